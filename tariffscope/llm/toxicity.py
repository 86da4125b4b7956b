"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton.

Texts are folded first: lower case, letters that look like Latin ones, digits that stand for
letters, and signs between letters that do. The lexicon is learned from labelled texts: words and
beginnings of words that are far more frequent in toxic ones, weighted by their log odds.
A term must occur in several contexts, so that what only copies of one text have in common is no
term. Phrases around a term that only clean texts have, and those given, are exceptions: terms inside
them don't count. A document's score is a logistic function of its summed weights,
as they are and per word, fitted on the same texts.

At most ``PER_CLASS`` labelled texts of either class, those with the smallest hashes of their ids, are
learned from; so the model's size and the driver's share don't grow with the data. Scoring is one pass over whole
texts with nothing shuffled.

Defined results: null and empty texts score as a text without terms; a null id belongs to no label and
isn't held out; of conflicting labels of an id each is used; labels with nulls are
not used; repeated rows are each scored; without toxic or without clean labels there is no
term and every score is 0; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import json
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tariffscope.llm.common import Scratch

PER_CLASS = 6000
MAX_TERMS = 4000
SHORTEST, LONGEST = 4, 10
LEAST_DOCUMENTS, LEAST_CONTEXTS, LEAST_WEIGHT = 3, 3, 2.5
THRESHOLD = 0.7
# Bounds a worker's memory, which it keeps while later stages run.
COUNTED_AT_ONCE = 300
EXCEPTIONS: tuple[str, ...] = ()
# Letters of other scripts and digits, and the Latin letters they look like.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h",
    "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ѵ": "v", "α": "a", "ε": "e", "ι": "i", "κ": "k",
    "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g", "ո": "n", "օ": "o",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b",
}
# Signs, and the letters they stand for between letters.
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "l", "€": "e"}
INVISIBLE = "­​‌‍⁠﻿"
_SIGN_IN_WORD = re.compile(r"(?<=[^\W\d_])[@$!|€](?=[^\W\d_])")
_FULL_WIDTH = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)}


class _Folding(dict):
    """For str.translate: anything that is not a letter becomes a space."""

    def __missing__(self, code: int) -> str | int:
        char = chr(code)
        made = char if char.isalpha() else " "
        self[code] = made
        return made


FOLDING = _Folding({ord(k): v for k, v in LOOKALIKES.items()} | {ord(c): None for c in INVISIBLE})
FOLDING |= {ord("2"): " ", ord("6"): " ", ord("9"): " "}


def fold(text: str | None) -> str:
    """Words of folded letters, each with one space before it, and one at the end."""
    text = text or ""
    if not text.isascii():
        text = text.translate(_FULL_WIDTH)
    text = text.lower()
    if any(sign in text for sign in SIGNS):
        text = _SIGN_IN_WORD.sub(lambda m: SIGNS[m[0]], text)
    return f" {' '.join(text.translate(FOLDING).split())} "


def terms_of(word: str) -> list[str]:
    """What a word may be matched by: its beginnings, and itself with its end."""
    return [f" {word[:n]}" for n in range(SHORTEST, min(LONGEST, len(word)) + 1)] + [f" {word} "]


class Matcher:
    """Terms and exception phrases in one automaton; a term's weight is its value."""

    def __init__(self, weights: dict[str, float], exceptions: list[str]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for phrase in exceptions:
            self.automaton.add_word(phrase, (len(phrase), None, phrase))
        for term, weight in weights.items():
            if term not in exceptions:
                self.automaton.add_word(term, (len(term), weight, term))
        if len(self.automaton):
            self.automaton.make_automaton()

    def matches(self, folded: str) -> list[tuple[int, int, float, str]]:
        """Start, end, weight and text of the terms outside exceptions; of those that begin
        a word, the longest."""
        if not len(self.automaton):
            return []
        longest, spared = {}, []
        for last, (length, weight, term) in self.automaton.iter(folded):
            start = last - length + 1
            if weight is None:
                spared.append((start, last + 1))
            elif length > longest.get(start, (0,))[0]:
                longest[start] = (length, weight, term)
        return [
            (start, start + length, weight, term)
            for start, (length, weight, term) in sorted(longest.items())
            if not any(a <= start and start + length <= b for a, b in spared)
        ]

    def features(self, text: str | None) -> tuple[float, float]:
        """Log of the summed weights, and of a thousand times that per word."""
        folded = fold(text)
        total = sum(m[2] for m in self.matches(folded))
        words = max(1, folded.count(" ") - 1)
        return math.log1p(total), math.log1p(1000 * total / words)


@functools.lru_cache(maxsize=4)
def _matcher(model: str) -> Matcher:
    """One automaton per worker process and model."""
    model = json.loads(model)
    return Matcher(model["weights"], model["exceptions"])


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of either class that hold a term, for some documents at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, COUNTED_AT_ONCE):
            part = batch.slice(at, COUNTED_AT_ONCE)
            counts: dict[int, Counter] = {0: Counter(), 1: Counter()}
            for text, toxic in zip(part.column("text").to_pylist(), part.column("toxic").to_pylist()):
                counts[toxic].update({t for w in set(fold(text).split()) for t in terms_of(w)})
            terms = list(counts[0] | counts[1])
            columns = [pa.array(terms, pa.string())]
            columns += [pa.array([counts[k][t] for t in terms], pa.int64()) for k in (1, 0)]
            yield pa.RecordBatch.from_arrays(columns, ["term", "toxic", "clean"])


def _contexts(batches: Iterator[pa.RecordBatch], model: str) -> Iterator[pa.RecordBatch]:
    """Each document's matches of terms with the words beside them, each once."""
    matcher = _matcher(model)
    for batch in batches:
        rows = set()
        for doc, text, toxic in zip(*(batch.column(c).to_pylist() for c in ("doc", "text", "toxic"))):
            folded = fold(text)
            for start, _, _, term in matcher.matches(folded):
                before = folded[max(0, start - LONGEST * 4) : start].split()[-1:]
                word, *after = folded[start : start + LONGEST * 8].split()[:2]
                rows.add((doc, term, " ".join(before), word, " ".join(after), toxic))
        yield pa.RecordBatch.from_pylist(
            [dict(zip(("doc", "term", "before", "word", "after", "toxic"), r)) for r in rows],
            pa.schema([("doc", pa.int64()), *((n, pa.string()) for n in ("term", "before", "word", "after")), ("toxic", pa.int32())]),
        )


def _features(batches: Iterator[pa.RecordBatch], model: str) -> Iterator[pa.RecordBatch]:
    matcher = _matcher(model)
    for batch in batches:
        found = [matcher.features(text) for text in batch.column("text").to_pylist()]
        columns = [pa.array([f[k] for f in found], pa.float64()) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([*columns, batch.column("toxic")], ["total", "density", "toxic"])


def _logistic(x: np.ndarray, y: np.ndarray) -> list[float]:
    """Ridge logistic regression, the classes weighted alike; Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    coef, ridge = np.zeros(x.shape[1]), 1e-4 * np.eye(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ coef, -30, 30)))
        gradient = x.T @ (share * (y - p)) - ridge @ coef
        hessian = (x * (share * p * (1 - p))[:, None]).T @ x + ridge
        coef += np.linalg.solve(hessian, gradient)
    return coef.tolist()


def _without_longer(weights: dict[str, float]) -> dict[str, float]:
    """Terms that no shorter term begins."""
    return {t: w for t, w in weights.items() if not any(t[:n] in weights for n in range(1 + SHORTEST, len(t)))}


def is_held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(
    documents: DataFrame,
    labels: DataFrame,
    per_class: int = PER_CLASS,
    exceptions: tuple[str, ...] = EXCEPTIONS,
) -> str:
    """The model, as JSON, from ``labels`` (doc_id, toxic) of ``documents`` (doc_id, text)."""
    spark = documents.sparkSession
    usable = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(
        "doc_id is not null and toxic in (0, 1)"
    )
    order = F.xxhash64("doc_id")
    chosen = [usable.where(F.col("toxic") == k).orderBy(order, "doc_id").limit(per_class) for k in (0, 1)]
    # Bounded by per_class, so small enough to broadcast; their texts are stored once.
    sample = Scratch(spark, "toxicity").keep(
        documents.select("doc_id", "text")
        .join(F.broadcast(chosen[0].union(chosen[1])), "doc_id").where("text is not null").select("text", "toxic")
        .distinct(),
        "sample",
    )
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        return json.dumps({"weights": {}, "exceptions": [], "coef": None})
    toxic, clean = F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("clean") + 0.5) / (n_clean + 1))
    candidates = (
        sample.mapInArrow(_count_terms, "term string, toxic long, clean long")
        .groupBy("term").agg(toxic, clean).withColumn("weight", odds)
        .where((F.col("toxic") >= LEAST_DOCUMENTS) & (F.col("weight") >= LEAST_WEIGHT))
        .orderBy(F.col("toxic").desc(), F.col("weight").desc(), "term").limit(MAX_TERMS)
    )
    weights = _without_longer({r["term"]: r["weight"] for r in candidates.collect()})
    # How many different surroundings a term has in toxic texts, and phrases that only clean ones have.
    folded_exceptions = [fold(e) for e in exceptions]
    model = json.dumps({"weights": weights, "exceptions": folded_exceptions})
    found = sample.withColumn("doc", F.xxhash64("text")).mapInArrow(
        lambda batches: _contexts(batches, model),
        "doc long, term string, before string, word string, after string, toxic int",
    )
    contexts = found.where("toxic = 1").select("term", "before", "word", "after").distinct().groupBy("term").count()
    varied = {r["term"] for r in contexts.where(F.col("count") >= LEAST_CONTEXTS).collect()}
    weights = {t: w for t, w in weights.items() if t in varied}
    phrases = found.select(
        "doc", "toxic", F.explode(F.array(F.concat_ws(" ", "before", "word"), F.concat_ws(" ", "word", "after"))).alias("phrase")
    )
    spared = (
        phrases.where("phrase like '% %'").distinct().groupBy("phrase")
        .agg(F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("clean"))
        .where(f"toxic = 0 and clean >= {LEAST_DOCUMENTS}")
        .orderBy(F.col("clean").desc(), "phrase").limit(MAX_TERMS)
    )
    folded_exceptions += [f" {r['phrase']} " for r in spared.collect()]
    model = json.dumps({"weights": weights, "exceptions": folded_exceptions})
    rows = sample.mapInArrow(
        lambda batches: _features(batches, model), "total double, density double, toxic int"
    ).toPandas()  # at most 2 * per_class rows of three numbers
    rows = rows.sort_values(list(rows.columns))  # sums of doubles depend on their order
    coef = _logistic(rows[["total", "density"]].to_numpy(), rows["toxic"].to_numpy())
    return json.dumps({"weights": weights, "exceptions": folded_exceptions, "coef": coef})


def _scores(batches: Iterator[pa.RecordBatch], model: str) -> Iterator[pa.RecordBatch]:
    matcher, coef = _matcher(model), json.loads(model)["coef"]
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            scores = []
            for text in part.column("text").to_pylist():
                total, density = matcher.features(text)
                level = coef[0] + coef[1] * total + coef[2] * density if coef else 0.0
                scores.append(1 / (1 + math.exp(-max(-700.0, level))) if coef else 0.0)
            made = {"toxicity": pa.array(scores, pa.float64())}
            yield pa.RecordBatch.from_arrays([*part.columns, *made.values()], [*part.schema.names, *made])


def score(documents: DataFrame, model: str) -> DataFrame:
    """``documents`` with a column ``toxicity`` from 0 to 1."""
    documents = documents.drop("toxicity")
    schema = StructType([*documents.schema.fields, StructField("toxicity", DoubleType())])
    return documents.mapInArrow(lambda batches: _scores(batches, model), schema)


def train_labels(labels: DataFrame) -> DataFrame:
    """Labels of documents that are not held out."""
    return labels.where(~is_held_out("doc_id"))


def assess(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document, learned from labels of the rest."""
    model = learn(documents, train_labels(labels))
    return score(documents.select("doc_id", "text"), model).select(
        "doc_id", is_held_out("doc_id").alias("held_out"), F.col("toxicity").alias("score"),
        F.when(F.col("toxicity") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
    )
