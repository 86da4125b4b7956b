"""Harmonic packing: token sequences of fixed capacity filled by length class.

A class holds pieces of capacity / j tokens, and each of its sequences takes exactly j of
them. Documents may be cut freely, so each is cut into whole sequences and then into powers
of two; with a capacity that is a power of two, j pieces of a class then fill a sequence
without padding. A piece's sequence follows from its number within its class alone. Tasks
number their own pieces; the counts of each task and class, a table of a few rows per task,
are the only thing that is brought together.

The last pieces of a class, fewer than j, form sequences whose lengths are powers of two.

Defined results: a null or empty text is the end token alone; repeated rows and repeated or
null ids are packed like any others, each row once; other columns are ignored; an
empty table gives no pieces.
"""

from __future__ import annotations

import collections
import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tariffscope.llm.common import Scratch

CAPACITY = 4096
END_ID = 2
# Words whose ids a task remembers; memory is bounded, results do not depend on it.
CACHED_WORDS, LONGEST_CACHED = 1_200_000, 48
TEXTS_AT_ONCE = 256
SIGNS = "!#$%&()*+,-./:;=?@[]^_`{}~"


class WordEncoder:
    """Ids of a text, word by word.

    The tokenizer splits texts at white space and at changes between letters, digits and other
    signs, and lower-cases them. So the ids of a word that spaces or line ends set apart don't
    depend on its neighbours; signs after its last letter are
    coded apart from it; and a Latin capital counts as its small letter. Words met before need no encoding again, and new ones of
    letters only are encoded together: each ends at the one token that closes a word.
    """

    def __init__(self, tokenizer_path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        # Words met before are remembered here, so the tokenizer's own memory of words only costs time.
        model = self.tokenizer.model
        model._resize_cache(0)
        self.tokenizer.model = model
        self.known: dict[str, bytes] = {}
        closing = [i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]
        self.closes = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.closes[closing] = True

    def _ids(self, words: list[str]) -> list[bytes]:
        coded = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return [np.asarray(c.ids, dtype="<u4").tobytes() for c in coded]

    def _letters(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words of small letters only."""
        if not words:
            return {}
        (coded,) = self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)
        ids = np.asarray(coded.ids, dtype="<u4")
        ends = np.flatnonzero(self.closes[ids]) + 1
        if len(ends) != len(words):  # never met; a word was not one run of letters to the tokenizer
            return dict(zip(words, self._ids(words)))
        raw, ends = ids.tobytes(), (4 * ends).tolist()
        return {word: raw[i:j] for word, i, j in zip(words, [0, *ends], ends)}

    def _learn(self, words: set[str]) -> dict[str, bytes]:
        stems, odd, plain, known = [], [], {}, self.known
        for word in words:
            stem = word.rstrip(SIGNS)
            if stem.isalpha() and max(stem) < "\u0100":
                small = stem.lower()
                stems.append((word, small, word[len(stem) :]))
                if small not in known:
                    plain[small] = None
            else:
                odd.append(word)
        found = dict(zip(odd, self._ids(odd)))
        plain = self._letters(list(plain))
        signs = {sign for _, _, sign in stems if sign and sign not in known}
        plain.update(zip(signs, self._ids(list(signs))))
        for word, small, sign in stems:
            ids = plain[small] if small in plain else known[small]
            found[word] = ids + (plain[sign] if sign in plain else known[sign]) if sign else ids
        known.update(plain)
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit integers."""
        if len(self.known) > CACHED_WORDS:
            self.known = {}
        split = [text.replace("\n", " ").split(" ") for text in texts]
        coded = [list(map(self.known.get, words)) for words in split]
        new = {word for words, ids in zip(split, coded) for word, i in zip(words, ids) if i is None}
        new = self._learn(new)
        self.known.update(item for item in new.items() if len(item[0]) <= LONGEST_CACHED)
        return [
            b"".join([i if i is not None else new[word] for word, i in zip(words, ids)])
            for words, ids in zip(split, coded)
        ]


@functools.cache
def encoder(tokenizer_path: str) -> WordEncoder:
    """One for each worker process."""
    return WordEncoder(tokenizer_path)


def cut(n_tokens: int, capacity: int) -> list[int]:
    """Lengths of a document's pieces: whole sequences, then falling powers of two."""
    whole, rest = divmod(n_tokens, capacity)
    return [capacity] * whole + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def _pieces_of(batches: Iterator[pa.RecordBatch], tokenizer_path: str, capacity: int, end_id: int, with_ids: bool):
    words = encoder(tokenizer_path)
    end = np.asarray([end_id], dtype="<u4").tobytes()
    filled = [0] * capacity.bit_length()
    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
            part = batch.slice(at, TEXTS_AT_ONCE)
            rows, ids = [], []
            coded = words.encode([t or "" for t in part.column("text").to_pylist()])
            for doc_id, code in zip(part.column("doc_id").to_pylist(), coded):
                code += end
                total, start = len(code) // 4, 0
                for length in cut(total, capacity):
                    piece = code[4 * start : 4 * (start + length)]
                    kind = length.bit_length() - 1
                    rows.append((doc_id, start, length, zlib.crc32(piece), total, kind, filled[kind]))
                    filled[kind] += 1
                    start += length
                    if with_ids:
                        ids.append(np.frombuffer(piece, dtype="<u4").astype(np.int32))
            if not rows:
                continue
            columns = [pa.array(c, pa.int64()) for c in zip(*rows)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "kind", "number"]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)


def pack(
    documents: DataFrame,
    tokenizer_path: str,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece of ``documents`` (doc_id, text): where it starts in its document,
    its length and checksum, its sequence and offset there; with ``with_ids`` its token ids too.

    ``capacity`` is a power of two.
    """
    spark = documents.sparkSession
    if capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    scratch = Scratch(spark, "packing")
    top = capacity.bit_length() - 1
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, kind long, number long"
    # Numbers are given in the task and written with its number, so a later run of a task
    # cannot change them.
    pieces = scratch.keep(
        documents.select(F.col("doc_id").cast("long"), "text")
        .mapInArrow(
            lambda batches: _pieces_of(batches, tokenizer_path, capacity, end_id, with_ids),
            schema + (", ids array<int>" if with_ids else ""),
        )
        .withColumn("task", F.spark_partition_id()),
        "pieces",
    )
    # A row per task and class: earlier tasks' pieces come first.
    counts = pieces.groupBy("kind", "task").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("kind").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("kind", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    # A row per class, at most 13 at the default capacity.
    classes = (
        counts.groupBy("kind").agg(F.sum("n").alias("n"))
        .withColumn("per", F.expr(f"shiftleft(1L, cast({top} - kind as int))"))
        .withColumn("full", F.expr("n div per")).withColumn("rest", F.expr("n % per"))
    )
    lower = Window.orderBy("kind").rowsBetween(Window.unboundedPreceding, -1)
    classes = classes.select(
        "kind", "per", "full", "rest",
        F.coalesce(F.sum(F.expr("full + bit_count(rest)")).over(lower), F.lit(0)).alias("first"),
    )
    # The rest of a class: its count's binary digits give sequences of 2^b pieces each. A piece's
    # digit is the highest in which its own number differs from the count.
    placed = (
        pieces.join(offsets, ["kind", "task"]).join(F.broadcast(classes), "kind")
        .withColumn("nth", F.expr("number + earlier"))
        .withColumn("late", F.expr("nth - full * per"))
        .withColumn("digit", F.expr("case when late >= 0 then cast(floor(log2(late ^ rest) + 1e-9) as int) end"))
    )
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        F.expr(
            "first + case when late < 0 then nth div per"
            " else full + bit_count(shiftright(rest, digit + 1)) end"
        ).alias("sequence_id"),
        F.expr(
            "length * case when late < 0 then nth % per"
            " else late - shiftleft(shiftright(rest, digit + 1), digit + 1) end"
        ).alias("offset"),
        *(["ids"] if with_ids else []),
    )
