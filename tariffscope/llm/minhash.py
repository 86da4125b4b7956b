"""Near-duplicates by weighted min-hashing of TF-IDF shingles.

A document is its word 5-grams, each weighted by its count and by 1 + log10 of the inverse share of
documents that have it. These shares are counted for every shingle: distinct texts are stored in chunks of some thousands, a chunk
sends its distinct shingles, as sorted arrays, to buckets by their first bits, and each bucket answers every chunk
with those that several documents have, and in how many. So shingles are never rows, one that all documents have is sent once a chunk,
and no table of shingles goes to the driver or to every task. What was counted is stored with each text, for the comparisons.

Improved consistent weighted sampling draws ``SAMPLES`` samples per document, so that two documents' samples
agree with the probability of their weighted Jaccard similarity. They are banded; documents that share a
band are compared with its leaders (``links.linked_roots``) by exact weighted Jaccard
similarity over their whole texts. Texts of large buckets, which are mostly unlike where a passage is common to them or a family of copies has
many edits, are first dealt out by their rarest shingles, of which similar texts share some (``by_rare_shingles``). Classes are the connected components of the links.

Texts, not rows, are compared: exact copies are one node however many they are.

Defined results: null texts and texts without words are each a class of their own, and so is each such row; a text of
fewer than five words is one shingle; repeated rows are one class; a class is named by its smallest document id, null
if no member has one; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tariffscope.llm.common import Scratch, document_key, unused
from tariffscope.llm.hashing import Prefixes, as_signed, mix
from tariffscope.llm.links import linked_roots

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 16, 4
SAMPLES = BANDS * ROWS
# Bytes of text in a chunk, and in all chunks for each bucket of shingles; shingles that a task holds before it deals them out.
CHUNK, BUCKET, HELD = 6_000_000, 8_000_000, 2_000_000
BROADCAST_TEXTS = 2_000_000
PAIRS_A_TASK = 5_000
# The words of shingles(): what ASCII white space leaves.
WITH_WORDS = r"[^\t-\r\x1c- ]"
_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
_STEP = 1024


def _odd(seed: int, n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


# Groups of samples that deal large buckets out anew: so many, across the bands, that a pair at SIMILARITY which shares a band
# agrees in none of them with a probability of about 3e-5 (simulated).
GROUPS = np.stack([np.random.Generator(np.random.PCG64(41 + k)).choice(SAMPLES, 6, replace=False) for k in range(96)])
_MULTIPLIERS = [_odd(11 + k, SAMPLES) for k in range(3)]
_OF_WORD = _odd(29, WORDS)


def shingles(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a text's distinct shingles, sorted, and how often each occurs."""
    prefixes = Prefixes((text or "").lower().encode("utf-8", "surrogatepass"))
    inside = np.concatenate([[False], ~_SPACES[prefixes.bytes], [False]]).view(np.int8)
    edges = np.diff(inside)
    words = prefixes.between(np.flatnonzero(edges == 1), np.flatnonzero(edges == -1))
    if not len(words):
        return words, np.zeros(0, np.int64)
    n = max(1, len(words) - WORDS + 1)
    total = np.zeros(n, np.uint64)
    for k in range(min(WORDS, len(words))):
        total += words[k : k + n] * _OF_WORD[k]
    return np.unique(mix(total), return_counts=True)


class Weights:
    """Shingles' weights among so many ``documents``; ``common`` lists those that share of them has, and one has any other."""

    def __init__(self, common: np.ndarray, shares: np.ndarray, documents: int = 1):
        order = np.argsort(common)
        self.common, self.often, self.documents = common[order], shares[order] * documents, documents

    def idf(self, often: np.ndarray) -> np.ndarray:
        return 1 - np.log10(often / self.documents)

    def of(self, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.idf(_looked_up(hashes, self.common, self.often)) * counts

    def of_part(self, part: pa.RecordBatch, parts: list) -> list[np.ndarray]:
        """Weights of a batch's shingled texts, by the documents' numbers in its column ``often`` where it has one."""
        if "often" not in part.schema.names:
            return [self.of(*each) for each in parts]
        often = [np.frombuffer(o, np.uint32) for o in part.column("often").to_pylist()]
        return [self.idf(o) * counts for o, (_, counts) in zip(often, parts, strict=True)]


def _looked_up(hashes: np.ndarray, known: np.ndarray, often: np.ndarray) -> np.ndarray:
    """How often each of the hashes is, by sorted ``known`` ones; 1 if it is not known."""
    found = np.ones(len(hashes), often.dtype)
    if len(known):
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        same = known[at] == hashes
        found[same] = often[at[same]]
    return found


def signature(hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """One 32-bit number for each of the samples."""
    best, sample = np.full(SAMPLES, np.inf, np.float32), np.zeros(SAMPLES, np.uint32)
    scale, low = np.float32(2.0**-24), np.uint64(0xFFFFFF)
    for at in range(0, len(hashes), _STEP):
        x = hashes[at : at + _STEP, None]
        log_weight = np.log(weights[at : at + _STEP]).astype(np.float32)[:, None]
        z = x * _MULTIPLIERS[0]
        z ^= z >> np.uint64(29)
        z *= _MULTIPLIERS[1]
        z ^= z >> np.uint64(32)
        half = np.float32(0.5)
        r = ((z & low).astype(np.float32) + half) * ((z >> np.uint64(24) & low).astype(np.float32) + half)
        r = -np.log(r * (scale * scale))  # Gamma(2, 1)
        beta = (z >> np.uint64(48)).astype(np.float32) * np.float32(2.0**-16)
        z *= _MULTIPLIERS[2]
        z ^= z >> np.uint64(31)
        c = ((z & low).astype(np.float32) + half) * ((z >> np.uint64(24) & low).astype(np.float32) + half)
        c = np.log(-np.log(c * (scale * scale)))
        t = np.floor(log_weight / r + beta)
        c -= r * (t - beta + np.float32(1))
        least = c.argmin(axis=0)
        columns = np.arange(SAMPLES)
        value = c[least, columns]
        better = value < best
        steps = t[least, columns].astype(np.int64).view(np.uint64)
        named = (mix(x[least, 0] + steps * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
        best[better], sample[better] = value[better], named[better]
    return sample


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], weights: Weights) -> float:
    """Weighted Jaccard similarity of two texts' shingles."""
    return _similarity(a, b, float(weights.of(*a).sum() + weights.of(*b).sum()), weights.of(a[0], np.ones(len(a[0]))))


def _similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], both: float, idf: np.ndarray) -> float:
    """The same, given the sum of ``both`` texts' weights and the weight of each shingle of ``a``."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    in_a = b[0][at] == a[0]
    shared = (idf[in_a] * np.minimum(a[1][in_a], b[1][at[in_a]])).sum()
    return float(shared / (both - shared))


def _texts(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, list]]:
    for batch in batches:
        for at in range(0, batch.num_rows, 128):
            part = batch.slice(at, 128)
            yield part, [shingles(t) for t in part.column(column).to_pylist()]


def _totals(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes, sorted, and the sums of their counts."""
    found = np.sort(hashes)
    starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(found)), bool), found[1:] != found[:-1]]))
    sums, found = np.diff(np.append(starts, len(found))), found[starts]
    more = counts > 1
    np.add.at(sums, np.searchsorted(found, hashes[more]), counts[more].astype(np.int64) - 1)
    return found, sums


def _packed(hashes: np.ndarray) -> bytes:
    """Sorted hashes with all first bytes first, and so on: those compress."""
    return hashes.view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpacked(packed: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(packed, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


def _chunked(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """(node, copies, size, text) with a ``chunk``: some ``most`` bytes of text in one task, or a single longer text."""
    first, before = TaskContext.get().partitionId() << 32, 0
    for batch in batches:
        ends = before + np.cumsum(batch.column("size").to_numpy())
        before = int(ends[-1]) if len(ends) else before
        yield batch.append_column("chunk", pa.array(first + ends // most, pa.int64()))


def _dealt(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Each chunk's distinct shingles, and in how many documents of the chunk they are, by buckets of shingles."""
    edges = np.array([(k << 64) // buckets for k in range(1, buckets)], np.uint64)
    held, copies, size, at = [], [], 0, None

    def dealt() -> pa.RecordBatch:
        found, sums = _totals(np.concatenate(held), np.repeat(np.array(copies), [len(h) for h in held]))
        cuts = [0, *np.searchsorted(found, edges).tolist(), len(found)]
        spans = [(k, *span) for k, span in enumerate(zip(cuts, cuts[1:])) if span[0] < span[1]]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([at] * len(spans), pa.int64()),
                pa.array([k for k, _, _ in spans], pa.int32()),
                pa.array([_packed(found[a:b]) for _, a, b in spans], pa.binary()),
                pa.array([sums[a:b].tobytes() if sums[a:b].max() > 1 else None for _, a, b in spans], pa.binary()),
            ],
            ["chunk", "bucket", "hashes", "counts"],
        )

    for part, parts in _texts(batches):
        for chunk, n, (hashes, _) in zip(part.column("chunk").to_pylist(), part.column("copies").to_pylist(), parts, strict=True):
            if held and (chunk != at or size > HELD):
                yield dealt()
                held, copies, size = [], [], 0
            at, size = chunk, size + len(hashes)
            held.append(hashes)
            copies.append(n)
    if held:
        yield dealt()


def _answered(asked: pa.Table) -> pa.Table:
    """For each chunk that asks about a bucket's shingles (``chunk``, ``hashes``, ``counts``), those in several documents of all chunks, and how ``often``."""
    hashes = [_unpacked(h) for h in asked.column("hashes").to_pylist()]
    counts = [np.ones(len(h), np.int64) if c is None else np.frombuffer(c, np.int64) for h, c in zip(hashes, asked.column("counts").to_pylist(), strict=True)]
    found, sums = _totals(np.concatenate(hashes), np.concatenate(counts))
    found, sums = found[sums > 1], np.minimum(sums[sums > 1], np.iinfo(np.uint32).max).astype(np.uint32)
    often = [_looked_up(h, found, sums) for h in hashes]
    return pa.table(
        {
            "chunk": asked.column("chunk"),
            "hashes": pa.array([_packed(h[n > 1]) for h, n in zip(hashes, often, strict=True)], pa.binary()),
            "often": pa.array([n[n > 1].tobytes() for n in often], pa.binary()),
        }
    )


def _answers(answers: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All answers' distinct shingles, sorted, and how often they are."""
    known = np.concatenate([np.zeros(0, np.uint64), *map(_unpacked, answers.column("hashes").to_pylist())])
    often = np.concatenate([np.zeros(0, np.uint32), *(np.frombuffer(o, np.uint32) for o in answers.column("often").to_pylist())])
    known, first = np.unique(known, return_index=True)
    return known, often[first]


def counted(texts: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, int]:
    """The distinct ``texts`` with words (chunk, node, copies, size, text), stored as ``texts``; for each chunk, its shingles
    in several texts, copies included, and how ``often`` they are, stored as ``often``; and the number of texts."""
    has_words = F.col("text").rlike(WITH_WORDS)
    distinct = texts.where(has_words).groupBy(F.xxhash64("text").alias("node")).agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    distinct = distinct.select("node", "copies", F.octet_length("text").cast("long").alias("size"), "text")
    most, columns = CHUNK, "node long, copies long, size long, text string, chunk long"
    stored = scratch.keep(distinct.mapInArrow(lambda batches: _chunked(batches, most), columns), "texts")
    n, size = stored.agg(F.sum("copies"), F.sum("size")).first()
    buckets = (size or 0) // BUCKET + 1
    asked = stored.select("chunk", "copies", "text").mapInArrow(
        lambda batches: _dealt(batches, buckets), "chunk long, bucket int, hashes binary, counts binary"
    )
    often = asked.groupBy("bucket").applyInArrow(_answered, "chunk long, hashes binary, often binary")
    return stored, scratch.keep(often, "often"), n or 0


def learn_weights(texts: DataFrame) -> Weights:
    """Weights of all shingles of all ``texts`` (text), copies included, for one process. text_roots() never brings them together like this."""
    scratch = Scratch(texts.sparkSession, "minhash-weights")
    _, often, n = counted(texts.select("text"), scratch)
    known, numbers = _answers(often.select("hashes", "often").toArrow())
    scratch.drop_all()
    return Weights(known, numbers / max(n, 1), max(n, 1))


def _signed(texts: pa.Table, answers: pa.Table, weights: Weights) -> pa.Table:
    """A chunk's texts' buckets, and how ``often`` each of their shingles is."""
    known, numbers = _answers(answers)
    made = []
    for part, parts in _texts(texts.to_batches()):
        often = [_looked_up(hashes, known, numbers) for hashes, _ in parts]
        part = part.select(["node", "text"]).append_column("often", pa.array([o.tobytes() for o in often], pa.binary()))
        made += _signatures(iter([part]), weights)
    return pa.Table.from_batches(made, pa.schema([("node", pa.int64()), ("buckets", pa.list_(pa.int64())), ("often", pa.binary())]))


def _signatures(batches: Iterator[pa.RecordBatch], weights: Weights) -> Iterator[pa.RecordBatch]:
    for part, parts in _texts(batches):
        each = weights.of_part(part, parts)
        made = np.stack([signature(hashes, w) for (hashes, _), w in zip(parts, each, strict=True)])
        bands = made.reshape(len(parts), BANDS, ROWS).astype(np.uint64)
        total = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * np.uint64(0x632BE59BD9B4E019)
        for k in range(ROWS):
            total = mix(total + bands[:, :, k])
        yield pa.RecordBatch.from_arrays(
            [
                part.column("node"),
                pa.array(list(as_signed(total)), pa.list_(pa.int64())),
                part.column("often"),
            ],
            ["node", "buckets", "often"],
        )


def _regrouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node's new buckets for (bucket, node, samples): the old one and the samples of one group. text_roots() deals out by
    shingles instead, which loses no pair and makes fewer rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, _STEP):
            part = batch.slice(at, _STEP)
            samples = np.frombuffer(b"".join(part.column("samples").to_pylist()), np.uint32).reshape(-1, SAMPLES).astype(np.uint64)
            total = np.arange(1, len(GROUPS) + 1, dtype=np.uint64)[None, :] * np.uint64(0x632BE59BD9B4E019)
            total = mix(total + part.column("bucket").to_numpy().view(np.uint64)[:, None])
            for k in range(GROUPS.shape[1]):
                total = mix(total + samples[:, GROUPS[:, k]])
            yield pa.RecordBatch.from_arrays(
                [part.column("node"), pa.array(list(as_signed(total)), pa.list_(pa.int64()))], ["node", "buckets"]
            )


def _shingled(batches: Iterator[pa.RecordBatch], weights: Weights) -> Iterator[pa.RecordBatch]:
    """Each node's shingles, their counts, how often they are, and the sum of their weights: computed once a text, not once a pair."""
    for part, parts in _texts(batches):
        yield pa.RecordBatch.from_arrays(
            [
                part.column("node"),
                pa.array([hashes.tobytes() for hashes, _ in parts], pa.binary()),
                pa.array([counts.astype(np.uint32).tobytes() for _, counts in parts], pa.binary()),
                part.column("often"),
                pa.array([float(w.sum()) for w in weights.of_part(part, parts)], pa.float64()),
            ],
            ["node", "hashes", "counts", "often", "total"],
        )


def _weighed(batches: Iterator[pa.RecordBatch], weights: Weights) -> Iterator[pa.RecordBatch]:
    """A row for each of a node's shingles, with its weight and that of all."""
    for part, parts in _texts(batches):
        each = weights.of_part(part, parts)
        sizes = [len(w) for w in each]
        yield pa.RecordBatch.from_arrays(
            [
                part.column("node").take(pa.array(np.repeat(np.arange(len(sizes)), sizes))),
                pa.array(as_signed(np.concatenate([hashes for hashes, _ in parts]))),
                pa.array(np.concatenate(each)),
                pa.array(np.repeat([w.sum() for w in each], sizes)),
            ],
            ["node", "shingle", "weight", "total"],
        )


def mostly_own(held: DataFrame) -> DataFrame:
    """``node`` of texts, of ``held`` (node, shingle, weight, total), of which so much is in no other that they are similar to none."""
    own = held.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), *(F.min(c).alias(c) for c in ("node", "weight", "total"))).where("n = 1")
    own = own.groupBy("node").agg(F.sum("weight").alias("own"), F.min("total").alias("total"))
    return own.where(F.col("own") > (1 - SIMILARITY * (1 - 1e-6)) * F.col("total")).select("node")


def by_rare_shingles(held: DataFrame, scratch: Scratch) -> DataFrame:
    """Buckets (bucket, node) in which any two texts of ``held`` (node, shingle, weight, total) at SIMILARITY meet, and few others.

    Texts at SIMILARITY s weigh total_a and total_b, and share s / (1 + s) of their sum at least. With each text's shingles from the rarest among
    ``held`` to the most frequent, the first that both have is followed, in both, by all that they share. So a text is in a shingle's bucket
    only if from this shingle on it has as much as it would share with the lightest text there. What a text has alone comes first.
    """
    often = scratch.keep(held.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "often")
    onward = Window.partitionBy("node").orderBy(F.desc("n"), F.desc("shingle")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    common = held.join(often, "shingle").withColumn("onward", F.sum("weight").over(onward))
    # A little less than SIMILARITY asks, for what floating point numbers lack.
    least, share = SIMILARITY * (1 - 1e-6), SIMILARITY / (1 + SIMILARITY) * (1 - 1e-6)
    kept = scratch.keep(common.where(F.col("onward") >= least * F.col("total")).select("shingle", "node", "total", "onward"), "onward")
    lightest = kept.groupBy("shingle").agg(F.min("total").alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    enough = F.col("onward") >= share * (F.col("total") + F.greatest("low", least * F.col("total")))
    kept = scratch.keep(kept.join(lightest, "shingle").where(enough).drop("low"), "enough")
    scratch.drop("often", "onward")
    return kept.select(F.col("shingle").alias("bucket"), "node", F.struct("onward", "total").alias("held"))


# Of two texts whose first common shingle is a bucket's, both have all that they share from there on.
FITS = f"least(held.onward, leader_held.onward) >= {SIMILARITY / (1 + SIMILARITY) * (1 - 1e-6)!r}D * (held.total + leader_held.total)"


def _similar(batches: Iterator[pa.RecordBatch], weights: Weights) -> Iterator[pa.RecordBatch]:
    def held(batch: pa.RecordBatch, end: str, i: int) -> tuple[np.ndarray, np.ndarray]:
        return (
            np.frombuffer(batch.column(f"hashes_{end}")[i].as_buffer(), np.uint64),
            np.frombuffer(batch.column(f"counts_{end}")[i].as_buffer(), np.uint32),
        )

    def idf(batch: pa.RecordBatch, i: int) -> np.ndarray:
        return weights.idf(np.frombuffer(batch.column("often_a")[i].as_buffer(), np.uint32))

    for batch in batches:
        a, b = (batch.column(c).to_numpy() for c in ("total_a", "total_b"))
        # The lighter text's weight is the most that both can share.
        possible = np.minimum(a, b) >= SIMILARITY * np.maximum(a, b) * (1 - 1e-9)
        good = [
            bool(possible[i]) and _similarity(held(batch, "a", i), held(batch, "b", i), a[i] + b[i], idf(batch, i)) >= SIMILARITY
            for i in range(batch.num_rows)
        ]
        yield batch.select(["node", "leader"]).filter(pa.array(good, pa.bool_()))


def text_roots(texts: DataFrame) -> DataFrame:
    """``node``, a text's hash, and ``root``, the smallest node of its class, for texts (text) with links to others."""
    scratch = Scratch(texts.sparkSession, "minhash")
    stored, often, n = counted(texts, scratch)
    weights = Weights(np.zeros(0, np.uint64), np.zeros(0), max(n, 1))
    signed = stored.select("chunk", "node", "text").groupBy("chunk").cogroup(often.groupBy("chunk")).applyInArrow(
        lambda texts, answers: _signed(texts, answers, weights), "node long, buckets array<long>, often binary"
    )
    signed = scratch.keep(signed, "signatures")
    scratch.drop("often")

    def texts_of(wanted: DataFrame) -> DataFrame:
        """node, text and how often its shingles are, of the ``wanted`` (node), each once."""
        wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_TEXTS else wanted
        return stored.select("node", "text").join(wanted, "node", "left_semi").join(signed.select("node", "often").join(wanted, "node", "left_semi"), "node")

    def verify(pairs: DataFrame) -> DataFrame:
        inner = Scratch(texts.sparkSession, "minhash-pairs")
        wanted = inner.keep(pairs.select("node").union(pairs.select("leader")).distinct(), "wanted")
        shingled = texts_of(wanted).mapInArrow(
            lambda batches: _shingled(batches, weights), "node long, hashes binary, counts binary, often binary, total double"
        )
        found = inner.keep(shingled, "shingles")
        # Pairs are small and their comparison is not: their bytes alone would put them into too few tasks.
        parts = min(pairs.count() // PAIRS_A_TASK + 1, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        both = pairs.repartition(parts, "node", "leader").join(found.toDF("node", "hashes_a", "counts_a", "often_a", "total_a"), "node")
        both = both.join(found.drop("often").toDF("leader", "hashes_b", "counts_b", "total_b"), "leader")
        good = inner.keep(both.mapInArrow(lambda batches: _similar(batches, weights), "node long, leader long"), "good")
        inner.drop("wanted", "shingles")
        return good

    members = signed.select(F.explode("buckets").alias("bucket"), "node")

    def thin(crowded: DataFrame) -> DataFrame:
        """Texts of large buckets, in buckets by the shingles that similar ones have to share."""
        inner = Scratch(texts.sparkSession, "minhash-crowded")
        wanted = inner.keep(crowded.select("node").distinct(), "wanted")
        found = inner.keep(texts_of(wanted), "found")
        weigh = lambda rows: rows.mapInArrow(
            lambda batches: _weighed(batches, weights), "node long, shingle long, weight double, total double"
        )
        # Most texts here have only a passage in common with others; what is left is few shingles.
        alone = inner.keep(mostly_own(weigh(found)), "alone")
        held = inner.keep(weigh(found.join(alone, "node", "left_anti")), "held")
        found = by_rare_shingles(held, inner)
        inner.drop("wanted", "found", "alone", "held")
        return found

    roots = linked_roots(members, verify, scratch, thin=thin, fits=F.expr(FITS))
    scratch.drop("texts")
    return roots


def _keyed(documents: DataFrame) -> DataFrame:
    """doc_id, document key and ``class``: the class' root, or the text's hash; null for texts without words."""
    roots = text_roots(documents)
    has_words = F.col("text").rlike(WITH_WORDS)
    keyed = documents.select("doc_id", *document_key(), F.when(has_words, F.xxhash64("text")).alias("node"))
    keyed = keyed.join(roots, "node", "left").select("doc_id", "doc", "doc_hash", F.coalesce("root", "node").alias("class"))
    return Scratch(documents.sparkSession, "minhash-classes").keep(keyed, "keyed")


def classes(documents: DataFrame) -> DataFrame:
    """doc_id, class_id (the class' smallest doc_id) and class_size, its rows, for every row."""
    keyed = _keyed(documents)
    sizes = keyed.where("class is not null").groupBy("class").agg(
        F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size")
    )
    alone = keyed.where("class is null").select(
        "doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size")
    )
    return keyed.join(sizes, "class").select("doc_id", "class_id", "class_size").union(alone)


def one_of_each(documents: DataFrame) -> DataFrame:
    """``documents`` with one row of each class, that with the smallest doc_id, nulls last; rows without words all stay."""
    columns = documents.columns
    keyed = _keyed(documents)
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc", "doc_hash")
    first = keyed.where("class is not null").groupBy("class").agg(F.min(order).alias("first"))
    key, key_hash = unused(columns, "_doc"), unused(columns, "_hash")
    first = first.select(F.col("first.doc").alias(key), F.col("first.doc_hash").alias(key_hash))
    doc, doc_hash = document_key()
    has_words = F.coalesce(F.col("text").rlike(WITH_WORDS), F.lit(False))
    rows = documents.withColumns({key: doc, key_hash: doc_hash})
    # Rows equal in id and text have one key.
    chosen = rows.where(has_words).join(first, [key, key_hash], "left_semi").dropDuplicates([key, key_hash])
    return chosen.select(*columns).unionByName(documents.where(~has_words))
