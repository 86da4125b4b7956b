"""Repeated strings of ``LENGTH`` bytes by prefix doubling over sampled positions.

Prefix doubling ranks positions by the string of 1, 2, 4, ... units that starts there; two ranks at a growing offset
make the next, and a position whose rank is unique leaves. Ranks here are names, equal for equal strings: deduplication needs
no order among different ones. Units are stretches between sampled positions, so a round has a row per stretch
and not per byte. Positions are sampled from content alone: of every ``WINDOW`` consecutive 16-byte strings, the one with
the smallest hash (leftmost among equals). So equal strings are sampled alike:

* every string of LENGTH bytes has an anchor, the sample of its first WINDOW positions; equal strings have it at the same place;
* from the anchor on, samples up to the first one ``REACH`` bytes later or more are inside the string.

The units up to there are an anchor's core. A string that occurs twice has an anchor whose core does; doubling
finds these, and stops at cores that are unique or complete; cores of MANY_UNITS units or more, where a short string
repeats at once, are named in one step instead of many rounds. Then the strings that belong to an anchor, at most WINDOW neighbouring starts, are
judged together: if all the bytes they cover occur elsewhere too, all repeat. Where contexts of
one core differ, as at the ends of repeated passages, its contexts' strings are compared, once for each distinct context: first in blocks of
neighbouring strings by the bytes that these have in common, and strings themselves only in blocks where these occur again.

Equal strings are told by 64-bit hashes at each step, and by at least two independent ones in all. A core that a third of all documents hold is counted in partial aggregates, and its rows are spread
where they meet those counts by adaptive execution. No rows of one core are brought together.

Defined results: null and empty texts have no bytes and stay as they are; strings in the same document count,
overlapping or not; rows equal in id and text repeat each other; null ids are ids; columns other
than text stay as they are; an empty table stays empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tariffscope.llm.common import Scratch, document_key
from tariffscope.llm.hashing import Prefixes, as_signed, mix

LENGTH, WINDOW, GRAM = 400, 150, 16
# Cores of so many units or more lie in text that repeats at once; they get their names in one step.
MANY_UNITS = 8
REACH = LENGTH - (WINDOW + GRAM - 1) - (WINDOW - 1)
# Strings of one core are compared in blocks of so many, and then of fewer, as long as the bytes a block has in common are found again.
BLOCKS = (32, 4, 1)


def samples_of(prefixes: Prefixes) -> np.ndarray:
    """For each position, the smallest 16-byte string's start among it and the WINDOW - 1 after."""
    value = (prefixes.windows(GRAM) >> np.uint64(32)).astype(np.uint32)
    place = np.arange(len(value), dtype=np.int64)
    width = 1
    while width < WINDOW:
        step = min(width, WINDOW - width)
        later = value[step:] < value[:-step]
        place = np.where(later, place[step:], place[:-step])
        value = np.where(later, value[step:], value[:-step])
        width += step
    return place


def anchors(text: bytes) -> dict[str, np.ndarray]:
    """A text's anchors in order: ``at``, the starts ``low`` to ``high`` of the strings that belong to it (none for
    the last ones, which end units only), its ``unit``'s name, ``units`` in its core, and a name of its ``context``,
    all bytes of its strings."""
    n = len(text)
    if n < LENGTH:
        return {}
    prefixes = Prefixes(text)
    sample = samples_of(prefixes)
    first = np.flatnonzero(np.concatenate([[True], sample[1:] != sample[:-1]]))
    at = sample[first]
    high = np.minimum(np.concatenate([first[1:], [len(sample)]]) - 1, n - LENGTH)
    owns = first <= n - LENGTH
    unit = np.zeros(len(at), np.uint64)
    unit[:-1] = prefixes.between(at[:-1], at[1:] + GRAM)
    units = np.searchsorted(at, at + REACH) - np.arange(len(at))
    context = np.zeros(len(at), np.uint64)
    context[owns] = mix(
        prefixes.between(first[owns], high[owns] + LENGTH) + (at - first)[owns].astype(np.uint64) * np.uint64(0x632BE59BD9B4E019)
    )
    core = np.zeros(len(at), np.uint64)
    many = np.flatnonzero(owns & (units >= MANY_UNITS))
    core[many] = prefixes.between(at[many], at[many + units[many]] + GRAM)
    return {
        "at": at, "low": first, "high": np.where(owns, high, -1), "unit": unit, "units": np.where(owns, units, 0),
        "context": context, "whole": core,
    }


def _utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("at", "low", "high", "unit", "units", "context", "whole")
    for batch in batches:
        made, size = [], 0
        rows = zip(batch.column("doc").to_pylist(), batch.column("doc_hash").to_pylist(), batch.column("text"))
        for doc, doc_hash, text in rows:
            found = anchors(_utf8(text.as_py()))
            if found:
                n = len(found["at"])
                made.append((np.full(n, doc), np.full(n, doc_hash), np.arange(n), *(found[k].view(np.int64) for k in names)))
                size += n
            if size > 100_000:
                yield _batch(made)
                made, size = [], 0
        if made:
            yield _batch(made)


def _batch(made: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate(c)) for c in zip(*made)],
        ["doc", "doc_hash", "nth", "at", "low", "high", "unit", "units", "context", "whole"],
    )


KEY = ["doc", "doc_hash"]
STRINGS = ["core", "at", "low", "high", "many", "name"]
BROADCAST_KEYS = 1_000_000


def _repeated(rows: DataFrame, *names: str) -> DataFrame:
    """``rows`` whose ``names`` occur more than once. The smaller side is hashed, so that rows need no sorting."""
    often = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    return rows.join(often.hint("shuffle_hash"), list(names), "left_semi")


def repeated_cores(units: DataFrame, scratch: Scratch) -> DataFrame:
    """doc, doc_hash, nth and ``core`` of the anchors whose cores occur more than once, by doubling over ``units``
    (doc, doc_hash, nth, units, unit, whole), those of units that occur more than once."""
    ranks = units.select(*KEY, "nth", "units", F.col("unit").alias("rank"))
    done = units.where(f"units >= {MANY_UNITS}").select(*KEY, "nth", F.xxhash64("whole", "units").alias("core"))
    for n in count():
        offset = 1 << n
        # Cores of offset to 2 * offset - 1 units: two ranks that overlap cover them.
        ends = ranks.select(*KEY, F.col("nth").alias("end"), F.col("rank").alias("end_rank")).hint("shuffle_hash")
        ready = ranks.where(f"units >= {offset} and units < {2 * offset}")
        if offset == 1:
            ready = ready.select(*KEY, "nth", F.xxhash64("rank", "units").alias("core"))
        else:
            ready = (
                ready.withColumn("end", F.col("nth") + F.col("units") - offset).join(ends, [*KEY, "end"])
                .select(*KEY, "nth", F.xxhash64("rank", "end_rank", "units").alias("core"))
            )
        done = done.union(scratch.keep(ready, f"cores{n}"))
        # Later rounds are for documents that have longer cores.
        longer = ranks.where(f"units >= {2 * offset} and units < {MANY_UNITS}").select(*KEY).distinct()
        longer = scratch.keep(longer, f"longer{n}")
        if longer.isEmpty():
            return _repeated(done, "core")
        pairs = (
            ranks.join(longer.hint("shuffle_hash"), KEY, "left_semi")
            .withColumn("end", F.col("nth") + offset).join(ends, [*KEY, "end"])
            .select(*KEY, "nth", "units", F.xxhash64("rank", "end_rank").alias("rank"))
        )
        pairs = scratch.keep(pairs, f"pairs{n}")
        ranks = scratch.keep(_repeated(pairs, "rank"), f"ranks{n + 1}")
        scratch.drop(f"pairs{n}", *([f"ranks{n}"] if n else []))


def _strings(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """The strings of the anchors listed for a text, in blocks of at most ``width`` distances from the anchor: a row a block, named
    by the bytes that all strings at its distances have in common. Blocks are cut alike for all anchors, so if a string occurs again, so
    does its block's name; with a width of 1, blocks are strings."""
    for batch in batches:
        made, size = [], 0
        for row in range(batch.num_rows):
            doc, doc_hash = batch.column("doc")[row].as_py(), batch.column("doc_hash")[row].as_py()
            listed = batch.column("anchors")[row].values
            core, at, low, high, many = (
                listed.field(k).to_numpy(zero_copy_only=False) for k in ("core", "at", "low", "high", "many")
            )
            prefixes = Prefixes(_utf8(batch.column("text")[row].as_py()))
            first, last = (at - high) // width, (at - low) // width
            lengths = last - first + 1
            which = np.repeat(np.arange(len(core)), lengths)
            block = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths) + first[which]
            # Any one string of a block covers these bytes, so they lie in the text.
            starts = at[which] - block * width
            names = prefixes.between(starts, starts - (width - 1) + LENGTH) + block.astype(np.uint64) * np.uint64(0x632BE59BD9B4E019)
            n = len(block)
            lows, highs = np.maximum(low[which], starts - (width - 1)), np.minimum(high[which], starts)
            made.append((np.full(n, doc), np.full(n, doc_hash), core[which], at[which], lows, highs, many[which].astype(np.int32), as_signed(names)))
            size += n
            if size > 200_000 or row == batch.num_rows - 1:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*made)], [*KEY, *STRINGS])
                made, size = [], 0


def repeated_spans(documents: DataFrame) -> DataFrame:
    """doc, doc_hash and ``spans``, starts and ends of bytes that lie in repeated strings, of documents that have any."""
    scratch = Scratch(documents.sparkSession, "suffix")
    texts = documents.select(*document_key(), "text").where("text is not null")
    # Rows that repeat a document have one key. They repeat each other whole, and stand for one text from here on.
    again = scratch.keep(texts.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*KEY), "again")
    whole = None
    if not again.isEmpty():
        small = F.broadcast(again) if again.count() <= BROADCAST_KEYS else again
        once_more = scratch.keep(texts.join(small, KEY, "left_semi").dropDuplicates(KEY), "copies")
        texts = texts.join(small, KEY, "left_anti").union(once_more)
        whole = once_more.where(F.octet_length("text") >= LENGTH).select(
            *KEY, F.lit(0).cast("long").alias("start"), F.octet_length("text").cast("long").alias("end")
        )
    fields = "doc long, doc_hash long, nth long, at long, low long, high long, unit long, units long, context long, whole long"
    found = scratch.keep(texts.mapInArrow(_anchors, fields), "anchors")
    units = scratch.keep(_repeated(found.where("unit != 0"), "unit"), "units")
    scratch.drop("anchors")
    cores = scratch.keep(repeated_cores(units, scratch), "cores")
    known = scratch.keep(units.drop("unit", "units", "whole").join(cores.hint("shuffle_hash"), [*KEY, "nth"]).drop("nth"), "known")
    scratch.drop("units", "cores")
    # One row for each distinct context of a core, and one place where it is.
    contexts = scratch.keep(
        known.groupBy("core", "context").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*KEY, "at", "low", "high")).alias("one")), "contexts"
    )
    settled = known.join(contexts.where("n > 1").select("core", "context").hint("shuffle_hash"), ["core", "context"], "left_semi").select(
        *KEY, F.col("low").alias("start"), (F.col("high") + LENGTH).alias("end")
    )
    # Most contexts of one core have no string in common. Blocks of strings tell, in a hundredth of the rows that strings would be.
    left = _repeated(contexts, "core").select("one.*", "core", (F.col("n") > 1).cast("int").alias("many"))
    for width in BLOCKS:
        listed = left.groupBy(*KEY).agg(F.collect_list(F.struct("core", "at", "low", "high", "many")).alias("anchors"))
        strings = scratch.keep(
            texts.join(listed.hint("shuffle_hash"), KEY).mapInArrow(
                lambda batches, width=width: _strings(batches, width), "doc long, doc_hash long, core long, at long, low long, high long, many int, name long"
            ),
            f"strings{width}",
        )
        # What only contexts that are settled have needs no comparison.
        shared = strings.groupBy("core", "name").agg(F.count(F.lit(1)).alias("n"), F.min("many").alias("least")).where("n > 1 and least = 0")
        left = scratch.keep(strings.join(shared.select("core", "name").hint("shuffle_hash"), ["core", "name"], "left_semi").drop("name"), f"left{width}")
        scratch.drop(f"strings{width}")
    single = left.where("many = 0").select(*KEY, F.col("low").alias("start"), (F.col("low") + LENGTH).alias("end"))
    spans = settled.union(single)
    spans = spans if whole is None else spans.union(whole)
    return spans.groupBy(*KEY).agg(F.collect_set(F.struct("start", "end")).alias("spans"))


def merged_spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by spans; runs that touch are one."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    opens = np.concatenate([[True], starts[1:] > ends[:-1]])
    closes = np.concatenate([opens[1:], [True]])
    return starts[opens], ends[closes]


def _removed(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 128):
            rows = batch.slice(at, 128)
            out = []
            for row in range(rows.num_rows):
                text = rows.column("text")[row].as_py()
                data, spans = _utf8(text), rows.column("spans")[row]
                kept, n_spans = data, 0
                if spans.is_valid:
                    starts, ends = (spans.values.field(k).to_numpy() for k in ("start", "end"))
                    starts, ends = merged_spans(starts, ends)
                    stops = np.concatenate([starts, [len(data)]]).tolist()
                    kept = b"".join(data[a:b] for a, b in zip([0, *ends.tolist()], stops))
                    n_spans = len(starts)
                out.append((len(data), len(data) - len(kept), n_spans, hashlib.sha256(kept).hexdigest(), None if text is None else kept))
            columns = list(zip(*out))
            made = [pa.array(columns[k], pa.int64()) for k in range(3)] + [pa.array(columns[3], pa.string())]
            names = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                made.append(pa.array(columns[4], pa.binary()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *made], ["doc_id", *names])


def without_repeats(documents: DataFrame, with_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, unless left out, the bytes ``kept`` of every document
    (doc_id, text) after the removal of all bytes that lie in a repeated string."""
    spans = repeated_spans(documents)
    rows = documents.select(F.col("doc_id").cast("long"), "text", *document_key()).join(spans.hint("shuffle_hash"), KEY, "left")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return rows.select("doc_id", "text", "spans").mapInArrow(
        lambda batches: _removed(batches, with_text), schema + (", kept binary" if with_text else "")
    )
