"""BPE encoding and decoding that encodes text shared by documents once.

Texts are cut into chunks where a rolling hash of the last ``WINDOW`` bytes says so, so equal passages fall into equal
chunks wherever they stand. Chunks are counted by a 128-bit digest; those that occur more than once are encoded once,
in Spark, and their ids go to the documents that hold them. The stretches between them are encoded where they are read.

Ids of neighbouring pieces don't simply add up: a word or a run of spaces may lie across the joint. So each joint is repaired: the
text from a safe place before it to one after it is encoded anew, starting with two such places on either side; if what lies between
these two does not come out as it was in the pieces, the window is widened until it does, at last to the whole text.
A safe place is one where the tokenizer's own pattern always splits: before a space that follows something
that is surely none. Texts with control characters whose kind of space is doubtful are encoded whole.

Which chunks are shared is told to the tasks by a Bloom filter of at most ``FILTER_BITS`` bits, not by a join of all texts; a chunk that it
takes for shared by mistake is encoded with the shared ones, which changes no result. Beyond some 10^7 shared
chunks more and more of them are, in the end all: then every chunk's text is shuffled once, in proportion to the input.

Defined results: a null or empty text has no ids; repeated rows and repeated or null ids each get their own row; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tariffscope.llm.common import Scratch, document_key

WINDOW, MEAN, LEAST = 32, 256, 64
FILTER_BITS = 1 << 26
# Units whose ids a task remembers; memory is bounded, results do not depend on it.
CACHED_UNITS, LONGEST_CACHED = 1_200_000, 48
SEEN_CHUNKS = 500_000
_GEAR = np.random.Generator(np.random.PCG64(20260102)).integers(0, 1 << 32, 256, dtype=np.uint32)

# Spaces and what follows them, up to the next space.
UNIT = re.compile(r"\s*\S+|\s+")
# Not every library calls these spaces, or calls them none.
DOUBTFUL = re.compile("[\x1c-\x1f\u180e\u200b\ufeff]")


def chunk_ends(data: bytes) -> list[int]:
    """Ends of the chunks of a text's bytes, never inside a character."""
    n = len(data)
    if n <= WINDOW:
        return [n] if n else []
    raw = np.frombuffer(data, np.uint8)
    rolling = _GEAR[raw]
    step = 1
    while step < WINDOW:
        rolling[step:] += rolling[:-step] << np.uint32(step)
        step *= 2
    found = np.flatnonzero(rolling[WINDOW - 1 : -1] < np.uint32((1 << 32) // MEAN)) + WINDOW
    found = found[raw[found] & 0xC0 != 0x80].tolist()
    ends, last = [], 0
    for end in found:
        if end - last >= LEAST:
            ends.append(end)
            last = end
    ends.append(n)
    return ends


def digests(chunks: list[bytes]) -> np.ndarray:
    """128-bit names of chunks, each two signed longs."""
    return np.frombuffer(b"".join([xxhash.xxh3_128_digest(c) for c in chunks]), ">i8").astype(np.int64).reshape(-1, 2)


class Window(NamedTuple):
    """Ids of a text to be encoded anew; those before and after the agreed places must come out as they were."""

    text: int
    start: int
    start_agreed: int
    end_agreed: int
    end: int
    needed: int


class Codec:
    """A tokenizer file's encoding of texts and decoding of ids."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        settings = json.loads(self.tokenizer.to_str())
        before = settings["pre_tokenizer"] or {}
        # Safe places follow from the byte-level pattern, with nothing that sees across them.
        self.has_safe_places = (
            settings["normalizer"] is None
            and before.get("type") == "ByteLevel"
            and before["use_regex"]
            and not before["add_prefix_space"]
            and not any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"] for t in settings["added_tokens"])
        )
        if not before.get("type") == "ByteLevel":
            raise ValueError("not a byte-level tokenizer")
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        # The byte-level alphabet: printable Latin-1 stands for itself, the other bytes, in order, for the characters from 256.
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
        self.bytes_of = [b""] * size
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            known = all(c in byte_of for c in token)
            self.bytes_of[i] = bytes(byte_of[c] for c in token) if known else token.encode()
        self.lengths = np.array([len(b) for b in self.bytes_of], np.int64)
        self.closes, self.opens = (np.array([f(b) for b in self.bytes_of]) for f in (self._ends_a_word, self._starts_with_space))
        self.units: dict[str, bytes] = {}

    @staticmethod
    def _starts_with_space(data: bytes) -> bool:
        return data[:1] in (b" ", b"\t", b"\n", b"\r")

    @staticmethod
    def _ends_a_word(data: bytes) -> bool:
        """Whether the last character is all there, and surely no space."""
        at = len(data) - 1
        while at > 0 and data[at] & 0xC0 == 0x80:
            at -= 1
        try:
            last = data[max(at, 0) :].decode()
        except UnicodeDecodeError:
            return False
        return bool(last) and not last.isspace() and not DOUBTFUL.search(last)

    def plain(self, texts: list[str]) -> list[bytes]:
        """Ids by the library alone, in the codec's kind of number."""
        return [np.asarray(c.ids, self.kind).tobytes() for c in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: set[str]) -> dict[str, bytes]:
        """Ids of units. Those that begin with a space and end without one add up, so they are encoded as one text."""
        joined = [u for u in new if len(u.lstrip()) < len(u) == len(u.rstrip())]
        rest = list(new.difference(joined))
        found = dict(zip(rest, self.plain(rest)))
        for at in range(0, len(joined), 5000):
            part = joined[at : at + 5000]
            (coded,) = self.plain(["".join(part)])
            ends = np.cumsum(self.lengths[np.frombuffer(coded, self.kind)])
            borders = np.searchsorted(ends, np.cumsum([len(u.encode()) for u in part]), "right") * self.kind.itemsize
            start = 0
            for unit, end in zip(part, borders.tolist()):
                found[unit] = coded[start:end]
                start = end
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text. Units between safe places that the worker has met need no encoding again."""
        if not self.has_safe_places:
            return self.plain(texts)
        if len(self.units) > CACHED_UNITS:
            self.units = {}
        whole = {i for i, text in enumerate(texts) if DOUBTFUL.search(text)}
        split = [[] if i in whole else UNIT.findall(text) for i, text in enumerate(texts)]
        coded = [list(map(self.units.get, units)) for units in split]
        unmet = [i for i, ids in enumerate(coded) if None in ids]
        new = {u for i in unmet for u, ids in zip(split[i], coded[i]) if ids is None}
        if new:
            new = self._learn(new)
            self.units.update(item for item in new.items() if len(item[0]) <= LONGEST_CACHED)
            for i in unmet:
                coded[i] = [ids if ids is not None else new[u] for u, ids in zip(split[i], coded[i])]
        result = list(map(b"".join, coded))
        order = sorted(whole)
        for i, ids in zip(order, self.plain([texts[i] for i in order])):
            result[i] = ids
        return result

    def ids(self, coded: bytes) -> np.ndarray:
        return np.frombuffer(coded, self.kind)

    def decode(self, ids: np.ndarray) -> str:
        """As the library decodes, special tokens included."""
        table = self.bytes_of
        return b"".join([table[i] for i in ids.tolist()]).decode("utf-8", "replace")

    def text(self, ids: np.ndarray) -> str:
        """The text of ids between characters."""
        return b"".join([self.bytes_of[i] for i in ids.tolist()]).decode()

    def joined(self, texts: list[list[bytes]]) -> list[bytes]:
        """Ids of texts, each from those of its pieces."""
        found = [self.ids(b"".join(pieces)) for pieces in texts]
        windows = [w for n, pieces in enumerate(texts) for w in self._windows(n, found[n], pieces)]
        changes: dict[int, list[tuple[int, int, bytes]]] = {}
        while windows:
            coded = self.encode([self.text(found[w.text][w.start : w.end]) for w in windows])
            wider = []
            for window, new in zip(windows, coded):
                ids = found[window.text]
                before = ids[window.start : window.start_agreed].tobytes()
                after = ids[window.end_agreed : window.end].tobytes()
                if new.startswith(before) and new.endswith(after):
                    changes.setdefault(window.text, []).append((window.start, window.end, new))
                else:
                    wider.append(window)
            # A wider window may reach into a neighbour's, so all of such a text's are drawn up again.
            again = {w.text: w.needed * 2 for w in wider}
            for n in again:
                changes.pop(n, None)
            windows = [w for n, needed in again.items() for w in self._windows(n, found[n], texts[n], needed)]
        result = []
        for n, ids in enumerate(found):
            at, parts = 0, []
            for start, end, new in sorted(changes.get(n, [])):
                parts += [ids[at:start].tobytes(), new]
                at = end
            result.append(b"".join([*parts, ids[at:].tobytes()]))
        return result

    def _windows(self, text: int, ids: np.ndarray, pieces: list[bytes], needed: int = 2) -> list[Window]:
        """What to encode anew around the joints of one text, ``needed`` safe places away where there are so many; where
        two meet, one window for both."""
        joints = np.unique(np.cumsum([len(p) // self.kind.itemsize for p in pieces])[:-1]) if len(pieces) > 1 else np.empty(0, int)
        joints = joints[(joints > 0) & (joints < len(ids))]
        if not len(joints):
            return []
        if self.has_safe_places:
            safe = np.flatnonzero(self.closes[ids[:-1]] & self.opens[ids[1:]]) + 1
        else:
            safe = np.empty(0, int)
        joints = joints[~np.isin(joints, safe)]
        before = np.searchsorted(safe, joints)  # safe[before - 1] < joint < safe[before]
        found: list[Window] = []
        for i in before.tolist():
            enough_before, enough_after = i >= needed, i + needed <= len(safe)
            start, start_agreed = (int(safe[i - needed]), int(safe[i - 1])) if enough_before else (0, 0)
            end, end_agreed = (int(safe[i + needed - 1]), int(safe[i])) if enough_after else (len(ids), len(ids))
            if found and start < found[-1].end:
                last = found[-1]
                found[-1] = Window(text, last.start, last.start_agreed, max(end_agreed, last.end_agreed), max(end, last.end), needed)
            else:
                found.append(Window(text, start, start_agreed, end_agreed, end, needed))
        return found


@functools.cache
def codec(path: str) -> Codec:
    """One for each worker process."""
    return Codec(path)


def _texts(batches: Iterator[pa.RecordBatch], size: int = 64) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


def _chunks(text: str | None) -> list[bytes]:
    data = (text or "").encode("utf-8", "replace")
    start, found = 0, []
    for end in chunk_ends(data):
        found.append(data[start:end])
        start = end
    return found


def _chunked(part: pa.RecordBatch) -> tuple[list[list[bytes]], np.ndarray]:
    """Chunks of each text of a batch, and the names of all."""
    chunks = [_chunks(text) for text in part.column("text").to_pylist()]
    return chunks, digests([c for of_text in chunks for c in of_text])


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of every chunk."""
    for part in _texts(batches):
        _, names = _chunked(part)
        yield pa.RecordBatch.from_arrays([pa.array(names[:, 0]), pa.array(names[:, 1])], ["high", "low"])


def _among(names: np.ndarray, words: bytes) -> np.ndarray:
    """Which names the Bloom filter holds."""
    raw, mask = np.frombuffer(words, np.uint8), np.int64(len(words) * 8 - 1)
    held = np.ones(len(names), bool)
    for place in (names[:, 1] & mask, (names[:, 1] >> np.int64(32)) & mask, names[:, 0] & mask):
        held &= (raw[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)
    return held


def _shared_texts(batches: Iterator[pa.RecordBatch], words) -> Iterator[pa.RecordBatch]:
    """Name and text of shared chunks, each about once a task."""
    seen: set[tuple[int, int]] = set()
    for part in _texts(batches):
        chunks, names = _chunked(part)
        flat, rows = [c for of_text in chunks for c in of_text], []
        for i in np.flatnonzero(_among(names, words.value)).tolist():
            name = (int(names[i, 0]), int(names[i, 1]))
            if name not in seen:
                seen.add(name)
                rows.append((*name, flat[i].decode()))
        if len(seen) > SEEN_CHUNKS:
            seen.clear()
        columns = list(zip(*rows)) or [[], [], []]
        kinds = (pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["high", "low", "text"])


def _coded_chunks(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    for part in _texts(batches, 1024):
        coded = codec(path).encode(part.column("text").to_pylist())
        yield pa.RecordBatch.from_arrays([part.column("high"), part.column("low"), pa.array(coded, pa.binary())], ["high", "low", "coded"])


def _uses(batches: Iterator[pa.RecordBatch], words) -> Iterator[pa.RecordBatch]:
    """Which shared chunks each document holds."""
    for part in _texts(batches):
        chunks, names = _chunked(part)
        held = np.flatnonzero(_among(names, words.value))
        row = np.repeat(np.arange(len(chunks)), [len(c) for c in chunks])[held]
        documents = [part.column(c).take(pa.array(row)) for c in ("doc", "doc_hash")]
        yield pa.RecordBatch.from_arrays(
            [*documents, pa.array(names[held, 0]), pa.array(names[held, 1])], ["doc", "doc_hash", "high", "low"]
        )


def _results(codes: list[bytes], coder: Codec, with_ids: bool, with_text: bool) -> list[pa.Array]:
    ids = [coder.ids(c) for c in codes]
    texts = [coder.decode(i) for i in ids]
    columns = [
        pa.array([len(i) for i in ids], pa.int64()),
        pa.array([hashlib.sha256(i.astype("<u4").tobytes()).hexdigest() for i in ids], pa.string()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string()),
    ]
    if with_ids:
        columns.append(pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32())))
    if with_text:
        columns.append(pa.array(texts, pa.string()))
    return columns


def _result_fields(with_ids: bool, with_text: bool) -> list[T.StructField]:
    kinds = {"n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()}
    kinds |= {"ids": T.ArrayType(T.IntegerType())} if with_ids else {}
    kinds |= {"decoded": T.StringType()} if with_text else {}
    return [T.StructField(name, kind) for name, kind in kinds.items()]


def _filled(values: pa.Array, rows: list[int], n: int) -> pa.Array:
    """``values`` at ``rows`` of n, nulls elsewhere."""
    index = np.full(n, -1)
    index[rows] = np.arange(len(rows))
    return values.take(pa.array(index, pa.int64(), mask=index < 0))


def _own_parts(batches: Iterator[pa.RecordBatch], path: str, words, with_ids: bool, with_text: bool):
    """Encodes what is not shared. A document without shared chunks is done; of others the ids of their own stretches go on,
    and their order: numbers of ids, and -1 for a shared chunk."""
    coder, packer = codec(path), zstandard.ZstdCompressor(level=1)
    for part in _texts(batches):
        plans, stretches = [], []  # a plan: places of stretches, names of shared chunks
        texts, names = _chunked(part)
        flags = iter(zip(_among(names, words.value).tolist(), names.tolist()))
        for chunks in texts:
            plan, open_run = [], []
            for chunk, (held, name) in zip(chunks, flags):
                if held:
                    if open_run:
                        plan.append(len(stretches))
                        stretches.append(b"".join(open_run).decode())
                        open_run = []
                    plan.append(tuple(name))
                else:
                    open_run.append(chunk)
            if open_run:
                plan.append(len(stretches))
                stretches.append(b"".join(open_run).decode())
            plans.append(plan)
        coded = coder.encode(stretches)
        done = [i for i, plan in enumerate(plans) if not any(isinstance(p, tuple) for p in plan)]
        finished = _results([coded[plans[i][0]] if plans[i] else b"" for i in done], coder, with_ids, with_text)
        n, todo = len(plans), set(range(len(plans))) - set(done)
        size = coder.kind.itemsize
        own, order, names = [None] * n, [None] * n, [None] * n
        for i in todo:
            plan = plans[i]
            own[i] = packer.compress(b"".join(coded[p] for p in plan if isinstance(p, int)))
            order[i] = [-1 if isinstance(p, tuple) else len(coded[p]) // size for p in plan]
            names[i] = [x for p in plan if isinstance(p, tuple) for x in p]
        yield pa.RecordBatch.from_arrays(
            [
                *(part.column(c) for c in ("doc_id", "doc", "doc_hash")),
                *(_filled(c, done, n) for c in finished),
                pa.array(own, pa.binary()), pa.array(order, pa.list_(pa.int32())), pa.array(names, pa.list_(pa.int64())),
            ],
            ["doc_id", "doc", "doc_hash", *(f.name for f in _result_fields(with_ids, with_text)), "own", "order", "names"],
        )


def _assembled(batches: Iterator[pa.RecordBatch], path: str, with_ids: bool, with_text: bool):
    """Joins documents' own stretches and shared chunks."""
    coder, opener = codec(path), zstandard.ZstdDecompressor()
    fields = [f.name for f in _result_fields(with_ids, with_text)]
    for part in _texts(batches, 256):
        rows, texts = [], []
        columns = (part.column(c).to_pylist() for c in ("own", "order", "names", "chunks"))
        for i, (own, order, names, chunks) in enumerate(zip(*columns)):
            if own is None:
                continue
            own, size, at = opener.decompress(own), coder.kind.itemsize, 0
            coded = {(c["high"], c["low"]): c["coded"] for c in chunks}
            wanted = iter(zip(names[::2], names[1::2]))
            pieces = []
            for n in order:
                if n < 0:
                    pieces.append(coded[next(wanted)])
                else:
                    pieces.append(own[at : at + n * size])
                    at += n * size
            rows.append(i)
            texts.append(pieces)
        late = _results(coder.joined(texts), coder, with_ids, with_text)
        index = np.arange(part.num_rows)
        index[rows] = part.num_rows + np.arange(len(rows))
        merged = [pa.concat_arrays([part.column(f), c]).take(pa.array(index)) for f, c in zip(fields, late)]
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), *merged], ["doc_id", *fields])


def _filter_of(shared: DataFrame) -> bytes:
    """The Bloom filter of the digests in ``shared``, put together by Spark; its size is bounded."""
    bits = 1 << max(16, min(FILTER_BITS.bit_length() - 1, (16 * shared.count()).bit_length()))
    mask = F.lit(bits - 1).cast("long")
    places = F.array(
        F.col("low").bitwiseAND(mask), F.shiftright("low", 32).bitwiseAND(mask), F.col("high").bitwiseAND(mask)
    )
    words = (
        shared.select(F.explode(places).alias("place"))
        .groupBy(F.shiftright("place", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("set"))
        .toArrow()
    )
    whole = np.zeros(bits // 64, "<i8")
    whole[words.column("word").to_numpy()] = words.column("set").to_numpy()
    return whole.tobytes()


def encode(documents: DataFrame, tokenizer_path: str, with_ids: bool = False, with_text: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row of ``documents`` (doc_id, text), as the tokenizers library
    encodes and decodes whole texts; with ``with_ids`` and ``with_text`` also the ``ids`` and the text ``decoded`` from them."""
    spark = documents.sparkSession
    scratch = Scratch(spark, "bpe")
    texts = documents.select("text")
    counted = texts.mapInArrow(_names, "high long, low long").groupBy("high", "low").agg(F.count(F.lit(1)).alias("n"))
    shared = scratch.keep(counted.where("n > 1").select("high", "low"), "shared")
    words = spark.sparkContext.broadcast(_filter_of(shared))
    once = (
        texts.mapInArrow(lambda batches: _shared_texts(batches, words), "high long, low long, text string")
        .groupBy("high", "low").agg(F.first("text").alias("text"))
    )
    coded = scratch.keep(
        once.mapInArrow(lambda batches: _coded_chunks(batches, tokenizer_path), "high long, low long, coded binary"), "coded"
    )
    scratch.drop("shared")
    keyed = documents.select("doc_id", *document_key(), "text")
    uses = keyed.select("doc", "doc_hash", "text").mapInArrow(
        lambda batches: _uses(batches, words), "doc long, doc_hash long, high long, low long"
    )
    chunks = (
        uses.distinct().join(coded, ["high", "low"])
        .groupBy("doc", "doc_hash").agg(F.collect_list(F.struct("high", "low", "coded")).alias("chunks"))
    )
    chunks = scratch.keep(chunks, "chunks")
    scratch.drop("coded")
    fields = _result_fields(with_ids, with_text)
    kind = T.StructField("doc_id", documents.schema["doc_id"].dataType)
    parts = T.StructType([
        kind, T.StructField("doc", T.LongType()), T.StructField("doc_hash", T.LongType()), *fields,
        T.StructField("own", T.BinaryType()), T.StructField("order", T.ArrayType(T.IntegerType())),
        T.StructField("names", T.ArrayType(T.LongType())),
    ])
    own = keyed.mapInArrow(lambda batches: _own_parts(batches, tokenizer_path, words, with_ids, with_text), parts)
    return own.join(chunks.hint("shuffle_hash"), ["doc", "doc_hash"], "left").drop("doc", "doc_hash").mapInArrow(
        lambda batches: _assembled(batches, tokenizer_path, with_ids, with_text), T.StructType([kind, *fields])
    )


def decode(rows: DataFrame, tokenizer_path: str) -> DataFrame:
    """``rows`` (doc_id, ids) as doc_id and ``decoded``; null ids give a null text."""
    kind = rows.schema["doc_id"]

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(tokenizer_path)
        for part in _texts(batches):
            found = [None if i is None else coder.decode(np.array(i, np.int64)) for i in part.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, pa.string())], ["doc_id", "decoded"])

    return rows.select("doc_id", "ids").mapInArrow(texts, T.StructType([kind, T.StructField("decoded", T.StringType())]))
