import base64
import glob
import gzip
import hashlib
import io
from collections import Counter

from tariffscope.llm import warc

PAGES = [
    (1, "http://a/\r\nX: 1", "same"), (2, None, "same"), (None, "http://b", "same"), (None, None, "none"), (7, "u", None),
    (8, "u", ""), (9, "u", "é" * 9_000_000), (9, "u", "twice"), (9, "u", "twice"), (10, "u", "plain \x1f text " * 1000),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string")


def test_round_trip_in_ranges_of_any_size(spark, tmp_path):
    folder = str(tmp_path / "archives")
    warc.write(frame(spark, PAGES).coalesce(2), folder)
    want = Counter()
    for page_id, _, html in PAGES:
        held = [i for i, _, h in PAGES if (h or "") == (html or "") and i is not None]
        kept_by = max(held, default=None)
        payload = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        revisit = kept_by is not None and kept_by != page_id
        want[page_id, len(payload), digest, "revisit" if revisit else "response", kept_by if revisit else None] += 1
    for range_bytes in (97, 5000, 1 << 20):
        rows = warc.read(spark, folder, range_bytes).collect()
        got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows)
        assert got == want
        assert {bytes(r.payload).decode() for r in rows if r.record_type == "response"} == {h or "" for _, _, h in PAGES}
    # The files are plain gzip archives.
    whole = b"".join(gzip.open(f).read() for f in glob.glob(folder + "/part*"))
    assert whole.count(b"WARC/1.1\r\n") == len(PAGES)


def test_records_belong_to_the_range_they_start_in():
    members = [warc._member(k, None, b"x" * 300 * k, None) + b"\0" for k in range(1, 20)]
    data = b"".join(members)
    every = [(at, f["warc-record-id"]) for at, f, _ in warc.records_in(io.BytesIO(data), 0, len(data))]
    assert len(every) == 19
    for size in (1, 50, 333):
        found = []
        for start in range(0, len(data), size):
            found += [(at, f["warc-record-id"]) for at, f, _ in warc.records_in(io.BytesIO(data), start, min(start + size, len(data)))]
        assert found == every


def test_magic_bytes_that_are_no_record_are_passed_over():
    noise = warc.MAGIC + b"\x00" * 20 + gzip.compress(b"not a record") + b"\x1f\x8b"
    data = noise + warc._member(5, None, b"yes", None) + b"\0" + noise
    assert [b for _, _, b in warc.records_in(io.BytesIO(data), 0, len(data))] [0].endswith(b"yes")


def test_empty_table(spark):
    assert warc.round_trip(frame(spark, []).select("page_id", "url", "html")).count() == 0
