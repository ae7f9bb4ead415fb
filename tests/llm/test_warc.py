import hashlib
import io
import zipfile

import pyarrow as pa
import pytest

from dayloom.llm import warc
from dayloom.llm.common import fresh_path


def brute(rows):
    least = {}
    for p, _, h in rows:
        d = (h or "").encode()
        if len(d) >= 1000 and p is not None:
            least[d] = max(least.get(d, p), p)
    out = []
    for p, _, h in rows:
        d = (h or "").encode()
        lead = least.get(d) if sum((x[2] or "").encode() == d for x in rows) > 1 else None
        to = lead if lead is not None and lead != p else None
        out.append((p, len(d), hashlib.sha1(d).hexdigest(), "response" if to is None else "revisit", to))
    return sorted(out, key=str)


def run(spark, rows, with_payload=False):
    folder = fresh_path(spark, "t")
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    return warc.read_packages(warc.write_packages(df, folder), folder, with_payload)


def test_round_trip(spark):
    long_ = "é" * 600
    rows = [(i, f"http://h/{i}", long_) for i in range(20)] + [(30, None, None), (31, "a\nb c", ""), (32, "u", "x" * 999), (33, "u", "x" * 999), (34, "u", "x" * 1000), (35, "u", "x" * 1000), (35, "u", "x" * 1000), (36, "u", "y" * 300_000), (None, "u", long_), (None, "u", "z" * 2000), (34, "u", "other" * 300)]
    out = run(spark, rows, True).collect()
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out], key=str) == brute(rows)
    assert all(hashlib.sha1(r.payload).hexdigest() == r.payload_digest for r in out if r.record_type == "response")
    assert run(spark, rows[:1], False).where("url = 'http://h/0'").count() == 1


def test_empty(spark):
    folder = fresh_path(spark, "t")
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_packages(warc.write_packages(df, folder), folder).collect() == []


def reader(raw):
    class Source:
        size = staticmethod(lambda: len(raw))
        read_at = staticmethod(lambda n, at: raw[at : at + n])

    return Source


@pytest.mark.parametrize("limit", [None, 10])
def test_directory(monkeypatch, limit):
    if limit:  # makes the library write ZIP64 records for small files
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", limit)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.comment = b"PK\5\6 inside a comment"
        z.writestr("archive/a.warc.gz", b"a" * 100, zipfile.ZIP_STORED)
        z.writestr("x.txt", b"b" * 500, zipfile.ZIP_DEFLATED)
        z.writestr("é.warc", b"c" * 30, zipfile.ZIP_STORED)
    raw = out.getvalue()
    assert (warc.END64 in raw) == bool(limit)
    members = warc.read_directory(reader(raw))
    assert [m.name for m in members] == ["archive/a.warc.gz", "x.txt", "é.warc"] and [m.method for m in members] == [0, 8, 0]
    assert raw[members[0].offset :][: members[0].size] == b"a" * 100 and raw[members[2].offset :][:30] == b"c" * 30
    with pytest.raises(ValueError):
        warc.read_directory(reader(b"no zip"))


def test_walk_without_index():
    records = [warc.make_record(i, "u", b"p" * (i * 700_000), hashlib.sha1(b"p" * (i * 700_000)).hexdigest(), None) for i in range(4)]
    raw = b"".join(records)
    places = list(warc.walk_member(reader(raw), warc.Member("a.warc.gz", 0, 0, len(raw))))
    assert [raw[a : a + n] for a, n in places] == records
    assert pa is not None


def test_other_columns_and_a_long_page(spark, tmp_path):
    """Columns of the result's names in the input are not archived; a page of 3 MB comes back whole."""
    long = "<p>é</p>" * 350_000
    rows = [(1, "http://a", long, "x", 5), (2, "http://b", long, "x", 6), (3, "http://c", "short", "x", 7), (4, "http://d", "short", None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload_digest string, refers_to long")
    out = {r.page_id: r for r in warc.read_packages(warc.write_packages(pages, f"file://{tmp_path}/p"), f"file://{tmp_path}/p").collect()}
    assert out[1].payload_bytes == out[2].payload_bytes == len(long.encode()) and out[1].payload_digest == hashlib.sha1(long.encode()).hexdigest()
    assert (out[1].record_type, out[1].refers_to, out[2].record_type, out[2].refers_to) == ("revisit", 2, "response", None)
    assert {out[i].record_type for i in (3, 4)} == {"response"}
