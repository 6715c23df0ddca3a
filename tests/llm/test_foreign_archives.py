"""Archives of other writers, ids below zero, and the two ways that revisits reach the writer."""

import hashlib

import pytest
from pyspark.sql import functions as F

from stradale.llm import warc


def foreign(k, kind="response", version="1.0", extra=(), body=b"body", content="application/http; msgtype=response"):
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + body if content.startswith("application/http") else body
    head = [f"WARC/{version}", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{k}>", "WARC-Date: 2020-01-01T00:00:00Z", *extra, f"Content-Type: {content}", f"content-length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def read(spark, folder, data, split):
    (folder / "a.warc").write_bytes(data)
    archives = spark.createDataFrame([(str(folder / "a.warc"), len(data))], "path string, bytes long")
    return {r.offset: r for r in warc.read_warc(archives, f"file://{folder}", split).collect()}


@pytest.mark.parametrize("split", [2500, 1 << 20])
def test_records_of_other_writers(spark, tmp_path, split):
    twice = ("WARC-Concurrent-To: <urn:uuid:a>", "WARC-Concurrent-To: <urn:uuid:b>", "X-Long: one", "\ttwo", " three")
    parts = [foreign("info", "warcinfo", content="application/warc-fields", body=b"software: x\r\n"), foreign(1, extra=twice), foreign(2, "metadata", "1.1", content="text/plain", body=b"a: b"), foreign(3, extra=("WARC-Payload-Digest: md5:aa",))]
    parts += [foreign(10 + k, body=(b"x%d " % k) * 40 + foreign(99) * (k % 3 == 0)) for k in range(30)]
    sha = hashlib.sha1(b"body").hexdigest()
    parts += [foreign(50, extra=(f"WARC-Payload-Digest: sha1:{sha.upper()}",)), foreign(51, "revisit", body=b""), foreign(52, "request", content="application/http; msgtype=request", body=b"")]
    got = read(spark, tmp_path, b"".join(parts), split)
    starts = [sum(map(len, parts[:k])) for k in range(len(parts))]
    assert sorted(got) == starts and all(r.page_id is None and r.refers_to is None for r in got.values())
    rows = [got[s] for s in starts]
    assert [r.record_id for r in rows[1:4]] == ["<urn:uuid:1>", "<urn:uuid:2>", "<urn:uuid:3>"]
    assert rows[0].record_type == "warcinfo" and bytes(rows[2].payload) == b"a: b" and rows[3].digest == sha == rows[-3].digest
    assert rows[-2].payload is None and rows[-2].digest is None and rows[-2].length is None
    assert all(r.digest == hashlib.sha1(bytes(r.payload)).hexdigest() and r.length == len(r.payload) for r in rows[:-2])


def test_no_archive_and_no_record(spark, tmp_path):
    assert read(spark, tmp_path, b"something else\r\n\r\n" * 100, 500) == {}
    assert read(spark, tmp_path, b"WARC/1.0\r\nno colon\r\n\r\n", 500) == {}


def test_a_large_archive_of_version_1_0(spark, tmp_path):
    """40 MB over several splits: every record comes back."""
    parts = [foreign(k, body=b"%07d " % k * 5000) for k in range(1000)]
    (tmp_path / "a.warc").write_bytes(data := b"".join(parts))
    assert len(data) > 40_000_000
    archives = spark.createDataFrame([(str(tmp_path / "a.warc"), len(data))], "path string, bytes long")
    got = warc.read_warc(archives, f"file://{tmp_path}").agg(F.count("*").alias("n"), F.count_distinct("record_id").alias("k"), F.sum("length").alias("x")).first()
    assert tuple(got) == (1000, 1000, 40_000_000)


@pytest.mark.parametrize("most", [0, 1000])
def test_ids_below_zero_and_both_ways_of_revisits(spark, monkeypatch, most):
    monkeypatch.setattr(warc, "MAX_BROADCAST", most)
    rows = [(-5, "u", "x" * 1000), (-9, "u", "x" * 1000), (7, None, "é" * 499), (8, "v", "é" * 500), (-1, "v", "é" * 500), (0, "", "")]
    got = {r.page_id: (r.record_type, r.refers_to, r.length) for r in warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {-5: ("response", None, 1000), -9: ("revisit", -5, 1000), 7: ("response", None, 998), 8: ("response", None, 1000), -1: ("revisit", 8, 1000), 0: ("response", None, 0)}
