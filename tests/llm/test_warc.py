"""WARC archives: rows in chunks, files that other readers can open, and their way back."""

import gzip
import hashlib
import io
import random

import brute
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lumenspark.llm import queries, warc

SF = "/root/testdata/sf0.01"
PAGES = [(1, "http://a/é ü", "same"), (2, "http://b/\r\nX: y", "same"), (None, None, "same"), (3, "u", None), (4, "u", ""), (5, "u", "é" * 5000), (6, "u", "<p>\r\n\r\nWARC/1.1\r\n</p>"), (7, "u", "tie"), (7, "u", "tie"), (8, "u", "x" * 100_000), (9, "u", "x" * 100_000), (-3, "u", "tie2"), (10, "u", "tie2")]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(p, u, h, "c", 1, b"z") for p, u, h in PAGES], "page_id long, url string, html string, kind string, record int, data binary").repartition(3)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def plain(folder):
    """All records of the archives by another reading: gzip whole, then by lengths."""
    out = []
    for path in sorted(folder.glob("*.warc.gz")):
        data = io.BytesIO(gzip.decompress(path.read_bytes()))
        while line := data.readline():
            assert line == b"WARC/1.1\r\n"
            head = {}
            while (line := data.readline()) != b"\r\n":
                name, _, value = line.decode().rstrip("\r\n").partition(": ")
                head[name] = value
            out.append((head, data.read(int(head["Content-Length"]))))
            assert data.read(4) == b"\r\n\r\n"
    return out


@pytest.mark.parametrize(("chunk", "least"), [(1 << 20, 0), (7, 0), (4096, 5)])
def test_round_trip(spark, pages, tmp_path, chunk, least, monkeypatch):
    path = f"file://{tmp_path}/out"
    warc.write(pages, path, least, chunk)
    assert rows(warc.archived(pages, least)) == sorted(brute.archive_rows([(p, h) for p, _, h in PAGES], least), key=repr)
    found = [x for x in plain(tmp_path / "out") if x[0]["WARC-Type"] != "warcinfo"]
    assert len(found) == len(PAGES) and not list((tmp_path / "out").glob("_*"))
    stored = {h["WARC-Record-ID"]: body.partition(b"\r\n\r\n")[2] for h, body in found}
    held = {r.record_id: r for r in warc.read(spark, path).collect()}
    assert set(held) == set(stored) and all(r.intact for r in held.values())
    assert sorted(stored[i].decode() for i, r in held.items() if r.kind == "response") == sorted({h or "" for _, _, h in PAGES} if not least else [*{h for _, _, h in PAGES if len((h or "").encode()) >= least}, *(h or "" for _, _, h in PAGES if len((h or "").encode()) < least)])
    for i, r in held.items():
        whole = stored[r.refers_to if r.kind == "revisit" else i]
        assert (r.payload_bytes, r.payload_digest) == (len(whole), warc.base32(hashlib.sha1(whole).digest()))
    parts = warc.chunks(spark, path, 11).groupBy("record_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", F.col("data").cast("string").alias("data")))), lambda x: x["data"]), "").alias("text"), F.max(F.length("data")).alias("most")).filter("NOT record_id LIKE '<urn:uuid%'")
    texts = {r.record_id: r for r in parts.collect()}
    assert {i: t.decode() for i, t in stored.items() if t and len(t) < 9000 and "é" not in t.decode()} == {i: r.text for i, r in texts.items() if len(r.text) < 9000 and "é" not in stored[i].decode()}
    assert max(r.most for r in texts.values()) <= 11


def test_archives_are_closed_by_size(spark, tmp_path):
    r = random.Random(3)
    docs = spark.createDataFrame([(i, "u", "".join(map(chr, r.choices(range(32, 500), k=3000)))) for i in range(60)], "page_id long, url string, html string").coalesce(1)
    warc.write(docs, str(tmp_path / "many"), archive=20_000)
    assert len(list((tmp_path / "many").glob("*.warc.gz"))) > 10 and len(plain(tmp_path / "many")) > 70
    assert warc.read(spark, str(tmp_path / "many")).count() == 60


def test_foreign_archives(spark, tmp_path):
    body = b"HTTP/1.0 200 OK\r\nX: 1\r\n\r\npayload"
    record = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x:1>\r\nWARC-Target-URI: http://a\r\n b\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n"
    other = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:x:2>\r\nWARC-Payload-Digest: sha1:WRONG\r\nContent-Type: text/plain\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    (tmp_path / "plain.warc").write_bytes(record + other)
    (tmp_path / "one.warc.gz").write_bytes(gzip.compress(record + other))
    (tmp_path / "each.warc.gz").write_bytes(gzip.compress(record) + gzip.compress(other))
    found = warc.read(spark, str(tmp_path)).collect()
    assert len(found) == 6
    for r in found:
        assert (r.kind, r.payload_bytes, r.intact) == (("response", 7, True) if r.record_id == "<urn:x:1>" else ("resource", 3, False))
    (tmp_path / "cut.warc.gz").write_bytes(gzip.compress(record)[:-20])
    with pytest.raises(Exception, match="ends within"):
        warc.read(spark, str(tmp_path / "cut.warc.gz")).collect()


def test_empty_and_hot(spark, pages, tmp_path):
    assert warc.archived(pages.filter("false")).count() == 0
    hot = spark.range(3000).select((3000 - F.col("id")).alias("page_id"), F.lit("u").alias("url"), F.lit("copy").alias("html"))
    found = warc.archived(hot)
    assert found.filter("record_type = 'response'").collect()[0].page_id == 1 and found.filter("refers_to = 1").count() == 2999


def test_an_attempt_that_fails_leaves_nothing(spark, pages, tmp_path):
    bad = warc.laid_out(warc.chunked(pages), warc.decided(warc.chunked(pages)).withColumn("n", F.col("n") + 1))
    warc.registered(spark)
    with pytest.raises(Exception, match="fewer bytes"):
        bad.write.format("warc").mode("append").save(f"{tmp_path}/bad")
    assert not list(tmp_path.glob("bad/*"))


def test_query(spark):
    pages = pq.read_table(f"{SF}/pages.parquet", columns=["page_id", "html"]).to_pylist()
    assert rows(queries.op12_warc(spark, SF)) == sorted(brute.archive_rows([(p["page_id"], p["html"]) for p in pages]), key=repr)
