"""Archives: round trips, pushed conditions, payloads that are not decoded, files of others."""

import gzip
import io
import os

import pytest
from pyspark.sql import functions as F
from warnings import catch_warnings

from braidwork.llm import warc

PAGES = "page_id long, url string, html string"
ROWS = [
    (1, "http://a.org/x", "<p>hi</p>"), (2, "http://b.org/", "<p>hi</p>"), (3, "http://b.org/é?q=1", "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n"), (4, None, None), (5, "u", ""),
    (6, "http://c.org/a b\r\nWARC-Type: revisit", "Ünï 中文 \u0000" * 5), (7, "http://a.org/x", "<p>hi</p>"), (7, "http://a.org/x", "<p>hi</p>"), (None, "http://n.org", "<p>hi</p>"), (None, "http://n.org", "only"),
    (8, "http://big.org", "long text " * 300_000),
]


@pytest.fixture
def pages(spark):
    return spark.createDataFrame(ROWS, PAGES).repartition(3)


def expected(least=0):
    latest = {}
    for i, _, h in ROWS:
        if i is not None:
            latest[h or ""] = max(i, latest.get(h or "", i))
    out = []
    for i, _, h in ROWS:
        p = (h or "").encode()
        top = latest.get(h or "") if len(p) >= least else i
        out.append((i, len(p), warc.digest32(p), *(("response", None) if i == top else ("revisit", top))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [0, 1, 10])
def test_round_trip(spark, pages, tmp_path, least):
    warc.write_pages(pages, str(tmp_path / "a é%20b"), least=least)
    got = warc.read_pages(spark, str(tmp_path / "a é%20b")).collect()
    assert sorted(map(tuple, got), key=repr) == expected(least)


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_whole_records(spark, pages, tmp_path, compression):
    named = warc.revisits(pages).select(F.coalesce(warc.urn(F.col("page_id")), F.lit("<urn:page:null>")).alias("record_id"), "url", F.lit("2024-01-02T03:04:05Z").alias("date"), F.lit(None).cast("string").alias("refers_to"), F.lit("text/plain").alias("content_type"), F.col("html").cast("binary").alias("payload"))
    warc.register(spark)
    named.write.format("warc").option("compression", compression).option("roll", 200).mode("append").save(str(tmp_path / "w"))
    files = os.listdir(tmp_path / "w")
    assert len(files) > 3 and all(f.endswith(".warc.gz" if compression == "gzip" else ".warc") for f in files)
    got = warc.read_warc(spark, str(tmp_path / "w")).collect()
    assert sorted((bytes(r.payload).decode() for r in got)) == sorted(h or "" for _, _, h in ROWS)
    for r in got:
        assert r.record_type == "response" and r.payload_digest == r.computed_digest and r.date == "2024-01-02T03:04:05Z" and "text/plain" in r.http_headers
        assert r.payload_length == len(r.payload) and r.headers["warc-type"] == "response"
    urls = {r.target_uri for r in got}
    assert "http://b.org/é?q=1" in urls and "http://c.org/a b%0D%0AWARC-Type: revisit" in urls and None in urls
    if compression == "gzip":  # any reader of gzip reads them
        whole = b"".join(gzip.open(tmp_path / "w" / f).read() for f in files)
        assert whole.count(b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID") == len(ROWS)


def filters(df):
    return " Filter " in df._jdf.queryExecution().executedPlan().toString()


def test_conditions_reach_the_reader(spark, pages, tmp_path):
    warc.write_pages(pages, str(tmp_path / "a"))
    ids = lambda df: sorted(r.record_id for r in df.collect())
    columns = "record_id string, record_type string, target_uri string, payload_length long, refers_to string"
    all_ = warc.read_warc(spark, str(tmp_path / "a"), columns)
    rows = all_.collect()
    for sql, test in {
        "record_type = 'revisit'": lambda r: r.record_type == "revisit",
        "record_type IN ('revisit', 'warcinfo')": lambda r: r.record_type == "revisit",
        "target_uri LIKE 'http://b%'": lambda r: (r.target_uri or "").startswith("http://b"),
        "target_uri LIKE '%org/'": lambda r: (r.target_uri or "").endswith("org/"),
        "target_uri LIKE '%.org%'": lambda r: ".org" in (r.target_uri or ""),
        "target_uri IS NULL": lambda r: r.target_uri is None,
        "payload_length > 8 AND payload_length <= 9": lambda r: 8 < r.payload_length <= 9,
        "payload_length < 5 OR payload_length >= 1000": lambda r: r.payload_length < 5 or r.payload_length >= 1000,
        "refers_to <=> NULL": lambda r: r.refers_to is None,
        "refers_to = '<urn:page:7>' AND upper(record_type) = 'REVISIT'": lambda r: r.refers_to == "<urn:page:7>",
    }.items():
        want = sorted(r.record_id for r in rows if test(r))
        assert ids(all_.where(sql)) == want, sql  # one relation, one query after the other
        assert ids(warc.read_warc(spark, str(tmp_path / "a"), columns, sql)) == want, sql
        assert all_.count() == len(rows)
    assert not filters(warc.read_warc(spark, str(tmp_path / "a"), columns, "record_type = 'revisit' AND target_uri LIKE 'http://b%'"))
    assert filters(warc.read_warc(spark, str(tmp_path / "a"), columns, "upper(record_type) = 'REVISIT'"))


class Counted(io.BytesIO):
    taken = 0

    def read(self, n=-1):
        got = super().read(n)
        Counted.taken += len(got)
        return got


def archive(compressed, n=50, size=200_000):
    rows = [{"record_id": f"<urn:page:{i}>", "url": None, "date": None, "content_type": None, "refers_to": None if i % 10 else "<urn:page:1>", "payload": os.urandom(size)} for i in range(n)]
    return b"".join(warc.member(warc.record_bytes(r)) if compressed else warc.record_bytes(r) for r in rows)


@pytest.mark.parametrize("compressed", [True, False])
def test_unwanted_payloads_are_passed_over(monkeypatch, compressed):
    monkeypatch.setattr(warc, "CHUNK", 4096)
    inflated = []
    more = warc.Member.more
    monkeypatch.setattr(warc.Member, "more", lambda self: inflated.append(1) or more(self))
    whole = archive(compressed)
    for conditions, content, least, most in (([("eq", "record_type", "revisit")], False, 0, 0.1), ([("eq", "record_id", "<urn:page:7>")], True, 0.02, 0.15), ([], True, 0.9, 1.1)):
        Counted.taken, inflated[:] = 0, []
        rows = list(warc.records(warc.Plain(Counted(whole)), compressed, conditions, content))
        assert least <= Counted.taken / len(whole) <= most
        assert len(rows) == {0.1: 5, 0.15: 1, 1.1: 50}[most]
        assert all(("payload" in r) == content for r in rows)


def test_members_without_length_and_other_types():
    block = b"software: x\r\n"
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Type: application/\r\n warc-fields\r\nwarc-record-id: <a>\r\nContent-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"
    other = warc.record_bytes({"record_id": "<b>", "url": "u", "date": None, "content_type": None, "refers_to": None, "payload": b"p" * 100_000})
    for whole, packed in ((gzip.compress(info) + gzip.compress(other) + gzip.compress(info), True), (info + other + info, False)):
        rows = list(warc.records(warc.Plain(io.BytesIO(whole)), packed, [], True))
        assert [r["record_id"] for r in rows] == ["<a>", "<b>", "<a>"] and rows[0]["payload"] == block and rows[0]["content_type"] == "application/ warc-fields" and len(rows[1]["payload"]) == 100_000
        assert [r["record_id"] for r in warc.records(warc.Plain(io.BytesIO(whole)), packed, [("eq", "record_type", "warcinfo")], False)] == ["<a>", "<a>"]
    for broken in (info[:-30], b"HTTP/1.1 200\r\n\r\n", gzip.compress(other)[:-40]):
        with pytest.raises(ValueError):
            list(warc.records(warc.Plain(io.BytesIO(broken)), broken[:2] == b"\x1f\x8b", [], True))


def test_edges(spark, tmp_path):
    none = spark.createDataFrame([], PAGES)
    warc.write_pages(none, str(tmp_path / "none"))
    assert warc.read_pages(spark, str(tmp_path / "none")).count() == 0
    some = spark.createDataFrame([(1, "u", "h")], PAGES).withColumn("_sha", F.lit(1)).withColumn("payload", F.lit("x")).withColumn("original", F.lit(3))
    warc.write_pages(some, str(tmp_path / "some"))
    assert [tuple(r) for r in warc.read_pages(spark, str(tmp_path / "some")).collect()] == [(1, 1, warc.digest32(b"h"), "response", None)]


def test_failed_jobs_leave_no_files(spark, pages, tmp_path):
    warc.register(spark)
    bad = pages.select(F.col("page_id").cast("string").alias("record_id"), "url", F.lit(None).cast("string").alias("date"), F.lit(None).cast("string").alias("refers_to"), F.lit(None).cast("string").alias("content_type"), F.expr("CASE WHEN page_id = 6 THEN CAST(raise_error('no') AS STRING) ELSE html END").cast("binary").alias("payload"))
    with catch_warnings(), pytest.raises(Exception, match="no"):
        bad.write.format("warc").mode("append").save(str(tmp_path / "bad"))
    assert not [f for _, _, names in os.walk(tmp_path / "bad") for f in names]


def test_overwrite(spark, pages, tmp_path):
    warc.register(spark)
    frame = lambda p: p.select(F.lit("<r>").alias("record_id"), "url", F.lit(None).cast("string").alias("date"), F.lit(None).cast("string").alias("refers_to"), F.lit(None).cast("string").alias("content_type"), F.col("html").cast("binary").alias("payload"))
    for mode, n in (("append", 11), ("append", 22), ("overwrite", 11)):
        frame(pages).write.format("warc").mode(mode).save(str(tmp_path / "o"))
        assert warc.read_warc(spark, str(tmp_path / "o"), "record_id string").count() == n
