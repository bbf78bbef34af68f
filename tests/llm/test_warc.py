"""WARC archives: visits against a plain version, predicates, plans and files of other writers."""

import base64
import gzip
import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull, IsNull, Not, StringContains, StringStartsWith
from pyspark.sql.types import StructType

from granary.llm import warc
from granary.llm.common import Scratch
from granary.sources import commits

ALL = warc.SCHEMA


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    html = [f"<p>{'é' * r.randint(0, 40)} {i}</p>" for i in range(30)] + ["", "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n", "\r\n\r\n" * 50, "x" * 3_000_000]
    out = [(i, f"http://Host{i}.org/a b\r\nc?é", r.choice(html), 0) for i in range(200)]
    out += [(1000 + i, None, "copies", i) for i in range(50)] + [(300, "http://a", None, 1), (301, "", "", 2), (5, "http://again", html[3], 3), (302, "u", "same"), (302, "u", "same"), (None, "n", "nobody"), (None, "m", "nobody"), (303, "big", html[-1])]
    return [(*x, "clash")[:4] for x in out]


@pytest.fixture(scope="module")
def pages(spark, rows):
    return spark.createDataFrame([(*x[:3], str(x[3])) for x in rows], "page_id long, url string, html string, record_type string").repartition(5)


@pytest.mark.parametrize("least", [0, 5, 10_000_000])
def test_visits(spark, rows, pages, least, tmp_path):
    warc.archive(pages, f"{tmp_path}/a", least)
    got = sorted((tuple(r) for r in warc.visits(spark, f"{tmp_path}/a").collect()), key=str)
    top, want = {}, []
    for k, _, html, _ in rows:
        top[html or ""] = max(top.get(html or "", -1), -1 if k is None else k)
    first = set()
    for k, _, html, _ in rows:
        data = (html or "").encode()
        best = top[html or ""]
        response = len(data) < least or (k == (best if best >= 0 else None) and html not in first)
        if response and len(data) >= least:
            first.add(html if html else "")
        if not html and len(data) >= least:
            response = k == best
        want.append((k, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if response else "revisit", None if response or best < 0 else best))
    assert got == sorted(want, key=str)


def test_empty_table(spark, pages, tmp_path):
    warc.archive(pages.limit(0), f"{tmp_path}/a")
    assert warc.visits(spark, f"{tmp_path}/a").count() == 0


def read(path, filters=(), columns=None, split=1 << 26):
    schema = StructType([f for f in ALL.fields if columns is None or f.name in columns])
    reader = warc.Reader(str(path), schema, split)
    assert list(reader.pushFilters(list(filters))) == []
    return [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]


def test_predicates_come_before_payloads(spark, pages, tmp_path, monkeypatch):
    warc.archive(pages, f"{tmp_path}/a")
    every = read(f"{tmp_path}/a")
    calls = []
    block = warc.Record.block
    monkeypatch.setattr(warc.Record, "block", lambda self: calls.append(1) or block(self))
    cases = [
        ([EqualTo(("record_type",), "revisit")], lambda r: r["record_type"] == "revisit"),
        ([In(("record_type",), ("response", "warcinfo")), GreaterThan(("content_length",), 300)], lambda r: r["record_type"] in ("response", "warcinfo") and r["content_length"] > 300),
        ([Not(EqualTo(("target_uri",), "http://a"))], lambda r: r["target_uri"] is not None and r["target_uri"] != "http://a"),
        ([StringStartsWith(("target_uri",), "http://Host1"), StringContains(("target_uri",), "a%20b%0D%0Ac")], lambda r: (r["target_uri"] or "").startswith("http://Host1")),
        ([IsNull(("target_uri",)), Not(IsNull(("payload_digest",)))], lambda r: r["target_uri"] is None and r["payload_digest"] is not None),
        ([IsNotNull(("refers_to",))], lambda r: r["refers_to"] is not None),
    ]
    for filters, test in cases:
        calls.clear()
        want = [r for r in every if test(r)]
        assert want and read(f"{tmp_path}/a", filters) == want
        assert len(calls) == len(want)
        assert [r["offset"] for r in read(f"{tmp_path}/a", filters, ["offset"])] == [r["offset"] for r in want]
        assert len(calls) == len(want)  # no column needs a payload
    assert list(warc.Reader("", ALL, 1).pushFilters([f := EqualTo(("payload_bytes",), 3)])) == [f]


def test_filters_reach_the_scan(spark, pages, tmp_path):
    warc.archive(pages, f"{tmp_path}/a")
    df = spark.read.format(warc.FORMAT).load(f"{tmp_path}/a").where("record_type = 'revisit' and target_uri is null and payload_bytes > 3")
    every = [r for r in read(f"{tmp_path}/a") if r["record_type"] == "revisit" and r["target_uri"] is None and r["payload_bytes"] > 3]
    assert df.count() == len(every) > 0
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "record_type" not in plan.split("Filter", 1)[-1].split("BatchScan")[0]


def test_partitions_cut_at_records_and_share_small_files(spark, pages, tmp_path):
    warc.register(spark)
    made = warc.records(pages, Scratch(spark))
    made.write.format(warc.FORMAT).mode("overwrite").option("file_bytes", 20_000).option("note_bytes", 500).save(f"{tmp_path}/a")
    made.write.format(warc.FORMAT).mode("append").option("note_bytes", 500).save(f"{tmp_path}/a")
    names = [f for f in os.listdir(f"{tmp_path}/a") if f.startswith("part-")]
    assert len(names) == len(commits.manifest(f"{tmp_path}/a")[1]) > 6
    whole = read(f"{tmp_path}/a")
    key = lambda r: (r["file"], r["offset"])
    for split in (1, 700, 5000, 1 << 30):
        assert sorted(read(f"{tmp_path}/a", split=split), key=key) == sorted(whole, key=key)
    parts = lambda n: len(warc.Reader(f"{tmp_path}/a", ALL, n).partitions())
    assert parts(1 << 30) == 1 < parts(5000) < parts(500)
    assert sum(r["record_type"] != "warcinfo" for r in whole) == 2 * pages.count()


def test_files_of_other_writers(tmp_path):
    records = [warc.record([("WARC-Type", kind), ("Content-Type", "text/plain"), ("WARC-Payload-Digest", "sha1:ABC")], body) for kind, body in (("resource", b"one"), ("metadata", b""), ("resource", b"\r\n\r\nWARC/1.0\r\n\r\n" * 9000))]
    os.mkdir(tmp_path / "d")
    (tmp_path / "d/a.warc").write_bytes(b"".join(records))
    (tmp_path / "d/b.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records))
    (tmp_path / "d/c.txt").write_text("no archive")
    folded = b"WARC/1.0\r\nwarc-type: resource\r\nX-Long: a\r\n  b\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n\r\n\r\n"
    (tmp_path / "d/e.warc").write_bytes(folded * 2)
    got = read(tmp_path / "d")
    assert [(r["file"][0], r["record_type"], r["payload"][:3]) for r in got] == [(f, k, b) for f in "ab" for k, b in (("resource", b"one"), ("metadata", b""), ("resource", b"\r\n\r"))] + [("e", "resource", b"hi")] * 2
    assert {r["payload_digest"] for r in got} == {"ABC", None}
    assert dict(got[-1]["headers"])["X-Long"] == "a b"
    assert [r["record_type"] for r in read(tmp_path / "d/a.warc", [EqualTo(("record_type",), "metadata")])] == ["metadata"]
    (tmp_path / "d/a.warc").write_bytes(b"".join(records)[:-20000])
    with pytest.raises(ValueError, match="cut off"):
        read(tmp_path / "d")


def test_a_changed_payload_is_an_error_and_failed_writes_leave_nothing(spark, pages, tmp_path):
    row = {"record_type": "response", "record_id": "<a>", "target_uri": "u", "date": warc.EPOCH, "media_type": None, "payload_digest": "WRONG", "payload_bytes": 1, "refers_to": None, "headers": [], "payload": b"x"}
    os.mkdir(tmp_path / "d")
    (tmp_path / "d/x.warc.gz").write_bytes(warc.member(warc.Writer.bytes_of(row)))
    with pytest.raises(Exception, match="differs from its digest"):
        warc.visits(spark, f"{tmp_path}/d").collect()
    warc.archive(pages.limit(9), f"{tmp_path}/a")
    before = sorted(os.listdir(f"{tmp_path}/a"))
    bad = warc.records(pages, Scratch(spark)).withColumn("payload", F.when(F.octet_length("payload") > 2_000_000, F.raise_error(F.lit("no more")).cast("binary")).otherwise(F.col("payload")))
    for mode in ("overwrite", "append"):
        with pytest.raises(Exception, match="no more"):
            bad.write.format(warc.FORMAT).mode(mode).save(f"{tmp_path}/a")
        assert sorted(os.listdir(f"{tmp_path}/a")) == before and not os.listdir(f"{tmp_path}/a/_jobs")
    assert warc.visits(spark, f"{tmp_path}/a").count() == 9
