"""Stateful operators on streams, with restarts, against their batch forms."""

import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from granary.operators import ledger
from granary.presets import LATIN
from granary.sources import commits
from granary.streaming import collect, dataset, stateful

START = datetime(2024, 1, 1, tzinfo=UTC)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    return [(i, f"k{r.randint(0, 40) if i % 3 else 0}", r.random() < 0.3 if i % 17 else None, i % 60, START + timedelta(minutes=i)) for i in range(600)]


SCHEMA = "pos long, key string, ok boolean, tokens long, at timestamp"


def arrive(spark, rows, folder, parts):
    """Rows in files, in their order of arrival."""
    for i, (a, b) in enumerate(parts):
        spark.createDataFrame(rows[a:b], SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/{i:03d}-{a}")


def run_twice(spark, rows, tmp_path, operator):
    """The output of an operator that is stopped after some files, and starts again from its checkpoint for the others."""
    for parts in ([(0, 150), (150, 290)], [(290, 300), (300, 600)]):
        arrive(spark, rows, f"{tmp_path}/in", parts)
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        stateful.drained(operator(stream), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    return spark.read.parquet(f"{tmp_path}/out")


def same(a, b):
    return sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.select(*a.columns).collect()), key=str)


def test_retries_go_on_after_a_restart(spark, rows, tmp_path):
    got = stateful.final(run_twice(spark, rows, tmp_path, stateful.retries))
    assert same(got, ledger.retry_plan(spark.createDataFrame(rows, SCHEMA).withColumn("ok", F.coalesce("ok", F.lit(False)))))
    assert {r.state for r in got.collect()} >= {"done", "given_up"}


def test_caps_and_shards_go_on_after_a_restart(spark, rows, tmp_path):
    whole = spark.createDataFrame(rows, SCHEMA)
    got = run_twice(spark, rows, tmp_path / "a", lambda s: stateful.capped(s, "key", "pos", 9))
    assert same(ledger.first_n(whole, "key", "pos", 9), got)
    got = run_twice(spark, rows, tmp_path / "b", lambda s: stateful.sharded(s.select("key", "pos", "tokens", "at"), "key", "pos", "tokens", 200))
    want = ledger.shards(whole, "key", "pos", "tokens", 200)
    assert same(want, got.select("key", "pos", "tokens", "shard"))


def test_state_of_a_run_expires(spark, tmp_path):
    hour = 3_600_000
    rows = [(i, "a", False, 1, START + timedelta(hours=h)) for i, h in enumerate([0, 0, 0, 5, 6, 6, 6.5])] + [(99, "b", True, 1, START + timedelta(hours=h)) for h in (0, 6)]
    for i, part in enumerate(([0, 1, 2, 7], [3], [4, 8], [5, 6])):  # the watermark moves after each file
        spark.createDataFrame([rows[k] for k in part], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{i}")
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        stateful.drained(stateful.retries(stream, keep_ms=2 * hour), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    got = sorted((r.key, r.tries, r.state) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [("a", 1, "retry"), ("a", 2, "given_up"), ("a", 2, "given_up"), ("b", 1, "done"), ("b", 1, "done")]
    held = spark.read.format("statestore").option("path", f"{tmp_path}/checkpoint").option("stateVarName", "run").load()
    assert held.count() <= 2


def export(folder, parts):
    """A dataset of parts: lists of files, each of texts, in row groups of 7."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    for part, files in parts.items():
        (folder / part).mkdir(parents=True, exist_ok=True)
        for name, texts in files.items():
            pq.write_table(pa.table({"id": list(range(len(texts))), "text": texts}), folder / part / f"{name}.parquet", row_group_size=7)


def test_dataset_comes_once_through_stops_and_crashes(spark, tmp_path):
    name = lambda p, k, n: [f" {p}{k}-{i} \n" if i % 5 else (" " if i % 2 else None) for i in range(n)]
    parts = {"verified": {"a": name("v", 0, 30), "b": name("v", 1, 9)}, "unverified": {"a": name("u", 0, 17), "c": []}, "synthetic": {"a": name("s", 0, 40)}}
    export(tmp_path / "d", parts)
    where = [str(tmp_path / x) for x in ("d", "out", "checkpoint")]
    seen = []
    for batches in (1, 2, 1):  # stopped after some batches, started again
        dataset.scan(spark, *where, batches=batches, rows=8)
        seen.append(spark.read.parquet(where[1]).count())
    assert seen == sorted(set(seen)) and {r.part for r in spark.read.parquet(where[1]).collect()} == {"verified"}
    dataset.scan(spark, *where, rows=8)
    export(tmp_path / "d", {"unverified": {"d": name("late", 2, 11)}})  # a file that comes later
    dataset.scan(spark, *where, rows=8)
    parts["unverified"]["d"] = name("late", 2, 11)
    want = []
    for part in ("verified", "unverified"):
        texts = [t for f in parts[part].values() for t in f]
        want += [(part, i, t.strip()) for i, t in enumerate(texts) if t and t.strip()]
    got = spark.read.parquet(where[1]).orderBy("batch", F.col("part").desc(), "pos").select("part", "pos", "text").collect()
    assert [tuple(r) for r in got] == want


def test_dataset_goes_on_after_what_a_ledger_says(spark, tmp_path):
    export(tmp_path / "d", {"verified": {"a": [f"v{i}" for i in range(20)]}, "unverified": {"a": [f"u{i}" for i in range(5)]}})
    dataset.scan(spark, *(str(tmp_path / x) for x in ("d", "out", "checkpoint")), done='{"verified": 18, "unverified": 4}')
    assert sorted(r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["u4", "v18", "v19"]


def items(spark, folder, numbers):
    for i in numbers:
        spark.createDataFrame([(f"k{i}", f"good words of item {i}"), (f"n{i}", "123")], "key string, text string").coalesce(1).write.mode("append").parquet(f"{folder}/in")


def tables(spark, out):
    return {t: sorted(r.key for r in collect.collection(spark, out, t).collect()) for t in collect.TABLES}


def run(spark, folder, **bounds):
    return collect.collected(spark, f"{folder}/in", "key string, text string", LATIN, f"{folder}/out", f"{folder}/cp", files_per_batch=1, **bounds)


@pytest.mark.parametrize("writes", [0, 1, 2, 3])
def test_a_crash_between_any_two_writes_shows_all_of_a_batch_or_none(spark, tmp_path, monkeypatch, writes):
    from pyspark.sql import DataFrameWriter

    items(spark, tmp_path, [0])
    assert tables(spark, f"{tmp_path}/out") == {"raw": [], "clean": [], "ledger": []}
    run(spark, tmp_path)
    first = tables(spark, f"{tmp_path}/out")
    assert first == {"raw": ["k0", "n0"], "clean": ["k0"], "ledger": ["k0", "n0"]}
    items(spark, tmp_path, [1])
    done, parquet, publish = [], DataFrameWriter.parquet, commits.publish

    def crash(f):
        def call(*a, **b):
            if len(done) == writes:
                raise OSError("the driver is gone")
            done.append(1)
            return f(*a, **b)

        return call

    with monkeypatch.context() as m:
        m.setattr(DataFrameWriter, "parquet", crash(parquet))
        m.setattr(commits, "publish", crash(publish))
        with pytest.raises(Exception, match="driver is gone"):
            run(spark, tmp_path)
    assert tables(spark, f"{tmp_path}/out") == first
    assert run(spark, tmp_path) == "drained"
    assert tables(spark, f"{tmp_path}/out") == {"raw": ["k0", "k1", "n0", "n1"], "clean": ["k0", "k1"], "ledger": ["k0", "k1", "n0", "n1"]}


def test_a_run_ends_at_its_bounds_and_the_next_goes_on(spark, tmp_path):
    items(spark, tmp_path, range(6))
    assert run(spark, tmp_path, most_items=3) == "items"
    assert len(tables(spark, f"{tmp_path}/out")["raw"]) == 4  # bounds hold between batches of two
    assert run(spark, tmp_path, most_seconds=0, most_items=100) == "seconds"
    assert len(tables(spark, f"{tmp_path}/out")["raw"]) == 6
    assert run(spark, tmp_path, most_seconds=1000, most_items=100) == "drained"
    assert tables(spark, f"{tmp_path}/out")["clean"] == [f"k{i}" for i in range(6)]
    assert run(spark, tmp_path) == "drained" and len(tables(spark, f"{tmp_path}/out")["raw"]) == 12
