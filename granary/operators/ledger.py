"""Order-dependent and ledger operators: done-sets, first and last wins, caps, retries, islands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import Scratch, cut_lineage
from . import folds


def pending(candidates: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Candidates whose key isn't in the done-set. Spark broadcasts the done-set where its size allows."""
    return candidates.join(done.select(key).distinct(), key, "left_anti")


def pending_elsewhere(candidates: DataFrame, ledger: DataFrame, namespaces: list[str], key: str = "key") -> DataFrame:
    """Candidates that none of the other namespaces holds; keys that begin with _ are bookkeeping and don't count."""
    held = ledger.where(F.col("namespace").isin(namespaces) & ~F.col(key).startswith("_"))
    return pending(candidates, held, key)


def unread(rows: DataFrame, ledger: DataFrame, by: str, order: str, done: str = "docs_done") -> DataFrame:
    """Rows of each stream from the position on that its ledger entry gives; all rows of a stream without an entry.

    ledger (by, docs_done): one row a stream."""
    left = rows.join(ledger.select(by, F.col(done).alias("_done")), by, "left")
    return left.where(F.col(order) >= F.coalesce("_done", F.lit(0))).drop("_done")


def first_per_key(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The first row of each key, combined before the shuffle; rows with equal order: any one of them."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


def last_per_key(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


def consecutive_distinct(rows: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """Rows whose value differs from the row before."""
    before = F.lag(value).over(Window.partitionBy(by).orderBy(order))
    return rows.withColumn("_b", before).where(~F.col(value).eqNullSafe(F.col("_b")) | F.col("_b").isNull()).drop("_b")


def first_n(rows: DataFrame, by: str, order: str, n: int) -> DataFrame:
    """At most n rows of each group: a cap of a batch. Below spark.sql.optimizer.windowGroupLimitThreshold (1000) each task
    keeps n rows of a group before the shuffle, so a group that holds most rows meets as n rows a task."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(order))).where(F.col("_n") <= n).drop("_n")


def first_where(rows: DataFrame, condition: Column, order: str) -> DataFrame:
    """The first row that fits, or none: a top-1, without a sort of all rows."""
    return rows.where(condition).orderBy(order).limit(1)


def running_total(rows: DataFrame, by: str, order: str, value: str, name: str = "before") -> DataFrame:
    """rows with the sum of `value` over the earlier rows of their group; rows of equal order: in any one order.

    A group may hold most rows: they are dealt out by ranges of (by, order) and summed within each range; what the
    ranges before it hold is added from a table of one row for each group and range.
    """
    dealt = rows.repartitionByRange(by, order).withColumn("_range", F.spark_partition_id())
    dealt = Scratch(rows.sparkSession).written(dealt, "dealt")
    ranges = dealt.groupBy(by, "_range").agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(by, "_range", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_first"))
    within = Window.partitionBy(by, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    inside = dealt.withColumn(name, F.coalesce(F.sum(value).over(within), F.lit(0)))
    return inside.join(ranges, [by, "_range"]).withColumn(name, F.col(name) + F.col("_first")).select(*rows.columns, name)


def token_prefix(rows: DataFrame, by: str, order: str, tokens: str, cap: int | None) -> DataFrame:
    """Rows until the running total reaches the cap; the row that crosses it stays. No cap: all rows."""
    if cap is None:
        return rows
    return running_total(rows, by, order, tokens, "_before").where(F.col("_before") < cap).drop("_before")


def shards(rows: DataFrame, by: str, order: str, tokens: str, limit: int) -> DataFrame:
    """Shard number of each row: a shard closes once it holds `limit` tokens, and the overshoot is forgotten. A long stream
    is folded in ranges side by side, see folds.shards()."""
    some = rows.select(F.col(by).alias("stream"), F.col(order).cast("long").alias("pos"), F.col(tokens).cast("long").alias("tokens"))
    return folds.shards(some, limit).select(F.col("stream").alias(by), F.col("pos").alias(order), "tokens", "shard")


def retry_plan(attempts: DataFrame, key: str = "key", order: str = "pos", ok: str = "ok") -> DataFrame:
    """What a queue that takes a failed item back once does: tries made, and done, retried or given_up."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(order))
    tries = attempts.withColumn("_n", n).where("_n <= 2").groupBy(key)
    got = tries.agg(F.min(F.when(F.col(ok), F.col("_n"))).alias("won"), F.max("_n").alias("seen"))
    state = F.when(F.col("won").isNotNull(), "done").when(F.col("seen") < 2, "retry").otherwise("given_up")
    return got.select(key, F.coalesce("won", "seen").cast("long").alias("tries"), state.alias("state"))


def before_empty_run(pages: DataFrame, by: str, order: str, nonempty: str, stop: int = 2) -> DataFrame:
    """Pages before `stop` empty ones in a row; failed pages (null) neither count as empty nor break a run."""
    w = Window.partitionBy(by).orderBy(order)
    island = F.sum(F.when(F.col(nonempty), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = pages.withColumn("_i", island)
    within = Window.partitionBy(by, "_i").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_e", F.sum(F.when(~F.col(nonempty), 1).otherwise(0)).over(within))
    seen = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_m", F.max("_e").over(seen)).where(F.col("_m") < stop).drop("_i", "_e", "_m")


def byte_ranges(offsets: DataFrame, end: int, by: str | None = None) -> DataFrame:
    """start and end of each distinct offset; the last one ends with the file."""
    keys = [by] if by else []
    w = Window.partitionBy(*keys).orderBy("start")
    return offsets.select(*keys, F.col("offset").alias("start")).distinct().withColumn("end", F.lead("start", 1, end).over(w))


def refetch(children: DataFrame, cache: DataFrame, newest: int = 5, most: int = 1500) -> DataFrame:
    """Child sitemaps to read again: the newest of each index, and those that the cache lacks."""
    ranked = children.withColumn("_n", F.row_number().over(Window.partitionBy("index_url").orderBy(F.col("lastmod").desc_nulls_last(), "child_url"))).where(F.col("_n") <= most)
    known = cache.select("index_url", "child_url").distinct().withColumn("_k", F.lit(True))
    return ranked.join(known, ["index_url", "child_url"], "left").where(F.col("_k").isNull() | (F.col("_n") <= newest)).drop("_n", "_k")


def merged_cache(children: DataFrame, cache: DataFrame, fetched: DataFrame) -> DataFrame:
    """index_url, child_url, article_url after a visit: what was read anew replaces what the cache held, a child that
    could not be read (null articles) keeps it, and children that their index no longer lists go.

    fetched: child_url, articles (array).
    """
    listed = children.select("index_url", "child_url").distinct()
    read = fetched.where("articles is not null")
    held = cache.join(listed, ["index_url", "child_url"], "left_semi").join(read.select("child_url").distinct(), "child_url", "left_anti")
    new = listed.join(read, "child_url").select("index_url", "child_url", F.explode("articles").alias("article_url"))
    return held.select("index_url", "child_url", "article_url").unionByName(new).distinct()


def reachable(edges: DataFrame, roots: DataFrame, depths: int = 50, documents: int | None = None) -> DataFrame:
    """node, depth of what a crawl of (parent, child) edges from roots (node) reaches, breadth first.

    Each depth is cut off by a checkpoint, so that the plan doesn't grow with the depth. documents: the crawl ends
    once it has read so many, of one depth the smallest nodes; then `cut` tells whether there was more to read.
    """
    seen = frontier = cut_lineage(roots.select("node").distinct().withColumn("depth", F.lit(0)))
    cut = False
    for depth in range(1, depths + 1):
        step = frontier.join(edges, frontier.node == edges.parent).select(F.col("child").alias("node")).distinct()
        step = step.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth))
        if documents is not None:
            left = max(0, documents - seen.count())
            step = cut_lineage(step.orderBy("node").limit(left + 1))
            cut = step.count() > left
            step = step.orderBy("node").limit(left)
        frontier = cut_lineage(step)
        if frontier.isEmpty():
            break
        seen = cut_lineage(seen.unionByName(frontier))
        if cut:
            break
    return seen if documents is None else seen.withColumn("cut", F.lit(cut))


def throughput(runs: DataFrame, by: str) -> DataFrame:
    """Totals and words an hour."""
    return runs.groupBy(by).agg(F.sum("words").alias("words"), F.round(F.sum("words") / F.nullif(F.sum("elapsed_s"), F.lit(0)) * 3600, 6).alias("words_per_hour"))


def leakage(train: DataFrame, held: DataFrame, keys: list[str]) -> DataFrame:
    """How many distinct keys both sides hold, and how many held ones training lacks."""
    h, t = held.select(*keys).distinct(), train.select(*keys).distinct()
    both = h.join(t.withColumn("_t", F.lit(True)), keys, "left")
    return both.agg(F.count_if(F.col("_t")).alias("shared"), F.count_if(F.col("_t").isNull()).alias("only_held"))


def side_by_side(rows: DataFrame, key: str, column: str, names: list, value: str) -> DataFrame:
    """One row a key with the value of each name in a column of its own; null where there is none."""
    return rows.groupBy(key).pivot(column, names).agg(F.first(value, ignorenulls=True))
