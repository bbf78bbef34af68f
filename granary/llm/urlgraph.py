"""URL filters by trust and distrust over the graph of hosts.

Rules give verdicts where one fits. Elsewhere a host's verdict comes from two personalised PageRanks over host
edges: trust flows from hosts that rules allow along links, distrust flows from blocked hosts against links (who
links to a bad host is worse for it). A host whose distrust outweighs its trust is blocked. Links that stay on their
host, as all relative ones do, say nothing about others; without links between hosts the seeds alone have ranks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, joined_evenly, table

# The rules (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
DAMPING = 0.85
TOLERANCE = 2e-10  #: of what the rounds that are left out could still add to all ranks in sum; ranks are given to 9 digits
STRIDE = 6  #: rounds between two checkpoints, where the change is looked at
MARGIN = 1.0  #: a host is blocked when distrust exceeds this many times its trust

#: Destinations of links, as they stand: absolute, without a scheme, or relative.
LINK = r"""(?i)<a\s(?:[^>]*?\s)?href\s*=\s*["']?\s*([^\s"'>]+)"""


def host_of(url: F.Column) -> F.Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; '' without :// or url."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: F.Column) -> F.Column:
    """After the host up to ? or # or the end; '' without :// or url."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: F.Column, path: F.Column, rules: tuple = RULES) -> tuple[F.Column, F.Column]:
    """The longest fitting rule as text, and its verdict; null where none fits."""
    name = verdict = None
    for v, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name = F.when(fits, f"{h}{p}") if name is None else name.when(fits, f"{h}{p}")
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return name, verdict


def target_host(link: F.Column, host: F.Column) -> F.Column:
    """The host that a link on a page of `host` leads to: its own for relative links; '' for other schemes (mail)."""
    absolute = link.rlike("(?i)^https?://")
    named = host_of(F.when(link.startswith("//"), F.concat(F.lit("http:"), link)).otherwise(link))
    return F.when(absolute | link.startswith("//"), named).when(link.rlike("(?i)^[a-z][a-z0-9+.-]*:"), "").otherwise(host)


def edges(pages: DataFrame, kinship: int = 0) -> DataFrame:
    """src, dst, w: links between different hosts, summed.

    kinship: a host and its parent domain count as linked both ways by so many links; by default they don't.
    """
    host = host_of(F.col("url"))
    linked = pages.where(F.col("html").isNotNull() & (host != "")).select(host.alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), 1)).alias("to"))
    linked = linked.select("src", target_host(F.col("to"), F.col("src")).alias("dst")).where("dst <> '' and src <> dst")
    found = linked.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("w"))
    if not kinship:
        return found
    seen = pages.select(host.alias("host")).where("instr(host, '.') > 0").distinct()
    parent = seen.select("host", F.regexp_extract("host", r"^[^.]*\.(.*)$", 1).alias("parent")).where("instr(parent, '.') > 0")
    kin = parent.selectExpr("host as src", "parent as dst").unionByName(parent.selectExpr("parent as src", "host as dst")).withColumn("w", F.lit(kinship).cast("bigint"))
    return found.unionByName(kin).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def spread(graph: DataFrame, seeds: DataFrame, damping: float | None = None, tolerance: float | None = None) -> DataFrame:
    """Personalised PageRanks: kind, host, rank. graph: kind, src, dst, p (shares of src's links); seeds: kind, host, s.

    s sums to 1 for each kind of rank. Flow from hosts without links is lost, so ranks sum to at most 1. Hosts that
    nothing reaches have no row. From the seeds' restart on, ranks only grow, towards their limit: the growth of
    their sum is the summed change, and what all further rounds add is at most damping^k / (1 - damping^k) times
    the growth over the last k. Rounds go on until that falls below `tolerance`.

    A popular host's inflow is pre-aggregated before each shuffle; no host's links are gathered in one task. Ranks are
    written every STRIDE rounds, and the table before is removed.
    """
    damping, tolerance = damping or DAMPING, tolerance or TOLERANCE
    scratch = Scratch(graph.sparkSession)
    base = scratch.written(seeds.select("kind", "host", ((1 - damping) * F.col("s")).alias("rank")), "base")
    if graph.isEmpty():
        return base
    left = damping**STRIDE / (1 - damping**STRIDE)
    total = lambda rank: rank.agg(F.sum("rank")).first()[0] or 0.0
    rank, was, stride = base, total(base), 0
    while True:
        for _ in range(STRIDE):
            flow = graph.join(rank.select(F.col("kind").alias("k"), "host", "rank"), (F.col("kind") == F.col("k")) & (F.col("src") == F.col("host"))).select("kind", F.col("dst").alias("host"), (damping * F.col("p") * F.col("rank")).alias("rank"))
            rank = flow.unionByName(base).groupBy("kind", "host").agg(F.sum("rank").alias("rank"))
        rank, stride = scratch.written(rank, f"rank-{stride + 1}"), stride + 1
        scratch.drop(f"rank-{stride - 1}")
        now = total(rank)
        if (now - was) * left < tolerance:
            return rank
        was = now


def shares(graph: DataFrame) -> DataFrame:
    return graph.join(graph.groupBy("src").agg(F.sum("w").alias("all")), "src").select("src", "dst", (F.col("w") / F.col("all")).alias("p"))


def weighted(hosts: DataFrame, column: str) -> DataFrame:
    """Seeds in proportion to a column of counts; none where all are zero."""
    hosts = hosts.where("host <> ''")
    total = hosts.agg(F.sum(column)).first()[0] or 1
    return hosts.where(F.col(column) > 0).select("host", (F.col(column) / F.lit(float(total))).alias("s"))


def judged(pages: DataFrame, rules: tuple = RULES, kinship: int = 0) -> DataFrame:
    """The contract's columns for every row of pages (page_id, url, html), and trust, distrust of the host.

    Null urls, and those without ://, have empty host and path, no rule, and are allowed, as is every host that
    neither rank reaches. Null html has no links. Repeated rows stay, and count as often as links; an empty
    table gives no rows; further columns are ignored. A host that rules allow for some pages and block for
    others is a seed of both, by its pages; its pages without a rule are blocked when more of distrust comes to it.
    """
    out = _verdicts(pages, F.col("page_id"), rules, kinship)
    return out.select(F.col("row").alias("page_id"), "host", "path", "rule", "verdict", "trust", "distrust")


def allowed(pages: DataFrame, rules: tuple = RULES, kinship: int = 0) -> DataFrame:
    """Rows of pages whose verdict is allow, with all columns, each judged by its own url, whatever its page_id."""
    return _verdicts(pages, F.struct(*pages.columns), rules, kinship).where("verdict = 'allow'").select("row.*")


def _verdicts(pages: DataFrame, row: F.Column, rules: tuple, kinship: int) -> DataFrame:
    scratch = Scratch(pages.sparkSession)
    rows = pages.select(row.alias("row"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": name, "ruled": verdict})
    counts = rows.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("ruled") == "allow").alias("good"), F.count_if(F.col("ruled") == "block").alias("bad"))
    hosts = scratch.written(counts, "hosts")
    graph = scratch.written(edges(pages, kinship), "graph")
    back = graph.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    both = lambda trust, distrust: trust.withColumn("kind", F.lit("trust")).unionByName(distrust.withColumn("kind", F.lit("distrust")))
    ranks = spread(scratch.written(both(shares(graph), shares(back)), "shares"), both(weighted(hosts, "good"), weighted(hosts, "bad")))
    ranks = ranks.groupBy("host").agg(*(F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("rank"))), F.lit(0.0)).alias(k) for k in ("trust", "distrust")))
    trust, distrust = (F.round(F.coalesce(F.col(c), F.lit(0.0)), 9) for c in ("trust", "distrust"))
    method = F.when(distrust > MARGIN * trust, "block").otherwise("allow")
    known = scratch.written(hosts.select("host", "n").join(ranks, "host", "left").select("host", "n", trust.alias("trust"), distrust.alias("distrust"), method.alias("method")), "known")
    return joined_evenly(rows, known, "host", "n").withColumn("verdict", F.coalesce("ruled", "method"))


def op8_trust_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages"))


_FITS = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'" for _, h, p in sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r)))
_VERDICTS = " ".join(f"WHEN '{h}{p}' THEN '{v}'" for v, h, p in RULES)
_HOST = "translate(regexp_extract({}, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LINK = LINK.replace("'", "''")

OP8_SQL = rf"""
WITH RECURSIVE p AS (SELECT page_id, coalesce({_HOST.format("url")}, '') AS host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path, html FROM pages),
r AS (SELECT *, CASE {_FITS} END AS rule FROM p), v AS (SELECT *, CASE rule {_VERDICTS} END AS ruled FROM r),
l AS (SELECT host AS src, unnest(regexp_extract_all(html, '{_LINK}', 1)) AS t FROM p WHERE host <> ''),
d AS (SELECT src, CASE WHEN regexp_matches(t, '(?i)^https?://') THEN {_HOST.format("t")} WHEN starts_with(t, '//') THEN {_HOST.format("'http:' || t")} WHEN regexp_matches(t, '(?i)^[a-z][a-z0-9+.-]*:') THEN '' ELSE src END AS dst FROM l),
w AS (SELECT src, dst, count(*) AS w FROM d WHERE dst <> '' AND src <> dst GROUP BY ALL),
g AS (SELECT 'trust' AS kind, src, dst, w / sum(w) OVER (PARTITION BY src) AS p FROM w UNION ALL SELECT 'distrust', dst, src, w / sum(w) OVER (PARTITION BY dst) FROM w),
s AS (SELECT CASE ruled WHEN 'allow' THEN 'trust' ELSE 'distrust' END AS kind, host, count(*) / sum(count(*)) OVER (PARTITION BY ruled) AS s FROM v WHERE ruled IS NOT NULL AND host <> '' GROUP BY ruled, host),
inc AS (SELECT 0 AS k, kind, host, {1 - DAMPING} * s AS x FROM s
  UNION ALL SELECT inc.k + 1, inc.kind, g.dst, sum({DAMPING} * g.p * inc.x) FROM inc JOIN g ON g.kind = inc.kind AND g.src = inc.host WHERE inc.k < 160 GROUP BY inc.k, inc.kind, g.dst),
ranks AS (SELECT host, round(coalesce(sum(x) FILTER (kind = 'trust'), 0), 9) AS trust, round(coalesce(sum(x) FILTER (kind = 'distrust'), 0), 9) AS distrust FROM inc GROUP BY host)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN coalesce(distrust, 0) > {MARGIN} * coalesce(trust, 0) THEN 'block' ELSE 'allow' END) AS verdict, coalesce(trust, 0.0) AS trust, coalesce(distrust, 0.0) AS distrust
FROM v LEFT JOIN ranks USING (host)
"""
