"""Ranks of a random graph of hosts against power iteration and SQL; odd inputs."""

import random

import duckdb
import numpy as np
import pandas as pd

from granary.llm import urlgraph

KIND = "page_id long, url string, html string"


def random_pages():
    r = random.Random(4)
    hosts = [f"h{i}.io" for i in range(25)] + ["a.org", "b.org", "x.net", "y.net", "q.example.com"]
    rows = []
    for i in range(220):
        host = r.choice(hosts)
        kinds = ["http://{}/a", "//{}/b?c", "HTTPS://{}", "/own", "mailto:x@{}", "rel/{}", "?q", "ftp://{}/"]
        links = "".join(f'<a {r.choice(["", "class=x "])}href={q}{r.choice(kinds).format(r.choice(hosts))}{q}>t</a>' for q in r.choices(['"', "'"], k=r.randint(0, 4)))
        rows.append((i % 200, f"http://{host.upper() if i % 9 == 0 else host}/{r.choice(['fr', 'de', 'en'])}/{i}", links if i % 11 else None))
    return rows + [(900, None, "x"), (901, "none", '<a href="http://x.net/">'), (None, "http://h1.io/", "")], hosts


def test_ranks_of_a_random_graph(spark):
    import re

    rows, hosts = random_pages()
    got = urlgraph.judged(spark.createDataFrame(rows, KIND).repartition(5)).collect()
    n = len(hosts)
    links = np.zeros((n, n))
    seeds = np.zeros((2, n))
    at = {h: i for i, h in enumerate(hosts)}
    for _, url, html in rows:
        if not url or "://" not in url:
            continue
        host = url.split("://")[1].split("/")[0].lower()
        path = "/" + url.split("://")[1].split("/", 1)[1]
        if host.endswith("net"):
            seeds[1, at[host]] += 1
        if host.endswith(".org") and path.startswith("/fr/"):
            seeds[0, at[host]] += 1
        if host == "q.example.com" and path.startswith("/de/"):
            seeds[1, at[host]] += 1
        for to in re.findall(r"""href=["']([^"']*)""", html or ""):
            m = re.match(r"(?i)(?:https?:)?//([^/?]*)", to)
            if m and m[1].lower() != host and m[1].lower() in at:
                links[at[host], at[m[1].lower()]] += 1
    ranks = []
    for k, w in ((0, links), (1, links.T)):
        p = np.divide(w, w.sum(axis=1, keepdims=True), out=np.zeros_like(w), where=w.sum(axis=1, keepdims=True) > 0)
        s = seeds[k] / seeds[k].sum()
        x = 0.15 * s
        for _ in range(400):
            x = 0.15 * s + 0.85 * (x @ p)
        ranks.append(x)
    for r in got:
        if r.host in at:
            assert abs(r.trust - ranks[0][at[r.host]]) < 1e-8 and abs(r.distrust - ranks[1][at[r.host]]) < 1e-8
            if r.rule is None:
                assert r.verdict == ("block" if r.distrust > r.trust else "allow")
    assert len(got) == len(rows) and len({r.verdict for r in got if r.rule is None}) == 2
    con = duckdb.connect()
    frame = pd.DataFrame(rows, columns=["page_id", "url", "html"]).astype({"page_id": "Int64"})
    con.register("pages", frame)
    same = lambda rows: sorted((str(r["page_id"]), r["host"], r["path"], r["rule"], r["verdict"], round(r["trust"], 8), round(r["distrust"], 8)) for r in rows)
    sql = con.sql(urlgraph.OP8_SQL).df().astype(object)
    sql = sql.where(sql.notna(), None).to_dict("records")
    assert [x[1:] for x in sorted(same(sql), key=str)] == [x[1:] for x in sorted(same([r.asDict() for r in got]), key=str)]


def test_odd_pages(spark, monkeypatch):
    monkeypatch.setattr(urlgraph, "TOLERANCE", 1e-3)  # both sides with the same ranks, whatever their digits
    rows, _ = random_pages()
    pages = spark.createDataFrame([(*r, "mine", 1) for r in rows], f"{KIND}, host string, n int")
    kept = urlgraph.allowed(pages)
    assert kept.columns == pages.columns
    verdicts = {(r.page_id, r.host, r.path): r.verdict for r in urlgraph.judged(pages).collect()}
    want = sorted((r.page_id or -1, r.url or "") for r in pages.collect() if verdicts[r.page_id, *parts(r.url)] == "allow")
    assert sorted((r.page_id or -1, r.url or "") for r in kept.collect()) == want
    assert urlgraph.judged(pages.limit(0)).count() == 0 and urlgraph.allowed(pages.limit(0)).count() == 0
    long_ = spark.createDataFrame([(1, "http://" + "a" * 100_000 + ".net/x", "<a " * 20_000)], KIND)
    assert urlgraph.judged(long_).first().verdict == "block"


def parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = rest.split("/")[0]
    return host.lower(), rest[len(host) :]


def test_kinship_is_an_option(spark, monkeypatch):
    monkeypatch.setattr(urlgraph, "TOLERANCE", 1e-3)
    pages = spark.createDataFrame([(1, "http://bad.net/", None), (2, "http://shop.io/", '<a href="/x">'), (3, "http://a.b.net/", None), (4, "http://m.ok.org/x", None), (5, "http://ok.org/fr/", None)], KIND)
    plain = {r.page_id: r for r in urlgraph.judged(pages).collect()}
    assert plain[4].trust == 0 and plain[2].verdict == "allow"
    kin = {r.page_id: r for r in urlgraph.judged(pages, kinship=1).collect()}
    assert kin[4].trust > 0
