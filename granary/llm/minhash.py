"""Near-duplicates by MinHash with tensored banding.

Two small collections of minhash bands are computed; a table key combines one band of each, so that m * m tables
need 2 * m bands only. Documents of a bucket become candidates, are verified on full shingle sets, and linked
documents are joined to components.

Texts of equal sets are one class, verified once. In each bucket all classes are compared with one centre; what
different components have in common after that is compared in blocks, by parity sketches that prove most pairs too
different, so that only pairs that may be links leave a block.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import RollingHash, Scratch, as_bytes, joined_evenly, mix, table

SHINGLE = 2
BANDS, ROWS = 16, 3  #: bands in each collection, minhashes in a band
SIMILAR = (4, 5)  #: a link: intersection / union at least 4/5

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
PIECE = 1 << 20
PARITY = 512  #: least bits of a set's parity sketch
BLOCK = 512  #: classes of a band that are compared with as many others at once


def word_hashes(text: bytes, rolling: RollingHash) -> np.ndarray:
    """64-bit hashes of the words `[^ \\t-\\r]+` of a text, A-Z lower-cased; long texts go piece by piece."""
    out = []
    at = 0
    while at < len(text):
        end = min(len(text), at + PIECE)
        block = np.frombuffer(text, np.uint8, end - at, at)
        space = _SPACE[block]
        if end < len(text):
            cut = np.flatnonzero(space)
            if not len(cut):  # one word longer than a piece
                m = at
                while m < len(text) and not _SPACE[text[m]]:
                    m += 1
                end = m
                block = np.frombuffer(text, np.uint8, end - at, at)
                space = _SPACE[block]
            else:
                end = at + int(cut[-1]) + 1
                block, space = block[: end - at], space[: end - at]
        edges = np.flatnonzero(np.diff(np.concatenate(([True], space, [True]))))
        if len(edges):
            out.append(rolling.of(rolling.prefix(_LOWER[block]), edges[::2], edges[1::2]))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingles(text: bytes, rolling: RollingHash, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of k-word shingles; of fewer words, the whole sequence is one."""
    w = word_hashes(text, rolling)
    if not len(w):
        return w
    n = max(1, len(w) - k + 1)
    h = np.full(n, min(k, len(w)), np.uint64)
    for i in range(min(k, len(w))):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + w[i : i + n])
    return np.unique(h)


_SEEDS = mix(np.arange(1, 1 + 2 * BANDS * ROWS, dtype=np.uint64)) | np.uint64(1)


def band_hashes(sets: list[np.ndarray]) -> np.ndarray:
    """One row for each (non-empty) set: 2 * BANDS hashes, each of ROWS minhashes."""
    flat, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])
    out = np.zeros((len(sets), 2 * BANDS), np.uint64)
    for i, seed in enumerate(_SEEDS):
        h = flat * seed
        h ^= h >> np.uint64(31)
        h *= _SEEDS[-1 - i]
        least = np.minimum.reduceat(h, starts)
        out[:, i // ROWS] = mix(out[:, i // ROWS] * np.uint64(0x9E3779B97F4A7C15) + least)
    return out


def parity(a: np.ndarray) -> np.ndarray:
    """Bits that each member of a set flips, 4 for each member and rounded up to a power of two. Two sets differ in at
    least as many members as their bits do; the bits of a larger sketch fold to those of a smaller one."""
    size = max(PARITY, 1 << (4 * len(a) - 1).bit_length()) if len(a) else PARITY
    odd = np.bincount(((a >> np.uint64(7)) & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """The sketch of the same set in fewer words."""
    while len(bits) > words:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def set_hashes(a: np.ndarray) -> tuple[int, int]:
    """Two 64-bit hashes of a whole set, signed."""
    return int(mix(np.array([np.bitwise_xor.reduce(mix(a + np.uint64(1)))], np.uint64)).view(np.int64)[0]), int(np.add.reduce(mix(a)).view(np.int64))


def _portions(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Stretches of texts of a few MB, or one long text."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= 4 * PIECE):
            size += len(texts[end])
            end += 1
        yield at, end
        at = end


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rolling = RollingHash()
    for batch in batches:
        ids, texts = batch.column("doc_id"), as_bytes(batch.column("text"))
        for at, end in _portions(texts):
            sets = [shingles(t, rolling) for t in texts[at:end]]
            full = [s for s in sets if len(s)]
            bands = iter(band_hashes(full) if full else [])
            rows = [next(bands) if len(s) else None for s in sets]
            hashes = [set_hashes(s) if len(s) else (None, None) for s in sets]
            columns = [pa.array([len(s) for s in sets], pa.int64()), *(pa.array([h[k] for h in hashes], pa.int64()) for k in (0, 1))]
            columns += [pa.array([None if r is None else r[part].view(np.int64) for r in rows], pa.list_(pa.int64())) for part in (slice(BANDS), slice(BANDS, None))]
            yield pa.RecordBatch.from_arrays([ids.slice(at, end - at), *columns], ["doc_id", "n_shingles", "h1", "h2", "a", "b"])


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, two hashes of the whole set, and the bands of both collections."""
    return docs.select("doc_id", "text").mapInArrow(_sketches, f"doc_id {dict(docs.dtypes)['doc_id']}, n_shingles long, h1 long, h2 long, a array<long>, b array<long>")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, set, parity of the texts whose set is the class's (h1, h2)."""
    rolling = RollingHash()
    for batch in batches:
        texts = as_bytes(batch.column("text"))
        wanted = list(zip(batch.column("h1").to_pylist(), batch.column("h2").to_pylist(), strict=True))
        for at, end in _portions(texts):
            sets = [shingles(t, rolling) for t in texts[at:end]]
            mine = [k for k, s in enumerate(sets) if len(s) and set_hashes(s) == wanted[at + k]]
            offsets = np.cumsum([0, *(len(sets[k]) for k in mine)]).astype(np.int32)
            arrays = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.uint64), *(sets[k] for k in mine)]).view(np.int64)))
            bits = pa.array([parity(sets[k]).view(np.int64) for k in mine], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("id").slice(at, end - at).take(pa.array(mine, pa.int64())), arrays, bits], ["id", "set", "parity"])


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose full sets are similar enough."""
    num, den = SIMILAR
    for batch in batches:
        cols = [batch.column(n) for n in ("x_set", "y_set")]
        flats = [np.asarray(c.values.to_numpy(zero_copy_only=False)) for c in cols]
        offs = [np.asarray(c.offsets) for c in cols]
        keep = []
        for i in range(batch.num_rows):
            x, y = (f[o[i] : o[i + 1]] for f, o in zip(flats, offs, strict=True))
            both = len(x) + len(y) - len(np.union1d(x, y))
            keep.append(den * both >= num * (len(x) + len(y) - both))
        yield batch.select(["x", "y"]).filter(pa.array(keep, pa.bool_()))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (x, y) that are links; sets: id, set."""
    xs, ys = (sets.select(F.col("id").alias(c), F.col("set").alias(f"{c}_set")) for c in "xy")
    return pairs.join(xs, "x").join(ys, "y").select("x", "y", "x_set", "y_set").mapInArrow(_similar, "x long, y long")


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """id, component (smallest id reachable) of all ids in links (x, y).

    Label spreading: large-star and small-star steps until no edge changes. A centre's edges, however many, are dealt
    out evenly. Each step's edges are written, and the step's before removed.
    """
    name = f"edges-{uuid.uuid4().hex[:8]}"
    edges = scratch.written(links.where("x <> y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct(), f"{name}-0")
    step, before = 0, None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = both.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("m"))
        near = scratch.written(near.withColumn("m", F.least("u", "m")), f"{name}-near")
        large = joined_evenly(both, near, "u", "n").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.written(large, f"{name}-large")
        least = scratch.written(large.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("m")), f"{name}-least")
        small = joined_evenly(large, least, "u", "n").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        step += 1
        edges = scratch.written(small.where("u <> v").distinct(), f"{name}-{step}")
        scratch.drop(f"{name}-{step - 1}", f"{name}-near", f"{name}-large", f"{name}-least")
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def similar_size() -> F.Column:
    num, den = SIMILAR
    return den * F.least("x_n", "y_n") >= num * F.greatest("x_n", "y_n")


def grouped(docs: DataFrame) -> DataFrame:
    """The contract's columns for every row of docs (doc_id, text).

    Null and empty texts, and those of white space, have empty sets and are linked with nothing. Texts of equal
    sets are one class, whose smallest doc_id stands for it. A null doc_id is a document of its own, always
    kept; rows that repeat a doc_id share its component, whatever their texts. Further columns are ignored; an empty
    table gives no rows.

    In each bucket all documents are compared with the one whose bands are shared most; what is then still in
    different components and shares a band of both collections, so a bucket, is compared pair by pair, each pair
    once, in blocks, where parity sketches leave room for a link. Every pair of a bucket is so compared or already in
    one component.
    """
    scratch = Scratch(docs.sparkSession)
    all_docs = scratch.written(sketches(docs), "sketches")
    known = all_docs.where("n_shingles > 0 and doc_id is not null")
    key = ["h1", "h2", "n_shingles"]
    found = known.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("a").alias("a"), F.first("b").alias("b"))
    classes = scratch.written(found.withColumn("id", F.monotonically_increasing_id()), "classes")
    narrow = known.select("doc_id", *key)
    member = scratch.written(joined_evenly(narrow, classes.select(*key, "id", "n"), key, "n").select("doc_id", "n_shingles", "id"), "member")
    twice = member.groupBy("doc_id").agg(F.min("id").alias("x"), F.max("id").alias("m")).where("x < m").select("doc_id", "x")
    same_doc = member.select("doc_id", F.col("id").alias("y")).join(twice, "doc_id").where("x < y").select("x", "y")
    texts = docs.select("doc_id", "text").join(classes.select("id", F.col("rep").alias("doc_id"), "h1", "h2"), "doc_id")
    comps, links = links_of(classes, texts, scratch)
    label = lambda c: comps.select(F.col("id").alias(c), F.col("component").alias(f"{c}_comp"))
    links = links.unionByName(same_doc).join(label("x"), "x", "left").join(label("y"), "y", "left")
    further = components(links.select(F.coalesce("x_comp", "x").alias("x"), F.coalesce("y_comp", "y").alias("y")), scratch)
    least = classes.select("id", "rep", "n").join(comps, "id", "left").select("rep", "n", F.col("id").alias("class"), F.coalesce("component", "id").alias("id"))
    least = least.join(further, "id", "left").select(F.col("class").alias("id"), "rep", "n", F.coalesce("component", "id").alias("component"))
    least = scratch.written(least, "least")
    smallest = scratch.written(least.groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.min("rep").alias("component_id")), "smallest")
    named = scratch.written(joined_evenly(least, smallest, "component", "size").select("id", "n", "component_id"), "named")
    out = scratch.written(joined_evenly(member, named, "id", "n").select("doc_id", "n_shingles", "component_id"), "out")
    empty = all_docs.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles")
    elsewhere = empty.where("doc_id is not null").select("doc_id").distinct().join(out.groupBy("doc_id").agg(F.min("component_id").alias("component_id")), "doc_id")
    empty = empty.join(elsewhere, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    scratch.drop("classes", "member", "components", "least", "smallest", "named", "banded", "members", "sets", "each", "mixed", "labelled", "across")
    return out.unionByName(empty.select(*out.columns)).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def bands(classes: DataFrame, scratch: Scratch) -> DataFrame:
    """id, n, those bands of each collection that another class shares, and how many share them in all (fame);
    classes without shared bands of both collections are left out."""
    one = classes.select("id", F.posexplode(F.concat("a", "b")).alias("i", "h")).select("id", F.xxhash64("i", "h").alias("band"), (F.col("i") < BANDS).alias("first"))
    one = scratch.written(one, "one")
    shared = scratch.written(one.groupBy("band").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "shared")
    both = joined_evenly(one, shared, "band", "c").groupBy("id").agg(F.collect_list(F.when(F.col("first"), F.col("band"))).alias("a"), F.collect_list(F.when(~F.col("first"), F.col("band"))).alias("b"), F.sum("c").alias("fame"))
    return both.where("size(a) > 0 and size(b) > 0").join(classes.select("id", F.col("n_shingles").cast("int").alias("n")), "id")


def links_of(classes: DataFrame, texts: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Components (id, component) of links to centres, and links (x, y) between them, which join all classes (id,
    n_shingles, a, b: sketches of distinct sets) as the full link graph does.

    texts: id, h1, h2, text; of a repeated doc_id other texts than the class's may be among them.
    """
    banded = scratch.written(bands(classes, scratch), "banded")
    scratch.drop("one", "shared")
    keys = scratch.written(banded.select("id", "n", "fame", F.explode(F.flatten(F.transform("a", lambda a: F.transform("b", lambda b: F.xxhash64(a, b))))).alias("key")), "keys")
    famous = F.struct("fame", (-F.col("id")).alias("id"), "n")
    centre = keys.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.max(famous).alias("m")).where("c > 1").select("key", "c", (-F.col("m.id")).alias("x"), F.col("m.n").alias("x_n"))
    centre = scratch.written(centre, "centre")
    members = scratch.written(joined_evenly(keys.select("id", "n", "key"), centre, "key", "c").select("id", "n", "x", "x_n").distinct(), "members")
    scratch.drop("keys", "centre")
    star = members.where("id <> x").select("x", F.col("id").alias("y"), "x_n", F.col("n").alias("y_n")).where(similar_size()).select("x", "y")
    wanted = members.select("id").distinct()
    sets = texts.join(wanted, "id", "left_semi").select("id", "h1", "h2", "text").mapInArrow(_sets, "id long, set array<long>, parity array<long>")
    sets = scratch.written(sets.dropDuplicates(["id"]), "sets")
    comps = scratch.written(components(verified(star, sets), scratch), "components")
    named = banded.join(comps, "id", "left").withColumn("comp", F.coalesce("component", "id")).join(sets.select("id", "parity"), "id").select("id", "n", "comp", "a", "b", "parity")
    named = scratch.written(named, "labelled")
    return comps, verified(scratch.written(across(named, scratch), "across"), sets)


def distinct_documents(docs: DataFrame) -> DataFrame:
    """One row of docs for each group of near-duplicates, that of the smallest doc_id; all columns as they were."""
    kept = grouped(docs).where("kept").select("doc_id").distinct()
    return docs.where("doc_id is null").unionByName(docs.join(kept, "doc_id", "left_semi").select(*docs.columns))


def across(named: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs (x, y) of classes of different components that share a band of both collections and that size and parity
    leave room for a link, each once. named: id, n, comp, a, b, parity.

    The largest component of a band needs no comparison within itself: its classes and all others are dealt into
    blocks, and so are the others alone (role 0). Each block of one kind meets each of the other in a task of its own,
    which gives only the pairs that may be links.
    """
    each = scratch.written(named.select("id", "comp", F.explode("a").alias("band")), "each")
    held = each.groupBy("band", "comp").agg(F.count(F.lit(1)).alias("c")).groupBy("band")
    mixed = held.agg(F.sum("c").alias("c"), F.max(F.struct("c", "comp")).alias("top"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    blocks = lambda c: F.ceil(c / BLOCK).cast("long")
    mixed = mixed.select("band", "c", F.col("top.comp").alias("major"), blocks(F.col("c")).alias("n_all"), blocks(F.col("c") - F.col("top.c")).alias("n_minor"))
    placed = joined_evenly(each, scratch.written(mixed, "mixed"), "band", "c")
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    mine = lambda n: F.pmod(F.xxhash64("id", "band"), F.col(n))
    meet = lambda role, i, k: F.struct(F.lit(role).alias("role"), i.alias("i"), k.alias("k"))
    as_any = F.transform(upto("n_minor"), lambda i: meet(1, i, mine("n_all")))
    as_minor = F.when(F.col("comp") != F.col("major"), F.transform(upto("n_all"), lambda k: meet(0, mine("n_minor"), k))).otherwise(F.array().cast("array<struct<role:int,i:bigint,k:bigint>>"))
    met = placed.select("id", "band", (F.col("comp") == F.col("major")).alias("is_major"), F.inline(F.concat(as_any, as_minor)))
    rows = met.join(named, "id").select("band", "i", "k", "role", "is_major", "id", "n", "comp", "a", "b", "parity")
    meetings = rows.repartition("band", "i", "k").sortWithinPartitions("band", "i", "k", "role", "id")
    return meetings.mapInArrow(_meetings, "x long, y long")


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by band and two blocks (i, k)."""
    held: list[dict] = []
    key: tuple | None = None
    names = ["band", "i", "k", "role", "is_major", "id", "n", "comp", "a", "b"]
    for batch in batches:
        found: list[tuple[int, int]] = []
        bits = batch.column("parity")
        words, at = bits.values.to_numpy(zero_copy_only=False).view(np.uint64), bits.offsets.to_numpy()
        for z, values in enumerate(zip(*(batch.column(n).to_pylist() for n in names), strict=True)):
            row = dict(zip(names, values, strict=True)) | {"parity": words[at[z] : at[z + 1]].copy()}
            now = values[:3]
            if now != key:
                found += may_link(held)
                held, key = [], now
            held.append(row)
        yield _pairs(found)
    yield _pairs(may_link(held))


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], ["x", "y"])


def may_link(rows: list[dict]) -> list[tuple[int, int]]:
    """Pairs of a row of role 0 and one of role 1; of two that both have either role, once."""
    first = sum(r["role"] == 0 for r in rows)
    if not first or first == len(rows):
        return []
    num, den = SIMILAR
    band = rows[0]["band"]
    n, comp, ids = (np.array([r[c] for r in rows]) for c in ("n", "comp", "id"))
    major = np.array([r["is_major"] for r in rows])
    bits = [r["parity"] for r in rows]
    words = np.array([len(b) for b in bits])
    #: by number of words, the sketches of all rows that have as many at least, folded to it
    at_size = {w: np.array([folded(b, w) if len(b) >= w else np.zeros(w, np.uint64) for b in bits]) for w in set(words.tolist())}
    out = []
    for x in range(first):
        y = np.arange(first, len(rows))
        y = y[(comp[y] != comp[x]) & (major[y] | (ids[y] > ids[x])) & (den * np.minimum(n[x], n[y]) >= num * np.maximum(n[x], n[y]))]
        for w in set(np.minimum(words[x], words[y]).tolist()):
            some = y[np.minimum(words[x], words[y]) == w]
            differ = np.bitwise_count(at_size[w][some] ^ at_size[w][x]).sum(axis=1, dtype=np.int64)
            for z in some[differ * (den + num) <= (den - num) * (n[x] + n[some])].tolist():
                p, q = rows[x], rows[z]
                if min(set(p["a"]).intersection(q["a"])) == band and not set(p["b"]).isdisjoint(q["b"]):
                    out.append((min(p["id"], q["id"]), max(p["id"], q["id"])))
    return out


def op9_tensored_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT r, doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM d),
e AS (SELECT r, doc_id, len(s) AS n, unnest(s) AS g FROM s WHERE doc_id IS NOT NULL),
l AS (SELECT x.doc_id AS a, y.doc_id AS b FROM e x JOIN e y ON x.g = y.g AND x.r < y.r AND 5 * least(x.n, y.n) >= 4 * greatest(x.n, y.n) GROUP BY x.r, y.r, x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
both_ways AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach AS (SELECT a AS doc_id, b AS other FROM both_ways UNION SELECT reach.doc_id, both_ways.b FROM reach JOIN both_ways ON reach.other = both_ways.a),
least_ AS (SELECT doc_id, min(other) AS m FROM reach GROUP BY doc_id)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id, coalesce(doc_id = least(doc_id, coalesce(m, doc_id)), true) AS kept FROM s LEFT JOIN least_ USING (doc_id)
"""
