"""The training-data operators against brute force, and on nulls, empty and repeated rows and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from granary.llm import decontaminate, fingerprint, licenses, minhash, pii, sharding, substrings, toxicity, urlgraph

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def corpus(seed=1, n=40):
    r = random.Random(seed)
    vocab = [f"w{i}é" if i % 9 == 0 else f"W{i}" for i in range(400)]
    texts = [" ".join(r.choice(vocab) for _ in range(r.randint(1, 120))) for _ in range(n)]
    for i in range(0, n, 4):  # near copies and copies
        w = texts[i].split()
        w[len(w) // 2] = "changed"
        texts += [" ".join(w), texts[i]]
    passage = " ".join(r.choice(vocab) for _ in range(150))
    texts += [texts[k] + " " + passage + "\n" + texts[k + 1] for k in range(3)]
    return [*texts, "", None, None, " \t\n", "x", "abcd " * 400]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "spans", i) for i, t in enumerate(corpus())] + [(None, "lost id", "n", 0), (7, corpus()[7], "again", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, spans string, u int").repartition(3)


def pairs(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def test_repeated_strings(docs, spark):
    length, gram = 60, 25
    rows = [(k, (t or "").encode()) for k, t in pairs(docs)]
    seen = Counter(b[i : i + length] for _, b in rows for i in range(len(b) - length + 1))
    want = []
    for k, b in rows:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int(np.count_nonzero(np.diff(np.concatenate(([False], gone))) & gone)) if len(b) else 0
        want.append((k, len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    got = [tuple(r)[:5] for r in substrings.removed(docs, length, gram).collect()]  # further columns follow
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(w[2] for w in want)
    assert substrings.removed(docs.limit(0)).count() == 0


def test_repeated_words(docs, spark):
    words = 20
    r = random.Random(5)
    name = lambda: "".join(r.choices("abcdefghijklm\u00e9", k=r.randint(1, 3))) + str(r.randint(0, 10**6))
    text = lambda n: " ".join(name() for _ in range(n))
    shared = [text(n) for n in (19, 20, 21, 35, 60)]  # below `words` words, and from there on; each shorter than LENGTH bytes
    planted = [(1000 + 2 * i + j, f"{text(40)}{' ' * j}\n{p}\t{text(40)}") for i, p in enumerate(shared) for j in (0, 1)]
    rows = planted + [(2000, text(200)), (2001, shared[2].replace(" ", " \n ")), (2002, None), (2003, " \n"), (2004, "ab " * 50)]
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    split = [(k, re.findall(r"[^\x00-\x20]+", t or "")) for k, t in pairs(table)]
    seen = Counter(tuple(w[i : i + words]) for _, w in split for i in range(len(w) - words + 1))
    want = [(k, len({j for i in range(len(w) - words + 1) if seen[tuple(w[i : i + words])] > 1 for j in range(i, i + words)})) for k, w in split]
    for block in (substrings.BLOCK, 300):  # also with every block parted
        before, substrings.BLOCK = substrings.BLOCK, block
        try:
            got = substrings.removed(table, 400, 200, words=words).select("doc_id", "n_removed", "n_repeated_words").collect()
        finally:
            substrings.BLOCK = before
        assert sorted([(x.doc_id, x.n_repeated_words) for x in got], key=str) == sorted(want, key=str)
    found = {x.doc_id: x for x in got}
    assert [found[k].n_repeated_words > 0 for k, _ in planted] == [False] * 2 + [True] * 8
    assert not any(found[k].n_removed for k, _ in planted[:8])


def test_long_texts_go_piece_by_piece(monkeypatch):
    from granary.llm.common import RollingHash

    text = bytes(random.Random(2).choices(b"ab ", k=3000))
    windows = lambda: {(int(s) + i) for s, m, _, _ in zip(*(np.concatenate(x) for x in zip(*substrings.stretches(text, RollingHash(), 40, 15), strict=True)), strict=True) for i in range(m)}
    whole = windows()
    monkeypatch.setattr(substrings, "PIECE", 500)
    assert whole == windows() == set(range(3000 - 39))


def sets_of(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + 2]) for i in range(max(1, len(w) - 1))} if w else set()


def test_near_duplicates(docs, spark):
    rows = [(k, sets_of(t)) for k, t in pairs(docs) if k is not None]
    root = {k: k for k, _ in rows}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for k, a in rows:
        for j, b in rows:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(k), find(j)
                root[max(x, y)] = min(x, y)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.grouped(docs).collect()}
    assert got.pop(None)[2]
    assert got == {k: (len(s), find(k), find(k) == k) for k, s in rows}
    kept = minhash.distinct_documents(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {k for k in root if find(k) == k} | {None}
    assert minhash.grouped(docs.limit(0)).count() == 0


def test_word_hashes_do_not_depend_on_pieces(monkeypatch):
    from granary.llm.common import RollingHash

    text = ("One two\tthree " * 50 + "x" * 300 + " end").encode()
    whole = minhash.word_hashes(text, RollingHash())
    monkeypatch.setattr(minhash, "PIECE", 64)
    assert (whole == minhash.word_hashes(text, RollingHash())).all()
    assert len(whole) == len(text.split())


def test_parity_bounds_the_difference():
    r = np.random.default_rng(1)
    for _ in range(50):
        sizes = r.integers(1, 900, 2)
        a, b = (np.unique(r.integers(0, 1500, n).astype(np.uint64) * np.uint64(11400714819323198485)) for n in sizes)
        p, q = minhash.parity(a), minhash.parity(b)
        w = min(len(p), len(q))
        bits = int(np.bitwise_count(minhash.folded(p, w) ^ minhash.folded(q, w)).sum())
        assert bits <= len(np.setxor1d(a, b)) and 64 * len(p) >= 4 * len(a)


def near_texts(seed=5, families=4, members=12):
    """Families of pages that share 60 to 95 % of their words, so that only some are linked, by others or not."""
    r = random.Random(seed)
    texts = []
    for f in range(families):
        page = [f"p{f}x{i}" for i in range(120)]
        for _ in range(members):
            w = list(page)
            for _ in range(r.choice([2, 6, 12, 20, 25])):
                w[r.randrange(len(w))] = f"u{r.randrange(10**9)}"
            texts.append(" ".join(w))
    return texts


def test_families_below_the_threshold_are_compared_in_blocks(spark, monkeypatch):
    texts = near_texts()
    rows = list(enumerate(texts)) + [(1, texts[30]), (1, texts[30]), (77, texts[2]), (5, "")]  # ids with several texts
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sets = [(k, sets_of(t)) for k, t in rows]
    root = {k: k for k, _ in rows}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for k, a in sets:
        for j, b in sets:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(k), find(j)
                root[max(x, y)] = min(x, y)
    want = sorted((k, len(s), find(k), find(k) == k) for k, s in sets)
    for block in (256, 3):
        monkeypatch.setattr(minhash, "BLOCK", block)
        assert sorted(tuple(r) for r in minhash.grouped(docs).collect()) == want
    assert 4 < len({w[2] for w in want}) < len(texts)


def hits(words, items, window=13):
    hit, found = set(), set()
    for name, w in items:
        n = min(window, len(w))
        for i in range(len(w) - n + 1) if w else ():
            for j in range(len(words) - n + 1):
                if words[j : j + n] == w[i : i + n]:
                    hit |= set(range(j, j + n))
                    found.add(name)
    return hit, found


def test_contamination(spark):
    r = random.Random(5)
    words = list("abcdef")
    items = [(i, " ".join(r.choice(words) for _ in range(n))) for i, n in enumerate([20, 15, 13, 4, 2, 0, 30])] + [(None, "a b"), (9, None)]
    texts = [" ".join(r.choice(words) for _ in range(n)) for n in (0, 3, 40, 200)] + ["X, " + items[0][1].upper() + "! yé", None, items[6][1] + " z" * 900]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, items int")
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, n_hit int")
    tok = lambda t: decontaminate.words((t or "").encode())
    known = [(i if i is None else str(i), tok(t)) for i, t in items]  # an item without an id is one too, as in the SQL
    want = []
    for i, t in enumerate(texts):
        w = tok(t)
        hit, found = hits(w, known)
        want.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found - {None})).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    assert sorted(tuple(r) for r in decontaminate.judged(docs, bench).collect()) == want
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns
    assert {r.doc_id: r.text for r in kept.collect()} == {w[0]: texts[w[0]] for w in want if not w[5]}
    cut = {r.doc_id: r.text for r in decontaminate.clean(docs, bench, cut_spans=True).collect()}
    assert cut[6].split() == ["z"] * 900
    assert decontaminate.judged(docs, bench.limit(0)).where("contaminated").count() == 0


def test_blocks_of_items_agree_with_one(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k l m n o")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c"), (2, "m n o"), (3, "b c d")], "item_id long, text string")
    one, many = (decontaminate.matches(docs, bench, limit=n).withColumn("hit", decontaminate.union_length("span_start", "span_end")).first() for n in (99, 3))
    assert one.hit == many.hit == 7
    assert one["items"] == many["items"] == ["1", "2", "3"]


EMAIL, IP, CARD, PHONE = (re.compile(x) for x in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"))


def plain_spans(t):
    """The contract, word for word."""
    digits = lambda x: re.sub("[^0-9]", "", x)
    doubled = lambda d: sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d)))
    out = [(0, *m.span()) for m in EMAIL.finditer(t)]
    out += [(1, *m.span()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(2, *m.span()) for m in CARD.finditer(t) if 16 <= len(digits(m[0])) <= 19 and doubled(digits(m[0])) % 10 == 0]
    return out + [(3, *m.span()) for m in PHONE.finditer(t) if 8 <= len(digits(m[0])) <= 15]


def test_base_spans_follow_the_patterns(spark):
    r = random.Random(4)
    alphabets = (["a", "@", ".", "1", "+", "-", " ", "(", "192.168.0.1", "4111111111111111", "é", "+1 (555) 010-9999", "b.c"], ["a", "@", ".", "-"], ["1", ".", "256", "0"], ["4111 1111 1111 1111", "-", " ", "1", "٣"], ["+", "1", "(", " ", ")"])
    for letters in alphabets:
        for _ in range(3000):
            t = "".join(r.choice(letters) for _ in range(r.randint(0, 14)))
            assert pii.base_spans(t) == plain_spans(t)
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    rows = [(i, "".join(r.choice(alphabets[0]) for _ in range(40)), 1, "mine") for i in range(60)] + [(1, None, 2, ""), (None, "a@b.c", 2, ""), (None, "a@b.c", 2, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_email int, spans string").repartition(3)
    got = sorted(((x.doc_id or -1, x.n_email, x.n_ip, x.n_card, x.n_phone, x.base_sha256) for x in pii.found(docs).collect()))
    want = []
    for k, t, *_ in rows:
        s = plain_spans(t or "")
        want.append((k or -1, *(sum(x[0] == i for x in s) for i in range(4)), hashlib.sha256(pii.joined(s).encode()).hexdigest()))
    assert got == sorted(want)
    assert pii.found(docs.limit(0)).count() == 0 and pii.masked(docs).columns == docs.columns


def test_long_runs_take_linear_time():
    import time

    n = 1_000_000
    for t in ("1" * n, "0" * 5000 + ".1.1.1", "a" * n, " " * n, "a" * n + "@", "a@" * (n // 2), "1." * (n // 2), "+" + "1 " * (n // 2), "(at)" * (n // 4), "+1" + "(" * n):
        start = time.process_time()
        base = pii.base_spans(t)
        pii.candidates(t, base)
        assert time.process_time() - start < 2
    assert pii.base_spans("0" * 5000 + ".1.1.1") == [(1, 0, 5006)]


def test_beliefs_are_exact_on_trees():
    r = np.random.default_rng(2)
    unary = r.normal(size=(5, 3))
    for skips, n in (([(0, 2)], 1), ([], 5)):  # a chain; and two tokens with a skip edge, without neighbours
        u = unary[: n if n > 1 else 2]
        edges = [(i, i + 1, 0.7) for i in range(len(u) - 1)]
        got = pii.field(u, [], 2.0, 0.7, rounds=60)
        total = np.zeros_like(u)
        for labels in np.ndindex(*[3] * len(u)):
            w = np.exp(sum(u[i, k] for i, k in enumerate(labels)) + sum(x for i, j, x in edges if labels[i] == labels[j]))
            for i, k in enumerate(labels):
                total[i, k] += w
        assert np.allclose(got, total / total.sum(axis=1, keepdims=True), atol=1e-6)


def test_edges_are_weighed_by_what_the_corpus_shows(spark):
    same = [(i, f"call +1 555 010 9{i % 900:03d} or +1 555 010 9{i % 900:03d}") for i in range(300)]
    differ = [(i, "pay +4111111 or 4111111@a.b, 192.168.0.1 or +1 92 16801") for i in range(300)]
    sets = [pii.train(spark.createDataFrame(x, "doc_id long, text string")) for x in (same, differ)]
    assert sets[0].skip == 4 > sets[1].skip == 0 and sets[0].chain > sets[1].chain
    assert len(sets[0].shapes) == 1 and pii.train(spark.createDataFrame([], "doc_id long, text string")).shapes == {}


def test_skip_edges_carry_labels_to_like_tokens(spark):
    text = "call +1 (555) 010-9999 today. or again 1 555 010 9999 later; pages 12 and 1999"
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "nothing 1 555 010 9999")], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.found(docs).collect()}
    assert got[1].n_phone == 1 and got[1].spans.count("phone") == 2
    assert got[2].spans == got[3].spans == got[4].spans == ""
    masked = {r.doc_id: r.text for r in pii.masked(docs).collect()}
    assert masked[1].count("<phone>") == 2 and masked[2] is None


def test_unconfirmed_tokens_never_confirm_each_other(spark):
    number = "9870157079875996"  # fails its check, though its shape is a card's
    cards = [(i, "card 4111 1111 1111 1111 or 4111111111111111 of 5500005555555559") for i in range(50)]
    rows = [(100, f"pay {number} then {number} now from 10.0.0.1 or 4111111111111111"), (101, " ".join([number] * 40) + " 10.0.0.1 9.8.7.6"), (102, "ask john (at) mail.com or jane [at] mail.com, not john(at)other.org; john@mail.com"), (103, "10.0.0.1 and 10001 or 100.01; 300.1.1.1 300.1.1.1"), (104, "+49 170 1234567, 0170 1234567, 170-1234567, 0171 1234567")]
    docs = spark.createDataFrame(cards + rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.found(docs).collect()}
    plain = {k: pii.joined(pii.base_spans(t)) for k, t in cards + rows}
    for k in (0, 100, 101, 103):
        assert got[k].spans == plain[k]
    named = lambda k: [rows[k - 100][1][int(a) : int(b)] for _, a, b in (x.split(":") for x in got[k].spans.split(","))]
    assert named(102) == ["john (at) mail.com", "john(at)other.org", "john@mail.com"]
    assert named(104) == ["+49 170 1234567", "0170 1234567", "170-1234567"]


def test_beliefs_on_loops_are_near_those_of_enumeration():
    r = np.random.default_rng(4)
    for _ in range(60):
        n = int(r.integers(3, 7))
        unary = r.normal(scale=1.5, size=(n, 3))
        unary[r.integers(n)] = [-12.0, 0.0, -12.0]
        skips = [(i, j) for i in range(n) for j in range(i + 2, n) if r.random() < 0.5]
        skip, chain = float(r.uniform(0, 1.2)), float(r.uniform(-0.6, 0.6))
        got = pii.field(unary, skips, skip, chain, rounds=60)
        total = np.zeros_like(unary)
        for labels in np.ndindex(*[3] * n):
            w = np.exp(sum(unary[i, k] for i, k in enumerate(labels)) + skip * sum(labels[i] == labels[j] for i, j in skips) + chain * sum(a == b for a, b in zip(labels, labels[1:], strict=False)))
            for i, k in enumerate(labels):
                total[i, k] += w
        assert np.abs(got - total / total.sum(axis=1, keepdims=True)).max() < 0.15


def test_segments_are_maximal():
    r = random.Random(6)
    for _ in range(200):
        s = np.array([r.choice([-1.0, -2.0, 3.0, 0.5]) for _ in range(r.randint(1, 30))])
        got = toxicity.segments(np.flatnonzero(s > 0), s)
        best = max((s[i:j].sum() for i in range(len(s)) for j in range(i + 1, len(s) + 1)), default=0)
        assert abs(max((x for _, _, x in got), default=0) - max(best, 0)) < 1e-9
        assert all(a[1] <= b[0] for a, b in zip(got, got[1:], strict=False))


def test_toxicity_on_held_out_rows(spark):
    r = random.Random(8)
    plain, bad = [f"plain{chr(97 + i % 26)}{i}" for i in range(300)], ["vilex", "fouly", "nasty"]
    rows = []
    for i in range(800):
        w = [r.choice(plain)[5:] + "word" for _ in range(60)]
        if i % 5 == 0:
            w[10:10] = [r.choice(bad) for _ in range(4)]
        rows.append((i, " ".join(w), int(i % 5 == 0)))
    docs = spark.createDataFrame([(i, t, 0) for i, t, _ in rows] + [(9001, None, 0), (9002, "", 0)], "doc_id long, text string, evidence int")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(9001, 1, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.scored(docs, labels).collect()}
    assert len(got) == 802 and all(0 <= r.score <= 1 for r in got.values())
    for i, _, y in rows:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert got[i].predicted == y
    assert got[9001].predicted == got[9002].predicted == 0
    kept = toxicity.clean(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 642
    assert toxicity.scored(docs, labels.limit(0)).where("predicted = 1").count() == 0


def test_tokens_of_all_scripts():
    assert toxicity.tokens("Hello, WORLD's «été» — 12ab_c") == ["hello", "world", "s", "été", "ab", "c"]
    assert toxicity.tokens("日本語 text漢字") == ["日本", "本語", "text", "漢字"]
    assert toxicity.tokens("漢") == ["漢"] and toxicity.tokens("") == [] == toxicity.tokens("1 2\u3000!")
    assert len(toxicity.tokens("字" * 5000)) == 4999


def test_toxic_passages_late_in_unparted_texts(spark):
    r = random.Random(9)
    plain = [chr(0x4E00 + i) for i in range(300)]
    rows = []
    for i in range(300):
        t = "".join(r.choice(plain) for _ in range(200))
        rows.append((i, t + ("鬼畜野郎死" if i % 4 == 0 else "") + "".join(r.choice(plain) for _ in range(20)), int(i % 4 == 0)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity.scored(docs, labels).collect()}
    assert got == {i: y for i, _, y in rows}


def test_log_odds_and_lambda(spark):
    import math

    counts = [("a", 30, 2), ("b", 5, 500), ("c", 3, 0), ("d", 1, 1)]
    got = {r.token: r for r in toxicity._rated(spark.createDataFrame(counts, "token string, t long, c long")).collect()}
    nt, nc = sum(t for _, t, _ in counts), sum(c for *_, c in counts)
    for w, t, c in counts:
        prior = (t + c) * toxicity.PRIOR / (nt + nc)
        odds = math.log((t + prior) / (nt + toxicity.PRIOR - t - prior)) - math.log((c + prior) / (nc + toxicity.PRIOR - c - prior))
        ratio = 2 * sum(x * math.log(x / ((t + c) * s)) for x, s in ((t, nt / (nt + nc)), (c, nc / (nt + nc))) if x)
        assert abs(got[w].odds - odds) < 1e-9 and abs(got[w].z - math.sqrt(max(0, ratio))) < 1e-9
    histogram = [(-1.0, 80.0), (2.0, 15.0), (3.0, 5.0)]
    x = toxicity.karlin(histogram)
    assert abs(sum(n / 100 * math.exp(x * s) for s, n in histogram) - 1) < 1e-6 and x > 0
    assert toxicity._rated(spark.createDataFrame([("a", 0, 2)], "token string, t long, c long")).count() == 0


def test_threshold_has_the_fewest_errors(spark):
    rows = [(i, float(i % 7) / 2 - 1, int(i % 7 > 3 and i % 3 > 0)) for i in range(70)]
    got = spark.createDataFrame([r[:2] for r in rows], "doc_id long, evidence double")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    line = toxicity.threshold(got, labels)
    train = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5]
    wrong = lambda x: sum((e >= x) != bool(y) for _, e, y in train)
    assert wrong(line) == min(wrong(x / 8) for x in range(-20, 40))
    assert toxicity.threshold(got.limit(0), labels) == 1e6
    assert toxicity.scored(spark.createDataFrame([], "doc_id long, text string"), labels).count() == 0


def test_all_maximal_segments():
    """Every segment's proper prefixes and suffixes are positive, and none can be made longer so."""
    r = random.Random(16)
    for _ in range(150):
        s = np.array([r.choice([-1.0, -2.0, 3.0, 0.5]) for _ in range(r.randint(1, 18))])
        n, upto = len(s), np.concatenate(([0.0], np.cumsum(s)))
        whole = {(i, j) for i in range(n) for j in range(i + 1, n + 1) if all(upto[i] < upto[k] for k in range(i + 1, j + 1)) and all(upto[k] < upto[j] for k in range(i, j))}
        want = {x for x in whole if not any(y != x and y[0] <= x[0] and x[1] <= y[1] for y in whole)}
        assert {(a, b) for a, b, _ in toxicity.segments(np.flatnonzero(s > 0), s)} == want


def test_sketches_recover_the_difference():
    r = np.random.default_rng(3)
    for n in (0, 1, 5, 60, 400):
        shared, a, b = (r.integers(1, 1 << 63, m).astype(np.uint64) for m in (200, n, n // 2))
        only_a, only_b = fingerprint.difference(np.concatenate([shared, a]), np.concatenate([shared, b]))
        assert sorted(only_a) == sorted(a) and sorted(only_b) == sorted(b)


def test_fingerprints_and_followers(spark):
    texts = [f"Clause {i}, and part {i % 7}. Also {i}é; end." * (1 + i % 3) for i in range(60)]
    rows = [(3 * i, t, 5) for i, t in enumerate(texts)] + [(None, None, 5), (6, "", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, range int").repartition(5)
    order = [(k, t or "") for k, t, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))]
    for size in (500, 10):
        fingerprint.ROWS_IN_RANGE = size
        got = sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint) for r in fingerprint.compared(docs).collect()), key=str)
        want = []
        for i, (k, t) in enumerate(order):
            new = fingerprint.edited(t, order[(i + 1) % len(order)][1])
            want.append((k, len(t), hashlib.sha256(new.encode()).hexdigest(), fingerprint.fingerprint(t)))
        assert got == sorted(want, key=str)
    fingerprint.ROWS_IN_RANGE = 500
    assert fingerprint.compared(docs.limit(0)).count() == 0


def test_license_rules(spark):
    rows = [(1, "Intro.\nLicensed under the  Apache License, Version 2.0.\nmore"), (2, None), (3, ""), (4, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files. filler words here! The software is provided \"AS IS\", without warranty of any kind, express or implied."), (5, "the software is provided as is without warranty of any kind express or implied. " + licenses.SENTENCES["mit-grant"])]
    got = {r.doc_id: (r.known, r.licenses) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("apache-notice", "Apache-2.0"), 2: ("", ""), 3: ("", ""), 4: ("mit-grant as-is", "MIT"), 5: ("as-is mit-grant", "")}


def test_url_rules_and_ranks(spark):
    link = '<a class=x href="{}">y</a>'.format
    rows = [
        (1, "https://Example.NET/en/1?x", None), (2, "http://a.example.net/fr/", None), (3, "http://b.example.com/de/x#y", ""), (4, "http://c.org/fr/1", link("http://friend.io/a") + link("/own")),
        (5, None, "x"), (6, "no url", None), (7, "http://friend.io/", None), (8, "http://spam.io", link("//b.example.com/de/")), (9, "http://xnet/", None), (10, "http://q.example.net", None),
    ]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlgraph.judged(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == ("example.net", "/en/1", "example.net/en/", "allow")
    assert got[2] == ("a.example.net", "/fr/", "net/", "block")
    assert got[3] == ("b.example.com", "/de/x", "example.com/de/", "block")
    assert got[4] == ("c.org", "/fr/1", "org/fr/", "allow")
    assert got[5] == got[6] == ("", "", None, "allow")
    assert got[7][3] == "allow"
    assert got[8] == ("spam.io", "", None, "block")  # it links to a blocked host
    assert got[9][2] is None and got[10][2] is None


def test_shards(docs, spark):
    got = sharding.assign(docs, shards=3, slots=64).collect()
    assert len(got) == docs.count()
    by = Counter()
    for s in range(3):
        rows = [r for r in got if r.shard == s]
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
        by[s] = sum(r["size"] for r in rows)
    assert max(by.values()) < 1.2 * min(by.values())
    want = sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in pairs(docs))
    assert sorted((r["size"], r.text_crc32) for r in got) == want
    assert sharding.assign(docs.limit(0)).count() == 0


def test_maps_hold_every_slot_and_every_version(spark, tmp_path):
    sizes = spark.createDataFrame([(3, 50, 2), (1, 70, 1)], "vslot int, bytes long, rows long")
    first = sharding.balanced_map(sizes, 3, slots=8)
    path = str(tmp_path / "maps")
    for _ in range(2):  # a repeated write replaces
        sharding.write_map(first, path)
    stored = sharding.read_map(spark, path)
    assert sorted(r.vslot for r in stored.collect()) == list(range(8))
    assert sorted(Counter(r.shard for r in stored.collect()).values()) == [2, 3, 3]
    second = sharding.rebalance(stored, sizes, 3)
    sharding.write_map(second, path)
    assert sorted(r.vslot for r in sharding.read_map(spark, path).collect()) == list(range(8))
    assert {r.version for r in sharding.read_map(spark, path).collect()} == {2}
    assert sorted((r.vslot, r.shard) for r in sharding.read_map(spark, path, 1).collect()) == sorted((r.vslot, r.shard) for r in first.collect())


def test_one_id_does_not_fill_a_slot(spark):
    docs = spark.createDataFrame([(None if i % 2 else 7, f"text {i} " + "x" * (i % 50), 5) for i in range(4000)], "doc_id long, text string, shard int")
    got = sharding.assign(docs, slots=256).collect()
    load, places = Counter(), {}
    for r in got:
        load[r.shard] += r["size"]
        places.setdefault(r.shard, []).append(r.slot)
    assert len(load) == 8 and max(load.values()) < 1.02 * min(load.values())
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}


def test_rebalancing_moves_slots_to_the_new_shard_only(spark):
    sizes = spark.createDataFrame([(i, 100 + i, 1) for i in range(200)], "vslot int, bytes long, rows long")
    old = sharding.balanced_map(sizes, 4, slots=200)
    new = {r.vslot: (r.shard, r.version) for r in sharding.rebalance(old, sizes, 4).collect()}
    was = {r.vslot: r.shard for r in old.collect()}
    assert all(s in (was[v], 4) and n == 2 for v, (s, n) in new.items())
    load = Counter()
    for v, (s, _) in new.items():
        load[s] += 100 + v
    assert max(load.values()) < 1.3 * min(load.values())
