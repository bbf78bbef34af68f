"""The trie of conversations against a plain version, and on odd rows."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from granary.llm import prefixtrie


def plain(rows):
    """Nodes of rows (conv_id, turn, role, text), by a dictionary of prefixes."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own[c].append((turn is not None, turn or 0, key, role, text))
    turns = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c in turns:
        h, base = zlib.crc32(str(c).encode()) % 9, c - (c % 5 if c >= 0 else -(-c % 5))
        built[c] = tuple(turns.get(base, [])[:h] + turns[c][h:])
    members = defaultdict(list)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    under = {k: [0, (len(v) - 1) * len(k[-1][1].encode()) if k else 0, 0] for k, v in members.items()}
    for k in sorted(members, key=len, reverse=True):
        if not under[k][2]:
            under[k][0] = 1
        if k:
            up = under[k[:-1]]
            up[0], up[1], up[2] = up[0] + under[k][0], up[1] + under[k][1], up[2] + 1
    out = []
    for k, v in members.items():
        ends = ",".join(map(str, sorted(c for c in v if len(built[c]) == len(k))))
        out.append((min(v), len(k), min(members[k[:-1]]) if k else None, len(v), under[k][2], under[k][0], under[k][1], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)
    said = [("user", "hi"), ("assistant", "ho"), ("system", "be kind"), ("user", "ünï"), (None, "x"), ("user", None), ("", ""), ("user", "a" * 300)]
    out = []
    for c in range(-12, 260):
        n = r.choice([0, 1, 2, 3, 5, 8, 12])
        walk = [said[min(int(r.expovariate(1.2)), 7)] for _ in range(n)]
        out += [(c, i if i else None, *t) for i, t in enumerate(walk)]
    for c in range(300, 420, 5):  # copies, and one family that grows by a turn each
        out += [(c, i, *said[i % 4]) for i in range(15)]
    for c in range(500, 560, 5):
        out += [(c, i, "user", f"step {i}") for i in range((c - 500) // 5 + 9)]
    out += [(1000, i, "user", f"turn {i}") for i in range(3000)] + [(1005, i, "user", f"turn {i}") for i in range(2500)]
    out += [(7, 0, "user", "hi"), (7, 0, "user", "hi"), (7, 0, "aa", "hi"), (None, 0, "user", "nobody's"), (None, None, None, None)]
    r.shuffle(out)
    return out


@pytest.mark.parametrize("local_turns", [0, 12, 1000, 100_000])
def test_trie(spark, rows, monkeypatch, local_turns):
    if local_turns == 0:
        rows = [r for r in rows if r[0] is not None and (r[0] < 40 or 330 < r[0] < 400 or r[0] in (500, 505, 510))]  # each level is a round
    monkeypatch.setattr(prefixtrie, "CHUNK", 12)
    talks = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, bucket string, n int").repartition(6)
    got = [tuple(r) for r in prefixtrie.trie(talks, local_turns).collect()]
    assert sorted(got, key=str) == plain(rows)


def test_empty_and_turnless(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert prefixtrie.trie(spark.createDataFrame([], schema)).count() == 0
    rows = [(c, 0, "user", "gone") for c in range(1, 40) if c % 5]  # no first conversation: most end where they begin
    got = [tuple(r) for r in prefixtrie.trie(spark.createDataFrame(rows, schema)).collect()]
    assert sorted(got, key=str) == plain(rows)
    assert any(r[1] == 0 and r[2] is None for r in got)


def test_piles_end_with_a_bucket(spark, rows, monkeypatch):
    import pyarrow as pa

    flat = [(b, c, 1 + k, b * 10 + (k and c % 3), 1, 0) for b in range(9) for c in range(20) for k in range(1 + c % 4)]
    batches = lambda size: [pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*flat[i : i + size], strict=True)], prefixtrie._Pile.NAMES) for i in range(0, len(flat), size)]
    whole = [r for b in prefixtrie._local(iter(batches(len(flat)))) for r in b.to_pylist()]
    monkeypatch.setattr(prefixtrie, "PILE", 30)
    parts = [r for b in prefixtrie._local(iter(batches(7))) for r in b.to_pylist()]
    assert sorted(map(str, parts)) == sorted(map(str, whole))
    assert len(whole) > 50
