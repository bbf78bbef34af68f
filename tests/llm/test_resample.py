"""Importance resampling against a plain version, and on odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from granary.llm import resample

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(resample.WORD)


def plain(rows, target, seed=2024, percent=10, least=20):
    words = [[zlib.crc32(w.encode()) % 10_000 for w in WORD.findall((t or "").translate(LOWER))] for _, t in rows]
    aim = Counter(zlib.crc32(w.encode()) % 10_000 for t in target for w in WORD.findall((t or "").translate(LOWER)))
    have = Counter(b for w in words for b in w)
    over, under = sum(have.values()) + 10_000, sum(aim.values()) + 10_000
    gain = {b: math.floor(1000 * math.log((aim[b] + 1) * over / ((have[b] + 1) * under))) for b in have}
    out = []
    for (k, _), w in zip(rows, words, strict=True):
        weight = sum(gain[b] for b in w) // len(w) if w else 0
        h = int(hashlib.sha256(f"{seed}:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        out.append((k, len(w), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    order = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranked = order[: len(order) * percent // 100]
    return out, ranked


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    vocab = [f"Wört{i}" if i % 7 == 0 else f"w{i}" for i in range(300)]
    texts = [" ".join(r.choices(vocab, k=r.randint(0, 90))) for _ in range(400)]
    return [*enumerate(texts), (3, texts[3]), (3, "other " * 30), (None, texts[4]), (500, None), (501, ""), (502, " .,! "), (503, "İ ÄÖ x\x7fy " * 40), (504, "long " * 200_000)]


@pytest.mark.parametrize(("percent", "range_rows"), [(10, 7), (50, 100_000), (100, 40)])
def test_draw(spark, rows, percent, range_rows, monkeypatch):
    monkeypatch.setattr(resample, "SLICE", 64)
    target = [" ".join(f"w{i}" for i in range(0, 300, 3)), None, ""]
    docs = spark.createDataFrame([(k, t, "clash", 1) for k, t in rows], "doc_id long, text string, rank string, run int").repartition(5)
    aim = spark.createDataFrame([(t, 1) for t in target], "text string, score int")
    got = [tuple(r) for r in resample.resampled(docs, aim, percent=percent, range_rows=range_rows).collect()]
    every, ranked = plain(rows, target, percent=percent)
    assert sorted((g[:4] for g in got), key=str) == sorted(every, key=str)
    drawn = sorted((g for g in got if g[4] is not None), key=lambda g: g[4])
    assert [g[4] for g in drawn] == list(range(1, len(ranked) + 1))
    assert [g[:4] for g in drawn] == ranked


def test_nothing_to_draw(spark, rows):
    docs = spark.createDataFrame(rows[:30], "doc_id long, text string")
    assert resample.resampled(docs.limit(0), docs.select("text")).count() == 0
    few = resample.resampled(docs.limit(5), docs.select("text").limit(0), percent=10)
    assert [r["rank"] for r in few.collect()] == [None] * 5


def test_tournament_of_any_number_of_runs():
    r = random.Random(2)
    for k in range(9):
        runs = [sorted((r.randint(0, 20),) for _ in range(r.randint(0, 12))) for _ in range(k + 1)]
        got = list(resample.Tournament([iter(x) for x in runs]))
        assert got == sorted((key, i) for i, x in enumerate(runs) for key in x)
