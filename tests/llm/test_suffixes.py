"""Suffix order and factors against plain comparison."""

import random

import numpy as np

from granary.llm.suffixes import SuffixOrder, nearest_smaller


def test_nearest_smaller():
    r = random.Random(1)
    for n in (0, 1, 2, 7, 50):
        for x in ([*range(n)], [*range(n)][::-1], r.sample(range(n), n)):
            want = [max((j for j in range(i) if x[j] < x[i]), default=-1) for i in range(n)]
            assert nearest_smaller(np.array(x, int)).tolist() == want


def test_order_and_factors():
    r = random.Random(2)
    for length in (1, 2, 3, 8, 13, 40):
        for _ in range(20):
            strings = [bytes(r.choices(b"ab", k=r.randint(length, length + 25))) for _ in range(r.randint(1, 5))]
            block, at, end = b"", [], []
            for s in strings:
                at += [len(block) + i for i in range(len(s) - length + 1)]
                block += s
                end += [len(block)] * (len(s) - length + 1)
            order = SuffixOrder(np.frombuffer(block, np.uint8), np.array(at), np.array(end), length)
            assert [block[at[i] : at[i] + length] for i in order.order] == sorted(block[a : a + length] for a in at)
            common = lambda i, j: next((k for k in range(min(end[i] - at[i], end[j] - at[j])) if block[at[i] + k] != block[at[j] + k]), min(end[i] - at[i], end[j] - at[j]))  # noqa: B023, E731
            for got, others in zip(order.factors(), (lambda i: range(i), lambda i: range(i + 1, len(at))), strict=True):
                assert [min(length, int(x)) for x in got] == [min(length, max((common(i, j) for j in others(i)), default=0)) for i in range(len(at))]
