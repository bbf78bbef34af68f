"""Whole tables against brute force, where the tables are there."""

import hashlib
import os
from collections import Counter

import numpy as np
import pytest

from granary.llm import substrings

TABLES = os.environ.get("GRANARY_TABLES", "/root/testdata/sf0.01")
pytestmark = pytest.mark.skipif(not os.path.exists(f"{TABLES}/documents.parquet"), reason="no tables")


def test_repeated_strings_of_all_documents(spark):
    rows = [(r.doc_id, (r.text or "").encode()) for r in spark.read.parquet(f"{TABLES}/documents.parquet").collect()]
    n = substrings.LENGTH
    seen = Counter(hash(b[i : i + n]) for _, b in rows for i in range(len(b) - n + 1))
    want = {}
    for k, b in rows:
        steps = np.zeros(len(b) + 1, int)
        for i in range(len(b) - n + 1):
            if seen[hash(b[i : i + n])] > 1:
                steps[i] += 1
                steps[i + n] -= 1
        gone = np.cumsum(steps)[:-1] > 0
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        want[k] = (len(b), int(gone.sum()), int(np.count_nonzero(np.diff(np.concatenate(([0], gone.astype(int)))) == 1)), hashlib.sha256(kept).hexdigest())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.op2_repeated_substrings(spark, TABLES).collect()}
    assert got == want and sum(w[1] > 0 for w in want.values()) > 100
