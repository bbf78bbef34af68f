"""The pipeline on small tables with planted cases, and on odd ones; SQL can't express it."""

import random
import re

import pytest

import corpus_pipeline
from granary.llm import viterbi

KIND = "doc_id long, text string, lang string, source string, n_chars int, evidence string, hits int"


def words(r, n):
    return " ".join(r.choice("abcdefghijklmnopqrst") + r.choice("aeiou") + r.choice("bcdfgklmnprst") + r.choice(["", "en", "ion", "ly"]) for _ in range(n))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r = random.Random(12)
    folder = tmp_path_factory.mktemp("tables")
    item = words(r, 30)
    rows, labels = [], []
    for i in range(300):
        toxic = i % 4 == 0
        rows.append((i, words(r, 60) + (" vilescum filthyfool rottenpest " if toxic else " ") + words(r, 20)))
        labels.append((i, 1, int(toxic)))
    clean = [x for x in rows if x[0] % 4]
    near = clean[5][1].split()
    near[40] = "changed"
    rows += [(1000, clean[3][1]), (1001, " ".join(near)), (1002, words(r, 20) + " " + item + " " + words(r, 10)), (1003, f"{words(r, 30)} write to jo.doe@mail.example.com or +1 (555) 010-9999, {words(r, 9)}")]
    rows += [(1004, words(r, 40) + " vilescum filthyfool rottenpest " + words(r, 10)), (1005, ""), (1006, None), (None, words(r, 50)), (None, words(r, 45)), (1007, item.upper().replace(" ", ", ") + " " + words(r, 900))]
    spark.createDataFrame([(k, t, "en", "s", len(t or ""), "mine", 7) for k, t in rows], KIND).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (None, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), rows


def test_planted_cases(spark, tables):
    folder, rows = tables
    got = {}
    for r in corpus_pipeline.run(spark, folder).collect():
        got.setdefault(r.doc_id, []).append(r)
    kept = {k for k, _ in rows if k is not None and (k < 1000 and k % 4 or k in (1003, 1005, 1006, 1007))}
    assert set(got) == kept | {None} and len(got[None]) == 2  # toxic, copied, near-copied and contaminated ones are gone
    assert all(len(v) == 1 for k, v in got.items() if k is not None) and all(r.round_trip for v in got.values() for r in v)
    coder = viterbi.Encoder(viterbi.load())
    masked = coder.decode(got[1003][0].ids)
    assert "<email>" in masked and "<phone>" in masked and not re.search("jo.doe|9999", masked)
    texts = dict(rows)
    for k in kept - {1003}:
        assert coder.decode(got[k][0].ids) == (texts[k] or "")


def test_stages_keep_the_columns(spark, tables):
    folder, _ = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, folder)
        assert after.dtypes == docs.dtypes, name
        assert stage(spark, docs.limit(0), folder).count() == 0, name
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "personal_data", "encoding"]
    assert corpus_pipeline.encode(spark, docs.limit(0), folder).count() == 0


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([(1, "one text", "en", "s", 8, "", 0), (2, None, None, None, None, None, None)], KIND).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert sorted((r.doc_id, r.n_ids > 0) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == [(1, True), (2, False)]
