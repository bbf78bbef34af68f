import random

import pytest

from granary.llm import viterbi


@pytest.fixture(scope="module")
def bpe():
    return viterbi.load()


@pytest.fixture(scope="module")
def model():
    """The same pieces as a unigram model."""
    m = viterbi.load()
    m.merges = None
    return m


def best(chars, model):
    """Brute force: the largest total over all segmentations, by plain dynamic programming over the whole text."""
    total = [0.0] + [-1e300] * len(chars)
    for end in range(1, len(chars) + 1):
        for a in range(max(0, end - model.longest), end):
            if (hit := model.pieces.get(chars[a:end])) and total[a] + hit[1] > total[end]:
                total[end] = total[a] + hit[1]
        if total[end] == -1e300:
            total[end] = total[end - 1] + model.byte_score * len(chars[end - 1].encode())
    return total[-1]


def score(ids, model):
    by_id = {i: s for i, s in model.pieces.values()}
    return sum(by_id.get(i, model.byte_score) for i in ids)


def test_stream_reaches_the_best_total(model):
    random.seed(3)
    for _ in range(300):
        text = "".join(random.choice(["the", "er", "a", "▁", "é", "☃", "zq", "ing", "\n", "tion", "𝄞"]) for _ in range(random.randint(1, 60)))
        blocks = list(viterbi.stream(text, model))
        assert abs(score([i for b in blocks for i in b], model) - best(text, model)) < 1e-6


def test_long_texts_are_committed_in_blocks(model, bpe):
    for m in (model, bpe):
        assert len(list(viterbi.stream("▁the▁river" * 200, m))) > 20


def test_remembered_words_equal_the_plain_stream(model, bpe):
    for m in (model, bpe):
        coder = viterbi.Encoder(m)
        for text in ("the river ran", "x", " a", "a  b", "ends ", "no\nspace\t", "ñandú the the"):
            assert coder.encode(text) == [i for b in viterbi.stream("▁" + text.replace(" ", "▁"), m) for i in b]


@pytest.mark.parametrize("text", ["", " ", "  two  spaces ", "▁marked▁ ▁", "\n\t\r", "☃𝄞 é", "a" * 5000, "<s> </s> <unk> <0x41>", "\x00"])
def test_round_trip(model, bpe, text):
    for m in (model, bpe):
        coder = viterbi.Encoder(m)
        assert coder.decode(coder.encode(text)) == text


def test_ids_of_random_texts_are_the_models(bpe):
    import sentencepiece

    theirs = sentencepiece.SentencePieceProcessor(model_file=viterbi.MODEL)
    r = random.Random(7)
    pieces = [p for p in bpe.pieces if "▁" not in p]
    coder = viterbi.Encoder(bpe)
    for k in range(3000):
        letters = r.choice(["ab", "aeionrst", "ehlo ", "0123456789", "é☃a ", "aA.,-"]) if k % 2 else r.sample(pieces, 12) + [" "]
        text = "".join(r.choice(letters) for _ in range(r.randint(1, 60)))
        assert coder.encode(text) == theirs.encode(text), text
    for text in ("a" * 3001, "ab" * 2000, "the" * 900, "ing" * 500 + "é" * 300, "=" * 999):
        assert coder.encode(text) == theirs.encode(text)


def test_long_runs_take_linear_time(model, bpe):
    import time

    for m in (model, bpe):
        for c in (" ", "a", "☃", "ab", "="):
            times = []
            for n in (20_000, 80_000):
                start = time.process_time()
                coder = viterbi.Encoder(m)
                text = c * (n // len(c))
                assert coder.decode(coder.encode(text)) == text
                times.append(time.process_time() - start)
            assert times[1] < 10 * times[0] + 0.5 and times[1] < 6, (c, times)


def test_odd_tables(spark):
    rows = [(1, "the  river", 5, "mine"), (1, "the  river", 5, "mine"), (None, None, 1, ""), (2, "", 1, ""), (3, " ▁é☃" * 2000, 1, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_ids int, ids string").repartition(2)
    got = viterbi.encoded(docs).collect()
    assert len(got) == 5 and all(r.round_trip for r in got)
    assert [r.n_ids for r in got if r.doc_id is None or r.doc_id == 2] == [0, 0]
    back = viterbi.decoded(viterbi.encoded(docs)).collect()
    assert sorted(((r.doc_id, r.text) for r in back), key=str) == sorted(((k, t or "") for k, t, *_ in rows), key=str)
    assert [r.text for r in viterbi.decoded(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")).collect()] == [None]
    assert viterbi.encoded(docs.limit(0)).count() == 0
