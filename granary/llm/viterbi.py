"""SentencePiece encoding and decoding by streaming Viterbi.

A segmentation is searched character by character; at each position one backpointer survives, the last piece of what
comes before. Only the last `longest piece` positions and the backpointers that still differ are kept: whenever all
surviving paths run through one boundary, the ids before it are committed and forgotten.

Which backpointer survives depends on the model. A unigram model adds scores, and the largest total wins. Scores of a
BPE model are ranks of merges and can't be added; there the piece survives that BPE would leave last: one that merges
make by themselves, and that stays apart from the piece before it. Whether two pieces stay apart is told by the merges
of these two alone, since no merge reaches over a boundary that its two pieces keep.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
NEVER = -1e300
CACHE = 400_000  #: words whose ids a worker remembers, and pairs of symbols


class Pieces:
    """Pieces with their scores, read from a model file; small enough to go with a task."""

    def __init__(self, pieces: dict[str, tuple[int, float]], byte_ids: list[int], texts: list[bytes], merges: bool = False) -> None:
        self.pieces, self.byte_ids, self.texts = pieces, byte_ids, texts
        self.longest = max(map(len, pieces))
        self.prefixes: dict[str, tuple[int, float]] = {p[:k]: (-1, 0.0) for p in pieces for k in range(1, len(p))} | pieces  #: -1: no piece itself
        self.starts_only = all(SPACE not in p.lstrip(SPACE) for p in pieces)
        worst = min(s for _, s in pieces.values())
        self.byte_score = worst - 10.0  #: of each byte of a character that no piece covers
        self.merges = Merges(pieces) if merges else None  #: of a BPE model


class Merges:
    """What BPE makes of characters. Symbols are the characters of all pieces and the pieces that merges make by
    themselves; each of these has two halves, those of its last merge."""

    def __init__(self, pieces: dict[str, tuple[int, float]]) -> None:
        longer = sorted((p for p in pieces if len(p) > 1), key=lambda p: -pieces[p][1])
        self.turn = {p: k for k, p in enumerate(longer)}  #: when a piece's merge has its turn
        self.names = sorted({c for p in pieces for c in p})
        self.turns, self.left, self.right = [-1] * len(self.names), [-1] * len(self.names), [-1] * len(self.names)
        symbol = {c: k for k, c in enumerate(self.names)}
        for p in longer:
            held, last = self.merged(p)
            if held == [p] and last[0] in symbol and last[1] in symbol:
                symbol[p] = len(self.names)
                self.names.append(p)
                self.turns.append(self.turn[p])
                self.left.append(symbol[last[0]])
                self.right.append(symbol[last[1]])
        self.ids = [pieces[p][0] if p in pieces else None for p in self.names]  #: None: a character that is no piece
        self.ends: dict[str, int] = {p[-k:]: -1 for p in symbol for k in range(1, len(p))} | symbol  #: ends of symbols; -1: no symbol itself
        self.known: dict[int, bool] = {}

    def merged(self, chars: str) -> tuple[list[str], tuple[str, str]]:
        """What is left of a short string, and the halves of the last merge: of all neighbours that make a piece the one
        whose turn is first is merged, the left one of equals, until none does."""
        held, last, turn = list(chars), ("", ""), self.turn
        while True:
            best = min(((k, i) for i in range(len(held) - 1) if (k := turn.get(held[i] + held[i + 1])) is not None), default=None)
            if best is None:
                return held, last
            i = best[1]
            last = (held[i], held[i + 1])
            held[i : i + 2] = [held[i] + held[i + 1]]

    def apart(self, a: int, b: int) -> bool:
        """Whether two neighbouring symbols stay as they are.

        Their merges are taken back, the later one first; what then stands on both sides of the boundary must not make
        a piece whose turn comes before the merge that was taken back. Of equal turns the left one is first.
        """
        key = a << 20 | b
        got = self.known.get(key)
        if got is None:
            if len(self.known) >= CACHE:
                self.known.clear()
            names, turns, turn, limit = self.names, self.turns, self.turn, float("inf")
            got = True
            while (across := turn.get(names[a] + names[b])) is None or across >= limit:
                if turns[a] > turns[b]:
                    limit, a = turns[a], self.right[a]
                elif turns[b] >= 0:
                    limit, b = turns[b] + 0.5, self.left[b]
                else:
                    break
            else:
                got = False
            self.known[key] = got
        return got

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}}


def load(path: str = MODEL) -> Pieces:
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, byte_ids, texts = {}, [0] * 256, []
    for i in range(sp.get_piece_size()):
        p = sp.id_to_piece(i)
        if sp.is_byte(i):
            byte_ids[int(p[1:-1], 16)] = i
            texts.append(bytes([int(p[1:-1], 16)]))
        elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
            texts.append(b"")
        else:
            pieces[p] = (i, sp.get_score(i))
            texts.append(p.replace(SPACE, " ").encode())
    spec = sentencepiece_model_pb2.ModelProto.FromString(sp.serialized_model_proto()).trainer_spec
    return Pieces(pieces, byte_ids, texts, spec.model_type == spec.BPE)


def stream(chars: str, model: Pieces) -> Iterator[list[int]]:
    """Ids of chars, committed block by block; memory is bounded by the longest stretch on which paths differ.

    Paths are traced back when the window has doubled since the last time, so that the time is linear.
    """
    search = searching(model)
    search.begin(chars)
    base, n, least = 0, len(chars), 2 * model.longest
    look = least
    while base < n:
        end = min(n, base + look)
        search.grow(end)
        back, heads = search.back, {end} if end == n else search.heads(end)
        while len(heads) > 1:  # the surviving paths, back to where they meet
            late = max(heads)
            heads.discard(late)
            heads.add(back[late - base][0])
        (meet,) = heads
        if meet > base:
            yield search.ids(meet)
            search.forget(meet)
            base, look = meet, least
        else:
            look *= 2


def searching(model: Pieces) -> _Search:
    return _ByMerges(model) if model.merges else _ByScores(model)


class _Search:
    """back: start and what is known of the last piece by position, from `base` on; `at` is the last one searched."""

    def __init__(self, model: Pieces) -> None:
        self.model = model

    def begin(self, chars: str) -> None:
        self.chars, self.base, self.at = chars, 0, 0
        self.back: list[tuple[int, int | None]] = [(0, None)]

    def forget(self, upto: int) -> None:
        del self.back[: upto - self.base]
        self.base = upto

    def ids(self, upto: int) -> list[int]:
        """Of the path to a position, from `base` on."""
        out: list[int] = []
        back, base, id_of = self.back, self.base, self.id_of
        while upto > base:
            start, piece = back[upto - base]
            got = piece if piece is None or id_of is None else id_of[piece]
            if got is None:
                out += [self.model.byte_ids[b] for b in reversed(self.chars[start:upto].encode())]
            else:
                out.append(got)
            upto = start
        out.reverse()
        return out


class _ByScores(_Search):
    """Unigram: of equal totals the path whose last piece is longer wins."""

    id_of = None  #: pieces are known by their ids

    def begin(self, chars: str) -> None:
        super().begin(chars)
        self.total = [0.0]

    def forget(self, upto: int) -> None:
        del self.total[: upto - self.base]
        super().forget(upto)

    def heads(self, end: int) -> set[int]:
        return {end} | {k for k in range(end + 1, self.base + len(self.total)) if self.total[k - self.base] != NEVER}

    def grow(self, end: int) -> None:
        chars, prefixes, base, total, back = self.chars, self.model.prefixes, self.base, self.total, self.back
        n = len(chars)
        for start in range(self.at, end):  # every path to start is known now
            here, upto = total[start - base], start + 1
            while upto <= n:
                hit = prefixes.get(chars[start:upto])
                if hit is None:
                    break
                at = upto - base
                if at == len(total):
                    total.append(NEVER)
                    back.append((upto - 1, None))
                if hit[0] >= 0 and here + hit[1] > total[at]:
                    total[at], back[at] = here + hit[1], (start, hit[0])
                upto += 1
            at = start + 1 - base
            if at == len(total):
                total.append(NEVER)
                back.append((start, None))
            if total[at] == NEVER:  # no piece ends here: the character's bytes
                total[at], back[at] = here + self.model.byte_score * len(chars[start].encode()), (start, None)
        self.at = end


class _ByMerges(_Search):
    """BPE: of the symbols that end at a position the one that merges leave; only one stays apart from the one before it."""

    def __init__(self, model: Pieces) -> None:
        super().__init__(model)
        self.id_of = model.merges.ids

    def heads(self, end: int) -> set[int]:
        return set(range(max(self.base, end - self.model.longest + 1), end + 1))

    def grow(self, end: int) -> None:
        chars, base, back, merges = self.chars, self.base, self.back, self.model.merges
        ends, known, apart, append = merges.ends.get, merges.known.get, merges.apart, self.back.append
        for upto in range(self.at + 1, end + 1):
            start = upto - 1
            while start >= base:
                symbol = ends(chars[start:upto])
                if symbol is None:
                    append((upto - 1, None))  # a character of no piece
                    break
                if symbol >= 0:
                    before = back[start - base][1]
                    if before is None:
                        append((start, symbol))
                        break
                    stay = known(before << 20 | symbol)
                    if stay or stay is None and apart(before, symbol):
                        append((start, symbol))
                        break
                start -= 1
            else:
                append((upto - 1, None))
        self.at = end


#: Marks and the word after them.
MARKED = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class Encoder:
    """Encodes texts; remembers words in two generations, so that frequent ones outlive a full memory."""

    def __init__(self, model: Pieces) -> None:
        self.model = model
        self.kind = "H" if len(model.texts) <= 1 << 16 else "I"  #: of the ids, in an array
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.search = searching(model)
        self.mark = array(self.kind, [model.byte_ids[b] for b in SPACE.encode()]).tobytes()

    def encode(self, text: str) -> list[int]:
        """Ids of a text; the empty text has none. A space is put before the text, and spaces become their mark."""
        return array(self.kind, self.packed(text)).tolist()

    def packed(self, text: str) -> bytes:
        """The same as an array's bytes.

        A mark in the text itself is written as bytes, so that decoding gives back exactly the text. Where no
        piece holds a mark after another character, all paths meet before each run of marks: a word's ids are
        then the same wherever it stands, and are remembered.
        """
        if not text:
            return b""
        first, *rest = text.split(SPACE)
        out = [self._plain(SPACE + first.replace(" ", SPACE))]
        for part in rest:
            out += [self.mark, self._plain(part.replace(" ", SPACE)) if part else b""]
        return b"".join(out)

    def _plain(self, chars: str) -> bytes:
        get, word = self.known.get, self._word
        return b"".join([get(w) or word(w) for w in (MARKED.findall(chars) if self.model.starts_only else [chars])])

    def _word(self, word: str) -> bytes:
        ids = self.known.get(word) or self.older.get(word)
        if ids is None:
            if len(word) <= 2 * self.model.longest:  # one block: stream() would do just this
                self.search.begin(word)
                self.search.grow(len(word))
                ids = array(self.kind, self.search.ids(len(word))).tobytes()
            else:
                ids = array(self.kind, chain.from_iterable(stream(word, self.model))).tobytes()
        if len(word) <= 64:
            if len(self.known) >= CACHE // 2:
                self.older, self.known = self.known, {}
            self.known[word] = ids
        return ids

    def decode(self, ids: list[int]) -> str:
        """The text of ids made by encode()."""
        texts = self.model.texts
        return b"".join([texts[i] for i in ids]).decode()[1:]


def _run(model: Pieces, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(model)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size < 1 << 21):
                    size += len(texts[end] or "")
                    end += 1
                ids, equal = [], []
                for t in texts[at:end]:
                    given = np.frombuffer(coder.packed(t or ""), coder.kind).astype("<i4")
                    equal.append(coder.decode(given.tolist()) == (t or ""))
                    ids.append(given)
                n = pa.array([len(x) for x in ids], pa.int64())
                same = pa.array(equal)
                if digest:
                    last = pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in ids], pa.string())
                else:
                    last = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)]), pa.int32()), pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, end - at), n, same, last], ["doc_id", "n_ids", "round_trip", "ids_sha256" if digest else "ids"])
                at = end

    return run


def encoded(docs: DataFrame, path: str = MODEL, digest: bool = False) -> DataFrame:
    """doc_id, n_ids, round_trip (decoding gives back the text), ids of every row of docs (doc_id, text).

    digest: instead of ids, the SHA-256 of their 32-bit little-endian form, ids_sha256. Null and empty texts have
    no ids and a true round trip. Repeated rows stay; an empty table gives no rows; further columns are ignored.
    Only the driver reads the model file.
    """
    kind = dict(docs.dtypes)["doc_id"]
    last = "ids_sha256 string" if digest else "ids array<int>"
    return docs.select("doc_id", "text").mapInArrow(_run(load(path), digest), f"doc_id {kind}, n_ids long, round_trip boolean, {last}")


def decoded(rows: DataFrame, path: str = MODEL) -> DataFrame:
    """rows (doc_id, ids) with their texts; null ids give a null text."""
    model = load(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(model)
        for batch in batches:
            texts = [None if x is None else coder.decode(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, text string")


def op3_streaming_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"), digest=True)
