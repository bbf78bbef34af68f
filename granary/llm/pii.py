"""Personal data by patterns and a skip-chain conditional random field.

Patterns give the base spans. A conditional random field over the document's candidate tokens adds spans: each
token has a potential by its shape and by its neighbour in the chain, and skip edges join distant tokens that are
equal or alike (the same digits, the same mail name), so that loopy message passing pulls their labels together.
Potentials of shapes and of both kinds of edges are counted over the base labels of all documents.

A token that no pattern confirms leans to no label, the more so the more often patterns confirm tokens of its shape:
then it has failed a check. It gets a kind only where skip edges lead to a confirmed token of that kind, and the
field believes in it; tokens without such a one never confirm each other.

All searches are linear in a text's length, also in long runs of digits, letters or marks: patterns start where such
a run starts, and quantifiers give nothing back that could not match.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

KINDS = ("email", "ip", "card", "phone")
# The patterns of the base spans; an address's local part is what stands before its @.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Candidate tokens of the random field: mail-like words around these marks, and runs of digits with marks between.
AT = re.compile(r"@|\x20?(?:\(at\)|\[at\])\x20?")
HOST = re.compile(r"[A-Za-z0-9.-]++")
NUMBER = re.compile(r"\+?[0-9](?:[ ().-]{0,3}[0-9])++")

ROUNDS = 8
SKIP_PRIOR = (20.0, 1.0)  #: pseudo-counts of skip edges with equal and with different labels
CHAIN_PRIOR = (5.0, 4.0)  #: the same of neighbours
MARGIN = 0.9  #: belief from which a label adds a span
MISSED = 0.5  #: odds of a kind for a token of a shape that patterns never confirm, before edges count
CLEAR = -12.0  #: log-potential of what is ruled out
LEAST_DIGITS = 8  #: digits by which numbers are alike


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local part, @, domain: a local part begins after what stands before it can't be one."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        free = at + 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            free = m.end()
        at = text.find("@", free)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end), by kind and start."""
    out = [(0, a, b) for a, b in emails(text)]
    if "." in text:
        for m in IP.finditer(text):
            if all(len(x := part.lstrip("0")) <= 3 and int(x or 0) <= 255 for part in m[0].split(".")):
                out.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = re.sub("[^0-9]", "", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum(c.isascii() and c.isdigit() for c in m[0]) <= 15:
                out.append((3, m.start(), m.end()))
    return out


def shape(token: str) -> str:
    """What a token looks like: a mail and how its @ is written, or a number: a plus in front, how many digits, dots and
    other marks, up to 24, 4 and 5: fewer than 2,000 shapes."""
    if m := AT.search(token):
        return "mail" + m[0].strip()
    digits = sum(c.isdigit() for c in token)
    dots = token.count(".")
    return f"{'+' if token[0] == '+' else ''}{min(digits, 24)}.{min(dots, 4)}-{min(len(token) - digits - dots, 5)}"


def likeness(token: str) -> list[str]:
    """Keys under which tokens of a document are alike: a mail's name and host, or its name; a number's digits, if it has
    LEAST_DIGITS, and the last ten of them."""
    if AT.search(token):
        name, _, host = AT.sub("@", token, count=1).lower().partition("@")
        return [f"m{name}@{host}", f"n{name}"]
    digits = re.sub("[^0-9]", "", token)
    return [f"d{digits}"] * (len(digits) >= LEAST_DIGITS) + [f"t{digits[-10:]}"] * (len(digits) >= 10)


def _tokens(text: str) -> list[tuple[int, int]]:
    out, free = [], 0
    for m in AT.finditer(text):
        start = m.start()
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        host = HOST.match(text, m.end())
        end = m.end() + len(host[0].rstrip(".-")) if host else m.end()
        free = max(free, m.end())
        if start < m.start() and end > m.end():
            out.append((start, end))
            free = end
    mails, j = len(out), 0
    for m in NUMBER.finditer(text):
        while j < mails and out[j][1] <= m.start():
            j += 1
        if j == mails or out[j][0] >= m.end():
            out.append(m.span())
    return sorted(out)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, label) of the field's tokens; label: 1 + the kind of the base span it shares places with, or 0."""
    spans = sorted((a, b, k + 1) for k, a, b in base)
    out, j = [], 0
    for start, end in _tokens(text):
        while j < len(spans) and spans[j][1] <= start:
            j += 1
        out.append((start, end, spans[j][2] if j < len(spans) and spans[j][0] < end else 0))
    return out


def skip_edges(text: str, tokens: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Each token and the next one that is like it, for each key of likeness, so that equal tokens are joined twice: linear
    in number."""
    last: dict[str, int] = {}
    out = []
    for i, (a, b, _) in enumerate(tokens):
        for key in likeness(text[a:b]):
            if key in last:
                out.append((last[key], i))
            last[key] = i
    return out


def supported(tokens: list[tuple[int, int, int]], skips: list[tuple[int, int]]) -> list[set[int]]:
    """Labels of the confirmed tokens that skip edges lead to, for each token."""
    root = list(range(len(tokens)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for i, j in skips:
        root[find(i)] = find(j)
    labels: dict[int, set[int]] = defaultdict(set)
    for i, t in enumerate(tokens):
        if t[2]:
            labels[find(i)].add(t[2])
    return [labels[find(i)] for i in range(len(tokens))]


class Model:
    """What the corpus shows: `shapes` has the share of each label among a shape's tokens (none, then the kinds); `skip` and
    `chain` are log-potentials of equal labels on skip edges and of neighbours."""

    def __init__(self, shapes: dict[str, list[float]], skip: float, chain: float) -> None:
        self.shapes, self.skip, self.chain = shapes, skip, chain

    def open(self, token: str) -> list[float]:
        """Log-potentials of the labels of a token that no pattern confirms."""
        form = shape(token)
        seen = self.shapes.get(form, [0.0] * (1 + len(KINDS)))
        digits = sum(c.isdigit() for c in token)
        fits = ["email"] if form.startswith("mail") else [k for k, a, b in (("ip", 4, 12), ("card", 16, 19), ("phone", 8, 15)) if a <= digits <= b and (k != "ip" or token.count(".") == 3)]
        return [0.0, *(math.log(MISSED * max(1 - seen[1 + i], 0.01)) if k in fits else CLEAR for i, k in enumerate(KINDS))]


def field(unary: np.ndarray, skips: list[tuple[int, int]], skip: float, chain: float, rounds: int = ROUNDS) -> np.ndarray:
    """Beliefs of all tokens by loopy sum-product over chain and skip edges; exact where these make no loop."""
    n, k = unary.shape
    a = np.array([i for i, _ in skips] + list(range(n - 1)), int)
    b = np.array([j for _, j in skips] + list(range(1, n)), int)
    same = np.exp(np.array([skip] * len(skips) + [chain] * (n - 1)))[:, None]
    src, dst, same = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([same, same])
    back = np.concatenate([np.arange(len(a), 2 * len(a)), np.arange(len(a))])
    log = np.zeros((len(src), k))
    for _ in range(rounds if len(src) else 0):
        into = unary.copy()
        np.add.at(into, dst, log)
        out = into[src] - log[back]
        out = np.exp(out - out.max(axis=1, keepdims=True))
        new = np.log(out.sum(axis=1, keepdims=True) + (same - 1) * out)
        log = 0.5 * log + 0.5 * (new - new.max(axis=1, keepdims=True))
    into = unary.copy()
    np.add.at(into, dst, log)
    p = np.exp(into - into.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def added_spans(text: str, base: list[tuple[int, int, int]], model: Model) -> list[tuple[int, int, int]]:
    """Spans that the field finds beside the base ones: of tokens that skip edges join to a confirmed one of the kind."""
    tokens = candidates(text, base)
    skips = skip_edges(text, tokens)
    support = supported(tokens, skips)
    if all(t[2] or not s for t, s in zip(tokens, support, strict=True)):
        return []  # no label has a token to go to
    unary = np.full((len(tokens), 1 + len(KINDS)), CLEAR)
    for i, (a, b, label) in enumerate(tokens):
        if label:
            unary[i, label] = 0.0
        else:
            unary[i] = model.open(text[a:b])
    beliefs = field(unary, skips, model.skip, model.chain)
    best = beliefs.argmax(axis=1)
    return [(int(k) - 1, a, b) for k, p, s, (a, b, label) in zip(best, beliefs.max(axis=1), support, tokens, strict=True) if not label and k in s and p >= MARGIN]


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of shapes by label, and of edges: `skip` between confirmed tokens (what patterns leave open between alike
    tokens is for the field to tell), 1 where labels are equal; `chain` between neighbours of which one is confirmed, by
    both labels."""
    for batch in batches:
        counts: dict[tuple[str, int], int] = defaultdict(int)
        for text in batch.column("text").to_pylist():
            if not text:
                continue
            tokens = candidates(text, base_spans(text))
            for a, b, label in tokens:
                counts[shape(text[a:b]), label] += 1
            if any(t[2] for t in tokens):
                for i, j in skip_edges(text, tokens):
                    if tokens[i][2] and tokens[j][2]:
                        counts["skip", int(tokens[i][2] == tokens[j][2])] += 1
                for (_, _, x), (_, _, y) in pairwise(tokens):
                    if x or y:
                        counts["chain", x * (1 + len(KINDS)) + y] += 1
        yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in counts], pa.string()), pa.array([k for _, k in counts], pa.int32()), pa.array(list(counts.values()), pa.int64())], ["shape", "label", "n"])


def train(docs: DataFrame) -> Model:
    """Potentials from the base labels of all documents; fewer than 10,000 counts come to the driver.

    A skip edge's weight is the log-odds of equal labels at its ends. A chain edge's is how much these odds exceed those of
    labels that are drawn apart from each other, so it may be below 0.
    """
    kinds = 1 + len(KINDS)
    counts = docs.select("text").mapInArrow(_statistics, "shape string, label int, n long").groupBy("shape", "label").agg(F.sum("n").alias("n"))
    by: dict[str, list[int]] = defaultdict(lambda: [0] * kinds**2)
    for r in counts.collect():
        by[r["shape"]][r["label"]] = r["n"]
    differ, same = by.pop("skip", [0, 0])[:2]
    odds = lambda same, differ, prior: math.log((same + prior[0]) / (differ + prior[1]))
    pairs = np.array(by.pop("chain", [0] * kinds**2), float).reshape(kinds, kinds)
    apart = np.outer(pairs.sum(axis=1), pairs.sum(axis=0)) / max(1.0, pairs.sum())
    chain = odds(np.trace(pairs), pairs.sum() - np.trace(pairs), CHAIN_PRIOR) - odds(np.trace(apart), apart.sum() - np.trace(apart), CHAIN_PRIOR)
    share = lambda c: [n / sum(c[:kinds]) for n in c[:kinds]]
    return Model({s: share(c) for s, c in by.items()}, min(4.0, max(0.0, odds(same, differ, SKIP_PRIOR))), min(4.0, max(-4.0, chain)))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def _finder(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                base = base_spans(text or "")
                more = added_spans(text or "", base, model)
                n = [sum(k == i for k, _, _ in base) for i in range(len(KINDS))]
                rows.append((*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more), len(base) + len(more)))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_spans"])

    return run


def found(docs: DataFrame) -> DataFrame:
    """The contract's columns for every row of docs (doc_id, text): counts and digest of base spans, all spans,
    and their number.

    Null and empty texts have no spans: zeros, the digest of the empty string, ''. Spans of different kinds may
    overlap. Repeated rows stay; an empty table gives no rows; further columns are ignored.
    """
    model = train(docs)
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(_finder(model), f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")


def masked(docs: DataFrame) -> DataFrame:
    """docs with every span replaced by `<kind>` in text and n_chars, where that column exists, counted anew.

    Of spans that overlap the first, and of those the longest, is replaced, and what sticks out of it goes too. Null
    texts stay null; repeated rows and further columns stay as they are; an empty table stays empty.
    """
    model = train(docs)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                if text:
                    base = base_spans(text)
                    parts, upto = [], 0
                    for k, a, b in sorted(base + added_spans(text, base, model), key=lambda s: (s[1], -s[2])):
                        if a >= upto:
                            parts += [text[upto:a], f"<{KINDS[k]}>"]
                        upto = max(upto, b)
                    text = "".join([*parts, text[upto:]])
                out.append(text)
            i = batch.schema.get_field_index("text")
            batch = batch.set_column(i, batch.schema.field(i), pa.array(out, batch.schema.field(i).type))
            yield batch

    got = docs.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in docs.dtypes))
    return got.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in names else got


def op1_skip_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(table(spark, sf_dir, "documents"))
