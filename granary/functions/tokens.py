"""Subword vocabularies: encoding, decoding and pieces, by the file's own library. The driver alone reads the file."""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from .udfs import by_pieces

#: Bytes of text, and ids, that go to a library at a time: what it makes of a text is a hundred times as large.
MOST = 1 << 18


class Vocabulary:
    """path: a `.model` of sentencepiece, a `.json` of tokenizers, or a `.tiktoken` table, which needs `pattern`, the
    regex that parts a text into words. A vocabulary is a few MB at most, and goes with each task."""

    def __init__(self, path: str, pattern: str | None = None) -> None:
        with open(path, "rb") as f:
            self.content = f.read()
        self.kind, self.pattern = path.rsplit(".", 1)[-1], pattern
        if self.kind not in ("model", "json", "tiktoken"):
            raise ValueError(f"no library reads a vocabulary in {path}")
        if self.kind == "tiktoken" and not pattern:
            raise ValueError("a .tiktoken table needs the pattern of its words")
        codec = opened(self.kind, self.content, pattern)
        self.size, self.unknown = codec.size, codec.unknown

    def encode(self, t: Column) -> Column:
        """Ids of a text; of null, null."""
        kind, content, pattern = self.kind, self.content, self.pattern

        @F.arrow_udf(ArrayType(IntegerType()))
        def run(s: pa.Array) -> pa.Array:
            codec = opened(kind, content, pattern)
            return by_pieces(s, lambda texts: _encoded(codec, texts), pa.list_(pa.int32()), MOST)

        return run(t)

    def decode(self, ids: Column) -> Column:
        kind, content, pattern = self.kind, self.content, self.pattern

        @F.arrow_udf(StringType())
        def run(s: pa.Array) -> pa.Array:
            codec = opened(kind, content, pattern)
            return by_pieces(s, lambda rows: _decoded(codec, rows), pa.string(), MOST)

        return run(ids)

    def pieces(self, ids: Column) -> Column:
        """What each id stands for; null where it stands for nothing."""
        names = F.lit([opened(self.kind, self.content, self.pattern).piece(i) for i in range(self.size)])
        return F.transform(ids, lambda i: F.get(names, i))


def _encoded(codec: _Codec, texts: pa.Array) -> pa.Array:
    """Lists of ids as one Arrow array; of null, null."""
    found = [np.array(ids, np.int32) for ids in codec.encode(texts.drop_null().to_pylist())]
    sizes = np.zeros(len(texts) + 1, np.int32)
    sizes[1:][texts.is_valid().to_numpy(zero_copy_only=False)] = [len(ids) for ids in found]
    return pa.ListArray.from_arrays(pa.array(np.cumsum(sizes, dtype=np.int32)), pa.array(np.concatenate([np.empty(0, np.int32), *found])), mask=texts.is_null())


def _decoded(codec: _Codec, rows: pa.Array) -> list[str | None]:
    ends = np.cumsum(pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False))
    parts = np.split(rows.flatten().to_numpy(zero_copy_only=False), ends[:-1])
    return [codec.decode(ids.tolist()) if known else None for ids, known in zip(parts, rows.is_valid().to_pylist(), strict=True)]


class _Codec:
    """One interface for three libraries. unknown: the id of what the vocabulary lacks, or -1."""

    def __init__(self, kind: str, content: bytes, pattern: str | None) -> None:
        if kind == "model":
            import sentencepiece

            p = sentencepiece.SentencePieceProcessor(model_proto=content)
            self.encode, self.decode, self.piece = lambda texts: p.encode(texts, num_threads=1), p.decode, p.id_to_piece
            self.size, self.unknown = p.get_piece_size(), p.unk_id()
        elif kind == "json":
            from tokenizers import Tokenizer

            t = Tokenizer.from_str(content.decode())
            t.encode_special_tokens = True
            self.encode = lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
            self.decode, self.piece = lambda ids: t.decode(ids, skip_special_tokens=False), t.id_to_token
            self.size, self.unknown = t.get_vocab_size(), getattr(t.model, "unk_token", None) and t.token_to_id(t.model.unk_token)
            self.unknown = -1 if self.unknown is None else self.unknown
        else:
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}
            by_id = {i: p for p, i in ranks.items()}
            t = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            self.encode, self.decode = lambda texts: [t.encode_ordinary(x) for x in texts], t.decode
            self.piece = lambda i: by_id[i].decode("utf-8", "replace") if i in by_id else None
            self.size, self.unknown = max(by_id) + 1, -1


@lru_cache(maxsize=8)
def opened(kind: str, content: bytes, pattern: str | None) -> _Codec:
    """Built once in each worker."""
    return _Codec(kind, content, pattern)
