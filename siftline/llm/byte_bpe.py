"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A rank file fixes the vocabulary. Its merges are recovered from the ranks: each token
of two or more bytes is the pair that is left when its own bytes are merged by lower
ranks only. Bytes map to printable characters, since the library's models work on
strings; decoding reverses that byte table on the joined tokens, so a character split
over tokens comes back whole.

A text is cut by the pattern first and each distinct piece is encoded once per memo,
because a piece's ids depend on the piece alone.

Defined results: a null or empty text has no ids and decodes to no bytes. Repeated
texts and rows get equal values; extra columns of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import os
import unicodedata
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import bound_batches, map_batches, narrow, slices

#: Distinct pieces kept, and the longest piece kept, so the memo has a bound.
MEMO_PIECES, MEMO_CHARS = 400_000, 64


def byte_table() -> list[str]:
    """A printable character for each byte: itself where printable, else from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def last_pair(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two parts that merges of lower rank leave of a token."""
    own, parts = ranks[token], [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        found = [(r, i) for i in range(len(parts) - 1) if (r := ranks.get(parts[i] + parts[i + 1], own)) < own]
        if not found:
            return None
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return tuple(parts) if len(parts) == 2 else None


class ByteBPE:
    """One vocabulary, ready to encode and decode. Cheap to make again in each worker."""

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer, models

        self.ranks, table = read_ranks(path), byte_table()
        shown = {bytes([b]).decode("latin-1"): c for b, c in enumerate(table)}
        self._shown = str.maketrans(shown)
        merges = [pair for token in sorted(self.ranks, key=self.ranks.get) if len(token) > 1 and (pair := last_pair(token, self.ranks))]
        self.model = Tokenizer(
            models.BPE(
                vocab={self.chars(t): r for t, r in self.ranks.items()},
                merges=[(self.chars(x), self.chars(y)) for x, y in merges],
                ignore_merges=True,  # a piece that is a token is taken as that token
                cache_capacity=0,
            )
        )
        self.unchars = {c: b for b, c in enumerate(table)}
        size = max(self.ranks.values()) + 1
        self.tokens: list[bytes] = [b""] * size
        for i in range(size):
            if (token := self.model.id_to_token(i)) is not None:
                self.tokens[i] = bytes(self.unchars[c] for c in token)
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)
        self.split, self.pattern = regex.compile(pattern).findall, pattern
        self.memo: dict[str, bytes] = {}
        self.assigned: set[str] = set()

    def chars(self, raw: bytes) -> str:
        return raw.decode("latin-1").translate(self._shown)

    def _learn(self, missing: set[str], wanted: set[str]) -> dict[str, bytes]:
        """Ids, as little-endian 32-bit integers, of the wanted pieces; new short ones go to the memo."""
        new = {p: array("I", [t.id for t in self.model.model.tokenize(self.chars(p.encode()))]).tobytes() for p in missing}
        known = {p: self.memo[p] for p in wanted.difference(missing)} | new
        if len(self.memo) > MEMO_PIECES:
            self.memo.clear()
        self.memo |= {p: ids for p, ids in new.items() if len(p) <= MEMO_CHARS}
        return known

    @lru_cache(1)  # noqa: B019  one per worker
    def _other_split(self):
        import tiktoken

        return tiktoken.Encoding("ranks", pat_str=self.pattern, mergeable_ranks=self.ranks, special_tokens={})

    def _unassigned(self, text: str) -> bool:
        """Whether a code point is one that this Python's Unicode tables lack."""
        if new := set(text) - self.assigned:
            self.assigned |= {c for c in new if unicodedata.category(c) != "Cn"}
            return not new <= self.assigned
        return False

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        if self._unassigned(text):  # engines' Unicode tables differ there; the rank library decides
            return np.asarray(self._other_split().encode_ordinary(text), "<u4").tobytes()
        pieces = self.split(text)
        if missing := set(pieces).difference(self.memo):
            return b"".join(map((self._learn(missing, set(pieces))).__getitem__, pieces))
        return b"".join(map(self.memo.__getitem__, pieces))

    def offsets(self, ids: bytes) -> np.ndarray:
        """End of each token in the text's UTF-8 bytes."""
        return np.cumsum(self.lengths[np.frombuffer(ids, "<u4")])

    def decode(self, ids: bytes) -> bytes:
        """Bytes of the tokens, joined before any character is read."""
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def inside_characters(ends: np.ndarray, raw: bytes) -> int:
    """How many tokens end inside a character, whose next byte is a continuation."""
    data = np.frombuffer(raw, np.uint8)
    return int(((data[ends[ends < len(data)]] & 0xC0) == 0x80).sum())


def encode_texts(docs: DataFrame, path: str, pattern: str, text: str = "text", key: str = "doc_id", offsets: bool = True) -> DataFrame:
    """(key, ids array<int>[, ends array<bigint>]): tokens and their end offsets in UTF-8 bytes."""

    def make():
        bpe = ByteBPE(path, pattern)

        def f(key, text):
            raw = [bpe.encode(t or "") for t in text]
            out = {"key": key, "ids": [np.frombuffer(r, "<i4") for r in raw]}
            return out | ({"ends": [bpe.offsets(r) for r in raw]} if offsets else {})

        return f

    rows = narrow(docs, key=key, text=text)
    out = map_batches(rows, make, f"key {dict(rows.dtypes)['key']}, ids array<int>" + ", ends array<bigint>" * offsets)
    return out.withColumnRenamed("key", key)


def decode_ids(tokens: DataFrame, path: str, pattern: str, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """(key, text): UTF-8 text of ids; bytes that are not UTF-8 become U+FFFD."""

    def make():
        bpe = ByteBPE(path, pattern)
        return lambda key, ids: {"key": key, "text": [bpe.decode(np.asarray([] if x is None else x, "<u4").tobytes()).decode("utf-8", "replace") for x in ids]}

    rows = narrow(tokens, key=key, ids=ids)
    return map_batches(rows, make, f"key {dict(rows.dtypes)['key']}, text string", text=None).withColumnRenamed("key", key)


def roundtrip_digest(docs: DataFrame, path: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256, n_split) of every whole text, decoded from its ids;
    n_split counts the tokens that end inside a character, by their offsets."""

    def make():
        bpe = ByteBPE(path, pattern)

        def f(key, text):
            raw = [bpe.encode(t or "") for t in text]
            return {
                "key": key,
                "n_tokens": [len(r) // 4 for r in raw],
                "ids_sha256": [hashlib.sha256(r).hexdigest() for r in raw],
                "decoded_sha256": [hashlib.sha256(bpe.decode(r)).hexdigest() for r in raw],
                "n_split": [inside_characters(bpe.offsets(r), (t or "").encode()) for r, t in zip(raw, text)],
            }

        return f

    rows = narrow(docs, key=key, text=text)
    schema = f"key {dict(rows.dtypes)['key']}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, n_split bigint"
    return map_batches(rows, make, schema).withColumnRenamed("key", key)


def tokenize(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """The input with ``text`` replaced by what its ids decode to, and ``ids array<int>``, ``n_tokens``.

    A null text stays null and has no ids. Any text that Spark holds decodes to itself.
    Columns of the input with the new names are replaced.
    """
    bound_batches(docs.sparkSession)
    names = [n for n in docs.columns if n not in ("ids", "n_tokens")]
    kept = docs.select(names)
    schema = kept.withColumns({"ids": F.array(F.lit(0)), "n_tokens": F.lit(0).cast("long")}).schema

    def run(batches):
        bpe = ByteBPE(path, pattern)
        for whole in batches:
            for batch in slices(whole, names.index(text)):
                texts = batch.column(names.index(text)).to_pylist()
                raw = [b"" if t is None else bpe.encode(t) for t in texts]
                back = [None if t is None else bpe.decode(r).decode("utf-8") for t, r in zip(texts, raw)]
                sizes = np.array([len(r) // 4 for r in raw], np.int64)
                ids = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32), np.frombuffer(b"".join(raw), "<i4"))
                columns = [pa.array(back, type=batch.schema.field(i).type) if n == text else batch.column(i) for i, n in enumerate(names)]
                yield pa.RecordBatch.from_arrays([*columns, ids, pa.array(sizes)], names=[*names, "ids", "n_tokens"])

    return kept.mapInArrow(run, schema)
