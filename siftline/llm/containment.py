"""Benchmark decontamination: size-partitioned MinHash containment with exact verification.

Words are runs of letters and digits, lower-cased; a shingle is five consecutive words,
or the whole sequence of a shorter text. A document holds a test item if at least
``threshold`` of the item's distinct shingles are in the document.

Items are partitioned by their number of shingles (powers of two). An item of q shingles
that needs m = ceil(threshold * q) of them is indexed by the q - m + 1 smallest of its
shingles' hashes, its bottom-k MinHash sketch. At most q - m shingles may be missing, so a
document that holds the item meets its sketch: the search has no false negatives at any
document length, where sampled signatures of long documents would miss short items.
Partitions whose smallest m exceeds a document's shingles are skipped. Each candidate is
verified by its exact containment.

The item side is the stated query set. It is broadcast in blocks of at most
``block_bytes`` of text, one scan of the documents for each block; documents are never
shuffled.

Defined results: null or empty items match nothing, null or empty documents hold
nothing. Repeated items match alike, each under its id; repeated documents are all
reported. By default, as in the SQL, items of fewer than five words match only documents of
the same words. With ``any_length``, which the query and the pipeline set, such an item is
one shingle of its own number of words and is found inside longer documents too, and CJK
characters are words of their own (as in P4), so unspaced passages have shingles.
"""

from __future__ import annotations

import math
import re
from functools import reduce

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.functions.text import CJK
from siftline.llm.common import map_batches, narrow, slices

WIDTH, THRESHOLD, BLOCK_BYTES = 5, 0.8, 8_000_000
WORD = re.compile(r"[^\W_]+")
_SINGLE = "".join(f"{chr(a)}-{chr(b)}" for a, b in CJK)
SINGLE_OR_WORD = re.compile(rf"(?=[^\W_])[{_SINGLE}]|[^\W_{_SINGLE}]+")


def words_of(text: str | None, pattern: re.Pattern = WORD) -> list[str]:
    return pattern.findall((text or "").lower())


def runs(w: list[str], width: int):
    return zip(*(w[i:] for i in range(width)))


def shingles(text: str | None, width: int = WIDTH):
    """All shingles of a text in order, repeats included."""
    return cut(words_of(text), width)


def cut(w: list[str], width: int):
    if len(w) < width:
        return iter([tuple(w)] if w else [])
    return runs(w, width)


class Index:
    """The sketches of a block of items by size partition, and their full shingle sets."""

    def __init__(self, items: list[tuple[object, str]], width: int = WIDTH, threshold: float = THRESHOLD, any_length: bool = False):
        self.width, self.threshold, self.pattern = width, threshold, SINGLE_OR_WORD if any_length else WORD
        self.short: dict[int, dict[tuple, list]] = {}  # by number of words
        self.sets: list[frozenset] = []
        self.ids: list = []
        self.parts: dict[int, tuple[int, dict[tuple, list[int]]]] = {}
        for item, text in items:
            words = words_of(text, self.pattern)
            if any_length and 0 < len(words) < width:
                self.short.setdefault(len(words), {}).setdefault(tuple(words), []).append(item)
                continue
            own = frozenset(cut(words, width))
            if not own:
                continue
            need = self.need(len(own))
            ranked = sorted(own, key=lambda s: (xxhash.xxh64_intdigest(" ".join(s)), s))
            size = len(own).bit_length()
            least, keys = self.parts.get(size, (need, {}))
            for s in ranked[: len(own) - need + 1]:
                keys.setdefault(s, []).append(len(self.ids))
            self.parts[size] = (min(least, need), keys)
            self.ids.append(item)
            self.sets.append(own)
        self.keys = frozenset(s for _, keys in self.parts.values() for s in keys)

    def need(self, q: int) -> int:
        """The fewest shingles of q that reach the threshold."""
        return max(1, math.ceil(round(self.threshold * q, 9)))

    def search(self, text: str | None) -> list[tuple[object, int, int]]:
        """(item, shared shingles, item's shingles) of all items that the text holds."""
        words = words_of(text, self.pattern)
        inside = [(i, 1, 1) for n, items in self.short.items() for s in items.keys() & set(runs(words, n)) for i in items[s]]
        met = self.keys.intersection(cut(words, self.width))
        if not met:
            return inside
        own = set(cut(words, self.width))
        candidates: set[int] = set()
        for least, keys in self.parts.values():
            if least <= len(own):
                for s in met & keys.keys():
                    candidates.update(keys[s])
        counts = ((i, len(self.sets[i] & own)) for i in sorted(candidates))
        return inside + [(self.ids[i], n, len(self.sets[i])) for i, n in counts if n >= self.need(len(self.sets[i]))]


def item_blocks(items: DataFrame, text: str, key: str, block_bytes: int):
    """The items in blocks of bounded text, each collected for one broadcast."""
    rows = narrow(items, key=key, text=text).where("text is not null")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    for b in range(n):
        part = rows.where(F.pmod(F.xxhash64("text"), F.lit(n)) == b) if n > 1 else rows
        yield sorted(((r["key"], r["text"]) for r in part.collect()), key=lambda r: (str(r[0]), r[1]))


def matches(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id", block_bytes: int = BLOCK_BYTES, any_length: bool = False) -> DataFrame:
    """(key, item, n_shared, n_shingles, containment): every item that each document holds."""
    rows = narrow(docs, key=key, text=text)
    kinds = dict(rows.dtypes) | {"item": dict(items.dtypes)[item_key]}
    out = []
    for block in item_blocks(items, item_text, item_key, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def make(shared=shared):
            index = Index(shared.value, width, threshold, any_length)

            def f(key, text):
                found = [(k, *m) for k, t in zip(key, text) for m in index.search(t)]
                return {n: [r[i] for r in found] for i, n in enumerate(("key", "item", "n_shared", "n_shingles"))}

            return f

        out.append(map_batches(rows, make, f"key {kinds['key']}, item {kinds['item']}, n_shared bigint, n_shingles bigint"))
    every = reduce(DataFrame.unionByName, out)
    return every.select(F.col("key").alias(key), F.col("item").alias(item_key), "n_shared", "n_shingles", F.round(F.col("n_shared") / F.col("n_shingles"), 6).alias("containment"))


def clean(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH, text: str = "text", item_text: str = "text", item_key: str = "item_id", block_bytes: int = BLOCK_BYTES, any_length: bool = False) -> DataFrame:
    """The documents that hold no item, rows and columns as they are."""
    at = docs.columns.index(text)
    for block in item_blocks(items, item_text, item_key, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            index = Index(shared.value, width, threshold, any_length)
            for batch in (part for whole in batches for part in slices(whole, at)):
                yield batch.filter(pa.array([not index.search(t) for t in batch.column(at).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def oracle(threshold: float = THRESHOLD, width: int = WIDTH) -> str:
    """DuckDB SQL for :func:`matches` of documents and benchmark."""
    cut = lambda t, k: f"""(SELECT {k} AS id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {width} THEN [array_to_string(w, ' ')]
      ELSE [array_to_string(w[i:i + {width - 1}], ' ') FOR i IN range(1, len(w) - {width - 2})] END)) AS s
      FROM (SELECT {k}, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM {t} WHERE text IS NOT NULL))"""  # noqa: E731
    return f"""
WITH d AS {cut("documents", "doc_id")}, b AS {cut("benchmark", "item_id")},
size AS (SELECT id, count(*) AS n FROM b GROUP BY id),
shared AS (SELECT d.id AS doc_id, b.id AS item_id, count(*) AS n FROM d JOIN b ON d.s = b.s GROUP BY ALL)
SELECT doc_id, item_id, shared.n AS n_shared, size.n AS n_shingles, round(shared.n / size.n, 6) AS containment
FROM shared JOIN size ON size.id = item_id WHERE shared.n >= ceil(round({threshold} * size.n, 9))"""
