"""SimHash near-duplicates with BK-trees over shards of fingerprints.

A fingerprint bit is set if more than half of a text's shingle hashes have it set.
Distinct fingerprints are dealt to shards; each shard holds one BK-tree for each key
that meets in it, whose children are keyed by their integer Hamming distance to the
parent, and a search follows only the edges within the radius of the query's distance.

All fingerprints together have no size bound, so a tree is not sent to every executor:
a shard's tree and its queries are dealt to the same task instead. ``link`` keys
fingerprints by 6 of their 8 bytes, in all 28 ways. Two fingerprints that differ in two
bits or fewer agree in one of these keys, so no link is lost, and a tree has at most
2^16 nodes, since only 16 bits of its members are free.

A tree's links leave the task as a spanning forest of its members, not as all pairs;
``common.components`` joins the forests.

Defined results: a null or empty text has fingerprint zero and links like any other.
Repeated texts share a fingerprint and so a component. A null id takes part in no
component number but gets that of its fingerprint. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import components, integer_key, map_batches, materialize, narrow, release

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: Pairs of a query and a tree node that a search holds at once.
PAIRS = 400_000


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode().lower())  # of bytes, lower() changes A-Z alone


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    """XXH64 with seed 42 of each run of ``width`` words, or of all words if there are fewer."""
    if not words:
        return np.zeros(0, np.uint64)
    runs = zip(*(words[i:] for i in range(width))) if len(words) >= width else [words]
    one = xxhash.xxh64_intdigest
    return np.array([one(b" ".join(r), 42) for r in runs], np.uint64)


def simhash(hashes: np.ndarray) -> int:
    """The 64-bit fingerprint as a signed integer; zero without hashes."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[at : at + (1 << 16)].astype("<u8")).view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, width: int = 3, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, fp bigint) of every whole text."""
    rows = narrow(docs, key=key, text=text)
    make = lambda: lambda key, text: {"key": key, "fp": [simhash(shingle_hashes(words_of(t), width)) for t in text]}
    return map_batches(rows, make, f"key {dict(rows.dtypes)['key']}, fp bigint")


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int64)


class Forest:
    """BK-trees, one for each group of equal ``group`` values in a run; nodes are array places."""

    def __init__(self, fp: np.ndarray, group: np.ndarray):
        self.fp = fp.astype(np.int64).view(np.uint64)
        starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        sizes = np.diff(starts, append=len(fp))
        self.root, self.size = np.repeat(starts, sizes), np.repeat(sizes, sizes)
        slots, children = [], []
        item = np.flatnonzero(self.root != np.arange(len(fp)))
        node = self.root[item]
        while len(item):  # one level of all trees at once: the first item of a slot becomes the child
            slot = node * 65 + distance(self.fp[item], self.fp[node])
            order = np.lexsort((item, slot))
            item, slot = item[order], slot[order]
            first = np.concatenate(([True], slot[1:] != slot[:-1]))
            child = item[first]
            slots.append(slot[first])
            children.append(child)
            node = child[np.cumsum(first) - 1][~first]
            item = item[~first]
        slot, child = np.concatenate([np.zeros(0, np.int64), *slots]), np.concatenate([np.zeros(0, np.int64), *children])
        order = np.argsort(slot, kind="stable")
        self.slot, self.child = slot[order], child[order]

    def search(self, query: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, node) places of the query's own tree within the radius, node before query."""
        node = self.root[query]
        while len(query):
            d = distance(self.fp[query], self.fp[node])
            hit = (d <= radius) & (node < query)
            yield query[hit], node[hit]
            low = np.searchsorted(self.slot, node * 65 + np.maximum(d - radius, 0))
            high = np.searchsorted(self.slot, node * 65 + np.minimum(d + radius, 64), "right")
            n = high - low
            at = np.repeat(low - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            query, node = np.repeat(query, n), self.child[at]

    def links(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All linked pairs of places, in portions whose work is bounded."""
        every = np.flatnonzero(self.size > 1)
        portion = np.cumsum(self.size[every]) // PAIRS
        for query in np.split(every, np.flatnonzero(np.diff(portion)) + 1):
            if len(query):
                yield from self.search(query, radius)


class Labels:
    """Union of places by smallest place, a batch of pairs at a time."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.of[a], self.of[b]
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.of, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(step := self.of[self.of], self.of):
                self.of = step


def by_shard(shards: DataFrame, columns: list[str], solve: Callable[[pa.Table], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(a, b): what ``solve`` gives for whole shards of (shard, id, ...) rows.

    Rows of a shard meet in one task, sorted; a task holds one Arrow batch and the last
    shard of the batch before.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def emit(table: pa.Table) -> pa.RecordBatch:
            a, b = solve(table)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            shard = batch.column(batch.schema.get_field_index("shard")).to_numpy()
            cut = int(np.searchsorted(shard, shard[-1])) if np.all(shard[1:] >= shard[:-1]) else 0
            if cut or len(held) > 1 and held[-2].column("shard")[-1].as_py() != shard[0]:
                held[-1] = batch.slice(0, cut)
                yield emit(pa.Table.from_batches(held))
                held = [batch.slice(cut)]
        if held:
            yield emit(pa.Table.from_batches(held))

    dealt = shards.select("shard", "id", *columns).repartition("shard").sortWithinPartitions("shard", "id")
    return dealt.mapInArrow(run, "a bigint, b bigint")


def spanning_links(shards: DataFrame, radius: int) -> DataFrame:
    """(a, b) from (shard, id, fp): a spanning forest of the links of each shard's tree."""

    def solve(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        shard, ids, fp = (table.column(c).to_numpy() for c in ("shard", "id", "fp"))
        forest, labels = Forest(fp, shard), Labels(len(fp))
        for a, b in forest.links(radius):
            labels.join(a, b)
        moved = np.flatnonzero(labels.of != np.arange(len(fp)))
        return ids[moved], ids[labels.of[moved]]

    return by_shard(shards, ["fp"], solve)


def byte_keys() -> list[tuple[int, int]]:
    """(number, signed mask) of the 28 ways to keep 6 of 8 bytes."""
    masks = (sum(0xFF << 8 * i for i in kept) for kept in combinations(range(8), 6))
    return [(k, m - (1 << 64) if m >> 63 else m) for k, m in enumerate(masks)]


def link(fps: DataFrame, radius: int = 2) -> DataFrame:
    """(key, fp, component_id) from (key, fp): components of fingerprints within the radius (at most 2)."""
    if not 0 <= radius <= 2:
        raise ValueError("the byte keys prove completeness for radii up to 2")
    fps = materialize(fps)
    reps = materialize(fps.groupBy("fp").agg(F.min("key").alias("id")))
    key = lambda k, m: F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(m).cast("long")))
    shards = reps.where("id is not null").select(F.explode(F.array(*(key(k, m) for k, m in byte_keys()))).alias("shard"), "id", "fp")
    found = components(spanning_links(shards, radius))
    named = reps.join(found.withColumnRenamed("node", "id"), "id", "left").select("fp", F.coalesce("component", "id").alias("component_id"))
    return fps.join(named, "fp").select("key", "fp", "component_id")


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 2, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, fingerprint, component_id) of every document."""
    out = link(fingerprints(docs, width, text, key), radius)
    return out.select(F.col("key").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# ---- groups of near copies by shingle similarity, for the pipeline ----

#: Disjoint pairs of minima that deal texts to shards: none is equal at similarity 0.8 with
#: probability 0.36^20 = 1.3e-9. Minima whose bytes prune (the pairs are of the same ones), and
#: the share of equal bytes that prunes: at 0.8, fewer are equal with probability 2e-10.
BANDS, SKETCH, PRUNE = 20, 64, 0.45
#: Members of a candidate group that one task compares with the group's first member, and those of
#: a block where groups that stay apart are compared.
STAR, BLOCK = 512, 1024
#: Members of a shard that one task links; of larger ones the first member's star is linked, then what is left.
SHARD = 20_000

_SEEDS = np.random.default_rng(11)
_MULT = _SEEDS.integers(1, 1 << 63, SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _SEEDS.integers(0, 1 << 63, SKETCH, dtype=np.uint64)


def minima(hashes: np.ndarray) -> np.ndarray:
    """The smallest value of each of the hash functions over a text's shingles."""
    out = np.full(SKETCH, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 4096):
        out = np.minimum(out, (hashes[at : at + 4096, None] * _MULT + _PLUS).min(0))
    return out


def signatures(docs: DataFrame, width: int, text: str, key: str) -> DataFrame:
    """(key, words, fp, lows, sketch): a hash of the words; fingerprint and minima of the distinct shingles."""

    def make():
        def f(key, text):
            out: dict[str, list] = {"key": key, "words": [], "fp": [], "lows": [], "sketch": []}
            for t in text:
                w = words_of(t)
                hashes = np.unique(shingle_hashes(w, width))
                m = minima(hashes)
                out["fp"].append(simhash(hashes))
                out["words"].append(xxhash.xxh3_128_digest(b" ".join(w)))
                out["lows"].append(m[: 2 * BANDS].view(np.int64))
                out["sketch"].append((m >> np.uint64(32)).astype(np.uint8).tobytes())
            return out

        return f

    rows = narrow(docs, key=key, text=text)
    return map_batches(rows, make, "key bigint, words binary, fp bigint, lows array<bigint>, sketch binary")


def alike(sketches: np.ndarray, one: int, others: np.ndarray) -> np.ndarray:
    """Which of the others share enough bytes with one."""
    return np.concatenate([(sketches[others[i : i + 65536]] == sketches[one]).sum(1) >= PRUNE * SKETCH for i in range(0, len(others), 65536)])


def grown(places: np.ndarray, near: Callable[[int, np.ndarray], np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """(first place, others linked to it, directly or not): each place meets only those that no group has yet."""
    while len(places):
        first, places = int(places[0]), places[1:]
        asked = [first]
        while asked and len(places):
            hit = near(asked.pop(), places)
            if hit.any():
                found, places = places[hit], places[~hit]
                asked += found.tolist()
                yield first, found


def sketch_links(shards: DataFrame) -> DataFrame:
    """(a, b) from (shard, id, sketch): a spanning forest of the pairs in a shard whose sketches are alike."""

    def solve(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        shard, ids = (table.column(c).to_numpy() for c in ("shard", "id"))
        sk = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH)
        starts = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1])))
        sizes = np.diff(starts, append=len(shard))
        pairs = starts[sizes == 2]
        pairs = pairs[(sk[pairs] == sk[pairs + 1]).sum(1) >= PRUNE * SKETCH]
        a, b = [ids[pairs + 1]], [ids[pairs]]
        for start, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            for first, found in grown(np.arange(start, start + n), lambda x, others: alike(sk, x, others)):
                a.append(ids[found])
                b.append(np.full(len(found), ids[first]))
        return np.concatenate(a), np.concatenate(b)

    return by_shard(shards, ["sketch"], solve)


def candidate_links(shards: DataFrame, sketches: DataFrame) -> DataFrame:
    """(a, b) from (shard, id) and (id, sketch): :func:`sketch_links`, with no shard of more than SHARD members in a task.

    Copies of one text that a third of all rows hold share their keys. Such a shard's members
    meet its first member, some in a task; those that star leaves apart then meet all members.
    """
    size = shards.groupBy("shard").agg(F.count("*").alias("n"), F.min("id").alias("b"))
    large = materialize(size.where(F.col("n") > SHARD).select("shard", "b"))
    if large.isEmpty():
        return sketch_links(shards.join(sketches, "id"))
    few = sketch_links(shards.join(large, "shard", "left_anti").join(sketches, "id"))
    many = materialize(shards.join(large, "shard").select("shard", "id", "b"))
    to_parts = lambda parts: parts.select(F.col("part").alias("shard"), "id").join(sketches, "id")
    links = materialize(sketch_links(to_parts(stars(many.where("id <> b").select(F.col("id").alias("a"), "b").distinct()))).distinct())
    left = cross_parts(many.select(F.col("id").alias("node"), F.col("shard").alias("component")).distinct(), components(links))
    return few.unionByName(links).unionByName(sketch_links(to_parts(left)))


def similar_links(members: DataFrame, similarity: float) -> DataFrame:
    """(a, b) from (part, id, sketch, hashes): links verified on whole shingle sets, inside each part.

    Rows of one id in a part count once.
    """

    def solve(ids, sketches, sets) -> tuple[list[int], list[int]]:
        sk = np.frombuffer(b"".join(sketches), np.uint8).reshape(-1, SKETCH)
        own = [np.frombuffer(s, np.uint64) for s in sets]
        size = np.array([len(x) for x in own])

        def near(x: int, others: np.ndarray) -> np.ndarray:
            low, high = np.minimum(size[others], size[x]), np.maximum(size[others], size[x])
            hit = (low >= similarity * high - 1e-9) & (high > 0)
            hit[hit] = alike(sk, x, others[hit]) if hit.any() else False
            for i in np.flatnonzero(hit):
                y = others[i]
                n = len(np.intersect1d(own[x], own[y], assume_unique=True))
                hit[i] = n >= similarity * (size[x] + size[y] - n) - 1e-9
            return hit

        links = [(ids[y], ids[first]) for first, found in grown(np.arange(len(ids)), near) for y in found]
        return [a for a, _ in links], [b for _, b in links]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows = None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[0] != part:
                    if len(rows) > 1:
                        yield out(rows)
                    part, rows = row[0], []
                if not rows or rows[-1][1] != row[1]:  # repeated rows of one id
                    rows.append(row)
        if len(rows) > 1:
            yield out(rows)

    def out(rows) -> pa.RecordBatch:
        a, b = solve([r[1] for r in rows], [r[2] for r in rows], [r[3] for r in rows])
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    dealt = members.select("part", "id", "sketch", "hashes").repartition("part").sortWithinPartitions("part", "id")
    return dealt.mapInArrow(run, "a bigint, b bigint")


def stars(links: DataFrame) -> DataFrame:
    """(part, id) from (a, b): each b with the a's linked to it, by STAR of them at most."""
    size = links.groupBy("b").agg(F.ceil(F.count("*") / STAR).cast("int").alias("chunks"))
    dealt = links.join(size, "b").select("a", "b", F.xxhash64("b", F.pmod(F.xxhash64("a"), F.col("chunks"))).alias("part"))
    return dealt.select("part", F.col("a").alias("id")).unionByName(dealt.select("part", F.col("b").alias("id")).distinct())


def cross_parts(near: DataFrame, sure: DataFrame) -> DataFrame:
    """(part, id): members of candidate groups (node, component) of which ``sure`` links left more than one.

    All members outside the largest of them meet all members, in parts of two blocks; the
    largest one's own members needn't meet.
    """
    own = near.join(sure.select("node", F.col("component").alias("g")), "node", "left").select("node", "component", F.coalesce("g", "node").alias("g"))
    sizes = own.groupBy("component", "g").agg(F.count("*").alias("n"))
    tops = sizes.groupBy("component").agg(F.count("*").alias("groups"), F.sum("n").alias("n"), F.max(F.struct("n", "g")).alias("top")).where("groups > 1")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    tops = tops.select("component", blocks(F.col("n")).alias("cols"), blocks(F.col("n") - F.col("top.n")).alias("rows"), F.col("top.g").alias("most"))
    place = lambda salt, n: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(n)).cast("int")
    m = own.join(tops, "component").select("node", "component", "cols", "rows", (F.col("g") != F.col("most")).alias("other"), place(1, "cols").alias("col"), place(2, "rows").alias("row"))
    every = m.select("node", "component", "col", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("row"))
    other = m.where("other").select("node", "component", F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("col"), "row")
    return every.unionByName(other).select(F.xxhash64("component", "row", "col").alias("part"), F.col("node").alias("id")).distinct()


def near_groups(docs: DataFrame, width: int = 5, similarity: float = 0.8, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, group): texts linked by a Jaccard similarity of their shingle sets, group = smallest key.

    Texts of the same words are one candidate. Candidates whose SimHash fingerprints, of their
    distinct shingles, are within two bits are linked by the BK-trees of :func:`link`. Texts of
    similarity 0.8 differ in about ten bits and often more, too many for any key of a tree to
    hold them all, so the rest needs another way: candidates are also dealt to shards by ``BANDS``
    disjoint pairs of min-hash values (two texts of similarity 0.8 share none with
    probability 1.3e-9, of 0.9 with 4e-15) and linked there if their sketches are alike, as a
    forest of stars. All are of shingle sets, as the similarity is, so lines that repeat
    don't matter. Whole shingle sets then verify the links of trees and stars, a bounded part of a star
    in a task. Where that leaves a candidate group in pieces, all members outside the
    largest piece are compared with all members, block by block.

    Ids are integers (others raise TypeError). Rows with a null key are left out.
    """
    rows = narrow(docs, id=integer_key(docs, key), text=text)
    sig = materialize(signatures(rows, width, "text", "id").where("key is not null"))
    reps = sig.groupBy("words").agg(F.min(F.struct("key", "fp", "lows", "sketch")).alias("r"))
    reps = materialize(reps.select("words", F.col("r.key").alias("id"), "r.fp", "r.lows", "r.sketch"))
    pairs = [F.xxhash64(F.lit(i), F.col("lows")[2 * i], F.col("lows")[2 * i + 1]) for i in range(BANDS)]
    shards = materialize(reps.select(F.explode(F.array(*pairs)).alias("shard"), "id"))
    trees = link(reps.select(F.col("id").alias("key"), "fp")).where("key <> component_id").select(F.col("key").alias("a"), F.col("component_id").alias("b"))
    links = materialize(trees.unionByName(candidate_links(shards, reps.select("id", "sketch"))).distinct())
    near = components(links)
    near = materialize(near.unionByName(near.select(F.col("component").alias("node"), "component").distinct()))

    def make():
        return lambda id, sketch, text: {"id": id, "sketch": sketch, "hashes": [np.unique(shingle_hashes(words_of(t), width)).tobytes() for t in text]}

    asked = near.select(F.col("node").alias("id")).join(reps.select("id", "sketch"), "id").join(rows, "id")
    sets = materialize(map_batches(asked, make, "id bigint, sketch binary, hashes binary"))
    sure = components(similar_links(stars(links).join(sets, "id"), similarity))
    more = materialize(cross_parts(near, sure))
    groups = sure
    if not more.isEmpty():
        found = similar_links(more.join(sets, "id"), similarity)
        groups = components(found.unionByName(sure.select(F.col("node").alias("a"), F.col("component").alias("b"))))
    for done in (shards, links, near, sets, more):
        release(docs.sparkSession, done)
    named = reps.join(groups.withColumnRenamed("node", "id"), "id", "left").select("words", F.coalesce("component", "id").alias("group"))
    return sig.select("key", "words").join(named, "words").select("key", "group")


def keep_first(docs: DataFrame, width: int = 5, similarity: float = 0.8, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The documents without those whose group has a smaller key; rows with a null key stay."""
    out = near_groups(docs, width, similarity, text, key).where("group < key").select(F.col("key").alias(key)).distinct()
    return docs.join(materialize(out), key, "left_anti").select(docs.columns)
