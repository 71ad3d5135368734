"""N-grams as 128-bit digests (P4-P8), cut and probed over Arrow batches.

A text becomes an array of units (hashes of tokens, or code points), an n-gram two
polynomials of n units modulo 2^64, so all grams of a text are a few vector operations
and no gram is ever a string. An index that is checked small goes to the tasks as sorted
arrays and is probed there: only matches leave the scan. A larger one is joined.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from siftline.functions import text as T
from siftline.operators.common import BROADCAST_ROWS

DIGEST = ("g1", "g2")
LATIN_WORD, BEYOND, ASCII = re.compile(r"[^\W_]+"), re.compile(T.BEYOND_LATIN), re.compile("[a-z0-9]+")
#: Odd factors of the two polynomials and of the mixing steps.
FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
MIX, MEMO = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F), 500_000


def words(text: str) -> list[str]:
    """P4 for one string: Latin texts by one pattern, others character by character."""
    return T.token_list(text) if BEYOND.search(text) else LATIN_WORD.findall(text.lower().replace("ß", "ss"))


def ascii_words(text: str) -> list[str]:
    """P7, Y2."""
    return ASCII.findall(text.lower().replace("_", " "))


def letters(text: str) -> str:
    """P8, Y3."""
    plain = text.lower().replace("ß", "ss") if not BEYOND.search(text) else unicodedata.normalize("NFKC", text).casefold()
    return "".join(filter(str.isalnum, plain))


#: How a text is cut: its pieces, and what joins the pieces of a gram that is shown.
CUTS: dict[str, tuple[Callable, str]] = {"words": (words, " "), "ascii": (ascii_words, " "), "letters": (letters, ""), "chars": (str, "")}


def mixed(x: np.ndarray, factor: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(factor)
    return x ^ (x >> np.uint64(29))


class Cutter:
    """The digests of all n-grams of a text; the hashes of tokens are kept up to a bound."""

    def __init__(self, cut: str, n: int):
        self.pieces, self.n, self.memo = CUTS[cut][0], n, {}

    def units(self, pieces: list[str] | str) -> np.ndarray:
        if isinstance(pieces, str):
            return mixed(np.frombuffer(pieces.encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1), MIX[1])
        if new := set(pieces).difference(self.memo):
            if len(self.memo) > MEMO:
                self.memo.clear()
                new = set(pieces)
            self.memo |= {t: xxhash.xxh3_64_intdigest(t) for t in new}
        return np.fromiter(map(self.memo.__getitem__, pieces), np.uint64, len(pieces))

    def digests(self, text: str) -> tuple[np.ndarray, np.ndarray, list[str] | str]:
        pieces = self.pieces(text)
        count = len(pieces) - self.n + 1
        if count < 1:
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64), pieces
        u, out = self.units(pieces), []
        for factor, mix in zip(FACTORS, MIX):
            v = mixed(u, mix)
            g = v[:count].copy()
            for j in range(1, self.n):
                g *= np.uint64(factor)
                g += v[j : j + count]
            out.append(mixed(g, mix))
        return out[0], out[1], pieces


def gram_rows(df: DataFrame, keys: list[str], text: str, cut: str, n: int, distinct: bool = True, shown: bool = False) -> DataFrame:
    """(keys, pos, g1, g2[, gram]): digests of all n-grams of each row, or of its distinct ones; null texts have none."""
    return _scan(df, keys, text, cut, n, distinct, shown, None)


def _scan(df: DataFrame, keys: list[str], text: str, cut: str, n: int, distinct: bool, shown: bool, index) -> DataFrame:
    rows = df.select(*keys, F.col(text).alias("text"))
    more = [StructField(c, LongType()) for c in ("pos", *DIGEST)] + ([StructField("mask", LongType())] if index else []) + ([StructField("gram", StringType())] if shown else [])
    schema, width, join = StructType([*rows.drop("text").schema.fields, *more]), len(keys), CUTS[cut][1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(cut, n)
        g1s, g2s, masks = index.value if index else (None, None, None)
        for batch in batches:
            own, at, a, b, m, grams = [], [], [], [], [], []
            for i, t in enumerate(batch.column(width).to_pylist()):
                if t is None:
                    continue
                g1, g2, pieces = cutter.digests(t)
                pos = np.arange(len(g1))
                if index and len(g1):
                    place = np.minimum(np.searchsorted(g1s, g1), len(g1s) - 1) if len(g1s) else np.zeros(len(g1), np.int64)
                    pos = np.flatnonzero((g1s[place] == g1) & (g2s[place] == g2)) if len(g1s) else pos[:0]
                    m.append(masks[place[pos]] if len(g1s) else np.zeros(0, np.int64))
                if distinct and len(pos):
                    first = np.sort(np.unique(g1[pos], return_index=True)[1])
                    if index:
                        m[-1] = m[-1][first]
                    pos = pos[first]
                own.append(np.full(len(pos), i)), at.append(pos), a.append(g1[pos]), b.append(g2[pos])
                if shown:
                    grams += [join.join(pieces[p : p + n]) for p in pos.tolist()]
            if not own:
                continue
            rows = pa.array(np.concatenate(own).astype(np.int64))
            columns = [pc.take(batch.column(j), rows) for j in range(width)] + [pa.array(np.concatenate(at).astype(np.int64)), *(pa.array(np.concatenate(x).view(np.int64)) for x in (a, b))]
            columns += ([pa.array(np.concatenate(m) if m else np.zeros(0, np.int64))] if index else []) + ([pa.array(grams, pa.string())] if shown else [])
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(run, schema)


def matches(df: DataFrame, keys: list[str], text: str, cut: str, n: int, index: DataFrame, distinct: bool = True, limit: int = BROADCAST_ROWS) -> DataFrame:
    """(keys, pos, g1, g2, mask) of the n-grams that an index (g1, g2, mask) holds."""
    head = index.select(*DIGEST, F.col("mask").cast("bigint").alias("mask")).limit(limit + 1).toArrow()
    if head.num_rows > limit:  # both sides move, as digests
        return gram_rows(df, keys, text, cut, n, distinct).join(index.select(*DIGEST, F.col("mask").cast("bigint").alias("mask")), list(DIGEST)).select(*keys, "pos", *DIGEST, "mask")
    g1, g2, mask = (head.column(i).to_numpy() for i in range(3))
    order = np.argsort(g1.view(np.uint64))
    shared = df.sparkSession.sparkContext.broadcast((g1.view(np.uint64)[order], g2.view(np.uint64)[order], mask[order]))
    return _scan(df, keys, text, cut, n, distinct, False, shared)


class Sets:
    """The distinct character n-grams of texts, as sorted 64-bit digests; a shorter text is one gram, an empty one none."""

    def __init__(self, n: int):
        self.cutter, self.n = Cutter("chars", n), n

    def of(self, text: str) -> np.ndarray:
        if len(text) >= self.n:
            return np.unique(self.cutter.digests(text)[0])
        return np.array([xxhash.xxh3_64_intdigest(text)] if text else [], np.uint64)


#: Grams whose keys are made at once, and how much larger than its smallest set the largest of a class of sizes is.
GRAMS, WIDTH = 500_000, 1.25
#: Sizes of sets that fit beside a sketch; larger ones are not pruned.
SIZES = (1 << 15) - 1


def most_apart(a, b, threshold: float):
    """Grams that only one of two sets of sizes a and b has, at most, if their Jaccard similarity is the threshold."""
    return np.floor((a + b) * (1 - threshold) / (1 + threshold) + 1e-6).astype(np.int64)


@lru_cache(64)
def size_classes(longest: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(largest size, number of parts) of each class of set sizes, from 1 to at least ``longest``."""
    tops, low = [], 1
    while low <= longest:
        tops.append(max(low, int(low * WIDTH)))
        low = tops[-1] + 1
    top = np.array(tops or [1])
    return top, most_apart(top, np.floor(top / threshold + 1e-6), threshold) + 1


def part_keys(sets: list[np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the set, key, note): two sets of the threshold's Jaccard similarity or more have a key in common.

    Such sets differ in at most k grams; dealt by hash to k + 1 parts, all grams of some part
    are the same. A key is the sum of a part's mixed grams. k follows from the class of
    the smaller set's size, so a set has keys in its own class and, where its size still fits,
    as a guest in the class below. The note holds a sketch, the parity of its grams in 48
    slots, with the size and whether it is a guest: sets that differ in k grams differ in k slots at most.
    """
    size = np.array([len(x) for x in sets], np.int64)
    grams = np.concatenate([np.zeros(0, np.uint64), *sets])
    top, parts = size_classes(1 << (int(size.max(initial=1)) - 1).bit_length(), threshold)
    own = np.repeat(np.arange(len(sets)), size)
    flips = np.bincount(own * 48 + (mixed(grams, FACTORS[0]) % np.uint64(48)).astype(np.int64), minlength=48 * len(sets)).reshape(-1, 48) & 1
    sketch = (flips.astype(np.int64) << np.arange(48, dtype=np.int64)).sum(1)
    at, low, high = mixed(grams, FACTORS[1]), grams & np.uint64(0xFFFFFFFF), grams >> np.uint64(32)
    level, out = np.searchsorted(top, size), []
    for guest in (0, 1):
        which = np.maximum(level - guest, 0)
        fit = (size > 0) & (level >= guest) & (size <= np.floor(top[which] / threshold + 1e-6))
        n = np.where(fit, parts[which], 0)
        base = np.cumsum(n) - n
        use = fit[own]
        o = own[use]
        part = base[o] + (at[use] % n[o].astype(np.uint64)).astype(np.int64)
        # sums modulo 2^64 from halves that doubles hold exactly
        total = sum(np.bincount(part, x[use].astype(np.float64), n.sum()).astype(np.uint64) << np.uint64(s) for x, s in ((low, 0), (high, 32)))
        owner = np.repeat(np.arange(len(sets)), n)
        number = (np.arange(len(owner)) - base[owner] + (which[owner] << 40)).astype(np.uint64)
        note = sketch[owner] << 16 | np.minimum(size[owner], SIZES) << 1 | guest
        out.append((owner, mixed(mixed(total, MIX[0]) + mixed(number + np.uint64(1), MIX[1]), MIX[0]).view(np.int64), note))
    return tuple(np.concatenate(x) for x in zip(*out))


def part_rows(df: DataFrame, key: str, text: str, n: int, threshold: float) -> DataFrame:
    """(key, part, note): :func:`part_keys` of the distinct character n-grams of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = Sets(n)

        def out(ids: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
            owner, part, note = part_keys(sets, threshold)
            return pa.RecordBatch.from_arrays([pa.array(np.array(ids, np.int64)[owner]), pa.array(part), pa.array(note)], names=[key, "part", "note"])

        for batch in batches:
            ids, sets, held = [], [], 0
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(i), sets.append(cut.of(t))
                held += len(sets[-1])
                if held > GRAMS:
                    yield out(ids, sets)
                    ids, sets, held = [], [], 0
            if ids:
                yield out(ids, sets)

    return df.select(F.col(key).cast("bigint"), text).mapInArrow(run, f"{key} bigint, part bigint, note bigint")


def part_pairs(rows: DataFrame, key: str, threshold: float) -> DataFrame:
    """(x, y) from :func:`part_rows`: keys of rows with a common part whose sizes and sketches allow the threshold."""

    def pairs(table: pa.Table) -> Iterator[pa.RecordBatch]:
        part, ids, note = (table.column(c).to_numpy() for c in ("part", key, "note"))
        size, guest, step = note >> 1 & SIZES, note & 1 == 1, 1
        one = np.flatnonzero(part[1:] == part[:-1])
        while len(one):  # each row with the next of its run, then the one after it, and so on
            for at in range(0, len(one), GRAMS):
                a = one[at : at + GRAMS]
                b = a + step
                low, high = np.minimum(size[a], size[b]), np.maximum(size[a], size[b])
                apart = np.bitwise_count((note[a] ^ note[b]).view(np.uint64) >> np.uint64(16)).astype(np.int64)
                hit = (ids[a] != ids[b]) & ~(guest[a] & guest[b]) & ((high == SIZES) | (low >= threshold * high - 1e-6) & (apart <= most_apart(low, high, threshold)))
                x, y = ids[a[hit]], ids[b[hit]]
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["x", "y"])
            step += 1
            one = one[one + step < len(part)]
            one = one[part[one + step] == part[one]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column(0).to_numpy()
            cut = int(np.searchsorted(part, part[-1]))  # the last run may go on in the next batch
            if cut or held and held[-1].column(0)[-1].as_py() != part[0]:
                yield from pairs(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from pairs(pa.Table.from_batches(held))

    return rows.select("part", key, "note").repartition("part").sortWithinPartitions("part").mapInArrow(run, "x bigint, y bigint").distinct()


def jaccard(df: DataFrame, keys: list[str], one: str, other: str, n: int) -> DataFrame:
    """(keys, jaccard) of two texts' distinct character n-grams."""
    rows = df.select(*keys, one, other)
    schema, width = StructType([*rows.drop(one, other).schema.fields, StructField("jaccard", DoubleType())]), len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = Sets(n)
        for batch in batches:
            out = []
            for a, b in zip(batch.column(width).to_pylist(), batch.column(width + 1).to_pylist()):
                a, b = cut.of(a), cut.of(b)
                both = np.sort(np.concatenate((a, b)))
                shared = np.count_nonzero(both[1:] == both[:-1])
                out.append(shared / max(len(both) - shared, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(out, pa.float64())], names=schema.names)

    return rows.mapInArrow(run, schema)
