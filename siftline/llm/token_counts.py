"""Token counts of whole texts, huge ones by overlapping chunks spliced where that is proven.

A unigram or pair-merge piece model marks a space by U+2581 and, if no piece of its
vocabulary has that mark after another character, no piece spans the place between a
non-space and a space. Such places are stable: what stands left of one can't change
the pieces on its right. They are proven from the vocabulary when the model is read.

* A text of one chunk is counted as the sum over its units (the runs between stable
  places); units not in the memo are encoded together, as one text of their own.
* A longer text is encoded in chunks that overlap, with the pieces' offsets. Two
  neighbours are spliced at a stable place in the overlap where both have a piece
  boundary. If they have none in common (a long run without spaces), the overlap is
  doubled, up to the whole rest, and the chunk is encoded again.

Defined results: a null or empty text has no bytes and no tokens. Repeated texts and
rows get equal values; extra columns of the input are ignored.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame

from siftline.llm.common import map_batches, narrow

MEMO_UNITS, MEMO_CHARS = 400_000, 64
SPACE = "▁"
#: A space mark as it may stand in a text: the model reads both alike.
UNIT = re.compile(f"[ {SPACE}]*[^ {SPACE}]*")
STABLE = re.compile(f"(?<=[^ {SPACE}])[ {SPACE}]")


class PieceCounter:
    """A piece model and the proof that its space boundaries are stable."""

    def __init__(self, path: str, chunk: int, overlap: int):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.chunk, self.overlap = chunk, overlap
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.starts = np.array([p.startswith(SPACE) for p in pieces])
        self.blank = np.array([not p.strip(SPACE) for p in pieces])
        self.sizes = np.array([1 if self.model.is_byte(i) else len(p.replace(SPACE, " ").encode()) for i, p in enumerate(pieces)])
        inner = any(SPACE in p.lstrip(SPACE) for p in pieces)
        probes = ("a b", " a  b ", "aé\n b　ﬁ")
        as_is = all(self.model.normalize(p).replace(SPACE, " ") == f" {p}" for p in probes)
        self.proven = not inner and as_is  # and the normaliser only puts one space before the text
        self.memo: dict[str, int] = {}

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self.proven:
            return len(self.model.encode(text))
        return self.by_units(text) if len(text) <= self.chunk else self.by_chunks(text)

    def by_units(self, text: str) -> int:
        """The model puts one space before a text, so every unit starts with a space."""
        units, memo = UNIT.findall(" " + text), self.memo
        if missing := set(units).difference(memo):
            new = sorted(filter(None, missing), key=lambda u: not u.strip(f" {SPACE}"))  # only a text's last unit can be blank
            ids = np.asarray(self.model.encode("".join(new)[1:], num_threads=1))
            first = self.starts[ids] & ~np.concatenate(([False], self.blank[ids[:-1]]))
            counts = np.diff(np.flatnonzero(first), append=len(ids)).tolist()
            if len(counts) != len(new):
                raise ValueError("the piece model's units don't match its pieces")
            learnt = dict(zip(new, counts)) | {"": 0}
            known = {u: memo[u] for u in set(units).difference(missing)} | learnt
            if len(memo) < MEMO_UNITS:
                memo |= {u: n for u, n in learnt.items() if len(u) <= MEMO_CHARS}
            memo = known
        return sum(map(memo.__getitem__, units))

    def ends(self, text: str, start: int, stop: int) -> np.ndarray:
        """End offsets in the text of the pieces of one chunk; those at its edges may be unstable.

        A chunk that starts inside the text on a space gives it up to the one the model adds.
        """
        own = start > 0 and text[start] in f" {SPACE}"
        part = text[start + own : stop]
        ids, raw = np.asarray(self.model.encode(part)), np.frombuffer(part.encode(), np.uint8)
        ends = np.cumsum(self.sizes[ids]) - 1  # without the space that the model adds
        if SPACE in part or not len(ids) or ends[-1] != len(raw):
            ends = np.array([p.end for p in self.model.encode(part, return_type="proto").pieces])
        chars = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))  # those are UTF-8 bytes
        return start + own + chars[ends]

    def by_chunks(self, text: str) -> int:
        total, start, taken = 0, 0, -1
        # pieces that end at or before `taken` are counted; the chunk in hand starts at `start`
        ends = self.ends(text, 0, self.chunk)
        stop = self.chunk
        while stop < len(text):
            overlap = self.overlap
            while True:
                begin = max(start, stop - overlap)
                after = min(len(text), max(stop + self.chunk - overlap, stop + 1))
                new = self.ends(text, begin, after)
                cut = self.splice(text, ends, new, max(begin, taken), begin, stop)
                if cut is not None:
                    break
                if begin == start:  # the overlap is the whole chunk: encode both as one
                    after = min(len(text), after + self.chunk)
                    new, cut = self.ends(text, start, after), taken
                    break
                overlap *= 2
            total += int(((taken < ends) & (ends <= cut)).sum())
            start, stop, ends, taken = begin if cut != taken else start, after, new, cut
        return total + int((ends > taken).sum())

    def splice(self, text: str, old: np.ndarray, new: np.ndarray, low: int, begin: int, stop: int) -> int | None:
        """The last stable place in (low, stop) where both chunks have a piece boundary."""
        common = set(np.intersect1d(old, new).tolist())
        places = [m.start() for m in STABLE.finditer(text, low, stop) if begin < m.start() < stop]
        return next((p for p in reversed(places) if p in common and p > low), None)


def count_tokens(docs: DataFrame, path: str, limit: int = 4096, chunk: int = 32_768, overlap: int = 1024, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of every whole text.

    ``chunk`` and ``overlap`` are characters; they bound memory and don't change counts.
    """

    def make():
        counter = PieceCounter(path, chunk, overlap)

        def f(key, text):
            n = [counter.count(t or "") for t in text]
            return {"key": key, "n_bytes": [len((t or "").encode()) for t in text], "n_tokens": n, "over_limit": [x > limit for x in n]}

        return f

    rows = narrow(docs, key=key, text=text)
    schema = f"key {dict(rows.dtypes)['key']}, n_bytes bigint, n_tokens bigint, over_limit boolean"
    return map_batches(rows, make, schema).withColumnRenamed("key", key)
