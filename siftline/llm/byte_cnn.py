"""Language identification by a byte convolutional network, trained in numpy.

The network reads a window of fixed length as bytes. Filters of several widths slide
over it, each is max-pooled over the window, and a softmax over the pooled values gives
the languages. With one-hot bytes a filter of width w is a sum of w table rows, so the
forward pass is table look-ups; for prediction two neighbouring bytes share one table.
Whole texts are read as consecutive windows, batched over texts; a text's score for a
language is the mean probability over its windows, weighted by the windows' bytes.

Training uses windows of a bounded sample: about ``per_lang`` texts a language, chosen
by a hash, with at most ``windows`` windows each, spread evenly over the text. Seeds and
order are fixed, so equal inputs give equal weights on one machine type.

Defined results: a null text, or one without letters, is ``und`` with score 0. With no
labelled text at all every text is ``und``. A single language is predicted for all.
Repeated rows get equal values; extra columns are ignored.
"""

from __future__ import annotations

import io
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import bound_batches, map_batches, narrow, slices

WINDOW, WIDTHS, FILTERS = 256, (2, 3, 4), 16
PER_LANG, WINDOWS, EPOCHS, BATCH, RATE, SEED = 1500, 3, 6, 64, 0.02, 7
#: Windows of one prediction batch.
CHUNK = 64

#: Every byte value is a class of its own; byte 0 pads the last window.
CLASSES = 256


def windows_of(raw: bytes) -> np.ndarray:
    """All consecutive windows of a text; the last one is padded with byte 0."""
    n = max(1, -(-len(raw) // WINDOW))
    out = np.zeros(n * WINDOW, np.uint8)
    out[: len(raw)] = np.frombuffer(raw, np.uint8)
    return out.reshape(n, WINDOW)


class ByteCNN:
    """Weights: a table (class, filter) for each place in each width, then a linear softmax."""

    def __init__(self, langs: list[str], seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.tables = {w: rng.normal(0, 0.3, (w, CLASSES, FILTERS)).astype(np.float32) for w in WIDTHS}
        n = FILTERS * len(WIDTHS)
        self.out = rng.normal(0, 0.1, (n, len(langs))).astype(np.float32)
        self.bias = np.zeros(len(langs), np.float32)

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Max of each filter over each window, and where it is."""
        values, places = [], []
        for w, table in self.tables.items():
            n = WINDOW - w + 1
            act = table[0][x[:, :n]]
            for j in range(1, w):
                act += table[j][x[:, j : j + n]]
            at = act.argmax(1)
            places.append(at)
            values.append(np.take_along_axis(act, at[:, None, :], 1)[:, 0])
        return np.concatenate(values, 1), places

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> ByteCNN:
        """Adam on the cross entropy; the gradient of a maximum goes to its place alone."""
        rng = np.random.default_rng(seed)
        params = [*self.tables.values(), self.out, self.bias]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for start in range(0, len(order), BATCH):
                rows = order[start : start + BATCH]
                h, places = self.pooled(x[rows])
                a = np.tanh(h)
                p = softmax(a @ self.out + self.bias)
                p[np.arange(len(rows)), y[rows]] -= 1
                p /= len(rows)
                dh = (p @ self.out.T) * (1 - a * a)
                grads = []
                for k, w in enumerate(WIDTHS):
                    g = np.zeros_like(self.tables[w])
                    d, at = dh[:, k * FILTERS : (k + 1) * FILTERS], places[k]
                    filters = np.broadcast_to(np.arange(FILTERS), d.shape)
                    for j in range(w):
                        np.add.at(g[j], (np.take_along_axis(x[rows], at + j, 1), filters), d)
                    grads.append(g)
                grads += [a.T @ p, p.sum(0)]
                step += 1
                for i, (q, g) in enumerate(zip(params, grads)):
                    first[i] = 0.9 * first[i] + 0.1 * g
                    second[i] = 0.99 * second[i] + 0.01 * g * g
                    q -= RATE * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.99**step)) + 1e-7)
        return self

    def fused(self) -> Callable[[np.ndarray], np.ndarray]:
        """Probabilities of windows, with one look-up for two neighbouring bytes."""
        pairs = {w: [(t[j][:, None] + t[j + 1][None]).reshape(-1, FILTERS) for j in range(0, w - 1, 2)] for w, t in self.tables.items()}

        def run(x: np.ndarray) -> np.ndarray:
            two = x[:, :-1].astype(np.intp) * CLASSES + x[:, 1:]
            values = []
            for w, t in self.tables.items():
                n = WINDOW - w + 1
                act = pairs[w][0].take(two[:, :n], 0, mode="clip")
                for k, table in enumerate(pairs[w][1:], 1):
                    act += table.take(two[:, 2 * k : 2 * k + n], 0, mode="clip")
                if w % 2:
                    act += t[w - 1].take(x[:, w - 1 : w - 1 + n], 0, mode="clip")
                values.append(act.max(1))
            return softmax(np.tanh(np.concatenate(values, 1)) @ self.out + self.bias)

        return run

    def dump(self) -> bytes:
        f = io.BytesIO()
        np.savez(f, langs=np.array(self.langs), out=self.out, bias=self.bias, **{f"t{w}": t for w, t in self.tables.items()})
        return f.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> ByteCNN:
        z = np.load(io.BytesIO(raw))
        model = cls([str(x) for x in z["langs"]])
        model.out, model.bias = z["out"], z["bias"]
        model.tables = {w: z[f"t{w}"] for w in WIDTHS}
        return model


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def lettered(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_lang: int = PER_LANG, windows: int = WINDOWS) -> bytes | None:
    """The dumped network from rows with text and label, or None if there is none.

    The sample is bounded by ``per_lang`` x ``windows`` windows for each language in
    expectation; the number of labels is taken to be that of natural languages.
    """
    rows = narrow(labelled, key=key, text=text, lang=lang).where("text is not null and lang is not null")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    place = F.pmod(F.xxhash64(F.col("key").cast("string")), F.lit(1_000_000)) / 1e6
    share = F.element_at(F.create_map(*(F.lit(v) for k, n in counts.items() for v in (k, min(1.0, per_lang / n)))), F.col("lang"))
    picked = rows.where(place < share)

    def make():
        def f(key, text, lang):
            out: dict[str, list] = {"key": [], "lang": [], "part": [], "x": []}
            for k, t, y in zip(key, text, lang):
                if lettered(t):
                    own = windows_of(t.encode())
                    for i in np.unique(np.linspace(0, len(own) - 1, windows).astype(int)).tolist():
                        for name, v in zip(out, (str(k), y, i, own[i].tobytes())):
                            out[name].append(v)
            return out

        return f

    found = map_batches(picked, make, "key string, lang string, part int, x binary").collect()
    found.sort(key=lambda r: (r["lang"], r["key"], r["part"], bytes(r["x"])))
    langs = sorted({r["lang"] for r in found})
    if not langs:
        return None
    x = np.stack([np.frombuffer(bytes(r["x"]), np.uint8) for r in found])
    y = np.array([langs.index(r["lang"]) for r in found])
    return ByteCNN(langs).fit(x, y).dump()


def predict(docs: DataFrame, model: bytes | None, text: str = "text", key: str | None = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, lang_pred, score[, kept columns]) of every whole text."""
    rows = narrow(docs, key=key, text=text, **{f"own_{c}": c for c in keep})
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the size of the weights, some hundred KB

    def make():
        classify = classifier(ByteCNN.load(shared.value) if shared.value else None)

        def f(key, text, **own):
            langs, scores = classify(text)
            return {"key": key, "lang_pred": langs, "score": scores} | own

        return f

    kinds = dict(rows.dtypes)
    schema = f"key {kinds['key']}, lang_pred string, score double" + "".join(f", own_{c} {kinds['own_' + c]}" for c in keep)
    out = map_batches(rows, make, schema)
    return out.select(F.col("key").alias(key), "lang_pred", "score", *(F.col(f"own_{c}").alias(c) for c in keep))


def classifier(net: ByteCNN | None) -> Callable[[list[str | None]], tuple[list[str], list[float]]]:
    """Languages and scores of a batch of whole texts."""
    run = net.fused() if net else None

    def classify(text: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = ["und"] * len(text), [0.0] * len(text)
        asked = [i for i, t in enumerate(text) if net and lettered(t)]
        sums = np.zeros((len(text), len(net.langs) if net else 0))
        for part, owner, weight in blocks([(i, text[i].encode()) for i in asked]):
            np.add.at(sums, owner, run(part) * weight[:, None])
        for i in asked:
            p = sums[i] / sums[i].sum()
            langs[i], scores[i] = net.langs[int(p.argmax())], float(p.max())
        return langs, scores

    return classify


def blocks(texts: list[tuple[int, bytes]]):
    """Windows of many texts in blocks of CHUNK, with the text and the bytes of each."""
    xs, owners, weights, n = [], [], [], 0
    for i, raw in texts:
        x = windows_of(raw)
        w = np.full(len(x), WINDOW, np.float64)
        w[-1] = len(raw) - WINDOW * (len(x) - 1)
        xs.append(x), owners.append(np.full(len(x), i)), weights.append(w)
        n += len(x)
        if n >= CHUNK:
            yield from cut(xs, owners, weights)
            xs, owners, weights, n = [], [], [], 0
    if n:
        yield from cut(xs, owners, weights)


def cut(xs, owners, weights):
    x, owner, weight = np.concatenate(xs), np.concatenate(owners), np.concatenate(weights)
    for at in range(0, len(x), CHUNK):
        yield x[at : at + CHUNK], owner[at : at + CHUNK], weight[at : at + CHUNK]


def held_out(key: Column) -> Column:
    """The rows that no training sees: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def keep_known(docs: DataFrame, model: bytes | None, min_score: float = 0.3, langs: frozenset[str] | None = None, text: str = "text") -> DataFrame:
    """The documents whose predicted language is known (of ``langs``, if given) and scored; rows and columns stay as they are.

    Without a model (no labelled text to learn from) nothing can be told, and all documents stay.
    """
    if model is None:
        return docs
    bound_batches(docs.sparkSession)
    at = docs.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        classify = classifier(ByteCNN.load(shared.value))
        for batch in (part for whole in batches for part in slices(whole, at)):
            found, scores = classify(batch.column(at).to_pylist())
            yield batch.filter(pa.array([y != "und" and s >= min_score and (langs is None or y in langs) for y, s in zip(found, scores)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
