"""Quality classifier: a generalised additive model with pairwise interactions.

Features are numbers that a text's bytes and words give. Each is cut into bins at quantiles; cyclic boosting of shallow
trees, one feature after another, learns a table of log-odds for each feature, and then for the few pairs of features
whose interaction explains most of what is left. A score is the sum of looked-up bins.

Defined cases: a null or empty text has features of its own (all zero); repeated rows get a row each; without labels to
learn from every score is 1; very long texts are read whole, in pieces; an empty table gives an empty table; extra columns are ignored, or pass through :func:`keep_good`.
At most ``SAMPLE_ROWS`` labelled rows are learnt from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spans, utf8
from .labelled import labelled_sample
from .words import word_hashes

SAMPLE_ROWS, BINS, ROUNDS, RATE, PAIRS, COARSE, THRESHOLD = 30_000, 48, 120, 0.12, 6, 10, 0.7

FEATURES = (
    "log_bytes", "upper", "lower", "digit", "symbol", "bar", "exclamation", "stop_comma", "space", "newline", "control", "non_ascii", "byte_entropy",
    "log_words", "word_length", "distinct_words", "top_word", "word_twice_running", "repeated_trigrams", "repeated_lines", "top_trigram",
)
_CLASSES = {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "symbol": [ord(c) for c in "#$%&*+/<=>@\\^_`{}~"], "bar": [124], "exclamation": [33], "stop_comma": [44, 46], "space": [9, 11, 12, 32], "newline": [10, 13], "control": [*range(9), *range(14, 32), 127], "non_ascii": range(128, 256)}
_CLASS = np.zeros((256, len(_CLASSES)))
for _k, _range in enumerate(_CLASSES.values()):
    _CLASS[list(_range), _k] = 1


def _share_of_most(h: np.ndarray) -> tuple[float, float]:
    """Distinct values and the most frequent one, as shares."""
    s = np.sort(h)
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    n = np.diff(np.append(first, len(s)))
    return len(first) / len(s), n.max() / len(s)


def _line_repeats(text: bytes) -> float:
    lines = [x for x in text.split(b"\n") if x.strip()]
    return 1 - len(set(lines)) / len(lines) if lines else 0.0


def features(column) -> np.ndarray:
    """A row of FEATURES for each text."""
    raw, at = utf8(column)
    out = np.zeros((len(at) - 1, len(FEATURES)))
    k = len(_CLASSES)
    three = np.array([3, 5, 7], np.uint64)
    for lo, hi in spans(at, 1 << 22):
        part, cut = raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        for first, offsets, h in word_hashes(part, cut):
            for i in range(len(offsets) - 1):
                row = out[lo + first + i]
                a, b = cut[first + i], cut[first + i + 1]
                if a == b:
                    continue
                own = part[a:b]
                share = np.bincount(own, minlength=256) / (b - a)
                row[0] = np.log1p(b - a)
                row[1 : 1 + k] = share @ _CLASS
                some = share[share > 0]
                row[1 + k] = -(some * np.log2(some)).sum()
                w = h[offsets[i] : offsets[i + 1]]
                row[2 + k] = np.log1p(len(w))
                if len(w):
                    row[3 + k] = np.log((b - a) / len(w))
                    row[4 + k], row[5 + k] = _share_of_most(w)
                    row[6 + k] = (w[1:] == w[:-1]).mean() if len(w) > 1 else 0
                if len(w) > 2:
                    n, top = _share_of_most(w[:-2] * three[0] + w[1:-1] * three[1] + w[2:] * three[2])
                    row[7 + k], row[9 + k] = 1 - n, top
                row[8 + k] = _line_repeats(own.tobytes())
    return out


@dataclass
class Model:
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    coarse: list[np.ndarray]  # of each feature: fine bin -> coarse bin
    pair_tables: list[np.ndarray]
    base: float

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], "right") for k, e in enumerate(self.edges)], axis=1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        z = np.full(len(x), self.base)
        for k, t in enumerate(self.tables):
            z += t[b[:, k]]
        for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
            z += t[self.coarse[i][b[:, i]], self.coarse[j][b[:, j]]]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _shallow_tree(g: np.ndarray, h: np.ndarray, splits: int = 3, damp: float = 2.0, least: float = 5.0) -> np.ndarray:
    """Step per bin of a tree with a few splits along the bins, by Newton gains. ``g``, ``h``: gradient and curvature per bin."""
    parts = [(0, len(g))]
    gain_of = lambda a, b: a * a / (b + damp)
    for _ in range(splits):
        best = (1e-9, None, None)
        for p, (lo, hi) in enumerate(parts):
            if hi - lo < 2:
                continue
            G, H = np.cumsum(g[lo:hi]), np.cumsum(h[lo:hi])
            left_g, left_h = G[:-1], H[:-1]
            right_g, right_h = G[-1] - left_g, H[-1] - left_h
            gain = gain_of(left_g, left_h) + gain_of(right_g, right_h) - gain_of(G[-1], H[-1])
            gain[(left_h < least / 25) | (right_h < least / 25)] = 0
            at = int(gain.argmax())
            if gain[at] > best[0]:
                best = (gain[at], p, lo + at + 1)
        if best[1] is None:
            break
        lo, hi = parts[best[1]]
        parts[best[1] : best[1] + 1] = [(lo, best[2]), (best[2], hi)]
    out = np.zeros(len(g))
    for lo, hi in parts:
        out[lo:hi] = g[lo:hi].sum() / (h[lo:hi].sum() + damp)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, damp: float = 2.0) -> tuple[np.ndarray, float]:
    """The best step that cuts each of two features once, and its gain."""
    G = np.pad(g.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    H = np.pad(h.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    i, j = np.meshgrid(np.arange(1, g.shape[0]), np.arange(1, g.shape[1]), indexing="ij")
    part = lambda c: (c[i, j], c[i, -1] - c[i, j], c[-1, j] - c[i, j], c[-1, -1] - c[i, -1] - c[-1, j] + c[i, j])
    gs, hs = part(G), part(H)
    gain = sum(a * a / (b + damp) for a, b in zip(gs, hs, strict=True)) - G[-1, -1] ** 2 / (H[-1, -1] + damp)
    if not gain.size:
        return np.zeros_like(g), 0.0
    at = np.unravel_index(gain.argmax(), gain.shape)
    out = np.zeros_like(g)
    x, y = at[0] + 1, at[1] + 1
    step = [a[at] / (b[at] + damp) for a, b in zip(gs, hs, strict=True)]
    out[:x, :y], out[:x, y:], out[x:, :y], out[x:, y:] = step
    return out, float(gain[at])


def fit(x: np.ndarray, y: np.ndarray, bins: int = BINS, rounds: int = ROUNDS, rate: float = RATE, n_pairs: int = PAIRS) -> Model:
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(x.shape[1])]
    model = Model(edges, [np.zeros(len(e) + 1) for e in edges], [], [], [], float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))))
    b = model.bins(x)
    z = np.full(len(y), model.base)
    slope = lambda: ((d := y - (p := 1 / (1 + np.exp(-z)))), np.maximum(p * (1 - p), 1e-6), d)[:2]
    for _ in range(rounds):
        for k, t in enumerate(model.tables):
            g, h = slope()
            step = rate * _shallow_tree(np.bincount(b[:, k], g, len(t)), np.bincount(b[:, k], h, len(t)))
            t += step
            z += step[b[:, k]]
    model.coarse = [np.minimum(np.arange(len(t)) * COARSE // len(t), COARSE - 1) for t in model.tables]
    c = np.stack([m[b[:, k]] for k, m in enumerate(model.coarse)], axis=1)
    grid = lambda i, j, w: np.bincount(c[:, i] * COARSE + c[:, j], w, COARSE * COARSE).reshape(COARSE, COARSE)
    g, h = slope()
    gains = {(i, j): _quadrants(grid(i, j, g), grid(i, j, h))[1] for i in range(x.shape[1]) for j in range(i)}
    model.pairs = sorted(gains, key=lambda p: (-gains[p], p))[:n_pairs]
    model.pair_tables = [np.zeros((COARSE, COARSE)) for _ in model.pairs]
    for _ in range(rounds // 3):
        for (i, j), t in zip(model.pairs, model.pair_tables, strict=True):
            g, h = slope()
            step = rate * _quadrants(grid(i, j, g), grid(i, j, h))[0]
            t += step
            z += step[c[:, i], c[:, j]]
    return model


def learn(docs: DataFrame, labels: DataFrame, may_learn: Column | None = None, label: str = "quality", most_rows: int = SAMPLE_ROWS) -> Model | None:
    sample = labelled_sample(docs, labels, label, may_learn, most_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch.column("text"))
            yield pa.RecordBatch.from_arrays([pa.array(list(x.astype(np.float64)), pa.list_(pa.float64())), batch.column("y")], names=["x", "y"])

    rows = sample.mapInArrow(run, "x array<double>, y int").toPandas()
    if not len(rows):
        return None
    x = np.stack(rows["x"].to_numpy())
    order = np.lexsort(x.T)  # the order of rows must not matter
    return fit(x[order], rows["y"].to_numpy(np.float64)[order])


def score(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, score, predicted``"""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = sent.value.scores(features(batch.column("text"))) if sent.value else np.ones(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, predicted int")


def keep_good(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows, as they are, of documents that the model doesn't reject."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = sent.value.scores(features(batch.column("text"))) if sent.value else np.ones(batch.num_rows)
            yield batch.filter(pa.array(s >= threshold))

    return docs.mapInArrow(run, docs.schema)


