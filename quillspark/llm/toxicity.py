"""Toxicity: a linear classifier of character n-grams, scaled by naive Bayes log-count ratios.

A feature is whether a text holds an n-gram (3 to 5 characters, lower case, everything but letters and digits a space).
Its scale is the log of how much more often toxic texts hold it than others; a logistic regression with an L2 penalty
weighs the scaled features. N-grams are hashed into 2**CELL_BITS cells. A cell takes part if the shares of texts that hold it differ
between the classes by more than sqrt(2 ln m) standard errors, m being the number of cells seen: about the largest difference
that chance alone would show among so many. There is no limit on how many pass.

Defined cases: a null or empty text has no n-gram and gets the score of the intercept; repeated rows get a row
each; without labels to learn from every score is 0; an empty table gives an empty table; extra columns are ignored, or
pass through :func:`keep_clean`. At most ``SAMPLE_ROWS`` labelled rows are learnt from, one for each doc_id. Texts are read whole, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, spans, written
from .labelled import labelled_sample

SAMPLE_ROWS, CELL_BITS, ORDERS, SMOOTH, PENALTY, STEPS, THRESHOLD = 30_000, 20, (3, 4, 5), 1.0, 2.0, 300, 0.5
#: The fit ends when so many steps lower the loss by less than this share; its sums go over so many cells of rows at once.
PATIENCE, LEAST_GAIN, PART = 10, 1e-5, 1 << 21
#: Characters, and texts, worked on at once.
BLOCK_CHARS, TEXTS = 1 << 18, 256
_TO_SPACE = np.arange(128, dtype=np.uint32)
_TO_SPACE[[c for c in range(128) if not chr(c).isalnum()]] = 32
_MULTIPLY = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)
_LAST = np.uint64(0x94D049BB133111EB)
_SHIFT = np.uint64(64 - CELL_BITS)


def _blocks(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of each part, its end, characters) of texts in blocks; a long text comes in parts that overlap by the longest n-gram."""
    rows, parts, held = [], [], 0
    for i, t in enumerate(texts):
        t = f" {(t or '').lower()} "
        for at in range(0, len(t), BLOCK_CHARS):
            part = t[at : at + BLOCK_CHARS + max(ORDERS) - 1]
            rows.append((i, len(part)))
            parts.append(part)
            held += len(part)
            if held >= BLOCK_CHARS:
                yield _codes(rows, parts)
                rows, parts, held = [], [], 0
    if parts:
        yield _codes(rows, parts)


def _codes(rows, parts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    c = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.where(c < 128, _TO_SPACE[np.minimum(c, 127)], c)
    i, n = np.array(rows).T
    return i, np.cumsum(n), c.astype(np.uint64)


def _grams(c: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(n, cell of the n-gram that begins at each character) for each order; longer ones go on from shorter ones."""
    h = np.zeros(len(c), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        m = len(c) - n + 1
        if m <= 0:
            return
        h = (h[:m] + c[n - 1 :]) * _MULTIPLY[n - 1]
        h ^= h >> np.uint64(29)
        if n in ORDERS:
            yield n, ((h * _LAST) >> _SHIFT).astype(np.int32)


def cells(texts: list[str | None], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (row, cell) of texts; of all cells or those that ``wanted`` flags."""
    out = [np.zeros(0, np.int64)]
    for row, edge, c in _blocks(texts):
        if wanted is not None:
            for n, cell in _grams(c):
                at = np.flatnonzero(wanted[cell])
                part = np.searchsorted(edge, at, "right")
                inside = at + n <= edge[part]  # n-grams must not run from one part into the next
                out.append(row[part[inside]].astype(np.int64) << CELL_BITS | cell[at[inside]])
            continue
        grams = list(_grams(c))
        for i, lo, hi in zip(row.tolist(), np.concatenate([[0], edge[:-1]]).tolist(), edge.tolist(), strict=True):
            own = np.sort(np.concatenate([cell[lo : max(lo, hi - n + 1)] for n, cell in grams] or [np.zeros(0, np.int32)]))
            first = np.ones(len(own), bool)
            np.not_equal(own[1:], own[:-1], out=first[1:])
            out.append(i << CELL_BITS | own[first].astype(np.int64))
    key = np.concatenate(out)
    if wanted is not None or (key[1:] <= key[:-1]).any():
        key = np.unique(key)
    return key >> CELL_BITS, key & ((1 << CELL_BITS) - 1)


@dataclass
class Model:
    wanted: np.ndarray
    weight: np.ndarray  # of each cell
    intercept: float

    def scores(self, column: pa.Array) -> np.ndarray:
        z = np.full(len(column), self.intercept)
        for lo in range(0, len(column), TEXTS):
            texts = column.slice(lo, TEXTS).to_pylist()
            row, cell = cells(texts, self.wanted)
            z[lo : lo + TEXTS] += np.bincount(row, self.weight[cell], len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _runs(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs that aren't empty, and where they begin, as reduceat wants them."""
    some = np.flatnonzero(offsets[1:] > offsets[:-1])
    return some, offsets[some]


def _sums(values: np.ndarray, runs: tuple[np.ndarray, np.ndarray], n: int) -> np.ndarray:
    out = np.zeros(n)
    if len(values):
        out[runs[0]] = np.add.reduceat(values, runs[1])
    return out


class _Rows:
    """Texts as runs of features. Products with weights go part by part, so that temporary arrays stay small; a part is kept by text and by feature."""

    def __init__(self, offsets: np.ndarray, feature: np.ndarray, ratio: np.ndarray):
        self.m, self.ratio, self.parts = len(ratio), ratio, []
        for lo, hi in spans(offsets, PART):
            own = feature[offsets[lo] : offsets[hi]]
            row = np.repeat(np.arange(hi - lo, dtype=np.min_scalar_type(hi - lo)), np.diff(offsets[lo : hi + 1]))
            by_feature = row[np.argsort(own, kind="stable")]
            cut = np.concatenate([[0], np.cumsum(np.bincount(own, minlength=self.m))])
            self.parts.append((lo, hi, own, _runs(offsets[lo : hi + 1] - offsets[lo]), by_feature, _runs(cut)))

    def _times(self, own: np.ndarray) -> np.ndarray:
        return np.concatenate([_sums(own[feature], runs, hi - lo) for lo, hi, feature, runs, _, _ in self.parts] or [np.zeros(0)])

    def times(self, weight: np.ndarray) -> np.ndarray:
        """Of each text the sum of its scaled features' weights."""
        return self._times(weight * self.ratio)

    def back(self, d: np.ndarray) -> np.ndarray:
        """Of each feature the sum of its texts' ``d``, scaled."""
        return self.ratio * sum((_sums(d[lo:hi][row], runs, self.m) for lo, hi, _, _, row, runs in self.parts), np.zeros(self.m))

    def longest(self) -> float:
        return float(self._times(self.ratio**2).max(initial=0))


def _fit(x: _Rows, y: np.ndarray, penalty: float, steps: int) -> tuple[np.ndarray, float]:
    """Logistic regression on scaled features, by accelerated gradient steps with restarts."""
    n = len(y)
    curve = 0.25 * max(1.0, x.longest()) * n / 4 + penalty
    w, b = np.zeros(x.m), float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
    at_w, at_b, t = w.copy(), b, 1.0
    rate, last, losses = 16 / curve, np.inf, []
    for _ in range(steps):
        z = x.times(at_w) + at_b
        loss = float(np.logaddexp(0, z).sum() - (y * z).sum() + 0.5 * penalty * (at_w @ at_w))
        if loss > last * (1 + 1e-9):
            rate, t, at_w, at_b = rate / 2, 1.0, w.copy(), b
            last = np.inf
            continue
        last = loss
        losses.append(loss)
        if len(losses) > PATIENCE and losses[-1 - PATIENCE] - loss < LEAST_GAIN * loss:
            break
        d = 1 / (1 + np.exp(-z)) - y
        new_w = at_w - rate * (x.back(d) + penalty * at_w)
        new_b = at_b - min(4.0 / n, 100 * rate) * float(d.sum())
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        at_w, at_b = new_w + (t - 1) / s * (new_w - w), new_b + (t - 1) / s * (new_b - b)
        w, b, t = new_w, new_b, s
    return w, b


def learn(docs: DataFrame, labels: DataFrame, may_learn: Column | None = None, label: str = "toxic", most_rows: int = SAMPLE_ROWS) -> Model | None:
    sample = labelled_sample(docs, labels, label, may_learn, most_rows)
    size = 1 << CELL_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, size), np.int32)
        for batch in batches:
            y = batch.column("y").to_numpy()
            for lo in range(0, batch.num_rows, TEXTS):
                row, cell = cells(batch.column("text").slice(lo, TEXTS).to_pylist())
                held += np.bincount(y[lo + row] * size + cell, minlength=2 * size).reshape(2, size).astype(np.int32)
        some = np.flatnonzero(held.sum(0))
        for lo in range(0, len(some), 1 << 16):
            part = some[lo : lo + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(held[0][part].astype(np.int64)), pa.array(held[1][part].astype(np.int64))], names=["cell", "clean", "toxic"])

    totals = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    clean_n, toxic_n = totals.get(0, 0), totals.get(1, 0)
    if not clean_n or not toxic_n:
        return None
    # all cells seen, 2**CELL_BITS at most
    counted = sample.mapInArrow(count, "cell long, clean long, toxic long").groupBy("cell").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counted = written(counted, "toxic-cells")
    seen = counted.count()
    share = (F.col("clean") + F.col("toxic")) / float(clean_n + toxic_n)
    error = F.sqrt(share * (1 - share) * (1.0 / clean_n + 1.0 / toxic_n)) + 1e-9
    z = F.abs(F.col("toxic") / float(toxic_n) - F.col("clean") / float(clean_n)) / error
    top = counted.where(z > float(np.sqrt(2 * np.log(max(seen, 2))))).toPandas().sort_values("cell")
    discard(counted)
    chosen = top["cell"].to_numpy(np.int64)
    wanted = np.zeros(size, bool)
    wanted[chosen] = True
    place = np.zeros(size, np.min_scalar_type(len(chosen)))
    place[chosen] = np.arange(len(chosen))
    sent = docs.sparkSession.sparkContext.broadcast((wanted, place))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, place = sent.value
        for batch in batches:
            lists = []
            for lo in range(0, batch.num_rows, TEXTS):
                part = batch.column("text").slice(lo, TEXTS).to_pylist()
                row, cell = cells(part, wanted)
                lists += np.split(place[cell], np.searchsorted(row, np.arange(1, len(part))))
            yield pa.RecordBatch.from_arrays([batch.column("y"), batch.column("h"), pa.array([x.tobytes() for x in lists], pa.binary())], names=["y", "h", "features"])

    rows = sample.select("text", "y", F.xxhash64("text").alias("h")).mapInArrow(find, "y int, h long, features binary").toArrow()
    # in one order always: by the text, then the label
    order = np.lexsort((rows.column("y").to_numpy(), rows.column("h").to_numpy()))
    y = rows.column("y").to_numpy().astype(np.float64)[order]
    length = pc.binary_length(rows.column("features")).to_numpy()[order] // place.itemsize
    offsets = np.concatenate([[0], np.cumsum(length, dtype=np.int64)])
    feature = np.empty(offsets[-1], place.dtype)
    column = rows.column("features")
    for k, i in enumerate(order.tolist()):
        feature[offsets[k] : offsets[k + 1]] = np.frombuffer(column[i].as_buffer(), place.dtype)
    del rows, column
    discard(sample)
    p, q = top["toxic"].to_numpy(np.float64) + SMOOTH, top["clean"].to_numpy(np.float64) + SMOOTH
    ratio = np.log((p / p.sum()) / (q / q.sum()))
    w, b = _fit(_Rows(offsets, feature, ratio), y, PENALTY, STEPS)
    weight = np.zeros(size)
    weight[chosen] = w * ratio
    return Model(wanted, weight, b)


def score(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, score, predicted``"""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = sent.value.scores(batch.column("text")) if sent.value else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, predicted int")


def keep_clean(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows, as they are, of documents that the model doesn't reject."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = sent.value.scores(batch.column("text")) if sent.value else np.zeros(batch.num_rows)
            yield batch.filter(pa.array(s < threshold))

    return docs.mapInArrow(run, docs.schema)
