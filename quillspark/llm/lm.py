"""Language-model scoring with a gated recurrent network in numpy.

Words are counted over all training texts. The most frequent ones are the network's vocabulary, cut by rank into classes:
p(word | state) = p(class | state) * p(word | class, state). All other words share one more class; inside it a word has
its smoothed share of that class's counts, so the scores are a distribution over all words seen, and one for the unseen.

The network (a GRU) learns by truncated backpropagation: first from a small sample in one task, and then in every task from that
start on the task's share of all training documents, after which the weights are averaged. Scoring runs documents side by side in streams and carries the state from
window to window, so a document's log-likelihood covers all of it.

Defined cases: a null or empty text is one end token; repeated rows get a row each and all count; without training
documents every word is unseen and the score equals that of the counts; an empty table gives an empty table; extra
columns are ignored. Every task learns from its own splits of the input, so scores repeat exactly where the splits do; over other
splits the averaged network, and with it the last digits of ``score``, differs. Texts are scored whole, however long.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import most_frequent, small_batches, spans, utf8, written
from .words import word_hashes

#: Network: words, classes, state. Known: words whose counts go to all executors; the rest are joined.
VOCABULARY, CLASSES, STATE, KNOWN, LOOK_BITS = 8192, 64, 16, 1 << 18, 20
SLOTS, WINDOW, TRAIN_SLOTS, TRAIN_WINDOW, RATE, FLUSH, BATCH_ROWS = 256, 64, 64, 32, 0.08, 2_000_000, 3000
#: Documents of the first sample, which gives all tasks one start.
FIRST_DOCUMENTS, CHUNK = 600, 8192
END = np.uint64(0x9D5F3C1B7A2E4680)


@dataclass
class Words:
    """The known words' hashes (sorted), logarithms of (count + 0.5) and ids in the network."""

    hashes: np.ndarray
    log_count: np.ndarray
    ids: np.ndarray
    bounds: np.ndarray  # class c has the ids bounds[c] up to bounds[c + 1]
    counts: np.ndarray  # of the vocabulary, by id
    total: int = 0
    distinct: int = 0
    begins: np.ndarray | None = None  # made where it is used

    @property
    def tail(self) -> int:
        """The id of all words outside the vocabulary."""
        return int(self.bounds[-1])

    def log_all(self) -> float:
        return float(np.log10(self.total + 0.5 * (self.distinct + 1)))

    def log_tail(self) -> float:
        return float(np.log10(self.total - int(self.counts.sum()) + 0.5 * (self.distinct - len(self.counts) + 1)))

    def look(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each hash: its place among the known words, and whether it is one."""
        if not len(self.hashes):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        if self.begins is None:  # by the upper bits of a hash: how many known hashes stand before those with the same bits
            edges = np.arange(1 << LOOK_BITS, dtype=np.uint64) << np.uint64(64 - LOOK_BITS)
            self.begins = np.searchsorted(self.hashes, edges).astype(np.int32)
        at = self.begins[(h >> np.uint64(64 - LOOK_BITS)).astype(np.int64)].astype(np.int64)
        last = len(self.hashes) - 1
        todo = np.flatnonzero(self.hashes[np.minimum(at, last)] < h)
        while len(todo):
            at[todo] += 1
            todo = todo[at[todo] <= last]
            todo = todo[self.hashes[at[todo]] < h[todo]]
        at = np.minimum(at, last)
        return at, self.hashes[at] == h

    def __getstate__(self) -> dict:
        return self.__dict__ | {"begins": None}


@dataclass
class Net:
    words_in: np.ndarray  # a row per id: what it adds to the gates
    gates: np.ndarray
    class_out: np.ndarray
    class_bias: np.ndarray
    word_out: np.ndarray
    word_bias: np.ndarray
    squares: dict = field(default_factory=dict)

    NAMES = ("words_in", "gates", "class_out", "class_bias", "word_out", "word_bias")

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, n).ravel() for n in self.NAMES]).astype(np.float32)

    def filled(self, flat: np.ndarray) -> Net:
        out, at = {}, 0
        for n in self.NAMES:
            a = getattr(self, n)
            out[n] = flat[at : at + a.size].reshape(a.shape).astype(np.float32)
            at += a.size
        return Net(**out)


def class_bounds(counts: np.ndarray, classes: int) -> np.ndarray:
    """Where classes of words (by falling count) begin: each has a like share of the square roots of counts, so frequent words stand in small classes."""
    n = len(counts)
    share = np.cumsum(np.sqrt(counts + 0.5))
    cut = np.searchsorted(share, share[-1] * np.arange(1, classes) / classes, "right") if n else np.zeros(0, np.int64)
    return np.unique(np.concatenate([[0], cut, [n]]).astype(np.int64))


def fresh(words: Words, state: int = STATE) -> Net:
    rng = np.random.default_rng(7)
    n, c = words.tail + 1, len(words.bounds)
    small = lambda *s: (rng.standard_normal(s) * 0.1).astype(np.float32)
    mass = np.array([*(words.counts[a:b].sum() for a, b in zip(words.bounds[:-1], words.bounds[1:], strict=True)), words.total - words.counts.sum()]) + 0.5
    return Net(small(n, 3 * state), small(state, 3 * state), small(c, state), np.log(mass / mass.sum()).astype(np.float32), small(n, state), np.append(np.log(words.counts + 0.5), 0).astype(np.float32))


def _halved(x: np.ndarray, size: int) -> np.ndarray:
    """A copy with what goes into the two gates halved: a sigmoid of x is half the tanh of x / 2, and a half."""
    x = x.copy()
    x[..., : 2 * size] *= 0.5
    return x


def _gates(a: np.ndarray, given: np.ndarray, size: int, out: np.ndarray | None = None) -> np.ndarray:
    g = np.add(a[:, : 2 * size], given[:, : 2 * size], out=out)
    np.tanh(g, out=g)
    g *= 0.5
    g += 0.5
    return g


def _exponentials(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | float]:
    """exp(x - m), its sums over rows, and m: the largest of all, or of each row where that would lose a row's digits."""
    m = x.max(initial=-np.inf)
    e = x - m
    np.exp(e, out=e)
    sums = e @ np.ones(x.shape[1], x.dtype)
    if len(x) and sums.min() < 1e-20:
        m = x.max(1, keepdims=True)
        e = np.exp(x - m)
        sums = e @ np.ones(x.shape[1], x.dtype)
        m = m[:, 0]
    return e, sums, m


def _log_sum(x: np.ndarray) -> np.ndarray:
    _, sums, m = _exponentials(x)
    return m + np.log(sums)


def _small_log_sum(x: np.ndarray) -> np.ndarray:
    """Of numbers whose exponentials neither overflow nor vanish."""
    e = np.exp(x)
    return np.log(e @ np.ones(x.shape[1], x.dtype))


def _softmax(x: np.ndarray, scale: float = 1.0) -> np.ndarray:
    """Of each row, times ``scale``."""
    e, sums, _ = _exponentials(x)
    e *= (scale / sums)[:, None]
    return e


class Streams:
    """Documents side by side: ``slots`` streams, the longest first; at step t the first ``active(t)`` streams have a token."""

    def __init__(self, ids: np.ndarray, offsets: np.ndarray, slots: int):
        lengths = np.diff(offsets)
        heap = [(0, s) for s in range(min(slots, len(lengths)))]
        mine: list[list[int]] = [[] for _ in heap]
        for d in np.argsort(-lengths, kind="stable").tolist():
            load, s = heapq.heappop(heap)
            mine[s].append(d)
            heapq.heappush(heap, (load + int(lengths[d]), s))
        loads = np.array([sum(int(lengths[d]) for d in m) for m in mine], np.int64)
        order = np.argsort(-loads, kind="stable")
        self.loads = loads[order]
        self.ids, self.docs, self.begins = [], [], []
        for s in order:
            docs = np.array(mine[s], np.int64)
            n = lengths[docs]
            self.docs.append(np.repeat(docs, n))
            first = np.cumsum(n) - n
            self.ids.append(ids[np.arange(n.sum()) - np.repeat(first, n) + np.repeat(offsets[docs], n)])
            b = np.zeros(int(n.sum()), bool)
            b[first] = True
            self.begins.append(b)

    def windows(self, size: int):
        """(ids, documents, begins, active streams of each step), each of steps x streams; idle places hold document -1."""
        steps = int(self.loads[0]) if len(self.loads) else 0
        for lo in range(0, steps, size):
            live = int((self.loads > lo).sum())
            n = min(size, steps - lo)
            ids, docs, begins = np.zeros((n, live), np.int64), np.full((n, live), -1, np.int64), np.zeros((n, live), bool)
            for s in range(live):
                m = min(n, int(self.loads[s]) - lo)
                ids[:m, s], docs[:m, s], begins[:m, s] = self.ids[s][lo : lo + m], self.docs[s][lo : lo + m], self.begins[s][lo : lo + m]
            yield ids, docs, begins, (docs >= 0).sum(1)


def log_likelihoods(net: Net, words: Words, ids: np.ndarray, offsets: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """log10 probability of each row of ids under the network; the tail id counts as one outcome."""
    out = np.zeros(len(offsets) - 1)
    streams = Streams(ids, offsets, slots)
    size = net.gates.shape[0]
    h, gates = np.zeros((len(streams.loads), size), np.float32), _halved(net.gates, size)
    bounds, at = words.bounds.tolist(), np.arange(len(streams.loads) * WINDOW)
    classes = np.arange(len(bounds)).astype(np.min_scalar_type(len(bounds)))  # short keys are sorted by their digits
    class_of = np.append(np.repeat(classes[:-1], np.diff(words.bounds)), classes[-1])
    largest = max((np.abs(w).sum(1) + np.abs(b)).max(initial=0) for w, b in ((net.class_out, net.class_bias), (net.word_out, net.word_bias)))
    log_sum = _small_log_sum if largest < 60 else _log_sum  # states lie within -1 and 1
    for target, docs, begins, active in streams.windows(WINDOW):
        n, live = target.shape
        before = np.zeros((n, live, size), np.float32)
        h = h[:live]
        given, new_doc = _halved(net.words_in[target], size), begins.any(1)
        for t in range(n):
            k = active[t]
            x = h[:k]
            if new_doc[t]:
                x[begins[t, :k]] = 0
            before[t, :k] = x
            a = x @ gates
            g = _gates(a, given[t, :k], size)
            new = g[:, size:] * a[:, 2 * size :]
            new += given[t, :k, 2 * size :]
            np.tanh(new, out=new)
            x -= new
            x *= g[:, :size]
            x += new
        some = docs.ravel() >= 0
        y = target.ravel()[some]
        kind = class_of[y]
        order = np.argsort(kind, kind="stable")  # a class's rows stand together
        x, y, kind, d = before.reshape(-1, size)[some][order], y[order], kind[order], docs.ravel()[some][order]
        logit = x @ net.class_out.T
        logit += net.class_bias
        p = (logit[at[: len(y)], kind] - log_sum(logit)).astype(np.float64)
        place, cuts = y - words.bounds[kind], np.searchsorted(kind, classes).tolist()
        for c in range(len(bounds) - 1):
            first, last, lo, hi = cuts[c], cuts[c + 1], bounds[c], bounds[c + 1]
            if last > first:
                logit = x[first:last] @ net.word_out[lo:hi].T
                logit += net.word_bias[lo:hi]
                p[first:last] += logit[at[: last - first], place[first:last]] - log_sum(logit)
        out += np.bincount(d, p, len(out))
    return out / np.log(10)


def train(net: Net, words: Words, ids: np.ndarray, offsets: np.ndarray, rate: float = RATE, slots: int = TRAIN_SLOTS) -> None:
    """One pass of truncated backpropagation over rows of ids, with AdaGrad steps. The state is carried on, gradients are not."""
    size = net.gates.shape[0]
    for n in Net.NAMES:
        net.squares.setdefault(n, np.full(getattr(net, n).shape if n not in ("words_in",) else (len(net.words_in), 1), 0.1, np.float32))
    streams = Streams(ids, offsets, slots)
    h = np.zeros((len(streams.loads), size), np.float32)
    classes = len(words.bounds) - 1
    bounds, at = words.bounds.tolist(), np.arange(len(streams.loads) * TRAIN_WINDOW)
    small = np.min_scalar_type(max(words.tail, classes))  # short keys are sorted by their digits
    ones = np.ones(max(len(streams.loads) * TRAIN_WINDOW, words.tail), np.float32)
    # the words' layer and, as its last column, its bias: one product gives both
    layer = np.column_stack([net.word_out, net.word_bias])
    square, grad_out, room = np.column_stack([net.squares["word_out"], net.squares["word_bias"]]), np.empty_like(layer), 0.0
    for target, docs, begins, _ in streams.windows(TRAIN_WINDOW):
        n, live = target.shape
        h = h[:live]
        gates, given = _halved(net.gates, size), _halved(net.words_in[target], size)
        keep = (~begins)[:, :, None].astype(np.float32)
        real = (docs >= 0)
        before, gate, new, acts = (np.empty((n, live, m), np.float32) for m in (size, 2 * size, size, 3 * size))
        rec = acts[:, :, 2 * size :]
        for t in range(n):
            x, g, y = before[t], gate[t], new[t]
            np.multiply(h, keep[t], out=x)
            a = np.matmul(x, gates, out=acts[t])
            _gates(a, given[t], size, g)
            np.multiply(g[:, size:], a[:, 2 * size :], out=y)
            y += given[t, :, 2 * size :]
            np.tanh(y, out=y)
            h = x - y
            h *= g[:, :size]
            h += y
        some = np.flatnonzero(real.ravel())
        kind = np.minimum(np.searchsorted(words.bounds, target.ravel()[some], "right") - 1, len(words.bounds) - 1)
        order = np.argsort(kind.astype(small), kind="stable")  # a class's rows stand together
        some, kind = some[order], kind[order]
        x, y = before.reshape(-1, size)[some], target.ravel()[some]
        scale = np.float32(1 / len(some))
        # output layer
        logit = x @ net.class_out.T
        logit += net.class_bias
        d = _softmax(logit, scale)
        d[at[: len(y)], kind] -= scale
        dx = d @ net.class_out
        _step(net, "class_out", slice(None), d.T @ x, rate)
        _step(net, "class_bias", slice(None), ones[: len(d)] @ d, rate)
        # the words' layer: classes share no words, so all of them take one step together
        cut = np.searchsorted(kind, np.arange(classes + 1))
        place = y - words.bounds[kind]
        wide = np.column_stack([x, ones[: len(x)]])
        grad_out.fill(0)
        if room < 1:  # a step moves a number by no more than the rate, so this holds for some windows
            room = (60 - float(np.abs(layer).sum(1).max(initial=0))) / ((size + 1) * rate)
        small_logits = room > 0  # states lie within -1 and 1, so no exponential overflows
        room -= 1
        cuts = cut.tolist()
        for c in np.flatnonzero(cut[1:] > cut[:-1]).tolist():
            first, last, lo, hi = cuts[c], cuts[c + 1], bounds[c], bounds[c + 1]
            xr, out = wide[first:last], layer[lo:hi]
            d = xr @ out.T
            if small_logits:
                np.exp(d, out=d)
                d *= (scale / (d @ ones[: hi - lo]))[:, None]
            else:
                d = _softmax(d, scale)
            d[at[: last - first], place[first:last]] -= scale
            dx[first:last] += (d @ out)[:, :size]
            np.matmul(d.T, xr, out=grad_out[lo:hi])
        _adagrad(layer, square, grad_out, rate)
        # back through the window
        d_out = np.zeros((n * live, size), np.float32)
        d_out[some] = dx
        d_out = d_out.reshape(n, live, size)
        d_given, d_rec = np.zeros((n, live, 3 * size), np.float32), np.zeros((n, live, 3 * size), np.float32)
        z, r = gate[:, :, :size], gate[:, :, size:]
        to_new, to_z, to_r = (1 - z) * (1 - new**2), (before - new) * z * (1 - z), rec * r * (1 - r)
        there, back = real[:, :, None].astype(np.float32), np.ascontiguousarray(net.gates.T)
        dh = np.zeros((live, size), np.float32)
        for t in range(n - 1, -1, -1):
            dh *= there[t]
            g, b = d_given[t], d_rec[t]
            np.multiply(dh, to_z[t], out=g[:, :size])
            np.multiply(dh, to_new[t], out=g[:, 2 * size :])
            np.multiply(g[:, 2 * size :], to_r[t], out=g[:, size : 2 * size])
            b[:, : 2 * size] = g[:, : 2 * size]
            np.multiply(g[:, 2 * size :], r[t], out=b[:, 2 * size :])
            dh = (d_out[t] + dh * z[t] + b @ back) * keep[t]
        grad = before.reshape(-1, size).T @ d_rec.reshape(-1, 3 * size)
        norm = float(np.sqrt((grad**2).sum()))
        _step(net, "gates", slice(None), grad * min(1.0, 1.0 / max(norm, 1e-9)), rate)
        order = np.argsort(y.astype(small), kind="stable")
        y = y[order]
        first = np.flatnonzero(np.concatenate([[True], y[1:] != y[:-1]]))
        _step(net, "words_in", y[first], np.add.reduceat(d_given.reshape(-1, 3 * size)[some[order]], first), rate)
    net.word_out[:], net.word_bias[:] = layer[:, :size], layer[:, size]
    net.squares["word_out"], net.squares["word_bias"] = square[:, :size].copy(), square[:, size].copy()


def _adagrad(a: np.ndarray, square: np.ndarray, grad: np.ndarray, rate: float) -> None:
    """A step of all numbers of ``a``, which uses up ``grad``."""
    grad *= 100  # as in _step
    square += grad * grad
    grad /= np.sqrt(square)
    grad *= rate
    a -= grad


def _step(net: Net, name: str, where, grad: np.ndarray, rate: float) -> None:
    """An AdaGrad step, which uses up ``grad``; there is a square for each number, or one for each row."""
    sq, a = net.squares[name], getattr(net, name)
    grad *= 100  # so that the first squares of 0.1 don't swamp what a batch's mean gives
    new = sq[where]  # a copy where rows are listed
    new += grad * grad if sq.shape == a.shape else np.einsum("ij,ij->i", grad, grad)[:, None] / grad.shape[1]
    if not isinstance(where, slice):
        sq[where] = new
    grad /= np.sqrt(new)
    grad *= rate
    a[where] -= grad


def _token_ids(text, words: Words):
    """For runs of rows: (first row, ids, offsets with the end token, hashes without it, word offsets, places, known)."""
    raw, at = utf8(text)
    end_at, _ = words.look(np.array([END]))
    end_id = words.ids[end_at[0]] if len(words.ids) else words.tail
    for lo, hi in spans(at, 1 << 25):
        part, cut = raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        hs, sizes = [], []
        for _, offsets, h in word_hashes(part, cut):
            hs.append(h)
            sizes.append(np.diff(offsets))
        h, size = np.concatenate(hs), np.concatenate(sizes)
        off = np.concatenate([[0], np.cumsum(size)])
        place, known = words.look(h)
        word_id = np.where(known, words.ids[place], words.tail) if len(words.ids) else np.full(len(h), words.tail)
        ids = np.insert(word_id, off[1:], end_id)
        yield lo, ids, off + np.arange(len(off)), h, off, place, known


def count_words(docs: DataFrame) -> DataFrame:
    """``word, n``: hashes of all words and the end token, and how often they stand in ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(parts: list[np.ndarray], ends: int) -> pa.RecordBatch:
            h = np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)
            first = np.flatnonzero(np.concatenate([[len(h) > 0], h[1:] != h[:-1]]))
            n = np.diff(np.append(first, len(h)))
            return pa.RecordBatch.from_arrays([pa.array(np.append(h[first], END).view(np.int64)), pa.array(np.append(n, ends))], names=["word", "n"])

        parts, held, ends = [], 0, 0
        for batch in batches:
            raw, at = utf8(batch.column("text"))
            ends += len(at) - 1
            for _, _, h in word_hashes(raw, at):
                parts.append(h)
                held += len(h)
                if held >= FLUSH:
                    yield out(parts, ends)
                    parts, held, ends = [], 0, 0
        if ends or parts:
            yield out(parts, ends)

    return docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def known_words(counts: DataFrame, vocabulary: int = VOCABULARY, classes: int = CLASSES, known: int = KNOWN) -> Words:
    """The most frequent words; bounded by ``known``."""
    total = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    top = most_frequent(counts, known).toPandas().sort_values(["n", "word"], ascending=[False, True], kind="stable")
    h, n = top["word"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)
    in_net = min(vocabulary, len(h))
    rank = np.arange(len(h))
    end = np.flatnonzero(h == END)
    if len(end) and end[0] >= in_net:  # the end token is always one of the network's words
        rank[end[0]], rank[in_net - 1] = in_net - 1, end[0]
    ids = np.where(rank < in_net, rank, in_net)
    by_id = np.zeros(in_net, np.int64)
    by_id[ids[ids < in_net]] = n[ids < in_net]
    bounds = class_bounds(by_id, classes)
    order = np.argsort(h)
    return Words(h[order], np.log10(n[order] + 0.5), ids[order], bounds, by_id, int(total["n"] or 0), int(total["v"]))


def _trained(docs: DataFrame, sent, tasks: int | None) -> Net:
    """Every task trains a copy on its documents; the copies are averaged by their tokens."""
    start: Net = sent.value[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, net = sent.value
        net, seen = net.filled(net.flat()), 0
        for batch in batches:
            for _, ids, offsets, *_ in _token_ids(batch.column("text"), words):
                train(net, words, ids, offsets)
                seen += len(ids)
        if seen:
            flat = net.flat()
            parts = [flat[k : k + CHUNK].tobytes() for k in range(0, len(flat), CHUNK)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([seen] * len(parts), pa.int64()), pa.array(parts, pa.binary())], names=["chunk", "tokens", "weights"])

    def mean(pdf):
        w = pdf["tokens"].to_numpy(np.float64)
        out = np.zeros(len(pdf["weights"].iloc[0]) // 4)
        for part, k in sorted(zip(pdf["weights"], w, strict=True)):
            out += np.frombuffer(part, np.float32) * (k / w.sum())
        pdf = pdf.iloc[:1].copy()
        pdf["weights"] = [out.astype(np.float32).tobytes()]
        return pdf

    rows = docs.select("text")
    if tasks:
        rows = docs.select("text", F.xxhash64("text").alias("h")).repartition(tasks).sortWithinPartitions("h", "text").select("text")  # in one order always
    got = rows.mapInArrow(run, "chunk int, tokens long, weights binary").groupBy("chunk").applyInPandas(mean, "chunk int, tokens long, weights binary").toPandas().sort_values("chunk")
    if not len(got):
        return start
    return start.filled(np.frombuffer(b"".join(got["weights"]), np.float32))


def learn(training: DataFrame, counts: DataFrame) -> tuple[Words, Net]:
    spark = training.sparkSession
    words = known_words(counts)
    net = fresh(words)
    ends = int(10 ** words.log_count[words.look(np.array([END]))[0][0]]) if len(words.hashes) else 0
    if not ends:
        return words, net
    place = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30))
    first = training.where(place < max(1, int((1 << 30) * min(1.0, FIRST_DOCUMENTS / ends))))
    net = _trained(first, spark.sparkContext.broadcast((words, net)), 1)
    return words, _trained(training, spark.sparkContext.broadcast((words, net)), None)


def score(docs: DataFrame, words: Words, net: Net, counts: DataFrame) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``; ``docs`` has ``doc_id, held_out, text``."""
    sent = docs.sparkSession.sparkContext.broadcast((words, net))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, net = sent.value
        end_place, end_known = words.look(np.array([END]))
        for batch in batches:
            for lo, ids, offsets, h, off, place, known in _token_ids(batch.column("text"), words):
                rows = len(off) - 1
                of = np.repeat(np.arange(rows), np.diff(off))
                logs = words.log_count[place] if len(words.hashes) else np.zeros(len(h))
                end_log = float(words.log_count[end_place[0]]) if end_known[0] else float(np.log10(0.5))
                base = np.bincount(of[known], logs[known], rows) + end_log
                in_tail = known & (words.ids[place] == words.tail) if len(words.ids) else known
                tail_base = np.bincount(of[in_tail], logs[in_tail], rows) + (0 if end_known[0] else end_log)
                n_tail = np.bincount(of[~known | in_tail], minlength=rows) + (0 if end_known[0] else 1)
                model = log_likelihoods(net, words, ids, offsets)
                key = np.sort(_pairs(of[~known], h[~known]), order=("row", "word"))
                new = np.ones(len(key), bool)
                new[1:] = key[1:] != key[:-1]
                at = np.flatnonzero(new)
                cut = pa.array(np.searchsorted(key["row"][at], np.arange(rows + 1)), pa.int32())
                times = np.diff(np.append(at, len(key)))
                part = batch.slice(lo, rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(np.diff(off) + 1), pa.array(np.bincount(of[known], minlength=rows) + int(end_known[0])), pa.array(base), pa.array(tail_base), pa.array(n_tail.astype(np.int64)), pa.array(model),
                     pa.ListArray.from_arrays(cut, pa.array(key["word"][at].view(np.int64))), pa.ListArray.from_arrays(cut, pa.array(times.astype(np.int32)))],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "base", "tail_base", "n_tail", "model", "other", "times"],
                )

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, base double, tail_base double, n_tail long, model double, other array<long>, times array<int>")
    scored = written(scored.withColumn("row", F.monotonically_increasing_id()), "lm-scored")
    # words that aren't among the known ones: their counts come by a join
    other = scored.where(F.size("other") > 0).select("row", F.explode(F.arrays_zip("other", "times")).alias("o")).select("row", F.col("o.other").alias("word"), F.col("o.times").alias("times"))
    found = other.join(counts, "word", "left")
    sums = found.groupBy("row").agg(F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(0.5))).alias("more"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("more_known"))
    out = scored.drop("other", "times").join(sums, "row", "left")
    more = F.coalesce("more", F.lit(0.0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).cast("long").alias("n_known"), F.lit(words.total).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * F.lit(words.log_all())).alias("base_score"),
        (F.col("model") + F.col("tail_base") + more - F.col("n_tail") * F.lit(words.log_tail())).alias("score"),
    )


def _pairs(row: np.ndarray, word: np.ndarray) -> np.ndarray:
    out = np.empty(len(row), [("row", np.int64), ("word", np.uint64)])
    out["row"], out["word"] = row, word
    return out


def score_corpus(docs: DataFrame, held_out: Column) -> DataFrame:
    """Learn from the documents that aren't held out, and score them all."""
    docs = docs.select("doc_id", "text", held_out.alias("held_out"))
    training = docs.where(~F.col("held_out"))
    with small_batches(docs.sparkSession, BATCH_ROWS):
        counts = written(count_words(training), "lm-counts")
        words, net = learn(training, counts)
        return score(docs, words, net, counts)
