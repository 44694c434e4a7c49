"""Benchmark decontamination by q-gram lemma filtering.

What counts as a leak: a window of a benchmark item (``window`` bytes, every ``stride`` bytes, and the item's last
window; the whole item if it is shorter) that occurs somewhere in a document with at most ``window // 10`` edits.
Texts are compared as UTF-8 bytes with A-Z in lower case and each run of white space as one space.

A string of w bytes with k edits keeps w - q + 1 - k*q of its q-grams, on diagonals that lie within k of one another.
So the scan looks up every q-gram of a document in the benchmark's index, drops hits in stretches that have too few
of them, counts the rest in overlapping diagonal bands, and verifies the windows that reach the bound by banded
alignment. No window that meets the definition is lost.

An item shorter than ``SHORT`` bytes shares too few q-grams for the bound to say anything; it counts as a leak where it stands as
a whole, without edits, between white space or a text's ends, and is found by its first bytes.

Defined cases: null or empty texts hold no leak and null or empty items are found nowhere; repeated rows are judged each; extra columns pass
through :func:`clean`; an empty benchmark or document table gives an empty report. Documents are scanned whole, in pieces that overlap.
The benchmark goes to the executors in parts of ``PART_BYTES`` at most, whose index takes some 25 bytes a byte, with a pass over
the documents for each part; up to that size one pass does.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import spans, utf8

Q, WINDOW, STRIDE, BAND, SHORT = 8, 64, 8, 8, 32
PART_BYTES, PIECE_BYTES, TABLE_BITS = 12 << 20, 1 << 18, (22, 26)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER[_SPACE] = 32
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _kept(raw: np.ndarray, before_is_space: bool) -> np.ndarray:
    space = _SPACE[raw]
    keep = np.ones(len(raw), bool)
    if len(raw):
        keep[1:] = ~(space[1:] & space[:-1])
        keep[0] = not (space[0] and before_is_space)
    return keep


def normal(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The comparable bytes of rows, and their offsets. White space before a row's first word goes."""
    keep = _kept(raw, True)
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    keep[first] = ~_SPACE[raw[first]]
    at = np.concatenate([[0], np.cumsum(keep)])
    return _LOWER[raw[keep]], at[offsets]


def raw_places(raw: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Of one row: where in ``raw`` the comparable bytes at ``places`` (ascending) stand."""
    out, seen, before = np.zeros(len(places), np.int64), 0, True
    for lo in range(0, len(raw), 1 << 20):
        part = raw[lo : lo + (1 << 20)]
        at = np.flatnonzero(_kept(part, before))
        mine = (places >= seen) & (places < seen + len(at))
        out[mine] = lo + at[places[mine] - seen]
        seen, before = seen + len(at), bool(_SPACE[part[-1]])
    out[places >= seen] = len(raw)
    return out


@dataclass
class Index:
    items: list
    text: np.ndarray  # comparable bytes of all items
    start: np.ndarray
    codes: np.ndarray  # distinct q-grams, sorted
    first: np.ndarray  # of each in the postings
    post_item: np.ndarray
    post_at: np.ndarray
    table: np.ndarray  # flags of the cells that hold a q-gram
    windows: list  # of each item: starts
    short: dict  # by length: (first bytes as numbers, sorted; items; texts) of items below SHORT


def _codes(text: np.ndarray) -> np.ndarray:
    n = len(text) - Q + 1
    return np.ndarray((max(n, 0),), "<u8", np.ascontiguousarray(text), 0, (1,)) if n > 0 else np.zeros(0, np.uint64)


def _cell(codes: np.ndarray, cells: int) -> np.ndarray:
    return ((codes * _MIX) >> np.uint64(65 - cells.bit_length())).astype(np.int64)


def bound(length: int) -> tuple[int, int]:
    """Edits allowed in a window, and q-grams that must be shared then."""
    k = min(length // 10, (length - Q) // Q)
    return k, length - Q + 1 - k * Q


def index(items: list[tuple[object, bytes]]) -> Index | None:
    texts, short = [], {}
    for item, text in items:
        t, _ = normal(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        t = t[: len(t) - 1] if len(t) and t[-1] == 32 else t
        if len(t) >= SHORT:
            texts.append((item, t))
        elif len(t):
            short.setdefault(len(t), []).append((_first_bytes(t, len(t))[0], item, t))
    for n, own in short.items():
        own.sort(key=lambda x: (int(x[0]), x[2].tobytes()))
        short[n] = np.array([x[0] for x in own], np.uint64), [x[1] for x in own], [x[2] for x in own]
    if not texts and not short:
        return None
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    start = np.concatenate([[0], np.cumsum([len(t) for _, t in texts], dtype=np.int64)])
    codes = join([_codes(t) for _, t in texts], np.uint64)
    item = join([np.full(len(t) - Q + 1, i, np.int32) for i, (_, t) in enumerate(texts)], np.int32)
    at = join([np.arange(len(t) - Q + 1, dtype=np.int32) for _, t in texts], np.int32)
    order = np.argsort(codes, kind="stable")
    distinct, first = np.unique(codes[order], return_index=True)
    low, high = TABLE_BITS
    table = np.zeros(1 << min(high, max(low, (8 * len(distinct)).bit_length())), bool)
    table[_cell(distinct, len(table))] = True
    windows = []
    for _, t in texts:
        last = max(0, len(t) - WINDOW)
        windows.append(np.unique(np.append(np.arange(0, last + 1, STRIDE), last)))
    return Index([i for i, _ in texts], join([t for _, t in texts], np.uint8), start, distinct, np.append(first, len(order)).astype(np.int32), item[order], at[order], table, windows, short)


def _first_bytes(text: np.ndarray, n: int) -> np.ndarray:
    """At each place the next bytes, n or eight, as one number; beyond the end they are zero."""
    codes = _codes(np.concatenate([text, np.zeros(Q - 1, np.uint8)]))
    return codes if n >= Q else codes & np.uint64((1 << 8 * n) - 1)


def scan_short(ix: Index, doc: np.ndarray, offsets: np.ndarray):
    """(row, item of ``short``, start, end) of the short items that stand in comparable rows."""
    found = []
    inner = np.zeros(len(doc) + 1, bool)
    inner[offsets] = True
    for n, (codes, _, texts) in ix.short.items():
        if len(doc) < n:
            continue
        own = _first_bytes(doc, n)[: len(doc) - n + 1]
        begins = np.flatnonzero(np.concatenate([[True], doc[:-1] == 32])[: len(own)] | inner[: len(own)])
        after = begins + n
        begins = begins[inner[after] | (doc[np.minimum(after, len(doc) - 1)] == 32)]
        lo, hi = np.searchsorted(codes, own[begins]), np.searchsorted(codes, own[begins], "right")
        for p, a, b in zip(begins[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist(), strict=True):
            r = int(np.searchsorted(offsets, p, "right")) - 1
            if p + n <= offsets[r + 1]:
                found += [(r, (n, k), p, p + n) for k in range(a, b) if np.array_equal(doc[p : p + n], texts[k])]
    return found


def _align(ix: Index, doc: np.ndarray, item: np.ndarray, a: np.ndarray, length: int, diagonal: np.ndarray):
    """Edits, start and end in ``doc`` of the best alignment of each item window inside its band of diagonals."""
    width, n = 2 * BAND, len(item)
    pad = np.concatenate([doc, np.zeros(length + width + 1, np.uint8)])
    pattern = ix.text[(ix.start[item] + a)[:, None] + np.arange(length)]
    base = a + diagonal
    steps = np.arange(width) * 32
    state = np.tile(np.arange(width), (n, 1)).astype(np.int64)  # 32 * edits + diagonal of the start
    outside = base[:, None] + np.arange(width) < 0
    state[outside] += 32 << 16
    high = np.full((n, 1), 32 << 20, np.int64)
    for i in range(length):
        where = base[:, None] + np.arange(width) + i
        same = (pad[np.clip(where, 0, len(pad) - 1)] == pattern[:, i : i + 1]) & (where >= 0) & (where < len(doc))
        now = np.minimum(state + np.where(same, 0, 32), np.concatenate([state[:, 1:] + 32, high], axis=1))
        state = np.minimum.accumulate(now - steps, axis=1) + steps
    state = np.where(base[:, None] + np.arange(width) + length > len(doc), 32 << 20, state)
    end = state.argmin(1)
    best = state[np.arange(n), end]
    return best >> 5, base + (best & 31), base + length + end


def scan(ix: Index, doc: np.ndarray, offsets: np.ndarray):
    """(row, item, window's start in the item, edits, start, end) of the leaks in comparable rows; places are in ``doc``."""
    none = tuple(np.zeros(0, np.int64) for _ in range(6))
    codes = _codes(doc)
    hits = np.flatnonzero(ix.table[_cell(codes, len(ix.table))]) if len(codes) and len(ix.codes) else np.zeros(0, np.int64)
    if not len(hits):
        return none
    row = np.searchsorted(offsets, hits, "right") - 1
    inside = hits + Q <= offsets[row + 1]
    hits, row = hits[inside], row[inside]
    at = np.minimum(np.searchsorted(ix.codes, codes[hits]), len(ix.codes) - 1)
    real = ix.codes[at] == codes[hits]
    hits, row, at = hits[real], row[real], at[real]
    least = min(bound(int(n))[1] for n in {min(WINDOW, int(x)) for x in np.diff(ix.start)})
    reach = np.searchsorted(hits, hits + WINDOW + WINDOW // 10, "right")
    dense = reach - np.arange(len(hits)) >= least
    mark = np.zeros(len(hits) + 1, np.int64)
    np.add.at(mark, np.flatnonzero(dense), 1)
    np.add.at(mark, reach[dense], -1)
    some = np.cumsum(mark[:-1]) > 0
    hits, row, at = hits[some], row[some], at[some]
    if not len(hits):
        return none
    many = ix.first[at + 1] - ix.first[at]
    skip = np.repeat(np.cumsum(many) - many, many)
    post = np.arange(many.sum()) - skip + np.repeat(ix.first[at], many)
    item, place = ix.post_item[post].astype(np.int64), ix.post_at[post].astype(np.int64)
    hits, row = np.repeat(hits, many), np.repeat(row, many)
    band = (hits - offsets[row] - place) // BAND
    item, place, row, band = (np.concatenate([x, y]) for x, y in ((item, item), (place, place), (row, row), (band, band - 1)))
    order = np.lexsort((place, band, item, row))
    item, place, row, band = item[order], place[order], row[order], band[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (band[1:] != band[:-1])
    fresh = new.copy()
    fresh[1:] |= place[1:] != place[:-1]
    item, place, row, band, new = item[fresh], place[fresh], row[fresh], band[fresh], new[fresh]
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(row))
    asked: dict[int, list] = {}
    for b, e in zip(begin[end - begin >= least], end[end - begin >= least], strict=True):
        i = item[b]
        length = min(WINDOW, int(ix.start[i + 1] - ix.start[i]))
        starts = ix.windows[i]
        n = np.searchsorted(place[b:e], starts + length - Q, "right") - np.searchsorted(place[b:e], starts)
        good = starts[n >= bound(length)[1]]
        if len(good):
            asked.setdefault(length, []).append(np.stack([np.full(len(good), row[b]), np.full(len(good), i), good, np.full(len(good), band[b] * BAND)]))
    found = [none]
    for length, parts in asked.items():
        r, i, a, d = np.concatenate(parts, axis=1)
        for x in np.unique(r):
            mine = r == x
            edits, s, t = _align(ix, doc[offsets[x] : offsets[x + 1]], i[mine], a[mine], length, d[mine])
            ok = edits <= bound(length)[0]
            found.append((r[mine][ok], i[mine][ok], a[mine][ok], edits[ok], s[ok] + offsets[x], t[ok] + offsets[x]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _pieces(offsets: np.ndarray):
    """(first row, end row, first byte, end byte): rows together, or overlapping parts of one long row."""
    overlap = 4 * WINDOW
    for first, end in spans(offsets, PIECE_BYTES):
        lo, hi = int(offsets[first]), int(offsets[end])
        for at in range(lo, max(lo + 1, hi - overlap), PIECE_BYTES):
            yield first, end, at, min(hi, at + PIECE_BYTES + overlap)


def _batch(ix: Index, text) -> list[tuple[int, int, int, int, int]]:
    """(row, item's id, start, end, least edits) of each leaked region of a batch, in characters of the text as it stands."""
    raw, raw_at = utf8(text)
    out = []
    for first_row, end_row in spans(raw_at, 1 << 22):
        part, at = raw[raw_at[first_row] : raw_at[end_row]], raw_at[first_row : end_row + 1] - raw_at[first_row]
        doc, offsets = normal(part, at)
        found = []
        for x, (n, k), s, t in scan_short(ix, doc, offsets) if ix.short else ():
            own = part[at[x] : at[x + 1]]
            lo, hi = raw_places(own, np.array([s, t - 1]) - offsets[x])
            out.append((first_row + x, ix.short[n][1][k], _chars(own, lo), _chars(own, hi + 1), 0))
        for first, end, lo, hi in _pieces(offsets):
            here = np.clip(offsets[first : end + 1], lo, hi) - lo
            r, *rest, s, t = scan(ix, doc[lo:hi], here)
            if len(r):
                found.append(np.stack([r + first, rest[0], rest[2], s + lo, t + lo]))
        if not found:
            continue
        row, item, edits, s, t = np.concatenate(found, axis=1)
        for x in np.unique(row):
            own = part[at[x] : at[x + 1]]
            for i in np.unique(item[row == x]):
                mine = (row == x) & (item == i)
                order = np.argsort(s[mine], kind="stable")
                regions: list[list[int]] = []
                for a, b, e in zip(s[mine][order], t[mine][order], edits[mine][order], strict=True):
                    if regions and a <= regions[-1][1]:
                        regions[-1][1], regions[-1][2] = max(regions[-1][1], b), min(regions[-1][2], e)
                    else:
                        regions.append([a, b, e])
                for a, b, e in regions:
                    lo, hi = raw_places(own, np.array([a, b - 1]) - offsets[x])
                    out.append((first_row + int(x), ix.items[int(i)], _chars(own, lo), _chars(own, min(hi + 1, len(own))), int(e)))
    return out


def _chars(raw: np.ndarray, n: int) -> int:
    """Characters in the first n bytes."""
    return int(((raw[:n] & 0xC0) != 0x80).sum())


def _parts(benchmark: DataFrame) -> Iterator[Index]:
    part, size = [], 0
    for r in benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text")).toLocalIterator():
        b = r["text"].encode()
        if part and size + len(b) > PART_BYTES:
            yield index(part)
            part, size = [], 0
        part.append((r["item_id"], b))
        size += len(b)
    if part:
        yield index(part)


LEAKS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("item_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("edits", T.IntegerType())])


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, start, end, edits``: a row for each region of a document that holds text of an item.

    ``start`` and ``end`` count characters of the text; ``edits`` are those of the region's best window.
    """
    spark = docs.sparkSession
    out = spark.createDataFrame([], LEAKS)
    for ix in _parts(benchmark):
        if ix is None:
            continue
        sent = spark.sparkContext.broadcast(ix)

        def report(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = _batch(sent.value, batch.column("text"))
                ids = batch.column("doc_id").to_pylist() if found else []
                cols = [[ids[r] for r, *_ in found], [i for _, i, *_ in found], [x[2] for x in found], [x[3] for x in found], [x[4] for x in found]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 4 + [pa.int32()], strict=True)], names=LEAKS.names)

        out = out.unionByName(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(report, LEAKS))
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows, whole and as they are, of documents without a leak."""
    for ix in _parts(benchmark):
        if ix is None:
            continue
        sent = docs.sparkSession.sparkContext.broadcast(ix)

        def keep(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bad = {r for r, *_ in _batch(sent.value, batch.column("text"))}
                yield batch.filter(pa.array([i not in bad for i in range(batch.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
