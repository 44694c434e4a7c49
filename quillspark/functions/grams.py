"""Kernels for n-grams over Arrow batches: tokens become numbers, so that n-grams are counted, found and paired without a string for each.

A batch has a list column of tokens, and may have one of further terms (runs of symbols, names), which count once with a like n-gram.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Tokens that are worked on at once, and keys of pairs that are held before they are counted.
TOKENS, PAIRS = 2_000_000, 16_000_000
#: Parts that terms are dealt into by their hash, to be summed part by part; and rows of a part that are held before they are summed.
PARTS, ROWS = 256, 4_000_000
ROOM = 1 << 62


def portions(batch: pa.RecordBatch, column: str = "words", most: int = TOKENS) -> Iterator[pa.RecordBatch]:
    """Runs of rows of at most ``most`` tokens; a longer row stands alone."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < len(ends):
        end = max(int(np.searchsorted(ends, (ends[first - 1] if first else 0) + most, "right")), first + 1)
        yield batch.slice(first, end - first)
        first = end


def coded(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Each token's row and number, and the words that the numbers stand for."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    d = lists.flatten().dictionary_encode()
    return np.repeat(np.arange(len(lists), dtype=np.int64), sizes), d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and how often each occurs. Sorts in place."""
    keys.sort()
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.diff(np.append(at, len(keys)))


def hashes(texts: pa.Array) -> np.ndarray:
    return np.fromiter((zlib.crc32(t.encode()) for t in texts.to_pylist()), np.uint64, len(texts))


def mixed(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of words' texts one after another."""
    return before * np.uint64(0x9E3779B97F4A7C15) + word


def packed(table: pa.Table, hashed: np.ndarray) -> pa.RecordBatch:
    """``part, data``: rows dealt out by their hash, those of a part in one cell, so that Spark moves few and large rows."""
    part = ((hashed ^ (hashed >> np.uint64(29))) % np.uint64(PARTS)).astype(np.uint16)
    order = np.argsort(part, kind="stable")
    ends = np.searchsorted(part[order], np.arange(PARTS + 1))
    (batch,) = table.combine_chunks().take(pa.array(order)).combine_chunks().to_batches() or [None]
    parts, cells = [], []
    for k in np.flatnonzero(np.diff(ends)).tolist():
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(batch.slice(ends[k], ends[k + 1] - ends[k]))
        parts.append(k)
        cells.append(sink.getvalue().to_pybytes())
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(cells, pa.binary())], names=["part", "data"])


def summed(batches: Iterator[pa.RecordBatch], keys: list[str], numbers: list[str], least: int = 0) -> Iterator[pa.RecordBatch]:
    """The keys of packed rows that come part by part, with the sums of their numbers; those whose first number is below ``least`` go, but for the null key."""
    now, held = None, []

    def total() -> pa.Table:
        t = pa.concat_tables(held).group_by(keys, use_threads=False).aggregate([(n, "sum") for n in numbers])
        return t.select([*keys, *(f"{n}_sum" for n in numbers)]).rename_columns([*keys, *numbers])

    def done() -> Iterator[pa.RecordBatch]:
        t = total()
        if least > 1:
            t = t.filter(pc.or_(pc.greater_equal(t[numbers[0]], least), pc.is_null(t[keys[-1]])))
        yield from t.to_batches(max_chunksize=100_000)

    for batch in batches:
        for part, cell in zip(batch.column("part").to_pylist(), batch.column("data"), strict=True):
            if part != now:
                if held:
                    yield from done()
                now, held = part, []
            held.append(pa.ipc.open_stream(cell.as_buffer()).read_all())
            if len(held) > 1 and sum(t.num_rows for t in held[1:]) > ROWS:
                held = [total()]
    if held:
        yield from done()


def sums(rows: DataFrame, keys: list[str], numbers: list[str], least: int = 0) -> DataFrame:
    """:func:`summed` over all tasks: ``rows`` are packed."""
    run = partial(summed, keys=keys, numbers=numbers, least=least)
    return rows.repartition("part").sortWithinPartitions("part").mapInArrow(run, ", ".join([f"`{k}` string" for k in keys] + [f"{n} long" for n in numbers]))


class Grams:
    """The n-grams of some rows: ``row`` and ``key`` of each place by size, where a key stands for one n-gram."""

    def __init__(self, lists: pa.Array, sizes: tuple[int, ...], sep: str = " ", drop: pa.Array | None = None):
        row, code, self.words = coded(lists)
        if drop is not None and len(self.words):
            keep = ~pc.is_in(self.words, drop).to_numpy(zero_copy_only=False)[code]
            row, code = row[keep], code[keep]
        self.rows, self.sizes, self.sep, self.wide = len(lists), sizes, sep, max(len(self.words), 1)
        self.row, self.key, self.span, self.table = {1: row}, {1: code}, {1: self.wide}, {}
        for n in range(2, max(sizes) + 1):
            same = row[n - 1 :] == row[: len(row) - n + 1] if len(row) >= n else np.zeros(0, bool)
            # keys of size n - 1 stand at the places where such an n-gram begins; those that go on are paired with the next token
            places = self.starts(n - 1, row)[: len(same)] if n > 2 else np.arange(len(same))
            before, span = self.key[n - 1][places[same]], self.span[n - 1]
            if span * self.wide >= ROOM // max(self.rows, 1):
                self.table[n], before = np.unique(before, return_inverse=True)
                span = max(len(self.table[n]), 1)
            self.row[n] = row[: len(same)][same]
            self.key[n] = before * self.wide + code[n - 1 :][same] if len(same) else before
            self.span[n] = span * self.wide

    def starts(self, n: int, row: np.ndarray) -> np.ndarray:
        """For each token the place of the n-gram that begins there among those of size n."""
        begins = np.zeros(len(row), np.int64)
        if len(row) >= n:
            begins[: len(row) - n + 1] = row[n - 1 :] == row[: len(row) - n + 1]
        return np.cumsum(begins) - begins

    def parts(self, n: int, key: np.ndarray) -> list[np.ndarray]:
        if n == 1:
            return [key]
        before = key // self.wide
        return [*self.parts(n - 1, self.table[n][before] if n in self.table else before), key % self.wide]

    def hashed(self, n: int, key: np.ndarray) -> np.ndarray:
        """By the words' texts, so that it is the same in every task."""
        if not hasattr(self, "_hashes"):
            self._hashes = hashes(self.words)
        first, *more = self.parts(n, key)
        out = self._hashes[first]
        for p in more:
            out = mixed(out, self._hashes[p])
        return out

    def text_hashed(self, terms: pa.Array) -> np.ndarray:
        """:meth:`hashed` of terms given as texts."""
        out = np.zeros(len(terms), np.uint64)
        for i, t in enumerate(terms.to_pylist()):
            first, *more = (zlib.crc32(w.encode()) for w in t.split(self.sep))
            for w in more:
                first = (first * 0x9E3779B97F4A7C15 + w) & 0xFFFFFFFFFFFFFFFF
            out[i] = first
        return out

    def text(self, n: int, key: np.ndarray) -> pa.Array:
        words = [self.words.take(pa.array(p)) for p in self.parts(n, key)]
        return pc.binary_join_element_wise(*words, self.sep) if n > 1 else words[0]

    def find(self, terms: list[str]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """By size: the keys of terms that are n-grams of words that occur here, sorted, and the terms' places in the list."""
        split = [t.split(self.sep) for t in terms]
        flat = pa.array([w for s in split for w in s], self.words.type)
        codes = pc.fill_null(pc.index_in(flat, self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64) if len(flat) and len(self.words) else np.full(len(flat), -1)
        got: dict[int, list] = {}
        at = 0
        for i, s in enumerate(split):
            c = codes[at : at + len(s)]
            at += len(s)
            if len(s) in self.sizes and (c >= 0).all():
                key = int(c[0])
                for n in range(2, len(s) + 1):
                    if n in self.table:
                        k = int(np.searchsorted(self.table[n], key))
                        key = k if k < len(self.table[n]) and self.table[n][k] == key else -1
                    if key < 0:
                        break
                    key = key * self.wide + int(c[n - 1])
                if key >= 0:
                    got.setdefault(len(s), []).append((key, i))
        out = {}
        for n, x in got.items():
            a = np.array(sorted(x), np.int64)
            out[n] = a[:, 0], a[:, 1]
        return out

    def distinct(self, more: pa.Array | None = None) -> list[tuple]:
        """(rows, keys, text of keys, size or 0) with each n-gram once a row; ``more`` brings terms of its own, which may be n-grams as well."""
        joined: dict[int, list] = {n: [self.row[n] * self.span[n] + self.key[n]] for n in self.sizes}
        own = []
        if more is not None:
            row, code, names = coded(more)
            if len(code):
                size, key = np.zeros(len(names), np.int64), np.arange(len(names), dtype=np.int64)
                for n, (keys, at) in self.find(names.to_pylist()).items():
                    size[at], key[at] = n, keys
                for n in np.unique(size[code]).tolist():
                    of = size[code] == n
                    if n:
                        joined[n].append(row[of] * self.span[n] + key[code[of]])
                    else:
                        k = counted(row[of] * len(names) + code[of])[0]
                        own = [(k // len(names), k % len(names), lambda x, names=names: names.take(pa.array(x)), 0)]
        out = []
        for n, x in joined.items():
            k = counted(np.concatenate(x))[0]
            out.append((k // self.span[n], k % self.span[n], lambda key, n=n: self.text(n, key), n))
        return out + own

    def holders(self, terms: list[str], more: pa.Array | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Rows and the places in ``terms`` of the terms that they hold, each once, sorted."""
        got, found, wide = [], self.find(terms), max(len(terms), 1)
        for n, (keys, at) in found.items():
            if n == 1:
                to = np.full(self.wide, -1)
                to[keys] = at
                term = to[self.key[1]]
            else:
                k = np.minimum(np.searchsorted(keys, self.key[n]), len(keys) - 1)
                term = np.where(keys[k] == self.key[n], at[k], -1)
            of = term >= 0
            got.append(self.row[n][of] * wide + term[of])
        if more is not None and len(terms):
            row, code, names = coded(more)
            if len(code):
                term = pc.fill_null(pc.index_in(names, pa.array(terms, names.type)), -1).to_numpy(zero_copy_only=False).astype(np.int64)[code]
                of = term >= 0
                got.append(row[of] * wide + term[of])
        k = counted(np.concatenate(got))[0] if got else np.zeros(0, np.int64)
        return k // wide, k % wide


def document_counts(batches: Iterator[pa.RecordBatch], sizes: tuple[int, ...], seeds: list[str]) -> Iterator[pa.RecordBatch]:
    """Packed ``term, n, exact, wide``: rows with each term; those of them that hold a seed; and those that do or have ``also`` set. The null term counts all rows."""
    for batch in batches:
        for part in portions(batch):
            g = Grams(part.column("words"), sizes)
            more = part.column("more")
            exact = np.zeros(g.rows, bool)
            exact[g.holders(seeds, more)[0]] = True
            wide = exact | part.column("also").to_numpy(zero_copy_only=False).astype(bool)
            texts, hashed, columns = [pa.array([None], pa.string())], [np.zeros(1, np.uint64)], [[np.array([x])] for x in (g.rows, exact.sum(), wide.sum())]
            for row, key, text, size in g.distinct(more):
                keys, n = counted(key.copy())
                texts.append(text(keys).cast(pa.string()))
                hashed.append(g.hashed(size, keys) if size else g.text_hashed(texts[-1]))
                columns[0].append(n)
                for column, hit in zip(columns[1:], (exact, wide), strict=True):
                    k, m = counted(key[hit[row]])
                    some = np.zeros(len(keys), np.int64)
                    some[np.searchsorted(keys, k)] = m
                    column.append(some)
            numbers = [pa.array(np.concatenate(c), pa.int32()) for c in columns]
            yield packed(pa.Table.from_arrays([pa.concat_arrays(texts), *numbers], names=["term", "n", "exact", "wide"]), np.concatenate(hashed))


def first_holders(batches: Iterator[pa.RecordBatch], sizes: tuple[int, ...], terms: list[str], most: int | None, within: list[str] | None) -> Iterator[pa.RecordBatch]:
    """``term, doc_id`` of rows that hold a term (and one of ``within``): of each run of rows the ``most`` with the smallest ids."""
    for batch in batches:
        for part in portions(batch):
            g = Grams(part.column("words"), sizes)
            row, term = g.holders(terms, part.column("more"))
            if within is not None:
                ok = np.zeros(g.rows, bool)
                ok[g.holders(within, part.column("more"))[0]] = True
                row, term = row[ok[row]], term[ok[row]]
            if most is not None and len(row):
                place = np.empty(g.rows, np.int64)
                place[pc.sort_indices(part.column("doc_id")).to_numpy(zero_copy_only=False)] = np.arange(g.rows)
                order = np.lexsort((place[row], term))
                row, term = row[order], term[order]
                first = np.searchsorted(term, term)
                keep = np.arange(len(term)) - first < most
                row, term = row[keep], term[keep]
            if len(row):
                yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()).take(pa.array(term)), part.column("doc_id").take(pa.array(row))], names=["term", "doc_id"])


def shared_rows(batches: Iterator[pa.RecordBatch], sizes: tuple[int, ...], terms: list[str], most: int, block: int = 2048) -> Iterator[pa.RecordBatch]:
    """``a, b, weight``: in how many rows two terms are among the row's first ``most`` of the list. One square table is held."""
    together = np.zeros((len(terms), len(terms)), np.int64)
    for batch in batches:
        for part in portions(batch):
            row, term = Grams(part.column("words"), sizes).holders(terms, part.column("more"))
            keep = np.arange(len(row)) - np.searchsorted(row, row) < most
            row, term = row[keep], term[keep]
            for first in range(0, part.num_rows, block):
                a, b = np.searchsorted(row, (first, first + block))
                held, at = np.unique(term[a:b], return_inverse=True)
                m = np.zeros((min(block, part.num_rows - first), len(held)), np.float32)
                m[row[a:b] - first, at] = 1
                together[np.ix_(held, held)] += (m.T @ m).astype(np.int64)
    names = np.array([t.encode() for t in terms], object)
    order = np.argsort(names, kind="stable") if len(terms) else np.zeros(0, np.int64)
    a, b = np.nonzero(np.triu(together[np.ix_(order, order)], 1))
    text = pa.array(terms, pa.string())
    yield pa.RecordBatch.from_arrays([text.take(pa.array(order[a])), text.take(pa.array(order[b])), pa.array(together[order[a], order[b]])], names=["a", "b", "weight"])


#: Rows of a table of pairs that travel and are summed together.
BLOCK = 64


def near_pairs(batches: Iterator[pa.RecordBatch], vocab: list[str], window: int) -> Iterator[pa.RecordBatch]:
    """``block, keys, counts``: pairs of vocabulary words within ``window`` places of each other, the smaller number first; keys count from the block's begin."""
    wide, names = len(vocab), pa.array(vocab, pa.string())
    held, size = [], 0

    def flush() -> Iterator[pa.RecordBatch]:
        keys, n = counted(np.concatenate(held))
        step = BLOCK * wide
        blocks = np.unique(keys // step)
        ends = np.searchsorted(keys, np.append(blocks * step, (blocks[-1:] + 1) * step))
        cut = lambda x, i: x[ends[i] : ends[i + 1]]
        yield pa.RecordBatch.from_arrays([
            pa.array(blocks, pa.int32()), pa.array([(cut(keys, i) - b * step).astype(np.uint32).tobytes() for i, b in enumerate(blocks.tolist())], pa.binary()),
            pa.array([cut(n, i).astype(np.uint32).tobytes() for i in range(len(blocks))], pa.binary()),
        ], names=["block", "keys", "counts"])

    for batch in batches:
        for part in portions(batch):
            row, code, words = coded(part.column("words"))
            if not len(code):
                continue
            at = pc.fill_null(pc.index_in(words, names), -1).to_numpy(zero_copy_only=False).astype(np.int64)[code]
            row, at = row[at >= 0], at[at >= 0]
            for k in range(1, min(window, len(at) - 1) + 1):
                same = row[k:] == row[:-k]
                a, b = at[:-k][same], at[k:][same]
                if len(a):
                    held.append(np.minimum(a, b) * wide + np.maximum(a, b))
                    size += len(a)
                if size >= PAIRS:
                    yield from flush()
                    held, size = [], 0
    if size:
        yield from flush()


def summed_pairs(batches: Iterator[pa.RecordBatch], wide: int) -> Iterator[pa.RecordBatch]:
    """``ia, ib, count`` of blocks of :func:`near_pairs` in order; both directions count, so a word beside itself counts twice."""
    now, table = None, np.zeros(0, np.int64)

    def done() -> pa.RecordBatch:
        key = np.flatnonzero(table)
        a, b = now * BLOCK + key // wide, key % wide
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(table[key] * np.where(a == b, 2, 1))], names=["ia", "ib", "count"])

    for batch in batches:
        for block, keys, n in zip(batch.column("block").to_pylist(), batch.column("keys"), batch.column("counts"), strict=True):
            if block != now:
                if now is not None:
                    yield done()
                now, table = block, np.zeros(BLOCK * wide, np.int64)
            table[np.frombuffer(keys.as_buffer(), np.uint32)] += np.frombuffer(n.as_buffer(), np.uint32)
    if now is not None:
        yield done()


def group_counts(batches: Iterator[pa.RecordBatch], sizes: tuple[int, ...], sep: str, drop: list[str] | None) -> Iterator[pa.RecordBatch]:
    """Packed ``group, term, n``: how often each n-gram occurs in the rows of each group; the null term has the group's n-grams of all sizes."""
    out = pa.array(drop, pa.string()) if drop else None
    for batch in batches:
        for part in portions(batch):
            g = Grams(part.column("words"), sizes, sep, out)
            kinds = part.column("group").dictionary_encode("encode")
            kind = kinds.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            total = np.zeros(len(kinds.dictionary), np.int64)
            groups, texts, hashed, ns = [], [], [], []
            for n in sizes:
                of = kind[g.row[n]]
                total += np.bincount(of, minlength=len(total))
                keys, count = counted(of * g.span[n] + g.key[n])
                groups.append(keys // g.span[n])
                keys %= g.span[n]
                texts.append(g.text(n, keys).cast(pa.string()))
                hashed.append(g.hashed(n, keys))
                ns.append(count)
            groups.append(np.arange(len(total)))
            texts.append(pa.nulls(len(total), pa.string()))
            hashed.append(np.zeros(len(total), np.uint64))
            ns.append(total)
            table = pa.Table.from_arrays([kinds.dictionary.take(pa.array(np.concatenate(groups))).cast(pa.string()), pa.concat_arrays(texts), pa.array(np.concatenate(ns), pa.int64())], names=["group", "term", "n"])
            yield packed(table, np.concatenate(hashed))


def row_phrases(batches: Iterator[pa.RecordBatch], sizes: tuple[int, ...], single: int | None) -> Iterator[pa.RecordBatch]:
    """``key, phrase, tf, last`` of each row's n-grams: all that occur more than once, and the first ``single`` of the others in order of text.

    ``last`` is the last of these others where some were left out, else null.
    """
    for batch in batches:
        for part in portions(batch, most=TOKENS // 4):
            g = Grams(part.column("words"), sizes)
            rows, tfs, texts = [], [], []
            for n in sizes:
                keys, tf = counted(g.row[n] * g.span[n] + g.key[n])
                rows.append(keys // g.span[n])
                tfs.append(tf)
                texts.append(g.text(n, keys % g.span[n]).cast(pa.string()))
            row, tf, text = np.concatenate(rows), np.concatenate(tfs), pa.concat_arrays(texts)
            keep, last = np.ones(len(row), bool), np.full(g.rows, -1)
            if single is not None and len(row):
                once = np.flatnonzero(tf == 1)
                names = text.take(pa.array(once)).dictionary_encode()
                place = np.empty(len(names.dictionary), np.int64)
                place[pc.sort_indices(names.dictionary).to_numpy(zero_copy_only=False)] = np.arange(len(place))
                order = once[np.lexsort((place[names.indices.to_numpy(zero_copy_only=False)], row[once]))]
                at = np.arange(len(order)) - np.searchsorted(row[order], row[order])
                keep[order[at >= single]] = False
                more = np.isin(row[order], row[order[at == single]]) & (at == single - 1)
                last[row[order[more]]] = order[more]
            kept = np.flatnonzero(keep)
            ends = last[row[kept]]
            yield pa.RecordBatch.from_arrays([
                part.column("key").take(pa.array(row[kept])), text.take(pa.array(kept)), pa.array(tf[kept], pa.int64()), text.take(pa.array(ends, mask=ends < 0)),
            ], names=["key", "phrase", "tf", "last"])


def first_of_groups(batches: Iterator[pa.RecordBatch], n: int, held_rows: int = 200_000) -> Iterator[pa.RecordBatch]:
    """Of a task's rows of ``group, term, count_raw`` the ``n`` of each group with the highest counts, then the smallest terms."""
    held, floor = [], None

    def first() -> pa.Table:
        t = pa.Table.from_batches(held).combine_chunks()
        t = t.take(pc.sort_indices(t, sort_keys=[("group", "ascending"), ("count_raw", "descending"), ("term", "ascending")]))
        begins = np.ones(t.num_rows, bool)
        begins[1:] = ~pc.fill_null(pc.equal(t["group"][1:], t["group"][:-1]), False).to_numpy() & ~pc.and_(pc.is_null(t["group"][1:]), pc.is_null(t["group"][:-1])).to_numpy() if t.num_rows > 1 else True
        at = np.arange(t.num_rows)
        return t.filter(pa.array(at - np.maximum.accumulate(np.where(begins, at, 0)) < n))

    for batch in batches:
        if floor is not None:
            low = pc.fill_null(floor[1].take(pc.index_in(batch.column("group"), floor[0])), 0)
            batch = batch.filter(pc.greater_equal(batch.column("count_raw"), low))
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) > held_rows:
            t = first()
            held_rows = max(held_rows, 2 * t.num_rows)
            sizes = t.group_by("group", use_threads=False).aggregate([("count_raw", "min"), ("count_raw", "count")])
            full = sizes.filter(pc.greater_equal(sizes["count_raw_count"], n))
            floor = (full["group"].combine_chunks(), full["count_raw_min"].combine_chunks()) if full.num_rows else None
            held = t.combine_chunks().to_batches()
    if held:
        yield from first().to_batches()
