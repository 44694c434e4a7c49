"""Exact n-gram Jaccard join and its connected classes.

Documents are sets of word shingles (64-bit hashes). Equal sets are one node from the start, so copies cost nothing.
Two sets that reach the similarity share one of the first n - ceil(t*n) + 1 shingles of either in any one order, so
those prefixes are the keys of the tiles. The order puts shingles that many documents share last; which they are
is found from all documents, and only the work depends on it, never the result.

A tile holds the nodes with one key. First each node meets its tiles' least nodes; the links that hold already join most
near copies. Tiles whose nodes then still belong to different classes are compared across classes, in
size bands (the smaller set must reach t of the larger): parity signatures bound the overlap from above (every bit that
differs is a shingle that only one set has), first 512 bits of each, then a number of bits that follows the set's
size; pairs that pass are verified by exact intersection of the sorted arrays. The first time each node passes on only its nearest partner (by signatures) of a tile, which joins
what is left of near copies; the second time all pairs that are still across classes. Pairs inside a class need no
comparison, so large groups of near copies cost few pairs.

Defined cases: null or empty texts have the empty set and link with nothing; fewer words than a shingle make one shingle;
repeated rows each get a row; rows that share a doc_id but not the text are nodes of their own; very long texts are read whole, in
pieces cut at white space; ties go to the smallest doc_id, and among rows of one doc_id to the smallest hash of the text; extra columns
are ignored; an empty table gives an empty table. Shingles are compared by 64-bit hashes, so the result is exact up to their collisions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, most_frequent, release, small_batches, spans, utf8, written
from .components import components, splittable
from .words import mixed, shingles, word_hashes

#: Shingles of at least so many documents among some million, and at most so many shingles, come last in the order.
OFTEN, MOST_FREQUENT, LOCAL, FLUSH = 8, 1 << 17, 3, 2_000_000
CELL_BITS, BITS, TILE_ROWS, BLOOM_WORDS = 22, 512, 8192, 1 << 20
PAIRS = 1 << 16  # compared at once
_OTHER = np.uint64(0x5851F42D4C957F2D)
_CELL = np.uint64(64 - CELL_BITS)


def _sets(text, words: int) -> Iterator[np.ndarray]:
    raw, at = utf8(text)
    for lo, hi in spans(at, 1 << 22):
        part, cut = raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        for _, offsets, h in word_hashes(part, cut):
            yield from shingles(offsets, h, words)


def _frequent(words: int):
    def count(parts: list[np.ndarray]) -> pa.RecordBatch:
        every = np.sort(np.concatenate(parts))
        first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
        n = np.diff(np.append(first, len(every)))
        some = n >= LOCAL
        return pa.RecordBatch.from_arrays([pa.array(every[first[some]].view(np.int64)), pa.array(n[some])], names=["shingle", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for s in _sets(batch.column("text"), words):
                if len(s):
                    parts.append(s)
                    held += len(s)
                if held >= FLUSH:
                    yield count(parts)
                    parts, held = [], 0
        if parts:
            yield count(parts)

    return run


def _key(s: np.ndarray) -> bytes:
    """128 bits that name a set."""
    if not len(s):
        return bytes(16)
    return np.array([mixed(s).sum(dtype=np.uint64), mixed(s ^ _OTHER).sum(dtype=np.uint64) + np.uint64(len(s))]).tobytes()


def _wide(s: np.ndarray) -> np.ndarray:
    """The parity signature of a set, four to sixteen bits for every eight shingles; halves of it folded together are the next smaller one."""
    bits = BITS
    while 2 * bits < len(s):
        bits *= 4
    return np.packbits((np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(bool))


def _folded(sign: np.ndarray, size: int) -> np.ndarray:
    return np.bitwise_xor.reduce(sign.reshape(-1, size), axis=0)


def _described(words: int, num: int, den: int, late):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = late.value
        for batch in batches:
            n, keys, signs, wides, prefixes = [], [], [], [], []
            for s in _sets(batch.column("text"), words):
                n.append(len(s))
                keys.append(_key(s))
                wide = _wide(s)
                wides.append(wide.tobytes())
                signs.append(_folded(wide, BITS // 8).view(np.int64))
                take = len(s) - -(-num * len(s) // den) + 1 if len(s) else 0
                often = cells[(s >> _CELL).astype(np.int64)]
                rare = s[~often]
                prefixes.append((rare[:take] if len(rare) >= take else np.concatenate([rare, s[often][: take - len(rare)]])).view(np.int64))
            lists = lambda parts: pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), lists(signs), pa.array(wides, pa.binary()), lists(prefixes)], names=SETS.names)

    return run


SETS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text_hash", T.LongType()), T.StructField("n", T.LongType()), T.StructField("key", T.BinaryType()), T.StructField("sign", T.ArrayType(T.LongType())), T.StructField("wide", T.BinaryType()), T.StructField("prefix", T.ArrayType(T.LongType()))])


def frequent_cells(docs: DataFrame, words: int) -> np.ndarray:
    """Cells (by the upper bits of a shingle) that hold a frequent shingle. Bounded: 2**CELL_BITS flags."""
    counts = docs.select("text").mapInArrow(_frequent(words), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    counts = written(counts.where(F.col("n") >= OFTEN), "frequent")
    top = most_frequent(counts, MOST_FREQUENT, OFTEN).toPandas()
    cells = np.zeros(1 << CELL_BITS, bool)
    cells[(top["shingle"].to_numpy(np.int64).view(np.uint64) >> _CELL).astype(np.int64)] = True
    return cells


def _bloom_places(key):
    h = F.xxhash64(key)
    bit = lambda shift: F.struct(F.pmod(F.shiftright(h, shift), F.lit(BLOOM_WORDS)).cast("int").alias("word"), F.pmod(F.shiftright(h, shift + 24), F.lit(64)).cast("int").alias("bit"))
    return F.array(bit(0), bit(30))


def _bloom(spark, ids: DataFrame):
    """A bounded filter of ids: BLOOM_WORDS words of 64 bits. It may let more through, never less."""
    places = ids.select(F.explode(_bloom_places(F.col("doc_id"))).alias("p")).groupBy("p.word").agg(F.bit_or(F.expr("shiftleft(1L, p.bit)")).alias("bits")).toPandas()
    words = np.zeros(BLOOM_WORDS, np.int64)
    words[places["word"].to_numpy(np.int64)] = places["bits"].to_numpy(np.int64)
    return spark.sparkContext.broadcast(words)


def _arrays(words: int, bloom):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = np.ones(batch.num_rows, bool)
            for w, b in (("w0", "b0"), ("w1", "b1")):
                word = batch.column(w).to_numpy(zero_copy_only=False)
                ok &= (bloom.value[word].view(np.uint64) >> batch.column(b).to_numpy(zero_copy_only=False).astype(np.uint64)) & np.uint64(1) == 1
            some = batch.filter(pa.array(ok))
            for lo in range(0, some.num_rows, 512):
                sets = list(_sets(some.column("text").slice(lo, 512), words))
                yield pa.RecordBatch.from_arrays([pa.array([_key(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["key", "items"])

    return run


def _possible(num: int, den: int):
    """Of pairs with both signatures, those that can reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = (batch.column(c).to_numpy() for c in ("na", "nb"))
            ok = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column("wa"), batch.column("wb"), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8)
                size = min(len(x), len(y))
                apart = int(np.bitwise_count(_folded(x, size) ^ _folded(y, size)).sum())
                top = (int(na[i]) + int(nb[i]) - apart) // 2
                ok[i] = den * top >= num * (int(na[i]) + int(nb[i]) - top)
            yield batch.select(["a", "b", "ka", "kb", "da", "db"]).filter(pa.array(ok))

    return run


def _verified(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                a, b = (a, b) if len(a) <= len(b) else (b, a)
                at = np.minimum(np.searchsorted(b, a), len(b) - 1)
                both = int((b[at] == a).sum())
                ok.append(den * both >= num * (len(a) + len(b) - both))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _nearest(a: np.ndarray, b: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Of each row its nearest partner."""
    x, y, d = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([apart, apart])
    order = np.lexsort((y, d, x))
    first = np.ones(len(order), bool)
    first[1:] = x[order][1:] != x[order][:-1]
    return order[first] % len(a)


def _tiles(num: int, den: int, nearest: bool):
    """Rows come sorted by tile, then class, then size; pairs across classes that the bounds can't exclude go out."""

    def pairs(tile, node, n, kind, side, sign) -> pa.RecordBatch:
        new = np.concatenate([[True], tile[1:] != tile[:-1]])
        end = np.append(np.flatnonzero(new)[1:], len(tile))[np.cumsum(new) - 1]
        other = new | np.concatenate([[True], kind[1:] != kind[:-1]])
        after = np.append(np.flatnonzero(other)[1:], len(tile))[np.cumsum(other) - 1]
        many = end - after
        out = [np.zeros((2, 0), np.int64)]
        cuts = spans(np.concatenate([[0], np.cumsum(many)]), PAIRS)
        for lo, hi in cuts:
            m = many[lo:hi]
            i = np.repeat(np.arange(lo, hi), m)
            j = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(after[lo:hi], m)
            for s in range(0, len(i), PAIRS):
                a, b = i[s : s + PAIRS], j[s : s + PAIRS]
                small, large = np.minimum(n[a], n[b]), np.maximum(n[a], n[b])
                ok = (den * small >= num * large) & ((side[a] == 0) | (side[a] != side[b]))
                a, b = a[ok], b[ok]
                apart = np.bitwise_count(sign[a] ^ sign[b]).sum(1, dtype=np.int64)
                top = (n[a] + n[b] - apart) // 2
                ok = np.flatnonzero(den * top >= num * (n[a] + n[b] - top))
                if nearest and len(ok):
                    ok = ok[_nearest(a[ok], b[ok], apart[ok])]
                out.append(np.stack([node[a[ok]], node[b[ok]]]))
        both = np.concatenate(out, axis=1)
        both = np.unique(np.sort(both, axis=0), axis=1) if both.shape[1] else both
        return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def columns(table: pa.Table):
            whole = lambda c: table.column(c).to_numpy()
            sign = np.frombuffer(table.column("sign").combine_chunks().flatten().to_numpy(zero_copy_only=False).tobytes(), np.uint64).reshape(-1, BITS // 64)
            key = whole("shingle"), whole("tile")
            new = np.concatenate([[True], (key[0][1:] != key[0][:-1]) | (key[1][1:] != key[1][:-1])])
            return np.cumsum(new), whole("node"), whole("n"), whole("class"), whole("side").astype(np.int64), sign

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            name = lambda b, i: (b.column("shingle")[i].as_py(), b.column("tile")[i].as_py())
            if sum(b.num_rows for b in held) < 100_000 and len(held) < 64:
                continue
            table = pa.Table.from_batches(held)
            last = name(batch, batch.num_rows - 1)
            s, t = table.column("shingle").to_numpy(), table.column("tile").to_numpy()
            open_ = int(np.flatnonzero((s != last[0]) | (t != last[1]))[-1]) + 1 if ((s != last[0]) | (t != last[1])).any() else 0
            if open_:
                yield pairs(*columns(table.slice(0, open_)))
                held = table.slice(open_).combine_chunks().to_batches()
        if held:
            yield pairs(*columns(pa.Table.from_batches(held)))

    return run


def jaccard_classes(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, tables: list[DataFrame] | None = None) -> DataFrame:
    """``doc_id, n_shingles, component_id``: sets link where den * |both| >= num * |either|.

    ``component_id`` is the smallest doc_id that links reach, the document's own included. ``tables`` gets the
    written tables that the result still reads, for the caller to discard.
    """
    with small_batches(docs.sparkSession):
        return _classes(docs, words, num, den, tables).select("doc_id", "n_shingles", "component_id")


def _classes(docs: DataFrame, words: int, num: int, den: int, tables: list[DataFrame] | None) -> DataFrame:
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    late = spark.sparkContext.broadcast(frequent_cells(docs, words))
    release(spark)
    sets = written(docs.mapInArrow(_described(words, num, den, late), SETS), "sets")
    first = [F.first(c).alias(c) for c in ("n", "sign", "wide", "prefix")]
    classes = sets.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("doc_id"), *first)
    keyed_nodes = written(classes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    nodes = written(keyed_nodes.drop("prefix"), "node-info")
    rows = written(sets.select("doc_id", "text_hash", "n", "key"), "rows")
    discard(sets)

    # nodes that share a key, and beside each the tile's least node
    every = keyed_nodes.select(F.explode("prefix").alias("shingle"), "node", "n")
    shared = every.groupBy("shingle").agg(F.count("*").alias("count"), F.min(F.struct("node", "n")).alias("least")).where("count > 1")
    keyed = written(every.join(splittable(shared), "shingle"), "keyed")
    discard(keyed_nodes)
    size_fits = lambda x, y: F.lit(den) * F.least(x, y) >= F.lit(num) * F.greatest(x, y)
    stars = keyed.where((F.col("node") != F.col("least.node")) & size_fits(F.col("n"), F.col("least.n"))).select(F.col("least.node").alias("a"), F.col("node").alias("b")).distinct()

    def hold(pairs: DataFrame, label: str) -> DataFrame:
        """The pairs that reach the similarity, by signatures and then by the arrays."""
        side = lambda p: nodes.select(F.col("node").alias(p), F.col("n").alias(f"n{p}"), F.col("wide").alias(f"w{p}"), F.col("key").alias(f"k{p}"), F.col("doc_id").alias(f"d{p}"))
        told = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ka", "kb", "da", "db", "na", "nb", "wa", "wb")
        left = written(told.mapInArrow(_possible(num, den), "a long, b long, ka binary, kb binary, da long, db long"), label)
        ids = left.select(F.explode(F.array("da", "db")).alias("doc_id")).distinct()
        bloom = _bloom(spark, ids)
        place = lambda i, f: _bloom_places(F.col("doc_id"))[i][f]
        asked = docs.select("text", *(place(i, f).alias(f"{f[0]}{i}") for i in (0, 1) for f in ("word", "bit")))
        arrays = written(asked.mapInArrow(_arrays(words, bloom), "key binary, items binary"), f"{label}-arrays")
        one = left.join(arrays.select(F.col("key").alias("ka"), F.col("items").alias("x")), "ka")
        two = one.join(arrays.select(F.col("key").alias("kb"), F.col("items").alias("y")), "kb")
        out = written(two.select("a", "b", "x", "y").mapInArrow(_verified(num, den), "a long, b long").distinct(), f"{label}-links")
        discard(arrays)
        release(spark)
        return out

    links = hold(stars, "stars")
    final = components(links)
    for nearest in (True, False):
        # tiles whose nodes are still of different classes
        told = keyed.select("shingle", "node", "n", "count").join(final, "node", "left").select("shingle", "node", "n", "count", F.coalesce("component", "node").alias("class"))
        open_ = told.groupBy("shingle").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo <> hi").select("shingle")
        mixed_ = told.join(splittable(open_), "shingle")
        parts = F.ceil(F.col("count") / TILE_ROWS).cast("int")
        mixed_ = mixed_.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
        mixed_ = mixed_.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        lo, hi = F.least("part", "with"), F.greatest("part", "with")
        # side: 0 where both parts are one; else -1 or 1, and only pairs of the two sides count
        mixed_ = mixed_.withColumn("tile", lo * F.col("parts") + hi).withColumn("side", F.when(F.col("part") == F.col("with"), 0).when(F.col("part") < F.col("with"), 1).otherwise(-1))
        signed = mixed_.join(nodes.select("node", "sign"), "node").select("shingle", "tile", "class", "n", "node", F.col("side").cast("int").alias("side"), "sign")
        signed = signed.repartition("shingle", "tile").sortWithinPartitions("shingle", "tile", "class", "n")
        crossing = signed.mapInArrow(_tiles(num, den, nearest), "a long, b long").distinct()
        links = links.unionByName(hold(crossing, "nearest" if nearest else "crossing"))
        final = components(links)

    discard(keyed)
    release(spark)
    if tables is not None:
        tables += [nodes, rows, final]
    labelled = nodes.select("node", "key", "doc_id").join(final, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = labelled.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    by_class = labelled.join(splittable(least), "component").select("key", "component", "component_id")
    out = rows.join(by_class, "key", "left")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), "component", "text_hash")


def keep_one(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows, as they are, of one document of each class: that with the smallest doc_id (a null id counts as largest).

    Documents without words stay. What stays or goes is a row, told by its doc_id and text: of rows that share a doc_id, one may go as
    a copy while another, of a class of its own, stays. Rows that repeat both a doc_id and its text are copies too, and one of them stays.
    """
    spark = docs.sparkSession
    tables: list[DataFrame] = []
    with small_batches(spark):
        classes = written(_classes(docs, words, num, den, tables).where("n_shingles > 0").select("doc_id", "text_hash", "component"), "classes")
    for t in tables:
        discard(t)
    release(spark)
    name = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    first = classes.groupBy("component").agg(F.min(name).alias("first"))
    apart = classes.join(splittable(first), "component").withColumn("stays", F.col("first") == name)
    gone = apart.where(~F.col("stays")).select(F.col("doc_id").alias("_gone_id"), F.col("text_hash").alias("_gone_hash")).distinct()
    same = lambda d, i, h: d["doc_id"].cast("long").eqNullSafe(F.col(i)) & (F.xxhash64(d["text"]) == F.col(h))
    kept = docs.join(gone, same(docs, "_gone_id", "_gone_hash"), "left_anti")
    stays = apart.where("stays").groupBy(F.col("doc_id").alias("_again_id"), F.col("text_hash").alias("_again_hash")).agg(F.count("*").alias("_times"))
    again = written(stays.where("_times > 1").select("_again_id", "_again_hash"), "repeated")
    if again.isEmpty():
        return kept
    twice = kept.join(again, same(kept, "_again_id", "_again_hash"), "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(again, same(kept, "_again_id", "_again_hash"), "left_anti").unionByName(twice)
