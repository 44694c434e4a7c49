"""Exact top-k inner-product search by ball trees, branch and bound.

Rows are dealt into cells around coarse centres (learnt from a bounded sample; they only shape the shards) and cells into shards
of bounded size, each packed into one row that holds its ball tree. A small table has every shard's ball. Queries of a cell form
blocks. A block first searches the few shards with the highest upper bounds (q.c + |q| r), best first, each under the k-th score of
those before; then all shards whose ball can still hold a row above some query's k-th score: there blocks travel to the shards, as
they are far smaller. Tables of pairs name blocks and shards and hold no vectors, and what holds vectors is never broadcast: its files
are so well packed that their size says nothing of the memory they need. Inside a shard, nodes are visited in the order of their upper bounds, and cut where these lie below the k-th score.

Defined cases: vectors that are null or hold null or non-finite components take no part; ties go to the smaller id;
rows that repeat an id are candidates of their own (and none of them is a candidate of a query with that id);
vectors of another dimension than a query's never match it; a score beyond 64 bits is given as the nearest
64-bit number; an empty table gives an empty table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

SHARD_ROWS, QUERY_ROWS, LEAF_ROWS = 8192, 2048, 256
#: Cells and the rows from which their centres are learnt; shards (a shard grows beyond that many); shards searched first, and blocks that meet a shard in one task then.
CELLS, SAMPLE, MOST_SHARDS, FIRST, GROUP = 1024, 16_384, 65_536, 4, 16
NONE = -(2**63)


def packed(a: np.ndarray) -> tuple[bytes, str]:
    """The integers in the narrowest type that holds them."""
    top = int(max(abs(int(a.max())), abs(int(a.min())))) if a.size else 0
    kind = next(t for t, most in (("i1", 127), ("i2", 32767), ("i4", 2**31 - 1), ("i8", 2**63 - 1)) if top <= most)
    return a.astype(kind).tobytes(), kind


def build(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order of the rows, and of each node: centre, radius, (first, end, left, right); a leaf's children are -1."""
    v = vectors.astype(np.float64)
    order = np.arange(len(v))
    centres, radii, nodes = [], [], []
    todo = [(0, len(v), -1, 0)]
    while todo:
        first, end, parent, side = todo.pop()
        rows = v[order[first:end]]
        c = rows.mean(0)
        away = np.sqrt(((rows - c) ** 2).sum(1))
        me = len(nodes)
        centres.append(c)
        radii.append(away.max() * (1 + 1e-9) + 1e-9)
        nodes.append([first, end, -1, -1])
        if parent >= 0:
            nodes[parent][2 + side] = me
        if end - first <= LEAF_ROWS or away.max() == 0:
            continue
        a = rows[away.argmax()]
        b = rows[((rows - a) ** 2).sum(1).argmax()]
        mid = (end - first) // 2
        order[first:end] = order[first:end][np.argpartition(rows @ (b - a), mid)]
        todo += [(first, first + mid, me, 0), (first + mid, end, me, 1)]
    return order, np.array(centres), np.array(radii), np.array(nodes, np.int64)


def search(queries: np.ndarray, query_ids: np.ndarray, floor: np.ndarray, ids: np.ndarray, vectors: np.ndarray, tree, k: int):
    """(query row, id, score) of each query's best k rows of a shard, as far as they reach the query's floor.

    ``ids`` and ``vectors`` are in the tree's order. ``floor``: scores below it are of no use.
    """
    centres, radii, nodes = tree
    q = queries.astype(np.float64)
    rank = np.argsort(np.argsort(ids, kind="stable"), kind="stable")  # smaller id, smaller rank
    n = len(ids)
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * q.shape[1]
    if bound * max(n, 1) >= 2**62 or bound >= 2**53:
        return _plain(queries, query_ids, floor, ids, vectors, k)
    v = vectors.astype(np.float64)
    lowest = -(2**62)
    best = np.full((len(q), k), lowest, np.int64)  # score * n + (n - 1 - rank): unique in the shard
    kth = np.maximum(floor.astype(np.float64), -np.inf)
    length = np.sqrt((q**2).sum(1))

    def upper(node: int, who: np.ndarray) -> np.ndarray:
        u = q[who] @ centres[node] + length[who] * radii[node]
        return u + 1e-6 * (1 + np.abs(u))

    todo = [(0, np.arange(len(q)), upper(0, np.arange(len(q))))] if n else []
    while todo:
        node, who, ub = todo.pop()
        who = who[ub >= kth[who]]
        if not len(who):
            continue
        first, end, left, right = nodes[node]
        if left >= 0:
            at = [(x, who, upper(x, who)) for x in (left, right)]
            todo += sorted(at, key=lambda x: x[2].mean())  # the more promising one is popped first
            continue
        for lo in range(first, end, 4 * LEAF_ROWS):
            part = slice(lo, min(end, lo + 4 * LEAF_ROWS))
            s = np.rint(q[who] @ v[part].T).astype(np.int64)
            s_key = s * n + (n - 1 - rank[part])
            s_key[query_ids[who][:, None] == ids[part][None, :]] = lowest
            some = np.flatnonzero(s_key.max(1) > np.maximum(best[who].min(1), lowest))
            if len(some):
                w = who[some]
                both = np.concatenate([best[w], s_key[some]], axis=1)
                best[w] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
                least = best[w].min(1)
                kth[w] = np.where(least > lowest, np.maximum(kth[w], least // n), kth[w])
    row, col = np.nonzero(best > lowest)
    key = best[row, col]
    score = key // n
    by_rank = np.empty(n, ids.dtype)
    by_rank[rank] = ids
    keep = score >= floor[row]
    return row[keep], by_rank[n - 1 - key[keep] % n], score[keep]


def _plain(queries, query_ids, floor, ids, vectors, k):
    """For integers too large for exact floating point: Python's own integers."""
    rows, out_ids, scores = [], [], []
    v = vectors.astype(object)
    for i, q in enumerate(queries.astype(object)):
        s = v @ q
        best = sorted((-int(x), int(j)) for x, j in zip(s, ids, strict=True) if j != query_ids[i])[:k]
        for x, j in best:
            if -x >= floor[i]:
                rows.append(i), out_ids.append(j), scores.append(max(NONE + 1, min(2**63 - 1, -x)))
    return np.array(rows, np.int64), np.array(out_ids, np.int64), np.array(scores, np.int64)


def _pack_queries(pdf: pd.DataFrame) -> pd.DataFrame:
    v = np.stack(pdf["v"].to_numpy()).astype(np.int64)
    data, kind = packed(v)
    return pd.DataFrame({"dim": [v.shape[1]], "block": [int(pdf["block"].iloc[0])], "q_ids": [pdf["vec_id"].to_numpy(np.int64).tobytes()], "q": [data], "q_kind": [kind], "floor": [np.full(len(v), NONE, np.int64).tobytes()]})


def _pack_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    v = np.stack(pdf["v"].to_numpy()).astype(np.int64)
    order, centres, radii, nodes = build(v)
    data, kind = packed(v[order])
    return pd.DataFrame({"dim": [v.shape[1]], "shard": [int(pdf["shard"].iloc[0])], "ids": [pdf["vec_id"].to_numpy(np.int64)[order].tobytes()], "v": [data], "v_kind": [kind], "centres": [centres.tobytes()], "radii": [radii.tobytes()], "nodes": [nodes.tobytes()], "ball": [np.append(centres[0], radii[0]).tobytes()]})


def _centres(vectors: DataFrame, n: int, cells: int) -> dict[int, np.ndarray]:
    """Of each dimension: centres around which rows lie, by a few rounds of k-means over a bounded sample."""
    place = F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(1 << 30))
    rows = vectors.where(place < max(1, int((1 << 30) * min(1.0, SAMPLE / max(n, 1))))).select("dim", "vec_id", "v").limit(2 * SAMPLE).toPandas().sort_values("vec_id", kind="stable")
    out = {}
    for dim, own in rows.groupby("dim"):
        x = np.unique(np.stack(own["v"].to_numpy()).astype(np.float64), axis=0)
        c = x[np.linspace(0, len(x) - 1, min(cells, len(x))).astype(int)]
        for _ in range(5):
            at = _nearest(x, c)
            total = np.zeros_like(c)
            np.add.at(total, at, x)
            k = np.bincount(at, minlength=len(c))
            c[k > 0] = total[k > 0] / k[k > 0, None]
        out[int(dim)] = c
    return out


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = 0.5 * (c**2).sum(1)
    return np.concatenate([(x[lo : lo + 1024] @ c.T - half).argmax(1) for lo in range(0, len(x), 1024)]) if len(x) else np.zeros(0, np.int64)


def _with_cell(vectors: DataFrame, centres: dict[int, np.ndarray]) -> DataFrame:
    sent = vectors.sparkSession.sparkContext.broadcast(centres)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            cell = np.zeros(len(pdf), np.int32)
            for dim in pdf["dim"].unique():
                if int(dim) in sent.value:
                    mine = (pdf["dim"] == dim).to_numpy()
                    cell[mine] = _nearest(np.stack(pdf["v"][mine].to_numpy()).astype(np.float64), sent.value[int(dim)])
            yield pdf.assign(cell=cell)

    return vectors.mapInPandas(run, "vec_id long, v array<long>, dim int, asks boolean, cell int")


def _bounds(r, centres: np.ndarray, radii: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Upper bounds of a block's queries in shards, some shards at a time."""
    q = np.frombuffer(r.q, r.q_kind).reshape(-1, int(r.dim)).astype(np.float64)
    length = np.sqrt((q**2).sum(1))
    for lo in range(0, len(radii), 512):
        u = q @ centres[lo : lo + 512].T + length[:, None] * radii[lo : lo + 512]
        yield lo, u + 1e-6 * (1 + np.abs(u))


ASK = "dim int, block int, q_ids binary, q binary, q_kind string, floor binary"
PAIR = "dim int, block int, shard int, place int, task int"


def _choose(blocks: DataFrame, balls, first: bool) -> DataFrame:
    """``PAIR``: the shards that each block searches first, or those that it must still search."""
    sent = blocks.sparkSession.sparkContext.broadcast(balls)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                shards, centres, radii = sent.value.get(int(r.dim), (np.zeros(0, np.int64), np.zeros((0, int(r.dim))), np.zeros(0)))
                floor = np.frombuffer(r.floor, np.int64).astype(np.float64)
                best, open_ = np.zeros(len(shards)), np.zeros(len(shards), bool)
                for lo, u in _bounds(r, centres, radii):
                    best[lo : lo + u.shape[1]] = u.max(0)
                    open_[lo : lo + u.shape[1]] = (u >= floor[:, None]).any(0)
                order = np.argsort(-best, kind="stable")
                order = order[:FIRST] if first else order[FIRST:][open_[order[FIRST:]]]
                yield pd.DataFrame({"dim": int(r.dim), "block": int(r.block), "shard": shards[order], "place": np.arange(len(order)), "task": int(r.block) // GROUP})

    return blocks.mapInPandas(run, PAIR)


def _asked(r) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(r.q, r.q_kind).reshape(-1, int(r.dim)), np.frombuffer(r.q_ids, np.int64), np.frombuffer(r.floor, np.int64)


def _held(r) -> tuple:
    """A shard's ids, vectors and tree."""
    dim = int(r.dim)
    tree = np.frombuffer(r.centres).reshape(-1, dim), np.frombuffer(r.radii), np.frombuffer(r.nodes, np.int64).reshape(-1, 4)
    return np.frombuffer(r.ids, np.int64), np.frombuffer(r.v, r.v_kind).reshape(-1, dim), tree


def _searched(k: int):
    """A block's shards one after another, each under the k-th scores of those before."""

    def run(asks: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, top = pdf.sort_values("place"), asks.iloc[0]
        q, q_ids, floor = _asked(top)
        floor = floor.copy()
        rows, ids, scores = (np.zeros(0, np.int64) for _ in range(3))
        for r in pdf.itertuples(index=False):
            a, b, c = search(q, q_ids, floor, *_held(r), k)
            rows, ids, scores = np.concatenate([rows, a]), np.concatenate([ids, b]), np.concatenate([scores, c])
            order = np.lexsort((ids, -scores, rows))
            rows, ids, scores = rows[order], ids[order], scores[order]
            begin = np.searchsorted(rows, np.arange(len(q) + 1))
            keep = np.arange(len(rows)) - begin[rows] < k
            rows, ids, scores = rows[keep], ids[keep], scores[keep]
            many = np.bincount(rows, minlength=len(q))
            end = np.cumsum(many)
            full = many == k
            floor[full] = np.maximum(floor[full], scores[end[full] - 1])
        return pd.DataFrame({"dim": [top.dim], "block": [top.block], "q_ids": [top.q_ids], "q": [top.q], "q_kind": [top.q_kind], "floor": [floor.tobytes()], "f_row": [rows.tobytes()], "f_id": [ids.tobytes()], "f_score": [scores.tobytes()]})

    return run


def _met(k: int):
    """What some blocks find in one shard, each under the k-th scores of its first shards."""

    def run(asks: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
        held, out = _held(pdf.iloc[0]), []
        for r in asks.itertuples(index=False):
            q, q_ids, floor = _asked(r)
            row, ids, score = search(q, q_ids, floor, *held, k)
            out.append(pd.DataFrame({"query_id": q_ids[row], "vec_id": ids, "score": score}))
        return pd.concat(out)

    return run


def _found(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        for r in pdf.itertuples():
            row = np.frombuffer(r.f_row, np.int64)
            yield pd.DataFrame({"query_id": np.frombuffer(r.q_ids, np.int64)[row], "vec_id": np.frombuffer(r.f_id, np.int64), "score": np.frombuffer(r.f_score, np.int64)})


def integer_vectors(embeddings: DataFrame, scale: float = 64.0) -> DataFrame:
    """``vec_id, v``: floor(scale * x) of each component, of the rows that take part."""
    e = F.col("embedding")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    v = F.transform(e, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))
    return embeddings.where(e.isNotNull() & F.col("vec_id").isNotNull() & (F.size(e) > 0) & fine).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def _dealt(spark: SparkSession, counts, rows: int) -> DataFrame:
    """``d_dim, d_cell, first, parts``: numbers of the pieces, of some ``rows`` rows each, into which each cell goes."""
    out, at = [], 0
    for r in sorted(counts, key=lambda r: (r["dim"], r["cell"])):
        parts = -(-r["n"] // rows)
        out.append((r["dim"], r["cell"], at, parts))
        at += parts
    return spark.createDataFrame(out, "d_dim int, d_cell int, first int, parts int")


def top_k(vectors: DataFrame, is_query: Column, k: int, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS, met: list | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score``. ``vectors``: ``vec_id, v`` (integers); every row but the query's own is a candidate.

    ``met`` gets the numbers of (blocks, shards, pairs of both that are searched).
    """
    spark = vectors.sparkSession
    vectors = written(vectors.select("vec_id", "v", F.size("v").alias("dim"), F.coalesce(is_query, F.lit(False)).alias("asks")), "topk-vectors")
    n = vectors.count()
    shard_rows = max(shard_rows, -(-n // MOST_SHARDS))
    cells = written(_with_cell(vectors, _centres(vectors, n, max(1, min(CELLS, n // shard_rows)))), "topk-cells")

    def dealt(rows: DataFrame, size: int, name: str) -> DataFrame:
        plan = _dealt(spark, rows.groupBy("dim", "cell").agg(F.count("*").alias("n")).collect(), size)
        part = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("parts")).cast("int")
        return rows.join(F.broadcast(plan), (F.col("dim") == F.col("d_dim")) & (F.col("cell") == F.col("d_cell"))).select("dim", (F.col("first") + part).alias(name), "vec_id", "v")

    shards = written(dealt(cells, shard_rows, "shard").groupBy("dim", "shard").applyInPandas(_pack_shard, "dim int, shard int, ids binary, v binary, v_kind string, centres binary, radii binary, nodes binary, ball binary"), "topk-shards")
    blocks = written(dealt(cells.where("asks"), query_rows, "block").groupBy("dim", "block").applyInPandas(_pack_queries, ASK), "topk-blocks")
    balls = {}
    for dim, own in shards.select("dim", "shard", "ball").toPandas().sort_values("shard").groupby("dim"):
        ball = np.stack([np.frombuffer(x) for x in own["ball"]])
        balls[int(dim)] = own["shard"].to_numpy(np.int64), ball[:, :-1], ball[:, -1]
    found = f"{ASK}, f_row binary, f_id binary, f_score binary"
    hits = "query_id long, vec_id long, score long"
    near = written(_choose(blocks, balls, True), "topk-near")
    nearest = near.hint("merge").join(shards, ["dim", "shard"])
    first = written(blocks.groupBy("dim", "block").cogroup(nearest.groupBy("dim", "block")).applyInPandas(_searched(k), found), "topk-first")
    asks = first.select("dim", "block", "q_ids", "q", "q_kind", "floor")
    rest = written(_choose(asks, balls, False), "topk-rest")
    if met is not None:
        met += [blocks.count(), shards.count(), near.count() + rest.count()]
    key = ["dim", "shard", "task"]
    theirs = [f"t_{c}" for c in key]
    tasks = rest.select(*(F.col(c).alias(t) for c, t in zip(key, theirs, strict=True))).distinct()
    asking = rest.hint("merge").join(asks, ["dim", "block"])
    asked = tasks.hint("merge").join(shards, (F.col("t_dim") == F.col("dim")) & (F.col("t_shard") == F.col("shard")))
    last = asking.groupBy(key).cogroup(asked.groupBy(theirs)).applyInPandas(_met(k), hits)
    out = first.mapInPandas(_found, hits).unionByName(last)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
