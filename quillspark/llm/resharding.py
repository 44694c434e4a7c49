"""Minimum-cost-flow resharding.

Old shards have sizes, new shards have capacities. A flow between them that moves the fewest bytes says
how many bytes go from each old shard to each new one. Blocks (hash ranges of an old shard's rows) are
laid out along each old shard and cut where the flow says. Only blocks that a cut crosses are looked at row by row.
Whole rows travel with their blocks, in one shuffle and without a key, into the new files of the shards that gain or lose any.

Defined cases: a null text has no bytes, its checksum is that of empty text; every row counts one byte more, so
empty rows spread too; repeated rows are rows of their own; an empty table gives an empty table; extra columns are kept
out of the plan and stand in the new files, but for those named like the files' own (``shard``, ``slot``, ``old_shard``). A row larger than a capacity makes its shard larger than the rest.
The driver sees one row per block (old shards x ``blocks``, a parameter) and a few rows at each cut.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, written

#: Of each old shard; a block has some 4,096 rows until there are so many blocks.
MOST_BLOCKS = 4096
#: Blocks of a shard that stand together in a file have some so many bytes.
PIECE_BYTES = 32 << 20


def fewest_moves(supply: list[int], capacity: list[int], cost: list[list[int]] | None = None) -> list[list[int]]:
    """Least-cost flow from supplies to capacities; by default staying is free and a byte that moves costs 1.

    Successive shortest paths (Bellman-Ford on the residual graph of two layers). Capacities must hold all supplies.
    """
    n, m = len(supply), len(capacity)
    cost = cost or [[int(i != j) for j in range(m)] for i in range(n)]
    if sum(supply) > sum(capacity):
        raise ValueError("the new shards can't hold what there is")
    left, room = list(supply), list(capacity)
    flow = [[0] * m for _ in range(n)]
    far = float("inf")
    while any(left):
        at_old, at_new = [0 if x else far for x in left], [far] * m
        via_new, via_old = [-1] * m, [-1] * n
        changed = True
        while changed:
            changed = False
            for i in range(n):
                for j in range(m):
                    if at_old[i] + cost[i][j] < at_new[j]:
                        at_new[j], via_new[j], changed = at_old[i] + cost[i][j], i, True
                    if flow[i][j] and at_new[j] - cost[i][j] < at_old[i]:
                        at_old[i], via_old[i], changed = at_new[j] - cost[i][j], j, True
        end = min((j for j in range(m) if room[j]), key=lambda j: (at_new[j], j))
        path, j, most = [], end, room[end]
        while True:
            i = via_new[j]
            path.append((i, j, 1))
            if via_old[i] < 0 or (left[i] and at_old[i] == 0):
                most = min(most, left[i])
                break
            j = via_old[i]
            path.append((i, j, -1))
            most = min(most, flow[i][j])
        for a, b, sign in path:
            flow[a][b] += sign * most
        left[path[-1][0]] -= most
        room[end] -= most
    return flow


def near_equal(total: int, n: int) -> list[int]:
    return [total // n + (k < total % n) for k in range(n)]


def sized(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *more: Column) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    return docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(body).cast("long") + 1).alias("size"), F.crc32(body).alias("text_crc32"), *more)


@dataclass
class Transfers:
    """Where rows go: small tables for ``place``."""

    blocks: int
    plan: list  # (old shard, block, its first byte, new shard; None if a cut crosses the block)
    pieces: list  # (old shard, from byte, to byte, new shard)
    given: list  # (old shard, block, row, new shard) of rows at cuts
    around: int
    offsets: list  # (new shard, old shard, block, first slot, piece of a file)
    shards: set
    affected: set  # shards that gain or lose rows


def _blocked(rows: DataFrame, blocks: int) -> DataFrame:
    more = [c for c in ("carried",) if c in rows.columns]
    return rows.select("doc_id", "size", "text_crc32", "old_shard", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(blocks)).cast("int").alias("block"), *more)


def _planned(rows: DataFrame, t: Transfers) -> DataFrame:
    plan_df = rows.sparkSession.createDataFrame(t.plan, "p_old int, p_block int, p_start long, p_shard int")
    on = (F.col("old_shard") == F.col("p_old")) & (F.col("block") == F.col("p_block"))
    return _blocked(rows, t.blocks).join(F.broadcast(plan_df), on).drop("p_old", "p_block")


def _cut(planned: DataFrame, t: Transfers) -> DataFrame:
    """Rows of blocks that a cut crosses, by their place; ``free``: near a cut."""
    order = W.partitionBy("old_shard", "block").orderBy("doc_id", "text_crc32", "size")
    cut = planned.where(F.col("p_shard").isNull()).withColumn("rn", F.row_number().over(order)).withColumn("hi", F.col("p_start") + F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0)))
    cut = cut.withColumn("lo", F.col("hi") - F.col("size"))
    piece_df = planned.sparkSession.createDataFrame(t.pieces, "q_old int, q_lo long, q_hi long, q_shard int")
    held = (F.col("old_shard") == F.col("q_old")) & (F.col("q_lo") <= F.col("lo")) & (F.col("lo") < F.col("q_hi"))
    near = order.rowsBetween(-t.around, t.around)
    return cut.join(F.broadcast(piece_df), held).withColumn("free", F.max(F.col("hi") > F.col("q_hi")).over(near))


def _sharded(rows: DataFrame, t: Transfers) -> DataFrame:
    """``rows`` with ``block`` and the new ``shard``."""
    planned = _planned(rows, t)
    columns = [c for c in planned.columns if not c.startswith("p_")]
    whole = planned.where(F.col("p_shard").isNotNull()).select(*columns, F.col("p_shard").alias("shard"))
    given_df = rows.sparkSession.createDataFrame(t.given, "g_old int, g_block int, g_rn int, g_shard int")
    on = (F.col("old_shard") == F.col("g_old")) & (F.col("block") == F.col("g_block")) & (F.col("rn") == F.col("g_rn"))
    split = _cut(planned, t).join(F.broadcast(given_df), on, "left").select(*columns, F.coalesce("g_shard", "q_shard").alias("shard"))
    return whole.unionByName(split)


def reshard(rows: DataFrame, n_new: int, capacities: list[int] | None = None, blocks: int | None = None, around: int = 16) -> DataFrame:
    """``rows``: ``doc_id, size, text_crc32, old_shard``. Adds ``shard``, ``slot`` (gapless from 0) and ``moved``."""
    return place(rows, transfers(rows, n_new, capacities, blocks, around))


def transfers(rows: DataFrame, n_new: int, capacities: list[int] | None = None, blocks: int | None = None, around: int = 16) -> Transfers:
    """Which blocks and rows go where.

    Rows up to ``around`` places from a cut stay if their shard lacks as much, and else go, largest first, where most is lacking, which evens out the sizes.

    ``rows`` is read several times: give a written table. New shard k is old shard k where both are there.
    """
    blocks = blocks or min(MOST_BLOCKS, 1 + rows.count() // (4096 * n_new))
    found = _blocked(rows, blocks).groupBy("old_shard", "block").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).orderBy("old_shard", "block").collect()
    olds = sorted({r["old_shard"] for r in found})
    index = {s: k for k, s in enumerate(olds)}
    supply = [0] * len(olds)
    for r in found:
        supply[index[r["old_shard"]]] += r["bytes"]
    capacities = capacities or near_equal(sum(supply), n_new)
    cost = [[int(s != k) for k in range(n_new)] for s in olds]
    flow = fewest_moves(supply, capacities, cost) if found else []

    pieces = []  # of each old shard: the bytes that stay come first
    for s, row in zip(olds, flow, strict=True):
        at = 0
        for k in sorted((k for k, x in enumerate(row) if x), key=lambda k: (k != s, k)):
            pieces.append((s, at, at + row[k], k))
            at += row[k]
    by_old: dict[int, list[tuple[int, int, int]]] = {}
    for s, lo, hi, k in pieces:
        by_old.setdefault(s, []).append((lo, hi, k))
    plan, at = [], dict.fromkeys(olds, 0)
    for r in found:
        s, lo = r["old_shard"], at[r["old_shard"]]
        hi = at[s] = lo + r["bytes"]
        inside = [k for a, b, k in by_old[s] if a <= lo and hi <= b]
        plan.append((s, r["block"], lo, inside[0] if inside else None))
    t = Transfers(blocks, plan, pieces, [], around, [], set(range(n_new)) | set(olds), set())

    # blocks that a cut crosses: the few rows at a cut go where most is lacking
    crossing = _cut(_planned(rows, t), t).where("free").select("old_shard", "block", "rn", "size", "lo").collect()
    lacking = [0] * n_new
    for r in crossing:
        hi = r["lo"] + r["size"]
        for a, b, k in by_old[r["old_shard"]]:
            lacking[k] += max(0, min(b, hi) - max(a, r["lo"]))
    for r in sorted(crossing, key=lambda r: (-r["size"], r["old_shard"], r["block"], r["rn"])):
        home = r["old_shard"]
        stays = home < n_new and lacking[home] >= r["size"]
        k = home if stays else max(range(n_new), key=lambda k: (lacking[k], -k))
        lacking[k] -= r["size"]
        t.given.append((r["old_shard"], r["block"], r["rn"], k))

    counts = _sharded(rows, t).groupBy("shard", "old_shard", "block").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).orderBy("shard", "old_shard", "block").collect()
    at, shard, piece, held = 0, None, -1, 0
    for r in counts:
        if r["shard"] != shard or held + r["bytes"] > PIECE_BYTES:
            at, shard, piece, held = at if r["shard"] == shard else 0, r["shard"], piece + 1, 0
        t.offsets.append((r["shard"], r["old_shard"], r["block"], at, piece))
        at, held = at + r["n"], held + r["bytes"]
        if r["shard"] != r["old_shard"]:
            t.affected |= {r["shard"], r["old_shard"]}
    return t


def place(rows: DataFrame, t: Transfers) -> DataFrame:
    """``rows`` with ``shard``, ``slot`` and ``moved``; a column ``carried`` travels along. The rows must be those of the plan.

    The blocks of a piece come into one partition, in the order of their slots.
    """
    offset_df = rows.sparkSession.createDataFrame(t.offsets, "o_shard int, o_old int, o_block int, o_offset long, o_piece int")
    on = (F.col("shard") == F.col("o_shard")) & (F.col("old_shard") == F.col("o_old")) & (F.col("block") == F.col("o_block"))
    placed = _sharded(rows, t).join(F.broadcast(offset_df), on).repartition("o_piece")
    rank = F.row_number().over(W.partitionBy("shard", "o_offset", "o_piece").orderBy("doc_id", "text_crc32", "size"))
    out = placed.withColumn("rn", rank)
    more = [c for c in ("carried",) if c in rows.columns]
    return out.select("doc_id", "size", "text_crc32", "old_shard", "shard", (F.col("o_offset") + F.col("rn") - 1).alias("slot"), (F.col("old_shard") != F.col("shard")).alias("moved"), *more)


def rewritten(docs: DataFrame, old_shard: Column, n_new: int, out_dir: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Reshard documents: the files of shards that gain or lose rows are written anew, as ``out_dir/shard=k``.

    Returns ``doc_id, size, text_crc32, old_shard, shard, slot, moved`` as read back from these files; the rows of other
    shards, which stay where they are, come from ``docs``. Repeated rows and null ids are rows like others: no key is needed.
    ``docs`` is read several times and must give the same rows each time.
    """
    spark = docs.sparkSession
    old = old_shard.cast("int").alias("old_shard")
    sizes = written(sized(docs, doc_id, text, old), "resharding-sizes")
    t = transfers(sizes, n_new)
    discard(sizes)
    names = [c for c in docs.columns if c.lower() not in ("shard", "slot", "old_shard")]
    columns = ["doc_id", "size", "text_crc32", "old_shard", "shard", "slot", "moved"]
    placed = place(sized(docs, doc_id, text, old, F.struct(*(F.col(f"`{c}`") for c in names)).alias("carried")), t)
    new = placed.where(F.col("shard").isin(*t.affected)).select(*(F.col("carried")[c].alias(c) for c in names), "old_shard", "slot", "shard") if t.affected else None
    out = []
    if new is not None:
        new.sortWithinPartitions("shard", "slot").write.option("compression", "zstd").partitionBy("shard").parquet(out_dir)
        back = sized(spark.read.schema(new.schema).parquet(out_dir), doc_id, text, *map(F.col, ("old_shard", "shard", "slot")))
        out.append(back.withColumn("moved", F.col("old_shard") != F.col("shard")).select(columns))
    if t.shards - t.affected or new is None:
        stay = place(sized(docs, doc_id, text, old), t)
        out.append(stay.where(~F.col("shard").isin(*t.affected)).select(columns) if t.affected else stay)
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])


def rewrite(docs: DataFrame, placed: DataFrame, out_dir: str, key: str = "doc_id") -> DataFrame:
    """Write the new files of shards that gain or lose rows, as ``out_dir/shard=k``; returns the affected shards.

    ``key`` must be unique in ``docs``. Shards that nothing enters or leaves keep their old files.
    """
    moved = placed.where("moved")
    affected = moved.select(F.explode(F.array("old_shard", "shard")).alias("shard")).distinct()
    part = placed.join(F.broadcast(affected), "shard", "left_semi").select(F.col(key).alias("_key"), F.col("shard").alias("_shard"), F.col("slot").alias("_slot"))
    rows = docs.join(part, docs[key] == part["_key"]).drop("_key")
    for c in ("shard", "slot"):  # clashing names of the documents' own give way
        rows = rows.drop(c)
    rows = rows.withColumnRenamed("_shard", "shard").withColumnRenamed("_slot", "slot")
    rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").mode("overwrite").parquet(out_dir)
    return affected
