"""Token counts of documents from flat token files, by a separator scan.

A flat token file is a run of token ids in which an end-of-document id follows each document, and nothing says where
documents begin. It is kept in blocks of equal size: a table ``file_id, block, tokens`` (little-endian unsigned integers).
Each block is searched for the end id with one vectorised comparison; a prefix scan over the blocks' summaries (one
row per block: its length, how many ends it holds and the last of them) stitches documents that cross blocks. The scan has two
levels, runs of ``RUN_BLOCKS`` blocks and then the runs of a file, and carries summaries only.

Defined cases: a null or empty text is a document of no tokens; tokens after a file's last end id are a document that
isn't ended (``ended`` false); blocks may come in any order, and each number once in a file; a vocabulary file that isn't there is a FileNotFoundError; an empty table gives an empty table; the text of a special token inside a
document is ordinary text, so the end id stands at ends only; extra columns are ignored; repeated rows are documents of their own.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

#: The public vocabulary's pre-tokenising pattern (a fixed value) and its free id.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY, END_ID = "/opt/tokenizers/byte_bpe_50k.tiktoken", 50256
BLOCK_TOKENS, DTYPE, LONG_TEXT = 1 << 16, "<u2", 1 << 20
#: Blocks whose summaries are scanned by one task; the runs' own summaries are scanned next.
RUN_BLOCKS = 4096
_encoders: dict[int, object] = {}


def bpe_encoder(spark: SparkSession, path: str = VOCABULARY) -> Callable[[str], list[int]]:
    """An encoder by a vocabulary file of ranks, which the driver reads and sends out."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    sent = spark.sparkContext.broadcast(ranks)

    def encode(text: str) -> list[int]:
        key = sent.id if hasattr(sent, "id") else 0
        if key not in _encoders:
            import tiktoken

            _encoders[key] = tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=sent.value, special_tokens={})
        encoder = _encoders[key]
        if len(text) <= LONG_TEXT:
            return encoder.encode_ordinary(text)
        out: list[int] = []  # cut before a space between two other characters: a token begins there
        at = 0
        while at < len(text):
            stop = at + LONG_TEXT
            while stop < len(text) and not (text[stop] == " " and not text[stop - 1].isspace() and not text[stop + 1 : stop + 2].isspace() and text[stop + 1 : stop + 2]):
                stop += 1
            out += encoder.encode_ordinary(text[at:stop])
            at = stop
        return out

    return encode


def token_files(docs: DataFrame, encode: Callable[[str], list[int]], end_id: int = END_ID, dtype: str = DTYPE, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """``file_id, block, tokens, first, doc_ids``: a flat file for each task, in blocks, and its documents' ids in order.

    Rows with ``tokens`` are the file; rows with ``doc_ids`` say which documents went in, from place ``first`` on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file_id, block, done = TaskContext.get().partitionId(), 0, 0
        held, size = [], 0

        def rows(blocks: list[tuple[int, bytes]], first: int, ids) -> pa.RecordBatch:
            n = len(blocks) + (ids is not None)
            some = [ids] if ids is not None else []
            return pa.RecordBatch.from_arrays(
                [pa.array([file_id] * n, pa.int64()), pa.array([b for b, _ in blocks] + [None] * len(some), pa.int64()), pa.array([t for _, t in blocks] + [None] * len(some), pa.binary()), pa.array([None] * len(blocks) + [first] * len(some), pa.int64()), pa.array([None] * len(blocks) + some, pa.list_(pa.int64()))],
                names=["file_id", "block", "tokens", "first", "doc_ids"],
            )

        for batch in batches:
            yield rows([], done, batch.column("doc_id").to_pylist())
            done += batch.num_rows
            for text in batch.column("text"):
                ids = encode(text.as_py() or "")
                ids.append(end_id)
                held.append(np.array(ids, dtype))
                size += len(ids)
                if size >= 8 * block_tokens:
                    flat = np.concatenate(held)
                    whole = len(flat) // block_tokens
                    yield rows([(block + k, flat[k * block_tokens : (k + 1) * block_tokens].tobytes()) for k in range(whole)], 0, None)
                    block += whole
                    held, size = [flat[whole * block_tokens :]], len(flat) - whole * block_tokens
        flat = np.concatenate(held) if held else np.zeros(0, dtype)
        if len(flat):
            yield rows([(block + k, flat[at : at + block_tokens].tobytes()) for k, at in enumerate(range(0, len(flat), block_tokens))], 0, None)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "file_id long, block long, tokens binary, first long, doc_ids array<long>")


def scan(blocks: DataFrame, end_id: int = END_ID, dtype: str = DTYPE) -> DataFrame:
    """``file_id, ordinal, start, n_tokens, ended`` of each document in flat files; ``start`` counts tokens in the file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, ends = [], []
            for t in batch.column("tokens"):
                tokens = np.frombuffer(t.as_buffer(), dtype)
                sizes.append(len(tokens))
                ends.append(np.flatnonzero(tokens == end_id).astype(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ends)]), pa.int32()), pa.array(np.concatenate(ends) if ends else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("file_id"), batch.column("block"), pa.array(sizes, pa.int64()), lists], names=["file_id", "block", "size", "ends"])

    found = written(blocks.where(F.col("tokens").isNotNull()).select("file_id", "block", "tokens").mapInArrow(run, "file_id long, block long, size long, ends array<long>"), "token-ends")
    none = F.lit(0).cast("long")
    run_of = F.floor(F.col("block") / RUN_BLOCKS)
    light = found.select("file_id", "block", run_of.alias("run"), "size", F.size("ends").cast("long").alias("count"), F.get("ends", F.size("ends") - 1).alias("last"))
    before = W.partitionBy("file_id", "run").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    light = light.withColumn("in_run", F.coalesce(F.sum("size").over(before), none)).withColumn("done_in_run", F.coalesce(F.sum("count").over(before), none))
    light = light.withColumn("open_in_run", F.max(F.col("in_run") + F.col("last")).over(before))
    runs = light.groupBy("file_id", "run").agg(F.sum("size").alias("r_size"), F.sum("count").alias("r_count"), F.max(F.col("in_run") + F.col("last")).alias("r_last"), F.max("block").alias("r_block"))
    earlier = W.partitionBy("file_id").orderBy("run").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.withColumn("r_offset", F.coalesce(F.sum("r_size").over(earlier), none)).withColumn("r_done", F.coalesce(F.sum("r_count").over(earlier), none))
    runs = runs.withColumn("r_open", F.max(F.col("r_offset") + F.col("r_last")).over(earlier)).withColumn("end_block", F.max("r_block").over(W.partitionBy("file_id")))
    stitched = light.join(runs, ["file_id", "run"]).select(
        "file_id", "block", (F.col("r_offset") + F.col("in_run")).alias("offset"), (F.col("r_done") + F.col("done_in_run")).alias("done"),
        F.coalesce(F.col("r_offset") + F.col("open_in_run") + 1, F.col("r_open") + 1, none).alias("open"), (F.col("block") == F.col("end_block")).alias("is_last"),
    )
    placed = found.join(stitched, ["file_id", "block"]).withColumn("count", F.size("ends").cast("long"))
    ends = F.transform("ends", lambda x: x + F.col("offset"))
    starts = F.concat(F.array("open"), F.transform("all_ends", lambda x: x + 1))
    tail = F.col("is_last") & (F.element_at("starts", -1) < F.col("offset") + F.col("size"))
    stops = F.when(tail, F.concat("all_ends", F.array(F.col("offset") + F.col("size")))).otherwise(F.col("all_ends"))
    placed = placed.withColumn("all_ends", ends).withColumn("starts", starts).withColumn("stops", stops)
    docs = placed.select("file_id", "done", "count", "starts", F.posexplode("stops").alias("k", "stop"))
    start = F.get("starts", F.col("k"))
    return docs.select("file_id", (F.col("done") + F.col("k")).alias("ordinal"), start.alias("start"), (F.col("stop") - start).alias("n_tokens"), (F.col("k") < F.col("count")).alias("ended"))


def named(counts: DataFrame, files: DataFrame) -> DataFrame:
    """Give scanned documents their ``doc_id`` by the lists of :func:`token_files`."""
    lists = files.where(F.col("doc_ids").isNotNull())
    ids = lists.select("file_id", "first", F.posexplode("doc_ids").alias("k", "doc_id")).select("file_id", (F.col("first") + F.col("k")).alias("ordinal"), "doc_id")
    return counts.join(ids, ["file_id", "ordinal"]).select("doc_id", "n_tokens", "file_id", "ordinal", "start")
