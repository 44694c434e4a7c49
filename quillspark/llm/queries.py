"""The queries of this subpackage, each over its whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ball_tree, chat_format, decontaminate, lm, ngram_join, packing, quality, resharding, token_counts, toxicity
from .common import doc_remainder, shared_dir, table, written


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_corpus(table(spark, sf_dir, "documents"), doc_remainder(F.col("doc_id"), 5) == 1)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = written(token_counts.token_files(table(spark, sf_dir, "documents"), token_counts.bpe_encoder(spark)), "token-files")
    return token_counts.named(token_counts.scan(files), files)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, left_out = table(spark, sf_dir, "documents"), doc_remainder(F.col("doc_id"), 4) == 2
    model = quality.learn(docs, table(spark, sf_dir, "labels"), ~left_out)
    return quality.score(docs, model).select("doc_id", left_out.alias("held_out"), "score", "predicted")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_tree.top_k(ball_tree.integer_vectors(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 20 == 0, 20)


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_classes(table(spark, sf_dir, "documents"), words=4, num=85)


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "<|im_end|><|im_start|>assistant ok"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    return chat_format.digests(chat_format.format_chats(turns.unionByName(more)))


#: The corpus stood in so many shards before; it goes to SHARDS now.
OLD_SHARDS, SHARDS = 6, 8


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, left_out = table(spark, sf_dir, "documents"), doc_remainder(F.col("doc_id"), 5) == 0
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), ~left_out)
    return toxicity.score(docs, model).select("doc_id", left_out.alias("held_out"), "score", "predicted")


def op10_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out_dir = f"{shared_dir(spark)}/op10-shards-{uuid.uuid4().hex}"
    placed = resharding.rewritten(table(spark, sf_dir, "documents"), doc_remainder(F.col("doc_id"), OLD_SHARDS), SHARDS, out_dir)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int"), F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"), "old_shard", "moved")


QUERIES = {f.__name__: f for f in (op1_lm_score, op2_decontaminate, op3_token_counts, op4_quality, op5_packing, op6_ball_tree, op7_ngram_join, op8_chat_format, op9_toxicity, op10_resharding)}

ORACLES: dict[str, str] = {
    "op6_ball_tree": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op7_ngram_join": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        s AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM d),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n_both FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
        e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * n_both >= 85 * (x.n + y.n - n_both)),
        r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
        SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
        FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) c USING (doc_id)""",
    "op8_chat_format": r"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
            UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
        p AS (
            SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before,
                length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) AS n_text,
                length(regexp_replace(role, '<(\\*)\|', '<\1\\|', 'g')) AS n_role FROM t)
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
            CAST(sum(n_text + CASE WHEN before = role THEN 11 ELSE 12 + n_role + 1 + 11 END) AS BIGINT) AS formatted_chars
        FROM p GROUP BY conv_id""",
}
