"""Topic tables: summaries, label tables, samples, and the join of edited labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEPTHS = ("topic_depth_1", "topic_depth_2", "topic_depth_3")
UNASSIGNED = "(unassigned)"


def depth_summary(topics: DataFrame, metadata: DataFrame) -> DataFrame:
    """``depth, topics, posts_assigned, examples``: one pass over the posts for all depths."""
    have = [(i + 1, c) for i, c in enumerate(DEPTHS) if c in topics.columns]
    stacked = topics.select(F.explode(F.array(*(F.struct(F.lit(i).alias("depth"), F.col(c).alias("label")) for i, c in have))).alias("x")).select("x.*")
    s = stacked.groupBy("depth").agg(F.count_distinct("label").alias("topics"), F.sum(F.when(F.coalesce("label", F.lit("")) != "", 1).otherwise(0)).cast("long").alias("posts_assigned"))
    label = F.coalesce(*(F.when(F.col("depth") == i, F.col(c)) for i, c in have))
    m = metadata.select("depth", "topic_id", label.alias("label")).where("label IS NOT NULL").withColumn("_r", F.row_number().over(W.partitionBy("depth").orderBy("topic_id"))).where("_r <= 4")
    e = m.groupBy("depth").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "label"))), lambda x: x["label"]), ", ").alias("examples"))
    return s.join(e, "depth", "left").select("depth", "topics", "posts_assigned", F.coalesce("examples", F.lit("")).alias("examples")).orderBy("depth")


def label_table(topics: DataFrame, metadata: DataFrame, depth: int) -> DataFrame:
    """One row per topic, the largest first, with blank labels to fill in."""
    c = DEPTHS[depth - 1]
    n = topics.groupBy(F.col(c).alias("_l")).agg(F.count("*").alias("n"))
    m = metadata.where(F.col("depth") == depth).select("topic_id", F.col(c).alias("nomic_label"), F.replace(F.coalesce("topic_description", F.lit("")), F.lit("/"), F.lit(", ")).alias("common_keywords"))
    out = m.join(n, m["nomic_label"] == n["_l"], "left")
    return out.select(F.lit(depth).alias("depth"), "topic_id", "nomic_label", "common_keywords", F.coalesce("n", F.lit(0)).cast("long").alias("n_posts"), F.lit("").alias("specific_label"), F.lit("").alias("broad_label")).orderBy(F.desc("n_posts"), "topic_id")


def topic_lookup(topics: DataFrame, id_field: str, depth: int, order: str | None = None) -> DataFrame:
    """``id, topic`` without nulls; of repeated ids the last (by ``order``) wins."""
    c = DEPTHS[depth - 1]
    t = topics.where(F.col(c).isNotNull())
    return t.groupBy(F.col(id_field).cast("string").alias("id")).agg((F.max_by(c, order) if order else F.max(c)).alias("topic"))


def sample(topics: DataFrame, id_field: str, depth: int, n: int, seed: int | None = 0) -> DataFrame:
    """At most ``n`` rows of each topic, by a seeded hash of the id (or the smallest ids, without a seed)."""
    c = DEPTHS[depth - 1]
    order = [F.xxhash64(F.col(id_field), F.lit(seed))] if seed is not None else []
    r = F.row_number().over(W.partitionBy(c).orderBy(*order, id_field))
    return topics.where(F.col(c).isNotNull()).withColumn("_r", r).where(F.col("_r") <= n).select(id_field, F.col(c).alias("topic"))


def workbook_order(posts: DataFrame, labels: DataFrame, topic: str, row_index: str) -> DataFrame:
    """Posts in the order of the label table; within a topic as they were."""
    o = labels.select(F.col("nomic_label").alias("_l"), F.row_number().over(W.orderBy(F.desc("n_posts"), "topic_id")).alias("label_order"))
    return posts.join(o, posts[topic] == o["_l"], "left").drop("_l").orderBy(F.col("label_order").asc_nulls_last(), row_index)


def read_labels(edited: DataFrame) -> DataFrame:
    """``nomic_label, specific_label, broad_label``, trimmed, without 'nan'; ``new_label`` is an old name of the specific one."""
    if "nomic_label" not in edited.columns or not {"specific_label", "new_label"} & set(edited.columns):
        raise ValueError("the label table needs nomic_label and specific_label")
    text = lambda c: F.coalesce(F.nullif(F.trim(F.col(c).cast("string")), F.lit("nan")), F.lit(""))
    specific = "specific_label" if "specific_label" in edited.columns else "new_label"
    broad = text("broad_label") if "broad_label" in edited.columns else F.lit("")
    more = [c for c in ("row_index",) if c in edited.columns]
    return edited.select(text("nomic_label").alias("nomic_label"), text(specific).alias("specific_label"), broad.alias("broad_label"), *more).where("nomic_label <> ''")


def build_mapping(labels: DataFrame, order: str) -> DataFrame:
    """One row per old label, the last one edited; a blank specific label keeps the old one, a blank broad one stays blank."""
    m = labels.groupBy("nomic_label").agg(F.max_by(F.struct("specific_label", "broad_label"), order).alias("l"))
    return m.select("nomic_label", F.coalesce(F.nullif("l.specific_label", F.lit("")), "nomic_label").alias("specific"), F.col("l.broad_label").alias("broad"))


def mapping_blanks(labels: DataFrame) -> DataFrame:
    return labels.agg(F.sum((F.col("specific_label") == "").cast("long")).alias("blank_specific"), F.sum((F.col("broad_label") == "").cast("long")).alias("blank_broad"))


def unmapped(lookup: DataFrame, mapping: DataFrame) -> DataFrame:
    return lookup.select("topic").distinct().join(mapping, lookup["topic"] == mapping["nomic_label"], "left_anti")


def relabel(rows: DataFrame, lookup: DataFrame, mapping: DataFrame, id_field: str) -> DataFrame:
    """Rows that have a topic, with the old label and both new ones."""
    j = rows.join(lookup, rows[id_field].cast("string") == lookup["id"]).join(mapping, F.col("topic") == F.col("nomic_label"))
    return j.select(*(rows[c] for c in rows.columns), "nomic_label", F.col("specific").alias("Topic (Specific)"), F.coalesce(F.nullif("broad", F.lit("")), F.lit(UNASSIGNED)).alias("Topic (Broad)"))


def coerce(df: DataFrame) -> DataFrame:
    """Only strings, 32-bit numbers and timestamps without zone: one aggregate finds integers that don't fit, which become floats."""
    ints = [f.name for f in df.schema if isinstance(f.dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType))]
    wide = set()
    if ints:
        ends = df.agg(*(F.max(F.abs(F.col(c).cast("decimal(20,0)"))).alias(c) for c in ints)).first()
        wide = {c for c in ints if ends[c] is not None and ends[c] > 2_147_483_647}
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.BooleanType):
            c = F.coalesce(c.cast("string"), F.lit(""))
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            c = F.date_trunc("millisecond", c.cast("timestamp_ntz")).cast("timestamp_ntz")
        elif f.name in ints:
            c = c.cast("float" if f.name in wide else "int")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = c.cast("float")
        elif isinstance(f.dataType, T.StringType):
            c = F.coalesce(c, F.lit(""))
        else:
            c = F.coalesce(F.to_json(c), F.lit(""))
        out.append(c.alias(f.name))
    return df.select(*out)
