"""Flattening of API payloads and filling of profile tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import non_blank, strip_tags

POST_FIELDS = "id date date_gmt modified modified_gmt slug status type link author featured_media comment_status ping_status sticky template format".split()
RENDERED = "struct<rendered:string>"
TERM = "struct<id:long,name:string,taxonomy:string>"
#: An open payload: names that aren't fixed stay in maps.
POST = f"id long, date string, date_gmt string, modified string, modified_gmt string, slug string, status string, type string, link string, author long, featured_media long, comment_status string, ping_status string, sticky boolean, template string, format string, title {RENDERED}, content {RENDERED}, excerpt {RENDERED}, categories array<long>, tags array<long>, meta map<string,string>, _embedded struct<author:array<struct<name:string>>,`wp:term`:array<array<{TERM}>>>"


def endpoint(site: Column) -> Column:
    """A site's address of posts."""
    s = F.regexp_replace(F.trim(site), "/+$", "")
    s = F.when(s.rlike("^https?://"), s).otherwise(F.concat(F.lit("https://"), s))
    return F.when(F.contains(s, F.lit("/wp-json/")), s).otherwise(F.concat(s, F.lit("/wp-json/wp/v2/posts")))


def flatten_posts(posts: DataFrame, strip_html: bool = True) -> DataFrame:
    text = lambda c: strip_tags(F.col(f"{c}.rendered")) if strip_html else F.coalesce(f"{c}.rendered", F.lit(""))
    terms = F.flatten(F.coalesce(F.col("_embedded.`wp:term`"), F.array().cast(f"array<array<{TERM}>>")))
    names = lambda a: F.array_join(F.array_sort(F.array_distinct(F.filter(a, lambda x: x.isNotNull()))), ", ")
    of = lambda kind: names(F.transform(F.filter(terms, lambda t: t["taxonomy"] == kind), lambda t: t["name"]))
    ids = lambda c: F.array_join(F.col(c).cast("array<string>"), ", ")
    return posts.select(
        *POST_FIELDS, text("title").alias("title"), text("content").alias("content"), text("excerpt").alias("excerpt"), ids("categories").alias("categories"), ids("tags").alias("tags"),
        F.to_json("meta").alias("meta_json"), names(F.transform(F.coalesce("_embedded.author", F.array().cast("array<struct<name:string>>")), lambda a: a["name"])).alias("author_name"), of("category").alias("category_names"), of("post_tag").alias("tag_names"),
    )


def meta_columns(posts: DataFrame, keys: list[str]) -> DataFrame:
    """Some of the meta map's values as ``meta_<key>`` columns."""
    return posts.select("id", *(F.try_element_at("meta", F.lit(k)).alias(f"meta_{k}") for k in keys))


def terms(df: DataFrame, column: str, order: str) -> DataFrame:
    """``term, first``: distinct trimmed terms of cells that hold several, in order."""
    e = df.select(F.col(order).alias("_o"), F.posexplode(non_blank(F.transform(F.split(F.col(column), r"[,\n]+"), lambda x: F.trim(x)))).alias("_k", "term"))
    return e.groupBy("term").agg(F.min(F.struct("_o", "_k")).alias("f")).orderBy("f").select("term", F.col("f._o").alias("first"))


def time_window(now: Column, months: int | None = None, first_day: Column | None = None, last_day: Column | None = None) -> Column:
    """``start, end`` in Unix seconds: some months back from ``now``, or whole days, the last one included."""
    seconds = lambda t: F.unix_seconds(t.cast("timestamp"))
    if months is not None:
        return F.struct(seconds(F.add_months(now, -months).cast("timestamp") + (now.cast("timestamp") - F.date_trunc("day", now))).alias("start"), seconds(now).alias("end"))
    return F.struct(seconds(F.to_date(first_day)).alias("start"), (seconds(F.date_add(F.to_date(last_day), 1)) - 1).alias("end"))


AD_FIELDS = "id name audit_status type first_shown_date last_shown_date estimated_audience spent impression show_mode rejection_info status".split()
AD = ", ".join(f"{c} string" for c in AD_FIELDS) + ", videos array<string>, image_urls array<string>, search_term string"


def flatten_ads(ads: DataFrame) -> DataFrame:
    some = lambda c: F.when(F.size(c) > 0, F.to_json(c)).otherwise(F.lit(""))
    return ads.select(*AD_FIELDS, some("videos").alias("videos"), some("image_urls").alias("image_urls"), "search_term")


def ad_summary(terms_: DataFrame, ads: DataFrame, errors: DataFrame) -> DataFrame:
    """``search_term, items_collected, error`` for every term, found or not."""
    n = ads.groupBy("search_term").agg(F.count("*").alias("n"))
    return terms_.select(F.col("term").alias("search_term")).join(n, "search_term", "left").join(errors.select("search_term", "error"), "search_term", "left").select("search_term", F.coalesce("n", F.lit(0)).cast("long").alias("items_collected"), F.coalesce("error", F.lit("")).alias("error")).orderBy(F.desc("items_collected"), "search_term")


def scalar(value: Column) -> Column:
    """A data value (JSON) as text: a text's text, an entity's id, a time's or quantity's value, else itself."""
    get = lambda p: F.nullif(F.get_json_object(value, p), F.lit(""))
    return F.when(value.startswith("{"), F.coalesce(get("$.text"), get("$.id"), get("$.time"), get("$.amount"), get("$.value"), value)).otherwise(F.regexp_replace(value, '^"|"$', ""))


def claims(entities: DataFrame, wanted: list[str]) -> DataFrame:
    """``qid, property, value``: the last value that isn't blank of each wanted property. ``entities``: ``qid, claims map<string, array<struct<snaktype, value>>>``."""
    e = entities.select("qid", F.explode("claims").alias("property", "snaks")).where(F.col("property").isin(wanted))
    e = e.select("qid", "property", F.posexplode("snaks").alias("k", "s")).where("s.snaktype = 'value'").select("qid", "property", "k", scalar(F.col("s.value")).alias("value")).where("trim(value) <> ''")
    return e.groupBy("qid", "property").agg(F.max_by("value", "k").alias("value"))


def resolve(df: DataFrame, row_index: str, mapping: dict[str, str], found: DataFrame) -> DataFrame:
    """``row_index, qid``: by the first mapped column whose value is known. ``found``: ``property, value, qid``, from distinct pairs only."""
    cells = df.select(F.col(row_index).alias("row_index"), F.explode(F.array(*(F.struct(F.lit(i).alias("k"), F.lit(p).alias("property"), F.trim(F.col(c).cast("string")).alias("value")) for i, (c, p) in enumerate(mapping.items())))).alias("x")).select("row_index", "x.*").where("value <> ''")
    return cells.join(found, ["property", "value"]).groupBy("row_index").agg(F.min_by("qid", "k").alias("qid"))


def lookup_keys(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """The distinct (property, value) pairs to look up."""
    return df.select(F.explode(F.array(*(F.struct(F.lit(p).alias("property"), F.trim(F.col(c).cast("string")).alias("value")) for c, p in mapping.items()))).alias("x")).select("x.*").where("value <> ''").distinct()


def fill(df: DataFrame, row_index: str, qids: DataFrame, values: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Blank cells filled by values of the row's entity; ``updated`` says whether any was. ``columns``: column -> property."""
    wide = values.groupBy("qid").agg(*(F.max(F.when(F.col("property") == p, F.col("value"))).alias(f"_v{i}") for i, p in enumerate(columns.values())))
    j = df.join(qids.withColumnRenamed("row_index", "_i"), F.col(row_index) == F.col("_i"), "left").drop("_i").join(wide, "qid", "left")
    blank = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""
    changed = F.lit(False)
    for i, c in enumerate(columns):
        changed = changed | (blank(c) & F.col(f"_v{i}").isNotNull())
    new = {c: F.when(blank(c), F.coalesce(f"_v{i}", F.col(c).cast("string"))).otherwise(F.col(c).cast("string")) for i, c in enumerate(columns)}
    keep = [new[c].alias(c) if c in new else F.col(c) for c in df.columns if c not in ("qid", "updated")]
    return j.select(*keep, "qid", changed.alias("updated"))
