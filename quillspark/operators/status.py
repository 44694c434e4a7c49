"""Status of posts and accounts: parsing of identifiers, and verdicts from probe answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Path parts that look like names, and forms of addresses.
RESERVED = "i home search explore hashtag messages notifications settings compose tos privacy logout login signup share intent about help".split()
POST_URL = r"(?i)https?://(?:(?:www|mobile|m)\.)?(?:x\.com|twitter\.com|nitter\.[\w.-]+)/(?:[A-Za-z0-9_]+|i/web)/status(?:es)?/(\d+)"
HOSTS = {"x": r"(?i)https?://(?:(?:www|mobile|m)\.)?(?:x|twitter)\.com/"}
NAME = r"^[A-Za-z0-9_]{1,15}$"


def parse_post(raw: Column) -> Column:
    """The id of a post's address, or a bare number of up to 25 digits."""
    s = F.trim(raw)
    return F.coalesce(F.nullif(F.regexp_extract(s, POST_URL, 1), F.lit("")), F.when(s.rlike(r"^\d{1,25}$"), s))


def parse_account(raw: Column) -> Column:
    s = F.regexp_replace(F.trim(raw), "^@+", "")
    first = F.regexp_extract(s, r"^https?://[^/?#]*/+([^/?#]+)", 1)
    name = F.when(s.startswith("http"), first).otherwise(s)
    return F.when(name.rlike(NAME) & ~F.lower(name).isin(RESERVED), name)


def platform_of(hint: Column, raw: Column, default: str = "x") -> Column:
    """A named platform, else that of the address, else the default."""
    out = F.lit(default)
    for name, pattern in HOSTS.items():
        out = F.when(raw.rlike("^" + pattern if not pattern.startswith("(?i)") else "(?i)^" + pattern[4:]), F.lit(name)).otherwise(out)
    return F.coalesce(F.nullif(F.lower(F.trim(hint)), F.lit("")), out)


def post_verdict(post_id: Column, http_status: Column, error: Column) -> Column:
    return F.when(post_id.isNull(), "invalid_url").when(error.isNotNull(), "error").when(http_status == 200, "live").when(http_status == 404, "gone").when(http_status == 429, "rate_limited").otherwise("error")


def timeline_fields(body: Column) -> Column:
    """``has_results, has_header, entries`` of a profile page, from its embedded JSON or else from its text."""
    b = F.coalesce(body, F.lit(""))
    data = F.nullif(F.regexp_extract(b, r'(?s)<script[^>]*id="__NEXT_DATA__"[^>]*>(.*?)</script>', 1), F.lit(""))
    where = F.coalesce(data, b)
    results = F.when(where.rlike(r'"hasResults"\s*:\s*false'), F.lit(False)).when(where.rlike(r'"hasResults"\s*:\s*true'), F.lit(True))
    header = where.rlike(r'"headerProps"\s*:\s*\{')
    listed = F.regexp_extract(where, r'(?s)"entries"\s*:\s*(\[.*?\])\s*[,}]', 1)
    count = F.size(F.from_json(listed, "array<string>"))
    empty = where.rlike(r'"entries"\s*:\s*\[\s*\]')
    entries = F.when(empty, F.lit(0)).when(where.rlike(r'"entries"\s*:\s*\['), F.greatest(F.lit(1), F.coalesce(count, F.lit(1))))
    return F.struct(results.alias("has_results"), header.alias("has_header"), entries.cast("int").alias("entries"))


def timeline_verdict(http_status: Column, fields: Column) -> Column:
    """The first probe's verdict."""
    entries = F.coalesce(fields["entries"], F.lit(0))
    return (
        F.when(http_status.isNull(), "error").when(http_status == 429, "rate_limited").when(http_status != 200, "error")
        .when(~F.coalesce(fields["has_results"], F.lit(True)) & ~fields["has_header"], "not_found")
        .when(fields["has_header"] & (entries == 0), "suspended_or_deactivated").when(entries > 0, "live").otherwise("error")
    )


def account_verdict(name: Column, first: Column, second: Column) -> Column:
    """Both probes together; ``second`` is live, protected, suspended_or_deactivated or null (unavailable)."""
    return (
        F.when(name.isNull(), "invalid_url").when(first.isin("not_found", "invalid_url"), first).when(second.isNull(), first).when(second.isin("live", "protected"), second)
        .when((second == "suspended_or_deactivated") & first.isin("rate_limited", "error"), "unknown").when(second == "suspended_or_deactivated", "suspended_or_deactivated").otherwise(first)
    )


def abort_after(rows: DataFrame, order: str, limit: int = 5, batch: str | None = None) -> DataFrame:
    """Rows after ``limit`` rate limits in a row (within a batch) are skipped."""
    keys = [batch] if batch else [F.lit(0)]
    o = W.partitionBy(*keys).orderBy(order)
    calm = F.sum((F.col("status") != "rate_limited").cast("int")).over(o)
    r = rows.withColumn("_g", calm)
    streak = F.count(F.when(F.col("status") == "rate_limited", 1)).over(W.partitionBy(*keys, "_g").orderBy(order))
    r = r.withColumn("_s", F.when(F.col("status") == "rate_limited", streak).otherwise(0))
    stopped = F.coalesce(F.max((F.col("_s") >= limit).cast("int")).over(o.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) == 1
    return r.withColumn("status", F.when(stopped, "skipped").otherwise(F.col("status"))).drop("_g", "_s")


def counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("status").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "status")


def dedup_lines(lines: DataFrame, line: str, order: str, most: int = 10_000) -> DataFrame:
    """Distinct trimmed lines in their order."""
    l_ = F.trim(F.col(line))
    d = lines.select(l_.alias("line"), F.col(order).alias("_o")).where("line <> ''").groupBy("line").agg(F.min("_o").alias("first"))
    return d.orderBy("first").limit(most)


def merged(inputs: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Result columns take the place of input columns of the same name."""
    over = set(results.columns) - {key}
    return inputs.select(*(c for c in inputs.columns if c not in over)).join(results, key, "left")


REGISTRY = {"x": {"posts": (parse_post, post_verdict), "accounts": (parse_account, account_verdict)}}


def register(platform: str, hosts: str | None = None, **modes) -> None:
    """Add a platform: ``mode=(parse, verdict)`` pairs of column functions, and a pattern of its addresses."""
    REGISTRY.setdefault(platform, {}).update(modes)
    if hosts:
        HOSTS[platform] = hosts


def check_posts(df: DataFrame, raw: str, fetch, platform: str = "x") -> DataFrame:
    """``raw, post_id, status`` of posts: parsed, asked once for each id, and judged. ``fetch(post_id)`` gives an answer's http_status and error."""
    from .links import fetch_all

    parse, verdict = REGISTRY[platform]["posts"]
    rows = df.select(raw).withColumn("post_id", parse(F.col(raw)))
    got = fetch_all(rows.select(F.col("post_id").alias("url")), fetch).select(F.col("url").alias("_id"), "http_status", "error")
    return rows.join(got, F.col("post_id") == F.col("_id"), "left").select(raw, "post_id", verdict(F.col("post_id"), F.col("http_status"), F.col("error")).alias("status"))


def check_one(spark, raw: str, fetch, platform: str = "x") -> dict:
    """A single post's id and status."""
    return check_posts(spark.createDataFrame([(raw,)], "raw string"), "raw", fetch, platform).first().asDict()


def supported(platform: str, mode: str) -> bool:
    return mode in REGISTRY.get(platform, {})
