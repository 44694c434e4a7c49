"""Readers of uploaded tables: delimited text, JSON, chat exports, lines and feeds."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DELIMITERS = ",;\t|"


def sniff_separator(spark: SparkSession, path: str) -> str:
    """The delimiter of a file's first lines; a comma if it can't be told. Reads a few lines through Spark, from any store."""
    head = "\n".join(r["value"] for r in spark.read.text(path).limit(20).collect())[:4096].lstrip("﻿")
    try:
        return csv.Sniffer().sniff(head, DELIMITERS).delimiter
    except csv.Error:
        return ","


def csv_infer(spark: SparkSession, path: str | list[str], sep: str = ",") -> DataFrame:
    return spark.read.csv(path, header=True, inferSchema=True, sep=sep, multiLine=False)


def csv_strings(spark: SparkSession, path: str | list[str], sep: str = ",") -> DataFrame:
    """All columns as text; empty cells are empty text."""
    return spark.read.csv(path, header=True, sep=sep, nullValue="\x00", emptyValue="").na.fill("")


def csv_sniffed(spark: SparkSession, path: str) -> DataFrame:
    """Delimiter found out; names and values trimmed; a byte order mark ignored."""
    df = csv_strings(spark, path, sniff_separator(spark, path))
    names = [c.lstrip("﻿").strip() for c in df.columns]
    return df.toDF(*names).select(*(F.trim(F.col(f"`{c}`")).alias(c) for c in names))


def csv_encoded(spark: SparkSession, path: str) -> DataFrame:
    """UTF-8, or Latin-1 if the file isn't that; broken lines are left out."""
    good = spark.read.format("binaryFile").load(path).select(F.is_valid_utf8(F.col("content").cast("string")).alias("ok")).where("NOT ok").isEmpty()
    return spark.read.csv(path, header=True, encoding="UTF-8" if good else "ISO-8859-1", mode="DROPMALFORMED")


def json_array(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


TELEGRAM = "name string, id string, messages array<struct<forwarded_from:string,text:string>>, _corrupt_record string"


def telegram(spark: SparkSession, path: str) -> DataFrame:
    """Chat exports: ``name, id, filename, messages``; a message's text stays JSON. Files that can't be read are left out."""
    df = spark.read.schema(TELEGRAM).json(path, multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record")
    return df.withColumn("filename", F.element_at(F.split(F.input_file_name(), "/"), -1)).where(F.col("messages").isNotNull() & F.col("_corrupt_record").isNull()).drop("_corrupt_record")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Trimmed lines that aren't blank."""
    return spark.read.text(path).select(F.trim("value").alias("line")).where("line <> ''")


def pasted_rows(lines_: DataFrame) -> DataFrame:
    """``country, site, query`` of lines that are 'country,site' or a query."""
    p = F.split("line", ",", 3)
    two = F.size(p) >= 2
    return lines_.select(F.when(two, F.trim(p[0])).alias("country"), F.when(two, F.trim(p[1])).alias("site"), F.when(~two, F.col("line")).alias("query"))


def csv_from_url(spark: SparkSession, url: str, fetch) -> DataFrame:
    """A delimited table behind an address; ``fetch(url)`` gives its text. All columns are text."""
    rows = list(csv.reader(fetch(url).lstrip("﻿").splitlines()))
    head = rows[0] if rows else []
    return spark.createDataFrame([tuple((r + [""] * len(head))[: len(head)]) for r in rows[1:]], ", ".join(f"`{c}` string" for c in head)) if head else spark.createDataFrame([], "value string")


def many_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Files with differing columns as one table; more than one adds ``source_file``."""
    parts = [csv_infer(spark, p) for p in paths]
    if len(parts) > 1:
        parts = [d.withColumn("source_file", F.lit(p.rstrip("/").rsplit("/", 1)[-1])) for d, p in zip(parts, paths, strict=True)]
    out = parts[0]
    for d in parts[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def feed_links(spark: SparkSession, path: str) -> DataFrame:
    """``link, first``: addresses of RSS items, Atom entries and sitemaps, with or without namespace, in order and once each."""
    text = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", r"(</?)[A-Za-z0-9_]+:", "$1").alias("x"))
    find = lambda pattern: F.coalesce(F.regexp_extract_all("x", F.lit(pattern), F.lit(1)), F.array().cast("array<string>"))
    found = F.concat(find(r"(?s)<item\b.*?<link>\s*(.*?)\s*</link>"), find(r"""(?s)<entry\b.*?<link\b[^>]*href=["']([^"']+)["']"""), find(r"(?s)<url>.*?<loc>\s*(.*?)\s*</loc>"))
    e = text.select(F.posexplode(F.filter(F.transform(found, lambda u: F.replace(F.trim(u), F.lit("&amp;"), F.lit("&"))), lambda u: u != "")).alias("k", "link"))
    return e.groupBy("link").agg(F.min("k").alias("first")).orderBy("first")


URL_NAMES = ("url", "urls", "link", "image", "image_url", "media", "src", "href")


def url_list(df: DataFrame) -> DataFrame:
    """``url``: http addresses of a column named for it, else of the first."""
    c = next((c for n in URL_NAMES for c in df.columns if c.lower() == n), df.columns[0])
    u = F.trim(F.col(f"`{c}`").cast("string"))
    return df.select(u.alias("url")).where(u.rlike("^https?://"))


def jdbc_rows(spark: SparkSession, url: str, table: str, column: str, needle: str, order: str, n: int, **options: str) -> DataFrame:
    """Rows of a database whose text holds ``needle``, the latest first; the filter goes to the database."""
    df = spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
    return df.where(F.contains(column, F.lit(needle))).orderBy(F.desc(order)).limit(n)
