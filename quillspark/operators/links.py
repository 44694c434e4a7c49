"""Links and sites: search queries, profile URLs, redirects and liveness. Network answers come from injected fetchers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import domain, is_http, words_of

#: First path segments that are no profiles.
FB_BANNED = "share photo.php watch events groups marketplace reel reels gaming".split()
IG_BANNED = "p reel reels explore stories tv accounts".split()
SHORTENERS = "t.co bit.ly tinyurl.com ow.ly buff.ly lnkd.in ift.tt trib.al goo.gl t.ly is.gd".split()


def build_query(site: Column, country: Column) -> Column:
    """The search phrase of a site's labels for state media."""
    s, c = F.lower(F.trim(F.coalesce(site, F.lit("")))), F.trim(F.coalesce(country, F.lit("")))
    tail = F.concat(F.lit(" site:"), s)
    phrase = F.when(s == "tiktok.com", F.concat(F.lit('"'), c, F.lit(' state-affiliated media"'))).when(s == "youtube.com", F.concat(F.lit('"is funded in whole or in part by the '), c, F.lit(' government."'))).otherwise(F.concat(F.lit('"'), c, F.lit(' state-controlled media"')))
    return F.when(s == "", F.lit("")).otherwise(F.concat(phrase, tail))


def preset_cross(countries: DataFrame, sites: DataFrame) -> DataFrame:
    """Every country with every site (two short lists; Spark broadcasts a side only below its size threshold)."""
    return countries.crossJoin(sites).select("country", "site", build_query(F.col("site"), F.col("country")).alias("query"))


PROFILE = "struct<platform:string,domain:string,is_profile:boolean,profile_type:string,profile_handle:string,normalized_profile_url:string>"


def parse_profile(link: Column, strict_host: bool = False) -> Column:
    """Platform, handle and canonical address of a profile link, as a struct.

    Hosts match if they contain a platform's name, as in the tool this stands in for; ``strict_host`` asks for the host itself.
    """
    host = F.lower(domain(F.coalesce(link, F.lit(""))))
    rest = F.regexp_extract(F.coalesce(link, F.lit("")), r"^https?://[^/?#]*([^?#]*)", 1)
    path = F.coalesce(F.try_url_decode(F.replace(rest, F.lit("+"), F.lit("%2B"))), rest)
    segs = F.filter(F.split(path, "/"), lambda x: x != "")
    seg = lambda i: F.coalesce(F.get(segs, F.lit(i)), F.lit(""))
    n, first = F.size(segs), F.lower(seg(0))
    query_id = F.regexp_extract(F.coalesce(link, F.lit("")), r"[?&]id=([^&#]+)", 1)

    def of(name: str) -> Column:
        return host.rlike(rf"^(?:[\w-]+\.)*{name.replace('.', chr(92) + '.')}$") if strict_host else F.contains(host, F.lit(name))

    def out(platform: str | None, kind: str | None = None, handle: Column | None = None, url: Column | None = None) -> Column:
        text = lambda x: (F.lit(x) if isinstance(x, str) or x is None else x).cast("string")
        return F.struct(text(platform).alias("platform"), host.alias("domain"), F.lit(kind is not None).alias("is_profile"), text(kind).alias("profile_type"), text(handle).alias("profile_handle"), text(url).alias("normalized_profile_url"))

    at = lambda base, x, end="": F.concat(F.lit(base), x, F.lit(end))
    bare = F.regexp_replace(seg(0), "^@+", "")
    second = seg(1)
    tg = F.when((seg(0) == "s") & (n >= 2), second).otherwise(seg(0))
    telegram = host.rlike(r"^(?:www\.)?t\.me$") if strict_host else host.endswith("t.me")
    return (
        F.when(of("instagram.com"), F.when((n == 0) | first.isin(IG_BANNED), out("instagram")).otherwise(out("instagram", "user", first, at("https://www.instagram.com/", first, "/"))))
        .when(of("threads.net"), F.when(n == 0, out("threads")).otherwise(out("threads", "handle", bare, at("https://www.threads.net/@", bare))))
        .when(
            of("facebook.com"),
            F.when((n == 0) | first.isin(FB_BANNED), out("facebook"))
            .when(first == "profile.php", F.when(query_id != "", out("facebook", "profile_id", query_id, at("https://www.facebook.com/profile.php?id=", query_id))).otherwise(out("facebook")))
            .when((first == "pages") & (n >= 3), out("facebook", "page_id", seg(2), F.concat(F.lit("https://www.facebook.com/pages/"), second, F.lit("/"), seg(2))))
            .otherwise(out("facebook", "page", first, at("https://www.facebook.com/", first))),
        )
        .when(
            of("youtube.com") | of("youtu.be"),
            F.when(seg(0).startswith("@"), out("youtube", "handle", bare, at("https://www.youtube.com/@", bare)))
            .when((seg(0) == "channel") & (n >= 2), out("youtube", "channel", second, at("https://www.youtube.com/channel/", second)))
            .when((seg(0) == "c") & (n >= 2), out("youtube", "custom", second, at("https://www.youtube.com/c/", second)))
            .when((seg(0) == "user") & (n >= 2), out("youtube", "user", second, at("https://www.youtube.com/user/", second)))
            .otherwise(out("youtube")),
        )
        .when(telegram, F.when(n == 0, out("telegram")).otherwise(out("telegram", "channel", tg, at("https://t.me/", tg))))
        .when(of("tiktok.com"), F.when(seg(0).startswith("@"), out("tiktok", "handle", bare, at("https://www.tiktok.com/@", bare))).otherwise(out("tiktok")))
        .otherwise(out(None))
    )


def search_rows(pages: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """A row per result with its position, or one Error, No Results or Skipped row. ``pages``: ``query, start, error, results array<struct<title,link,snippet>>``."""
    p = pages.withColumn("query", F.trim(F.coalesce("query", F.lit(""))))
    e = p.select("*", F.posexplode_outer("results").alias("k", "r"))
    status = F.when(F.col("query") == "", "Skipped").when(F.col("error").isNotNull(), "Error").when(F.col("r").isNull(), "No Results").otherwise("OK")
    prof = parse_profile(F.col("r.link"))
    return e.withColumn("p", F.when(F.col("r.link").isNotNull(), prof)).select(
        "query", (F.col("start") + F.col("k") + 1).cast("long").alias("position"), F.col("r.title").alias("title"), F.col("r.link").alias("link"), F.col("r.snippet").alias("snippet"),
        "p.platform", "p.domain", "p.is_profile", "p.profile_type", "p.profile_handle", "p.normalized_profile_url", status.alias("status"), F.coalesce("error", F.lit("")).alias("error"), *carry,
    )


def unescape_html(c: Column) -> Column:
    """The common entities (named ones of markup, quotes and spaces; and decimal or hex codes of ASCII)."""
    for code, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&apos;", "'"), ("&#x2F;", "/"), ("&#47;", "/"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(code), F.lit(plain))
    return c


#: What a page may say about where it leads, in this order.
REDIRECTS = (
    r"""(?i)<meta[^>]+http-equiv=["']?refresh["']?[^>]+content=["']?\s*\d+\s*;\s*url\s*=\s*([^"'>\s]+)""",
    r"""(?i)location\.(?:href|replace)\s*=\s*["']([^"']+)["']""",
    r"""(?i)location\.(?:replace|assign)\s*\(\s*["']([^"']+)["']\s*\)""",
    r"""(?i)<title>\s*(https?://[^<\s]+)\s*</title>""",
)


def join_url(base: Column, ref: Column) -> Column:
    """A reference seen from a base address."""
    scheme, root = F.regexp_extract(base, r"^(https?:)", 1), F.regexp_extract(base, r"^(https?://[^/?#]*)", 1)
    folder = F.regexp_extract(F.regexp_replace(base, r"[?#].*$", ""), r"^(https?://[^/]*(?:/.*/|/)?)", 1)
    folder = F.when(folder.endswith("/"), folder).otherwise(F.concat(root, F.lit("/")))
    up = F.regexp_replace(F.concat(folder, ref), r"/\./", "/")
    up = F.regexp_replace(up, r"/(?!\.\.)[^/]+/\.\./", "/")
    return F.when(ref.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), ref).when(ref.startswith("//"), F.concat(scheme, ref)).when(ref.startswith("/"), F.concat(root, ref)).when(ref == "", base).when(ref.startswith("?"), F.concat(F.regexp_replace(base, r"[?#].*$", ""), ref)).otherwise(up)


def html_redirect(html: Column, base: Column) -> Column:
    """Where a page's markup or script leads, or null."""
    t = F.replace(unescape_html(F.coalesce(html, F.lit(""))), F.lit("\\/"), F.lit("/"))
    found = F.coalesce(*(F.nullif(F.trim(F.regexp_extract(t, r, 1)), F.lit("")) for r in REDIRECTS))
    return F.when(found.isNotNull(), join_url(base, found))


ANSWER = "url string, final_url string, http_status int, chain array<string>, content_type string, html string, ms double, error string"


def fetch_all(urls: DataFrame, fetch: Callable[[str], dict], schema: str = ANSWER, tasks: int | None = None) -> DataFrame:
    """One call for each distinct url; what a fetcher raises becomes its row's error. ``fetch(url)`` gives the schema's other fields."""
    names = [p.strip().split(" ")[0] for p in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for url in pdf["url"]:
                try:
                    rows.append({"url": url, **fetch(url)})
                except Exception as e:  # noqa: BLE001 - the row carries it
                    rows.append({"url": url, "error": str(e) or type(e).__name__})
            yield pd.DataFrame(rows, columns=names).astype(object).where(lambda x: x.notna(), None)

    distinct = urls.select("url").where(F.coalesce("url", F.lit("")) != "").distinct()
    return (distinct.repartition(tasks) if tasks else distinct).mapInPandas(run, schema)


def unshorten(answers: DataFrame, max_redirects: int = 10) -> DataFrame:
    """``url, final_url, http_status, redirect_chain, resolved_domain, error`` from answers, redirects inside pages followed once."""
    sniff = (F.coalesce("http_status", F.lit(200)) == 200) & (F.contains(F.lower(F.coalesce("content_type", F.lit(""))), F.lit("text/html")) | F.lower(domain(F.col("url"))).isin(SHORTENERS)) & (F.coalesce(F.size("chain"), F.lit(0)) <= 1)
    to = F.when(F.col("error").isNull() & sniff, html_redirect(F.left("html", F.lit(200_000)), F.coalesce("final_url", "url")))
    a = answers.withColumn("_to", F.when(to.isNotNull() & (to != F.coalesce("final_url", F.lit(""))), to))
    base = F.when(F.coalesce(F.size("chain"), F.lit(0)) > 0, F.col("chain")).otherwise(F.array("url"))
    chain = F.when(F.col("_to").isNotNull(), F.concat(base, F.array("_to"))).otherwise(F.coalesce("chain", F.array().cast("array<string>")))
    a = a.withColumn("_c", chain).withColumn("final_url", F.coalesce("_to", "final_url"))
    long = F.size("_c") > max_redirects + 1
    error = F.when(~is_http(F.col("url")), "Not a URL").when(long, F.lit(f"Exceeded max_redirects={max_redirects}")).otherwise(F.col("error"))
    return a.select("url", "final_url", "http_status", F.array_join(F.slice("_c", 1, max_redirects + 1), " -> ").alias("redirect_chain"), F.lower(domain(F.col("final_url"))).alias("resolved_domain"), error.alias("error"))


def unshorten_columns(df: DataFrame, columns: list[str], resolved: DataFrame) -> DataFrame:
    """The rows with what was found for each URL column, and a status for the row."""
    out = df
    for c in columns:
        r = resolved.select(F.col("url").alias(f"_u_{c}"), F.col("final_url").alias(f"final_url_{c}"), F.col("http_status").alias(f"http_status_{c}"), F.col("redirect_chain").alias(f"redirect_chain_{c}"), F.col("resolved_domain").alias(f"resolved_domain_{c}"), F.col("error").alias(f"error_{c}"))
        out = out.join(r, F.trim(F.col(c)) == F.col(f"_u_{c}"), "left").drop(f"_u_{c}")
    has = [F.coalesce(F.trim(F.col(c)), F.lit("")) != "" for c in columns]
    good = [F.col(f"final_url_{c}").isNotNull() & F.col(f"error_{c}").isNull() for c in columns]
    bad = [h & (F.col(f"error_{c}").isNotNull() | F.col(f"final_url_{c}").isNull()) for h, c in zip(has, columns, strict=True)]
    any_ = lambda xs: F.greatest(*xs, F.lit(False))
    status = F.when(any_(good), "OK").when(any_(bad), "Error").otherwise("No URL")
    used = F.array_join(F.filter(F.array(*(F.when(h, F.lit(c)) for h, c in zip(has, columns, strict=True))), lambda x: x.isNotNull()), ", ")
    return out.withColumn("processed_url_columns", used).withColumn("row_status", status)


def candidate_urls(raw: Column, prefer_https: bool = True, path: str = "/") -> Column:
    """Addresses to try for a site, in order. A full URL keeps its scheme and gets a path if it has none."""
    path = path if path.startswith("/") else f"/{path}"
    s = F.trim(F.coalesce(raw, F.lit("")))
    own = F.regexp_replace(s, r"^(https?://[^/?#]*)(?=$|[?#])", "$1" + path.replace("$", r"\$"))
    host = F.trim(F.substring_index(s, "/", 1))
    rest = F.when(F.contains(s, F.lit("/")), F.concat(F.lit("/"), F.trim(F.regexp_replace(s, "^[^/]*/", "")))).otherwise(F.lit(path))
    each = [F.concat(F.lit(p), host, rest) for p in (("https://", "http://") if prefer_https else ("http://", "https://"))]
    none = F.array().cast("array<string>")
    return F.when(s == "", none).when(is_http(s), F.array(own)).when(host == "", none).otherwise(F.array(*each))


PROBE = "url string, dns_ok boolean, resolved_ips array<string>, dns_error string, tcp_443_ok boolean, tcp_443_error string, tcp_80_ok boolean, tcp_80_error string, attempts array<struct<url:string,final_url:string,http_status:int,chain:array<string>,ms:double,error:string>>"


def probe_all(sites: DataFrame, prober: Callable[[list[str]], dict], tasks: int | None = None) -> DataFrame:
    """``site, candidates`` and the PROBE fields; one call for each distinct list of candidates. What a prober raises becomes its dns_error."""
    schema = PROBE.replace("url string, ", "candidates array<string>, ", 1)
    names = [p.strip().split(" ")[0] for p in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for c in pdf["candidates"]:
                try:
                    got = prober(list(c))
                except Exception as e:  # noqa: BLE001 - the row carries it
                    got = {"dns_ok": False, "dns_error": str(e) or type(e).__name__, "tcp_443_ok": False, "tcp_80_ok": False, "attempts": []}
                rows.append({"candidates": list(c), **got})
            yield pd.DataFrame(rows, columns=names).astype(object).where(lambda x: x.notna(), None)

    asked = sites.select("candidates").where(F.size("candidates") > 0).distinct()
    found = (asked.repartition(tasks) if tasks else asked).mapInPandas(run, schema)
    return sites.select("site", "candidates").join(found, "candidates", "left").select("site", *names)


def fetch_batches(urls: DataFrame, fetch: Callable[[str], dict], folder: str, batches: int = 16, schema: str = ANSWER) -> DataFrame:
    """As :func:`fetch_all`, written batch by batch to ``folder``: after an abort a new call goes on with the batches that lack."""
    spark = urls.sparkSession
    place = F.pmod(F.xxhash64("url"), F.lit(batches))
    for k in range(batches):
        path = f"{folder}/batch={k}"
        try:
            spark.read.parquet(path)
        except AnalysisException:  # nothing was committed there
            fetch_all(urls.where(place == k), fetch, schema).write.mode("overwrite").parquet(path)
    return spark.read.schema(f"{schema}, batch int").parquet(folder).drop("batch")


def live_verdict(probes: DataFrame, require_http_ok: bool = False) -> DataFrame:
    """``site`` row by row: the first attempt that counts as live, or what went wrong. ``probes``: ``site, candidates`` and the PROBE fields."""
    ok = lambda a: a["error"].isNull() & (a["http_status"].isNotNull() | a["final_url"].isNotNull())
    live = (lambda a: ok(a) & (a["http_status"].isNull() | a["http_status"].between(200, 399))) if require_http_ok else ok
    tried = F.coalesce("attempts", F.array().cast("array<struct<url:string,final_url:string,http_status:int,chain:array<string>,ms:double,error:string>>"))
    p = probes.withColumn("_a", tried).withColumn("_live", F.filter("_a", live)).withColumn("w", F.get("_live", F.lit(0)))
    is_live = F.size("_live") > 0
    last = F.element_at(F.filter(F.transform("_a", lambda a: a["error"]), lambda e: e.isNotNull()), -1)
    last = F.when(F.size(F.filter(F.transform("_a", lambda a: a["error"]), lambda e: e.isNotNull())) > 0, last)
    notes = F.concat_ws(" | ", *(F.nullif(F.col(c), F.lit("")) for c in ("dns_error", "tcp_443_error", "tcp_80_error")), F.when(last.isNotNull(), F.concat(F.lit("HTTP error: "), last)))
    error = F.when(F.size("candidates") == 0, "Missing site/URL").when(is_live, F.lit(None)).otherwise(F.when(notes == "", "Unreachable").otherwise(notes))
    status = F.when(F.size("candidates") == 0, "No Site").when(is_live, "OK").otherwise("Error")
    no = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return p.select(
        "site", F.when(is_live, F.col("w.url")).otherwise(F.get("candidates", F.lit(0))).alias("checked_url"), F.col("w.final_url").alias("final_url"), F.col("w.http_status").alias("http_status"),
        F.array_join(F.coalesce("w.chain", F.array().cast("array<string>")), " -> ").alias("redirect_chain"), F.col("w.ms").alias("response_time_ms"), F.array_join(F.coalesce("resolved_ips", F.array().cast("array<string>")), ", ").alias("resolved_ips"),
        no("dns_ok"), no("tcp_443_ok"), no("tcp_80_ok"), is_live.alias("is_live"), error.alias("error"), status.alias("row_status"),
    )


def extract_urls(df: DataFrame, text: str, order: str) -> DataFrame:
    """``url, first``: distinct addresses in the order in which they come, without closing punctuation."""
    found = F.transform(words_of(F.col(text), r"""https?://[^\s<>"']+"""), lambda u: F.regexp_replace(u, r"[.,;:!?)\]}]+$", ""))
    e = df.select(F.col(order).alias("_o"), F.posexplode(found).alias("_k", "url")).where("url <> ''")
    return e.groupBy("url").agg(F.min(F.struct("_o", "_k")).alias("first")).orderBy("first").select("url", F.col("first._o").alias("first"))


OEMBED = "url string, http_status int, title string, author_name string, author_url string, type string, provider_name string, provider_url string, version string, height int, width int, thumbnail_url string, thumbnail_width int, thumbnail_height int, html string, error string"


def oembed_rows(answers: DataFrame) -> DataFrame:
    status = F.when(F.col("http_status") == 200, "Found").when(F.col("http_status") == 404, "Not Found").when(F.col("http_status") == 400, "Bad Request").otherwise("Error")
    return answers.withColumn("status", status).withColumn("embed_src", F.nullif(F.regexp_extract(F.coalesce("html", F.lit("")), r'src="([^"]+)"', 1), F.lit("")))


def download_manifest(pages: DataFrame, order: str, more: tuple[str, ...] = ()) -> DataFrame:
    """``url, status, filename, bytes`` and columns ``more``: a numbered name made from the address; text of pages that aren't markup gets .txt."""
    from pyspark.sql import Window as W

    from ..functions.text import slug

    # names and places only are numbered in one task, and pages join on their place
    place = pages.select(order, "url").withColumn("_n", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(order, "url"))).select(F.col(order).alias("_order"), F.col("url").alias("_url"), "_n")
    pages = pages.join(place, pages[order].eqNullSafe(F.col("_order")) & pages["url"].eqNullSafe(F.col("_url")))
    n = F.col("_n")
    body = F.coalesce("html", F.lit(""))
    name = F.concat(F.format_string("%03d", n), F.lit("_"), slug(F.regexp_replace("url", "^https?://", "")), F.when(body.rlike(r"(?is)<html|<body|<!doctype"), ".html").otherwise(".txt"))
    return pages.select("url", F.when(F.col("error").isNull(), "ok").otherwise(F.col("error")).alias("status"), F.when(F.col("error").isNull(), name).otherwise(F.lit("")).alias("filename"), F.octet_length(body).cast("long").alias("bytes"), *more)
