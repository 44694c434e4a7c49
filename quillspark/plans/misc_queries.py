"""Queries of clustering, image matching, transfers, links, status, relabelling and enrichment.

The tables hold no social columns, so inputs are made from their ids where an operator needs some.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import is_http
from ..operators import clustering as tc
from ..operators import enrich as en
from ..operators import image_match as im
from ..operators import links as ln
from ..operators import relabel as nr
from ..operators import status as ps
from ..operators import transfers as cr
from .registry import query, table

# clustering


def vectors(spark, d, *more):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("row_index"), F.col("embedding").cast("array<double>").alias("embedding"), *more)


@query()
def tc_encode(spark, d):
    return tc.hashed_vectors(table(spark, d, "documents"), "doc_id", "text").select("row_index", F.size("embedding").alias("dims"), F.round(tc.dot(F.col("embedding"), F.col("embedding")), 6).alias("norm"))


UNIT = "(SELECT vec_id AS i, label, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS v FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings))"


@query(f"SELECT x.i AS a, y.i AS b, round(list_inner_product(x.v, y.v), 6) AS similarity FROM {UNIT} x JOIN {UNIT} y ON x.i < y.i WHERE list_inner_product(x.v, y.v) >= 0.3")
def tc_similar_pairs(spark, d):
    v = vectors(spark, d)
    return tc.similar_pairs(v.withColumn("embedding", tc.normalised(F.col("embedding"))), 0.3).withColumn("similarity", F.round("similarity", 6))


def _greedy(same: str = "true") -> str:
    """``i, label, leader, similarity``: rows in order, each free row leading later free rows within 0.3."""
    return f"""(WITH RECURSIVE u AS MATERIALIZED {UNIT}, p AS MATERIALIZED (SELECT x.i AS a, y.i AS b, list_inner_product(x.v, y.v) AS s FROM u x JOIN u y ON x.i < y.i AND {same} WHERE list_inner_product(x.v, y.v) >= 0.3),
        n AS MATERIALIZED (SELECT i, label, row_number() OVER (ORDER BY i) AS k, (SELECT list(a) FROM p WHERE b = u.i) AS early FROM u),
        g AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS l UNION ALL SELECT n.k, CASE WHEN list_has_any(coalesce(n.early, []), g.l) THEN g.l ELSE list_append(g.l, n.i) END FROM g JOIN n ON n.k = g.k + 1),
        f AS (SELECT unnest(l) AS leader FROM (SELECT l FROM g ORDER BY k DESC LIMIT 1)), led AS (SELECT b, min(a) AS a, arg_min(s, a) AS s FROM p WHERE a IN (SELECT leader FROM f) GROUP BY b)
        SELECT n.i AS row_index, n.label, CASE WHEN n.i IN (SELECT leader FROM f) THEN n.i ELSE led.a END AS leader, CASE WHEN n.i IN (SELECT leader FROM f) THEN 1.0::DOUBLE ELSE led.s END AS similarity FROM n LEFT JOIN led ON led.b = n.i)"""


@query(f"SELECT row_index, leader, round(similarity, 6) AS similarity FROM {_greedy()}")
def tc_neardup(spark, d):
    return tc.near_duplicates(vectors(spark, d), 0.3).withColumn("similarity", F.round("similarity", 6))


@query()
def tc_semantic(spark, d):
    return tc.semantic(vectors(spark, d), 10).select("row_index", "cluster_id", "cluster_size", F.round("similarity", 5).alias("similarity"))


@query(f"SELECT row_index, CAST(label AS VARCHAR) AS partition, leader, round(similarity, 6) AS similarity FROM {_greedy('x.label = y.label')} WHERE label IN (SELECT label FROM embeddings GROUP BY 1 HAVING count(*) > 1)")
def tc_partitioned(spark, d):
    return tc.partitioned(vectors(spark, d, "label"), "label", 0.3).select("row_index", "partition", "leader", F.round("similarity", 6).alias("similarity"))


@query(f"SELECT leader, count(*) AS cluster_size, count(DISTINCT label) AS cluster_distinct_differentiators FROM {_greedy()} GROUP BY 1")
def tc_distinct_count(spark, d):
    v = vectors(spark, d, "label")
    return tc.clusters(tc.near_duplicates(v, 0.3), v, 2, 1, "label").select("leader", "cluster_size", "cluster_distinct_differentiators").distinct()


@query(f"""WITH a AS MATERIALIZED (SELECT * FROM {_greedy()}), s AS (SELECT leader, count(*) AS cluster_size FROM a GROUP BY 1),
    c AS (SELECT leader, row_number() OVER (ORDER BY cluster_size DESC, leader) AS cluster_id FROM s WHERE cluster_size >= 2)
    SELECT row_index, label, round(similarity, 6) AS similarity, cluster_size, cluster_id FROM a JOIN s USING (leader) LEFT JOIN c USING (leader)""")
def tc_payload(spark, d):
    v = vectors(spark, d, "label")
    return tc.payload(v.select("row_index", "label"), tc.clusters(tc.near_duplicates(v, 0.3), v, 2)).withColumn("similarity", F.round("similarity", 6))


@query("SELECT least(1.0::DOUBLE, greatest(0.3::DOUBLE, l_tax * 20)) AS threshold, CAST(least(500000, greatest(1, l_linenumber - 2)) AS BIGINT) AS min_size FROM lineitem GROUP BY ALL")
def tc_params(spark, d):
    pairs = table(spark, d, "lineitem").select((F.col("l_tax") * 20).alias("t"), (F.col("l_linenumber") - 2).alias("n")).distinct().collect()
    return spark.createDataFrame(sorted({(float(tc.clamp_threshold(r["t"])), tc.clamp_min_size(r["n"])) for r in pairs}), "threshold double, min_size long")


# image matching: 64 signs of an embedding and three shifts of them stand in for a hash


#: Bits by which the five images of a group differ from its first: none, none, 5, 15 and 40 (as four numbers each).
FLIPS = ((0, 0, 0, 0), (0, 0, 0, 0), (0x0001000100010001, 1, 0, 0), (0x0001000100010001, 0x0001000100010001, 0x0001000100010001, 0x0000000100010001), (0x0003000700030007,) * 4)


def images(spark, d):
    """Hashes of 4 x 60 spread bits, in groups of five images, some of them copies."""
    i = F.col("vec_id")
    part = lambda k: F.conv(F.substring(F.md5(F.concat(F.lit("abcd"[k]), i - i % 5)), 1, 15), 16, 10).cast("long")
    flip = lambda k: F.element_at(F.array(*(F.lit(f[k]).cast("long") for f in FLIPS)), (i % 5 + 1).cast("int"))
    return table(spark, d, "embeddings").select(i.alias("idx"), F.concat(F.lit("img"), i).alias("name"), F.array(*(part(k).bitwiseXOR(flip(k)) for k in range(4))).alias("hash"))


HASH = "(SELECT vec_id AS idx, 'img' || vec_id AS name, [" + ", ".join(f"xor(CAST('0x' || substr(md5('{'abcd'[k]}' || (vec_id - vec_id % 5)), 1, 15) AS BIGINT), {[f[k] for f in FLIPS]}[vec_id % 5 + 1]::BIGINT)" for k in range(4)) + "] AS h FROM embeddings)"
DISTANCE = "(" + " + ".join(f"CAST(bit_count(xor(x.h[{k}], y.h[{k}])) AS INTEGER)" for k in (1, 2, 3, 4)) + ")"


@query(f"SELECT x.name AS image_a, y.name AS image_b, CAST(0 AS BIGINT) AS distance, true AS exact FROM {HASH} x JOIN {HASH} y ON x.idx < y.idx AND x.h = y.h")
def im_exact(spark, d):
    return im.exact(images(spark, d))


SHARES = " OR ".join(f"(x.h[{k}] >> {16 * j}) & 65535 = (y.h[{k}] >> {16 * j}) & 65535" for k in (1, 2, 3, 4) for j in range(4))


@query(f"SELECT x.name AS image_a, y.name AS image_b, CAST({DISTANCE} AS BIGINT) AS distance, {DISTANCE} = 0 AS exact FROM {HASH} x JOIN {HASH} y ON x.idx < y.idx WHERE {DISTANCE} <= 40 AND ({SHARES})")
def im_lsh_join(spark, d):
    return im.lsh_join(images(spark, d), 40)


@query(f"SELECT x.name AS source_image, y.name AS dataset_image, CAST({DISTANCE} AS BIGINT) AS distance, {DISTANCE} = 0 AS exact FROM {HASH} x JOIN {HASH} y ON x.idx % 3 = 0 AND y.idx % 3 <> 0 WHERE {DISTANCE} <= 40 AND ({SHARES})")
def im_cross_join(spark, d):
    i = images(spark, d)
    return im.cross_join(i.where("idx % 3 = 0"), i.where("idx % 3 <> 0"), 40)


@query(f"SELECT x.name || ' = ' || y.name AS result FROM {HASH} x JOIN {HASH} y ON x.idx < y.idx AND x.h = y.h UNION ALL SELECT 'No matches found'")
def im_to_rows(spark, d):
    """Pairs stay as they are; none give a notice."""
    some = im.rows_or_notice(im.exact(images(spark, d))).select(F.concat_ws(" = ", "image_a", "image_b").alias("result"))
    return some.union(im.rows_or_notice(im.exact(images(spark, d).where(F.lit(False)))))


# transfers: orders from customers to the suppliers of their lines


def transfers(spark, d):
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    address = lambda p, key: F.struct(F.concat(F.lit(p), key).alias("address"), F.when(key % 3 == 0, F.create_map(F.lit("name"), F.concat(F.lit("E"), key))).alias("arkhamEntity"), F.lit(None).cast("map<string,string>").alias("arkhamLabel"))
    to = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_suppkey")).alias("s"))
    j = o.join(to, F.col("o_orderkey") == F.col("l_orderkey"))
    none = lambda t: F.lit(None).cast(t)
    t = F.struct(
        F.concat(F.lit("tx"), "o_orderkey").alias("hash"), none("string").alias("transactionHash"), F.struct(F.lit("TOK").alias("symbol"), none("string").alias("address")).alias("token"), F.col("o_totalprice").alias("value"), none("double").alias("amount"),
        none("double").alias("valueUsd"), (F.col("o_totalprice") * 2).alias("amountUsd"), F.lit("eth").alias("chain"), F.col("o_orderdate").cast("string").alias("timestamp"), address("c", F.col("o_custkey")).alias("fromAddress"),
        none(cr.ADDRESS).alias("toAddress"), none(f"array<{cr.ADDRESS}>").alias("fromAddresses"), F.transform("s", lambda k: address("s", k)).alias("toAddresses"),
    )
    return j.select(t.alias("transfer"), F.when(F.col("o_orderkey") % 2 == 0, "in").otherwise("out").alias("direction"), F.concat(F.lit("c"), "o_custkey").alias("base_wallet"), F.col("o_orderpriority").alias("chain"))


PAIRS = """(SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate, s FROM orders JOIN (SELECT l_orderkey, l_suppkey AS s, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey) AS r FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem)) ON o_orderkey = l_orderkey WHERE o_orderkey % 2 = 1 OR r = 1)"""


@query(f"SELECT 'tx' || o_orderkey AS tx_hash, o_totalprice AS amount, o_totalprice * 2 AS amount_usd, 'c' || o_custkey AS from_address, CASE WHEN o_custkey % 3 = 0 THEN 'E' || o_custkey END AS from_entity, 's' || s AS to_address FROM {PAIRS}")
def cr_flatten_legs(spark, d):
    return cr.flatten_legs(transfers(spark, d)).select("tx_hash", "amount", "amount_usd", "from_address", "from_entity", "to_address")


@query("SELECT 's' || s_suppkey AS to_address, CASE WHEN s_suppkey % 3 = 0 THEN 'E' || s_suppkey END AS to_entity FROM supplier")
def cr_flat_addr(spark, d):
    a = F.struct(F.concat(F.lit("s"), "s_suppkey").alias("address"), F.when(F.col("s_suppkey") % 3 == 0, F.create_map(F.lit("name"), F.concat(F.lit("E"), "s_suppkey"))).alias("arkhamEntity"), F.lit(None).cast("map<string,string>").alias("arkhamLabel"))
    return table(spark, d, "supplier").select(a.alias("a")).select(*cr.flat_address(F.col("a"), "to")).select("to_address", "to_entity")


@query(f"SELECT 'tx' || o_orderkey AS tx_hash, 'eth' AS chain, o_orderpriority AS src_chain, count(*) AS legs FROM {PAIRS} JOIN orders o USING (o_orderkey) GROUP BY 1, 2, 3")
def cr_src_cols(spark, d):
    return cr.flatten_legs(transfers(spark, d), source_columns=("chain",)).groupBy("tx_hash", "chain", "src_chain").agg(F.count("*").alias("legs"))


@query(f"SELECT 'c' || c_custkey AS address, CASE WHEN c_custkey IN (SELECT o_custkey FROM {PAIRS}) THEN 'OK' WHEN c_custkey % 10 = 0 THEN 'Error' ELSE 'No Results' END AS status, CASE WHEN c_custkey % 10 = 0 THEN 'HTTP 500' ELSE '' END AS error FROM customer")
def cr_status_rows(spark, d):
    c = table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("address"), "c_custkey")
    bad = c.where("c_custkey % 10 = 0").select(F.col("address").alias("base_wallet"), F.lit("HTTP 500").alias("error"))
    return cr.status_rows(c, cr.flatten_legs(transfers(spark, d)), bad, "address")


@query(f"SELECT 'c' || o_custkey AS \"from\", 's' || s AS \"to\", arg_min('tx' || o_orderkey, 'tx' || o_orderkey) AS tx_hash, arg_min(o_totalprice, 'tx' || o_orderkey) AS amount, count(*) AS count FROM {PAIRS} GROUP BY 1, 2")
def cr_edges(spark, d):
    return cr.edges(cr.flatten_legs(transfers(spark, d)), "tx_hash").select("from", "to", "tx_hash", "amount", "count")


# links


@query("SELECT n_nationkey, CASE s WHEN 'tiktok.com' THEN '\"' || n_name || ' state-affiliated media\" site:tiktok.com' WHEN 'youtube.com' THEN '\"is funded in whole or in part by the ' || n_name || ' government.\" site:youtube.com' ELSE '\"' || n_name || ' state-controlled media\" site:' || s END AS q FROM (SELECT *, ['facebook.com', 'tiktok.com', 'youtube.com', 'x.com'][n_nationkey % 4 + 1] AS s FROM nation)")
def ss_build_query(spark, d):
    site = F.element_at(F.array(*map(F.lit, ("Facebook.com ", "tiktok.com", "youtube.com", "x.com"))), (F.col("n_nationkey") % 4 + 1).cast("int"))
    return table(spark, d, "nation").select("n_nationkey", ln.build_query(site, F.col("n_name")).alias("q"))


@query("SELECT n_name AS country, site, '\"' || n_name || ' state-controlled media\" site:' || site AS query FROM nation, (SELECT unnest(['facebook.com', 'threads.net']) AS site)")
def ss_preset_cross(spark, d):
    return ln.preset_cross(table(spark, d, "nation").select(F.col("n_name").alias("country")), spark.createDataFrame([("facebook.com",), ("threads.net",)], "site string"))


def profiles(spark, d):
    k = F.col("c_custkey")
    forms = ["https://www.Instagram.com/User{0}/?x=1", "https://www.threads.net/@u{0}", "http://facebook.com/profile.php?id={0}", "https://m.facebook.com/pages/Some/{0}", "https://youtube.com/channel/UC{0}", "https://www.youtube.com/@h{0}/videos", "https://t.me/s/chan{0}", "https://www.tiktok.com/@t%20{0}", "https://instagram.com/reel/{0}", "https://example.org/{0}"]
    url = F.lit("")
    for i, f in enumerate(forms):
        a, b = f.split("{0}")
        url = F.when(k % len(forms) == i, F.concat(F.lit(a), k, F.lit(b))).otherwise(url)
    return table(spark, d, "customer").select("c_custkey", url.alias("link"))


@query("""SELECT c_custkey, ['instagram', 'threads', 'facebook', 'facebook', 'youtube', 'youtube', 'telegram', 'tiktok', 'instagram', NULL][m + 1] AS platform, m < 8 AS is_profile, ['user', 'handle', 'profile_id', 'page_id', 'channel', 'handle', 'channel', 'handle', NULL, NULL][m + 1] AS profile_type,
    ['user' || k, 'u' || k, k, k, 'UC' || k, 'h' || k, 'chan' || k, 't ' || k, NULL, NULL][m + 1] AS profile_handle, ['https://www.instagram.com/user' || k || '/', 'https://www.threads.net/@u' || k, 'https://www.facebook.com/profile.php?id=' || k, 'https://www.facebook.com/pages/Some/' || k,
    'https://www.youtube.com/channel/UC' || k, 'https://www.youtube.com/@h' || k, 'https://t.me/chan' || k, 'https://www.tiktok.com/@t ' || k, NULL, NULL][m + 1] AS normalized_profile_url FROM (SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS k, c_custkey % 10 AS m FROM customer)""")
def ss_parse_profile(spark, d):
    return profiles(spark, d).select("c_custkey", ln.parse_profile(F.col("link")).alias("p")).select("c_custkey", "p.platform", "p.is_profile", "p.profile_type", "p.profile_handle", "p.normalized_profile_url")


@query("""SELECT CASE WHEN k % 5 = 4 THEN '' ELSE 'q' || k END AS query, CASE WHEN k % 5 IN (0, 1) THEN k % 3 * 10 + i + 1 END AS position, CASE WHEN k % 5 IN (0, 1) THEN 'https://t.me/c' || i END AS link, CASE k % 5 WHEN 2 THEN 'Error' WHEN 3 THEN 'No Results' WHEN 4 THEN 'Skipped' ELSE 'OK' END AS status
    FROM (SELECT c_custkey AS k, unnest(CASE WHEN c_custkey % 5 IN (0, 1) THEN [0, 1] ELSE [0] END) AS i FROM customer)""")
def ss_result_rows(spark, d):
    k = F.col("c_custkey")
    hit = lambda i: F.struct(F.lit("t").alias("title"), F.lit(f"https://t.me/c{i}").alias("link"), F.lit("s").alias("snippet"))
    pages = table(spark, d, "customer").select(F.when(k % 5 == 4, " ").otherwise(F.concat(F.lit("q"), k)).alias("query"), (k % 3 * 10).alias("start"), F.when(k % 5 == 2, "quota").alias("error"), F.when((k % 5).isin(0, 1), F.array(hit(0), hit(1))).otherwise(F.array().cast("array<struct<title:string,link:string,snippet:string>>")).alias("results"))
    return ln.search_rows(pages).select("query", "position", "link", "status")


def answers(spark, d):
    """What a fetcher would have said of each page's address."""
    k = F.col("page_id")
    meta = F.concat(F.lit('<html><meta http-equiv="refresh" content="0; url=/to/'), k, F.lit('"></html>'))
    script = F.concat(F.lit("<script>location.href = 'https:\\/\\/other.example\\/"), k, F.lit("'</script>"))
    return table(spark, d, "pages").select(
        F.concat(F.lit("https://t.co/"), k).alias("url"), F.concat(F.lit("https://t.co/"), k).alias("final_url"), F.lit(200).alias("http_status"), F.array(F.concat(F.lit("https://t.co/"), k)).alias("chain"), F.lit("text/html").alias("content_type"),
        F.when(k % 3 == 0, meta).when(k % 3 == 1, script).otherwise("<html></html>").alias("html"), F.lit(1.0).alias("ms"), F.when(k % 7 == 6, "timeout").alias("error"),
    )


TO = "CASE WHEN page_id % 7 = 6 THEN NULL WHEN page_id % 3 = 0 THEN 'https://t.co/to/' || page_id WHEN page_id % 3 = 1 THEN 'https://other.example/' || page_id END"


@query(f"SELECT 'https://t.co/' || page_id AS url, coalesce({TO}, 'https://t.co/' || page_id) AS final_url, 'https://t.co/' || page_id || coalesce(' -> ' || {TO}, '') AS redirect_chain, CASE WHEN page_id % 7 = 6 THEN 'timeout' END AS error FROM pages")
def lu_unshorten(spark, d):
    return ln.unshorten(answers(spark, d)).select("url", "final_url", "redirect_chain", "error")


@query(f"SELECT page_id, {TO} AS target FROM pages WHERE page_id % 7 <> 6")
def lu_html_redirect(spark, d):
    a = answers(spark, d).where("error IS NULL").select(F.regexp_extract("url", r"(\d+)$", 1).cast("long").alias("page_id"), ln.html_redirect(F.col("html"), F.col("url")).alias("target"))
    return a


@query("SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'No URL' WHEN page_id % 7 = 6 THEN 'Error' ELSE 'OK' END AS row_status, CASE WHEN page_id % 5 = 0 THEN '' ELSE 'link' END AS processed_url_columns FROM pages")
def lu_row_status(spark, d):
    rows = table(spark, d, "pages").select("page_id", F.when(F.col("page_id") % 5 == 0, " ").otherwise(F.concat(F.lit("https://t.co/"), "page_id")).alias("link"))
    return ln.unshorten_columns(rows, ["link"], ln.unshorten(answers(spark, d))).select("page_id", "row_status", "processed_url_columns")


def sites(k):
    return F.when(k % 4 == 0, F.concat(F.lit("https://site"), k, F.lit(".example"))).when(k % 4 == 1, F.concat(F.lit("site"), k, F.lit(".example/a"))).when(k % 4 == 2, F.concat(F.lit(" site"), k, F.lit(".example:8080 "))).otherwise(F.lit(None))


CANDIDATES = "CASE page_id % 4 WHEN 0 THEN 'https://site' || page_id || '.example/' WHEN 1 THEN 'https://site' || page_id || '.example/a|http://site' || page_id || '.example/a' WHEN 2 THEN 'https://site' || page_id || '.example:8080/|http://site' || page_id || '.example:8080/' ELSE '' END"


@query(f"SELECT page_id, {CANDIDATES} AS candidates FROM pages")
def sl_normalize(spark, d):
    return table(spark, d, "pages").select("page_id", F.array_join(ln.candidate_urls(sites(F.col("page_id"))), "|").alias("candidates"))


def probes(spark, d):
    k = F.col("page_id")
    p = table(spark, d, "pages").select(k.alias("site"), ln.candidate_urls(sites(k)).alias("candidates"))
    s = F.col("site")
    attempt = lambda u: F.struct(u.alias("url"), F.when(s % 3 == 0, u).alias("final_url"), F.when(s % 3 == 0, F.lit(404)).cast("int").alias("http_status"), F.array().cast("array<string>").alias("chain"), F.lit(2.0).alias("ms"), F.when(s % 3 != 0, F.lit("refused")).alias("error"))
    return p.select("site", "candidates", F.lit(True).alias("dns_ok"), F.array(F.lit("10.0.0.1")).alias("resolved_ips"), F.lit(None).cast("string").alias("dns_error"), F.lit(False).alias("tcp_443_ok"), F.lit("443 closed").alias("tcp_443_error"), F.lit(True).alias("tcp_80_ok"), F.lit(None).cast("string").alias("tcp_80_error"), F.transform("candidates", attempt).alias("attempts"))


LIVE = "SELECT page_id AS site, page_id % 4 <> 3 AND page_id % 3 = 0 AS is_live, CASE WHEN page_id % 4 = 3 THEN 'Missing site/URL' WHEN page_id % 3 <> 0 THEN '443 closed | HTTP error: refused' END AS error, CASE WHEN page_id % 4 = 3 THEN 'No Site' WHEN page_id % 3 = 0 THEN 'OK' ELSE 'Error' END AS row_status FROM pages"


@query(LIVE)
def sl_verdict(spark, d):
    return ln.live_verdict(probes(spark, d)).select("site", "is_live", "error", "row_status")


@query(f"SELECT site, CASE WHEN site % 4 = 3 THEN 'No Site' ELSE 'Error' END AS row_status FROM ({LIVE})")
def sl_row_status(spark, d):
    """An answer counts only if its status does."""
    return ln.live_verdict(probes(spark, d), require_http_ok=True).select("site", "row_status")


@query("SELECT page_id AS site, page_id % 3 <> 0 AS dns_ok, CASE WHEN page_id % 3 = 0 THEN 'no such name' END AS dns_error, page_id % 3 = 1 AS is_live, CASE WHEN page_id % 3 = 1 THEN 200 WHEN page_id % 3 = 2 THEN 404 END AS http_status FROM pages")
def sl_probe(spark, d):
    """An injected prober that answers from the host alone."""
    k = F.col("page_id")

    def prober(candidates):
        n = int(candidates[0].split("//site")[1].split(".")[0])
        if n % 3 == 0:
            raise OSError("no such name")
        code = 200 if n % 3 == 1 else 404
        return {"dns_ok": True, "resolved_ips": ["10.0.0.1"], "dns_error": None, "tcp_443_ok": True, "tcp_443_error": None, "tcp_80_ok": True, "tcp_80_error": None, "attempts": [{"url": candidates[0], "final_url": candidates[0], "http_status": code, "chain": [candidates[0]], "ms": 1.0, "error": None}]}

    s = table(spark, d, "pages").select(k.alias("site"), ln.candidate_urls(F.concat(F.lit("site"), k, F.lit(".example"))).alias("candidates"))
    p = ln.probe_all(s, prober)
    v = ln.live_verdict(p, require_http_ok=True).select("site", "is_live")
    return p.join(v, "site").select("site", "dns_ok", "dns_error", "is_live", F.get("attempts", F.lit(0))["http_status"].alias("http_status"))


@query("SELECT 'https://x.com/u/status/' || c_custkey AS raw, CAST(c_custkey AS VARCHAR) AS post_id, CASE WHEN c_custkey % 3 = 0 THEN 'gone' ELSE 'live' END AS status FROM customer UNION ALL SELECT 'nothing', NULL, 'invalid_url'")
def ps_check_one(spark, d):
    """Whole check of posts: parsed, asked by an injected fetcher, judged."""
    rows = table(spark, d, "customer").select(F.concat(F.lit("https://x.com/u/status/"), "c_custkey").alias("raw")).unionByName(spark.createDataFrame([("nothing",)], "raw string"))
    return ps.check_posts(rows, "raw", lambda i: {"http_status": 404 if int(i) % 3 == 0 else 200, "error": None})


@query("SELECT 'x' AS platform, 'posts' AS mode, true AS supported UNION ALL SELECT 'x', 'accounts', true UNION ALL SELECT 'y', 'posts', false UNION ALL SELECT 'z', 'posts', true")
def ps_registry(spark, d):
    ps.register("z", r"(?i)https?://z\.example/", posts=(ps.parse_post, ps.post_verdict))
    return spark.createDataFrame([(p, m, ps.supported(p, m)) for p, m in (("x", "posts"), ("x", "accounts"), ("y", "posts"), ("z", "posts"))], "platform string, mode string, supported boolean")


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'user' || c_custkey END AS handle FROM customer")
def handle_from_url(spark, d):
    k = F.col("c_custkey")
    url = F.when(k % 2 == 0, F.concat(F.lit("https://x.com/user"), k, F.lit("?s=20"))).otherwise("https://x.com/home")
    return table(spark, d, "customer").select("c_custkey", ps.parse_account(url).alias("handle"))


@query("SELECT DISTINCT 'https://a.example/' || (doc_id % 50) AS url, doc_id % 50 AS first FROM documents")
def yt_extract_urls(spark, d):
    t = F.concat(F.lit("see https://a.example/"), F.col("doc_id") % 50, F.lit(")."))
    return ln.extract_urls(table(spark, d, "documents").select("doc_id", t.alias("t")), "t", "doc_id")


@query("SELECT page_id, ['Found', 'Not Found', 'Bad Request', 'Error'][page_id % 4 + 1] AS status, CASE WHEN page_id % 4 = 0 THEN 'https://v.example/' || page_id END AS embed_src FROM pages")
def yt_oembed(spark, d):
    k = F.col("page_id")
    a = table(spark, d, "pages").select("page_id", F.element_at(F.array(*map(F.lit, (200, 404, 400, 503))), (k % 4 + 1).cast("int")).alias("http_status"), F.when(k % 4 == 0, F.concat(F.lit('<iframe src="https://v.example/'), k, F.lit('"></iframe>'))).alias("html"))
    return ln.oembed_rows(a).select("page_id", "status", "embed_src")


@query("SELECT url, CASE WHEN page_id % 9 = 8 THEN 'timeout' ELSE 'ok' END AS status, CASE WHEN page_id % 9 = 8 THEN 0 ELSE octet_length(encode(html)) END AS bytes FROM pages")
def sd_download(spark, d):
    p = table(spark, d, "pages").select("page_id", "url", F.when(F.col("page_id") % 9 != 8, F.col("html")).alias("html"), F.when(F.col("page_id") % 9 == 8, "timeout").alias("error"))
    return ln.download_manifest(p, "page_id").select("url", "status", "bytes")


@query("SELECT page_id, starts_with(url, 'http://') OR starts_with(url, 'https://') AS http, regexp_extract(url, '^https?://([^/?#]*)', 1) AS netloc FROM pages")
def url_host(spark, d):
    from ..functions.text import domain

    return table(spark, d, "pages").select("page_id", is_http(F.col("url")).alias("http"), domain(F.col("url")).alias("netloc"))


# status


def handles(k):
    return F.when(k % 5 == 0, F.concat(F.lit("https://x.com/user"), k, F.lit("/status/"), k)).when(k % 5 == 1, k.cast("string")).when(k % 5 == 2, F.concat(F.lit("@user"), k)).when(k % 5 == 3, F.concat(F.lit("https://www.twitter.com/user"), k, F.lit("/"))).otherwise(F.lit("settings"))


POST_ID = "CASE WHEN c_custkey % 5 IN (0, 1) THEN CAST(c_custkey AS VARCHAR) END"
ACCOUNT = "CASE c_custkey % 5 WHEN 1 THEN CAST(c_custkey AS VARCHAR) WHEN 4 THEN NULL ELSE 'user' || c_custkey END"


@query(f"SELECT c_custkey, {POST_ID} AS post_id FROM customer")
def ps_parse_post(spark, d):
    return table(spark, d, "customer").select("c_custkey", ps.parse_post(handles(F.col("c_custkey"))).alias("post_id"))


@query(f"SELECT c_custkey, {ACCOUNT} AS account FROM customer")
def ps_parse_account(spark, d):
    return table(spark, d, "customer").select("c_custkey", ps.parse_account(handles(F.col("c_custkey"))).alias("account"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'other' ELSE 'x' END AS platform FROM customer")
def ps_platform(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select("c_custkey", ps.platform_of(F.when(k % 2 == 0, " Other").otherwise(""), handles(k)).alias("platform"))


@query(f"SELECT c_custkey, CASE WHEN {POST_ID} IS NULL THEN 'invalid_url' ELSE ['live', 'gone', 'rate_limited', 'error'][c_custkey % 4 + 1] END AS status FROM customer")
def ps_post_verdict(spark, d):
    k = F.col("c_custkey")
    code = F.element_at(F.array(*map(F.lit, (200, 404, 429, 500))), (k % 4 + 1).cast("int"))
    return table(spark, d, "customer").select("c_custkey", ps.post_verdict(ps.parse_post(handles(k)), code, F.lit(None).cast("string")).alias("status"))


def profile_pages(spark, d):
    k = F.col("c_custkey")
    body = (
        F.when(k % 4 == 0, '<script id="__NEXT_DATA__" type="application/json">{"hasResults":false,"headerProps":null}</script>')
        .when(k % 4 == 1, '<script id="__NEXT_DATA__" type="application/json">{"hasResults":true,"headerProps":{"n":1},"entries":[]}</script>')
        .when(k % 4 == 2, '<script id="__NEXT_DATA__" type="application/json">{"hasResults":true,"headerProps":{"n":1},"entries":["a","b"]}</script>').otherwise("nothing")
    )
    return table(spark, d, "customer").select("c_custkey", F.when(k % 6 == 5, 429).otherwise(200).alias("code"), body.alias("body"))


FIRST = "CASE WHEN c_custkey % 6 = 5 THEN 'rate_limited' ELSE ['not_found', 'suspended_or_deactivated', 'live', 'error'][c_custkey % 4 + 1] END"


@query("SELECT c_custkey, [false, true, true, NULL][c_custkey % 4 + 1] AS has_results, c_custkey % 4 IN (1, 2) AS has_header, CAST([NULL, 0, 2, NULL][c_custkey % 4 + 1] AS INTEGER) AS entries FROM customer")
def ps_next_data(spark, d):
    return profile_pages(spark, d).select("c_custkey", ps.timeline_fields(F.col("body")).alias("f")).select("c_custkey", "f.*")


@query(f"""SELECT c_custkey, CASE WHEN {ACCOUNT} IS NULL THEN 'invalid_url' WHEN f = 'not_found' THEN f WHEN s IS NULL THEN f WHEN s IN ('live', 'protected') THEN s WHEN f IN ('rate_limited', 'error') THEN 'unknown' ELSE s END AS status
    FROM (SELECT c_custkey, {FIRST} AS f, [NULL, 'live', 'protected', 'suspended_or_deactivated'][c_custkey % 7 % 4 + 1] AS s FROM customer)""")
def ps_account_verdict(spark, d):
    k = F.col("c_custkey")
    p = profile_pages(spark, d).withColumn("f", ps.timeline_fields(F.col("body")))
    second = F.element_at(F.array(F.lit(None).cast("string"), F.lit("live"), F.lit("protected"), F.lit("suspended_or_deactivated")), (k % 7 % 4 + 1).cast("int"))
    return p.select("c_custkey", ps.account_verdict(ps.parse_account(handles(k)), ps.timeline_verdict(F.col("code"), F.col("f")), second).alias("status"))


STREAK = "(SELECT c_custkey, c_nationkey, CASE WHEN c_custkey // 7 % 3 = 1 THEN 'rate_limited' ELSE 'live' END AS status FROM customer)"


@query(f"""WITH r AS (SELECT *, sum(CASE WHEN status <> 'rate_limited' THEN 1 ELSE 0 END) OVER (ORDER BY c_custkey) AS g FROM {STREAK}), s AS (SELECT *, CASE WHEN status = 'rate_limited' THEN count(*) FILTER (status = 'rate_limited') OVER (PARTITION BY g ORDER BY c_custkey) ELSE 0 END AS n FROM r),
    t AS (SELECT *, coalesce(max(CASE WHEN n >= 5 THEN 1 ELSE 0 END) OVER (ORDER BY c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped FROM s) SELECT c_custkey, CASE WHEN stopped = 1 THEN 'skipped' ELSE status END AS status FROM t""")
def ps_abort(spark, d):
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").select("c_custkey", F.when(F.floor(k / 7) % 3 == 1, "rate_limited").otherwise("live").alias("status"))
    return ps.abort_after(rows, "c_custkey")


@query(f"SELECT status, count(*) AS count FROM {STREAK} GROUP BY 1")
def ps_counts(spark, d):
    return ps.counts(table(spark, d, "customer").select(F.when(F.floor(F.col("c_custkey") / 7) % 3 == 1, "rate_limited").otherwise("live").alias("status")))


@query("SELECT trim(c_mktsegment) AS line, min(c_custkey) AS first FROM customer GROUP BY 1")
def ps_dedup_paste(spark, d):
    return ps.dedup_lines(table(spark, d, "customer"), "c_mktsegment", "c_custkey")


@query("SELECT c_custkey, c_nationkey, 'checked' AS c_mktsegment FROM customer")
def ps_result_merge(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return ps.merged(c, c.select("c_custkey", F.lit("checked").alias("c_mktsegment")), "c_custkey")


# relabelling: part types are topics


def topics(spark, d):
    return table(spark, d, "part").select("p_partkey", F.lit("all").alias("topic_depth_1"), F.col("p_brand").alias("topic_depth_2"), F.when(F.col("p_partkey") % 10 != 0, F.col("p_type")).alias("topic_depth_3"))


def metadata(spark, d):
    p = table(spark, d, "part")
    return p.groupBy("p_brand").agg(F.min("p_partkey").alias("topic_id")).select(F.lit(2).alias("depth"), "topic_id", F.lit(None).cast("string").alias("topic_depth_1"), F.col("p_brand").alias("topic_depth_2"), F.lit(None).cast("string").alias("topic_depth_3"), F.concat("p_brand", F.lit("/x/y")).alias("topic_description"))


T_ = "(SELECT p_partkey, 'all' AS topic_depth_1, p_brand AS topic_depth_2, CASE WHEN p_partkey % 10 <> 0 THEN p_type END AS topic_depth_3 FROM part)"
M_ = "(SELECT p_brand AS label, min(p_partkey) AS topic_id FROM part GROUP BY 1)"


@query(f"""SELECT 1 AS depth, count(DISTINCT topic_depth_1) AS topics, count(topic_depth_1) AS posts_assigned, '' AS examples FROM {T_} UNION ALL SELECT 2, count(DISTINCT topic_depth_2), count(topic_depth_2), (SELECT string_agg(label, ', ' ORDER BY topic_id) FROM (SELECT * FROM {M_} ORDER BY topic_id LIMIT 4)) FROM {T_}
    UNION ALL SELECT 3, count(DISTINCT topic_depth_3), count(topic_depth_3), '' FROM {T_}""")
def nr_depth_summary(spark, d):
    return nr.depth_summary(topics(spark, d), metadata(spark, d))


@query(f"SELECT topic_id, label AS nomic_label, label || ', x, y' AS common_keywords, (SELECT count(*) FROM part WHERE p_brand = label) AS n_posts FROM {M_}")
def nr_label_table(spark, d):
    return nr.label_table(topics(spark, d), metadata(spark, d), 2).select("topic_id", "nomic_label", "common_keywords", "n_posts")


@query("SELECT CAST(p_partkey AS VARCHAR) AS id, p_type AS topic FROM part WHERE p_partkey % 10 <> 0")
def nr_topic_lookup(spark, d):
    return nr.topic_lookup(topics(spark, d), "p_partkey", 3)


@query(f"SELECT p_partkey, topic_depth_2 AS topic FROM (SELECT *, row_number() OVER (PARTITION BY topic_depth_2 ORDER BY p_partkey) AS r FROM {T_}) WHERE r <= 5")
def nr_sample(spark, d):
    return nr.sample(topics(spark, d), "p_partkey", 2, 5, None)


@query(f"SELECT p_partkey, l.o AS label_order FROM part JOIN (SELECT label, CAST(row_number() OVER (ORDER BY n DESC, topic_id) AS INTEGER) AS o FROM (SELECT label, topic_id, (SELECT count(*) FROM part WHERE p_brand = label) AS n FROM {M_})) l ON p_brand = label")
def nr_workbook_order(spark, d):
    t = topics(spark, d)
    return nr.workbook_order(t, nr.label_table(t, metadata(spark, d), 2), "topic_depth_2", "p_partkey").select("p_partkey", "label_order")


def edited(spark, d):
    p = table(spark, d, "part").groupBy("p_brand").agg(F.min("p_partkey").alias("row_index"))
    return p.select("row_index", F.concat(F.lit(" "), "p_brand").alias("nomic_label"), F.when(F.col("row_index") % 2 == 0, F.concat(F.lit("S "), "p_brand")).otherwise("nan").alias("new_label"), F.when(F.col("row_index") % 3 == 0, "B").alias("broad_label"))


L_ = "(SELECT min(p_partkey) AS row_index, p_brand AS nomic_label, CASE WHEN min(p_partkey) % 2 = 0 THEN 'S ' || p_brand ELSE '' END AS specific_label, CASE WHEN min(p_partkey) % 3 = 0 THEN 'B' ELSE '' END AS broad_label FROM part GROUP BY p_brand)"


@query(f"SELECT nomic_label, specific_label, broad_label FROM {L_}")
def nr_read_labels(spark, d):
    return nr.read_labels(edited(spark, d)).drop("row_index")


@query(f"SELECT nomic_label, coalesce(nullif(specific_label, ''), nomic_label) AS specific, broad_label AS broad FROM {L_}")
def nr_build_mapping(spark, d):
    return nr.build_mapping(nr.read_labels(edited(spark, d)), "row_index")


@query(f"SELECT DISTINCT p_brand AS topic FROM part WHERE p_brand NOT IN (SELECT nomic_label FROM {L_} WHERE row_index % 2 = 0)")
def nr_unmapped_check(spark, d):
    m = nr.build_mapping(nr.read_labels(edited(spark, d)).where("row_index % 2 = 0"), "row_index")
    return nr.unmapped(nr.topic_lookup(topics(spark, d), "p_partkey", 2), m)


@query(f"""SELECT p_partkey, p_name, nomic_label, coalesce(nullif(specific_label, ''), nomic_label) AS "Topic (Specific)", coalesce(nullif(broad_label, ''), '(unassigned)') AS "Topic (Broad)" FROM part JOIN {L_} ON p_brand = nomic_label""")
def nr_relabel_join(spark, d):
    rows = table(spark, d, "part").select("p_partkey", "p_name")
    return nr.relabel(rows, nr.topic_lookup(topics(spark, d), "p_partkey", 2), nr.build_mapping(nr.read_labels(edited(spark, d)), "row_index"), "p_partkey")


@query("SELECT CAST(o_orderkey AS INTEGER) AS o_orderkey, CAST(o_orderkey * 1000000 AS FLOAT) AS wide, CAST(o_totalprice AS FLOAT) AS o_totalprice, CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'false' END AS flag, o_orderdate FROM orders")
def nr_coerce(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") * 1_000_000).alias("wide"), "o_totalprice", (F.col("o_orderkey") % 2 == 0).alias("flag"), "o_orderdate")
    return nr.coerce(o)


# payloads


def posts(spark, d):
    p = table(spark, d, "pages")
    fields = {c: F.lit(None).cast("string").alias(c) for c in en.POST_FIELDS}
    k = F.col("page_id")
    term = lambda i, n, t: F.struct(F.lit(i).cast("long").alias("id"), n.alias("name"), F.lit(t).alias("taxonomy"))
    text = lambda c: F.struct(c.alias("rendered"))
    fields |= {"id": k.alias("id"), "link": F.col("url").alias("link"), "sticky": F.lit(False).alias("sticky"), "author": k.alias("author"), "featured_media": k.alias("featured_media")}
    return p.select(
        *fields.values(), text(F.concat(F.lit("<b>T"), k, F.lit("</b> "))).alias("title"), text(F.col("html")).alias("content"), text(F.lit("")).alias("excerpt"), F.array(k, k + 1).alias("categories"), F.array().cast("array<long>").alias("tags"), F.create_map(F.lit("a"), k.cast("string")).alias("meta"),
        F.struct(F.array(F.struct(F.concat(F.lit("A"), k % 3).alias("name"))).alias("author"), F.array(F.array(term(1, F.lit("c2"), "category"), term(2, F.lit("c1"), "category")), F.array(term(3, F.lit("t"), "post_tag"))).alias("wp:term")).alias("_embedded"),
    )


@query("SELECT page_id AS id, 'T' || page_id AS title, page_id || ', ' || (page_id + 1) AS categories, 'A' || (page_id % 3) AS author_name, 'c1, c2' AS category_names, 't' AS tag_names, '{\"a\":\"' || page_id || '\"}' AS meta_json FROM pages")
def wp_flatten(spark, d):
    return en.flatten_posts(posts(spark, d)).select("id", "title", "categories", "author_name", "category_names", "tag_names", "meta_json")


@query("SELECT page_id, trim(regexp_replace(html, '(?s)<.*?>', '', 'g')) AS plain FROM pages")
def wp_strip_html(spark, d):
    from ..functions.text import strip_tags

    return table(spark, d, "pages").select("page_id", strip_tags(F.col("html")).alias("plain"))


@query("SELECT c_custkey, 'https://site' || c_custkey || '.example/wp-json/wp/v2/posts' AS endpoint FROM customer")
def wp_endpoint(spark, d):
    return table(spark, d, "customer").select("c_custkey", en.endpoint(F.concat(F.lit(" site"), "c_custkey", F.lit(".example/"))).alias("endpoint"))


@query("SELECT term, min(p_partkey) AS first FROM (SELECT p_partkey, unnest([p_brand, p_type]) AS term FROM part) GROUP BY 1")
def tk_terms(spark, d):
    return en.terms(table(spark, d, "part").select("p_partkey", F.concat("p_brand", F.lit(" ,"), "p_type", F.lit("\n")).alias("t")), "t", "p_partkey")


@query("SELECT o_orderkey, CAST(epoch(date_trunc('day', o_orderdate)) AS BIGINT) AS start, CAST(epoch(date_trunc('day', o_orderdate)) + 4 * 86400 - 1 AS BIGINT) AS end FROM orders")
def tk_time_window(spark, d):
    w = en.time_window(F.lit(None), first_day=F.col("o_orderdate"), last_day=F.date_add("o_orderdate", 3))
    return table(spark, d, "orders").select("o_orderkey", w.alias("w")).select("o_orderkey", "w.*")


def ads(spark, d):
    k = F.col("p_partkey")
    fields = [(k.cast("string") if c == "id" else F.lit(None).cast("string")).alias(c) for c in en.AD_FIELDS]
    return table(spark, d, "part").where("p_brand <> 'Brand#1'").select(*fields, F.array(F.concat(F.lit("v"), k)).alias("videos"), F.array().cast("array<string>").alias("image_urls"), F.col("p_brand").alias("search_term"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS id, '[\"v' || p_partkey || '\"]' AS videos, '' AS image_urls, p_brand AS search_term FROM part WHERE p_brand <> 'Brand#1'")
def tk_flatten(spark, d):
    return en.flatten_ads(ads(spark, d)).select("id", "videos", "image_urls", "search_term")


@query("SELECT p_brand AS search_term, count(*) FILTER (p_brand <> 'Brand#1') AS items_collected, CASE WHEN p_brand = 'Brand#1' THEN 'HTTP 500' ELSE '' END AS error FROM part GROUP BY p_brand")
def tk_summary(spark, d):
    t = table(spark, d, "part").select(F.col("p_brand").alias("term")).distinct()
    return en.ad_summary(t, ads(spark, d), spark.createDataFrame([("Brand#1", "HTTP 500")], "search_term string, error string"))


def entities(spark, d):
    k = F.col("c_custkey")
    snak = lambda kind, v: F.struct(F.lit(kind).alias("snaktype"), v.alias("value"))
    claims = F.create_map(F.lit("P1"), F.array(snak("value", F.concat(F.lit('"u'), k, F.lit('"'))), snak("somevalue", F.lit('"x"'))), F.lit("P2"), F.array(snak("value", F.lit('{"id":"Q1"}')), snak("value", F.concat(F.lit('{"id":"Q'), k, F.lit('"}')))), F.lit("P9"), F.array(snak("value", F.lit('"no"'))))
    return table(spark, d, "customer").select(F.concat(F.lit("Q"), k).alias("qid"), claims.alias("claims"))


CLAIMS = "(SELECT 'Q' || c_custkey AS qid, 'P1' AS property, 'u' || c_custkey AS value FROM customer UNION ALL SELECT 'Q' || c_custkey, 'P2', 'Q' || c_custkey FROM customer)"


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'Q' || c_custkey WHEN 1 THEN 'plain' ELSE '+' || c_custkey END AS value FROM customer")
def wd_scalar(spark, d):
    k = F.col("c_custkey")
    v = F.when(k % 3 == 0, F.concat(F.lit('{"id":"Q'), k, F.lit('"}'))).when(k % 3 == 1, '"plain"').otherwise(F.concat(F.lit('{"amount":"+'), k, F.lit('","unit":"1"}')))
    return table(spark, d, "customer").select("c_custkey", en.scalar(v).alias("value"))


@query(f"SELECT qid, property, value FROM {CLAIMS}")
def wd_claims(spark, d):
    return en.claims(entities(spark, d), ["P1", "P2"])


def accounts(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select("c_custkey", F.when(k % 2 == 0, F.concat(F.lit("u"), k)).otherwise("").alias("handle"), F.when(k % 3 == 0, F.concat(F.lit("mail"), k)).alias("mail"), F.when(k % 5 == 0, "kept").otherwise(" ").alias("note"))


def known(spark, d):
    k = F.col("c_custkey")
    c = table(spark, d, "customer")
    return c.select(F.lit("P1").alias("property"), F.concat(F.lit("u"), k).alias("value"), F.concat(F.lit("Q"), k).alias("qid")).unionByName(c.select(F.lit("P3").alias("property"), F.concat(F.lit("mail"), k).alias("value"), F.concat(F.lit("Q9"), k).alias("qid")))


MAPPING = {"handle": "P1", "mail": "P3"}
RESOLVED = "(SELECT c_custkey AS row_index, CASE WHEN c_custkey % 2 = 0 THEN 'Q' || c_custkey ELSE 'Q9' || c_custkey END AS qid FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0)"


@query(f"SELECT row_index, qid FROM {RESOLVED}")
def wd_resolve(spark, d):
    return en.resolve(accounts(spark, d), "c_custkey", MAPPING, known(spark, d))


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'kept' WHEN c_custkey % 2 = 0 THEN 'u' || c_custkey ELSE ' ' END AS note, c_custkey % 5 <> 0 AND c_custkey % 2 = 0 AS updated FROM customer")
def wd_fill(spark, d):
    a = accounts(spark, d)
    q = en.resolve(a, "c_custkey", {"handle": "P1"}, known(spark, d))
    return en.fill(a, "c_custkey", q, en.claims(entities(spark, d), ["P1", "P2"]), {"note": "P1"}).select("c_custkey", "note", "updated")


@query("SELECT 'P1' AS property, 'u' || c_custkey AS value FROM customer WHERE c_custkey % 2 = 0 UNION SELECT 'P3', 'mail' || c_custkey FROM customer WHERE c_custkey % 3 = 0")
def wd_mapping(spark, d):
    return en.lookup_keys(accounts(spark, d), MAPPING)
