"""Queries of sources and sinks: tables are written in a format and read back by the engine's readers."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import functions as F

from ..operators import enrich as en
from ..operators import image_match as im
from ..operators import lexicon as lx
from ..operators import links as ln
from ..operators import relabel as nr
from ..operators import transfers as cr
from ..sources import api, roles, sinks, tables, xlsx
from ..sources.files import shared_folder
from .registry import query, table


def _part(spark, d):
    return table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice")


@query("SELECT p_partkey, p_name, p_size, p_retailprice FROM part")
def src_csv_infer(spark, d):
    path = shared_folder(spark, "csv")
    sinks.write_csv(_part(spark, d), path)
    return tables.csv_infer(spark, path).select(F.col("p_partkey").cast("long"), "p_name", F.col("p_size").cast("int"), F.col("p_retailprice").cast("double"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, CASE WHEN p_size % 2 = 0 THEN '' ELSE p_name END AS p_name FROM part")
def src_csv_str(spark, d):
    path = shared_folder(spark, "csv")
    sinks.write_csv(_part(spark, d).select("p_partkey", F.when(F.col("p_size") % 2 == 0, "").otherwise(F.col("p_name")).alias("p_name")), path)
    return tables.csv_strings(spark, path)


@query("SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_brand FROM part")
def src_csv_sniff(spark, d):
    path = shared_folder(spark, "csv")
    _part(spark, d).select("p_partkey", F.concat(F.lit(" "), "p_brand").alias("p_brand")).write.csv(path, header=True, sep=";")
    return tables.csv_sniffed(spark, path)


@query("SELECT p_partkey, p_name FROM part")
def src_json_array(spark, d):
    """Files of one array each: a reader of whole files takes the first value of a file only."""
    path = shared_folder(spark, "json")
    rows = _part(spark, d).groupBy(F.floor(F.col("p_partkey") / 5000).alias("g")).agg(F.collect_list(F.struct("p_partkey", "p_name")).alias("r"))
    rows.select(F.to_json("r").alias("value")).write.option("lineSep", "\n").option("maxRecordsPerFile", 1).text(path)
    return tables.json_array(spark, path).select("p_partkey", "p_name")


@query("SELECT 'chat' || (conv_id % 3) AS name, count(*) AS messages FROM conversations GROUP BY 1")
def src_telegram_json(spark, d):
    path = shared_folder(spark, "chats")
    c = table(spark, d, "conversations").groupBy((F.col("conv_id") % 3).alias("id")).agg(F.collect_list(F.struct(F.lit(None).cast("string").alias("forwarded_from"), F.lit("words").alias("text"))).alias("messages"))
    c.select(F.concat(F.lit("chat"), "id").alias("name"), F.col("id").cast("string").alias("id"), "messages").write.option("maxRecordsPerFile", 1).json(path)
    return tables.telegram(spark, path).groupBy("name").agg(F.sum(F.size("messages")).cast("long").alias("messages"))


@query("SELECT p_name AS line FROM part")
def src_lines(spark, d):
    path = shared_folder(spark, "lines")
    _part(spark, d).select(F.concat(F.lit("  "), "p_name", F.lit(" \n\n")).alias("value")).write.text(path)
    return tables.lines(spark, path)


@query("SELECT CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS country, CASE WHEN p_partkey % 2 = 0 THEN p_name END AS site, CASE WHEN p_partkey % 2 = 1 THEN p_name END AS query FROM part")
def src_paste_rows(spark, d):
    line = F.when(F.col("p_partkey") % 2 == 0, F.concat("p_brand", F.lit(" , "), "p_name", F.lit(",x"))).otherwise(F.col("p_name"))
    return tables.pasted_rows(_part(spark, d).select(line.alias("line")))


@query("SELECT p_partkey, p_name, p_brand, CASE WHEN p_partkey % 2 = 0 THEN 'even' ELSE 'odd' END AS which FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name END AS p_name, CASE WHEN p_partkey % 2 = 1 THEN p_brand END AS p_brand FROM part)")
def src_multi_file(spark, d):
    base = shared_folder(spark, "many")
    p = _part(spark, d)
    sinks.write_csv(p.where("p_partkey % 2 = 0").select("p_partkey", "p_name"), f"{base}/even")
    sinks.write_csv(p.where("p_partkey % 2 = 1").select("p_partkey", "p_brand"), f"{base}/odd")
    return tables.many_files(spark, [f"{base}/even", f"{base}/odd"]).select(F.col("p_partkey").cast("long").alias("p_partkey"), "p_name", "p_brand", F.col("source_file").alias("which"))


@query("SELECT 'https://feed.example/' || c_custkey AS link FROM customer")
def src_feed_xml(spark, d):
    path = shared_folder(spark, "feed")
    k = F.col("c_custkey")
    u = F.concat(F.lit("https://feed.example/"), k)
    row = F.when(k % 3 == 0, F.concat(F.lit("<item><title>t</title><link> "), u, F.lit(" </link></item>"))).when(k % 3 == 1, F.concat(F.lit('<a:entry><a:link rel="x" href="'), u, F.lit('"/></a:entry>'))).otherwise(F.concat(F.lit("<url><loc>"), u, F.lit("</loc></url>")))
    table(spark, d, "customer").select(row.alias("value")).write.text(path)
    return tables.feed_links(spark, path).select("link")


@query("SELECT url FROM pages WHERE starts_with(url, 'http')")
def src_url_list(spark, d):
    return tables.url_list(table(spark, d, "pages").select("page_id", "url"))


@query("SELECT 'p_name' AS text, 'p_brand' AS generic, 'p_partkey' AS address")
def col_roles(spark, d):
    p = _part(spark, d)
    row = (roles.text_column(p), roles.generic_column(p, None, ["Brand"], "brand"), roles.preferred_column(p.columns, None, ("address", "wallet")))
    return spark.createDataFrame([row], "text string, generic string, address string")


@query("SELECT 'ts' AS column")
def col_datetime(spark, d):
    return spark.createDataFrame([(roles.datetime_column(table(spark, d, "events").select("event_type", "ts", "user_id")),)], "`column` string")


@query("SELECT n_name AS key, CAST(p AS BIGINT) AS page, CAST(i AS BIGINT) AS item FROM nation, range(0, 3) r(p), range(0, 2) s(i) WHERE n_nationkey % 5 <> 4")
def src_api_pages(spark, d):
    """A paged source over a transport without a network; every fifth key fails."""
    bad = {r["n_name"] for r in table(spark, d, "nation").where("n_nationkey % 5 = 4").collect()}

    def transport(key, cursor):
        page = cursor or 0
        return (404, [], None) if key in bad else (200, [(page, i) for i in range(2)], page + 1 if page < 2 else None)

    api.register(spark, "quill_pages", "page long, item long", transport)
    keys = [r["n_name"] for r in table(spark, d, "nation").select("n_name").collect()]
    return api.read(spark, "quill_pages", keys).where("error IS NULL").select("key", "page", "item")


@query("SELECT p_brand AS dimension, p_type AS value, count(*) AS mentions FROM part, range(0, 2) r(i) GROUP BY 1, 2, r.i")
def sink_csv_sections(spark, d):
    path = shared_folder(spark, "sections")
    long = table(spark, d, "part").groupBy(F.col("p_brand").alias("dimension"), F.col("p_type").alias("value")).agg(F.count("*").alias("mentions"))
    sinks.write_sections(long, path)
    folders = spark.read.csv(path, header=True, schema="value string, mentions long, dimension string").select("dimension", "value", "mentions")
    # the sections of one text say the same; both are given, and SQL has each row twice
    out, section = [], None
    for block in sinks.sections_text(folders.orderBy("dimension", "value")).split("\n\n"):
        section, _, *lines = block.strip("\n").split("\n")
        out += [(section, x.rpartition(",")[0].strip('"'), int(x.rpartition(",")[2])) for x in lines]
    return folders.unionByName(spark.createDataFrame(out, "dimension string, value string, mentions long"))


@query("SELECT string_agg(CASE WHEN contains(r_name, ' ') THEN '\"' || r_name || '\"' ELSE r_name END, ' OR ' ORDER BY r_regionkey) AS query FROM region")
def sink_boolean_query(spark, d):
    return sinks.boolean_query(table(spark, d, "region"), "r_name", "r_regionkey")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def sink_preview(spark, d):
    return sinks.preview(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), 100, F.desc("o_totalprice"), "o_orderkey")


@query("SELECT c_custkey, c_mktsegment || '; ' || c_nationkey AS cells FROM customer")
def sink_list_cells(spark, d):
    return sinks.list_cells(table(spark, d, "customer").select("c_custkey", F.array("c_mktsegment", F.col("c_nationkey").cast("string")).alias("cells")))


@query("""SELECT r_regionkey, '{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"}' AS json FROM region""")
def sink_json_state(spark, d):
    r = table(spark, d, "region").select("r_regionkey", "r_name")
    return sinks.json_rows(r).select(F.get_json_object("json", "$.r_regionkey").cast("int").alias("r_regionkey"), "json")


@query("SELECT p_partkey, p_name || ' é' AS p_name FROM part")
def src_csv_encoding(spark, d):
    path = shared_folder(spark, "latin")
    p = _part(spark, d).select("p_partkey", F.concat("p_name", F.lit(" é")).alias("p_name"))
    p.write.csv(path, header=True, encoding="ISO-8859-1")
    return tables.csv_encoded(spark, path).select(F.col("p_partkey").cast("long").alias("p_partkey"), "p_name")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def src_csv_chunked(spark, d):
    """A large table read in splits; nothing holds it whole."""
    path = shared_folder(spark, "chunks")
    sinks.write_csv(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), path)
    return tables.csv_strings(spark, path).select(F.col("l_orderkey").cast("long").alias("l_orderkey"), F.col("l_linenumber").cast("int").alias("l_linenumber"), F.col("l_quantity").cast("double").alias("l_quantity"))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name || ', \"N\"' AS name FROM nation UNION ALL SELECT 'short', ''")
def src_url_csv(spark, d):
    """The answer is a table as a service would give it, with quotes, commas and a short line."""
    rows = table(spark, d, "nation").select("n_nationkey", "n_name").collect()
    body = "id,name\n" + "".join('%s,"%s, ""N"""\n' % (r[0], r[1]) for r in rows) + "short\n"
    return tables.csv_from_url(spark, "https://t.example/t.csv", lambda url: body)


def _workbook(spark, sheets):
    import io

    f = io.BytesIO()
    xlsx.write_workbook(sheets, f)
    return spark.createDataFrame([(f.getvalue(),)], "content binary")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name FROM nation")
def src_excel(spark, d):
    return xlsx.parse(_workbook(spark, {"nation": table(spark, d, "nation").select("n_nationkey", "n_name")}), ["n_nationkey", "n_name"])


@query("SELECT CAST(r_regionkey AS VARCHAR) AS r_regionkey, r_name FROM region")
def sink_xlsx(spark, d):
    return xlsx.parse(_workbook(spark, {"region": table(spark, d, "region").select("r_regionkey", "r_name")}), ["r_regionkey", "r_name"])


@query("SELECT CAST(r_regionkey AS VARCHAR) AS r_regionkey, r_name FROM region")
def sink_xlsx_multi(spark, d):
    """The second of two sheets."""
    return xlsx.parse(_workbook(spark, {"nation": table(spark, d, "nation").select("n_name"), "region": table(spark, d, "region").select("r_regionkey", "r_name")}), ["r_regionkey", "r_name"], "region")


@query("SELECT n_nationkey, n_name FROM nation")
def sink_csv(spark, d):
    path = shared_folder(spark, "csv")
    sinks.write_csv(table(spark, d, "nation").select("n_nationkey", "n_name"), path, one_file=True)
    return spark.read.csv(path, header=True, schema="n_nationkey int, n_name string")


@query("SELECT event_id, ts FROM events")
def sink_excel_safe(spark, d):
    return sinks.spreadsheet_safe(table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts")))


def _nation_graph(spark, d):
    n = table(spark, d, "nation").select(F.col("n_name").alias("term"), "n_regionkey")
    a, b = n.select(F.col("term").alias("a"), "n_regionkey"), n.select(F.col("term").alias("b"), "n_regionkey")
    return n, a.join(b, "n_regionkey").where("a < b").select("a", "b", F.lit(1).cast("long").alias("weight"))


GRAPH = "SELECT 'node' AS kind, n_name AS a, '' AS b, CAST(NULL AS DOUBLE) AS weight FROM nation UNION ALL SELECT 'edge', a.n_name, b.n_name, 1.0::DOUBLE FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_name < b.n_name"


def _graph_rows(spark, text, value):
    """Nodes and edges of a graph's XML, parsed back."""
    from xml.etree import ElementTree

    name = lambda e: e.tag.rpartition("}")[2]
    every = list(ElementTree.fromstring(text.encode()).iter())
    rows = [("node", e.get("id"), "", None) for e in every if name(e) == "node"]
    rows += [("edge", e.get("source"), e.get("target"), float(value(e))) for e in every if name(e) == "edge"]
    return spark.createDataFrame(rows, "kind string, a string, b string, weight double")


@query(GRAPH)
def sink_graphml(spark, d):
    return _graph_rows(spark, sinks.graphml(*_nation_graph(spark, d)), lambda e: e[0].text)


@query(GRAPH)
def sink_gexf(spark, d):
    n, e = _nation_graph(spark, d)
    text = sinks.gexf(n.select(F.col("term").alias("address"), F.col("term").alias("label")), e.select(F.col("a").alias("from"), F.col("b").alias("to"), F.col("weight").alias("count")))
    return _graph_rows(spark, text, lambda e: e.get("weight"))


@query("SELECT url, octet_length(encode(html)) AS bytes FROM pages")
def sink_zip_manifest(spark, d):
    """The archive is written, opened again, and its manifest's files are measured."""
    import csv
    import io
    import zipfile

    p = table(spark, d, "pages").select("page_id", "url", "html", F.lit(None).cast("string").alias("error"))
    held = io.BytesIO()
    sinks.write_archive(ln.download_manifest(p, "page_id", ("html",)), None, held)
    with zipfile.ZipFile(held) as z:
        rows = [(r["url"], len(z.read(r["filename"]))) for r in csv.DictReader(io.StringIO(z.read("manifest.csv").decode()))]
    return spark.createDataFrame(rows, "url string, bytes long")


@query("SELECT page_id, base64(encode(url)) AS content FROM pages")
def sink_b64(spark, d):
    return sinks.as_base64(table(spark, d, "pages").select("page_id", F.col("url").cast("binary").alias("content")), "content")


@query("SELECT 'https://h.example/' || c_custkey AS url, CAST(200 AS INTEGER) AS http_status FROM customer")
def sink_checkpoint(spark, d):
    """Fetched in batches; the second call finds all of them done and asks nothing."""
    urls = table(spark, d, "customer").select(F.concat(F.lit("https://h.example/"), "c_custkey").alias("url"))
    folder = shared_folder(spark, "fetched")
    ln.fetch_batches(urls, lambda u: {"final_url": u, "http_status": 200, "chain": [u], "content_type": "", "html": "", "ms": 0.0, "error": None}, folder, 4)
    return ln.fetch_batches(urls, lambda u: {"http_status": 500}, folder, 4).select("url", "http_status")


@query("SELECT p_partkey AS id, p_name AS text FROM part")
def sink_atlas_upload(spark, d):
    """Rows are checked, sent in batches by the tasks to an injected client (here: a table), and counted."""
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"))
    folder = tempfile.mkdtemp(prefix="quillspark-sent-")

    def client(batch):
        with open(f"{folder}/{uuid.uuid4().hex}.json", "w") as f:
            f.write("".join(json.dumps(r) + "\n" for r in batch))

    done = []
    sent = sinks.upload(rows, client, 500, "id", "text", lambda: done.append("created"), lambda c: done.append(f"index on {c}"))
    back = spark.read.schema("id long, text string").json(folder)
    if done != ["created", "index on text"] or sent != rows.count():
        raise ValueError("the upload is not whole")
    return back


@query("SELECT s AS value, s IN ('1', 'on', 'Yes') AS truthy FROM (SELECT unnest(['1', 'on', 'Yes', 'no', '']) AS s)")
def lx_truthy(spark, d):
    return spark.createDataFrame([(v, lx.truthy(v)) for v in ("1", "on", "Yes", "no", "")], "value string, truthy boolean")


def _png(pixels) -> bytes:
    """A grey picture as a PNG file."""
    import struct
    import zlib

    h, w = pixels.shape
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    lines = b"".join(b"\0" + row.tobytes() for row in pixels)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(lines)) + part(b"IEND", b"")


def _pictures(spark, d):
    """PNG files in a folder, read by Spark's image source: 25 pictures of waves, each as a small and a large one and a brighter one."""
    import numpy as np

    names = [r["n_nationkey"] for r in table(spark, d, "nation").select("n_nationkey").collect()]
    folder = tempfile.mkdtemp(prefix="quillspark-pictures-")
    for k in names:
        rng = np.random.default_rng(k)
        waves = rng.standard_normal((20, 20)) / (1 + np.add.outer(np.arange(20), np.arange(20)))
        for kind, n, more in (("a", 96, 0), ("b", 192, 0), ("c", 96, 12)):
            x = np.cos(np.pi * np.outer(np.arange(20), np.arange(n) + 0.5) / n)
            grey = x.T @ waves @ x
            grey = 40 + 160 * (grey - grey.min()) / (grey.max() - grey.min()) + more
            with open(f"{folder}/{k}{kind}.png", "wb") as f:
                f.write(_png(np.round(grey).astype(np.uint8)))
    return spark.read.format("image").load(folder)


@query("SELECT CAST(n_nationkey AS VARCHAR) AS picture, kind, true AS near_own, true AS far_from_others FROM nation, (SELECT unnest(['b', 'c']) AS kind)")
def im_phash(spark, d):
    """Larger and brighter pictures have the hash of the first within 15 bits, and no other picture has."""
    h = im.hash_images(_pictures(spark, d)).select(F.regexp_extract("name", r"(\d+)[abc]\.png$", 1).alias("picture"), F.regexp_extract("name", r"([abc])\.png$", 1).alias("kind"), "hash")
    first = h.where("kind = 'a'").select(F.col("picture").alias("other"), F.col("hash").alias("first"))
    apart = h.where("kind <> 'a'").join(first).withColumn("bits", im.hamming(F.col("hash"), F.col("first")))
    own = F.col("picture") == F.col("other")
    return apart.groupBy("picture", "kind").agg(F.max(F.when(own, F.col("bits") <= 15)).alias("near_own"), F.min(F.when(~own, F.col("bits") > 15)).alias("far_from_others"))


@query("SELECT n_nationkey || kind || '.png' AS name, size AS height, size AS width, CAST(1 AS INTEGER) AS channels FROM nation, (SELECT unnest(['a', 'b', 'c']) AS kind, unnest([96, 192, 96]) AS size)")
def src_images(spark, d):
    return _pictures(spark, d).select(F.regexp_extract("image.origin", "([^/]+)$", 1).alias("name"), "image.height", "image.width", F.col("image.nChannels").alias("channels"))


@query("SELECT c_custkey, i AS band, (c_custkey >> (16 * i)) & 65535 AS key FROM customer, range(0, 4) r(i)")
def im_bits(spark, d):
    h = F.array(F.col("c_custkey"), *(F.lit(0).cast("long"),) * 3)
    return table(spark, d, "customer").select("c_custkey", F.posexplode(im.bands(h)).alias("band", "key")).where("band < 4").select("c_custkey", F.col("band").cast("long").alias("band"), F.col("key").cast("long").alias("key"))


@query("SELECT page_id, starts_with(url, 'http://') OR starts_with(url, 'https://') AS http FROM pages")
def url_is_http(spark, d):
    from ..functions.text import is_http

    return table(spark, d, "pages").select("page_id", is_http(F.col("url")).alias("http"))


# services, by transports without a network


def _service(keys, schema, page):
    """Pages of each key of a one-column table, by a transport without a network."""
    return api.read_keys(keys, schema, lambda key, cursor: page(key, cursor or 0)).where("error IS NULL")


@query("SELECT n_name AS search_term, n_name || '-' || (i // 3) || '-' || (i % 3) AS id FROM nation, range(0, 6) r(i)")
def src_api_ads(spark, d):
    ads = _service(table(spark, d, "nation").select("n_name"), "id string", lambda k, c: (200, [(f"{k}-{c}-{i}",) for i in range(3)], c + 1 if c < 1 else None))
    return ads.select(F.col("key").alias("search_term"), "id")


@query("SELECT 'https://site' || n_nationkey || '.example/wp-json/wp/v2/posts' AS endpoint, i AS id, 't' || (i % 2) AS title FROM nation, range(0, 4) r(i)")
def src_api_wp(spark, d):
    ends = table(spark, d, "nation").select(en.endpoint(F.concat(F.lit("site"), "n_nationkey", F.lit(".example"))).alias("e"))
    posts = _service(ends, "id long, title string", lambda k, c: (200, [(c * 2 + i, f"t{i}") for i in range(2)], c + 1 if c < 1 else None))
    return posts.select(F.col("key").alias("endpoint"), "id", "title")


@query("SELECT '\"' || n_name || ' state-controlled media\" site:facebook.com' AS query, i + 1 AS position FROM nation, range(0, 4) r(i)")
def src_api_serp(spark, d):
    asked = ln.preset_cross(table(spark, d, "nation").select(F.col("n_name").alias("country")), spark.createDataFrame([("facebook.com",)], "site string")).select("query")
    hits = _service(asked, "position long, link string", lambda k, c: (200, [(c * 2 + i + 1, "https://facebook.com/p") for i in range(2)], c + 1 if c < 1 else None))
    return hits.select(F.col("key").alias("query"), "position")


@query("SELECT 'c' || c_custkey AS base_wallet, count(*) AS legs FROM customer, range(0, 3) GROUP BY 1")
def src_api_transfers(spark, d):
    keys = table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("k"))
    raw = _service(keys, "body string", lambda k, c: (200, [('{"hash":"h%d","fromAddress":{"address":"%s"},"toAddress":{"address":"z"}}' % (c, k),)], c + 1 if c < 2 else None))
    legs = cr.flatten_legs(raw.select(F.from_json("body", cr.TRANSFER).alias("transfer"), F.lit("out").alias("direction"), F.col("key").alias("base_wallet")))
    return legs.groupBy("base_wallet").agg(F.count("*").alias("legs"))


@query("SELECT 'u' || c_custkey AS value, 'Q' || c_custkey AS qid FROM customer")
def src_api_sparql(spark, d):
    keys = table(spark, d, "customer").select(F.concat(F.lit("u"), "c_custkey").alias("k"))
    return _service(keys, "qid string", lambda k, c: (200, [("Q" + k[1:],)], None)).select(F.col("key").alias("value"), "qid")


@query("SELECT 'Q' || c_custkey AS qid, 'P1' AS property, 'v' || c_custkey AS value FROM customer")
def src_api_entity(spark, d):
    keys = table(spark, d, "customer").select(F.concat(F.lit("Q"), "c_custkey").alias("k"))
    raw = _service(keys, "claims string", lambda k, c: (200, [('{"P1":[{"snaktype":"value","value":"\\"v%s\\""}],"P8":[]}' % k[1:],)], None))
    return en.claims(raw.select(F.col("key").alias("qid"), F.from_json("claims", "map<string,array<struct<snaktype:string,value:string>>>").alias("claims")), ["P1"])


@query("SELECT p_partkey AS id, p_brand AS topic FROM part")
def src_api_topics(spark, d):
    # a service that answers with a topic for an id: here the brand that goes with it, by the key
    keys = table(spark, d, "part").select(F.concat_ws("|", "p_partkey", "p_brand").alias("k"))
    rows = _service(keys, "id long, topic string", lambda k, c: (200, [(int(k.partition("|")[0]), k.partition("|")[2])], None))
    return rows.select("id", "topic")


@query("SELECT 'https://h.example/' || c_custkey AS url, 200 AS http_status FROM customer")
def src_http_head_get(spark, d):
    urls = table(spark, d, "customer").select(F.concat(F.lit("https://h.example/"), "c_custkey").alias("url"))
    return ln.fetch_all(urls, lambda u: {"final_url": u, "http_status": 200, "chain": [u], "content_type": "", "html": "", "ms": 0.0, "error": None}).select("url", "http_status")


def _role(spark, name, value):
    return spark.createDataFrame([(name, value)], "role string, `column` string")


@query("SELECT 'generic' AS role, 'p_brand' AS column")
def col_generic(spark, d):
    return _role(spark, "generic", roles.generic_column(_part(spark, d), None, ["Brand"], "brand"))


@query("SELECT 'text' AS role, 'text' AS column")
def col_text(spark, d):
    return _role(spark, "text", roles.text_column(table(spark, d, "documents")))


@query("SELECT 'text_cluster' AS role, 'text' AS column")
def col_text_cluster(spark, d):
    return _role(spark, "text_cluster", roles.preferred_column(table(spark, d, "documents").columns, None, ("Text",)))


@query("SELECT 'address' AS role, 'c_custkey' AS column")
def col_address(spark, d):
    return _role(spark, "address", roles.preferred_column(table(spark, d, "customer").columns, None, ("address", "wallet")))


@query("SELECT 'identifier' AS role, 'url' AS column")
def col_identifier(spark, d):
    return _role(spark, "identifier", roles.preferred_column(table(spark, d, "pages").columns, None, ("url", "link", "handle", "username", "id")))


@query("SELECT 'terms' AS role, 'n_name' AS column")
def col_terms(spark, d):
    return _role(spark, "terms", roles.first_string(table(spark, d, "nation")))


@query("SELECT (SELECT count(*) FROM part) AS rows, count(DISTINCT p_brand) AS topics FROM part")
def nr_inspect(spark, d):
    from .misc_queries import metadata, topics

    t = topics(spark, d)
    return nr.depth_summary(t, metadata(spark, d)).where("depth = 2").select(F.lit(t.count()).cast("long").alias("rows"), "topics")


@query("""SELECT p_brand AS topic, p_partkey, p_name, CAST(label_order AS INTEGER) AS label_order FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS r FROM part)
    JOIN (SELECT p_brand, row_number() OVER (ORDER BY count(*) DESC, min(p_partkey)) AS label_order FROM part GROUP BY 1) USING (p_brand) WHERE r <= 3""")
def nr_export(spark, d):
    """Sampled posts with their rows, in the order of the label table."""
    from .misc_queries import metadata, topics

    t = topics(spark, d)
    rows = nr.sample(t, "p_partkey", 2, 3, None).join(table(spark, d, "part"), "p_partkey", "left")
    return nr.workbook_order(rows, nr.label_table(t, metadata(spark, d), 2), "topic", "p_partkey").select("topic", "p_partkey", "p_name", "label_order")
