"""Operators on small tables: edge cases that the comparison with SQL over the test tables doesn't reach."""

import datetime as dt
import inspect
import math
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.functions import boolean_query, graph
from quillspark.functions import text as tx
from quillspark.operators import clustering, coordination, image_match, keyword, links, status, temporal
from quillspark.plans import keyword_queries
from quillspark.plans.bundles import lexicon, temporal as temporal_bundle
from quillspark.sources import api, sinks, tables, xlsx
from quillspark.streaming import events as streaming

T0 = dt.datetime(2024, 3, 1)


def frame(spark, rows):
    return spark.createDataFrame([(i, T0 + dt.timedelta(seconds=s) if s is not None else None, e) for i, (s, e) in enumerate(rows)], "row_index long, ts timestamp_ntz, entity string")


def ev(spark, rows):
    f = frame(spark, rows)
    return temporal.prepare(f, F.col("ts"), F.col("row_index"), F.col("entity"))


def test_intervals_cross_minutes(spark):
    rows = [(s, "a") for s in (0, 10, 59.5, 60, 300, 300, 4000)] + [(None, "a")]
    got = sorted(r[0] for r in temporal.intervals(ev(spark, rows)).collect())
    assert got == sorted([10, 49.5, 0.5, 240, 0, 3700])
    one = temporal.interval_stats(temporal.intervals(ev(spark, rows[:2]))).first()
    assert (one["n_intervals"], one["std"], one["cv"]) == (1, 0.0, None)
    none = temporal.interval_stats(temporal.intervals(ev(spark, []))).first()
    assert none["n_intervals"] == 0 and none["mean"] is None


def test_empty_events(spark):
    e = ev(spark, [])
    assert temporal.autocorrelation(e).count() == 0
    assert temporal.minute_gini(e).first()[0] == 0.0 and temporal.minute_entropy(e).first()[0] == 0.0
    for f in (coordination.near_simultaneous_windows, coordination.entity_synchrony, coordination.pairwise_co_posts, coordination.entity_jitter, coordination.entity_hour_profile, coordination.burst_correlation, coordination.dormancy_bursts):
        assert f(e).count() == 0


def test_bounds_of_entropy_and_gini(spark):
    e = ev(spark, [(60 * k * k, "a") for k in range(40)])
    assert 0 <= temporal.minute_entropy(e).first()["minute_entropy_normalized"] <= 1
    assert 0 <= temporal.minute_gini(e).first()[0] < 1


def test_window_shows_twenty_names(spark):
    r = coordination.near_simultaneous_windows(ev(spark, [(k / 10, f"e{k:02}") for k in range(25)] + [(100, None), (101, None)])).collect()
    assert len(r) == 1 and r[0]["unique_entities"] == 25 and r[0]["entities"].startswith("e00, e01") and r[0]["entities"].endswith("e19 …")


def test_modal_interval_takes_the_first_of_ties(spark):
    r = coordination.entity_jitter(ev(spark, [(s, "a") for s in (0, 5, 12, 17, 24)])).first()
    assert (r["modal_interval_s"], r["modal_interval_share"], r["repetition_flag"]) == (5, 0.5, False)


def test_constant_counts_have_no_correlation(spark):
    assert temporal.autocorrelation(ev(spark, [(60 * k, "a") for k in range(10)])).count() == 0


def test_parsing(spark):
    df = spark.createDataFrame([("1700000000",), ("1700000060",), ("x",)], "t string")
    assert temporal.parse_unix(df, "t") is not None
    got = [r[0] for r in df.select(temporal.to_zone(temporal.parse_datetimes(df, "t"), "UTC")).collect()]
    assert got == [dt.datetime(2023, 11, 14, 22, 13, 20), dt.datetime(2023, 11, 14, 22, 14, 20), None]
    assert temporal.parse_datetimes(spark.createDataFrame([("a",), ("b",)], "t string"), "t") is None
    d = spark.createDataFrame([("02/03/2024",)], "t string")
    assert d.select(temporal.parse_datetimes(d, "t", day_first=True)).first()[0].month == 3
    assert temporal.epoch_divisor(1.7e12) == 1000 and temporal.epoch_divisor(None) is None


@pytest.mark.parametrize(
    ("expression", "want"),
    [("", [0, 1, 2, 3, 4]), ("cat, dog", [0, 1, 2]), ("cat OR dog", [0, 1, 2]), ("cat AND dog", [2]), ("cat AND NOT dog", [0]), ('"big dog"', [2]), ("ca*", [0, 2, 3]), ("(cat OR bird) AND NOT (big OR cart)", [0]), ("NOT cat", [1, 3, 4]), ("not not cat", [0, 2]), ("cat dog", []), ("cat OR (dog", [0]), ('"Cat"', [0, 2])],
)
def test_boolean_filter(spark, expression, want):
    texts = ["a cat here", "dog", "Cat and big dog", "cart of bird", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    if expression == "cat OR (dog":
        want = []  # it doesn't parse, and as one keyword it occurs nowhere
    assert [r["i"] for r in df.where(boolean_query.boolean_filter(F.col("t"), expression)).orderBy("i").collect()] == want


def test_association_measures(spark):
    rows = [(10, 10, 10, 100), (25, 50, 50, 100), (0, 10, 10, 100), (5, 10, 10, 0), (50, 60, 55, 100)]
    df = spark.createDataFrame(rows, "xy int, x int, y int, n int")
    args = [F.col(c) for c in ("xy", "x", "y", "n")]
    got = df.where("n > 0").select(keyword.pmi(*args).alias("p"), keyword.llr(*args).alias("l")).collect()
    assert abs(got[0]["p"] - math.log2(10)) < 1e-9 and abs(got[1]["p"]) < 1e-9 and got[2]["p"] == 0
    assert abs(got[1]["l"]) < 1e-6 and got[0]["l"] > 0 and got[3]["l"] > 0
    assert [r[0] for r in keyword.minmax(spark.createDataFrame([(3.0,), (3.0,)], "v double"), "v", "o").select("o").collect()] == [0.5, 0.5]


def test_merge_rules(spark):
    rows = [("Deep State", 0.9, "cooccurrence", 30), ("deep", 0.95, "network", 30), ("deep state", 0.7, "semantic", 30), ("seeds", 0.9, "network", 30), ("the of", 0.9, "network", 30), ("rare", 0.9, "network", 2), ("common", 0.9, "network", 60), ("x", 0.9, "network", 30), ("gone", 0.9, "network", 30)]
    c = spark.createDataFrame([(t, s, m, [m], f"{m} {s}", [m], 3 if m == "semantic" else None, n) for t, s, m, n in rows], keyword.CANDIDATE)
    got = keyword.merge(c, ["seed"], ["gone"], [], 5, 100, 0.4).collect()
    assert [(r["term"], r["score"], r["source"], r["sources"], r["context"], r["evidence"], r["community_id"]) for r in got] == [("deep state", 0.9, "cooccurrence|semantic", ["cooccurrence", "semantic"], "cooccurrence 0.9", ["cooccurrence", "semantic"], 3)]


def test_discovery_runs_end_to_end(spark):
    texts = ["red apples and green pears grow in the garden", "green pears taste sweet in autumn", "the garden holds red apples", "sweet apples and zorbling pears", "zorbling zorblers zorblike in the garden"] * 8
    c = keyword.corpus(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text", min_df=4)
    known = keyword.lexicon(spark.createDataFrame([(w,) for t in texts for w in t.split() if not w.startswith("zorb")], "word string"))
    got = {r["term"]: r for r in keyword.discover(c, ["apples"], known, 20, 4, max_df_ratio=1.0).collect()}
    assert got and not {"apples", "apple"} & set(got)
    assert any("corpus_specific" in r["sources"] for r in got.values()) and all(len(r["evidence"]) <= 5 for r in got.values())
    empty = keyword.corpus(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text")
    assert keyword.cooccurrence(empty, ["a"]).count() == 0


def test_semantic_is_registered_whole(monkeypatch):
    got = []
    monkeypatch.setattr(keyword_queries, "corpus", lambda spark, d: None)
    monkeypatch.setattr(keyword, "stored", lambda c: c)
    monkeypatch.setattr(keyword, "_top", lambda df, n: None)
    monkeypatch.setattr(keyword, "_candidates", lambda *args, **how: None)
    monkeypatch.setattr(F, "format_string", lambda *args: None)
    real = inspect.signature(keyword.semantic_scores)

    def spied(*args, **how):
        bound = real.bind(*args, **how)
        bound.apply_defaults()
        got.append((bound.arguments["max_vocab"], bound.arguments["dims"]))

    monkeypatch.setattr(keyword, "semantic_scores", spied)
    keyword_queries.kd_semantic(None, None)
    assert got == [(10_000, 100)]


def test_graph_is_registered_whole(monkeypatch):
    got = []
    real = inspect.signature(keyword.cooccurrence_graph)

    def spied(*args, **how):
        bound = real.bind(*args, **how)
        bound.apply_defaults()
        got.append(bound.arguments["max_nodes"])
        raise LookupError

    monkeypatch.setattr(keyword_queries, "corpus", lambda spark, d: None)
    monkeypatch.setattr(keyword, "stored", lambda c: c)
    monkeypatch.setattr(keyword, "cooccurrence_graph", spied)
    for name in ("kd_pagerank", "kd_betweenness", "kd_communities", "kd_network"):
        with pytest.raises(LookupError):
            getattr(keyword_queries, name)(None, None)
    assert got == [1000] * 4


def test_evidence_is_looked_for_in_all_documents(spark):
    texts = [f"a case of, anon {i}" for i in range(50)] + [f"Of anon {i}" for i in range(8)]
    c = keyword.corpus(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text")
    got = keyword.evidence(c, spark.createDataFrame([("of anon",)], "term string")).collect()
    assert [r["evidence"] for r in got] == [[f"Of anon {i}" for i in range(5)]]


def test_chain():
    chain = keyword.Chain.start(["One", "one", " two "])
    chain.rounds.append({"number": 1, "seeds": ["one"], "added": [], "excluded": [], "dismissed": [], "candidates": []})
    chain.select(added=["one", "three words here"], dismissed=["no"])
    assert chain.seeds == ["one", "two", "three words here"] and chain.boolean_query() == 'one OR two OR "three words here"'
    again = keyword.Chain.from_json(chain.to_json())
    assert again == chain
    again.undo()
    assert again.seeds == ["one", "two"] and again.dismissed == [] and again.rounds == []


def test_graph_kernels():
    names = list("abcdefgh")
    edges = [(x, y, 1.0) for g in ("abcd", "efgh") for i, x in enumerate(g) for y in g[i + 1 :]] + [("d", "e", 1.0)]
    adj = graph.adjacency(names, edges)
    kind = graph.communities(adj)
    assert kind.tolist() == [0, 0, 0, 0, 1, 1, 1, 1]
    rank = graph.pagerank(adj, np.eye(8)[0])
    assert abs(rank.sum() - 1) < 1e-6 and rank[0] == rank.max()
    between = graph.betweenness(adj)
    assert between.argmax() in (3, 4) and abs(between[3] - 12 / 21 * 1) < 0.01
    assert graph.betweenness([{}, {}]).tolist() == [0, 0] and graph.communities([]).tolist() == []


@pytest.mark.parametrize("t", [0.3, 0.6, 0.9])
def test_leaders_equal_the_sequential_loop(spark, t):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(80, 4))
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "row_index long, embedding array<double>")
    got = {r["row_index"]: r["leader"] for r in clustering.near_duplicates(df, t).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {}
    for i in range(80):
        if i not in want:
            want |= {j: i for j in range(i, 80) if j not in want and (j == i or u[i] @ u[j] >= t)}
    assert got == want


def test_bands_find_all_close_hashes(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(-(2**63), 2**63, (20, 4))
    rows = [(i, f"n{i}", [int(x) for x in h]) for i, h in enumerate(base)]
    for i in range(20):
        h = [int(x) for x in base[i]]
        for b in rng.choice(256, 15, replace=False):
            h[b // 64] ^= 1 << int(b % 64) if b % 64 < 63 else -(2**63)
        rows.append((100 + i, f"m{i}", h))
    df = spark.createDataFrame(rows, "idx long, name string, hash array<long>")
    got = {(r["image_a"], r["image_b"]): r["distance"] for r in image_match.lsh_join(df, 15).collect()}
    assert all(got.get((f"n{i}", f"m{i}")) == 15 for i in range(20))
    grey = rng.integers(0, 80, (90, 70)).astype(np.uint8)  # a picture is of bytes, so a brighter one rounds a little apart
    assert sum(int(x).bit_count() for x in (image_match.phash(grey) ^ image_match.phash(grey * 3 + 5)).view(np.uint64)) <= 15


def test_links(spark):
    df = spark.createDataFrame([("https://a.example/x/y?q#f",), ("site.example",)], "u string")
    r = df.select(links.join_url(F.col("u"), F.lit("../z")).alias("j"), links.candidate_urls(F.col("u")).alias("c")).collect()
    assert r[0]["j"] == "https://a.example/z" and r[1]["c"] == ["https://site.example/", "http://site.example/"]
    got = links.fetch_all(df.select(F.col("u").alias("url")), lambda u: {"final_url": u, "http_status": 200} if "a.ex" in u else 1 / 0).collect()
    assert {x["url"][:6]: x["error"] for x in got} == {"https:": None, "site.e": "division by zero"}


def test_status(spark):
    df = spark.createDataFrame([("https://x.com/i/web/status/12",), ("@Name_1",), ("home",), ("1" * 30,), (None,)], "r string")
    got = [(r[0], r[1]) for r in df.select(status.parse_post(F.col("r")), status.parse_account(F.col("r"))).collect()]
    assert got[0][0] == "12" and got[1] == (None, "Name_1") and got[2] == (None, None) and got[3] == (None, None) and got[4] == (None, None)
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(["live"] + ["rate_limited"] * 5 + ["live", "gone"])], "i int, status string")
    assert [r["status"] for r in status.abort_after(rows, "i").orderBy("i").collect()] == ["live"] + ["rate_limited"] * 5 + ["skipped"] * 2


def test_text_columns(spark):
    df = spark.createDataFrame([("See https://t.co/a. @me #Tag, naïve!",), (None,), ("a",)], "t string")
    c = F.col("t")
    r = df.select(tx.clean_text(c).alias("c"), tx.ngrams(tx.tokens(c), 2).alias("n"), tx.tokenize_urls(c).alias("u"), tx.tokenize_hashtags(c).alias("h"), tx.strip_accents(c).alias("s"), tx.text_filter(c, "NAIVE|zzz").alias("f"), tx.text_filter(c, "[", regex=True).alias("b")).collect()
    assert r[0]["c"] == "See Tag, na ve!" and r[0]["u"] == ["https://t.co/a"] and r[0]["h"] == ["#tag"] and "naive" in r[0]["s"] and r[0]["f"] and not r[0]["b"]
    assert r[1]["c"] == "" and r[1]["n"] == [] and r[1]["u"] == [] and not r[1]["f"] and r[2]["n"] == []


def test_bundles(spark):
    e = spark.createDataFrame([(i, f"2024-01-01 00:{i % 60:02}:{i % 7:02}", f"u{i % 5}", "see #one https://a.b/c") for i in range(200)], "id long, when string, who string, said string")
    out = temporal_bundle(e, "when", "id", "who", text="said")
    assert out["indicators"].count() == 1 and out["hashtag_storms"].count() > 0 and len(out) == 24
    lex = lexicon(e, "said", "who", query="one")
    assert lex["frequency"].count() > 0 and lex["enriched"].count() == 200


def test_workbooks_and_sinks(spark, tmp_path):
    a = spark.createDataFrame([(1, "x<&>", None), (2, "é\x01", 2.5)], "n long, s string, d double")
    xlsx.write_workbook({"A/B": a, "a_b": a.limit(1)}, str(tmp_path / "w.xlsx"))
    spark.dataSource.register(xlsx.XlsxSource)
    got = spark.read.format("xlsx").option("path", str(tmp_path / "w.xlsx")).load()
    assert got.columns == ["n", "s", "d"] and [tuple(r) for r in got.collect()] == [("1", "x<&>", ""), ("2", "é", "2.5")]
    assert xlsx.sheet_names(["A/B", "a_b", "x" * 40]) == ["A_B", "a_b_2", "x" * 31]
    g = sinks.graphml(spark.createDataFrame([("a",), ("b",)], "term string"), spark.createDataFrame([("a", "b", 2)], "a string, b string, weight long"))
    assert g.count("<node") == 2 and ">2<" in g
    m = spark.createDataFrame([("https://a.b", "ok", "001_a.html", 3)], "url string, status string, filename string, bytes long")
    sinks.write_archive(m, spark.createDataFrame([("https://a.b", "abc")], "url string, html string"), str(tmp_path / "z.zip"))
    assert zipfile.ZipFile(tmp_path / "z.zip").namelist() == ["001_a.html", "manifest.csv"]
    assert "dimension" not in sinks.sections_text(spark.createDataFrame([("d", "v,1", 2)], "dimension string, value string, n long")).splitlines()[1]


def test_encodings_and_broken_files(spark, tmp_path):
    (tmp_path / "l.csv").write_bytes("a,b\nné,1\n".encode("latin-1"))
    assert tables.csv_encoded(spark, str(tmp_path / "l.csv")).first()["a"] == "né"
    (tmp_path / "s.csv").write_text("﻿ x ;y\n1 ; 2\n", encoding="utf-8")
    assert tables.csv_sniffed(spark, str(tmp_path / "s.csv")).collect()[0].asDict() == {"x": "1", "y": "2"}
    (tmp_path / "t").mkdir()
    (tmp_path / "t/good.json").write_text('{"name":"n","id":1,"messages":[{"text":["a",{"type":"hashtag","text":"#b"}]}]}')
    (tmp_path / "t/bad.json").write_text("{broken")
    assert [r["filename"] for r in tables.telegram(spark, str(tmp_path / "t")).collect()] == ["good.json"]


def test_paging():
    calls = []

    def transport(key, cursor):
        calls.append(cursor)
        return (429, [], None) if len(calls) < 3 else (200, [(1,)], cursor or 1)

    got = list(api.pages("k", transport, api.Paging(backoff=0)))
    assert got == [([(1,)], None), ([(1,)], None)] and len(calls) == 4
    assert list(api.pages("k", lambda k, c: (500, [], None), api.Paging(max_retries=1, backoff=0))) == [([], "HTTP 500")]


def test_streams(spark, tmp_path):
    frame(spark, [(k / 2, f"e{k % 3}") for k in range(40)] + [(1000, "z")]).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("row_index long, ts timestamp_ntz, entity string").parquet(str(tmp_path / "in")).withColumn("ts", F.col("ts").cast("timestamp"))
    q = streaming.shared_windows(s).writeStream.format("memory").queryName("shared").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["event_count"], r["unique_entities"]) for r in spark.table("shared").collect()) == [(20, 3), (20, 3)]
