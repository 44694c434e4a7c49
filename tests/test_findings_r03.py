"""Faults that the third round's findings named."""

import io
import math
import os
import pathlib
import random
import zipfile
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quillspark.functions import grams, text
from quillspark.operators import keyword, lexicon, links
from quillspark.plans import io_queries, text_queries
from quillspark.sources import sinks


def test_base64_stays_on_one_line(spark):
    url = "https://blog.example.net/" + "x" * 60
    import base64

    got = sinks.as_base64(spark.createDataFrame([(url.encode(),)], "content binary"), "content").first()["content"]
    assert got == base64.b64encode(url.encode()).decode() and "\r" not in got


def test_archive_with_repeated_addresses_and_many_pages(spark):
    p = spark.range(1200).select(F.col("id").alias("page_id"), F.concat(F.lit("https://a.example/"), F.col("id") % 3).alias("url"), F.concat(F.lit("<html>"), F.col("id")).alias("html"), F.lit(None).cast("string").alias("error"))
    held = io.BytesIO()
    sinks.write_archive(links.download_manifest(p, "page_id", ("html",)), None, held)
    with zipfile.ZipFile(held) as z:
        names = [n for n in z.namelist() if n != "manifest.csv"]
        assert len(names) == len(set(names)) == 1200 and z.read("1200_a-example-2.html") == b"<html>1199"
        assert z.read("manifest.csv").decode().count("\n") == 1201


def test_json_arrays_are_read_whole_from_many_splits(spark, tmp_path):
    (tmp_path / "part.parquet").mkdir()
    for k in range(6):
        n = range(k * 9000, k * 9000 + 9000)
        pq.write_table(pa.table({"p_partkey": pa.array(n, pa.int64()), "p_name": [f"n{i}" for i in n], "p_brand": ["b"] * 9000, "p_size": pa.array([1] * 9000, pa.int32()), "p_retailprice": [1.0] * 9000}), tmp_path / f"part.parquet/{k}.parquet")
    was = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = io_queries.src_json_array(spark, str(tmp_path))
        assert got.agg(F.count("*"), F.countDistinct("p_partkey")).first() == (54000, 54000)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", was)


def test_long_words_are_no_wallets(spark, tmp_path):
    words = ["r" + "abcde" * 5, "7" + "x" * 42, "a" * 20 + "thing", "L" + "y" * 30 + "."]
    pq.write_table(pa.table({"doc_id": pa.array(range(4), pa.int64()), "text": [f"some {w} string" for w in words]}), tmp_path / "documents.parquet")
    got = text_queries.tx_crypto(spark, str(tmp_path))
    assert [(r["doc_id"], r["currency"]) for r in got.orderBy("doc_id").collect()] == [(i, text_queries.CURRENCIES[i][0]) for i in range(4)]
    assert {r["matches"] for r in text_queries.tx_tabular_rows(spark, str(tmp_path)).collect()} == {"string"}


@pytest.mark.parametrize("room", [1 << 62, 300])
def test_kernels_of_ngrams_against_plain_python(monkeypatch, room):
    monkeypatch.setattr(grams, "ROOM", room)  # with little room keys are numbered anew
    monkeypatch.setattr(grams, "TOKENS", 40)
    pick = random.Random(1)
    docs = [[pick.choice("abcdefg") for _ in range(pick.randint(0, 12))] for _ in range(50)]
    more = [pick.sample(["a", "a b", "x y", "q", "c d e", "zz"], pick.randint(0, 3)) for _ in docs]
    group = [pick.choice(["u", "v", None]) for _ in docs]
    held = [{" ".join(d[i : i + n]) for n in (1, 2, 3) for i in range(len(d) - n + 1)} | set(m) for d, m in zip(docs, more, strict=True)]
    lists = pa.list_(pa.string())
    batch = pa.RecordBatch.from_arrays([pa.array(docs, lists), pa.array(more, lists), pa.array([False] * 50), pa.array(range(50)), pa.array(group)], names=["words", "more", "also", "doc_id", "group"])
    sums = lambda rows, key, n: {k: v for k, v in Counter(x for r in rows for x in [key(r)] * r[n]).items() if v}
    by_part = lambda rows: [b.take(pa.array([i])) for b in rows for i in range(b.num_rows)]
    whole = lambda rows, keys, n: pa.Table.from_batches(list(grams.summed(sorted(by_part(rows), key=lambda b: b["part"][0].as_py()), keys, n))).to_pylist()
    rows = whole(grams.document_counts([batch], (1, 2, 3), ["a b", "zz"]), ["term"], ["n", "exact", "wide"])
    assert len(rows) == len({r["term"] for r in rows})
    seeded = [bool(h & {"a b", "zz"}) for h in held]
    assert sums(rows, lambda r: r["term"], "n") == Counter(t for h in held for t in h) + Counter({None: 50})
    assert sums(rows, lambda r: r["term"], "exact") == Counter(t for h, s in zip(held, seeded, strict=True) if s for t in h) + Counter({None: sum(seeded)})
    want = Counter()
    for d, g in zip(docs, group, strict=True):
        d = [x for x in d if x != "c"]
        own = ["_".join(d[i : i + n]) for n in (1, 2, 3) for i in range(len(d) - n + 1)]
        want.update([(g, t) for t in own] + [(g, None)] * len(own))
    assert sums(whole(grams.group_counts([batch], (1, 2, 3), "_", ["c"]), ["group", "term"], ["n"]), lambda r: (r["group"], r["term"]), "n") == want
    pairs = Counter()
    for h in held:
        first = [t for t in ("c d e", "a", "zz", "b c", "b") if t in h][:2]
        pairs.update([tuple(sorted(first))] if len(first) > 1 else [])
    assert sums(pa.Table.from_batches(list(grams.shared_rows([batch], (1, 2, 3), ["c d e", "a", "zz", "b c", "b"], 2))).to_pylist(), lambda r: (r["a"], r["b"]), "weight") == pairs


def test_keyword_operators_write_neither_texts_nor_postings(spark):
    texts = [f"apples pears word{i % 7} " + " ".join(f"filler{i}x{k}" for k in range(60)) for i in range(300)]
    c = keyword.corpus(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text")
    at = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(at))
    assert keyword.cooccurrence(keyword.stored(c, ["apples"]), ["apples"], 5).count() == 5
    size = sum(p.stat().st_size for d in set(os.listdir(at)) - before for p in pathlib.Path(at, d).rglob("*.parquet"))
    assert size < sum(map(len, texts)) / 4


def test_evidence_looks_on_where_the_first_documents_have_none(spark):
    texts = ["red, apple"] * 200 + ["a red apple"] * 7
    c = keyword.corpus(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text")
    terms = spark.createDataFrame([("red apple",), ("apple",), ("none",)], "term string")
    got = {r["term"]: r["evidence"] for r in keyword.evidence(c, terms).collect()}
    assert got == {"red apple": ["a red apple"] * 5, "apple": ["red, apple"] * 5}
    assert keyword.evidence(c, terms, sample=20).where("term = 'red apple'").count() == 0


def test_key_phrases_of_settled_and_open_texts(spark, monkeypatch):
    monkeypatch.setattr(lexicon, "FIRST_PHRASES", 6)
    pick = random.Random(3)
    docs = [[pick.choice("abcdefghijklmnop") for _ in range(pick.randint(0, 25))] for _ in range(60)] + [list("aabbccddeeff")] * 3
    df = spark.createDataFrame([(i if i else None, d) for i, d in enumerate(docs)], "k long, tokens array<string>")
    tf = [Counter(" ".join(d[i : i + n]) for n in (1, 2, 3) for i in range(len(d) - n + 1)) for d in docs]
    seen = Counter(t for c in tf for t in c)
    score = lambda t, c: c[t] * (math.log((1 + len(docs)) / (1 + seen[t])) + 1)
    want = {(i or None, t) for i, c in enumerate(tf) for t in sorted(c, key=lambda t: (-round(score(t, c), 9), t))[:5]}
    got = lexicon.key_phrases(df, "k")
    assert {(r["k"], r["phrase"]) for r in got.collect()} == want and len(want) == got.count()
    plan = lambda d: d._jdf.queryExecution().toString()
    assert "phrases-few" in plan(got) and "phrases-shared" in plan(got)  # texts' n-grams aren't all dealt out by key
    twice = spark.createDataFrame([(1, ["x", "y"]), (1, ["x"])], "k long, tokens array<string>")
    assert {(r["k"], r["phrase"]) for r in lexicon.key_phrases(twice, "k").collect()} == {(1, "x"), (1, "y"), (1, "x y")}


def test_first_terms_of_groups_are_cut_in_each_task(spark):
    pick = random.Random(5)
    rows = [(g, f"t{i}", pick.randint(1, 40), 0.5) for g in ("a", "b", None) for i in range(400)]
    schema = "group string, term string, count_raw long, normalized_per_thousand double"
    names = [c.split()[0] for c in schema.split(", ")]
    batches = pa.Table.from_arrays([pa.array(x) for x in zip(*pick.sample(rows, len(rows)), strict=True)], names=names).to_batches(max_chunksize=50)
    first = lambda rows: {(g, t) for k in ("a", "b", None) for g, t, *_ in sorted((r for r in rows if r[0] == k), key=lambda r: (-r[2], r[1]))[:7]}
    got = pa.Table.from_batches(list(grams.first_of_groups(iter(batches), 7, 60)))
    assert {(r["group"], r["term"]) for r in got.to_pylist()} == first(rows) and got.num_rows == 21
    top = lexicon.top_terms(spark.createDataFrame(rows, schema).repartition(4), 7)
    assert {(r["group"], r["term"]) for r in top.collect()} == first(rows) and "MapInArrow" in top._jdf.queryExecution().toString()


def test_clean_text_looks_characters_up(spark):
    texts = ["a  #b\téè https://x.y/z @me! (c-d); e:f?\n.,\\g [h] \U0001f600z_", "", None, " - "]
    c, old = F.col("t"), F.coalesce(F.col("t"), F.lit(""))
    old = F.replace(F.regexp_replace(F.regexp_replace(old, r"https?://\S+", ""), r"(?U)@\w+", ""), F.lit("#"), F.lit(""))
    old = F.trim(F.regexp_replace(F.regexp_replace(old, r"[^a-zA-Z0-9\s.!?,;:\-()]", " "), r"\s+", " "))
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select(text.clean_text(c).alias("a"), old.alias("b")).collect():
        assert r["a"] == r["b"]
    assert "a-z" not in text.clean_text(c)._jc.toString()
