"""Keyword discovery: which terms go with given seeds, by co-occurrence, context, graph centrality and rarity.

A corpus is three tables: ``docs(doc_id, raw, clean)``, ``postings(term, doc_id)`` (distinct) and ``vocab(term, doc_count)``.
Candidates are ``term, score, source, sources, context, evidence, community_id, doc_count``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import grams, graph
from ..functions import text as tx
from ..sources.files import shared_folder
from .lexicon import PROPER, STOP_WORDS

#: Runs of emoji and symbols (fixed ranges).
EMOJI = r"[\x{1F300}-\x{1F9FF}\x{2600}-\x{27BF}\x{200D}\x{FE0F}\x{2B50}\x{2B06}\x{2194}-\x{21AA}\x{23CF}\x{23E9}-\x{23F3}\x{25AA}-\x{25FE}\x{1FA00}-\x{1FAFF}]+"
#: Prefixes that are no families, forms without an apostrophe, and short forms that count as known words.
STOP_PREFIXES = "the pre pro con dis mis non over out under sub super inter trans anti auto semi multi post com for per man pol can".split()
CONTRACTIONS = "ve ll re doesn hasn isn wasn aren didn won wouldn shouldn couldn hadn don".split()
ABBREVIATIONS = "http https www url html jpg png gif pdf csv json api id ok lol omg wtf idk imo imho fyi btw tbh smh ngl dm pm rt irl fwiw tldr afaik etc covid covid19 ai ml nft crypto usa".split()
#: Endings of inflected forms, added to any word; or put in place of a last e or y.
ENDINGS, E_ENDINGS, Y_ENDINGS = "s es ed ing er ers ly ness ment tion ation".split(), ("ing", "ed", "er"), ("ies", "ied")
CANDIDATE = "term string, score double, source string, sources array<string>, context string, evidence array<string>, community_id int, doc_count long"
MODULES = ("cooccurrence", "semantic", "network", "corpus_specific")
MAX_DF_RATIO = 0.04
WORDS = r"(?U)\b\w+\b"


def clean(c: Column) -> Column:
    return F.trim(F.lower(F.regexp_replace(F.regexp_replace(c, r"(?i)https?://\S+", ""), r"(?U)@\w+", "")))


def terms_of(c: Column, low: int = 1, high: int = 2) -> Column:
    """N-grams of words, joined by spaces, and runs of emoji."""
    words = tx.words_of(c, WORDS)
    return F.concat(*(tx.ngrams(words, n, " ") if n > 1 else words for n in range(low, high + 1)), tx.words_of(c, EMOJI))


def proper_nouns(raw: Column) -> Column:
    return F.transform(tx.words_of(raw, r"(?U)(?=[A-Z])" + PROPER), lambda x: F.lower(x))


@dataclass
class Corpus:
    docs: DataFrame
    postings: DataFrame
    vocab: DataFrame
    n_docs: int
    sizes: tuple[int, ...] = (1, 2)
    min_df: int = 5
    counts: dict = field(default_factory=dict)


#: Whether a text has any of EMOJI's characters (some others too): cheaper than looking for runs of them.
MAYBE_EMOJI = r"[\x{200D}\x{2190}-\x{10FFFF}]"


def _tokenised(docs: DataFrame, also: Column | None = None) -> DataFrame:
    """``doc_id, words, more, also``: a text's words, its runs of emoji and proper nouns, and a condition, for the kernels of ``grams``."""
    emoji = F.when(F.col("clean").rlike(MAYBE_EMOJI), tx.words_of(F.col("clean"), EMOJI)).otherwise(F.array().cast("array<string>"))
    return docs.select("doc_id", tx.words_of(F.col("clean"), WORDS).alias("words"), F.concat(emoji, proper_nouns(F.col("raw"))).alias("more"), (F.lit(False) if also is None else F.coalesce(also, F.lit(False))).alias("also"))


def _document_counts(docs: DataFrame, sizes: tuple[int, ...], seeds: list[str], least: int, also: Column | None = None) -> DataFrame:
    """``term, doc_count, exact, wide`` of terms that ``least`` documents hold: each task counts its documents' terms as numbers, so only counts travel.

    The null term has all documents.
    """
    run = partial(grams.document_counts, sizes=sizes, seeds=seeds)
    return grams.sums(_tokenised(docs, also).mapInArrow(run, "part int, data binary"), ["term"], ["n", "exact", "wide"], least).withColumnRenamed("n", "doc_count")


def corpus(df: DataFrame, doc_id: str, text: str, ngrams: tuple[int, int] = (1, 2), min_df: int = 5, keep_null: bool = False) -> Corpus:
    raw = F.coalesce(F.col(text).cast("string"), F.lit("nan")) if keep_null else F.col(text).cast("string")
    docs = df.select(F.col(doc_id).alias("doc_id"), raw.alias("raw")).where(F.col("raw").isNotNull()).withColumn("clean", clean(F.col("raw")))
    terms = F.array_distinct(F.concat(terms_of(F.col("clean"), *ngrams), proper_nouns(F.col("raw"))))
    postings = docs.select("doc_id", F.explode(terms).alias("term"))  # distinct, as each document is one row
    sizes = tuple(range(ngrams[0], ngrams[1] + 1))
    vocab = _document_counts(docs, sizes, [], min_df).where(F.col("term").isNotNull()).select("term", "doc_count")
    return Corpus(docs, postings, vocab, docs.count(), sizes, min_df)


def _any_seed(seeds: list[str]) -> Column:
    """Whether a text has a seed as a whole word."""
    some = F.lit(False)
    for s in seeds:
        some = some | F.col("clean").rlike(r"(?U)\b" + re.escape(s) + r"\b")
    return some


def counts(c: Corpus, seeds: list[str]) -> DataFrame:
    """``term, doc_count, exact, wide`` of the vocabulary: documents, those that hold a seed by the index, and those that hold one at all.

    One pass over the texts, whose result is written to the shared folder. The null term has the numbers of all documents.
    """
    seeds = sorted({s.lower() for s in seeds})
    if (key := tuple(seeds)) not in c.counts:
        c.counts[key] = kept(_document_counts(c.docs, c.sizes, seeds, c.min_df, _any_seed(seeds)), "vocab")
    return c.counts[key]


def kept(df: DataFrame, label: str) -> DataFrame:
    """A table written to the shared folder and read again."""
    spark = df.sparkSession
    path = shared_folder(spark, f"keyword-{label}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored(c: Corpus, seeds: list[str] = ()) -> Corpus:
    """The corpus with its vocabulary written, counted with the seeds that will be asked for, so that no operator counts it again. Texts and postings aren't written."""
    return replace(c, vocab=counts(c, list(seeds)).where(F.col("term").isNotNull()).select("term", "doc_count"))


def _holders(c: Corpus, terms: list[str], most: int | None = None, within: list[str] | None = None) -> DataFrame:
    """``term, doc_id`` of documents that hold one of a few terms (and one of ``within``); with ``most``, at least the first so many of each term."""
    run = partial(grams.first_holders, sizes=c.sizes, terms=terms, most=most, within=within)
    return _tokenised(c.docs).mapInArrow(run, f"term string, doc_id {c.docs.schema['doc_id'].dataType.simpleString()}")


def seed_docs(c: Corpus, seeds: list[str], exact: bool = False) -> DataFrame:
    """``doc_id`` of documents with a seed: by the index, or for seeds that it lacks by whole words in the text."""
    seeds = sorted({s.lower() for s in seeds})
    hits = _holders(c, seeds).select("doc_id")
    return hits.distinct() if exact else c.docs.where(_any_seed(seeds)).select("doc_id").unionByName(hits).distinct()


def pmi(n_xy: Column, n_x: Column, n_y: Column, n: Column) -> Column:
    some = (n_xy > 0) & (n_x > 0) & (n_y > 0) & (n > 0)
    ratio = (n_xy.cast("double") / n) / ((n_x.cast("double") / n) * (n_y.cast("double") / n))
    return F.when(some, F.log2(ratio)).otherwise(F.lit(0.0))


def llr(n_xy: Column, n_x: Column, n_y: Column, n: Column) -> Column:
    """Twice the log-likelihood gain of two rates over one. As in the tool this stands in for, a side without hits counts nothing."""
    a, c, row1, row2 = n_xy, n_y - n_xy, n_x, n - n_x

    def side(k: Column, m: Column, p: Column) -> Column:
        p = F.greatest(F.lit(1e-10), F.least(F.lit(1 - 1e-10), p))
        return F.when((k == 0) | (m == 0), F.lit(0.0)).otherwise(k * F.log(p) + (m - k) * F.log(1 - p))

    rate = lambda k, m: F.when(m != 0, k.cast("double") / F.nullif(m, F.lit(0))).otherwise(F.lit(0.5))
    both = rate(n_y, n)
    gain = side(a, row1, rate(a, row1)) + side(c, row2, rate(c, row2)) - side(a, row1, both) - side(c, row2, both)
    return F.when(n == 0, F.lit(0.0)).otherwise(2.0 * gain)


def minmax(df: DataFrame, column: str, out: str) -> DataFrame:
    """Values brought to 0 to 1; 0.5 if all are equal. The extremes come from one aggregate row."""
    ends = df.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    scaled = F.when(F.col("_hi") == F.col("_lo"), F.lit(0.5)).otherwise((F.col(column) - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)))
    return df.crossJoin(F.broadcast(ends)).withColumn(out, scaled).drop("_lo", "_hi")


def cooccurrence_scores(c: Corpus, seeds: list[str], min_df: int = 5, weights: tuple[float, float] = (0.4, 0.6)) -> DataFrame:
    """``term, n_co, doc_count, pmi, llr, score`` of all terms that share documents with seeds."""
    seeds = [s.lower() for s in seeds]
    held = counts(c, seeds)
    n_seed = held.where(F.col("term").isNull()).select(F.col("exact").alias("n_seed"))
    t = held.where((F.col("exact") > 0) & (F.col("doc_count") >= min_df) & ~F.col("term").isin(seeds)).select("term", F.col("exact").alias("n_co"), "doc_count").crossJoin(F.broadcast(n_seed))
    args = F.col("n_co"), F.col("n_seed"), F.col("doc_count"), F.lit(c.n_docs)
    t = t.withColumn("pmi", pmi(*args)).withColumn("llr", llr(*args))
    t = minmax(minmax(t, "pmi", "_p"), "llr", "_l")
    return t.select("term", "n_co", "doc_count", "pmi", "llr", (weights[0] * F.col("_p") + weights[1] * F.col("_l")).alias("score"))


#: Documents of each term that are looked at first for evidence.
FIRST_LOOK = 64


def evidence(c: Corpus, terms: DataFrame, within: list[str] | None = None, most: int = 5, sample: int | None = None, whole_word: bool = True) -> DataFrame:
    """``term, evidence``: beginnings (300 characters) of the first documents that hold each term (and one of the seeds ``within``).

    Only a term's first ``sample`` documents are looked at if that is given. Otherwise a few are looked at first, and more for
    terms that these gave too little, until all have enough or no more. The terms are few; texts are never shuffled or sorted.
    """
    spark = c.docs.sparkSession
    found = F.contains(F.lower("raw"), F.lower("term"))
    if whole_word:
        found = found & F.expr(r"regexp_like(raw, concat('(?iU)(?<!\\w)\\Q', term, '\\E(?!\\w)'))")
    snippet = F.concat(F.trim(F.left("raw", F.lit(300))), F.when(F.length("raw") > 300, F.lit("...")).otherwise(F.lit("")))
    left, look, parts = sorted(r["term"] for r in terms.select("term").where("term IS NOT NULL").distinct().collect()), sample or FIRST_LOOK, []
    while left:
        p = _holders(c, left, look, within).withColumn("_r", F.row_number().over(W.partitionBy("term").orderBy("doc_id"))).where(F.col("_r") <= look)
        p = (F.broadcast(p) if len(left) * look <= 1 << 17 else p).join(c.docs.select("doc_id", "raw"), "doc_id")
        p = kept(p.select("term", "_r", F.when(found, snippet).alias("s")), "evidence")
        short = [] if sample else [r["term"] for r in p.groupBy("term").agg(F.count("*").alias("n"), F.count("s").alias("k")).where((F.col("n") >= look) & (F.col("k") < most)).collect()]
        parts.append(p.where(~F.col("term").isin(short)) if short else p)
        left, look = sorted(short), look * 32
    if not parts:
        return spark.createDataFrame([], "term string, evidence array<string>")
    p = parts[0]
    for more in parts[1:]:
        p = p.unionByName(more)
    p = p.where("s IS NOT NULL").withColumn("_r", F.row_number().over(W.partitionBy("term").orderBy("_r"))).where(F.col("_r") <= most)
    got = p.groupBy("term").agg(F.array_sort(F.collect_list(F.struct("_r", "s"))).alias("_l"))
    return got.select("term", F.transform("_l", lambda x: x["s"]).alias("evidence"))


def _top(df: DataFrame, n: int) -> DataFrame:
    return df.orderBy(F.desc("score"), "term").limit(n)


def _candidates(top: DataFrame, c: Corpus, source: str, context: Column, community: Column | None = None, **how) -> DataFrame:
    spark = c.docs.sparkSession
    top = spark.createDataFrame(top.collect(), top.schema)  # some dozens of rows, which took a pass over the texts
    e = evidence(c, top, **how)
    return top.join(e, "term", "left").select(
        "term", F.round(F.least(F.lit(1.0), "score"), 4).alias("score"), F.lit(source).alias("source"), F.array(F.lit(source)).alias("sources"), context.alias("context"),
        F.coalesce("evidence", F.array().cast("array<string>")).alias("evidence"), (community if community is not None else F.lit(None)).cast("int").alias("community_id"), F.col("doc_count").cast("long").alias("doc_count"),
    )


def cooccurrence(c: Corpus, seeds: list[str], top_n: int = 50, min_df: int = 5) -> DataFrame:
    top = _top(cooccurrence_scores(c, seeds, min_df), top_n)
    context = F.format_string("Co-occurring term (PMI: %.2f, LLR: %.1f)", "pmi", "llr")
    return _candidates(top, c, "cooccurrence", context, within=sorted({x.lower() for x in seeds}), sample=20)


def _near(c: Corpus, min_df: int, window: int, max_vocab: int) -> tuple[list[str], DataFrame, np.ndarray]:
    """The vocabulary, ``ia, ib, count`` of its words' pairs (each once, the smaller number first; written), and each word's sum of counts."""
    spark = c.docs.sparkSession
    vocab = [r["term"] for r in c.vocab.where(F.col("doc_count") >= min_df).orderBy(F.desc("doc_count"), "term").limit(max_vocab).select("term").collect()]
    vocab.sort()
    # a task counts its documents' pairs as numbers, and sums them by blocks of the table of pairs
    words = c.docs.select(tx.words_of(F.col("clean"), WORDS).alias("words"))
    blocks = words.mapInArrow(partial(grams.near_pairs, vocab=vocab, window=window), "block int, keys binary, counts binary")
    pairs = kept(blocks.repartition("block").sortWithinPartitions("block").mapInArrow(partial(grams.summed_pairs, wide=len(vocab)), "ia int, ib int, count long"), "pairs")
    sums = np.zeros(len(vocab), np.int64)
    ends = pairs.select(F.col("ia").alias("i"), "count").unionByName(pairs.where("ia <> ib").select(F.col("ib").alias("i"), "count"))
    for r in ends.groupBy("i").agg(F.sum("count").alias("s")).collect():  # max_vocab rows at most
        sums[r["i"]] = r["s"]
    return vocab, pairs, sums


def ppmi(c: Corpus, min_df: int = 5, window: int = 5, max_vocab: int = 10_000) -> DataFrame:
    """``a, b, count, ppmi`` of vocabulary words that stand within ``window`` places among the document's vocabulary words."""
    vocab, pairs, sums = _near(c, min_df, window, max_vocab)
    spark = c.docs.sparkSession
    names = spark.createDataFrame([(i, t, int(n)) for i, (t, n) in enumerate(zip(vocab, sums, strict=True))], "i int, t string, s long")
    at = lambda i, t, s: F.broadcast(names.select(F.col("i").alias(i), F.col("t").alias(t), F.col("s").alias(s)))
    both = pairs.unionByName(pairs.where("ia <> ib").select(F.col("ib").alias("ia"), F.col("ia").alias("ib"), "count"))
    out = both.join(at("ia", "a", "ra"), "ia").join(at("ib", "b", "rb"), "ib")
    return out.select("a", "b", "count", F.greatest(F.lit(0.0), F.log(F.col("count").cast("double") * F.lit(int(sums.sum())) / (F.col("ra").cast("double") * F.col("rb")))).alias("ppmi"))


def _matrix_rows(batches: Iterator[pa.RecordBatch], sums: np.ndarray) -> Iterator[pa.RecordBatch]:
    """``i, at, value``: the positive values of each row of the PPMI matrix, of pairs that come with all of their row's."""
    held = [np.column_stack([batch.column(k).to_numpy() for k in ("ia", "ib", "count")]) for batch in batches]
    if held and sum(map(len, held)):
        x = np.concatenate(held)
        value = np.log(x[:, 2].astype(np.float64) * sums.sum() / (sums[x[:, 0]].astype(np.float64) * sums[x[:, 1]]))
        x, value = x[value > 0], value[value > 0]
        order = np.lexsort((x[:, 1], x[:, 0]))
        x, value = x[order], value[order]
        i, first = np.unique(x[:, 0], return_index=True)
        ends = pa.array(np.append(first, len(x)), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.ListArray.from_arrays(ends, pa.array(x[:, 1], pa.int32())), pa.ListArray.from_arrays(ends, pa.array(value))], names=["i", "at", "value"])


def _factors(rows: DataFrame, n: int, k: int, more: int = 20, passes: int = 8, place: np.ndarray | None = None) -> np.ndarray:
    """Left singular vectors times the roots of singular values of a symmetric matrix, by subspace iteration.

    ``rows``: ``i, at array<int>, value array<double>``; ``place`` has the places of their numbers among the n, if these aren't all.
    A pass is one job; the driver holds n x (k + more) numbers, n being bounded.
    """
    spark = rows.sparkSession
    place = np.arange(n) if place is None else place

    def times(m: np.ndarray) -> np.ndarray:
        sent = spark.sparkContext.broadcast(m)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # rows are filled up with zeros, some at a time: at such densities one product of matrices is faster than a look-up for each entry
            for whole in batches:
                for first in range(0, whole.num_rows, 64):
                    batch = whole.slice(first, 64)
                    full = np.zeros((batch.num_rows, n))
                    for k, (a, v) in enumerate(zip(batch.column("at"), batch.column("value"), strict=True)):
                        full[k, place[a.values.to_numpy()]] = v.values.to_numpy()
                    got = [row.tobytes() for row in full @ sent.value]
                    yield pa.RecordBatch.from_arrays([batch.column("i"), pa.array(got, pa.binary())], names=["i", "row"])

        out = np.zeros((n, m.shape[1]))
        got = rows.mapInArrow(run, "i int, row binary").toArrow()
        for i, row in zip(got.column("i").to_pylist(), got.column("row"), strict=True):
            out[place[i]] = np.frombuffer(row.as_buffer(), np.float64)
        sent.unpersist()
        return out

    q = np.linalg.qr(times(np.random.default_rng(0).standard_normal((n, min(n, k + more)))))[0]
    for _ in range(passes):
        q = np.linalg.qr(times(q))[0]
    u, size, _ = np.linalg.svd(times(q).T, full_matrices=False)
    return (q @ u[:, :k]) * np.sqrt(size[:k])


def semantic_scores(c: Corpus, seeds: list[str], min_df: int = 5, window: int = 5, dims: int = 100, max_vocab: int = 10_000) -> DataFrame:
    """``term, doc_count, similarity, score``: closeness of a term's contexts to the seeds'.

    The PPMI matrix (a bounded vocabulary) is written once, by rows, and factored by subspace iteration over them.
    """
    spark = c.docs.sparkSession
    seeds = [s.lower() for s in seeds]
    vocab, pairs, sums = _near(c, min_df, window, max_vocab)
    both = pairs.unionByName(pairs.where("ia <> ib").select(F.col("ib").alias("ia"), F.col("ia").alias("ib"), "count"))
    rows = kept(both.repartition("ia").mapInArrow(partial(_matrix_rows, sums=sums), "i int, at array<int>, value array<double>"), "rows")
    some = sorted(r["i"] for r in rows.select("i").collect())
    names = [vocab[i] for i in some]
    at = {t: i for i, t in enumerate(names)}
    known = [at[s] for s in seeds if s in at]
    k = min(dims, len(names) - 1)
    empty = spark.createDataFrame([], "term string, doc_count long, similarity double, score double")
    if not known or k < 2:
        return empty
    place = np.zeros(len(vocab), np.int64)
    place[some] = np.arange(len(some))
    x = _factors(rows, len(names), k, place=place)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    centre = x[known].mean(0)
    if not np.linalg.norm(centre):
        return empty
    sim = x @ (centre / np.linalg.norm(centre))
    if len(known) > 1:
        sim = 0.5 * sim + 0.5 * (x @ x[known].T).max(1)
    rest = np.setdiff1d(np.arange(len(names)), known)
    rest = rest[sim[rest] > -0.5]
    if not len(rest):
        return empty
    lo, hi = sim[rest].min(), sim[rest].max()
    score = (sim[rest] - lo) / (hi - lo if hi > lo else 1.0)
    got = spark.createDataFrame(pd.DataFrame({"term": [names[i] for i in rest], "similarity": sim[rest], "score": score}), "term string, similarity double, score double")
    return got.where("score > 0").join(c.vocab, "term").select("term", "doc_count", "similarity", "score")


def semantic(c: Corpus, seeds: list[str], top_n: int = 50, min_df: int = 5, **how) -> DataFrame:
    top = _top(semantic_scores(c, seeds, min_df, **how), top_n)
    return _candidates(top, c, "semantic", F.format_string(f"Used in similar contexts to '{seeds[0]}' (distributional sim: %.3f)", "similarity"))


def cooccurrence_graph(c: Corpus, seeds: list[str], min_df: int = 5, max_nodes: int = 1000, hops: int = 2, terms_per_doc: int = 40) -> tuple[DataFrame, DataFrame]:
    """``nodes(term, doc_count)`` and ``edges(a, b, weight)`` around the seeds. A document gives its ``terms_per_doc`` most frequent terms."""
    seeds = sorted({s.lower() for s in seeds})
    is_seed = F.col("term").isin(seeds)
    spark = c.docs.sparkSession
    rows = c.vocab.where((F.col("doc_count") >= min_df) | is_seed).orderBy(F.desc(is_seed.cast("int")), F.desc("doc_count"), "term").limit(max_nodes).select("term", "doc_count").collect()
    pool = spark.createDataFrame(rows, "term string, doc_count long")
    first = [r["term"] for r in sorted(rows, key=lambda r: (-r["doc_count"], r["term"].encode()))]
    pairs = _tokenised(c.docs).mapInArrow(partial(grams.shared_rows, sizes=c.sizes, terms=first, most=terms_per_doc), "a string, b string, weight long")
    edges = kept(pairs.groupBy("a", "b").agg(F.sum("weight").alias("weight")), "edges")  # a bounded number
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    reached = pool.where(is_seed).select("term")
    if reached.isEmpty():
        return pool, edges
    for _ in range(hops):
        step = both.join(F.broadcast(reached), both["a"] == reached["term"]).select(F.col("b").alias("term"))
        reached = reached.unionByName(step).distinct()
    nodes = pool.join(F.broadcast(reached), "term", "left_semi")
    inside = edges.join(F.broadcast(nodes.select(F.col("term").alias("a"))), "a", "left_semi").join(F.broadcast(nodes.select(F.col("term").alias("b"))), "b", "left_semi").select("a", "b", "weight")
    return nodes, inside


def graph_measures(nodes: DataFrame, edges: DataFrame, seeds: list[str], sources: int = 200) -> DataFrame:
    """``term, community, pagerank, betweenness, near_seed, is_bridge`` of a bounded graph, in one task."""
    seeds = sorted({s.lower() for s in seeds})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames), ignore_index=True)
        names = sorted(rows.loc[rows["b"].isna(), "a"])
        links = rows.dropna(subset=["b"]).sort_values(["a", "b"])
        adj = graph.adjacency(names, list(zip(links["a"], links["b"], links["weight"], strict=True)))
        n = len(names)
        kind = graph.communities(adj)
        start = np.array([float(t in seeds) for t in names])
        rank = graph.pagerank(adj, start)
        between = graph.betweenness(adj, min(sources, n) if n > 500 else None)
        seed_kinds = {int(kind[i]) for i, t in enumerate(names) if t in seeds}
        around = [{int(kind[j]) for j in a} for a in adj]
        near = [int(kind[i]) in seed_kinds or bool(around[i] & seed_kinds) for i in range(n)]
        yield pd.DataFrame({"term": names, "community": kind.astype("int32"), "pagerank": rank, "betweenness": between, "near_seed": near, "is_bridge": [len(a & seed_kinds) > 1 for a in around]})

    rows = nodes.select(F.col("term").alias("a"), F.lit(None).cast("string").alias("b"), F.lit(None).cast("long").alias("weight")).unionByName(edges.select("a", "b", "weight"))
    return rows.coalesce(1).mapInPandas(run, "term string, community int, pagerank double, betweenness double, near_seed boolean, is_bridge boolean")


def network_scores(c: Corpus, seeds: list[str], min_df: int = 5, max_nodes: int = 1000, hops: int = 2) -> DataFrame:
    nodes, edges = cooccurrence_graph(c, seeds, min_df, max_nodes, hops)
    m = graph_measures(nodes, edges, seeds)
    ends = m.agg(F.max("pagerank").alias("_p"), F.max("betweenness").alias("_b"), F.count("*").alias("_n"))
    part = lambda x, top: F.coalesce(F.try_divide(x, F.nullif(F.col(top), F.lit(0.0))), F.lit(0.0))
    s = m.crossJoin(F.broadcast(ends)).where("_n >= 3").withColumn("score", 0.5 * part(F.col("betweenness"), "_b") + 0.5 * part(F.col("pagerank"), "_p"))
    s = s.where(F.col("near_seed") & ~F.col("term").isin([x.lower() for x in seeds]) & (F.col("score") > 0))
    return s.join(c.vocab, "term").select("term", "score", "community", "is_bridge", "doc_count")


def network(c: Corpus, seeds: list[str], top_n: int = 50, min_df: int = 5, **how) -> DataFrame:
    top = _top(network_scores(c, seeds, min_df, **how), top_n)
    bridge = F.when(F.col("is_bridge"), F.lit(" - BRIDGE term connecting multiple communities")).otherwise(F.lit(""))
    return _candidates(top, c, "network", F.concat(F.lit("Graph centrality (community "), F.col("community"), F.lit(")"), bridge), F.col("community"))


def lexicon(words: DataFrame) -> DataFrame:
    """``word``: base words with their inflected forms, contractions and common abbreviations."""
    w = F.lower("word")
    stem = F.expr("left(lower(word), length(word) - 1)")
    none = F.array().cast("array<string>")
    forms = F.concat(
        F.array(w), F.when(F.length(w) >= 2, F.array(*(F.concat(w, F.lit(e)) for e in ENDINGS))).otherwise(none),
        F.when((F.length(w) >= 2) & w.endswith("e"), F.array(*(F.concat(stem, F.lit(e)) for e in E_ENDINGS))).otherwise(none),
        F.when((F.length(w) >= 2) & w.endswith("y"), F.array(*(F.concat(stem, F.lit(e)) for e in Y_ENDINGS))).otherwise(none),
    )
    more = words.sparkSession.createDataFrame([(x,) for x in CONTRACTIONS + ABBREVIATIONS], "word string")
    return words.select(F.explode(forms).alias("word")).unionByName(more).distinct()


def unknown_terms(vocab: DataFrame, known: DataFrame) -> DataFrame:
    """Terms with a word of two letters or more that the lexicon lacks."""
    words = vocab.select("term", F.explode(F.split("term", r"\s+")).alias("word")).where(F.length("word") >= 2)
    return words.join(known, "word", "left_anti").select("term").distinct()


def productive_prefixes(terms: DataFrame, least: int = 3, family: int = 3) -> DataFrame:
    """``prefix, size, members`` (five at most) of prefixes that several single-word terms share."""
    single = terms.where(~F.contains("term", F.lit(" ")) & (F.length("term") > least))
    p = single.select("term", F.explode(F.sequence(F.lit(least), F.length("term") - 1)).alias("n")).select("term", F.expr("left(term, n)").alias("prefix")).where(~F.col("prefix").isin(STOP_PREFIXES))
    sizes = p.groupBy("prefix").agg(F.count("*").alias("size")).where(F.col("size") >= family)
    head = p.join(sizes, "prefix").withColumn("_r", F.row_number().over(W.partitionBy("prefix").orderBy("term"))).where("_r <= 5")
    return head.groupBy("prefix", "size").agg(F.array_sort(F.collect_list("term")).alias("members"))


def corpus_specific_scores(c: Corpus, seeds: list[str], known: DataFrame, min_df: int = 5) -> DataFrame:
    seeds_ = [s.lower() for s in seeds]
    terms = counts(c, seeds).where((F.col("doc_count") >= min_df) & ~F.col("term").isin(seeds_))
    terms = terms.join(unknown_terms(terms, known), "term")
    raw = F.log1p(F.col("doc_count").cast("double")) * (1.0 + 2.0 * F.col("wide") / F.col("doc_count"))
    t = terms.select("term", "doc_count", raw.alias("raw_score"))
    top = t.agg(F.max("raw_score").alias("_m"))
    return t.crossJoin(F.broadcast(top)).select("term", "doc_count", "raw_score", (F.col("raw_score") / F.col("_m")).alias("score"))


def corpus_specific(c: Corpus, seeds: list[str], known: DataFrame, top_n: int = 50, min_df: int = 5) -> DataFrame:
    scores = corpus_specific_scores(c, seeds, known, min_df)
    top = _top(scores, top_n)
    families = productive_prefixes(scores.select("term"))
    prefixed = top.select("term", F.explode(F.when(F.length("term") > 3, F.sequence(F.lit(3), F.length("term") - 1)).otherwise(F.array().cast("array<int>"))).alias("n")).select("term", F.expr("left(term, n)").alias("prefix"))
    best = prefixed.join(families, "prefix").groupBy("term").agg(F.max_by(F.struct("prefix", "members"), F.struct("size", F.col("prefix"))).alias("f"))
    top = top.join(best, "term", "left")
    context = F.concat(F.lit("Corpus-specific term (not in standard English dictionary)"), F.coalesce(F.concat(F.lit(". Productive affix '"), F.col("f.prefix"), F.lit("-': "), F.array_join("f.members", ", ")), F.lit("")))
    return _candidates(top, c, "corpus_specific", context, whole_word=False)


def stem_overlap(term: Column, blocked: list[str]) -> Column:
    """Whether a term is a plain variant of a blocked one: a prefix either way, word by word."""
    words = F.split(term, r"\s+")
    out = F.lit(False)
    for seed in sorted({b.lower() for b in blocked}):
        parts = seed.split()
        if len(parts) == 1:
            out = out | F.exists(words, _alike(parts[0]))
        elif parts:
            each = F.lit(True)
            for i, p in enumerate(parts):
                each = each & _alike(p)(F.coalesce(F.get(words, F.lit(i)), F.lit("")))
            out = out | ((F.size(words) == len(parts)) & each)
    return out


def _alike(p: str):
    return lambda w: w.startswith(p) | F.lit(p).startswith(w)


def merge(candidates: DataFrame, seeds: list[str], dismissed: list[str] = (), excluded: list[str] = (), min_df: int = 5, n_docs: int = 0, max_df_ratio: float = MAX_DF_RATIO, stop: list[str] | None = None) -> DataFrame:
    """One row per term: the highest score and its context, all sources, five pieces of evidence at most.

    Seeds, dismissed and excluded terms, their plain variants, stop words, rare and too frequent terms go, and words of
    terms of several words. Ties follow the order of MODULES. ``stop``: the stop words; by default the short English list of the
    lexicon, beside which a longer one (a file of words, see :func:`word_list`) can be given.
    """
    stop = STOP_WORDS if stop is None else stop
    low = lambda xs: sorted({x.lower() for x in xs})
    term = F.trim(F.lower("term"))
    c = candidates.withColumn("term", term)
    blocked = low([*seeds, *dismissed, *excluded])
    ok = ~F.col("term").isin(blocked) & ~stem_overlap(F.col("term"), [*seeds, *excluded]) & (F.length("term") >= 2)
    ok = ok & F.exists(F.split("term", r"\s+"), lambda w: ~w.isin(stop)) & (F.col("doc_count") >= min_df)
    if n_docs > 0:
        ok = ok & (F.col("doc_count") <= int(n_docs * max_df_ratio))
    order = F.coalesce(F.array_position(F.array(*map(F.lit, MODULES)), F.col("source")), F.lit(99))
    c = c.where(ok).withColumn("_o", order)
    g = c.groupBy("term").agg(
        F.max("score").alias("score"), F.array_sort(F.collect_list(F.struct("_o", "sources", "evidence", "community_id"))).alias("l"),
        F.max_by("context", F.struct("score", -F.col("_o"))).alias("context"), F.max("doc_count").alias("doc_count"),
    )
    all_of = lambda f: F.array_distinct(F.flatten(F.transform("l", lambda x: x[f])))
    kinds = F.filter(F.transform("l", lambda x: x["community_id"]), lambda x: x.isNotNull())
    g = g.select("term", "score", F.array_join(all_of("sources"), "|").alias("source"), all_of("sources").alias("sources"), "context", F.slice(all_of("evidence"), 1, 5).alias("evidence"), F.when(F.size(kinds) > 0, F.element_at(kinds, -1)).alias("community_id"), "doc_count")
    parts = g.where(F.contains("term", F.lit(" "))).select(F.explode(F.split("term", r"\s+")).alias("term")).distinct()
    kept = g.where(F.contains("term", F.lit(" "))).unionByName(g.where(~F.contains("term", F.lit(" "))).join(parts, "term", "left_anti").select(*g.columns))
    return kept.orderBy(F.desc("score"), "term")


def word_list(spark, path: str) -> list[str]:
    """The distinct words of a text file, in lower case: a user's stop list or the like, whose size the user knows."""
    return sorted(r["w"] for r in spark.read.text(path).select(F.explode(F.split(F.lower("value"), r"\s+")).alias("w")).where("w <> ''").distinct().collect())


def rerank(candidates: DataFrame, scorer=None, top_k: int = 50) -> DataFrame:
    """``scorer(candidates) -> term, score`` replaces the scores of the first ``top_k``; without one all stays."""
    if scorer is None:
        return candidates
    head = _top(candidates, top_k)
    return head.drop("score").join(scorer(head), "term").select(*candidates.columns).orderBy(F.desc("score"), "term")


def discover(c: Corpus, seeds: list[str], known: DataFrame, top_n: int = 50, min_df: int = 5, dismissed: list[str] = (), excluded: list[str] = (), scorer=None, max_df_ratio: float = MAX_DF_RATIO, stop: list[str] | None = None) -> DataFrame:
    """All four modules, merged and reranked. The vocabulary is counted and written first, as each module reads it."""
    c = stored(c, seeds)
    parts = [cooccurrence(c, seeds, top_n, min_df), semantic(c, seeds, top_n, min_df), network(c, seeds, top_n, min_df), corpus_specific(c, seeds, known, top_n, min_df)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return rerank(merge(every, seeds, dismissed, excluded, min_df, c.n_docs, max_df_ratio, stop), scorer)


@dataclass
class Chain:
    """Rounds of discovery: seeds, what was added, excluded and dismissed, and each round's candidates."""

    seeds: list[str]
    added: list[str]
    excluded: list[str]
    dismissed: list[str]
    rounds: list[dict]

    @classmethod
    def start(cls, seeds: list[str]) -> Chain:
        return cls(list(dict.fromkeys(s.strip().lower() for s in seeds if s.strip())), [], [], [], [])

    def record(self, candidates: DataFrame) -> None:
        self.rounds.append({"number": len(self.rounds) + 1, "seeds": list(self.seeds), "added": [], "excluded": [], "dismissed": [], "candidates": [r.asDict(recursive=True) for r in candidates.collect()]})

    def select(self, added: list[str] = (), excluded: list[str] = (), dismissed: list[str] = ()) -> None:
        """Only terms that are new are noted for the round, so undoing it leaves what was there before."""
        for name, terms, more in (("added", added, self.seeds), ("excluded", excluded, None), ("dismissed", dismissed, None)):
            mine = getattr(self, name)
            for t in dict.fromkeys(x.strip().lower() for x in terms if x.strip()):
                if t in mine or (more is not None and t in more):
                    continue
                mine.append(t)
                if more is not None:
                    more.append(t)
                if self.rounds:
                    self.rounds[-1][name].append(t)

    def undo(self) -> None:
        if not self.rounds:
            return
        last = self.rounds.pop()
        self.seeds = [s for s in self.seeds if s not in last["added"]]
        for name in ("added", "excluded", "dismissed"):
            setattr(self, name, [t for t in getattr(self, name) if t not in last[name]])

    def to_json(self) -> str:
        import json

        return json.dumps(self.__dict__, indent=2, ensure_ascii=False)

    @classmethod
    def from_json(cls, text: str) -> Chain:
        import json

        return cls(**json.loads(text))

    def table(self, spark) -> DataFrame:
        """``term, score, sources, context, doc_count, community_id, round`` of all rounds."""
        rows = [(c["term"], c["score"], "|".join(c["sources"]), c["context"], c["doc_count"], c["community_id"], r["number"]) for r in self.rounds for c in r["candidates"]]
        return spark.createDataFrame(rows, "term string, score double, sources string, context string, doc_count long, community_id int, round int")

    def boolean_query(self) -> str:
        return " OR ".join(f'"{s}"' if " " in s else s for s in self.seeds)
