"""Queries of keyword discovery over all ``documents``; the seeds are words of the corpus, the words of ``benchmark`` stand in for a dictionary."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.boolean_query import boolean_filter
from ..operators import keyword as kd
from ..operators.lexicon import STOP_WORDS
from .registry import query, table
from .text_queries import _in

SEEDS = ["idiot", "clown", "disgusting"]
MIN_DF = 5


def corpus(spark, d) -> kd.Corpus:
    return kd.corpus(table(spark, d, "documents"), "doc_id", "text", min_df=MIN_DF)


WORD = r"[\p{L}\p{N}_]"
CLEAN = rf"trim(lower(regexp_replace(regexp_replace(text, '(?i)https?://\S+', '', 'g'), '@{WORD}+', '', 'g')))"
PROPER = r"list_transform(regexp_extract_all(regexp_replace(text, '[^\x00-\x7F]', '0', 'g'), '\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3}\b'), lambda x: lower(x))"
DOCS = f"(SELECT doc_id, text, {CLEAN} AS clean FROM documents WHERE text IS NOT NULL)"
TERMS = f"(SELECT doc_id, list_concat(w, list_concat(CASE WHEN len(w) < 2 THEN [] ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END, p)) AS t FROM (SELECT doc_id, regexp_extract_all(clean, '{WORD}+') AS w, {PROPER} AS p FROM {DOCS}))"
POSTINGS = f"(SELECT DISTINCT doc_id, unnest(t) AS term FROM {TERMS})"
VOCAB = f"(SELECT term, count(*) AS doc_count FROM {POSTINGS} GROUP BY 1 HAVING count(*) >= {MIN_DF})"


@query(f"SELECT doc_id, {CLEAN} AS clean FROM documents")
def kd_clean(spark, d):
    return table(spark, d, "documents").select("doc_id", kd.clean(F.col("text")).alias("clean"))


@query(f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n, array_to_string(t, '|') AS terms FROM (SELECT doc_id, list_concat(w, CASE WHEN len(w) < 2 THEN [] ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS t FROM (SELECT doc_id, regexp_extract_all(clean, '{WORD}+') AS w FROM {DOCS}))")
def kd_tokenize(spark, d):
    t = kd.terms_of(F.col("clean"))
    return table(spark, d, "documents").select("doc_id", kd.clean(F.col("text")).alias("clean")).select("doc_id", F.size(t).cast("long").alias("n"), F.array_join(t, "|").alias("terms"))


@query(f"SELECT doc_id, term FROM (SELECT doc_id, unnest({PROPER}) AS term FROM documents)")
def kd_proper_nouns(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(kd.proper_nouns(F.col("text"))).alias("term"))


@query(f"SELECT term, doc_count FROM {VOCAB}")
def kd_term_index(spark, d):
    return corpus(spark, d).vocab


BOOLEAN = '(idiot OR "of the") AND NOT thand* AND NOT (clown and trash)'


@query(r"""SELECT doc_id FROM documents WHERE (regexp_matches(x, '(?i)(^|[^\p{L}\p{N}_])idiot($|[^\p{L}\p{N}_])') OR contains(lower(x), 'of the')) AND NOT regexp_matches(x, '(?i)(^|[^\p{L}\p{N}_])thand')
    AND NOT (regexp_matches(x, '(?i)(^|[^\p{L}\p{N}_])clown($|[^\p{L}\p{N}_])') AND regexp_matches(x, '(?i)(^|[^\p{L}\p{N}_])trash($|[^\p{L}\p{N}_])'))""".replace("FROM documents WHERE", "FROM (SELECT doc_id, text AS x FROM documents) WHERE"))
def kd_boolean_filter(spark, d):
    return table(spark, d, "documents").where(boolean_filter(F.col("text"), BOOLEAN)).select("doc_id")


SEED_DOCS = f"(SELECT DISTINCT doc_id FROM {POSTINGS} WHERE term IN {_in(SEEDS)})"


@query(f"SELECT doc_id FROM {SEED_DOCS}")
def kd_seed_mask(spark, d):
    return kd.seed_docs(corpus(spark, d), SEEDS)


N = f"(SELECT count(*) FROM {DOCS})"
COUNTS = f"(SELECT term, doc_count AS y, count(*) AS xy, (SELECT count(*) FROM {SEED_DOCS}) AS x, {N} AS n FROM {POSTINGS} JOIN {VOCAB} USING (term) WHERE doc_id IN (SELECT doc_id FROM {SEED_DOCS}) AND term NOT IN {_in(SEEDS)} GROUP BY 1, 2)"
PMI = "log2((xy / n) / ((x / n) * (y / n)))"


def _side(k: str, m: str, p: str) -> str:
    p = f"greatest(1e-10, least(1 - 1e-10, {p}))"
    return f"CASE WHEN {k} = 0 OR {m} = 0 THEN 0 ELSE {k} * ln({p}) + ({m} - {k}) * ln(1 - {p}) END"


LLR = "2.0::DOUBLE * (" + f"({_side('xy', 'x', 'xy / x')}) + ({_side('(y - xy)', '(n - x)', '(y - xy) / (n - x)')}) - ({_side('xy', 'x', 'y / n')}) - ({_side('(y - xy)', '(n - x)', 'y / n')}))"


@query(f"SELECT term, {PMI} AS pmi FROM {COUNTS}")
def kd_pmi(spark, d):
    return kd.cooccurrence_scores(kd.stored(corpus(spark, d), SEEDS), SEEDS, MIN_DF).select("term", "pmi")


@query(f"SELECT term, {LLR} AS llr FROM {COUNTS}")
def kd_llr(spark, d):
    return kd.cooccurrence_scores(kd.stored(corpus(spark, d), SEEDS), SEEDS, MIN_DF).select("term", "llr")


@query(f"SELECT term, (doc_count - min(doc_count) OVER ()) / (max(doc_count) OVER () - min(doc_count) OVER ()) AS scaled FROM {VOCAB}")
def kd_minmax(spark, d):
    return kd.minmax(corpus(spark, d).vocab, "doc_count", "scaled").select("term", "scaled")


SCORES = f"(SELECT *, 0.4::DOUBLE * (pmi - min(pmi) OVER ()) / (max(pmi) OVER () - min(pmi) OVER ()) + 0.6::DOUBLE * (llr - min(llr) OVER ()) / (max(llr) OVER () - min(llr) OVER ()) AS score FROM (SELECT term, xy AS n_co, y AS doc_count, {PMI} AS pmi, {LLR} AS llr FROM {COUNTS}))"


@query(f"SELECT term, n_co, doc_count, round(score, 9) AS score FROM {SCORES}")
def kd_cooccurrence(spark, d):
    return kd.cooccurrence_scores(kd.stored(corpus(spark, d), SEEDS), SEEDS, MIN_DF).select("term", "n_co", "doc_count", F.round("score", 9).alias("score"))


@query(f"""WITH p AS (SELECT term, doc_id, row_number() OVER (PARTITION BY term ORDER BY doc_id) AS r FROM {POSTINGS} WHERE term IN {_in(SEEDS)})
    SELECT term, string_agg(trim(left(text, 300)) || CASE WHEN length(text) > 300 THEN '...' ELSE '' END, '|' ORDER BY doc_id) AS evidence FROM p JOIN documents USING (doc_id) WHERE r <= 5 GROUP BY term""")
def kd_evidence(spark, d):
    c = corpus(spark, d)
    terms = spark.createDataFrame([(s,) for s in SEEDS], "term string")
    return kd.evidence(c, terms).select("term", F.array_join("evidence", "|").alias("evidence"))


SEQ = f"(SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS i FROM (SELECT doc_id, unnest(w) AS term, unnest(range(1, len(w) + 1)) AS k FROM (SELECT doc_id, regexp_extract_all(clean, '{WORD}+') AS w FROM {DOCS})) WHERE term IN (SELECT term FROM {VOCAB} ORDER BY doc_count DESC, term LIMIT 10000))"


@query(f"""WITH s AS {SEQ}, c AS (SELECT x.term AS a, y.term AS b, count(*) AS count FROM s x JOIN s y ON x.doc_id = y.doc_id AND x.i <> y.i AND abs(x.i - y.i) <= 5 GROUP BY 1, 2),
    m AS (SELECT a, sum(count)::DOUBLE AS s FROM c GROUP BY 1) SELECT c.a, c.b, count, round(greatest(0, ln(count::DOUBLE * (SELECT sum(s) FROM m) / (x.s * y.s))), 9) AS ppmi FROM c JOIN m x ON x.a = c.a JOIN m y ON y.a = c.b""")
def kd_ppmi(spark, d):
    return kd.ppmi(corpus(spark, d), MIN_DF).withColumn("ppmi", F.round("ppmi", 9))


@query()
def kd_semantic(spark, d):
    return kd.semantic(kd.stored(corpus(spark, d)), SEEDS, 50, MIN_DF)


GRAPH = f"""(WITH v AS (SELECT term, doc_count FROM {VOCAB} ORDER BY CASE WHEN term IN {_in(SEEDS)} THEN 0 ELSE 1 END, doc_count DESC, term LIMIT 1000),
    f AS (SELECT doc_id, term FROM (SELECT doc_id, p.term, row_number() OVER (PARTITION BY doc_id ORDER BY v.doc_count DESC, p.term) AS r FROM {POSTINGS} p JOIN v ON p.term = v.term) WHERE r <= 40),
    e AS (SELECT x.term AS a, y.term AS b, count(*) AS weight FROM f x JOIN f y ON x.doc_id = y.doc_id AND x.term < y.term GROUP BY 1, 2),
    u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), h0 AS (SELECT term FROM v WHERE term IN {_in(SEEDS)}), h1 AS (SELECT term FROM h0 UNION SELECT b FROM u WHERE a IN (SELECT term FROM h0)),
    h2 AS (SELECT term FROM h1 UNION SELECT b FROM u WHERE a IN (SELECT term FROM h1)) SELECT a, b, weight FROM e WHERE a IN (SELECT term FROM h2) AND b IN (SELECT term FROM h2))"""


@query(GRAPH[1:-1])
def kd_graph(spark, d):
    return kd.cooccurrence_graph(kd.stored(corpus(spark, d)), SEEDS, MIN_DF)[1]


def _measures(spark, d):
    nodes, edges = kd.cooccurrence_graph(kd.stored(corpus(spark, d)), SEEDS, MIN_DF)
    return kd.graph_measures(nodes, edges, SEEDS)


@query()
def kd_pagerank(spark, d):
    return _measures(spark, d).select("term", F.round("pagerank", 9).alias("pagerank"))


@query()
def kd_betweenness(spark, d):
    return _measures(spark, d).select("term", F.round("betweenness", 9).alias("betweenness"))


@query()
def kd_communities(spark, d):
    return _measures(spark, d).select("term", "community")


@query()
def kd_network(spark, d):
    return kd.network(kd.stored(corpus(spark, d)), SEEDS, 50, MIN_DF)


def _words(spark, d):
    w = F.explode(kd.terms_of(kd.clean(F.col("text")), 1, 1))
    return table(spark, d, "benchmark").select(w.alias("word")).distinct()


WORDS = f"(SELECT DISTINCT unnest(regexp_extract_all(c, '{WORD}+')) AS word FROM (SELECT {CLEAN} AS c FROM benchmark))"
LEXICON = f"""(SELECT word FROM {WORDS} UNION SELECT word || e FROM {WORDS}, (SELECT unnest({list(kd.ENDINGS)}) AS e) WHERE length(word) >= 2
    UNION SELECT left(word, -1) || e FROM {WORDS}, (SELECT unnest({list(kd.E_ENDINGS)}) AS e) WHERE length(word) >= 2 AND word LIKE '%e' UNION SELECT left(word, -1) || e FROM {WORDS}, (SELECT unnest({list(kd.Y_ENDINGS)}) AS e) WHERE length(word) >= 2 AND word LIKE '%y'
    UNION SELECT unnest({kd.CONTRACTIONS + kd.ABBREVIATIONS}))"""


@query(f"SELECT word FROM {LEXICON}")
def kd_lexicon(spark, d):
    return kd.lexicon(_words(spark, d))


UNKNOWN = f"(SELECT DISTINCT term FROM (SELECT term, unnest(string_split(term, ' ')) AS w FROM {VOCAB}) WHERE length(w) >= 2 AND w NOT IN (SELECT word FROM {LEXICON}))"


@query(f"SELECT term FROM {UNKNOWN}")
def kd_non_english(spark, d):
    return kd.unknown_terms(corpus(spark, d).vocab, kd.lexicon(_words(spark, d)))


@query(f"SELECT prefix, count(*) AS size, array_to_string(list_sort(list(term))[:5], '|') AS members FROM (SELECT term, left(term, n) AS prefix FROM (SELECT term, unnest(range(3, length(term))) AS n FROM {UNKNOWN} WHERE NOT contains(term, ' ') AND length(term) > 3)) WHERE prefix NOT IN {_in(kd.STOP_PREFIXES)} GROUP BY 1 HAVING count(*) >= 3")
def kd_affixes(spark, d):
    return kd.productive_prefixes(kd.unknown_terms(corpus(spark, d).vocab, kd.lexicon(_words(spark, d)))).select("prefix", "size", F.array_join("members", "|").alias("members"))


SPECIFIC = f"""(SELECT term, doc_count, ln(1 + doc_count::DOUBLE) * (1 + 2.0::DOUBLE * coalesce(co, 0) / doc_count) AS s FROM {VOCAB} JOIN {UNKNOWN} USING (term)
    LEFT JOIN (SELECT term, count(*) AS co FROM {POSTINGS} WHERE doc_id IN (SELECT doc_id FROM {SEED_DOCS}) GROUP BY 1) USING (term) WHERE term NOT IN {_in(SEEDS)})"""


@query(f"SELECT term, doc_count, round(s / max(s) OVER (), 9) AS score FROM {SPECIFIC}")
def kd_corpus_specific(spark, d):
    return kd.corpus_specific_scores(kd.stored(corpus(spark, d), SEEDS), SEEDS, kd.lexicon(_words(spark, d)), MIN_DF).select("term", "doc_count", F.round("score", 9).alias("score"))


OVERLAP = "len(list_filter(string_split(term, ' '), lambda w: " + " OR ".join(f"starts_with(w, '{s}') OR starts_with('{s}', w)" for s in SEEDS) + ")) > 0"


@query(f"SELECT term FROM {VOCAB} WHERE {OVERLAP}")
def kd_stem_overlap(spark, d):
    return corpus(spark, d).vocab.where(kd.stem_overlap(F.col("term"), SEEDS)).select("term")


def _two_modules(spark, d):
    """Candidates of two modules without evidence, so that SQL can follow."""
    c = kd.stored(corpus(spark, d), SEEDS)
    none = F.array().cast("array<string>")
    shape = lambda t, name: t.select("term", F.round("score", 9).alias("score"), F.lit(name).alias("source"), F.array(F.lit(name)).alias("sources"), F.lit(name).alias("context"), none.alias("evidence"), F.lit(None).cast("int").alias("community_id"), "doc_count")
    return c, shape(kd.cooccurrence_scores(c, SEEDS, MIN_DF), "cooccurrence").unionByName(shape(kd.corpus_specific_scores(c, SEEDS, kd.lexicon(_words(spark, d)), MIN_DF), "corpus_specific"))


@query(f"""WITH a AS (SELECT term, round(score, 9) AS score, 1 AS o, 'cooccurrence' AS source, doc_count FROM {SCORES} UNION ALL SELECT term, round(s / max(s) OVER (), 9), 4, 'corpus_specific', doc_count FROM {SPECIFIC}),
    k AS (SELECT * FROM a WHERE NOT ({OVERLAP}) AND length(term) >= 2 AND len(list_filter(string_split(term, ' '), lambda w: w NOT IN {_in(STOP_WORDS)})) > 0 AND doc_count >= {MIN_DF} AND doc_count <= CAST(floor({N} * 0.5) AS BIGINT)),
    g AS (SELECT term, max(score) AS score, string_agg(source, '|' ORDER BY o) AS source, max(doc_count) AS doc_count FROM k GROUP BY 1),
    w AS (SELECT DISTINCT unnest(string_split(term, ' ')) AS term FROM g WHERE contains(term, ' ')) SELECT * FROM g WHERE contains(term, ' ') OR term NOT IN (SELECT term FROM w)""")
def kd_merge(spark, d):
    c, both = _two_modules(spark, d)
    return kd.merge(both, SEEDS, min_df=MIN_DF, n_docs=c.n_docs, max_df_ratio=0.5).select("term", "score", "source", "doc_count")


@query()
def kd_discover(spark, d):
    c = corpus(spark, d)
    return kd.discover(c, SEEDS, kd.lexicon(_words(spark, d)), 50, MIN_DF, max_df_ratio=0.5)


TOP = f"(SELECT *, row_number() OVER (ORDER BY score DESC, term) AS place FROM {SCORES})"


@query(f"SELECT term, round(1.0::DOUBLE / (1 + length(term)), 9) AS score, doc_count FROM {TOP} WHERE place <= 20")
def kd_rerank(spark, d):
    c = kd.stored(corpus(spark, d), SEEDS)
    first = kd.cooccurrence(c, SEEDS, 50, MIN_DF)
    return kd.rerank(first, lambda h: h.select("term", (1.0 / (1.0 + F.length("term"))).alias("score")), 20).select("term", F.round("score", 9).alias("score"), "doc_count")


def _chain(spark, d) -> kd.Chain:
    chain = kd.Chain.start(SEEDS)
    c = kd.stored(corpus(spark, d), SEEDS)
    top = kd.cooccurrence(c, chain.seeds, 10, MIN_DF)
    chain.record(top)
    names = [r["term"] for r in top.select("term").collect()]
    chain.select(added=names[:2], excluded=names[2:3], dismissed=names[3:4])
    return chain


@query(f"SELECT 'seeds' AS kind, unnest({SEEDS}) AS term UNION ALL SELECT unnest(CASE WHEN place <= 2 THEN ['seeds', 'added'] WHEN place = 3 THEN ['excluded'] ELSE ['dismissed'] END), term FROM {TOP} WHERE place <= 4")
def kd_select(spark, d):
    chain = _chain(spark, d)
    return spark.createDataFrame([(k, t) for k in ("seeds", "added", "excluded", "dismissed") for t in getattr(chain, k)], "kind string, term string")


@query(f"SELECT unnest({SEEDS}) AS term")
def kd_undo(spark, d):
    chain = _chain(spark, d)
    chain.undo()
    return spark.createDataFrame([(s,) for s in chain.seeds], "term string")


@query(f"SELECT term, round(score, 4) AS score, 'cooccurrence' AS sources, printf('Co-occurring term (PMI: %.2f, LLR: %.1f)', pmi, llr) AS context, doc_count, CAST(NULL AS INTEGER) AS community_id, CAST(1 AS INTEGER) AS round FROM {TOP} WHERE place <= 10")
def kd_export_csv(spark, d):
    return _chain(spark, d).table(spark)
