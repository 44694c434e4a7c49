"""Lexicon: frequencies of n-grams by group, differences between groups, sentiment and counts of what texts mention."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import grams as gm
from ..functions import text as tx
from ..sources.files import shared_folder

#: English stop words (fixed list); other lists can be given.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves "
    "what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while "
    "of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there "
    "when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now d ll m o re ve y ain "
    "aren couldn didn doesn hadn hasn haven isn ma mightn mustn needn shan shouldn wasn weren won wouldn"
).split()

#: A small valence table of our own, from -4 to 4; a user's table replaces it.
VALENCE = {"good": 1.9, "great": 3.1, "excellent": 2.7, "happy": 2.7, "love": 3.2, "nice": 1.8, "best": 3.2, "win": 2.8, "bad": -2.5, "awful": -2.0, "hate": -2.7, "sad": -2.1, "terrible": -2.1, "worst": -3.1, "stupid": -2.4, "idiot": -2.3, "trash": -1.9, "pathetic": -2.7, "disgusting": -2.4, "moron": -2.2, "scum": -2.5}


def truthy(value: str | None) -> bool:
    return (value or "").strip().lower() in {"1", "true", "on", "yes", "y", "t"}


def with_group(df: DataFrame, group: str | None) -> DataFrame:
    """Adds ``group``: a column's value as text, or 'all'."""
    return df.withColumn("group", F.coalesce(F.col(group).cast("string"), F.lit("nan")) if group else F.lit("all"))


def enrich(df: DataFrame, text: str, html: str | None = None, stop: list[str] | None = None) -> DataFrame:
    """All derived columns in one projection, so the table is scanned once."""
    c = F.col(text)
    clean = tx.clean_text(c)
    more = {"clean_text": clean, "tokens": tx.tokens(clean, STOP_WORDS if stop is None else stop), "mentions": tx.mentions(c), "hashtags": tx.hashtags(c), "links": tx.links(c), "domains": F.transform(tx.links(c), tx.domain)}
    if html:
        more |= {"html_links": tx.hrefs(F.col(html)), "html_tweets": tx.tweets(F.col(html))}
    return df.withColumns(more)


def grams(tokenised: DataFrame, sizes: tuple[int, ...] = (1, 2, 3), tokens: str = "tokens") -> DataFrame:
    """``group, term``: a row for each n-gram."""
    t = F.col(tokens)
    return tokenised.select("group", F.explode(F.concat(*(tx.ngrams(t, n) if n > 1 else t for n in sizes))).alias("term"))


def group_totals(tokenised: DataFrame, sizes: tuple[int, ...] = (1, 2, 3), tokens: str = "tokens") -> DataFrame:
    each = sum((F.greatest(F.size(tokens) - (n - 1), F.lit(0)) for n in sizes), F.lit(0))
    return tokenised.groupBy("group").agg(F.sum(each).cast("long").alias("total_token_equivalents"))


def frequency(tokenised: DataFrame, sizes: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """``group, term, count_raw, normalized_per_thousand``: per thousand of all n-grams of all sizes together. Groups are few.

    Each task counts its n-grams as numbers, and the counts travel packed by the terms' hash.
    """
    rows = tokenised.where(F.col("group").isNotNull()).select(F.col("group").cast("string").alias("group"), F.col("tokens").alias("words"))
    packed = rows.mapInArrow(partial(gm.group_counts, sizes=sizes, sep="_", drop=None), "part int, data binary")
    counts = gm.sums(packed, ["group", "term"], ["n"]).where(F.col("term").isNotNull()).withColumnRenamed("n", "count_raw")
    totals = F.broadcast(group_totals(tokenised, sizes))
    return counts.join(totals, "group").select("group", "term", "count_raw", F.coalesce(F.try_divide(F.col("count_raw") * 1000.0, "total_token_equivalents"), F.lit(0.0)).alias("normalized_per_thousand"))


def top_terms(freq: DataFrame, n: int = 1000) -> DataFrame:
    """Each group's first ``n`` by count, then by term: each task gives its own first ones, and only these meet by group."""
    freq = freq.mapInArrow(partial(gm.first_of_groups, n=n), freq.schema)
    rank = F.row_number().over(W.partitionBy("group").orderBy(F.desc("count_raw"), "term"))
    return freq.withColumn("_r", rank).where(F.col("_r") <= n).drop("_r")


def differential(freq: DataFrame, a: str, b: str, n: int = 100) -> DataFrame:
    """Terms that either of two groups has among its first ``n``: their counts and shares in both, and the difference."""
    of = lambda c, g: F.coalesce(F.sum(F.when(F.col("group") == g, F.col(c))), F.lit(0))
    freq = freq.where(F.col("group").isin(a, b))
    first = top_terms(freq, n).select("term").distinct()
    both = freq.join(F.broadcast(first), "term", "left_semi").groupBy("term").agg(of("count_raw", a).alias("_ra"), of("count_raw", b).alias("_rb"), of("normalized_per_thousand", a).alias("_na"), of("normalized_per_thousand", b).alias("_nb"))
    return both.select("term", F.col("_ra").alias(f"{a}_raw"), F.col("_rb").alias(f"{b}_raw"), F.round("_na", 4).alias(f"{a}_norm"), F.round("_nb", 4).alias(f"{b}_norm"), F.round(F.col("_na") - F.col("_nb"), 4).alias("differential_norm")).orderBy(F.desc("differential_norm"), "term")


def sentiment(df: DataFrame, key: str, tokens: Column, valence: dict[str, float] | None = None) -> DataFrame:
    """``key, score``: sum of the words' valences, brought into (-1, 1) by x / sqrt(x^2 + 15)."""
    table = F.create_map(*(F.lit(x) for kv in (valence or VALENCE).items() for x in kv))
    total = F.aggregate(F.transform(tokens, lambda t: F.coalesce(F.try_element_at(table, t), F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)
    return df.select(key, total.alias("_s")).select(key, (F.col("_s") / F.sqrt(F.col("_s") * F.col("_s") + 15.0)).alias("score"))


def sentiment_summary(scored: DataFrame) -> DataFrame:
    """``scored``: ``group, score``. One value has no spread."""
    n = F.count("score")
    out = scored.groupBy("group").agg(n.alias("count"), F.avg("score").alias("mean_score"), F.stddev_samp("score").alias("std_dev")).where("count > 0")
    out = out.withColumn("std_error", F.col("std_dev") / F.sqrt("count"))
    return out.withColumn("95ci_lower", F.col("mean_score") - 1.96 * F.col("std_error")).withColumn("95ci_upper", F.col("mean_score") + 1.96 * F.col("std_error")).orderBy("group")


def counts(values: DataFrame, column: str) -> DataFrame:
    """A list column's values and how often each stands there."""
    return values.select(F.explode(column).alias("value")).groupBy("value").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "value")


def meta_counts(enriched: DataFrame, kinds: tuple[str, ...] = ("mentions", "hashtags", "links", "domains")) -> DataFrame:
    """``group, kind, value, count`` of several list columns in one aggregate."""
    stacked = F.flatten(F.array(*(tx.tagged(F.col(k), k) for k in kinds)))
    return enriched.select("group", F.explode(stacked).alias("m")).groupBy("group", F.col("m.kind").alias("kind"), F.col("m.value").alias("value")).agg(F.count("*").alias("count")).orderBy("group", "kind", F.desc("count"), "value")


#: Two to four capitalised words in a row.
PROPER = r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3}\b"


def entities(text: Column) -> Column:
    """Named entities by a plain rule; a model can be put in as a pandas UDF."""
    return tx.words_of(text, PROPER)


def _phrases_of_repeated_keys(tokenised: DataFrame, key: str, top: int = 5, sizes: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """:func:`key_phrases` where texts share a key and count as one."""
    t = F.col("tokens")
    tf = tokenised.select(key, F.explode(F.concat(*(tx.ngrams(t, n, " ") if n > 1 else t for n in sizes))).alias("phrase")).groupBy(key, "phrase").agg(F.count("*").alias("tf"))
    df_ = tf.groupBy("phrase").agg(F.count("*").alias("df"))
    n = tokenised.agg(F.count("*").alias("n"))
    scored = tf.join(df_, "phrase").crossJoin(F.broadcast(n)).withColumn("score", F.col("tf") * (F.log((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1.0))
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc("score"), "phrase"))
    return scored.withColumn("_r", rank).where(F.col("_r") <= top).select(key, "phrase", "score")


#: N-grams that occur once in a text and are looked at first, in order of text.
FIRST_PHRASES = 40


def key_phrases(tokenised: DataFrame, key: str, top: int = 5, sizes: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Each text's n-grams with the highest tf-idf: ``key, phrase, score``. What two texts or more share is counted and written first.

    An n-gram that occurs once in a text scores highest if no other text has it, and ties go by text. So a text's repeated n-grams and the first
    few others settle most texts, and only the texts that these leave open send all their n-grams.
    """
    spark = tokenised.sparkSession
    if not tokenised.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return _phrases_of_repeated_keys(tokenised, key, top, sizes)
    kind = tokenised.schema[key].dataType.simpleString()
    none = F.array().cast("array<string>")
    rows = tokenised.select(F.col(key).alias("key"), F.coalesce("tokens", none).alias("words"), none.alias("more"), F.lit(False).alias("also"))

    def kept(df: DataFrame, label: str) -> DataFrame:
        path = shared_folder(spark, f"phrases-{label}")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    counts = rows.mapInArrow(partial(gm.document_counts, sizes=sizes, seeds=[]), "part int, data binary")
    shared = kept(gm.sums(counts, ["term"], ["n", "exact", "wide"], 2).select(F.col("term").alias("phrase"), F.col("n").alias("df")), "shared")
    total = shared.where("phrase IS NULL").agg(F.max("df")).first()[0] or 0
    shared = shared.where("phrase IS NOT NULL")
    score = lambda tf, df: tf * (F.log((1.0 + F.lit(total)) / (1.0 + df)) + 1.0)

    def scored(texts: DataFrame, single: int | None) -> DataFrame:
        p = texts.mapInArrow(partial(gm.row_phrases, sizes=sizes, single=single), f"key {kind}, phrase string, tf long, last string")
        p = p.join(shared, "phrase", "left").select("key", "phrase", "last", score(F.col("tf"), F.coalesce("df", F.lit(1))).alias("score"))
        rank = F.row_number().over(W.partitionBy("key").orderBy(F.desc("score"), "phrase"))
        return p.withColumn("_r", rank).where(F.col("_r") <= top)

    once = score(F.lit(1), F.lit(1))
    settled = F.col("last").isNull() | (F.col("score") > once) | ((F.col("score") == once) & (F.col("phrase") <= F.col("last")))
    few = kept(scored(rows, max(FIRST_PHRASES, top)).withColumn("_ok", settled), "few")
    left = few.where((F.col("_r") == top) & ~F.col("_ok")).select("key")  # with ``last`` there are ``top`` rows at least
    rest = scored(rows.join(left, rows["key"].eqNullSafe(left["key"]), "left_semi"), None)
    done = few.join(left.select(F.col("key").alias("_k")), F.col("key").eqNullSafe(F.col("_k")), "left_anti")
    return done.select("key", "phrase", "score").unionByName(rest.select("key", "phrase", "score")).withColumnRenamed("key", key)


def embedded_tweets(df: DataFrame, key: str, html: str) -> DataFrame:
    return df.select(key, F.explode(tx.tweets(F.col(html))).alias("t")).select(key, "t.*")


def export(enriched: DataFrame) -> DataFrame:
    """List columns as text joined with '; ', items of structs as JSON; the cleaned text goes."""
    out = []
    for name, kind in enriched.dtypes:
        if name in ("clean_text", "tokens"):
            continue
        if kind.startswith("array<struct"):
            out.append(F.array_join(F.transform(F.col(name), lambda x: F.to_json(x)), "; ").alias(name))
        elif kind.startswith("array"):
            out.append(F.array_join(F.col(name).cast("array<string>"), "; ").alias(name))
        else:
            out.append(F.col(name))
    return enriched.select(*out)
