"""Grouping of multi-value cells."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import non_blank, tagged, words_of

COLUMNS = ("Expanded URLs", "Media URLs", "X Repost of", "X Reply to")
#: The stop words of the token counts.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves "
    "what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while "
    "of at by for with about against between through during before after above below to from up down in out on off over under again further then once here there "
    "when where why how all both each few more most other some such no nor not only own same so than too very s t can will just don should now d ll m o re ve y ain "
    "aren couldn didn doesn hadn hasn haven isn ma mightn mustn needn shan shouldn wasn weren won wouldn also would could might shall may must need get got one two like "
    "even still us much many well really right back going know think want go make see say said come take people way thing things time new good first last long great "
    "little just man made let put old big use look give help tell ask try keep work part set call every find day run end "
    "b c e f g h j k l n p q r u v w x z http https www com rt amp"
).split()


def split_counts(df: DataFrame, columns: list[str], separator: str = ", ") -> DataFrame:
    """``dimension, value, mentions``: the values of cells that hold several, over all columns in one aggregate."""
    parts = lambda c: non_blank(F.transform(F.split(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), re.escape(separator)), lambda x: F.trim(x)))
    cells = F.flatten(F.array(*(tagged(parts(c), c, ("dimension", "value")) for c in columns)))
    return df.select(F.explode(cells).alias("x")).groupBy("x.dimension", "x.value").agg(F.count("*").alias("mentions")).orderBy("dimension", F.desc("mentions"), "value")


def token_counts(df: DataFrame, text: str, stop: list[str] | None = None) -> DataFrame:
    """Words, hashtags and handles of more than one character, in lower case, without stop words."""
    t = F.transform(words_of(F.col(text), r"(?U)[a-zA-Z0-9#@][\w'@#]*"), F.lower)
    kept = F.filter(t, lambda x: (F.length(x) > 1) & ~x.isin(STOP_WORDS if stop is None else stop))
    return df.select(F.explode(kept).alias("value")).groupBy("value").agg(F.count("*").alias("mentions")).orderBy(F.desc("mentions"), "value")


def first_rows(df: DataFrame, n: int = 100_000) -> DataFrame:
    return df.limit(n)
