"""Text as column expressions: cleaning, tokens, n-grams, extraction. ``(?U)`` makes Java's classes follow Unicode."""

from __future__ import annotations

import re
import string

from pyspark.sql import Column
from pyspark.sql import functions as F

URL = r"https?://\S+"


def words_of(text: Column, pattern: str, group: int = 0) -> Column:
    """All matches; an empty array for null."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.array().cast("array<string>"))


def tagged(a: Column, kind: str, as_: tuple[str, str] = ("kind", "value")) -> Column:
    """Each item of an array beside a constant."""
    return F.transform(a, lambda v: F.struct(F.lit(kind).alias(as_[0]), v.alias(as_[1])))


def non_blank(a: Column) -> Column:
    return F.filter(a, lambda x: F.trim(x) != "")


def strip_accents(c: Column) -> Column:
    """Letters of Latin scripts without their marks (fixed table of precomposed letters), and no combining marks."""
    import unicodedata

    pairs = {}
    for code in range(0xC0, 0x250):
        base = "".join(x for x in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(x))
        if len(base) == 1 and base != chr(code):
            pairs[chr(code)] = base
    return F.regexp_replace(F.translate(c, "".join(pairs), "".join(pairs.values())), r"\p{M}+", "")


#: What :func:`clean_text` keeps, character by character: Java looks these up in a table, while it tries ranges one after another (some 25 times slower).
KEPT = string.ascii_letters + string.digits + r".!?,;:\-()"


def clean_text(c: Column) -> Column:
    """No links, mentions or #; letters, digits and plain punctuation of ASCII only; single spaces. Null gives ''."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), URL, "")
    t = F.regexp_replace(t, r"(?U)@\w+", "")
    return F.trim(F.regexp_replace(F.replace(t, F.lit("#"), F.lit("")), f"[^{KEPT}]+", " "))


def mentions(c: Column) -> Column:
    return words_of(c, r"(?U)@(\w+)", 1)


def hashtags(c: Column) -> Column:
    return words_of(c, r"(?U)#(\w+)", 1)


def links(c: Column) -> Column:
    return words_of(c, URL)


def domain(url: Column) -> Column:
    """What stands between :// and the path, port and user included."""
    return F.regexp_extract(url, r"^https?://([^/?#]*)", 1)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^(?i:https?)://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def is_http(url: Column) -> Column:
    return F.coalesce(url.rlike(r"^https?://"), F.lit(False))


def tokens(c: Column, stop: list[str] | None = None) -> Column:
    """Runs of a-z in lower case, without stop words."""
    t = words_of(F.lower(c), r"[a-z]+")
    return F.filter(t, lambda x: ~x.isin(stop)) if stop else t


def ngrams(toks: Column, n: int, sep: str = "_") -> Column:
    """Runs of n tokens; empty where there are fewer. Shifted copies are zipped, so the tokens aren't made anew for each run."""
    many = F.greatest(F.size(toks) - (n - 1), F.lit(0))
    out = F.slice(toks, F.lit(1), many)
    for k in range(2, n + 1):
        out = F.zip_with(out, F.slice(toks, F.lit(k), many), lambda a, b: F.concat(a, F.lit(sep), b))
    return out


def split_terms(query: str | None) -> list[str]:
    return [p.strip() for p in re.split(r"[,|\n]+", query or "") if p.strip()]


def split_terms_column(c: Column) -> Column:
    return non_blank(F.transform(F.split(F.coalesce(c, F.lit("")), r"[,|\n]+"), lambda x: F.trim(x)))


def _valid(pattern: str) -> bool:
    try:
        re.compile(pattern)
    except re.error:
        return False
    return True


def text_filter(c: Column, query: str | None, regex: bool = False, logic: str = "any", case_insensitive: bool = True, accent_insensitive: bool = True) -> Column:
    """Whether a text has any, or all, of the terms. A broken pattern counts as literal text; no term lets everything through."""
    terms = split_terms(query)
    if not terms:
        return F.lit(True)
    text = F.coalesce(c, F.lit(""))
    fold = (lambda x: strip_accents(x)) if accent_insensitive else (lambda x: x)
    text = fold(text)

    def one(term: str) -> Column:
        if regex and _valid(term):
            return text.rlike(("(?iu)" if case_insensitive else "") + term)
        needle = fold(F.lit(term))
        return F.contains(F.lower(text), F.lower(needle)) if case_insensitive else F.contains(text, needle)

    masks = [one(t) for t in terms]
    out = masks[0]
    for m in masks[1:]:
        out = (out & m) if logic.lower() == "all" else (out | m)
    return out


def strip_tags(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?s)<.*?>", ""))


def hrefs(html: Column) -> Column:
    """Values of href in <a>, with either quote."""
    return F.transform(words_of(html, r"""(?is)<a\b[^>]*?\bhref\s*=\s*("[^"]*"|'[^']*')""", 1), lambda x: F.substring(x, F.lit(2), F.length(x) - 2))


def tweets(html: Column) -> Column:
    """Embedded posts: link (the last one), id, screen name and text of each ``blockquote.twitter-tweet``."""
    quotes = words_of(html, r"""(?is)<blockquote\b[^>]*class\s*=\s*["'][^"']*twitter-tweet[^"']*["'][^>]*>.*?</blockquote>""")

    def one(q: Column) -> Column:
        found = hrefs(q)
        link = F.when(F.size(found) > 0, F.element_at(found, -1))
        parts = F.split(link, "/")
        text = F.array_join(F.transform(words_of(q, r"(?is)<p\b[^>]*>(.*?)</p>", 1), lambda p: F.regexp_replace(p, r"(?s)<.*?>", "")), "")
        return F.struct(link.alias("tweetLink"), F.element_at(parts, -1).alias("tweetId"), F.when(F.size(parts) > 3, F.element_at(parts, -3)).alias("screenName"), F.nullif(F.trim(text), F.lit("")).alias("tweetText"))

    return F.transform(quotes, one)


def tokenize_urls(c: Column) -> Column:
    """URLs of a cell, without trailing punctuation; blank-like cells have none."""
    found = words_of(c, r"""https?://[^\s,;"'<>\]\[|]+""")
    out = F.filter(F.transform(found, lambda u: F.regexp_replace(u, r"""[.,;)"'>\]}]+$""", "")), lambda u: u != "")
    return F.when(F.lower(F.trim(F.coalesce(c, F.lit("")))).isin("", "nan", "none", "null"), F.array().cast("array<string>")).otherwise(out)


def tokenize_hashtags(c: Column, strict: bool = True) -> Column:
    """Hashtags in lower case. Unless ``strict``, a list of at most 30 bare tags counts too, all or nothing."""
    found = F.transform(words_of(c, r"(?U)#[\wÀ-￿]+"), F.lower)
    if strict:
        return found
    bare = non_blank(F.transform(F.split(F.coalesce(c, F.lit("")), r"[,;\n]+"), lambda x: F.regexp_replace(F.trim(x), "^#+", "")))
    fits = (F.size(bare) > 0) & (F.size(bare) <= 30) & F.forall(bare, lambda x: x.rlike(r"(?U)^\w{2,30}$"))
    none = F.array().cast("array<string>")
    blank = F.lower(F.trim(F.coalesce(c, F.lit("")))).isin("", "nan", "none", "null", "[]")
    return F.when(blank, none).when(F.size(found) > 0, found).when(fits, F.transform(bare, lambda x: F.concat(F.lit("#"), F.lower(x)))).otherwise(none)


def slug(c: Column, most: int = 80) -> Column:
    return F.left(F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9]+", "-"), r"^-+|-+$", ""), F.lit(most))
