"""Which column plays which role: by names, and where needed by one aggregate over the candidates."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DATETIME = re.compile(r"(date|time|created|posted|published|timestamp|\bts\b|_at$)", re.I)
TEXT_NAMES = ("text", "content", "body", "message", "full_text", "post_text")


def _plain(name: str) -> str:
    return re.sub(r"[\s_-]+", "", name.lower())


def named(columns: list[str], wanted: str) -> str | None:
    """A column by its name: exact, or else whatever its case."""
    return wanted if wanted in columns else next((c for c in columns if c.lower() == wanted.lower()), None)


def filled(df: DataFrame, columns: list[str]) -> dict[str, int]:
    """Values that aren't null or blank, of all candidates in one pass."""
    if not columns:
        return {}
    row = df.agg(*(F.count(F.nullif(F.trim(F.col(f"`{c}`").cast("string")), F.lit(""))).alias(f"c{i}") for i, c in enumerate(columns))).first()
    return dict(zip(columns, row, strict=True))


def datetime_column(df: DataFrame) -> str | None:
    """The column with most parsable times: among those with a name for it, else among all; else the first."""
    from ..operators.temporal import FORMATS, MONTH_FIRST

    def best(columns: list[str]) -> str | None:
        if not columns:
            return None
        parse = lambda c: F.coalesce(*(F.try_to_timestamp(F.col(f"`{c}`").cast("string"), F.lit(f)) for f in FORMATS + MONTH_FIRST))
        n = df.agg(*(F.count(parse(c)) for c in columns)).first()
        top = max(range(len(columns)), key=lambda i: (n[i], -i))
        return columns[top] if n[top] else None

    return best([c for c in df.columns if DATETIME.search(c)]) or best(df.columns) or (df.columns[0] if df.columns else None)


def generic_column(df: DataFrame, requested: str | None, preferred: list[str], pattern: str) -> str | None:
    """The requested column, else a preferred name, else a name that matches; the latter two must hold something."""
    if requested and requested in df.columns:
        return requested
    liked = [c for p in preferred for c in df.columns if _plain(c) == _plain(p)]
    matching = [c for c in df.columns if re.search(pattern, c, re.I)]
    n = filled(df, list(dict.fromkeys(liked + matching)))
    return next((c for c in [*liked, *matching] if n[c]), None)


def text_column(df: DataFrame, requested: str | None = None) -> str | None:
    if requested and requested in df.columns:
        return requested
    return next((c for n in TEXT_NAMES for c in df.columns if c.lower() == n), None) or first_string(df)


def first_string(df: DataFrame, hint: str | None = None) -> str | None:
    if hint and hint in df.columns:
        return hint
    return next((c for c, t in df.dtypes if t == "string"), df.columns[0] if df.columns else None)


def preferred_column(columns: list[str], requested: str | None, names: tuple[str, ...]) -> str | None:
    for n in ([requested] if requested else []) + list(names):
        if c := named(columns, n):
            return c
    return columns[0] if columns else None
