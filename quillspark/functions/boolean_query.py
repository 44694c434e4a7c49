"""Boolean keyword expressions as one filter column: AND, OR, NOT, parentheses, "phrases" and prefix*.

NOT binds tighter than AND, AND tighter than OR. What doesn't parse, like terms without an operator between
them, is a list of keywords separated by commas, of which any may occur.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r'\s*(?:(?P<phrase>"[^"]*")|(?P<paren>[()])|(?P<prefix>\w+\*)|(?P<word>\w+))')


class _Broken(ValueError):
    pass


def looks_boolean(expression: str) -> bool:
    upper = expression.upper()
    return any(k in f" {upper}" for k in (" AND ", " OR ", " NOT ", "(", ")")) or '"' in expression or bool(re.search(r"\w\*", expression))


def _lexed(expression: str) -> list[tuple[str, str]]:
    out, at, text = [], 0, expression.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise _Broken(text[at:])
        kind = m.lastgroup
        value = m[kind]
        if kind == "word" and value.upper() in ("AND", "OR", "NOT"):
            kind, value = "operator", value.upper()
        out.append((kind, value))
        at = m.end()
        while at < len(text) and text[at].isspace():
            at += 1
    return out


def parse(expression: str):
    """Nested tuples: ('OR' | 'AND', [...]), ('NOT', x), ('term', text)."""
    tokens = _lexed(expression)
    at = 0

    def peek() -> tuple[str, str]:
        return tokens[at] if at < len(tokens) else ("end", "")

    def chain(operator: str, part):
        nonlocal at
        parts = [part()]
        while peek() == ("operator", operator):
            at += 1
            parts.append(part())
        return parts[0] if len(parts) == 1 else (operator, parts)

    def negated():
        nonlocal at
        if peek() == ("operator", "NOT"):
            at += 1
            return ("NOT", negated())
        kind, value = peek()
        if kind == "paren" and value == "(":
            at += 1
            inner = chain("OR", conjunction)
            if peek() != ("paren", ")"):
                raise _Broken("missing )")
            at += 1
            return inner
        if kind in ("phrase", "prefix", "word"):
            at += 1
            return ("term", value[1:-1] if kind == "phrase" else value)
        raise _Broken(value)

    def conjunction():
        return chain("AND", negated)

    out = chain("OR", conjunction)
    if at < len(tokens):
        raise _Broken(str(tokens[at:]))
    return out


def _word(text: Column, term: str) -> Column:
    return text.rlike(r"(?iU)\b" + re.escape(term) + r"\b")


def _column(node, text: Column) -> Column:
    kind, value = node
    if kind == "NOT":
        return ~_column(value, text)
    if kind in ("AND", "OR"):
        out = _column(value[0], text)
        for x in value[1:]:
            out = (out & _column(x, text)) if kind == "AND" else (out | _column(x, text))
        return out
    if value.endswith("*"):
        return text.rlike(r"(?iU)\b" + re.escape(value[:-1]))
    return F.contains(F.lower(text), F.lit(value.lower())) if " " in value else _word(text, value)


def boolean_filter(text: Column, expression: str) -> Column:
    """Whether a text meets the expression; an empty one lets everything through."""
    expression = expression.strip()
    text = F.coalesce(text, F.lit(""))
    if not expression:
        return F.lit(True)
    if looks_boolean(expression):
        try:
            return _column(parse(expression), text)
        except _Broken:
            pass
    out = F.lit(False)
    for keyword in (k.strip().lower() for k in expression.split(",")):
        if keyword:
            out = out | _word(text, keyword)
    return out
