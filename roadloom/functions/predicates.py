"""Filters given as data or text, as Spark columns."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_, eq, ge, gt, le, lt, ne, or_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Term = tuple[str, str, Any]
_OPS = {"==": eq, "=": eq, "!=": ne, ">": gt, ">=": ge, "<": lt, "<=": le}


def term(name: str, op: str, value: Any) -> Column:
    """One comparison; a None value means IS [NOT] NULL, an empty list is in nothing."""
    op = " ".join(op.lower().split())
    c = F.col(name)
    if op in ("in", "not in"):
        found = c.isin(list(value))
        return found if op == "in" else ~found
    if value is None and op in ("==", "=", "!="):
        return c.isNull() if op != "!=" else c.isNotNull()
    if op not in _OPS:
        raise ValueError(f"unknown operator {op!r}")
    return _OPS[op](c, F.lit(value))


def dnf(filters: Sequence[Any]) -> Column:
    """Disjunctive normal form: the outer list is OR, an inner list AND, a flat list of terms one AND."""
    if not filters:
        return F.lit(True)
    groups = [filters] if isinstance(filters[0], tuple) or isinstance(filters[0][0], str) else filters
    return reduce(or_, [reduce(and_, [term(*t) for t in g]) for g in groups])


def renamed(filters: Sequence[Any], names: Mapping[str, str]) -> list[Any]:
    """The filter tree with its columns renamed."""
    if isinstance(filters, tuple):
        return (names.get(filters[0], filters[0]), *filters[1:])
    if len(filters) == 3 and isinstance(filters[0], str):
        return [names.get(filters[0], filters[0]), *filters[1:]]
    return [renamed(f, names) for f in filters]


_TOKEN = re.compile(r"""\s*('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|`[^`]+`|\d+(?:\.\d+)?(?:[eE][-+]?\d+)?|[A-Za-z_][\w.]*|==|!=|>=|<=|[<>()\[\],&|~+*/%-])""")


def frame_expression(text: str) -> str:
    """A data-frame query text as Spark SQL: & | ~, ==, None, in / not in, .isnull() .notnull() .isin() and
    .str.contains / startswith / endswith; quoted texts and back-quoted names are kept whole."""
    tokens, at = [], 0
    text = text.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"can't read {text[at:]!r}")
        tokens.append(m[1])
        at = m.end()
    out: list[str] = []

    def literal(t: str) -> str:
        return "'" + t[1:-1].replace("\\" + t[0], t[0]).replace("\\", "\\\\").replace("'", "\\'") + "'"

    i = 0
    while i < len(tokens):
        t = tokens[i]
        if t[0] in "'\"":
            out.append(literal(t))
        elif t in ("&", "|", "~"):
            out.append({"&": "AND", "|": "OR", "~": "NOT"}[t])
        elif t in ("==", "!=") and i + 1 < len(tokens) and tokens[i + 1] in ("None", "nan"):
            out.append("IS NULL" if t == "==" else "IS NOT NULL")
            i += 1
        elif t == "==":
            out.append("=")
        elif t in ("True", "False", "None"):
            out.append({"True": "TRUE", "False": "FALSE", "None": "NULL"}[t])
        elif t in ("and", "or", "not", "in"):
            out.append(t.upper())
        elif t in ("[", "]"):
            out.append("(" if t == "[" else ")")
        elif m := re.fullmatch(r"(.*)\.(isnull|isna|notnull|notna|isin|str\.contains|str\.startswith|str\.endswith)", t):
            name, call = m.groups()
            name = name or out.pop()
            if call in ("isnull", "isna", "notnull", "notna"):
                out.append(f"{name} IS {'' if call.startswith('is') else 'NOT '}NULL")
                i += 2
            elif call == "isin":
                out.append(f"{name} IN")
                if tokens[i + 2] == "[":  # isin([..]): one pair of parentheses
                    close = tokens.index("]", i)
                    out.append("(" + " ".join(literal(x) if x[0] in "'\"" else x for x in tokens[i + 3 : close]) + ")")
                    i = close + 1
            else:
                arg = literal(tokens[i + 2])
                out.append(f"{ {'str.contains': 'contains', 'str.startswith': 'startswith', 'str.endswith': 'endswith'}[call]}({name}, {arg})")
                i += 3
        else:
            out.append(t)
        i += 1
    return " ".join(out)


def both(static: Column | str | None, call: Column | str | None) -> Column:
    """A dataset's own filter and a call's filter, each as a whole."""
    return reduce(and_, [F.expr(f) if isinstance(f, str) else f for f in (static, call) if f is not None], F.lit(True))


def in_window(minute: Column, start: int, end: int) -> Column:
    """Minutes of the day in [start, end), going on after midnight where end exceeds 1440."""
    if end < 1440:
        return (minute >= start) & (minute < end)
    return ((minute >= start) & (minute < 1440)) | ((minute >= 0) & (minute < end - 1440))


def members(df: DataFrame, keys: DataFrame, on: str | Sequence[str], inside: bool = True) -> DataFrame:
    """Rows whose key is (not) among the keys; Spark picks the join by size."""
    return df.join(keys.select(*([on] if isinstance(on, str) else on)), on, "left_semi" if inside else "left_anti")
