"""Where queries and their SQL twins are registered."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: named SQL pieces; a twin pulls in the ones it mentions, in order of definition
VIEWS: dict[str, str] = {}


#: Exact decimal halves would round by the last bit of a sum, which depends on its order. Both
#: sides of a comparison shift by this much first; in SQL, rnd(x, n) stands for it.
NUDGE = 3e-8


def rnd(c: Column | str, n: int = 4) -> Column:
    return F.round(F.lit(NUDGE) + (F.col(c) if isinstance(c, str) else c), n)


def query(name: str, oracle: str | None = None):
    """Register a query; `oracle` is its SQL, written over VIEWS and the driver's tables."""
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = with_views(oracle).replace("rnd(", f"round({NUDGE!r} + ")
        return fn
    return deco


def view(name: str, body: str) -> None:
    VIEWS[name] = body.strip()


def with_views(body: str) -> str:
    """Prefix `body` with the WITH list of every view it uses, directly or not."""
    words = re.compile(r"[A-Za-z_][A-Za-z_0-9]*")
    need: set[str] = set()
    todo = [body]
    while todo:
        for word in set(words.findall(todo.pop())):
            if word in VIEWS and word not in need:
                need.add(word)
                todo.append(VIEWS[word])
    if not need:
        body = body.strip()
        return "WITH RECURSIVE " + body[5:] if body.upper().startswith("WITH ") and "RECURSIVE" not in body[:20] else body
    parts = []
    for name, text in VIEWS.items():
        if name in need:
            recursive = name in words.findall(text)
            parts.append(f"{name} AS {'' if recursive else 'MATERIALIZED '}({text})")
    body = body.strip()
    glue = "\n"
    if body.upper().startswith("WITH "):  # the twin brings its own WITH list: continue ours
        body, glue = body[5:], ",\n"
    return "WITH RECURSIVE " + ",\n".join(parts) + glue + body


def values_sql(columns: list[str], rows: list[tuple], casts: dict[str, str] | None = None) -> str:
    """SELECT over literal rows with cast columns, for policy tables in the SQL twins."""
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return "TRUE" if v else "FALSE"
        if isinstance(v, (int, float)):
            return repr(v)
        if isinstance(v, (list, tuple)):
            return "[" + ", ".join(lit(x) for x in v) + "]"
        return "'" + str(v).replace("'", "''") + "'"

    casts = casts or {}
    sel = ", ".join(f"CAST({c} AS {casts[c]}) AS {c}" if c in casts else c for c in columns)
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"SELECT {sel} FROM (VALUES {body}) t({', '.join(columns)})"
