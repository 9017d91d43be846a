"""Symbol search, lookup by name, children and suggestions."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgeatlas.operators.graph import MAX_LIMIT, check_range
from edgeatlas.plans.envelope import ToolError, invalid

CHILDREN_SCANNED, CHILDREN_SHOWN, CANDIDATES_SHOWN = 500, 50, 50


def matches(query: str) -> Column:
    """Three characters or more: anywhere in the name or the qualified name; fewer: at the name's start. Case does not count."""
    if not query or "\0" in query:
        raise invalid("query must not be empty or hold a NUL")
    q = query.lower()
    name, qualified = F.lower("name"), F.lower("qualified_name")
    return name.contains(q) | qualified.contains(q) if len(query) >= 3 else name.startswith(q)


def search(symbols: DataFrame, query: str, kind: str | None = None, repo: str | None = None, limit: int = 25) -> DataFrame:
    """The exact name first, then the shortest qualified names; ``total`` counts the matches before the limit."""
    check_range("limit", limit, 1, MAX_LIMIT)
    found = symbols.where(matches(query))
    if kind:
        found = found.where(F.col("kind") == kind)
    if repo:
        found = found.where(F.col("repo") == repo)
    order = [(F.col("name") == query).desc(), F.length("qualified_name").asc(), F.asc("qualified_name"), F.asc("symbol_id")]
    return found.orderBy(*order).limit(limit)


def search_total(symbols: DataFrame, query: str) -> DataFrame:
    return symbols.where(matches(query)).agg(F.count("*").alias("total"))


def groups(symbols: DataFrame) -> DataFrame:
    """A symbol group is all declarations of one (repo, qualified_name, kind)."""
    return symbols.groupBy("repo", "qualified_name", "kind").agg(F.count("*").alias("n_declarations"), F.min("symbol_id").alias("first_id"))


def children(symbols: DataFrame, container: Column, per_kind: int = CHILDREN_SHOWN) -> DataFrame:
    """The first children of each kind by line. ``container`` gives the parent of a row, null for none."""
    order = Window.partitionBy("parent", "kind").orderBy("line", "qualified_name", "symbol_id")
    return symbols.withColumn("parent", container).where("parent is not null").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_kind)


def dotted_parent(c: Column) -> Column:
    return F.when(c.contains("."), F.regexp_extract(c, r"(?s)\A(.*)\.[^.]+\z", 1))


def resolve_symbol(symbols: DataFrame, name: str) -> list[int]:
    """The ids of the one group that ``name`` means: exact, else by its last parts; several are an error with candidates, none with suggestions."""
    text = name.strip().removesuffix("()")
    if not text or "\0" in text:
        raise invalid("symbol must not be empty")
    repo, _, rest = text.partition(":")
    known = rest and symbols.where(F.col("repo") == repo).limit(1).count() > 0
    pool, text = (symbols.where(F.col("repo") == repo), rest) if known else (symbols, text)
    exact = pool.where(F.col("qualified_name") == text).limit(1000).collect()
    rows = [r for r in exact if r["kind"] != "module"] or exact
    if not rows:
        ends = F.lower("qualified_name").endswith("." + text.lower()) | (F.col("name") == text)
        rows = pool.where((F.col("kind") != "module") & ends).orderBy("qualified_name", "symbol_id").limit(CANDIDATES_SHOWN + 1).collect()
    found = {(r["repo"], r["qualified_name"], r["kind"]) for r in rows}
    if len(found) == 1:
        r, q, k = next(iter(found))
        return [x["symbol_id"] for x in symbols.where((F.col("repo") == r) & (F.col("qualified_name") == q) & (F.col("kind") == k)).select("symbol_id").collect()]
    if found:
        many = f"more than {CANDIDATES_SHOWN}" if len(rows) > CANDIDATES_SHOWN else str(len(rows))
        shown = [f"{r}:{q}" for r, q, _ in sorted(found)][:CANDIDATES_SHOWN]
        raise ToolError("ambiguous_symbol", f"{many} symbols match {name!r}", "pass a qualified name, or repo:qualified.name", shown)
    raise ToolError("not_found", f"no symbol matches {name!r}", "try search_symbols", [r["qualified_name"] for r in suggest(pool, text).collect()])


def suggest(symbols: DataFrame, name: str, cutoff: float = 0.6, n: int = 5) -> DataFrame:
    """qualified_name, ratio: the names most like ``name`` of those that share its first three characters."""
    last = name.rsplit(".", 1)[-1]

    @F.pandas_udf("double")
    def ratio(names: pd.Series) -> pd.Series:
        return names.map(lambda x: difflib.SequenceMatcher(None, x or "", last).ratio())

    near = symbols.where(F.lower("name").startswith(last[:3].lower())).groupBy("name").agg(F.min("qualified_name").alias("qualified_name"))
    return near.withColumn("ratio", ratio("name")).where(F.col("ratio") >= cutoff).orderBy(F.desc("ratio"), "name").limit(n)
