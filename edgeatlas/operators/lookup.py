"""Symbols by qualified name, seen from a repository."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup(wanted: DataFrame, symbols: DataFrame, keys: list[str], kinds: tuple[str, ...] = ()) -> DataFrame:
    """The keys, to_symbol_id and to_file: the first symbol of that name in the repository, else the only one there is anywhere.

    ``wanted``: keys, qualified, repo, lang; ``symbols``: symbol_id, file_id, qualified_name, repo, lang, kind. Ids order symbols. Both
    joins have one row at most on the symbols' side, so a name that every repository declares costs a row for each reference.
    """
    s = symbols.where(F.col("kind").isin(*kinds)) if kinds else symbols
    per = s.groupBy("repo", "lang", F.col("qualified_name").alias("qualified")).agg(F.min(F.struct("symbol_id", "file_id")).alias("own"), F.count("*").alias("n"))
    single = per.groupBy("lang", "qualified").agg(F.min("own").alias("only"), F.sum("n").alias("n")).where("n = 1").select("lang", "qualified", "only")
    j = wanted.join(per.drop("n"), ["repo", "lang", "qualified"], "left").join(single, ["lang", "qualified"], "left")
    hit = F.coalesce("own", "only")
    return j.where(hit.isNotNull()).select(*keys, hit["symbol_id"].alias("to_symbol_id"), hit["file_id"].alias("to_file"))
