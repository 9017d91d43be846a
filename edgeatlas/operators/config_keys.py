"""Configuration keys: search by normalised pattern, definitions and reads grouped."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgeatlas.functions.names import like_escape, normal_key

SHOWN = 50


def like_pattern(pattern: str) -> str:
    """``*`` is any text; a pattern without a percent sign is looked for anywhere, one that has a literal one is not."""
    like = like_escape(normal_key(pattern)).replace("*", "%")
    return like if "%" in like else f"%{like}%"


def find(keys: DataFrame, pattern: str, limit: int | None = 25) -> DataFrame:
    """key_norm, definitions, reads, n_definitions, n_reads; the first ``limit`` keys, or all without one. ``keys`` has key_norm, origin, repo, path, line."""
    found = keys.where(F.like("key_norm", F.lit(like_pattern(pattern)), F.lit("\\"))).withColumn("is_read", F.col("origin") == "code-read")
    g = found.groupBy("key_norm").agg(F.count_if(~F.col("is_read")).alias("n_definitions"), F.count_if("is_read").alias("n_reads"))
    g = g if limit is None else g.orderBy("key_norm").limit(limit)
    # a key's first places: every task keeps so many at most before they meet
    place = F.row_number().over(Window.partitionBy("key_norm", "is_read").orderBy("repo", "path", "line", "origin"))
    row = F.struct("repo", "path", "line", "origin")
    of = lambda c: F.sort_array(F.collect_list(F.when(c, row)))
    first = found.withColumn("place", place).where(F.col("place") <= SHOWN).groupBy("key_norm").agg(of(~F.col("is_read")).alias("definitions"), of(F.col("is_read")).alias("reads"))
    return g.join(first, "key_norm").select("key_norm", "definitions", "reads", "n_definitions", "n_reads")
