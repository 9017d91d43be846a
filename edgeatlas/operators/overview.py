"""Repository roll-ups: languages, modules, fan-in, status counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeatlas.schemas import TRAVERSED


def languages(files: DataFrame) -> DataFrame:
    return files.groupBy("repo", "lang").agg(F.count("*").alias("n_files"), F.sum("loc").alias("loc"))


def top_modules(symbols: DataFrame, repo: str, n: int = 10) -> DataFrame:
    found = symbols.where((F.col("repo") == repo) & (F.col("module") != "")).groupBy("module").agg(F.count("*").alias("n_symbols"))
    return found.orderBy(F.desc("n_symbols"), "module").limit(n)


def hotspots(edges: DataFrame, targets: DataFrame, min_confidence: float = 0.5, n: int = 10) -> DataFrame:
    """The symbols of ``targets`` (symbol_id) with most distinct callers, from anywhere."""
    e = edges.where(F.col("kind").isin(*TRAVERSED) & (F.col("confidence") >= min_confidence)).select("from_id", "to_id")
    fan = e.join(targets.select(F.col("symbol_id").alias("to_id")), "to_id", "left_semi").groupBy("to_id").agg(F.countDistinct("from_id").alias("n_callers"))
    return fan.orderBy(F.desc("n_callers"), "to_id").limit(n)


def per_repo(repos: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """repo, n_files, n_symbols; repositories without files keep zeros."""
    f = files.groupBy("repo").agg(F.count("*").alias("n_files"))
    s = symbols.groupBy("repo").agg(F.count("*").alias("n_symbols"))
    out = repos.select("repo").join(f, "repo", "left").join(s, "repo", "left")
    return out.select("repo", F.coalesce("n_files", F.lit(0)).alias("n_files"), F.coalesce("n_symbols", F.lit(0)).alias("n_symbols"))


def resolved_ratio(refs: DataFrame, edges: DataFrame) -> DataFrame:
    """n_refs, n_resolved, n_edges, ratio: of references other than imports; no references give 1."""
    r = refs.where("kind <> 'import'").select("ref_id")
    hit = edges.select("ref_id").distinct().join(r, "ref_id", "left_semi").agg(F.count("*").alias("n_resolved"))
    out = r.agg(F.count("*").alias("n_refs")).crossJoin(hit).crossJoin(edges.agg(F.count("*").alias("n_edges")))  # one row each
    return out.withColumn("ratio", F.when(F.col("n_refs") == 0, 1.0).otherwise(F.bround(F.col("n_resolved") / F.col("n_refs"), 4)))


def unresolved(refs: DataFrame, edges: DataFrame) -> DataFrame:
    return refs.join(edges.select("ref_id"), "ref_id", "left_anti")
