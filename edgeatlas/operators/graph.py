"""Bounded traversal, shortest paths and edge explanation, for a batch of start symbols at once.

``edges`` has from_id, to_id, from_name, to_name, kind, rule, confidence, path, line. Every query of a batch carries its ``query_id``
through the frontier, so a level is one join whatever the number of starts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgeatlas.plans.envelope import invalid
from edgeatlas.schemas import RULES, TRAVERSED
from edgeatlas.session import cut

MAX_LIMIT, MAX_DEPTH, MAX_PATH = 200, 3, 10


def check_range(name: str, value: float, low: float, high: float) -> None:
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not low <= value <= high:
        raise invalid(f"{name} must be between {low} and {high} (got {value})")


def followed(edges: DataFrame, min_confidence: float, kinds: tuple[str, ...] = TRAVERSED) -> DataFrame:
    return edges.where(F.col("kind").isin(*kinds) & (F.col("confidence") >= min_confidence))


def levels(edges: DataFrame, starts: DataFrame, depth: int, reverse: bool) -> list[DataFrame]:
    """The edges met at each level: every edge of the frontier, also those to symbols already seen; only unseen ones go on.

    ``starts`` has query_id and id, and may hold several ids (a symbol's declarations) per query.
    """
    near, far = ("to_id", "from_id") if reverse else ("from_id", "to_id")
    frontier = seen = starts.select("query_id", "id").distinct()
    out = []
    for level in range(1, depth + 1):
        met = edges.join(frontier.withColumnRenamed("id", near), near).withColumn("depth", F.lit(level))
        if level < depth:
            met = cut(met, "level")
            reached = met.select("query_id", F.col(far).alias("id")).distinct()
            frontier = cut(reached.join(seen, ["query_id", "id"], "left_anti"), "frontier")
            seen = seen.unionByName(frontier)
        out.append(met)
    return out


def order() -> list:
    return [F.asc("depth"), F.desc("confidence"), F.asc("path"), F.asc("line"), F.asc("from_id"), F.asc("to_id"), F.asc("rule")]


def traverse(edges: DataFrame, starts: DataFrame, depth: int = 1, min_confidence: float = 0.5, limit: int | None = 25, reverse: bool = True) -> DataFrame:
    """Callers (``reverse``) or callees of each start, in order of level, confidence, path, line; ``limit`` counts after all levels, per query."""
    check_range("depth", depth, 1, MAX_DEPTH)
    check_range("min_confidence", min_confidence, 0, 1)
    if limit is not None:
        check_range("limit", limit, 1, MAX_LIMIT)
    e = followed(edges, min_confidence)
    e = cut(e, "edges") if depth > 1 else e  # read once a level
    met = reduce(DataFrame.unionByName, levels(e, starts, depth, reverse))
    more = [c for c in ("repo", "candidates") if c in edges.columns]
    met = met.select("query_id", "depth", "from_name", "to_name", "from_id", "to_id", "kind", "rule", "confidence", "path", "line", *more)
    if limit is not None:
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order()))
        met = met.withColumn("rank", rank).where(F.col("rank") <= limit).drop("rank")
    return met


def hidden(edges: DataFrame, starts: DataFrame, min_confidence: float = 0.5, reverse: bool = True) -> DataFrame:
    """query_id, n_hidden, rules, max_confidence, suggested: first-level edges under the threshold; suggested is the least one's confidence cut to a tenth."""
    near = "to_id" if reverse else "from_id"
    low = edges.where(F.col("kind").isin(*TRAVERSED) & (F.col("confidence") < min_confidence)).join(starts.select("query_id", F.col("id").alias(near)), near)
    return low.groupBy("query_id").agg(
        F.count("*").alias("n_hidden"),
        F.array_join(F.sort_array(F.collect_set("rule")), ",").alias("rules"),
        F.max("confidence").alias("max_confidence"),
        (F.floor(F.min("confidence") * 10 + 1e-9) / 10).alias("suggested"),
    )


def shortest_paths(edges: DataFrame, pairs: DataFrame, max_depth: int = 6, min_confidence: float = 0.5) -> DataFrame:
    """query_id, step, symbol_id, name, via_kind, via_rule, via_confidence, via_path, via_line: one row per step of each path found.

    ``pairs`` has query_id, from_id, to_id (several of each for a symbol's declarations). A start among the goals is one step without a
    way in. A symbol's way in is the edge of the level before with the highest confidence, then path, line, from; the goal reached is
    the lowest id of those on the first level that has one.
    """
    check_range("max_depth", max_depth, 1, MAX_PATH)
    check_range("min_confidence", min_confidence, 0, 1)
    e = cut(followed(edges, min_confidence), "edges")  # read once a level
    goals = pairs.select("query_id", F.col("to_id").alias("id")).distinct()
    start = pairs.select("query_id", F.col("from_id").alias("id")).distinct()
    none = "cast(null as {})"
    found = [start.selectExpr("query_id", "id", "0 as level", none.format("bigint") + " as parent", none.format("string") + " as name", none.format("string") + " as kind", none.format("string") + " as rule", none.format("double") + " as confidence", none.format("string") + " as path", none.format("int") + " as line")]
    seen, frontier = start, start
    done = cut(start.join(goals, ["query_id", "id"], "left_semi").groupBy("query_id").agg(F.min("id").alias("goal")).withColumn("level", F.lit(0)), "goals")
    way_in = Window.partitionBy("query_id", "to_id").orderBy(F.desc("confidence"), "path", "line", "from_id", "kind", "rule")
    for level in range(1, max_depth + 1):
        frontier = frontier.join(done.select("query_id"), "query_id", "left_anti")
        met = e.join(frontier.withColumnRenamed("id", "from_id"), "from_id").join(seen.withColumnRenamed("id", "to_id"), ["query_id", "to_id"], "left_anti")
        met = met.withColumn("n", F.row_number().over(way_in)).where("n = 1")
        met = cut(met.select("query_id", F.col("to_id").alias("id"), F.lit(level).alias("level"), F.col("from_id").alias("parent"), F.col("to_name").alias("name"), "kind", "rule", "confidence", "path", "line"), "reached")
        found.append(met)
        frontier = met.select("query_id", "id")
        seen = seen.unionByName(frontier)
        hit = frontier.join(goals, ["query_id", "id"], "left_semi").groupBy("query_id").agg(F.min("id").alias("goal")).withColumn("level", F.lit(level))
        done = cut(done.unionByName(hit), "goals")
        if frontier.isEmpty():
            break
    tree = reduce(DataFrame.unionByName, found)
    at = done.select("query_id", F.col("goal").alias("id"), "level")
    steps = []
    for _ in range(max_depth + 1):  # back from the goal, one level a round
        step = cut(at.join(tree.drop("level"), ["query_id", "id"]), "steps")
        if step.isEmpty():
            break
        steps.append(step)
        at = step.where("level > 0").select("query_id", F.col("parent").alias("id"), (F.col("level") - 1).alias("level"))
    out = reduce(DataFrame.unionByName, steps) if steps else done.join(tree.drop("level"), "query_id").limit(0)
    return out.select("query_id", F.col("level").alias("step"), F.col("id").alias("symbol_id"), "name", F.col("kind").alias("via_kind"), F.col("rule").alias("via_rule"), F.col("confidence").alias("via_confidence"), F.col("path").alias("via_path"), F.col("line").alias("via_line"))


def rule_table(spark) -> DataFrame:
    return spark.createDataFrame([(k, c, m) for k, (c, m) in RULES.items()], "rule string, nominal double, meaning string")


def explain(edges: DataFrame, from_ids: list[int], to_ids: list[int]) -> DataFrame:
    """All edges of any kind between two symbols, each with its rule's meaning, by line."""
    rules = F.broadcast(rule_table(edges.sparkSession))  # ten rows
    e = edges.where(F.col("from_id").isin(*from_ids) & F.col("to_id").isin(*to_ids))
    return e.join(rules, "rule").select("from_name", "to_name", "kind", "rule", "confidence", "meaning", "path", "line").orderBy("line", "rule")
