"""Scores against labelled answers, calibration of rules, the regression gate, and the text-search baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeatlas.operators import intervals

TOLERANCE = 0.02
#: Edges that one task of ``golden_candidates`` is meant for.
TASK_ROWS = 500_000


def ratios(hits: Column, answered: Column, expected: Column) -> dict[str, Column]:
    """Precision, recall and F1; nothing answered and nothing expected is all right."""
    both = (answered == 0) & (expected == 0)
    p = F.when(both, 1.0).when(answered == 0, 0.0).otherwise(hits / answered)
    r = F.when(both, 1.0).when(expected == 0, 0.0).otherwise(hits / expected)
    f1 = F.when(both, 1.0).when(hits == 0, 0.0).otherwise(2.0 * hits / (answered + expected))
    return {"precision": p, "recall": r, "f1": f1}


def score(questions: DataFrame) -> DataFrame:
    """``questions``: id, tool, expected and answered (arrays). A path question is right or wrong as a whole."""
    e, a = F.array_distinct("expected"), F.array_distinct("answered")
    scores = ratios(F.size(F.array_intersect(e, a)), F.size(a), F.size(e))
    exact = (F.col("expected") == F.col("answered")).cast("double")
    return questions.select("id", "tool", *[F.when(F.col("tool") == "find_path", exact).otherwise(c).alias(k) for k, c in scores.items()])


def score_items(items: DataFrame) -> DataFrame:
    """``score`` of questions given item by item: id, tool, item, expected and answered (booleans). Items are counted, not gathered; one given twice counts once."""
    once = items.groupBy("id", "tool", "item").agg(F.bool_or(F.coalesce("expected", F.lit(False))).alias("e"), F.bool_or(F.coalesce("answered", F.lit(False))).alias("a"))
    n = once.groupBy("id", "tool").agg(F.count_if(F.col("e") & F.col("a")).alias("hits"), F.count_if("a").alias("n_a"), F.count_if("e").alias("n_e"))
    return n.select("id", "tool", *[c.alias(k) for k, c in ratios(F.col("hits"), F.col("n_a"), F.col("n_e")).items()])


def by_tool(scores: DataFrame) -> DataFrame:
    return scores.groupBy("tool").agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in ("precision", "recall", "f1")])


def calibration(hits: DataFrame, rules: DataFrame) -> DataFrame:
    """``hits``: rule, right. Observed precision beside the nominal confidence."""
    g = hits.groupBy("rule").agg(F.avg(F.col("right").cast("double")).alias("observed"), F.count("*").alias("n"))
    return g.join(F.broadcast(rules.select("rule", "nominal")), "rule").select("rule", "nominal", "observed", "n")


def regressions(now: DataFrame, baseline: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Tools whose F1 fell below the baseline by more than the tolerance; a tool no longer measured counts as zero."""
    b = baseline.select("tool", F.col("f1").alias("before"))
    return b.join(now.select("tool", "f1"), "tool", "left").select("tool", "before", F.coalesce("f1", F.lit(0.0)).alias("f1")).where(F.col("f1") < F.col("before") - tolerance)


def enclosing(points: DataFrame, spans: DataFrame, rank: list[Column] | None = None) -> DataFrame:
    """The span that ranks first around each point, by default the innermost. ``points``: path, line; ``spans``: path, qualified_name, line_start, line_end."""
    return intervals.best_around(points, spans, rank or [F.col("line_end") - F.col("line_start")])


def grep(texts: DataFrame, word: str) -> DataFrame:
    """path, line, text: lines that hold ``word`` on its own."""
    lines = texts.select("path", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    quoted = "".join(c if c.isalnum() or c == "_" else "\\" + c for c in word)
    return lines.where(F.col("text").rlike(rf"(?<![A-Za-z0-9_]){quoted}(?![A-Za-z0-9_])")).select("path", (F.col("pos") + 1).alias("line"), "text")


def golden_candidates(edges: DataFrame, low: int = 1, high: int = 15, n: int = 25) -> DataFrame:
    """Targets with a moderate number of callers, in the order of a hash. Edges may repeat.

    They are counted first and dealt over as many tasks as hold ``TASK_ROWS`` each, so that no task's tables grow with the input.
    """
    pairs = edges.select("to_name", "from_name")
    tasks = pairs.count() // TASK_ROWS + 1
    g = pairs.repartition(tasks, "to_name", "from_name").distinct().repartition(tasks, "to_name").groupBy("to_name").agg(F.count("from_name").alias("n_callers"))
    return g.where(F.col("n_callers").between(low, high)).orderBy(F.sha2("to_name", 256), "to_name").limit(n)
