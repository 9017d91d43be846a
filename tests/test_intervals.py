import random

import pytest
from pyspark.sql import functions as F

from edgeatlas.operators.evaluation import enclosing
from edgeatlas.operators.intervals import best_around

SPANS = "path string, qualified_name string, line_start int, line_end int, weight int"


def plain(points, spans, rank):
    out = {}
    for path, line in points:
        around = [s for s in spans if path is not None and line is not None and s[0] == path and s[1] is not None and s[2] <= line <= s[3]]
        if around:
            out[path, line] = min(around, key=lambda s: (*rank(s), s[1]))[1]
    return out


@pytest.mark.parametrize("width", [1, 7, 64, 4096])
def test_best_around(spark, width):
    rng = random.Random(width)
    spans = [(f"p{rng.randrange(4)}", f"s{i:04}", a := rng.randrange(300), a + rng.choice([0, 1, 5, 40, 250]), rng.randrange(9)) for i in range(400)]
    spans += [("p0", "backwards", 9, 2, 0), (None, "nowhere", 0, 9, 0), ("p0", None, 0, 9, 0), spans[0]]
    points = [(f"p{rng.randrange(5)}", rng.randrange(-3, 600)) for _ in range(500)] + [(None, 1), ("p0", None), ("p1", 4), ("p1", 4)]
    s, p = spark.createDataFrame(spans, SPANS), spark.createDataFrame(points, "path string, line int")
    got = {(r.path, r.line): r.qualified_name for r in best_around(p, s, [F.col("weight"), F.col("line_end") - F.col("line_start")], width).collect()}
    assert got == plain(points, spans, lambda s: (s[4], s[3] - s[2]))
    got = {(r.path, r.line): r.qualified_name for r in enclosing(p, s).collect()}
    assert got == plain(points, spans, lambda s: (s[3] - s[2],))
    assert best_around(p, s, [F.col("weight")], width).schema["line"].dataType == p.schema["line"].dataType


def test_no_points_or_spans(spark):
    s, p = spark.createDataFrame([], SPANS), spark.createDataFrame([("a", 1)], "path string, line int")
    assert enclosing(p, s).count() == 0
    assert enclosing(p.limit(0), spark.createDataFrame([("a", "x", 0, 9, 1)], SPANS)).count() == 0


def test_a_path_with_many_spans_and_points(spark):
    """All in one path: rows out are hits, no pairs."""
    n = 200_000
    s = spark.range(n).selectExpr("'a' as path", "concat('s', id) as qualified_name", "cast(id % 50000 as int) as line_start", "cast(id % 50000 + id % 1000 as int) as line_end")
    p = spark.range(n).selectExpr("'a' as path", "cast(id as int) as line")
    got = enclosing(p, s)
    assert got.count() == got.select("line").distinct().count()
    assert got.agg(F.max("line")).first()[0] < 51_000
