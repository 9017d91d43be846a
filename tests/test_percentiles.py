import math
import random

import pytest
from pyspark.sql import functions as F

from edgeatlas.operators.percentiles import order_statistics


@pytest.mark.parametrize("few,bins", [(1, 2), (3, 16), (4096, 1024)])
def test_order_statistics(spark, few, bins):
    rng = random.Random(few)
    rows = [("ties", float(rng.randrange(3))) for _ in range(150)] + [("spread", rng.gauss(0, 1e6)) for _ in range(149)] + [("tiny", 1 + i * 2**-52) for i in range(20)]
    rows += [("one", 7.0), ("same", 5.0), ("same", 5.0), ("nulls", None), (None, 1.0), (None, 2.0), ("some", None), ("some", 3.0), ("huge", 1e308), ("huge", -1e308), ("huge", 0.0), ("ends", math.inf), ("ends", -math.inf), ("ends", 1.0), ("ends", 2.0)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(3)
    n = F.col("n")
    got = {r.g: tuple(r) for r in order_statistics(df, "g", "x", {"first": F.lit(0), "mid": F.floor(n / 2), "last": n - 1, "beyond": n + 5}, few, bins).collect()}
    want = {}
    for g in {g for g, _ in rows}:
        v = sorted(x for k, x in rows if k == g and x is not None)
        if v:
            want[g] = (g, len(v), v[0], v[len(v) // 2], v[-1], v[-1])
    assert got == want


def test_no_values(spark):
    assert order_statistics(spark.createDataFrame([], "g string, x double"), "g", "x", {"first": F.lit(0)}).count() == 0
