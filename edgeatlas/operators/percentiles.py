"""Exact order statistics of groups of any size, by narrowing an interval around each rank.

A pass counts the values of an interval in ``BINS`` bins of equal width, with each bin's least and greatest value; the bin that holds the
rank is the next interval. Counts are combined before they are shuffled, so a group costs a task its bins and not its rows. An interval of
at most ``FEW`` values, or of one value however often, is settled: only the former's values are ordered, in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgeatlas.session import cut, drop

BINS, FEW = 1024, 4096


def order_statistics(values: DataFrame, group: str, value: str, ranks: dict[str, Column], few: int = FEW, bins: int = BINS) -> DataFrame:
    """group, n (values that are not null) and a column for each of ``ranks``: the value with that rank (from 0) of its group.

    Ranks are expressions of ``n``, held between 0 and n - 1. Nulls count for nothing, a group of nulls alone is not in the result; a null group
    is a group. NaN counts as infinity; infinite values are ordered as such.
    """
    spark = values.sparkSession
    v = values.select(F.col(group).alias("g"), F.col(value).cast("double").alias("v")).where("v is not null")
    v = v.select("g", F.when(F.isnan("v"), F.lit(float("inf"))).otherwise(F.col("v")).alias("v"))
    total = v.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.greatest(F.lit(0), F.least(rank, F.col("n") - 1)).cast("long").alias("rank")) for name, rank in ranks.items()]))
    at = cut(total.select("g", "n", "lo", "hi", wanted.alias("w")).select("g", "n", "w.name", "w.rank", "lo", "hi", F.col("n").alias("inside")), "ranks")
    made, settled = [at], []
    while True:
        open_ = (F.col("inside") > few) & (F.col("lo") < F.col("hi"))
        settled.append(at.where(~open_))
        at = at.where(open_)
        if at.isEmpty():
            break
        far = 1.7e308  # infinite ends are binned as the farthest finite ones
        low, high = F.greatest(F.col("lo"), F.lit(-far)), F.least(F.col("hi"), F.lit(far))
        width = high / bins - low / bins
        place = F.when(F.col("v") >= F.col("hi"), bins - 1).otherwise(F.greatest(F.lit(0), F.least(F.lit(bins - 2), F.floor((F.greatest(F.col("v"), F.lit(-far)) / width - low / width)).cast("int"))))
        met = v.join(at, v["g"].eqNullSafe(at["g"])).where((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi"))).select(at["g"], "n", "name", "rank", place.alias("bin"), "v")
        counted = met.groupBy("g", "n", "name", "rank", "bin").agg(F.count("*").alias("inside"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        upto = F.sum("inside").over(Window.partitionBy("g", "name").orderBy("bin"))  # at most ``bins`` rows
        at = counted.withColumn("upto", upto).where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("inside")))
        at = cut(at.select("g", "n", "name", (F.col("rank") - F.col("upto") + F.col("inside")).alias("rank"), "lo", "hi", "inside"), "ranks")
        made.append(at)
    done = settled[0]
    for s in settled[1:]:
        done = done.unionByName(s)
    one = done.where("lo = hi").select("g", "n", "name", F.col("lo").alias("v"))
    left = done.where("lo < hi")
    few_ = v.join(left, v["g"].eqNullSafe(left["g"])).where((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi"))).groupBy(left["g"], "n", "name", "rank").agg(F.sort_array(F.collect_list("v")).alias("vs"))
    found = one.unionByName(few_.select("g", "n", "name", F.get("vs", F.col("rank").cast("int")).alias("v")))
    out = cut(found.groupBy(F.col("g").alias(group), "n").agg(*[F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in ranks]), "statistics")
    drop(spark, *made)
    return out
