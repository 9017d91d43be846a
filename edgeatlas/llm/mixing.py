"""Mixing sources to target weights.

Words are counted per source, a water level turns weights into targets (no source beyond ``cap`` times its size), and each
document is taken floor(rate) times plus one copy decided by a seeded hash with the rate's fraction as probability.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgeatlas.llm.session import cut, free

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
SHARE, CAP, SEED = 1.5, 2.0, 17
#: Most sources whose table is broadcast.
BROADCAST_ROWS = 10_000


def size_of(text: Column) -> Column:
    """Number of words of a text; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, source: str = "source", size: str = "size", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size, weight, target) by source; ``sizes`` has a row per document.

    Sources rank by code point, null last, and take the weights in turn. A source is capped where cap * size / weight lies
    under the water level; taking sources by that ratio, the first prefix whose level lies below the next ratio is it. The
    windows here run over one row per source, after the aggregation.
    """
    per = sizes.groupBy(F.col(source).alias("source")).agg(F.sum(size).cast("long").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("ceiling", F.col("source_size") * F.lit(cap))
    order = Window.orderBy(F.col("ceiling") / F.col("weight"), F.col("source").asc_nulls_last())
    every = Window.partitionBy(F.lit(1))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumns({
        "at": F.row_number().over(order),
        "ratio": F.col("ceiling") / F.col("weight"),
        "level": (F.sum("source_size").over(every) * F.lit(share) - F.coalesce(F.sum("ceiling").over(before), F.lit(0.0)))
        / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))),
    })
    water = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("at", "level"))).over(every)["level"]
    target = F.least(F.col("ceiling"), F.coalesce(water, F.col("ratio")) * F.col("weight"))
    return per.select("source", "source_size", "weight", target.alias("target"))


def copies(keys: list[Column], rate: Column, seed: int = SEED) -> Column:
    """floor(rate) plus a Bernoulli copy: the keys' hash, as a number in [0, 1), lies below the fraction."""
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11) / F.lit(float(1 << 53))
    whole = F.floor(rate)
    return (whole + F.when(draw < rate - whole, 1).otherwise(0)).cast("int")


def mix_plan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", name: str = "__mix", **kw) -> DataFrame:
    """Every row with size, source_size, target and n_copies in a struct column ``name``.

    Null texts have size 0; a null source is a source; rows with one doc_id share their draw; a source without words gets
    rate 0; an empty table gives an empty result. Columns of any other name pass through untouched. The sources' table is
    worked on in one task: it has a row per source, some 100 bytes each.
    """
    seed = kw.pop("seed", SEED)
    size, own, total, goal = free(docs, "__size", "__source", "__source_size", "__target")
    sized = docs.withColumn(size, size_of(F.col(text)))
    per = source_targets(sized.select(F.col(source).alias("source"), F.col(size).alias("size")), **kw)
    per = cut(per.select(F.col("source").alias(own), F.col("source_size").alias(total), F.col("target").alias(goal)), "sources")
    # one row per source; with very many sources the join is dealt by source instead, where adaptive execution splits hot ones
    per = F.broadcast(per) if per.count() <= BROADCAST_ROWS else per
    out = sized.join(per, sized[source].eqNullSafe(F.col(own)), "left")
    rate = F.when(F.col(total) > 0, F.col(goal) / F.col(total)).otherwise(0.0)
    n = copies([F.col(doc_id)], rate, seed)
    mixed = F.struct(F.col(size).alias("size"), F.col(total).alias("source_size"), F.col(goal).alias("target"), n.alias("n_copies"))
    return out.select(*[docs[c] for c in docs.columns], mixed.alias(name))


def mix_sources(docs: DataFrame, **kw) -> DataFrame:
    """The mixture itself: the input's columns, each document as often as it is taken."""
    mix, copy = free(docs, "__mix", "__copy")
    plan = mix_plan(docs, name=mix, **kw).where(F.col(mix)["n_copies"] > 0)
    return plan.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(mix)["n_copies"]))).select(*docs.columns)


def op2_source_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    m = F.col("__mix")
    return mix_plan(docs).select("doc_id", m.size.alias("size"), m.source_size.alias("source_size"), m.target.alias("target"), (m.size * m.n_copies).cast("long").alias("taken"), m.n_copies.alias("n_copies"))


def mixing_targets(spark, sf_dir: str) -> DataFrame:
    """The part of ``op2_source_mixing`` that SQL can say: sizes, and each source's target."""
    return op2_source_mixing(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 3).alias("target"))


#: The water level lies above the highest ratio of ceiling to weight at which all sources together still hold no more than the share.
TARGETS_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(SUM(size) AS BIGINT) AS source_size, CAST([5, 2, 1][CAST((ROW_NUMBER() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS DOUBLE) AS w FROM d GROUP BY source),
c AS (SELECT l.source_size * 2.0 / l.w AS level, SUM(LEAST(r.source_size * 2.0, r.w * (l.source_size * 2.0 / l.w))) AS filled FROM s l, s r GROUP BY l.source, l.source_size, l.w),
t AS (SELECT 1.5 * SUM(source_size) AS total FROM s),
lo AS (SELECT COALESCE(MAX(level), 0) AS below FROM c, t WHERE filled <= total),
water AS (SELECT (total - (SELECT COALESCE(SUM(source_size * 2.0), 0) FROM s, lo WHERE source_size * 2.0 / w <= below)) / NULLIF((SELECT SUM(w) FROM s, lo WHERE source_size * 2.0 / w > below), 0) AS level FROM t)
SELECT doc_id, size, source_size, round(CASE WHEN source_size * 2.0 / w <= below THEN source_size * 2.0 ELSE LEAST(source_size * 2.0, water.level * w) END, 3) AS target
FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source, lo, water
"""
