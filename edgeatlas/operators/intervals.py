"""Points in intervals: the best interval around each point, by one sweep over each stretch of a path.

Intervals are cut where stretches of ``WIDTH`` lines end, so a point meets the pieces of one stretch only, and the stretches of a path
are swept side by side. A sweep keeps the intervals open so far that can still win: a better and longer-lasting one drives out others, so
what is left ranks worse the longer it lasts (a stack, where intervals nest). Rows are streamed in order; nothing is paired.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTH = 4096


class Open:
    """Open intervals in order of rank, each lasting longer than those that rank better."""

    def __init__(self):
        self.ranks: list[tuple] = []
        self.ends: list[int] = []
        self.names: list = []

    def add(self, rank: tuple, end: int, name) -> None:
        i = bisect_left(self.ranks, rank)
        if i and self.ends[i - 1] >= end:
            return
        j = i
        while j < len(self.ends) and self.ends[j] <= end:
            j += 1
        self.ranks[i:j], self.ends[i:j], self.names[i:j] = [rank], [end], [name]

    def at(self, line: int):
        """The best interval open at ``line``, None without one; lines ascend."""
        i = bisect_left(self.ends, line)
        if i:
            del self.ranks[:i], self.ends[:i], self.names[:i]
        return self.names[0] if self.names else None


def best_around(points: DataFrame, spans: DataFrame, rank: list[Column], width: int = WIDTH) -> DataFrame:
    """path, line, qualified_name: for each distinct point the span around it that comes first by ``rank`` (numbers), then by name.

    ``points``: path, line; ``spans``: path, qualified_name, line_start, line_end (both included) and what ``rank`` reads. Points
    outside every span, rows with nulls and spans that end before they start give nothing; an empty table gives an empty result.
    """
    stretch = lambda c: F.floor(F.col(c) / width).cast("long")
    s = spans.where("line_start <= line_end and path is not null and qualified_name is not null").withColumn("stretch", F.explode(F.sequence(stretch("line_start"), stretch("line_end"))))
    s = s.select("path", "stretch", F.greatest(F.col("line_start").cast("long"), F.col("stretch") * width).alias("at"), F.lit(0).alias("is_point"), F.least(F.col("line_end").cast("long"), (F.col("stretch") + 1) * width - 1).alias("end"), F.array(*[r.cast("double") for r in rank]).alias("rank"), "qualified_name")
    p = points.select("path", "line").distinct().where("path is not null and line is not null")
    kind = points.schema["line"].dataType
    p = p.select("path", stretch("line").alias("stretch"), F.col("line").cast("long").alias("at"), F.lit(1).alias("is_point"), F.lit(None).cast("long").alias("end"), F.lit(None).cast("array<double>").alias("rank"), F.lit(None).cast("string").alias("qualified_name"))
    # hash partitions by stretch: all rows of one are in one place, in order, spans before the points of their first line
    rows = s.unionByName(p).repartition("path", "stretch").sortWithinPartitions("path", "stretch", "at", "is_point")

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, opened = None, Open()
        for batch in batches:
            paths, lines, names = [], [], []
            for path, part, at, is_point, end, ranks, name in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (path, part) != key:
                    key, opened = (path, part), Open()
                if not is_point:
                    opened.add((*ranks, name), end, name)
                elif (found := opened.at(at)) is not None:
                    paths.append(path)
                    lines.append(at)
                    names.append(found)
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(lines, pa.int64()), pa.array(names, pa.string())], names=["path", "line", "qualified_name"])

    return rows.mapInArrow(sweep, "path string, line long, qualified_name string").withColumn("line", F.col("line").cast(kind))
