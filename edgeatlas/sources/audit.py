"""The audit log: JSON lines by UTC day. Arguments are sanitised, results never logged."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeatlas.operators.percentiles import order_statistics

SCHEMA = "ts timestamp, tool string, args map<string,string>, result_count long, duration_ms double, client string, error string"


class AuditLog:
    """Appends on the driver, one short line a call."""

    def __init__(self, folder: str, clean: Callable = lambda x: x, now: Callable[[], dt.datetime] = lambda: dt.datetime.now(dt.UTC)):
        self.folder, self.clean, self.now = Path(folder), clean, now

    def __call__(self, tool: str, args: dict, result_count: int, duration_ms: float, client: str, error: str | None) -> None:
        at = self.now()
        self.folder.mkdir(parents=True, exist_ok=True)
        row = {"ts": at.isoformat(), "tool": tool, "args": self.clean({k: str(v) for k, v in args.items()}), "result_count": result_count, "duration_ms": round(duration_ms, 2), "client": self.clean(client), "error": error}
        with (self.folder / f"{at:%Y-%m-%d}.jsonl").open("a", encoding="utf-8") as f:
            f.write(json.dumps(row) + "\n")


def entries(spark: SparkSession, folder: str, days: int | None = None) -> DataFrame:
    """The entries of the last ``days`` day files (files, not calendar days)."""
    files = sorted(Path(folder).glob("*.jsonl"))
    chosen = [str(f) for f in (files[-days:] if days else files)]
    return spark.read.schema(SCHEMA).json(chosen) if chosen else spark.createDataFrame([], SCHEMA)


def tail(log: DataFrame, n: int) -> DataFrame:
    """The last n entries, oldest first."""
    return log.orderBy(F.desc("ts"), "tool").limit(n).orderBy("ts", "tool")


def summary(log: DataFrame) -> DataFrame:
    """tool, n_calls, n_errors, p50 (interpolated), p95 (nearest rank); a tool's rows are never gathered in one place."""
    counts = log.groupBy("tool").agg(F.count("*").alias("n_calls"), F.count_if(F.col("error").isNotNull()).alias("n_errors"))
    n = F.col("n")
    ranks = {"below": F.floor((n - 1) / 2), "above": F.ceil((n - 1) / 2), "p95": F.ceil(n * 0.95 - 1e-9) - 1}
    stats = order_statistics(log, "tool", "duration_ms", ranks).withColumnRenamed("tool", "of")
    j = counts.join(stats, F.col("tool").eqNullSafe(F.col("of")), "left")
    return j.select("tool", "n_calls", "n_errors", ((F.col("below") + F.col("above")) / 2).alias("p50"), "p95")
