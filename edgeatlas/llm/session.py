"""Session helpers of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from edgeatlas.session import cut, discard, drop, scratch, shared_dir

__all__ = ["cut", "discard", "drop", "free", "release", "scratch", "shared_dir", "small_batches"]


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Bound an Arrow batch of whole texts by rows; long texts make large batches. A bound that is lower already stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if not 0 < now <= rows:
        spark.conf.set(key, str(rows))


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores put before it until no column of ``df`` has it (case does not count)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def release() -> None:
    """Give memory that this process no longer uses back to the system; workers outlive their tasks."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
