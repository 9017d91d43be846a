"""What changed between two snapshots of keyed content hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff(old: DataFrame, new: DataFrame, keys: list[str], value: str = "content_hash") -> DataFrame:
    """The keys, and state: added, removed, changed or same."""
    a = old.select(*keys, F.col(value).alias("__old"), F.lit(True).alias("__in_old"))
    b = new.select(*keys, F.col(value).alias("__new"), F.lit(True).alias("__in_new"))
    state = F.when(F.col("__in_old").isNull(), "added").when(F.col("__in_new").isNull(), "removed").when(F.col("__old").eqNullSafe(F.col("__new")), "same").otherwise("changed")
    return a.join(b, keys, "full").select(*keys, state.alias("state"))
