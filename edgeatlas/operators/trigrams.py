"""An inverted index of trigrams for substring search, for one needle or a table of them.

A posting is a row (trigram, symbol_id), so a trigram that every symbol has is many rows and no long value. A needle's rarest trigrams
are intersected first, and what survives is compared with the names themselves, so an answer is exactly that of a scan. Needles of less
than three characters have no trigram and are not for this index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Trigrams of a needle that are intersected, rarest first; more would hardly leave fewer symbols.
RAREST = 3


def trigrams(text: Column) -> Column:
    """The distinct trigrams of a text in lower case; none for a null or a shorter one."""
    low = F.lower(F.coalesce(text, F.lit("")))
    at = F.sequence(F.lit(1), F.greatest(F.length(low) - 2, F.lit(1)))
    return F.when(F.length(low) < 3, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(at, lambda i: F.substring(low, i, F.lit(3)))))


def postings(symbols: DataFrame) -> DataFrame:
    """(trigram, symbol_id) of names and qualified names, each once a symbol."""
    both = F.array_union(trigrams(F.col("name")), trigrams(F.col("qualified_name")))
    return symbols.select(F.explode(both).alias("trigram"), "symbol_id")


def candidates(index: DataFrame, needles: DataFrame, rarest: int = RAREST) -> DataFrame:
    """(needle, symbol_id): symbols that have the needle's ``rarest`` trigrams. ``needles``: needle, each once.

    A needle with a trigram that no symbol has gives nothing; nulls and needles under three characters give nothing either.
    """
    asked = needles.select("needle", F.explode(trigrams(F.col("needle"))).alias("trigram"))
    met = index.join(asked.select("trigram").distinct(), "trigram", "left_semi")  # the postings of these trigrams alone
    sizes = met.groupBy("trigram").agg(F.count("*").alias("n"))
    ranked = asked.join(sizes, "trigram", "left").withColumn("rank", F.row_number().over(Window.partitionBy("needle").orderBy(F.coalesce("n", F.lit(0)), "trigram"))).where(F.col("rank") <= rarest)
    wanted = ranked.groupBy("needle").agg(F.count("*").alias("of"), F.min(F.coalesce("n", F.lit(0))).alias("least")).where("least > 0")
    # the rarest one's postings, then those of them that the others have
    found = ranked.where("rank = 1").select("needle", "trigram").join(met, "trigram").select("needle", "symbol_id")
    others = ranked.where("rank > 1").select("needle", "trigram").join(met, "trigram").select("needle", "symbol_id")
    every = found.unionByName(others.join(found, ["needle", "symbol_id"], "left_semi")).groupBy("needle", "symbol_id").agg(F.count("*").alias("n"))
    return every.join(wanted, "needle").where("n = of").select("needle", "symbol_id")


def find(index: DataFrame, symbols: DataFrame, needles: DataFrame) -> DataFrame:
    """``symbols`` with the needle that each holds in its name or qualified name; a row per pair. Case does not count."""
    found = candidates(index, needles.select("needle").distinct()).join(symbols, "symbol_id")
    low = F.lower("needle")
    return found.where(F.lower("name").contains(low) | F.lower("qualified_name").contains(low))
