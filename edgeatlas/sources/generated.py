"""Repositories of source files written from the relational tables, so that extraction and resolution run on data of any size.

Each customer is a Python module of one of five market repositories that imports and calls its supplier, each supplier a module of the
supply repository with an entry point, a job and an environment variable, each nation a C# class with a constant, each region a
JSON settings file. A file is a row's own: nothing is gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeatlas.functions.names import language
from edgeatlas.sources.warehouse import table

CUSTOMER = """import os
from s{k} import serve_{k}


def buy_{c}(x):
    serve_{k}()
    x.settle_{c}()
    return os.getenv("SEGMENT_{c}")


class Account{c}:
    def settle_{c}(self):
        return buy_{c}(self)
"""
SUPPLIER = """import dramatiq


@dramatiq.actor(actor_name="job-{k}")
def ship_{k}(x):
    return x


def serve_{k}():
    return ship_{k}.send(1)


if __name__ == "__main__":
    serve_{k}()
"""
NATION = """namespace Places;
public static class Nation{n} {{
    public const string Name = "nation-{n}";
    public static int Code() {{ return {n}; }}
}}
"""
REGION = """{{
  "Region": {{ "Code": {r} }},
  "Code{r}": true
}}
"""
#: A customer's supplier: the smallest tables have ten.
SUPPLIERS = 10


def _text(template: str, **columns: str):
    parts = []
    for i, piece in enumerate(template.replace("{{", "\0").replace("}}", "\1").split("{")):
        name, _, rest = piece.partition("}") if i else ("", "", piece)
        parts += [F.col(columns[name]).cast("string")] if name else []
        parts.append(F.lit(rest.replace("\0", "{").replace("\1", "}")))
    return F.concat(*parts)


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """repo, path, lang, content, content_hash."""
    c = table(spark, sf_dir, "customer").withColumn("k", F.col("c_custkey") % SUPPLIERS)
    rows = [
        c.select(F.concat(F.lit("market"), F.col("c_custkey") % 5).alias("repo"), F.concat(F.lit("c"), "c_custkey", F.lit(".py")).alias("path"), _text(CUSTOMER, c="c_custkey", k="k").alias("text")),
        table(spark, sf_dir, "supplier").select(F.lit("supply").alias("repo"), F.concat(F.lit("s"), "s_suppkey", F.lit(".py")).alias("path"), _text(SUPPLIER, k="s_suppkey").alias("text")),
        table(spark, sf_dir, "nation").select(F.lit("places").alias("repo"), F.concat(F.lit("Nation"), "n_nationkey", F.lit(".cs")).alias("path"), _text(NATION, n="n_nationkey").alias("text")),
        table(spark, sf_dir, "region").select(F.lit("settings").alias("repo"), F.concat(F.lit("r"), "r_regionkey", F.lit("/appsettings.json")).alias("path"), _text(REGION, r="r_regionkey").alias("text")),
    ]
    # small texts, long work: without a number adaptive execution would put them into few tasks
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    all_ = rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3]).repartition(n, "repo", "path")
    return all_.select("repo", "path", language(F.col("path")).alias("lang"), F.encode("text", "UTF-8").alias("content"), F.sha2("text", 256).alias("content_hash"))
