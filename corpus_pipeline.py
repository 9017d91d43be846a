"""A training corpus from ``documents`` in five stages, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeatlas.llm import jaccard, mixing, packing, pii, quality
from edgeatlas.llm.session import cut, free, scratch
from edgeatlas.llm.sketch import Sketch, at_least

#: Names of documents that go or have several rows: 2**26 cells of 1 bit, 8 MB. Others may share a cell, which changes no result.
UNSETTLED = Sketch(rows=1, cell_bits=26, times=1)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the learned list keep; nulls and empty texts go, repeated rows share their verdict."""
    rules = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    (name,) = free(docs, "__quality")
    return quality.assess(docs, rules, name=name).where(F.col(name)["kept"]).select(*docs.columns)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id, one without an id only where none has one.

    A document is named by its id and its text: rows alike in both are one document, of which the least row stays; rows with
    one id and different texts are documents of their own.
    """
    (name,) = free(docs, "__name")
    named = docs.withColumn(name, F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("c"), F.col("text").isNull().alias("d")))
    found = jaccard.jaccard_components(named, doc_id=name).groupBy(F.col("doc_id").alias(name)).agg(F.first(F.expr("doc_id = component_id")).alias("kept"), F.count("*").alias("rows"))
    found = cut(found, "names")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield UNSETTLED.partial(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))

    # a row stays as it is, and its text where it is, unless its name may be of a document that goes or has several rows
    hashed = lambda df: df.select(F.xxhash64(name).alias("h"))
    marked = UNSETTLED.total(spark, hashed(found.where("not kept or rows > 1")).mapInArrow(mark, "shard int, cells binary"), at_least(1), 1)

    @F.pandas_udf("boolean")
    def unsettled(h: pd.Series) -> pd.Series:
        return pd.Series(UNSETTLED.bit(np.frombuffer(marked.value, np.uint8), h.to_numpy().view(np.uint64)))

    (flag,) = free(named, "__unsettled")
    asked = named.withColumn(flag, unsettled(F.xxhash64(name)))
    rows = asked.where(flag).join(found.where("kept").select(name), name, "left_semi").groupBy(name).agg(F.min(F.struct(*docs.columns)).alias("row"))
    return asked.where(~F.col(flag)).select(*docs.columns).unionByName(rows.select("row.*"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, spans of personal data replaced by their kind."""
    out = pii.redact(docs, pii.fit(docs))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them."""
    return mixing.mix_sources(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per token piece with its sequence and offset."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", ngram_jaccard),
    ("PII", personal_data),
    ("mixing sources to target weights", source_mixing),
    ("best-fit packing", best_fit_packing),
]

#: The learned stages have no SQL; tests compare the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
