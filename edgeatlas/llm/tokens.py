"""Token counts through a digest cache.

A count belongs to two digests: that of the normalised content (null as empty, malformed UTF-8 repaired) and that of the
tokenizer's version (kind, library version and the bytes of its file). The cache is a Parquet table of (tokenizer, content, n_tokens),
a folder per tokenizer. Documents' digests are joined to it; of the contents it lacks one copy each is encoded and appended. In
the steady state only digests are shuffled: texts move only where their digest is missing, copies having met on the map side.
A lost executor repeats its tasks; a failed run appends nothing, and rows that two runs append at once say the same.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeatlas.llm.packing import Encoder, tokenizer_path
from edgeatlas.llm.session import cut, drop, free, release, scratch

LIMIT = 1024
SCHEMA = "content binary, n_tokens long, tokenizer string"
#: Missing digests of 32 bytes that are broadcast, at most (some 10 MB in the join); beyond it distinct texts meet them in a shuffled join.
BROADCAST_ROWS = 1 << 16
#: Code points that one call of the library encodes, about.
BATCH = 1 << 20
#: A text with a character outside of these (Latin letters and punctuation) goes to the tokenizer's own library.
OTHER = re.compile("[^\\0-\u024f\u2000-\u206f]")


def tokenizer_version(path: str) -> str:
    """Digest of what decides the ids: the file's kind and bytes, and the library's version."""
    kind = os.path.splitext(path)[1]
    if kind == ".json":
        import tokenizers as library
    elif kind == ".model":
        import sentencepiece as library
    else:
        raise ValueError(f"no library for tokenizer files like {path}")
    with open(path, "rb") as f:
        return hashlib.sha256(f"{kind} {library.__name__} {library.__version__} ".encode() + f.read()).hexdigest()


def counter(path: str) -> Callable[[list[str]], list[int]]:
    """Numbers of tokens of texts, as the file's library gives them: nothing added, cut or padded.

    A byte-level vocabulary also drives the rank encoder of ``packing``, for texts of ``OTHER``'s complement without special strings, on whose
    characters the tests compare both; whatever else a text holds, the library counts.
    """
    if path.endswith(".json"):
        enc = Encoder(path)
        enc.tok.no_truncation()
        enc.tok.no_padding()

        def count(texts: list[str]) -> list[int]:
            quick = [bool(enc.fast) and not OTHER.search(t) and not enc.holds_added(t) for t in texts]
            slow = iter(enc.tok.encode_batch_fast([t for t, q in zip(texts, quick, strict=True) if not q], add_special_tokens=False))
            return [len(enc.encode(t)) if q else len(next(slow)) for t, q in zip(texts, quick, strict=True)]

        return count
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    return lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]


def normalised(text: Column) -> Column:
    return F.make_valid_utf8(F.coalesce(text, F.lit("")))


def digest(content: Column) -> Column:
    return F.unhex(F.sha2(content, 256))


def stored(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """content, n_tokens: what the cache has for one version of a tokenizer; a cache that is not there yet is empty."""
    try:
        found = spark.read.schema(SCHEMA).parquet(cache)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        found = spark.createDataFrame([], SCHEMA)
    return found.where(F.col("tokenizer") == version).select("content", "n_tokens").dropDuplicates(["content"])


def append_missing(docs: DataFrame, cache: str, path: str, text: str = "text") -> int:
    """Encode the distinct contents of ``docs`` that the cache lacks and append them; how many there were."""
    spark, version = docs.sparkSession, tokenizer_version(path)
    contents = docs.select(normalised(F.col(text)).alias("text")).select(digest(F.col("text")).alias("content"), "text")
    missing = cut(contents.select("content").distinct().join(stored(spark, cache, version), "content", "left_anti"), "missing")
    n = missing.count()
    if n:
        if n <= BROADCAST_ROWS:
            contents = contents.join(F.broadcast(missing), "content", "left_semi")
        # copies meet before they are shuffled; what is joined beyond the bound is dealt by the digest already
        texts = contents.groupBy("content").agg(F.first("text").alias("text"))
        if n > BROADCAST_ROWS:
            texts = texts.join(missing.hint("merge"), "content", "left_semi")

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if tokenizer_version(path) != version:
                raise RuntimeError(f"{path} differs between the driver and an executor")
            count = counter(path)
            for batch in batches:
                counts: list[int] = []
                held: list[str] = []
                size = 0
                for t in batch.column(1):
                    held.append(t.as_py())
                    size += len(held[-1])
                    if size > BATCH:
                        counts += count(held)
                        held, size = [], 0
                counts += count(held) if held else []
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["content", "n_tokens"])
            del count
            release()

        rows = texts.select("content", "text").mapInArrow(encode, "content binary, n_tokens long")
        rows.withColumn("tokenizer", F.lit(version)).write.mode("append").partitionBy("tokenizer").parquet(cache)
    drop(spark, missing)
    return n


def count_tokens(docs: DataFrame, cache: str, path: str | None = None, limit: int = LIMIT, text: str = "text") -> DataFrame:
    """``docs`` without ``text``, with n_bytes (UTF-8), n_tokens and over_limit; columns of these names get underscores before the new ones.

    A null text counts as empty; repeated rows stay as many as they are; an empty table gives an empty result. Rows with any ids, or none,
    are counted by their content alone. ``cache`` is a folder that driver and executors reach; counts found there are not encoded again.
    """
    path = path or tokenizer_path()
    append_missing(docs, cache, path, text)
    known = cut(stored(docs.sparkSession, cache, tokenizer_version(path)), "known")  # as a table, so that a digest with many rows can be split
    n_bytes, n_tokens, over, content = free(docs, "n_bytes", "n_tokens", "over_limit", "content")
    rest = [c for c in docs.columns if c != text]
    keyed = docs.withColumn(n_bytes, normalised(F.col(text))).select(*rest, F.octet_length(n_bytes).cast("long").alias(n_bytes), digest(F.col(n_bytes)).alias(content))
    j = keyed.join(known.select(F.col("content").alias(content), F.col("n_tokens").alias(n_tokens)), content)
    return j.select(*rest, n_bytes, n_tokens, (F.col(n_tokens) > limit).alias(over))


def op13_token_counts(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_tokens(docs, scratch(spark, "token-counts"))
