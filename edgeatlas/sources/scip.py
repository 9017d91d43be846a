"""Reader of code-intelligence indexes in protobuf wire format: symbol occurrences by file and line."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

DEFINITION = 1


def _varint(b: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        x = b[i]
        i += 1
        value |= (x & 127) << shift
        if x < 128:
            return value, i
        shift += 7


def _fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, number or bytes); fixed-width fields are skipped, groups refused."""
    i = 0
    while i < len(b):
        tag, i = _varint(b, i)
        kind = tag & 7
        if kind == 0:
            v, i = _varint(b, i)
            yield tag >> 3, v
        elif kind == 2:
            n, i = _varint(b, i)
            if i + n > len(b):
                raise ValueError("truncated index")
            yield tag >> 3, b[i : i + n]
            i += n
        elif kind in (1, 5):
            i += 8 if kind == 1 else 4
        else:
            raise ValueError("groups are not supported")


def _numbers(b: bytes) -> list[int]:
    out, i = [], 0
    while i < len(b):
        v, i = _varint(b, i)
        out.append(v)
    return out


def read_index(content: bytes) -> Iterator[tuple[str, str, int, int]]:
    """(path, symbol, line from 1, roles) of every occurrence."""
    for n, doc in _fields(content):
        if n != 2 or not isinstance(doc, bytes):
            continue
        path, found = "", []
        for k, v in _fields(doc):
            if k == 1 and isinstance(v, bytes):
                path = v.decode()
            elif k == 2 and isinstance(v, bytes):
                place, symbol, roles = [], "", 0
                for f, x in _fields(v):
                    if f == 1:
                        place += _numbers(x) if isinstance(x, bytes) else [x]
                    elif f == 2 and isinstance(x, bytes):
                        symbol = x.decode()
                    elif f == 3 and isinstance(x, int):
                        roles = x
                found.append((symbol, place[0] + 1 if place else 1, roles))
        yield from ((path, *x) for x in found)


def occurrences(spark: SparkSession, path: str) -> DataFrame:
    """path, symbol, line, roles of index files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                yield pd.DataFrame(list(read_index(bytes(content))), columns=["path", "symbol", "line", "roles"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "path string, symbol string, line int, roles int")


def callers(found: DataFrame, spans: DataFrame) -> DataFrame:
    """symbol, callers: the innermost functions around references to a symbol. ``spans``: path, qualified_name, line_start, line_end."""
    from pyspark.sql import functions as F

    from edgeatlas.operators.evaluation import enclosing

    refs = found.where(F.col("roles").bitwiseAND(DEFINITION) == 0)
    at = enclosing(refs.select("path", "line").distinct(), spans)
    return refs.join(at, ["path", "line"]).groupBy("symbol").agg(F.sort_array(F.collect_set("qualified_name")).alias("callers"))
