"""A count-min sketch of fixed size: partial sketches by chunk, summed by shard, held as a broadcast of packed cells.

A chunk writes its cells sorted and delta-coded, about a byte an entry, each as often as it was met up to a cap; shards add
up where they meet. Sums only overestimate, except that a chunk's cap bounds what it adds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from edgeatlas.llm.session import cut, drop, release
from edgeatlas.llm.words import mix

_SALT = np.uint64(0xA0761D6478BD642F)


def encode(sorted_ids: np.ndarray) -> bytes:
    """Ascending ids as bytes: differences, 255 meaning "255 and go on"."""
    d = np.diff(sorted_ids.astype(np.int64), prepend=0)
    far, rest = np.divmod(d, 255)
    at = np.cumsum(far + 1) - 1
    out = np.full(int(at[-1]) + 1 if len(at) else 0, 255, np.uint8)
    out[at] = rest
    return out.tobytes()


def decode(blob: bytes) -> np.ndarray:
    b = np.frombuffer(blob, np.uint8)
    return np.cumsum(b, dtype=np.int64)[b < 255]


@dataclass(frozen=True)
class Sketch:
    """``rows`` rows of 2**cell_bits cells, in shards of 2**shard_bits; ``times`` caps what one chunk adds to a cell."""

    rows: int = 2
    cell_bits: int = 28
    shard_bits: int = 22
    times: int = 2

    @property
    def shards(self) -> int:
        return 1 << (self.cell_bits - self.shard_bits)

    def cells(self, h: np.ndarray, row: int = 0) -> np.ndarray:
        x = h if row == 0 else mix(h ^ _SALT * np.uint64(row))
        return (x >> np.uint64(64 - self.cell_bits)).astype(np.uint32)

    def partial(self, h: np.ndarray) -> pa.RecordBatch:
        """A chunk's part: (row and shard, cells)."""
        at, blobs, t = [], [], self.times
        for row in range(self.rows):
            c = np.sort(self.cells(h, row))
            if len(c) > t:
                c = c[np.concatenate([np.ones(t, bool), c[t:] != c[:-t]])]
            bounds = np.searchsorted(c, np.arange(0, (1 << self.cell_bits) + 1, 1 << self.shard_bits))
            for s in np.flatnonzero(np.diff(bounds)):
                at.append(row * self.shards + int(s))
                blobs.append(encode(c[bounds[s] : bounds[s + 1]] - np.uint32(s << self.shard_bits)))
        return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(blobs, pa.binary())], names=["shard", "cells"])

    def total(self, spark: SparkSession, parts: DataFrame, pack: Callable[[np.ndarray], np.ndarray], bits: int):
        """Sum ``parts``; ``pack`` turns a shard's counts (uint8, at most 255) into bytes of ``bits`` bits a cell. A broadcast of fixed size."""
        return self.totals(spark, parts, pack, bits)[0]

    def totals(self, spark: SparkSession, parts: DataFrame, pack: Callable[[np.ndarray], np.ndarray], bits: int):
        """``total``, and the sum of the first row's cells that reach two: about how many entries share a cell."""
        size = 1 << self.shard_bits

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                for s, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    have = sums.setdefault(s, np.zeros(size, np.uint8))
                    u, n = np.unique(decode(blob.as_py()), return_counts=True)
                    have[u] = np.minimum(have[u] + n, 255)
            for s, have in sums.items():
                many = int(have[have > 1].sum(dtype=np.int64)) if s < self.shards else 0
                yield pa.RecordBatch.from_pydict({"shard": pa.array([s], pa.int32()), "cells": pa.array([pack(have).tobytes()], pa.binary()), "many": pa.array([many], pa.int64())})
            release()

        width = size * bits // 8
        out, many = bytearray(self.rows * self.shards * width), 0
        # all shards are summed side by side and written; the driver then fetches some 4 MB of them at a time
        summed = cut(parts.repartition(self.rows * self.shards, "shard").mapInArrow(run, "shard int, cells binary, many long"), "sketch")
        for r in summed.coalesce(max(1, len(out) >> 22)).toLocalIterator():
            out[r[0] * width : (r[0] + 1) * width] = r[1]
            many += r[2]
        drop(spark, summed)
        return spark.sparkContext.broadcast(out), many

    def bit(self, table: np.ndarray, h: np.ndarray) -> np.ndarray:
        """For one bit a cell: whether all of a hash's cells have it."""
        ok = np.ones(len(h), bool)
        for row in range(self.rows):
            c = self.cells(h[ok], row).astype(np.int64) + (row << self.cell_bits)
            ok[ok] = (table[c >> 3] >> (c & 7).astype(np.uint8)) & 1 != 0
        return ok

    def nibble(self, table: np.ndarray, h: np.ndarray) -> np.ndarray:
        """For four bits a cell and one row: a hash's value."""
        c = self.cells(h)
        return (table[c >> 1] >> ((c & 1) << 2).astype(np.uint8)) & 15


def at_least(n: int) -> Callable[[np.ndarray], np.ndarray]:
    return lambda counts: np.packbits(counts >= n, bitorder="little")


def levels(bounds: tuple[int, ...]) -> Callable[[np.ndarray], np.ndarray]:
    """Pack counts as the number of ``bounds`` (at most 15, ascending) that they reach."""
    table = np.searchsorted(np.array(bounds), np.arange(256), "right").astype(np.uint8)

    def pack(counts: np.ndarray) -> np.ndarray:
        v = table[counts]
        return v[0::2] | (v[1::2] << 4)

    return pack
