"""Small gradient-boosted trees: grown from sums over all examples, applied as Spark expressions.

An example is a row of small whole numbers that stands for ``n`` equal ones. A level of a tree needs only the sums of gradients by leaf,
feature and value; ``Local`` takes them over arrays, ``Spread`` as a Spark job over a table of any size. Gradients are rounded to multiples of
1 / ``UNIT``, so that sums are whole numbers, exact below 2^53: any order and any number of partitions gives the same trees.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Steps of a gradient, and of a score where held-out examples are counted by it.
UNIT, GRID = 1 << 20, 10_000


@dataclass
class Node:
    value: float = 0.0
    feature: int = -1
    cut: float = 0.0
    low: Node | None = None
    high: Node | None = None
    leaf: int = -1  # its number while it may be split

    def _fold(self, x: np.ndarray, of: str) -> np.ndarray:
        if self.feature < 0:
            return np.full(len(x), getattr(self, of))
        return np.where(x[:, self.feature] <= self.cut, self.low._fold(x, of), self.high._fold(x, of))

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self._fold(x, "value")

    def leaves(self, x: np.ndarray) -> np.ndarray:
        return self._fold(x, "leaf")

    def column(self, f: list[Column]) -> Column:
        if self.feature < 0:
            return F.lit(float(self.value))
        return F.when(f[self.feature] <= F.lit(float(self.cut)), self.low.column(f)).otherwise(self.high.column(f))


@dataclass
class Boosted:
    """Log-odds as a sum of shallow trees."""

    base: float = 0.0
    trees: list[Node] = field(default_factory=list)

    def predict(self, x: np.ndarray) -> np.ndarray:
        z = self.base + sum((t.predict(x) for t in self.trees), np.zeros(len(x)))
        return 1 / (1 + np.exp(-z))

    def column(self, f: list[Column]) -> Column:
        z = F.lit(float(self.base))
        for t in self.trees:
            z = z + t.column(f)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


@dataclass
class Shape:
    """Kinds of examples (a model each), features, and the values that a feature can have, ascending."""

    kinds: int
    features: int
    values: np.ndarray


@dataclass
class Examples:
    fold: np.ndarray
    k: np.ndarray
    x: np.ndarray
    y: np.ndarray
    n: np.ndarray

    @staticmethod
    def of(table: pa.Table | pa.RecordBatch, features: int) -> Examples:
        """From columns fold, k, f (lists of one length), y and n."""
        f = table.column("f")
        flat = (f.combine_chunks() if isinstance(f, pa.ChunkedArray) else f).flatten()
        c = {name: np.asarray(table.column(name)) for name in ("fold", "k", "y", "n")}
        return Examples(c["fold"], c["k"], np.asarray(flat).reshape(-1, features), c["y"].astype(float), c["n"].astype(float))


def _sums(e: Examples, shape: Shape, models: list[Boosted], growing: dict[int, Node], width: int) -> np.ndarray:
    """[kind, leaf, feature, value, (gradient, curvature, number)] over the examples to fit on, fold 0 left out."""
    size = len(shape.values)
    out = np.zeros((shape.kinds, width, shape.features, size, 3))
    for k, root in growing.items():
        x, own = e.x, (e.k == k) & (e.fold > 0)
        own[own] = root.leaves(x[own]) >= 0
        x, y, n = x[own], e.y[own], e.n[own]
        q, leaf = models[k].predict(x), root.leaves(x)
        weights = np.rint((y - q) * UNIT) * n, np.rint(q * (1 - q) * UNIT) * n, n
        for f in range(shape.features):
            at = leaf * size + np.searchsorted(shape.values, x[:, f])
            for c, w in enumerate(weights):
                out[k, :, f, :, c] = np.bincount(at, w, width * size).reshape(width, size)
    return out


def _held(e: Examples, models: list[Boosted]) -> dict[str, np.ndarray]:
    """Examples of fold 0 by kind and score to 1 / ``GRID``: right ones, all, least and highest score."""
    parts = []
    for k in np.unique(e.k[e.fold == 0]):
        own = (e.k == k) & (e.fold == 0)
        s = models[k].predict(e.x[own])
        bins, at = np.unique(np.floor(s * GRID).astype(np.int64), return_inverse=True)
        lo, hi = np.full(len(bins), np.inf), np.full(len(bins), -np.inf)
        np.minimum.at(lo, at, s)
        np.maximum.at(hi, at, s)
        parts.append((np.full(len(bins), k, np.int64), bins, np.bincount(at, e.y[own] * e.n[own]), np.bincount(at, e.n[own]), lo, hi))
    kinds = (np.int64, np.int64, float, float, float, float)
    return dict(zip(("k", "bin", "hits", "n", "lo", "hi"), [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.empty(0, t) for t in kinds], strict=True))


@dataclass
class Local:
    """Examples in arrays."""

    examples: Examples
    shape: Shape

    def sums(self, models: list[Boosted], growing: dict[int, Node], width: int) -> np.ndarray:
        return _sums(self.examples, self.shape, models, growing, width)

    def held(self, models: list[Boosted]) -> dict[str, np.ndarray]:
        return _held(self.examples, models)


@dataclass
class Spread:
    """Examples in a table with fold, k, f, y and n. A job a level; what reaches the driver is a row for each leaf, feature and value, or score."""

    table: DataFrame
    shape: Shape

    def sums(self, models: list[Boosted], growing: dict[int, Node], width: int) -> np.ndarray:
        shape = self.shape

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((shape.kinds, width, shape.features, len(shape.values), 3))
            for b in batches:
                total += _sums(Examples.of(b, shape.features), shape, models, growing, width)
            flat = total.reshape(-1, 3)
            at = np.flatnonzero(flat.any(1))
            yield pa.RecordBatch.from_pydict({"cell": at.astype(np.int64), **{c: flat[at, i] for i, c in enumerate("ghw")}})

        got = self.table.mapInArrow(run, "cell long, g double, h double, w double").groupBy("cell").agg(*[F.sum(c).alias(c) for c in "ghw"]).toArrow()
        out = np.zeros((shape.kinds * width * shape.features * len(shape.values), 3))
        out[np.asarray(got["cell"])] = np.stack([np.asarray(got[c]) for c in "ghw"], 1)
        return out.reshape(shape.kinds, width, shape.features, len(shape.values), 3)

    def held(self, models: list[Boosted]) -> dict[str, np.ndarray]:
        shape = self.shape

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_pydict(_held(Examples.of(b, shape.features), models))

        rows = self.table.where("fold = 0").mapInArrow(run, "k long, bin long, hits double, n double, lo double, hi double")
        got = rows.groupBy("k", "bin").agg(F.sum("hits").alias("hits"), F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).toArrow()
        return {c: np.asarray(got[c]) for c in got.column_names}


def _split(h: np.ndarray, values: np.ndarray, least: int, l2: float) -> tuple[int, int] | None:
    """Feature and place of the best cut of a leaf's sums [feature, value, 3], the first of equals; none that gains or leaves enough on both sides."""
    g, c, w = h[0].sum(0)
    best, where = 1e-6, None
    for f in range(len(h)):
        there = np.flatnonzero(h[f, :, 2] > 0)
        for i, (gl, hl, wl) in zip(there[:-1], np.cumsum(h[f, there], 0)[:-1], strict=True):
            if least <= wl and least <= w - wl:
                gain = gl**2 / (hl + l2) + (g - gl) ** 2 / (c - hl + l2) - g**2 / (c + l2)
                if gain > best:
                    best, where = gain, (f, i)
    return where


def fit(examples: Local | Spread, rounds: int = 24, depth: int = 3, rate: float = 0.4, least: int = 3, l2: float = 1.0) -> tuple[list[Boosted], np.ndarray]:
    """Logistic boosting by second-order steps, a model for each kind grown side by side, and the number of right examples of each; no examples or
    one class give a constant."""
    shape, values = examples.shape, examples.shape.values.astype(float)
    scale = np.array([1 / UNIT, 1 / UNIT, 1.0])
    first = examples.sums([Boosted()] * shape.kinds, {k: Node(leaf=0) for k in range(shape.kinds)}, 1)[:, 0, 0].sum(1) * scale
    n, hits = first[:, 2], first[:, 0] + first[:, 2] / 2  # gradients of even odds
    models, active = [], []
    for k in range(shape.kinds):
        p = np.clip(hits[k] / n[k], 1e-4, 1 - 1e-4) if n[k] else 0.0
        models.append(Boosted(float(np.log(p / (1 - p))) if n[k] else -10.0))
        active += [k] if 0 < hits[k] < n[k] else []
    leaf = lambda s: Node(value=float(rate * s[0] / (s[1] + l2)))
    for _ in range(rounds):
        growing = {k: Node(leaf=0) for k in active}
        leaves = {k: [growing[k]] for k in active}
        for _level in range(depth):
            width = max(map(len, leaves.values()), default=0)
            if not width:
                break
            sums = examples.sums(models, {k: growing[k] for k in leaves if leaves[k]}, width) * scale
            for k, nodes in leaves.items():
                leaves[k] = []
                for i, node in enumerate(nodes):
                    node.leaf = -1
                    h = sums[k, i]
                    if (found := _split(h, values, least, l2)) is None:
                        continue
                    f, at = found
                    more = np.flatnonzero(h[f, :, 2] > 0)
                    node.feature, node.cut = f, float((values[at] + values[more[more > at][0]]) / 2)
                    low, all_ = h[f, : at + 1].sum(0), h[f].sum(0)
                    node.low, node.high = leaf(low), leaf(all_ - low)
                    for child, s in ((node.low, low), (node.high, all_ - low)):
                        if s[2] >= 2 * least:
                            child.leaf = len(leaves[k])
                            leaves[k].append(child)
        for nodes in leaves.values():
            for node in nodes:
                node.leaf = -1
        active = [k for k in active if growing[k].feature >= 0]
        for k in active:
            models[k].trees.append(growing[k])
        if not active:
            break
    return models, hits


def thresholds(held: dict[str, np.ndarray], kinds: int, hits: np.ndarray, precision: float) -> list[float]:
    """For each kind, halfway below the least score from which the precision on held-out examples is reached; above 1 where there is none, or nothing is right."""
    out = []
    for k in range(kinds):
        own = np.flatnonzero(held["k"] == k)
        own = own[np.argsort(-held["bin"][own], kind="stable")]
        right, n = np.cumsum(held["hits"][own]), np.cumsum(held["n"][own])
        lo, below = held["lo"][own], np.append(held["hi"][own][1:], 0.0)[: len(own)]
        ok = np.flatnonzero((right / n >= precision) & (below < lo)) if len(own) and hits[k] + right[-1] > 0 else []
        out.append(float((lo[ok[-1]] + below[ok[-1]]) / 2) if len(ok) else 2.0)
    return out
