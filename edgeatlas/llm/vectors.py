"""Embedding near-dedup by randomised-rotation binary codes.

A vector is normalised and rotated by a fixed random rotation; its code is the signs, one bit a dimension, its correction factor the
inner product of the vector with its own code. The product of a code with another vector's rotated form, divided by the factor, is an
unbiased estimate of their cosine whose error shrinks with the factor and the dimension. Codes and factors are stored with each vector,
beside its rotated form in a byte a dimension (whose rounding error is bounded and added to the bound). Only these are sent to the
places where vectors meet. A pair whose estimate plus bound stays under the threshold is dropped, then one whose rotated forms in bytes
stay under it by more than their rounding; full vectors are fetched for those that have a pair left, and such pairs are computed again in
double precision.

No pair at or above the threshold is left out of that estimate. A vector's home is the cell of its nearest centre (a bounded sample, near copies
of a centre left out), in a near or a far ring. It visits each cell that a partner could have as home: two bounds follow from
the least distance and the least angle between vectors that are no partners. Cells are put together or cut into blocks, blocks into some
12 groups; a job is a pair of groups, goes through its pairs of blocks one at a time and sees a pair of vectors once. A vector is sent to a
job once, with the blocks it visits there as bits, and only counts and a spanning forest of its links leave a job. Equal vectors collapse
beforehand. Where vectors have nothing in common no bound excludes a cell, so work among those is quadratic; what is sent is not, until
groups reach their greatest size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeatlas.llm.components import components
from edgeatlas.llm.session import cut

THRESHOLD = 0.9
#: Standard deviations that a pair's estimate may fall short by.
DEVIATIONS = 4.0
#: Centres are 2 * sqrt(vectors) in number, within these bounds, less the near copies among them.
LEAST_CENTRES, MOST_CENTRES = 8, 16384
#: Cosine to the centre from which a vector is in the near ring of its cell.
RING = 0.6
#: Vectors of a block, at most. Rows computed at once in a job.
BLOCK, ROWS = 4096, 256
#: Groups of blocks; each vector is sent to at most one job a group. Blocks of a group at most (bits of a long), which bounds a job's memory:
#: beyond GROUPS * WIDE * BLOCK vectors (1.6 million) there are more groups.
GROUPS, WIDE = 12, 32
SEED = 11


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


class Codes:
    """Signs, correction factors, deviations and rotated forms of unit vectors (rows)."""

    def __init__(self, unit: np.ndarray, turn: np.ndarray):
        turned = unit @ turn.T
        dim = unit.shape[1]
        top = np.abs(turned).max(1) if dim else np.zeros(len(unit))
        self._set(np.packbits(turned >= 0, axis=1), np.abs(turned).sum(1) / np.sqrt(dim), np.rint(turned * (127 / np.where(top > 0, top, 1))[:, None]).astype(np.int8), top / 127, dim)

    def _set(self, bits, factor, bytes_, scale, dim) -> Codes:
        self.bits, self.factor, self.bytes, self.scale, self.dim, self._turned = bits, factor, bytes_, scale, dim, None
        self.deviation = np.sqrt(np.maximum(0, 1 - factor**2) / (factor**2 * max(1, dim - 1)))
        return self

    @classmethod
    def stored(cls, bits: np.ndarray, factor: np.ndarray, bytes_: np.ndarray, scale: np.ndarray) -> Codes:
        return cls.__new__(cls)._set(bits, factor, bytes_, scale, bytes_.shape[1])

    def signs(self) -> np.ndarray:
        return np.unpackbits(self.bits, axis=1, count=self.dim).astype(np.float32) * 2 - 1

    def turned(self) -> np.ndarray:
        if self._turned is None:
            self._turned = self.bytes.astype(np.float32) * self.scale.astype(np.float32)[:, None]
        return self._turned

    def rows(self, i, j=None) -> Codes:
        at = slice(i, j) if j is not None else i
        return Codes.stored(self.bits[at], self.factor[at], self.bytes[at], self.scale[at])

    def estimate(self, other: Codes) -> np.ndarray:
        """Estimated cosines of this side's codes with the other side's vectors."""
        return (self.signs() @ other.turned().T) / (np.sqrt(self.dim) * self.factor)[:, None]

    def may_link(self, other: Codes, threshold: float, deviations: float) -> np.ndarray:
        """Pairs whose estimate, with its deviation and the other side's rounding, reaches the threshold."""
        rounding = np.sqrt(self.dim) * float(other.scale.max(initial=0)) / 2
        least = threshold - 1e-5 - deviations * self.deviation - rounding / self.factor
        return self.signs() @ other.turned().T >= (least * np.sqrt(self.dim) * self.factor).astype(np.float32)[:, None]

    def near(self, other: Codes, threshold: float, deviations: float) -> tuple[np.ndarray, np.ndarray]:
        """Index pairs that ``may_link`` leaves and whose rotated forms reach the threshold or miss it by no more than both sides' rounding."""
        maybe = self.may_link(other, threshold, deviations)
        a, b = self.turned(), other.turned()
        off, less = (np.sqrt(self.dim) / 2 * c.scale for c in (self, other))  # a rounded form is at most so far from its vector
        if np.count_nonzero(maybe) > maybe.size // 16:
            least = threshold - 1e-5 - off - float(less.max(initial=0)) * (1 + off)
            maybe &= a @ b.T >= least.astype(np.float32)[:, None]
            return np.divmod(np.flatnonzero(maybe), maybe.shape[1])
        x, y = np.divmod(np.flatnonzero(maybe), maybe.shape[1])  # faster than nonzero
        ok = np.einsum("ij,ij->i", a[x], b[y]) >= threshold - 1e-5 - off[x] - less[y] * (1 + off[x])
        return x[ok], y[ok]


def linked_parts(a: np.ndarray, b: np.ndarray, turn: np.ndarray, threshold: float = THRESHOLD, deviations: float = DEVIATIONS) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """``linked`` for a few rows of ``a`` at a time, in order."""
    cb = Codes(b, turn)
    for start in range(0, len(a), ROWS):
        part = a[start : start + ROWS]
        maybe = Codes(part, turn).may_link(cb, threshold, deviations)
        n = int(np.count_nonzero(maybe))
        if n > maybe.size // 16:
            x, y = np.nonzero(maybe & (part @ b.T >= threshold))
        else:
            x, y = np.nonzero(maybe)
            ok = np.einsum("ij,ij->i", part[x], b[y]) >= threshold
            x, y = x[ok], y[ok]
        yield x + start, y, n


def linked(a: np.ndarray, b: np.ndarray, turn: np.ndarray, threshold: float = THRESHOLD, deviations: float = DEVIATIONS) -> tuple[np.ndarray, np.ndarray, int]:
    """Index pairs of unit vectors with cosine at or above the threshold, and how many pairs were computed exactly."""
    parts = list(linked_parts(a, b, turn, threshold, deviations))
    if not parts:
        return np.empty(0, int), np.empty(0, int), 0
    x, y, n = zip(*parts, strict=True)
    return np.concatenate(x), np.concatenate(y), sum(n)


def unite(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Labels (each the least index of its tree) after the links x, y."""
    while len(x):
        a, b = label[x], label[y]
        apart = a != b
        x, y, a, b = x[apart], y[apart], a[apart], b[apart]
        up = np.arange(len(label))
        np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
        while (up[up] != up).any():
            up = up[up]
        label = up[label]
    return label


def spread(sample: np.ndarray, threshold: float) -> np.ndarray:
    """The rows (unit vectors) that have no cosine at or above the threshold with an earlier one that stays."""
    kept = np.empty_like(sample)
    n = 0
    for row in sample:
        if not n or (kept[:n] @ row).max() < threshold:
            kept[n] = row
            n += 1
    return kept[:n]


class Cells:
    """Rings of centres, dealt to blocks, and which of them hold a vector's possible partners.

    ``stats``: (home, ring, vectors, least and greatest cosine to the centre), a row per ring that holds vectors.
    """

    def __init__(self, centres: np.ndarray, stats: list[tuple], threshold: float, block: int):
        self.centres, self.reach = centres.astype(np.float32), np.sqrt(max(0.0, 2 - 2 * threshold))
        angle, slack = np.arccos(np.clip(threshold, -1, 1)), 1e-3
        self.blocks: dict[tuple[int, int], tuple[int, int]] = {}
        entries, n_blocks, room = [], 0, 0
        for home, ring, n, low, high in sorted(stats, key=lambda r: (-r[3], r[0], r[1])):
            if n > block:
                own = -(-n // block)
                self.blocks[home, ring] = (n_blocks, own)
                n_blocks, room = n_blocks + own, 0
            else:
                if n > room:
                    n_blocks, room = n_blocks + 1, block
                self.blocks[home, ring] = (n_blocks - 1, 1)
                room -= n
            far, near = (float(np.arccos(np.clip(c, -1, 1))) for c in (low, high))
            first, own = self.blocks[home, ring]
            bounds = (np.cos(min(np.pi, far + angle + slack)) - 1e-5, np.cos(max(0.0, near - angle - slack)) + 1e-5)
            entries += [(b, home, *bounds) for b in range(first, first + own)]
        entries.sort()
        self.entry_home = np.array([e[1] for e in entries], int)
        self.low, self.high = (np.array([e[k] for e in entries], np.float32) for k in (2, 3))
        self.starts = np.flatnonzero(np.diff([-1, *(e[0] for e in entries)]))

    def groups(self) -> tuple[int, int]:
        """Groups, and blocks of a group."""
        per = max(1, min(WIDE, -(-len(self.starts) // GROUPS)))
        return -(-len(self.starts) // per), per

    def block_of(self, home: np.ndarray, ring: np.ndarray, node: np.ndarray) -> np.ndarray:
        first, own = np.array([self.blocks[k] for k in zip(home.tolist(), ring.tolist(), strict=True)], np.int64).reshape(-1, 2).T
        return first + node % own

    def visited(self, unit: np.ndarray, home: np.ndarray) -> np.ndarray:
        """Vectors x blocks: whether the block may hold a partner of the vector.

        A partner y is at least as near to its own centre c as to this one's h, so x.(h - c) is at most |x - y| |h - c|; and
        its angle to c differs from that of x by no more than the threshold's angle.
        """
        p = unit.astype(np.float32) @ self.centres.T
        apart = np.sqrt(np.maximum(0, 2 - 2 * (self.centres[home] @ self.centres.T)))
        side = p[np.arange(len(p)), home][:, None] - p <= self.reach * apart + 1e-3
        q = p[:, self.entry_home]
        may = side[:, self.entry_home] & (q >= self.low) & (q <= self.high)
        return np.logical_or.reduceat(may, self.starts, axis=1)

    def sent(self, unit: np.ndarray, home: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Vectors (by index), groups that they are sent to, and the blocks they visit there as bits; ``own`` are the vectors' blocks."""
        n, per = self.groups()
        may = np.zeros((len(unit), n * per), bool)
        may[:, : len(self.starts)] = self.visited(unit, home)
        may[np.arange(len(own)), own] = True
        bits = may.reshape(-1, n, per) @ (np.int64(1) << np.arange(per, dtype=np.int64))
        x, to = np.nonzero(bits)
        return x, to, bits[x, to]


def meetings(key: tuple, table: pa.Table, per: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Of the job ``key``, a pair of groups: each pair of blocks that has vectors on both sides, and the rows of ``table`` that meet there."""
    i, j = (k.as_py() for k in key)
    block, visits = (table.column(k).to_numpy() for k in ("block", "visits"))
    order = np.argsort(block, kind="stable")
    first = {int(b): rows for b, rows in zip(*_runs(block[order], order), strict=True)}
    for p in sorted(b for b in first if b // per == i):
        for q in sorted(b for b in first if b // per == j and b >= p):
            a = first[p][visits[first[p]] >> (q - j * per) & 1 == 1]
            b = first[q][visits[first[q]] >> (p - i * per) & 1 == 1]
            if len(a) and len(b):
                yield p, q, a, b


def _runs(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct keys (sorted before), and the rows of each."""
    at = np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1))
    return keys[at], np.split(rows, at[1:])


def _unit(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in double precision, and which rows have one."""
    rows = column.to_pylist() if column.null_count or column.flatten().null_count else None
    if rows is None and len(column) and len(column.flatten()) == dim * len(column):
        v = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), dim)
    else:
        rows = column.to_pylist() if rows is None else rows
        v = np.full((len(column), dim), np.nan)
        for i, r in enumerate(rows):
            if r is not None and len(r) == dim and None not in r:
                v[i] = r
    with np.errstate(invalid="ignore", over="ignore"):
        top = np.abs(v).max(1, keepdims=True) if dim else np.zeros((len(v), 1))
        fine = np.isfinite(v).all(1) & (top[:, 0] > 0)
        v = np.where(fine[:, None], v / np.where(top > 0, top, 1), 0)
        norm = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(norm > 0, norm, 1), fine


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per vector.

    Null and zero vectors and vectors with null or non-finite parts have no links; vectors of different lengths have no cosine, so
    each length is worked on by itself; equal vectors link with each other; repeated ids count as separate rows; an empty table
    gives an empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    v = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("embedding"))
    good = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    v = v.withColumn("name", F.when(good, F.md5(F.to_json("embedding"))))  # 128 bits stand for the vector
    groups = v.where("name is not null").groupBy("name").agg(F.first("embedding").alias("embedding"), F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    nodes = cut(groups.withColumn("node", F.monotonically_increasing_id()), "nodes")  # numbered once, when written
    found, roots = None, None
    for (dim,) in nodes.select(F.size("embedding").alias("d")).distinct().orderBy("d").collect():  # the lengths that occur
        links = _links(nodes.where(F.size("embedding") == dim).select("node", "embedding", "copies"), dim, threshold)
        found = links if found is None else found.unionByName(links)
    if found is None:
        found = spark.createDataFrame([], "node long, links long, to long")
    else:
        roots = components(found.select(F.col("node").alias("a"), F.col("to").alias("b"))).withColumnRenamed("node", "c_node")
    named = nodes.select("name", "node", "copies", "least").join(found.groupBy("node").agg(F.sum("links").alias("links")), "node", "left")
    named = named.join(roots, F.col("node") == F.col("c_node"), "left") if roots is not None else named.withColumn("component", F.lit(None).cast("long"))
    named = named.select("name", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "least", F.coalesce("component", "node").alias("root"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    per_node = named.join(ids, "root").select(F.col("name").alias("p_name"), "n_links", "component_id")
    out = v.select("vec_id", "name").join(per_node, F.col("name") == F.col("p_name"), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def _links(nodes: DataFrame, dim: int, threshold: float) -> DataFrame:
    """(node, links, to): of distinct vectors of one length, how many rows each links with, and a forest of the links."""
    spark = nodes.sparkSession
    n = nodes.count()
    k = int(min(MOST_CENTRES, max(LEAST_CENTRES, 2 * np.sqrt(n))))
    sample = np.array([r[0] for r in nodes.orderBy(F.xxhash64("node", F.lit(SEED)), "node").select("embedding").limit(k).collect()], float).reshape(-1, dim)
    sample /= np.linalg.norm(sample, axis=1, keepdims=True) if len(sample) else 1
    centres = spark.sparkContext.broadcast(spread(sample, threshold))
    turn = rotation(dim)
    kind = nodes.schema["embedding"].dataType.simpleString()
    code_kind = "bits binary, factor double, bytes binary, scale double"

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = centres.value.astype(np.float32)
        for batch in batches:
            unit, _ = _unit(batch.column(1), dim)
            home, cosine = np.empty(len(unit), np.int32), np.empty(len(unit))
            for i in range(0, len(unit), ROWS):
                p = unit[i : i + ROWS].astype(np.float32) @ c.T
                home[i : i + ROWS], cosine[i : i + ROWS] = p.argmax(1), p.max(1)
            code = Codes(unit, turn)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in range(3)), pa.array(home), pa.array((cosine >= RING).astype(np.int32)), pa.array(cosine), _cells(code.bits), pa.array(code.factor), _cells(code.bytes), pa.array(code.scale)],
                names=["node", "embedding", "copies", "home", "ring", "cosine", "bits", "factor", "bytes", "scale"],
            )

    placed = cut(nodes.mapInArrow(assign, f"node long, embedding {kind}, copies long, home int, ring int, cosine double, {code_kind}"), "placed")
    stats = placed.groupBy("home", "ring").agg(F.count("*"), F.min("cosine"), F.max("cosine")).collect()  # two rows a centre
    # a block less than full where that makes GROUPS of them
    dealt = Cells(centres.value, [tuple(r) for r in stats], threshold, min(BLOCK, max(ROWS, -(-n // GROUPS))))
    (groups, per), cells = dealt.groups(), spark.sparkContext.broadcast(dealt)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, home, ring = (batch.column(k).to_numpy() for k in (0, 2, 3))
            unit, _ = _unit(batch.column(1), dim)
            block = cells.value.block_of(home, ring, node)
            for i in range(0, len(unit), ROWS):
                own = block[i : i + ROWS]
                x, to, bits = cells.value.sent(unit[i : i + ROWS], home[i : i + ROWS], own)
                mine = own[x] // per
                ends = (np.minimum(mine, to), np.maximum(mine, to), own[x])
                rows = pa.array(x + i)
                yield pa.RecordBatch.from_arrays([*(pa.array(e.astype(np.int32)) for e in ends), pa.array(bits), *(batch.column(c).take(rows) for c in (0, 4, 5, 6, 7))], names=["i", "j", "block", "visits", "node", "bits", "factor", "bytes", "scale"])

    visits = placed.select("node", "embedding", "home", "ring", "bits", "factor", "bytes", "scale").mapInArrow(visit, f"i int, j int, block int, visits long, node long, {code_kind}")
    jobs = groups * (groups + 1) // 2  # few and long: each is dealt by itself

    def screen(key: tuple, table: pa.Table) -> pa.Table:
        """Who has a pair left by the estimates, and in which blocks."""
        i, j = (k.as_py() for k in key)
        block, node, factor, scale = (table.column(k).to_numpy() for k in ("block", "node", "factor", "scale"))
        code = Codes.stored(_matrix(table.column("bits"), np.uint8), factor, _matrix(table.column("bytes"), np.int8), scale)
        left = np.zeros(len(node), np.int64)
        for p, q, a, b in meetings(key, table, per):
            other = code.rows(b)
            for s in range(0, len(a), ROWS):
                some = a[s : s + ROWS]
                x, y = code.rows(some).near(other, threshold, DEVIATIONS)
                x, y = some[x], b[y]
                if p == q:
                    x, y = x[x != y], y[x != y]
                left[x] |= 1 << (q - j * per)
                left[y] |= 1 << (p - i * per)
        at = np.flatnonzero(left)
        return pa.table({"i": np.full(len(at), i, np.int32), "j": np.full(len(at), j, np.int32), "block": block[at].astype(np.int32), "visits": left[at], "node": node[at]})

    left = cut(visits.repartition(jobs, "i", "j").groupBy("i", "j").applyInArrow(screen, "i int, j int, block int, visits long, node long"), "left")
    full = left.join(placed.select("node", "copies", "embedding"), "node")

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        node, copies = (table.column(k).to_numpy() for k in ("node", "copies"))
        embedding = table.column("embedding").combine_chunks()
        links, label = np.zeros(len(node)), np.arange(len(node))
        for p, q, a, b in meetings(key, table, per):
            at = a if p == q else np.concatenate([a, b])
            apart, tree, count, weight = len(at) - len(b), np.arange(len(at)), np.zeros(len(at)), copies[at]
            left, right = (_unit(embedding.take(pa.array(k)), dim)[0] for k in (a, b))
            for x, y, _ in linked_parts(left, right, turn, threshold):
                y = y + apart
                if p == q:
                    x, y = x[x < y], y[x < y]
                count += np.bincount(x, weight[y], len(at)) + np.bincount(y, weight[x], len(at))
                tree = unite(tree, x, y)
            links[at] += count
            label = unite(label, at, at[tree])
        at = np.flatnonzero(links)
        return pa.table({"node": node[at], "links": links[at].astype(np.int64), "to": node[label[at]]})

    return cut(full.repartition(jobs, "i", "j").groupBy("i", "j").applyInArrow(compare, "node long, links long, to long"), "links")


def _cells(rows: np.ndarray) -> pa.Array:
    """A binary column of a matrix of bytes."""
    n, width = rows.shape
    offsets = pa.array(np.arange(n + 1, dtype=np.int32) * width)
    return pa.Array.from_buffers(pa.binary(), n, [None, offsets.buffers()[1], pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def _matrix(column: pa.ChunkedArray, kind) -> np.ndarray:
    blobs = column.to_pylist()
    return np.frombuffer(b"".join(blobs), kind).reshape(len(blobs), -1)


def op5_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def embedding_copies(spark, sf_dir: str) -> DataFrame:
    """``op5_embedding_dedup`` on the vectors and, of every second one, a copy scaled and bent a little: the tables hold few near copies."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    bent = F.transform("embedding", lambda x, i: x * F.when(i % 4 == 0, 1.5).when(i % 4 == 1, 0.75).otherwise(1.0))
    return near_duplicates(e.unionByName(e.where("vec_id % 2 = 0").select((-F.col("vec_id") - 1).alias("vec_id"), bent.alias("embedding"))))


SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL),
u AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v WHERE list_dot_product(e, e) > 0),
p AS (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.vec_id <> b.vec_id AND list_dot_product(a.e, b.e) >= 0.9),
reach AS (SELECT x, x AS r FROM (SELECT DISTINCT x FROM p) UNION SELECT reach.x, p.y FROM reach JOIN p ON reach.r = p.x),
c AS (SELECT x, MIN(r) AS c FROM reach GROUP BY x),
n AS (SELECT x, COUNT(*) AS n FROM p GROUP BY x)
SELECT e.vec_id, COALESCE(n.n, 0) AS n_links, COALESCE(c.c, e.vec_id) AS component_id, COALESCE(c.c, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN n ON n.x = e.vec_id LEFT JOIN c ON c.x = e.vec_id
"""

COPIES_SQL = SQL.replace("WITH RECURSIVE v AS", """WITH RECURSIVE embeddings AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS embedding FROM main.embeddings UNION ALL
  SELECT -vec_id - 1, list_transform(CAST(embedding AS DOUBLE[]), lambda x, i: x * CASE (i - 1) % 4 WHEN 0 THEN 1.5 WHEN 1 THEN 0.75 ELSE 1.0 END) FROM main.embeddings WHERE vec_id % 2 = 0), v AS""")
