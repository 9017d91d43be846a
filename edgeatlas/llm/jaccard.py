"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence.

Nodes are distinct shingle sets, named by a 64-bit signature, so copies collapse before anything is compared. Two linked
sets share an n-gram among the first |x| - ceil(0.75 |x|) + 1 of each in any fixed order; the order here is rarest first by a
count-min sketch (only consistency matters for exactness). The sketch has a fixed size, so on large inputs many sets that are not alike
share such a column. The pairs of a column of at most ``PAIRED`` sets therefore go through an exact bound first: a set's bitmap holds the
parity of its hashes by position, and two sets differ in at least as many hashes as their bitmaps in bits. Pairs that may still
link, and all sets of a larger column, fall into one cluster; within a cluster, blocks of rows are multiplied: overlap counts
accumulate over columns (common columns as a dense product, rare ones by their pairs), pairs of impossible sizes are
discarded, the rest are decided by the exact count. Only a spanning forest of each block pair's links leaves it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeatlas.llm.components import components, forest
from edgeatlas.llm.session import cut, drop, small_batches
from edgeatlas.llm.sketch import Sketch, at_least, levels
from edgeatlas.llm.words import Words, blocks, mix, raw

N, PERCENT = 5, 75
#: Document frequencies: one row of 2**27 cells of 4 bits, 64 MB. Clustered signatures: 2**27 cells of 1 bit, 16 MB.
FREQUENCY, CLUSTERED = Sketch(rows=1, cell_bits=27, times=15), Sketch(rows=1, cell_bits=27, times=1)
LEVELS = (1, 2, 3, 4, 5, 6, 8, 12, 16, 24, 32, 64, 96, 128, 255)
#: Entries that a chunk holds; sets and entries of a block at most (a larger single set is a block).
CHUNK, BLOCK_SETS, BLOCK_ENTRIES = 1 << 20, 1024, 1 << 20
#: Columns of at most this many sets are compared pair by pair before they form clusters.
PAIRED = 32
#: Bits of a bitmap: a power of two, about a set's size, within these.
LEAST_BITS, MOST_BITS = 64, 1 << 15
#: Columns of a block pair with this many rows or more are multiplied densely, so many at a time.
DENSE, COLUMNS = 24, 2048
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def shingle_sets(column: pa.Array, n: int = N) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, offsets, hashes) of runs of rows: each row's distinct shingle hashes, ascending. Fewer than n words: one shingle of all."""
    data, off = raw(column)
    for i, _, d, o in blocks(data, off):
        w = Words(d, o, lower=True)
        h = w.hashes()
        count = w.counts()
        at, win = w.windows(h, n)
        doc = w.doc_of(at)
        for k in range(1, n):
            short = np.flatnonzero(count == k)
            if len(short):
                a, x = w.windows(h, k)
                keep = np.isin(a, w.first[short])
                doc, win = np.concatenate([doc, w.doc_of(a[keep])]), np.concatenate([win, x[keep]])
        order = np.lexsort((win, doc))
        doc, win = doc[order], win[order]
        new = np.ones(len(win), bool)
        new[1:] = (win[1:] != win[:-1]) | (doc[1:] != doc[:-1])
        doc, win = doc[new], win[new]
        yield i, np.searchsorted(doc, np.arange(len(o))), win


def signatures(off: np.ndarray, h: np.ndarray) -> np.ndarray:
    """One number per set: a mixed sum over its hashes and its size; 0 for the empty set."""
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(h ^ _A), dtype=np.uint64)])
    size = np.diff(off)
    out = mix((sums[off[1:]] - sums[off[:-1]]) * _B + size.astype(np.uint64))
    out[size == 0] = 0
    return out.view(np.int64)


def bitmaps(off: np.ndarray, h: np.ndarray) -> list[bytes]:
    """A set's bitmap: at each of its positions whether an odd number of hashes falls there; the last bits of a hash are its position."""
    size, x = np.diff(off), mix(h ^ _B)
    bits = np.clip(1 << np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64), LEAST_BITS, MOST_BITS)
    at = np.concatenate([[0], np.cumsum(bits)])
    place = (x & np.repeat(bits - 1, size).astype(np.uint64)).astype(np.int64) + np.repeat(at[:-1], size)
    packed = np.packbits(np.bincount(place, minlength=int(at[-1])) & 1, bitorder="little").tobytes()
    return [packed[i // 8 : j // 8] for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def may_link(n: np.ndarray, m: np.ndarray, a: list[bytes], b: list[bytes], percent: int = PERCENT) -> np.ndarray:
    """Mask of pairs that sizes and bitmaps leave open: of n + m hashes as many at least are not shared as bits differ."""
    ok = 100 * np.minimum(n, m) >= percent * np.maximum(n, m)
    wide, near = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
    for w, v in sorted(set(zip(wide[ok].tolist(), near[ok].tolist(), strict=True))):
        at = np.flatnonzero(ok & (wide == w) & (near == v))
        x, y = (np.frombuffer(b"".join(c[i] for i in at), np.uint8).reshape(len(at), -1) for c in (a, b))
        least = min(w, v)  # the wider one folds onto the other's positions
        x, y = (np.bitwise_xor.reduce(z.reshape(len(at), -1, least), axis=1) for z in (x, y))
        differ = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
        both = n[at] + m[at]
        ok[at] = (100 + percent) * (both - differ) >= 2 * percent * both
    return ok


def column_pairs(c: np.ndarray, k: np.ndarray, a: np.ndarray, tied: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From rows of whole columns (column, size class, set, whether others are tied to the set): the pairs to compare, and the links
    that hold together what is not compared."""
    o = np.lexsort((~tied, a, k, c))
    c, k, a, tied = c[o], k[o], a[o], tied[o]
    new = np.ones(len(c), bool)
    new[1:] = (c[1:] != c[:-1]) | (a[1:] != a[:-1])
    c, k, a, tied = c[new], k[new], a[new], tied[new]
    start = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]])) if len(c) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(c)))
    few = np.repeat((size <= PAIRED) & (np.add.reduceat(tied.astype(np.int64), start) == 0 if len(start) else True), size)
    pairs = [np.zeros((0, 2), np.int64)]
    for d in range(1, min(PAIRED, len(c))):
        near = few[d:] & (c[d:] == c[:-d]) & (k[d:] - k[:-d] <= 1)
        if not near.any():
            break
        x, y = a[d:][near], a[:-d][near]
        pairs.append(np.stack([np.maximum(x, y), np.minimum(x, y)], 1))
    near = ~few[1:] & (c[1:] == c[:-1]) & (k[1:] - k[:-1] <= 1)
    chain = np.stack([a[1:][near], a[:-1][near]], 1)
    return np.unique(np.concatenate(pairs), axis=0), np.unique(chain, axis=0)


def _first_of(sig: np.ndarray, seen: set[int]) -> np.ndarray:
    """Mask of rows whose non-empty set this task has not met; ``seen`` is emptied when it grows large."""
    if len(seen) > 1 << 19:
        seen.clear()
    out = np.zeros(len(sig), bool)
    for i, s in enumerate(sig.tolist()):
        if s and s not in seen:
            seen.add(s)
            out[i] = True
    return out


def _chunks(batches: Iterator[pa.RecordBatch], at: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(signatures, sizes, concatenated hashes) of the distinct sets of a task, chunk by chunk."""
    seen: set[int] = set()
    held, n = [], 0
    for batch in batches:
        for _, off, h in shingle_sets(batch.column(at)):
            sig, size = signatures(off, h), np.diff(off)
            new = _first_of(sig, seen)
            held.append((sig[new], size[new], h[np.repeat(new, size)]))
            n += len(held[-1][2])
            if n >= CHUNK:
                yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
                held, n = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def size_class(n: np.ndarray) -> np.ndarray:
    """Sizes that a link can join lie in one class or in neighbouring ones (1.34 is a little over 100 / 75)."""
    return np.floor(np.log(n) / np.log(1.34)).astype(np.int32)


def block_links(sig: np.ndarray, sets: list[np.ndarray], side: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Indices of linked rows. ``side``: 0 or 1; where both occur, only pairs across are asked for."""
    m = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    entry, row = np.concatenate(sets), np.repeat(np.arange(m), size)
    order = np.argsort(entry, kind="stable")
    entry, row = entry[order], row[order]
    start = np.flatnonzero(np.concatenate([[True], entry[1:] != entry[:-1]]))
    freq = np.diff(np.append(start, len(entry)))
    overlap = np.zeros((m, m), np.float32)
    common = np.flatnonzero(freq >= DENSE)
    for i in range(0, len(common), COLUMNS):
        cols = common[i : i + COLUMNS]
        a = np.zeros((m, len(cols)), np.float32)
        at = np.concatenate([np.arange(start[c], start[c] + freq[c]) for c in cols])
        a[row[at], np.repeat(np.arange(len(cols)), freq[cols])] = 1
        overlap += a @ a.T
    few = np.repeat((freq < DENSE) & (freq > 1), freq)
    r, group = row[few], np.repeat(np.arange(len(freq)), freq)[few]
    flat = overlap.reshape(-1)
    for d in range(1, DENSE):
        same = np.flatnonzero(group[d:] == group[:-d]) if d < len(group) else []
        if not len(same):
            break
        p, c = np.unique(r[same] * m + r[same + d], return_counts=True)
        flat[p] += c
    overlap = np.triu(overlap, 1)
    x, y = np.nonzero(overlap)
    both = len(np.unique(side)) > 1
    ok = 100 * np.minimum(size[x], size[y]) >= percent * np.maximum(size[x], size[y])
    if both:
        ok &= side[x] != side[y]
    x, y = x[ok], y[ok]
    o = np.rint(overlap[x, y]).astype(np.int64)
    ok = 100 * o >= percent * (size[x] + size[y] - o)
    return x[ok], y[ok]


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id: documents linked at Jaccard 0.75 of their 5-word shingles, directly or through others.

    Null and empty texts have no shingles and stay alone; a text of one to four words is one shingle; equal sets are linked
    whatever their texts; rows with a null doc_id take part and get the smallest non-null id of their component, if any;
    an empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig, size, maps = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
            for _, off, h in shingle_sets(batch.column(1)):
                sig.append(signatures(off, h))
                size.append(np.diff(off))
                maps += bitmaps(off, h)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(size)), pa.array(np.concatenate(sig)), pa.array(maps, pa.binary())], names=["doc_id", "n_shingles", "sig", "bits"])

    written = cut(d.mapInArrow(sign, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, n_shingles long, sig long, bits binary"), "signed")
    signed = written.drop("bits")
    texts = d.select("text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, h in _chunks(batches):
            yield FREQUENCY.partial(h)

    often = FREQUENCY.total(spark, texts.mapInArrow(count, "shard int, cells binary"), levels(LEVELS), 4)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(often.value, np.uint8)
        for sig, size, h in _chunks(batches):
            level = FREQUENCY.nibble(table, h)
            row = np.repeat(np.arange(len(sig)), size)
            order = np.lexsort((h, level, row))
            rank = np.arange(len(h)) - np.repeat(np.cumsum(size) - size, size)
            keep = np.repeat(size - -(-PERCENT * size // 100) + 1, size)
            chosen = order[(rank < keep) & (level[order] > 1)]
            # of a column's rows of one size class, one goes on where they are many; the others are tied to it here
            c, r = h[chosen], row[chosen]
            k = size_class(size)[r]
            o = np.lexsort((r, k, c))
            c, r, k = c[o], r[o], k[o]
            lead = np.ones(len(c), bool)
            lead[1:] = (c[1:] != c[:-1]) | (k[1:] != k[:-1])
            run = np.cumsum(lead) - 1
            to, many = r[lead][run] if len(c) else r, (np.bincount(run) > PAIRED)[run] if len(c) else lead
            on, off = ~many | lead, many & ~lead
            pair = np.unique(np.stack([sig[to[off]], sig[r[off]]], 1), axis=0) if off.any() else np.zeros((0, 2), np.int64)
            # class: twice the size class, and 1 where others are tied to the set; -1: a link of two sets
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([c[on].view(np.int64), pair[:, 0]])), pa.array(np.concatenate([sig[r[on]], pair[:, 1]])), pa.array(np.concatenate([2 * k[on] + many[on], np.full(len(pair), -1)]).astype(np.int32))],
                names=["column", "a", "class"],
            )

    def columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = []
        for batch in batches:
            c, a, k = (x.to_numpy(zero_copy_only=False) for x in batch.columns)
            link = k < 0
            if link.any():
                yield _pairs(np.stack([a[link], c[link]], 1), False)
            got.append((c[~link], k[~link], a[~link]))
        if got:
            c, k, a = (np.concatenate(x) for x in zip(*got, strict=True))
            pairs, chain = column_pairs(c, k >> 1, a, (k & 1) > 0)
            yield _pairs(pairs, True)
            yield _pairs(chain, False)

    def open_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n, m = (x.to_numpy(zero_copy_only=False) for x in batch.columns[:4])
            ok = may_link(n, m, batch.column(4).to_pylist(), batch.column(5).to_pylist())
            yield _pairs(np.stack([a[ok], b[ok]], 1))

    rows = texts.mapInArrow(prefixes, "column long, a long, class int")
    met = cut(rows.repartition("column").mapInArrow(columns, "a long, b long, compare boolean"), "met")
    maps = written.where("sig != 0").groupBy("sig").agg(F.first("n_shingles").alias("n"), F.first("bits").alias("bits"))
    side = lambda s, n: maps.select(F.col("sig").alias(s), F.col("n").alias(n), F.col("bits").alias(f"bits_{s}"))
    pairs = met.where("compare").select("a", "b").distinct().join(side("a", "n"), "a").join(side("b", "m"), "b").select("a", "b", "n", "m", "bits_a", "bits_b")
    candidates = pairs.mapInArrow(open_pairs, "a long, b long").unionByName(met.where("not compare").select("a", "b"))
    clusters = cut(components(candidates).select(F.col("node").alias("sig"), F.col("component").alias("cluster")), "clusters")
    often.destroy()  # what it served is written
    drop(spark, met)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield CLUSTERED.partial(mix(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)))

    inside = CLUSTERED.total(spark, clusters.select("sig").mapInArrow(mark, "shard int, cells binary"), at_least(1), 1)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(inside.value, np.uint8)
        for sig, size, h in _chunks(batches):
            end = np.cumsum(size)
            take = np.flatnonzero(CLUSTERED.bit(table, mix(sig.view(np.uint64))))
            for i in range(0, len(take), 256):
                some = take[i : i + 256]
                yield pa.RecordBatch.from_arrays([pa.array(sig[some]), pa.array(size[some].astype(np.int32)), pa.array([h[end[j] - size[j] : end[j]].tobytes() for j in some], pa.binary())], names=["sig", "n", "entries"])

    # blocks: a cluster's sets are dealt by their signature's hash; a job is a pair of blocks
    size = signed.where("sig != 0").groupBy("sig").agg(F.first("n_shingles").alias("n"))
    per = clusters.join(size, "sig").groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_ENTRIES), F.lit(1)).cast("int").alias("n_blocks"))
    where = clusters.join(per, "cluster").select("sig", "cluster", "n_blocks", F.pmod(F.xxhash64("sig"), F.col("n_blocks")).cast("int").alias("block"))
    held = texts.mapInArrow(sets, "sig long, n int, entries binary").join(where, "sig")
    other = F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))
    jobs = held.withColumn("other", other).select("cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "sig", "block", "entries")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}

        def done():
            sig = np.array(list(held), np.int64)
            x, y = block_links(sig, [np.frombuffer(e, np.uint64) for _, e in held.values()], np.array([b for b, _ in held.values()]))
            return _pairs(np.array(forest(sig[x], sig[y]), np.int64).reshape(-1, 2))

        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))
            for key, s, b, e in zip(keys, batch.column(3).to_pylist(), batch.column(4).to_pylist(), batch.column(5), strict=True):
                if key != now:
                    if len(held) > 1:
                        yield done()
                    now, held = key, {}
                held[s] = (b, e.as_py())
        if len(held) > 1:
            yield done()

    links = jobs.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j").mapInArrow(multiply, "a long, b long")
    joined = components(links)
    inside.destroy()
    named = signed.join(joined, signed.sig == joined.node, "left").select("doc_id", "n_shingles", "sig", F.coalesce("component", "sig").alias("root"))
    ids = named.where("sig != 0").groupBy("root").agg(F.min("doc_id").alias("least"))
    alone = named.where("sig = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return named.where("sig != 0").join(ids, "root").select("doc_id", "n_shingles", F.col("least").alias("component_id")).unionByName(alone)


def _pairs(p: np.ndarray, compare: bool | None = None) -> pa.RecordBatch:
    more = [] if compare is None else [pa.array(np.full(len(p), compare))]
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(p[:, 0])), pa.array(np.ascontiguousarray(p[:, 1])), *more], names=["a", "b", "compare"][: 2 + len(more)])


def op9_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i+4], ' ') AS g FROM w, LATERAL (SELECT UNNEST(range(1, GREATEST(len(ws) - 3, 2))) AS i) WHERE len(ws) > 0),
n AS (SELECT doc_id, COUNT(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, COUNT(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM o JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * o >= 75 * (a.n + b.n - o)),
both_ways AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
reach AS (SELECT x, x AS r FROM (SELECT DISTINCT x FROM both_ways) UNION SELECT reach.x, b.y FROM reach JOIN both_ways b ON reach.r = b.x),
c AS (SELECT x, MIN(r) AS c FROM reach GROUP BY x)
SELECT w.doc_id, COALESCE(n.n, 0) AS n_shingles, COALESCE(c.c, w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.x = w.doc_id
"""
