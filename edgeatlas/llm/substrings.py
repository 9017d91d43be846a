"""Substring dedup: words inside windows of ``k`` words that occur more than once, found through a count-min prefilter.

Pass 1 sketches: every chunk of windows writes its cells (sorted, delta-coded, a cell met twice written twice) by shard; the
shards are summed where they meet and become one bit per cell, "two or more". Pass 2 exactly groups only windows all of whose cells
have that bit: a sketch only overestimates, so no repeated window is lost. A window stands as a 64-bit and an independent 32-bit hash there:
that any two of 10**13 different windows fall together has a probability under 10**-3. A window repeated within a chunk is settled there
and represented by one row, so a passage in every document costs a row per chunk. Windows are dealt to as many buckets as the
sketch's counts call for. Pass 3 removes the covered words; only texts whose document's bit is set in a filter of fixed size
are shuffled to meet their places, the others are finished where they are read.

The sketch has 2 rows of 2**29 cells, 128 MB of bits, whatever the corpus. Beyond some 10**9 windows it lets more windows through
(at worst all, which is plain exact grouping); results never depend on it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeatlas.llm.session import cut, release, small_batches
from edgeatlas.llm.sketch import Sketch, at_least, decode, encode
from edgeatlas.llm.words import Words, blocks, covered, mix, raw

WINDOW = 35
SKETCH = Sketch(rows=2, cell_bits=29, shard_bits=23)
#: Documents with repeated windows: one row of 2**27 bits, 16 MB.
MARKED = Sketch(rows=1, cell_bits=27, times=1)
#: Windows that one chunk sketches (more make its cells denser and their differences shorter), windows let through that one
#: chunk of pass 2 holds, and rows that a bucket of pass 2 is meant for.
SKETCH_CHUNK, CHUNK, BUCKET = 1 << 21, 1 << 20, 1 << 20
#: In place of a start word: a window met more than once in its chunk, whose places are settled there.
REPEATED = -1
Places = tuple[np.ndarray, np.ndarray, np.ndarray]


def window_hashes(column: pa.Array, k: int, both: bool = False) -> Iterator[tuple[np.ndarray, ...]]:
    """(row in the batch, start word, hash) of the windows of a column, a few MB of text at a time; with ``both`` the second hash, too."""
    data, off = raw(column)
    for i, _, d, o in blocks(data, off):
        w = Words(d, o)
        at, h = w.windows(w.hashes(), k)
        doc = w.doc_of(at)
        second = ((w.windows(w.hashes(1), k, 1)[1] >> np.uint64(32)).astype(np.uint32),) if both else ()
        yield i + doc, at - w.first[doc], h, *second


def repeated_starts(docs: DataFrame, k: int = WINDOW) -> DataFrame:
    """(key, key2, starts): for each document with repeated windows, their start words (int32). ``docs`` has key, key2 (its name) and text."""
    spark = docs.sparkSession

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for _, _, h in window_hashes(batch.column(2), k):
                held.append(h)
                n += len(h)
                if n >= SKETCH_CHUNK:
                    yield SKETCH.partial(np.concatenate(held))
                    held, n = [], 0
        if n:
            yield SKETCH.partial(np.concatenate(held))
        del held
        release()

    bits, through = SKETCH.totals(spark, docs.mapInArrow(sketch, "shard int, cells binary"), at_least(2), 1)
    n_buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-through // BUCKET))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(bits.value, np.uint8)
        held: list[tuple[np.ndarray, ...]] = []
        n = 0

        def flush():
            key, key2, at, h, h2 = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((h2, h))
            new = np.ones(len(h), bool)
            new[1:] = (h[order][1:] != h[order][:-1]) | (h2[order][1:] != h2[order][:-1])
            size = np.diff(np.append(np.flatnonzero(new), len(h)))
            many, first = np.zeros(len(h), bool), np.zeros(len(h), bool)
            many[order], first[order] = np.repeat(size > 1, size), new
            yield _batch(*_settled((key[many], key2[many], at[many]), n_buckets), True)
            yield _batch(*_counted(h, h2, (key, key2, at), ~many, many & first, n_buckets), False)

        for batch in batches:
            keys, keys2 = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            for doc, at, h, h2 in window_hashes(batch.column(2), k, both=True):
                ok = SKETCH.bit(table, h)
                held.append((keys[doc[ok]], keys2[doc[ok]], at[ok], h[ok], h2[ok]))
                n += int(ok.sum())
                if n >= CHUNK:
                    yield from flush()
                    held, n = [], 0
        if n:
            yield from flush()
        held = []
        release()

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        for batch in batches:
            settled = batch.column(2)
            yield batch.filter(settled)
            for b, blob in zip(*(c.to_pylist() for c in batch.filter(pc.invert(settled)).columns[:2]), strict=True):
                held.setdefault(b, []).append(blob)
        for b in list(held):
            parts = [_uncounted(x) for x in held.pop(b)]
            h, h2, key, key2, at = (np.concatenate(x) for x in zip(*parts, strict=True))
            del parts
            order = np.lexsort((h2, h))
            h, h2, at = h[order], h2[order], at[order]
            start = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (h2[1:] != h2[:-1])])) if len(h) else np.zeros(0, np.int64)
            weight = np.add.reduceat(np.where(at == REPEATED, 2, 1), start) if len(h) else start
            many = np.repeat(weight > 1, np.diff(np.append(start, len(h)))) & (at >= 0)
            place = order[many]
            yield _batch(*_settled((key[place], key2[place], at[many]), n_buckets), True)
        release()

    def regroup(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [_unpacked(x.as_py()) for batch in batches for x in batch.column(1)]
        if parts:
            key, key2, at = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((at, key2, key))
            key, key2, at = key[order], key2[order], at[order].astype(np.int32)
            first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (key2[1:] != key2[:-1])]))
            ends = np.append(first[1:], len(key))
            for i in range(0, len(first), 1024):
                s, e = first[i : i + 1024], ends[i : i + 1024]
                yield pa.RecordBatch.from_arrays([pa.array(key[s]), pa.array(key2[s]), pa.array([at[a:b].tobytes() for a, b in zip(s, e, strict=True)], pa.binary())], names=["key", "key2", "starts"])

    kind = "bucket long, blob binary, settled boolean"
    rows = docs.mapInArrow(candidates, kind).repartition(n_buckets, "bucket")
    out = cut(rows.mapInArrow(exact, kind).repartition(n_buckets, "bucket").mapInArrow(regroup, "key long, key2 long, starts binary"), "starts")
    bits.destroy()
    return out


def _batch(bucket: np.ndarray, blob: list[bytes], settled: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array(blob, pa.binary()), pa.array([settled] * len(blob), pa.bool_())], names=["bucket", "blob", "settled"])


def _packed(places: Places) -> bytes:
    """Places as bytes: document keys once per run of ascending start words, run lengths, delta-coded starts."""
    key, key2, at = (x.astype(np.int64, copy=False) for x in places)
    runs = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (key2[1:] != key2[:-1]) | (at[1:] < at[:-1])])) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.append(runs, len(key)))
    last = at[np.append(runs[1:], len(at)) - 1] if len(runs) else runs
    shift = np.concatenate([[0], np.cumsum(last)])[: len(runs)]
    head = np.array([len(key), len(runs)], np.int64)
    return head.tobytes() + key[runs].tobytes() + key2[runs].tobytes() + size.tobytes() + encode(at + np.repeat(shift, size))


def _unpacked(blob: bytes) -> Places:
    n, runs = np.frombuffer(blob, np.int64, 2).tolist()
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    key, key2, size = (np.frombuffer(blob, np.int64, runs, 16 + 8 * i * runs) for i in range(3))
    moved = decode(blob[16 + 24 * runs :])
    last = np.diff(moved[np.cumsum(size) - 1], prepend=0)  # a run's last start, as the next run's shift grew by it
    return np.repeat(key, size), np.repeat(key2, size), moved - np.repeat(np.concatenate([[0], np.cumsum(last)])[:runs], size)


def _parts(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(bucket, first, end) of ascending buckets' runs."""
    if len(bucket):
        bounds = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
        yield from zip(bucket[bounds[:-1]].tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)


def _settled(places: Places, buckets: int) -> tuple[list[int], list[bytes]]:
    """Places dealt by document: a blob for each bucket that has any."""
    key, key2, at = places
    bucket = (key.view(np.uint64) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((at, key2, key, bucket))
    key, key2, at = key[order], key2[order], at[order]
    got = [(b, _packed((key[i:j], key2[i:j], at[i:j]))) for b, i, j in _parts(bucket[order])]
    return [b for b, _ in got], [x for _, x in got]


def _counted(h: np.ndarray, h2: np.ndarray, places: Places, once: np.ndarray, stands: np.ndarray, buckets: int) -> tuple[list[int], list[bytes]]:
    """Windows to be counted, dealt by hash, in text order: their places, then all hashes.

    ``once`` are windows met once here, ``stands`` one place of each window met more often; the latter carry no place.
    """
    take = np.flatnonzero(once | stands)
    bucket = (mix(h[take]) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((stands[take], bucket))
    take, bucket = take[order], bucket[order]
    out = []
    for b, i, j in _parts(bucket):
        t = take[i:j]
        single = t[once[t]]
        out.append((b, np.array([len(t)], np.int64).tobytes() + h[t].tobytes() + h2[t].tobytes() + _packed(tuple(x[single] for x in places))))
    return [b for b, _ in out], [x for _, x in out]


def _uncounted(blob: bytes) -> tuple[np.ndarray, ...]:
    """(hash, second hash, key, key2, start) of ``_counted``'s windows; ``REPEATED`` in place of a start where there is none."""
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    h, h2 = np.frombuffer(blob, np.uint64, n, 8), np.frombuffer(blob, np.uint32, n, 8 + 8 * n)
    key, key2, at = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, REPEATED, np.int64)
    single = _unpacked(blob[8 + 12 * n :])
    m = len(single[0])
    key[:m], key2[:m], at[:m] = single
    return h, h2, key, key2, at


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = WINDOW, texts: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept: every row once, with the words that stay, joined by a space (``texts``: false leaves it out).

    A null text has no words, a text of fewer than ``k`` words has no windows, rows with one id and text are each other's
    copies, an empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    d = d.select(F.xxhash64("doc_id", "text").alias("key"), F.xxhash64(F.lit(k), "text", "doc_id").alias("key2"), "text", "doc_id")
    starts = repeated_starts(d.select("key", "key2", "text"), k)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield MARKED.partial(batch.column(0).to_numpy().view(np.uint64))

    marked = MARKED.total(spark, starts.select("key").mapInArrow(mark, "shard int, cells binary"), at_least(1), 1)
    names = ["n_words", "n_removed", "kept_sha256", *(["kept"] if texts else [])]
    types = dict(zip(names, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=False))
    kind = f"doc_id {docs.schema[doc_id].dataType.simpleString()}, n_words long, n_removed long, kept_sha256 string" + (", kept string" if texts else "")

    def finished(ids: pa.Array, column: pa.Array, places: list[bytes | None]) -> pa.RecordBatch:
        rows = []
        for t, starts in zip(column, places, strict=True):
            words = (t.as_py() or "").encode().split()
            kept = words
            if starts is not None:
                gone = covered(np.frombuffer(starts, np.int32), k, len(words))
                kept = [w for w, x in zip(words, gone.tolist(), strict=True) if not x]
            whole = b" ".join(kept)
            rows.append((len(words), len(words) - len(kept), hashlib.sha256(whole).hexdigest(), whole.decode() if texts else None))
        return pa.RecordBatch.from_arrays([ids, *(pa.array([r[i] for r in rows], t) for i, t in enumerate(types.values()))], names=["doc_id", *names])

    def has_mark(batch: pa.RecordBatch) -> np.ndarray:
        return MARKED.bit(np.frombuffer(marked.value, np.uint8), batch.column(0).to_numpy().view(np.uint64))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = batch.filter(pa.array(~has_mark(batch)))
            yield finished(rest.column(3), rest.column(2), [None] * rest.num_rows)
        release()

    def to_meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(has_mark(batch)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield finished(batch.column(0), batch.column(1), batch.column(2).to_pylist())
        release()

    untouched = d.mapInArrow(whole, kind)
    some = d.mapInArrow(to_meet, d.schema).join(starts, ["key", "key2"], "left").select("doc_id", "text", "starts")
    return untouched.unionByName(some.mapInArrow(run, kind))


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), texts=False)


SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i+34], ' ')) AS h FROM w, LATERAL (SELECT UNNEST(range(1, len(ws) - 33)) AS i)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, COUNT(*) OVER (PARTITION BY h) AS n FROM win) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, i + o AS i FROM rep, (SELECT UNNEST(range(0, 35)) AS o)),
each AS (SELECT doc_id, i, ws[i] AS word FROM w, LATERAL (SELECT UNNEST(range(1, len(ws) + 1)) AS i)),
kept AS (SELECT e.doc_id, string_agg(e.word, ' ' ORDER BY e.i) AS t, COUNT(*) AS n FROM each e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.i = g.i GROUP BY e.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - COALESCE(n, 0) AS BIGINT) AS n_removed, sha256(COALESCE(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
