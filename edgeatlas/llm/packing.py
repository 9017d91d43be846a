"""Best-fit packing of token pieces into sequences.

Lengths are small integers, so an instance is its histogram: at most ``capacity`` classes, whatever the number of
documents. ``plan`` reduces it by Martello-Toth dominance (a largest piece whose best single partner fills the sequence, or
beside which at most one more piece fits, is fixed with that partner, as often as both classes last), then packs the
remainder best-fit decreasing. Pieces are dealt to the plan's slots by their rank within their length class, which is computed
in salted parts so that a common length is nobody's hot key.
"""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgeatlas.llm.session import cut, release, small_batches

CAPACITY, END = 1024, 2
TOKENIZER = "byte_bpe_50k.json"
#: Fixed value: how byte-level pre-tokenizers split a text.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PROBES = ("it's we'll  a b\n\n c \t d12 3.5%", "Éai les öffnete ñ ç \u00a0 \u200b 你好 🙂", "x" * 300, "<|endoftext|> <|endoftext|>", "", "  \n ")
#: Pieces of one length that one task ranks, about; rows of a table that is broadcast, at most.
SALTED, BROADCAST_ROWS = 1 << 20, 1 << 17


# ---- tokens

class Encoder:
    """Ids of whole texts as uint32 bytes.

    The tokenizer file's own vocabulary, where ids are merge ranks, also drives the faster rank encoder of ``tiktoken``; both
    give the same ids for texts without added tokens, which is checked on ``PROBES`` at the start. Where they differ, a text is too
    much for the faster one, or it holds one of the file's added tokens, the tokenizer itself encodes, as loaded.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.fast = self._ranks(path)
        if self.fast and any(self.fast(t) != self.slow(t) for t in PROBES if not self.holds_added(t)):
            self.fast = None

    def _ranks(self, path: str):
        import json

        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"].get("type", "BPE") != "BPE" or spec.get("normalizer") or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space"):
            return None
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
        special = {x["content"] for x in spec.get("added_tokens", [])}
        ranks = {bytes(byte_of[c] for c in k): v for k, v in spec["model"]["vocab"].items() if k not in special}
        if sorted(ranks.values()) != list(range(len(ranks))):
            return None
        return tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def holds_added(self, text: str) -> bool:
        return any(t in text for t in self.added)

    def slow(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def encode(self, text: str) -> array:
        if self.fast and not self.holds_added(text):
            try:
                return array("I", self.fast(text))
            except (ValueError, RuntimeError, OverflowError):
                pass
            except BaseException as e:  # its library panics on white space without end, which is no Exception
                if type(e).__name__ != "PanicException":
                    raise
        return array("I", self.slow(text))


def cut_points(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: a shorter first piece, if any, then full ones."""
    head = n % capacity or min(n, capacity)
    return [(0, head)] + [(s, capacity) for s in range(head, n, capacity)]


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenize(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32. A null text is empty; every document ends with id ``end``."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(path or tokenizer_path())
        types = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        for batch in batches:
            rows: list[tuple] = []
            for d, text in enumerate(batch.column(1)):
                ids = enc.encode(text.as_py() or "")
                ids.append(end)
                view = memoryview(ids).cast("B")
                rows += [(d, k, s, n, zlib.crc32(view[4 * s : 4 * (s + n)])) for k, (s, n) in enumerate(cut_points(len(ids), capacity))]
            if rows:
                of, *columns = (pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(of), *columns], names=["doc_id", "piece", "start", "length", "ids_crc32"])
        del enc
        release()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


# ---- the plan

def reduce_dominated(hist: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Sets that some optimal packing contains, and what they leave. Lengths from the largest down.

    For a largest piece j: no piece fits beside it, j stays alone; if its largest fitting partner fills the sequence, or no two
    pieces fit beside j, {j, partner} dominates every set with j; if two but not three fit, and the partner is at least as long
    as the longest fitting pair, it does too.
    """
    left = {k: v for k, v in hist.items() if v > 0}
    lengths = sorted(left)
    fixed: list[tuple[tuple[int, ...], int]] = []
    for j in sorted(left, reverse=True):
        while left.get(j):
            room = capacity - j
            others = lengths[: bisect_left(lengths, room + 1)]
            others = [x for x in others if left[x] - (x == j) > 0]
            if not others:
                fixed.append(((j,), left[j]))
                take = {j: left[j]}
            else:
                best = others[-1]
                three = []
                for x in others:
                    three += [x] * min(3, left[x] - (x == j))
                    if len(three) >= 3:
                        break
                one_fits = len(three) < 2 or sum(three[:2]) > room
                two_fit = not one_fits and (len(three) < 3 or sum(three[:3]) > room)
                if not (best == room or one_fits or two_fit and best >= longest_pair(others, left, j, room)):
                    break
                n = left[j] // 2 if best == j else min(left[j], left[best])
                n = max(1, n) if best == room or one_fits else 1
                fixed.append(((j, best), n))
                take = {j: 2 * n} if best == j else {j: n, best: n}
            for x, n in take.items():
                left[x] -= n
            lengths = [x for x in lengths if left[x] > 0]
    return fixed, {k: v for k, v in left.items() if v > 0}


def longest_pair(others: list[int], left: dict[int, int], j: int, room: int) -> int:
    """Longest sum of two pieces within ``room``, of those still left beside j."""
    most, lo, hi = 0, 0, len(others) - 1
    while lo <= hi:
        s = others[lo] + others[hi]
        if lo == hi and left[others[lo]] - (others[lo] == j) < 2:
            break
        if s <= room:
            most, lo = max(most, s), lo + 1
        else:
            hi -= 1
    return most


def best_fit(hist: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over classes: equal pieces go together into the fullest open sequences that take them."""
    open_by: dict[int, Counter] = {}  # free room -> contents -> how many
    rooms: list[int] = []

    def put(room: int, what: tuple[int, ...], n: int) -> None:
        if room not in open_by:
            open_by[room] = Counter()
            insort(rooms, room)
        open_by[room][what] += n

    for j in sorted(hist, reverse=True):
        n = hist[j]
        while n:
            i = bisect_left(rooms, j)
            if i == len(rooms):
                fit = capacity // j
                if n >= fit:
                    put(capacity - fit * j, (j,) * fit, n // fit)
                if n % fit:
                    put(capacity - n % fit * j, (j,) * (n % fit), 1)
                break
            room = rooms[i]
            what, have = open_by[room].popitem()
            fit = max(1, min(room // j, n // have))
            used = min(have, n // fit)
            if have > used:
                open_by[room][what] = have - used
            if not open_by[room]:
                del open_by[room], rooms[i]
            put(room - fit * j, what + (j,) * fit, used)
            n -= used * fit
    return [(what, n) for c in open_by.values() for what, n in c.items()]


def plan(hist: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in one sequence, how many such sequences)."""
    fixed, rest = reduce_dominated(hist, capacity)
    return fixed + best_fit(rest, capacity)


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, last rank + 1, sequence of the first rank, offset): which ranks of a length go where."""
    used: Counter = Counter()
    out, sequence = [], 0
    for what, n in patterns:
        at = 0
        for x in what:
            out.append((x, used[x], used[x] + n, sequence, at))
            used[x] += n
            at += x
        sequence += n
    return out


# ---- ranks and slots, distributed

def _met(rows: DataFrame, table: DataFrame, n: int, on) -> DataFrame:
    """``rows`` with the ``n`` rows of ``table``: broadcast up to a size, dealt by the key beyond it."""
    return rows.join(F.broadcast(table) if n <= BROADCAST_ROWS else table, on)


def rank_in_class(pieces: DataFrame, hist: dict[int, int], salted: int = SALTED) -> DataFrame:
    """``rank``: 0.. within each length, in parts by a hash of the document; a length has parts in proportion to its pieces."""
    spark = pieces.sparkSession
    sizes = spark.createDataFrame([(x, 16 + n // salted) for x, n in hist.items()], "__len long, __salts long")  # at most ``capacity`` rows
    p = pieces.join(F.broadcast(sizes), F.col("length") == F.col("__len")).withColumn("__salt", F.pmod(F.xxhash64("doc_id", "piece"), F.col("__salts"))).drop("__len", "__salts")
    part = p.groupBy("length", "__salt").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    part = part.withColumn("__base", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    order = Window.partitionBy("length", "__salt").orderBy("doc_id", "piece", "ids_crc32")
    p = p.withColumn("__in", F.row_number().over(order) - 1)
    parts = sum(16 + n // salted for n in hist.values())
    return _met(p, part.select("length", "__salt", "__base"), parts, ["length", "__salt"]).withColumn("rank", F.col("__base") + F.col("__in")).drop("__salt", "__base", "__in")


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece of every document.

    Nulls and empty texts are one-token documents; repeated rows are packed each; an empty table gives an empty result.
    Only doc_id, of any type, and text are read. The histogram that reaches the driver has at most ``capacity`` rows.
    """
    spark = docs.sparkSession
    pieces = cut(tokenize(docs, path, capacity, end), "pieces")
    hist = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    rows = slots(plan(hist, capacity))
    # at most a few slots per pattern, and patterns grow with the capacity's classes, not with the documents
    table = spark.createDataFrame(rows, "__len long, __lo long, __hi long, __seq long, __at long")
    per = table.groupBy("__len").agg(F.sort_array(F.collect_list(F.struct("__lo", "__hi", "__seq", "__at"))).alias("__slots"))
    joined = _met(rank_in_class(pieces, hist), per, len(rows), F.col("length") == F.col("__len"))
    slot = F.element_at(F.filter("__slots", lambda s: (s["__lo"] <= F.col("rank")) & (F.col("rank") < s["__hi"])), 1)
    return joined.withColumn("__s", slot).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("__s.__seq") + F.col("rank") - F.col("__s.__lo")).alias("sequence_id"), F.col("__s.__at").alias("offset"))


def op10_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
