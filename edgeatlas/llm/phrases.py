"""Phrase collocation mining by generalised suffix automata of bounded depth, one per shard.

Texts are pieces between punctuation marks, and pieces are words; everything is counted per language. Three scans, each less selective
than a phrase needs: words are counted; pairs of words that reach the least count are counted by a hash; then a shard's
pieces, cut wherever a word or a pair of neighbours is too rare to be in any candidate, go through an automaton that enumerates their
phrases with the sizes of their endpos sets. Counts of shards are summed globally, so a count is exact whatever the shards are. Both
filters are bits of hashes, sized by what passed: they may let more through, never less.

The automaton of a shard is truncated at the longest phrase and built level by level with sorts: a state is a class of
substrings with one endpos set, represented by its longest, and its suffix link leads to the longest suffix that ends in more places.
The reduced table has the same links: dropping a candidate's first word follows one, dropping its last goes back along a transition.
Whatever contains a phrase contains it through a phrase one word longer that is at least as frequent, so these two steps decide subsumption.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from edgeatlas.llm.session import cut, drop, release
from edgeatlas.llm.sketch import Sketch, at_least
from edgeatlas.llm.words import Words, blocks, mix, raw

LEAST, LONGEST, TOP = 30, 4, 2000
#: A phrase is subsumed by a longer one with at least this share of its occurrences, in per cent.
SUBSUMED = 80
#: Words of one shard, about: those counted at once, those of one automaton.
COUNTED, SHARD = 1 << 21, 1 << 20
#: Cells of a filter: 32 for every hash in it, between these powers of two (2**30 cells are 128 MB).
CELL_BITS = (20, 30)
#: Single words are looked up under so many salts: a common word begins or ends a large share of all candidates.
SALTS = 32

_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = True
_INSIDE = ~_BREAK
_INSIDE[[0x20, 0x09]] = False
_NAMES = ["lang", "phrase", "n"]
COUNTS = "lang string, phrase string, n long"


def lang_hash(lang: str) -> np.uint64:
    return np.frombuffer(hashlib.sha256(lang.encode()).digest()[:8], np.uint64)[0]


@dataclass
class Run:
    """Words of a few MB of texts of one batch: their bytes, languages (codes), and whether a word follows the one before it in its piece."""

    words: Words
    lang: np.ndarray
    follows: np.ndarray

    def strings(self, at: np.ndarray) -> pa.Array:
        """The words with these indices."""
        start, size = self.words.start[at], self.words.end[at] - self.words.start[at]
        off = np.zeros(len(at) + 1, np.int64)
        np.cumsum(size, out=off[1:])
        take = np.repeat(start - off[:-1], size) + np.arange(off[-1])
        return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(self.words.data[take])))


def runs(batch: pa.RecordBatch, langs: dict[str, int]) -> Iterator[Run]:
    """The words of a batch of (lang, text); ``langs`` numbers the languages met."""
    named = batch.column(0).dictionary_encode()
    code = np.array([langs.setdefault(x, len(langs)) for x in named.dictionary.to_pylist()], np.int64)
    of_doc = code[named.indices.to_numpy()] if len(code) else np.zeros(0, np.int64)
    data, off = raw(batch.column(1))
    for i, j, d, o in blocks(data, off):
        w = Words(d, o, lower=True, inner=_INSIDE)
        n = len(w.start)
        if not n:
            continue
        breaks = np.zeros(len(d) + 1, np.int64)
        np.cumsum(_BREAK[d], out=breaks[1:])
        follows = np.zeros(n, bool)
        follows[1:] = breaks[w.start[1:]] == breaks[w.end[:-1]]
        follows[w.first[:-1][w.first[:-1] < n]] = False
        yield Run(w, np.repeat(of_doc[i:j], w.counts()), follows)


def word_hashes(run: Run, langs: dict[str, int]) -> np.ndarray:
    salt = np.array([lang_hash(x) for x in langs], np.uint64)
    return mix(run.words.hashes() ^ salt[run.lang])


def pair_hashes(h: np.ndarray) -> np.ndarray:
    """For every word but the last, the hash of it and the next."""
    return mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])


class Filter:
    """Bits of hashes, held by a broadcast."""

    def __init__(self, spark: SparkSession, hashes: DataFrame, n: int):
        bits = min(max(CELL_BITS[0], (32 * max(1, n) - 1).bit_length()), CELL_BITS[1])
        self.sketch = sketch = Sketch(rows=1, cell_bits=bits, shard_bits=min(bits, 23), times=1)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield sketch.partial(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))

        self.held = sketch.total(spark, hashes.mapInArrow(run, "shard int, cells binary"), at_least(1), 1)

    def passes(self, h: np.ndarray) -> np.ndarray:
        return self.sketch.bit(np.frombuffer(self.held.value, np.uint8), h)


# ---- first scan

def count_words(docs: DataFrame, held: int = COUNTED) -> DataFrame:
    """(lang, phrase, n): how often each word occurs. ``docs`` has lang and text, without nulls in lang."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs: dict[str, int] = {}
        parts: list[tuple[pa.Array, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            words = pa.chunked_array([p[0] for p in parts]).combine_chunks().dictionary_encode()
            key, n = np.unique(np.concatenate([p[1] for p in parts]) * len(words.dictionary) + words.indices.to_numpy(), return_counts=True)
            lang, word = np.divmod(key, len(words.dictionary))
            return pa.RecordBatch.from_arrays([pa.array(list(langs), pa.string()).take(pa.array(lang)), words.dictionary.take(pa.array(word)).cast(pa.string()), pa.array(n)], names=_NAMES)

        for batch in batches:
            for r in runs(batch, langs):
                parts.append((r.strings(np.arange(len(r.lang))), r.lang))
                size += len(r.lang)
                if size >= held:
                    yield flush()
                    parts, size = [], 0
        if parts:
            yield flush()
        release()

    return docs.select("lang", "text").mapInArrow(run, COUNTS).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def hash_words(words: DataFrame) -> DataFrame:
    """(h): the hashes by which ``word_hashes`` knows the words of (lang, phrase)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs: dict[str, int] = {}
        for batch in batches:
            for r in runs(batch, langs):
                yield pa.RecordBatch.from_arrays([pa.array(word_hashes(r, langs).view(np.int64))], names=["h"])

    return words.select("lang", "phrase").mapInArrow(run, "h long")


# ---- second scan

def count_pairs(docs: DataFrame, words: Filter, held: int = COUNTED) -> DataFrame:
    """(h, n): pairs of neighbours that may both be frequent, by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs: dict[str, int] = {}
        parts: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(parts), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

        for batch in batches:
            for r in runs(batch, langs):
                h = word_hashes(r, langs)
                ok = words.passes(h)
                parts.append(pair_hashes(h)[ok[:-1] & ok[1:] & r.follows[1:]])
                size += len(parts[-1])
                if size >= held:
                    yield flush()
                    parts, size = [], 0
        if parts:
            yield flush()
        release()

    return docs.select("lang", "text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


# ---- third scan

class Automaton:
    """Generalised suffix automaton, truncated at ``depth``, of words (dense numbers) in runs; ``left`` is how many words a run still has at each.

    Arrays by substring length k = 1..depth: ``at[k]`` a start of each substring, ``n[k]`` the size of its endpos set, ``suffix[k]``
    the substring without its first word, ``state[k]`` whether it is the longest of its class.
    """

    def __init__(self, words: np.ndarray, left: np.ndarray, depth: int):
        self.at, self.n, self.suffix, self.state = {}, {}, {}, {}
        n_words = int(words.max()) + 1 if len(words) else 1
        place, of = np.arange(len(words)), words.astype(np.int64)
        for k in range(1, depth + 1):
            if k > 1:
                more = left[place] >= k
                place = place[more]
                of = last[place] * n_words + words[place + k - 1]
            _, first, of, n = np.unique(of, return_index=True, return_inverse=True, return_counts=True)
            self.at[k], self.n[k] = place[first], n
            self.state[k] = np.ones(len(n), bool)
            if k > 1:
                self.suffix[k] = last[self.at[k] + 1]
                # equal sizes: the suffix always has this word before it, so both are of one class
                absorbed = self.suffix[k][n == self.n[k - 1][self.suffix[k]]]
                self.state[k - 1][absorbed] = False
            last = np.full(len(words) + 1, -1, np.int64)
            last[place] = of
        self.depth = depth

    def link(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Suffix links of the substrings of k words: length and number of the longest suffix with a larger endpos set (0, 0: the root)."""
        size, to = np.full(len(self.n[k]), k), np.arange(len(self.n[k]))
        own, moving = self.n[k], np.ones(len(self.n[k]), bool)
        for j in range(k, 0, -1):
            step = moving & (size == j)
            if j == 1:
                size[step], to[step] = 0, 0
                break
            to[step], size[step] = self.suffix[j][to[step]], j - 1
            moving &= ~(step & (self.n[j - 1][np.where(step, to, 0)] > own))
        return size, to

    def substrings(self, least: int = 2) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, starts, sizes of endpos sets): every state gives its longest substring and the suffixes down to its link's length."""
        for k in range(1, self.depth + 1):
            states = np.flatnonzero(self.state[k])
            shortest = self.link(k)[0][states] + 1
            for size in range(k, least - 1, -1):
                mine = states[shortest <= size]
                yield size, self.at[k][mine] + k - size, self.n[k][mine]


def count_phrases(docs: DataFrame, words: Filter, pairs: Filter, longest: int = LONGEST, shard: int = SHARD) -> DataFrame:
    """(lang, phrase, n): phrases of 2 to ``longest`` words whose words and neighbours pass both filters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs: dict[str, int] = {}
        parts: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            named = pa.chunked_array([p[0] for p in parts]).combine_chunks().dictionary_encode()
            lang, joined = np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])
            _, word = np.unique(lang * len(named.dictionary) + named.indices.to_numpy(), return_inverse=True)
            ends = np.append(np.flatnonzero(~joined)[1:], len(word))
            left = np.repeat(ends, np.diff(np.concatenate([[0], ends]))) - np.arange(len(word))
            for k, at, n in Automaton(word, left, longest).substrings():
                if len(at):
                    phrase = pc.binary_join_element_wise(*[named.dictionary.take(named.indices.take(pa.array(at + i))) for i in range(k)], pa.scalar(" ", pa.large_string()))
                    yield pa.RecordBatch.from_arrays([pa.array(list(langs), pa.string()).take(pa.array(lang[at])), phrase.cast(pa.string()), pa.array(n)], names=_NAMES)

        for batch in batches:
            for r in runs(batch, langs):
                h = word_hashes(r, langs)
                ok = words.passes(h)
                near = np.zeros(len(h) + 1, bool)
                at = np.flatnonzero(ok[:-1] & ok[1:] & r.follows[1:])
                near[1 + at] = pairs.passes(pair_hashes(h)[at])
                kept = np.flatnonzero(near[:-1] | near[1:])
                if len(kept):
                    parts.append((r.strings(kept), r.lang[kept], near[kept]))
                    size += len(kept)
                if size >= shard:
                    yield from flush()
                    parts, size = [], 0
        if parts:
            yield from flush()
        release()

    return docs.select("lang", "text").mapInArrow(run, COUNTS).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


# ---- the whole

def exact(column: str):
    return F.col(column).cast("decimal(38,0)")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, subsumed: int = SUBSUMED, lang: str = "lang", text: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` phrases by score, then a, then the phrase's bytes.

    A null language is ``und``, a null text empty; texts without words and empty tables give no rows. Repeated rows count as often as
    they occur, and other columns are not read. ``least`` is at least 2 (a phrase met once has no filter to pass). Two languages never mix.
    """
    spark = docs.sparkSession
    docs = docs.select(F.coalesce(lang, F.lit("und")).alias("lang"), F.col(text).alias("text"))
    words = cut(count_words(docs), "words")
    often = words.where(F.col("n") >= least)
    word_filter = Filter(spark, hash_words(often), often.count())
    pairs = cut(count_pairs(docs, word_filter).where(F.col("n") >= least).select("h"), "pairs")
    pair_filter = Filter(spark, pairs, pairs.count())
    found = cut(count_phrases(docs, word_filter, pair_filter, longest).where(F.col("n") >= least), "phrases")
    drop(spark, pairs)
    size = F.size(F.split("phrase", " "))
    longer = found.where(size > 2)
    shorter = lambda of: longer.select("lang", of.alias("phrase"), F.col("n").alias("m"))
    suffix, prefix = F.expr("substring(phrase, locate(' ', phrase) + 1)"), F.expr("substring_index(phrase, ' ', size(split(phrase, ' ')) - 1)")
    around = shorter(suffix).unionByName(shorter(prefix)).groupBy("lang", "phrase").agg(F.max("m").alias("m"))
    left = found.join(around, ["lang", "phrase"], "left").where(F.col("m").isNull() | (100 * exact("m") < subsumed * exact("n"))).drop("m")
    # both parts of every cut, looked up among words and phrases; words under salts
    salted = F.when(F.locate(" ", F.col("part")) == 0, F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).otherwise(0).cast("int")
    cuts = left.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1)))
    sides = F.array(F.struct(F.lit(True).alias("is_l"), F.expr("substring_index(phrase, ' ', k)").alias("part")), F.struct(F.lit(False).alias("is_l"), F.expr("substring_index(phrase, ' ', k - size(split(phrase, ' ')))").alias("part")))
    asked = cuts.select("lang", "phrase", F.col("n").alias("a"), "k", F.inline(sides)).withColumn("salt", salted)
    counts = often.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).unionByName(found.withColumn("salt", F.lit(0)))
    counts = counts.select("lang", F.col("phrase").alias("part"), "salt", F.col("n").alias("f"))
    of_cut = asked.join(counts, ["lang", "part", "salt"]).groupBy("lang", "phrase", "a", "k").agg(F.max(F.when(F.col("is_l"), F.col("f"))).alias("l"), F.max(F.when(~F.col("is_l"), F.col("f"))).alias("r"))
    of_cut = of_cut.withColumn("score", F.expr("cast(2000000 as decimal(10,0)) * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))").cast("long"))
    best = of_cut.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase"))).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", F.col("total").alias("n"), "cut.score")


def op11_phrase_mining(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""WITH p AS (SELECT COALESCE(lang, 'und') AS lang, row_number() OVER () AS d, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\x0C\r]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS w FROM p),
g AS (SELECT lang, unnest(list_transform(range(1, len(w) + 1), lambda i: w[i])) AS phrase, 1 AS m FROM w UNION ALL SELECT lang, unnest(list_transform(range(1, len(w)), lambda i: array_to_string(w[i:i+1], ' '))), 2 FROM w
  UNION ALL SELECT lang, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' '))), 3 FROM w UNION ALL SELECT lang, unnest(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))), 4 FROM w),
f AS (SELECT lang, phrase, m, COUNT(*) AS a FROM g GROUP BY ALL HAVING COUNT(*) >= 30),
n AS (SELECT lang, COUNT(*) AS n FROM g WHERE m = 1 GROUP BY lang),
inside AS (SELECT q.lang, array_to_string(string_split(q.phrase, ' ')[i:i+k-1], ' ') AS phrase, MAX(q.a) AS most FROM f q, (VALUES (2), (3)) AS ks(k), (VALUES (1), (2), (3)) AS i_(i) WHERE k < q.m AND i + k - 1 <= q.m GROUP BY 1, 2),
c AS (SELECT f.* FROM f LEFT JOIN inside USING (lang, phrase) WHERE m > 1 AND (most IS NULL OR 100 * most::HUGEINT < 80 * a::HUGEINT)),
cuts AS (SELECT c.lang, c.phrase, c.a, k, x.a AS l, y.a AS r, (2000000 * c.a::HUGEINT) // (x.a::HUGEINT + y.a) AS score FROM c, (VALUES (1), (2), (3)) AS ks(k), f x, f y WHERE k < c.m AND x.lang = c.lang AND y.lang = c.lang
  AND x.phrase = array_to_string(string_split(c.phrase, ' ')[1:k], ' ') AND y.phrase = array_to_string(string_split(c.phrase, ' ')[k+1:], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best) JOIN n USING (lang) WHERE rank <= 2000"""
