"""Quality rules: statistics of whole texts, and a decision list learned from labelled statistics.

Sequential covering: grow a conjunction of thresholds on two thirds of the labelled rows by FOIL gain, prune it on the rest, keep it
where its precision there is high enough, remove what it covers, repeat. The list becomes one ordered Spark conditional.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeatlas.llm.session import free, release, small_batches
from edgeatlas.llm.words import Words, blocks, covered, mix, raw

REPEAT_WINDOW = 5
SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRA = ("n_lines", "n_upper", "n_digits", "n_marks", "n_lone")
#: Labelled rows that the list is learned from, at most; the first by a hash of their id.
SAMPLE_ROWS = 6000
#: Least precision of a learned rule on the rows it was not grown on, and least rows it must cover there.
PRECISION, SUPPORT = 0.95, 3
STATS = "struct<" + ",".join(f"{c}:long" for c in COUNTS + EXTRA) + ">"

_MASKS = {"n_symbols": np.isin(np.arange(256), list(SYMBOLS.encode())), "n_upper": np.isin(np.arange(256), range(65, 91)), "n_digits": np.isin(np.arange(256), range(48, 58)), "n_marks": np.isin(np.arange(256), list(b"!?"))}


def _run(data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """Statistics of a run of documents, one entry per document."""
    n = len(off) - 1
    w = Words(data, off)
    total = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[off])
    out = {"n_words": w.counts()}
    white = np.zeros(256, bool)
    white[[9, 10, 11, 12, 13, 32]] = True
    out["word_chars"] = total(~white[data] & ((data & 0xC0) != 0x80))
    out |= {k: total(m[data]) for k, m in _MASKS.items()}
    h = w.hashes()
    docs = np.repeat(np.arange(n), out["n_words"])
    lone = ((w.end - w.start) == 1) & ~np.isin(data[w.start], np.r_[48:58, 65:91, 97:123].astype(np.uint8))
    out["n_lone"] = np.bincount(docs[lone], minlength=n)
    # words in windows that occur twice or more in their text
    at, win = w.windows(h, REPEAT_WINDOW)
    key = mix(win + docs[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    out["n_repeat_words"] = np.bincount(docs[covered(at[twice], REPEAT_WINDOW, len(h))], minlength=n)
    # lines: split at newlines and document ends; only those with a word count
    brk = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([off[:-1], brk + 1]), kind="stable")
    ends = np.sort(np.concatenate([off[1:], brk]), kind="stable")
    has = np.searchsorted(w.start, ends) > np.searchsorted(w.start, starts)
    starts, ends = starts[has], ends[has]
    line_doc = np.searchsorted(off, starts, "right") - 1
    out["n_lines"] = np.bincount(line_doc, minlength=n)
    out["n_dup_lines"] = np.zeros(n, np.int64)
    text = data.tobytes()
    seen: set[bytes] = set()
    last = -1
    for d, a, b in zip(line_doc.tolist(), starts.tolist(), ends.tolist(), strict=True):
        if d != last:
            seen, last = set(), d
        line = text[a:b]
        if line in seen:
            out["n_dup_lines"][d] += 1
        else:
            seen.add(line)
    return out


def text_stats(column: pa.Array) -> pa.Array:
    data, off = raw(column)
    parts = [_run(d, o) for _, _, d, o in blocks(data, off)]
    release()
    names = COUNTS + EXTRA
    return pa.StructArray.from_arrays([pa.array(np.concatenate([p[k] for p in parts]) if parts else np.zeros(0), pa.int64()) for k in names], names=list(names))


def stats_of(text: Column) -> Column:
    """Struct of the text's statistics; a null text has those of an empty one."""

    @F.arrow_udf(STATS)
    def stats(column: pa.Array) -> pa.Array:
        return text_stats(column)

    return stats.asNondeterministic()(text)


def base_failed(s: Column) -> Column:
    return (s["n_words"] < 10) | (100 * s["n_repeat_words"] > 20 * s["n_words"])


# ---- features: ratios of statistics, alike as arrays and as expressions

FEATURES = ("n_words", "word_length", "symbols_per_word", "dup_line_share", "repeat_share", "upper_share", "digit_share", "marks_per_word", "lone_share", "words_per_line")


def features(s, least) -> list:
    """``s`` has the statistics by name (arrays or columns); ``least`` is the elementwise maximum with 1."""
    words, chars, lines = least(s["n_words"]), least(s["word_chars"]), least(s["n_lines"])
    return [s["n_words"] * 1.0, s["word_chars"] / words, s["n_symbols"] / words, s["n_dup_lines"] / lines, s["n_repeat_words"] / words, s["n_upper"] / chars, s["n_digits"] / chars, s["n_marks"] / words, s["n_lone"] / words, s["n_words"] / lines]


@dataclass(frozen=True)
class Rule:
    """A conjunction of (feature, above, threshold); texts that meet it are rejected."""

    terms: tuple[tuple[int, bool, float], ...]
    precision: float
    covered: int

    def __str__(self) -> str:
        return " and ".join(f"{FEATURES[f]} {'>' if up else '<='} {t:.6g}" for f, up, t in self.terms)


def _meets(x: np.ndarray, terms) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, up, t in terms:
        out &= (x[:, f] > t) if up else (x[:, f] <= t)
    return out


def _grow(x: np.ndarray, bad: np.ndarray, longest: int = 4) -> list[tuple[int, bool, float]]:
    terms: list[tuple[int, bool, float]] = []
    inside = np.ones(len(x), bool)
    while len(terms) < longest and (~bad[inside]).any():
        p0, n0 = bad[inside].sum(), (~bad[inside]).sum()
        best, gain = None, 1e-9
        for f in range(x.shape[1]):
            for t in np.unique(np.quantile(x[inside, f], np.linspace(0.02, 0.98, 49))):
                for up in (True, False):
                    m = inside & ((x[:, f] > t) if up else (x[:, f] <= t))
                    p, n = (bad & m).sum(), (~bad & m).sum()
                    if p and (g := p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))) > gain:
                        best, gain = (f, up, float(t)), g
        if best is None:
            break
        terms.append(best)
        inside = _meets(x, terms)
    return terms


def learn_rules(x: np.ndarray, bad: np.ndarray, most: int = 12, precision: float = PRECISION, support: int = SUPPORT) -> list[Rule]:
    """Ordered rules; none where nothing meets the precision, or there are no rows of either class."""
    rng = np.random.default_rng(5)
    rules: list[Rule] = []
    left = np.ones(len(x), bool)
    while len(rules) < most and bad[left].any() and (~bad[left]).any():
        idx = np.flatnonzero(left)
        rng.shuffle(idx)
        grow, prune = idx[: 2 * len(idx) // 3], idx[2 * len(idx) // 3 :]
        terms = _grow(x[grow], bad[grow])
        worth = lambda ts: (lambda m: ((bad[prune] & m).sum() - 4 * (~bad[prune] & m).sum()) / max(1, m.sum()) if m.any() else -9)(_meets(x[prune], ts))
        while len(terms) > 1 and worth(terms[:-1]) >= worth(terms):
            terms = terms[:-1]
        m = _meets(x[prune], terms) if terms else np.zeros(len(prune), bool)
        hit = int((bad[prune] & m).sum())
        if hit < support or hit < precision * m.sum():
            break
        rules.append(Rule(tuple(terms), hit / m.sum(), int(m.sum())))
        left &= ~_meets(x, terms)
    return rules


def rejected(s: Column, rules: list[Rule]) -> Column:
    """The list as one conditional: 1-based number of the first rule met, 0 where none is."""
    f = features(s, lambda c: F.greatest(c, F.lit(1)))
    out = None
    for i, r in enumerate(rules, 1):
        cond = F.lit(True)
        for k, up, t in r.terms:
            cond &= (f[k] > F.lit(t)) if up else (f[k] <= F.lit(t))
        out = F.when(cond, i) if out is None else out.when(cond, i)
    return F.lit(0) if out is None else out.otherwise(0)


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Learn from at most ``rows`` labelled documents, chosen by a hash of doc_id; null labels are left out."""
    small_batches(docs.sparkSession)
    some = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    got = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("quality", stats_of(F.col("text")).alias("s")).select("quality", "s.*").orderBy(*COUNTS, *EXTRA).collect()
    if not got:
        return []
    table = {c: np.array([r[c] for r in got], float) for c in COUNTS + EXTRA}
    x = np.column_stack(features(table, lambda c: np.maximum(c, 1)))
    return learn_rules(x, np.array([r["quality"] == 0 for r in got]))


def assess(docs: DataFrame, rules: list[Rule], text: str = "text", name: str = "__quality") -> DataFrame:
    """The input's columns, and a struct ``name``: the statistics, base_failed, rule (0: none) and kept.

    Nulls and empty texts have no words and fail the base; repeated rows get equal verdicts; an empty table stays empty.
    """
    small_batches(docs.sparkSession)
    stats = free(docs, "__s")[0]
    d = docs.withColumn(stats, stats_of(F.col(text)))
    s = F.col(stats)
    failed, rule = base_failed(s), rejected(s, rules)
    q = F.struct(*[s[c].alias(c) for c in COUNTS], failed.alias("base_failed"), rule.alias("rule"), (~failed & (rule == 0)).alias("kept"))
    return d.select(*docs.columns, q.alias(name))


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rules = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return assess(docs.select("doc_id", "text"), rules).select("doc_id", *[F.col(f"__quality.{c}").alias(c) for c in (*COUNTS, "base_failed", "kept", "rule")])


def quality_base(spark, sf_dir: str) -> DataFrame:
    """The part of ``op8_quality_rules`` that SQL can say."""
    return op8_quality_rules(spark, sf_dir).select("doc_id", *COUNTS, "base_failed")


BASE_SQL = r"""
WITH d AS (SELECT doc_id, COALESCE(text, '') AS t, regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
lines AS (SELECT doc_id, COUNT(*) - COUNT(DISTINCT l) AS n FROM (SELECT doc_id, UNNEST(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i+4], ' ')) AS h FROM d, LATERAL (SELECT UNNEST(range(1, len(ws) - 3)) AS i)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, COUNT(*) OVER (PARTITION BY doc_id, h) AS n FROM win) WHERE n > 1),
cover AS (SELECT doc_id, COUNT(DISTINCT i + o) AS n FROM rep, (SELECT UNNEST(range(0, 5)) AS o) GROUP BY doc_id),
c AS (SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(COALESCE(lines.n, 0) AS BIGINT) AS n_dup_lines, CAST(COALESCE(cover.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN cover USING (doc_id))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c
"""
