"""Toxicity by a linear-chain conditional random field over tokens.

Training rows are labelled by document. Words that stand out in the toxic ones (document counts, smoothed) label their tokens there;
the field learns word and transition weights from these token labels by gradient steps on segments. Scoring runs
forward-backward over whole texts: words without a weight of their own share one emission, so a stretch of them is a power of
one 2 by 2 matrix and only the others cost a step. The marginals give spans and, through a logistic fit, a document score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeatlas.llm.session import free, release, small_batches
from edgeatlas.llm.words import ALNUM, Words, blocks, raw

#: Labelled rows that the field is fitted on, at most; the first by a hash of doc_id.
SAMPLE_ROWS = 6000
#: A vocabulary word: toxic documents with it at least, smoothed share of toxic among documents with it.
LEAST_DOCS, LEAST_SHARE = 3, 0.5
SEGMENT, STEPS, L2 = 48, 60, 0.05
#: Powers of the gap matrix that are kept; a longer gap's is squared together from them.
POWERS = 512
FOLDS = 5


@dataclass
class Field:
    """Word hashes (ascending) with emission weights, the weight of other words, log transitions, start, document weights."""

    words: np.ndarray
    emit: np.ndarray
    other: float
    trans: np.ndarray
    start: float
    doc: np.ndarray

    def __post_init__(self):
        step = np.exp(self.trans) * np.exp([0.0, self.other])
        out = [np.eye(2)]
        for _ in range(POWERS):
            m = out[-1] @ step
            out.append(m / m.max())
        self.gap = np.array(out)

    def power(self, n: int) -> np.ndarray:
        """The matrix of a gap of n tokens, up to a factor."""
        if n <= POWERS:
            return self.gap[n]
        half = self.power(n // 2)
        m = half @ half @ self.gap[n % 2]
        return m / m.max()


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[Words, np.ndarray]:
    w = Words(data, off, lower=True, inner=ALNUM)
    return w, w.hashes()


def marginals(field: Field, at: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """P(toxic) of the tokens at positions ``at`` (ascending) with emissions ``weight``, in a text of n tokens."""
    t, k = np.exp(field.trans), len(at)
    phi = np.stack([np.ones(k), np.exp(weight)], 1)
    fwd, bwd = np.empty((k, 2)), np.empty((k, 2))
    first = np.array([1.0, np.exp(field.start)])
    last = None
    for i in range(k):
        if last is None:
            a = first if at[i] == 0 else (first * np.array([1.0, np.exp(field.other)])) @ field.power(at[i] - 1) @ t
        else:
            a = fwd[i - 1] @ field.power(at[i] - last - 1) @ t
        a = a * phi[i]
        fwd[i] = a / a.sum()
        last = at[i]
    b = field.power(n - 1 - at[-1]) @ np.ones(2)
    bwd[k - 1] = b / b.sum()
    for i in range(k - 2, -1, -1):
        b = field.power(at[i + 1] - at[i] - 1) @ (t @ (phi[i + 1] * bwd[i + 1]))
        bwd[i] = b / b.sum()
    g = fwd * bwd
    return g[:, 1] / g.sum(1)


def doc_features(m: np.ndarray, n: int) -> list[float]:
    return [1.0, float(m.max()) if len(m) else 0.0, float(np.log1p(m.sum())), float(np.sqrt(m.sum() / max(n, 1)))]


def score_texts(field: Field, column: pa.Array, offsets: bool = True) -> Iterator[tuple[list[float], list[tuple[int, int, float]]]]:
    """Document features and toxic spans (code points) of each text."""
    data, off = raw(column)
    for _, _, d, o in blocks(data, off):
        w, h = tokens(d, o)
        count, first = w.counts(), w.first
        if len(field.words):
            pos = np.minimum(np.searchsorted(field.words, h), len(field.words) - 1)
            hit = np.flatnonzero(field.words[pos] == h)
            weight = field.emit[pos[hit]]
        else:
            hit, weight = np.zeros(0, np.int64), np.zeros(0)
        bounds = np.searchsorted(hit, first)
        for i in range(len(o) - 1):
            a, b = bounds[i], bounds[i + 1]
            if a == b:
                yield doc_features(np.zeros(0), int(count[i])), []
                continue
            m = marginals(field, hit[a:b] - first[i], weight[a:b], int(count[i]))
            spans = []
            if offsets and (m >= 0.5).any():
                chars = np.concatenate([[0], np.cumsum((d[o[i] : o[i + 1]] & 0xC0) != 0x80)])
                for j in np.flatnonzero(m >= 0.5):
                    s, e = w.start[hit[a + j]] - o[i], w.end[hit[a + j]] - o[i]
                    spans.append((int(chars[s]), int(chars[e]), float(m[j])))
            yield doc_features(m, int(count[i])), spans


# ---- fitting

def _vocabulary(column: pa.Array, toxic: np.ndarray) -> np.ndarray:
    """Words that stand out, ascending. Documents that share their least three-word window count as one: copies prove little."""
    data, off = raw(column)
    group = np.arange(len(toxic), dtype=np.uint64)
    pairs = []
    for i, _, d, o in blocks(data, off):
        w, h = tokens(d, o)
        at, win = w.windows(h, 3)
        doc = w.doc_of(at)
        least = np.full(len(o) - 1, np.iinfo(np.uint64).max, np.uint64)
        np.minimum.at(least, doc, win)
        some = np.flatnonzero(np.bincount(doc, minlength=len(o) - 1))
        group[i + some] = least[some]
        pairs.append(np.stack([h, group[i + np.repeat(np.arange(len(o) - 1), w.counts())]], 1))
    if not pairs:
        return np.zeros(0, np.uint64)
    p = np.unique(np.concatenate(pairs), axis=0)
    names, member = np.unique(group, return_inverse=True)
    bad_group = np.bincount(member, toxic) / np.bincount(member)
    words, inv = np.unique(p[:, 0], return_inverse=True)
    bad = np.bincount(inv, bad_group[np.searchsorted(names, p[:, 1])], len(words))
    n = np.bincount(inv, minlength=len(words))
    prior = toxic.mean()
    share = (bad + prior) / (n + 1)
    rate = np.clip(bad / n, 1e-9, 1 - 1e-9)
    # Chernoff's exponent against chance, beyond what the best of all the words would reach by luck
    surprise = n * (rate * np.log(rate / prior) + (1 - rate) * np.log((1 - rate) / (1 - prior)))
    ok = np.flatnonzero((bad >= LEAST_DOCS) & (share >= max(LEAST_SHARE, min(0.9, 3 * prior))) & (surprise > np.log(len(words)) + 2))
    return words[ok]


def _segments(column: pa.Array, toxic: np.ndarray, words: np.ndarray, seed: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vocabulary index, 0 for others, -1 past the end), token labels and lengths of segments: those with a vocabulary word, as many others."""
    data, off = raw(column)
    with_word, without = [], []
    for i, _, d, o in blocks(data, off):
        w, h = tokens(d, o)
        pos = np.minimum(np.searchsorted(words, h), max(0, len(words) - 1))
        idx = np.where(words[pos] == h, pos + 1, 0) if len(words) else np.zeros(len(h), np.int64)
        for j in range(len(o) - 1):
            x = idx[w.first[j] : w.first[j + 1]]
            for s in range(0, len(x), SEGMENT):
                part = x[s : s + SEGMENT]
                (with_word if part.any() else without).append((part, toxic[i + j]))
    order = np.random.default_rng(seed).permutation(len(without))[: max(200, len(with_word))]
    every = with_word + [without[j] for j in order]
    x = np.full((len(every), SEGMENT), -1)
    y = np.zeros((len(every), SEGMENT))
    for r, (part, bad) in enumerate(every):
        x[r, : len(part)] = part
        y[r, : len(part)] = (part > 0) & bool(bad)
    return x, y, (x >= 0).sum(1)


def _train(x: np.ndarray, y: np.ndarray, size: np.ndarray, v: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Emissions (0: other words), transitions and start, by scaled gradient steps on the conditional likelihood."""
    emit, trans, start = np.full(v + 1, -3.0), np.zeros((2, 2)), 0.0
    emit[1:] = 0.0
    mask = x >= 0
    idx = np.where(mask, x, 0)
    m, n = x.shape
    seen = np.bincount(idx[mask], minlength=v + 1) + 1.0
    both = mask[:, 1:]
    yi = y.astype(int)
    observed = np.zeros((2, 2))
    np.add.at(observed, (yi[:, :-1][both], yi[:, 1:][both]), 1)
    for _ in range(STEPS if m else 0):
        phi = np.stack([np.ones((m, n)), np.exp(emit)[idx]], 2)
        phi[~mask] = 1
        t = np.exp(trans)
        a, b = np.empty((m, n, 2)), np.empty((m, n, 2))
        a[:, 0] = phi[:, 0] * [1.0, np.exp(start)]
        a[:, 0] /= a[:, 0].sum(1, keepdims=True)
        for i in range(1, n):
            step = (a[:, i - 1] @ t) * phi[:, i]
            a[:, i] = np.where(mask[:, i, None], step / step.sum(1, keepdims=True), a[:, i - 1])
        b[:, n - 1] = 0.5
        for i in range(n - 2, -1, -1):
            step = (phi[:, i + 1] * b[:, i + 1]) @ t.T
            b[:, i] = np.where(mask[:, i + 1, None], step / step.sum(1, keepdims=True), 0.5)
        g = a * b
        g = g[..., 1] / g.sum(2)
        xi = a[:, :-1, :, None] * t * (phi * b)[:, 1:, None, :]
        xi /= xi.sum((2, 3), keepdims=True)
        grad = np.bincount(idx[mask], (y - g)[mask], v + 1) - L2 * emit
        emit += 4.0 * grad / seen
        trans += 2.0 * ((observed - xi[both].sum(0)) / max(1, both.sum()) - 1e-3 * trans)
        start += 2.0 * ((y[:, 0] - g[:, 0]).mean() - 1e-3 * start)
    return emit, trans, start


def _logistic(x: np.ndarray, y: np.ndarray, l2: float = 0.05, steps: int = 40) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ w))
        h = (x * (p * (1 - p))[:, None]).T @ x + l2 * np.eye(len(w))
        w += np.linalg.solve(h, x.T @ (y - p) - l2 * w)
    return w


def fit_texts(texts: list[str | None], toxic: list[int]) -> Field:
    """Fit on labelled texts; no rows, or rows of one class, give a field without words."""
    y = np.array([t == 1 for t in toxic], float)
    column = pa.array(texts, pa.string())
    words = _vocabulary(column, y) if 0 < y.sum() < len(y) else np.zeros(0, np.uint64)
    emit, trans, start = np.array([-3.0]), np.zeros((2, 2)), 0.0
    if len(words):
        emit, trans, start = _train(*_segments(column, y, words), len(words))
    field = Field(words, emit[1:], float(emit[0]), trans, float(start), np.zeros(4))
    if len(y):
        x = np.array([f for f, _ in score_texts(field, column, offsets=False)])
        field.doc = _logistic(x, y)
    else:
        field.doc = np.array([-3.0, 0, 0, 0])
    return field


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Field:
    """Fit on at most ``rows`` labelled documents outside the held-out fold; null labels are left out."""
    some = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    some = some.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    got = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("doc_id", "text", "toxic").collect()
    got.sort(key=lambda r: (r["doc_id"], r["text"] or ""))
    return fit_texts([r["text"] for r in got], [r["toxic"] for r in got])


def score(docs: DataFrame, field: Field, text: str = "text", name: str = "__toxic") -> DataFrame:
    """The input's columns and a struct ``name``: score, predicted and spans (start, end in code points, marginal).

    Only the text is read. Null and empty texts score as texts without toxic words; an empty table stays empty.
    """
    small_batches(docs.sparkSession)

    @F.arrow_udf("struct<score:double,spans:array<struct<start:int,end:int,marginal:double>>>")
    def run(column: pa.Array) -> pa.Array:
        out = list(score_texts(field, column))
        z = np.array([f for f, _ in out]).reshape(-1, 4) @ field.doc
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("marginal", pa.float64())]))
        release()
        spans = pa.array([[{"start": s, "end": e, "marginal": m} for s, e, m in x] for _, x in out], kind)
        return pa.StructArray.from_arrays([pa.array(1 / (1 + np.exp(-z))), spans], names=["score", "spans"])

    found = free(docs, "__t")[0]
    d = docs.withColumn(found, run.asNondeterministic()(F.col(text)))
    s = F.col(found)["score"]
    return d.select(*docs.columns, F.struct(s.alias("score"), (s >= 0.5).cast("int").alias("predicted"), F.col(found)["spans"].alias("spans")).alias(name))


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    field = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    d = score(docs, field)
    spans = F.array_join(F.transform("__toxic.spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return d.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("__toxic.score").alias("score"), F.col("__toxic.predicted").alias("predicted"), spans.alias("spans"))
