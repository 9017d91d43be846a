import random
import re

import numpy as np
import pyarrow as pa

from edgeatlas.llm.sketch import Sketch, decode, encode
from edgeatlas.llm.words import Words, blocks, covered, raw

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = ["", " ", "a", "a b", " é  ñ\tb\nc ", "x" * 5000, "\n\n", "a\x1cb \x85c", "one two one two one two", None]


def test_words_match_the_pattern():
    data, off = raw(pa.array(TEXTS, pa.string()))
    w = Words(data, off)
    words = [x for t in TEXTS for x in WORD.findall(t or "")]
    assert [bytes(data[a:b]).decode() for a, b in zip(w.start, w.end, strict=True)] == words
    assert w.counts().tolist() == [len(WORD.findall(t or "")) for t in TEXTS]
    h = w.hashes()
    assert len(set(h.tolist())) == len(set(words))


def test_windows_are_equal_where_words_are():
    rng = random.Random(3)
    texts = [" ".join(rng.choices("ab", k=rng.randint(0, 30))) for _ in range(40)]
    data, off = raw(pa.array(texts))
    w = Words(data, off)
    at, h = w.windows(w.hashes(), 4)
    flat = [x for t in texts for x in WORD.findall(t)]
    want = [tuple(flat[i : i + 4]) for i in at]
    assert len(set(zip(h.tolist(), want, strict=True))) == len(set(want)) == len(set(h.tolist()))
    assert len(at) == sum(max(0, len(WORD.findall(t)) - 3) for t in texts)


def test_blocks_keep_documents_whole():
    data, off = raw(pa.array(["a" * 10, "b" * 100, "", "c"]))
    assert [(i, j) for i, j, _, _ in blocks(data, off, 12)] == [(0, 1), (1, 3), (3, 4)] or sum(j - i for i, j, _, _ in blocks(data, off, 12)) == 4


def test_sliced_columns():
    a = pa.array(["x", "y z", None, "w"])[1:]
    data, off = raw(a)
    assert bytes(data) == b"y zw" and off.tolist() == [0, 3, 3, 4]


def test_cover():
    assert covered(np.array([1, 2]), 2, 5).tolist() == [False, True, True, True, False]


def test_codes_round_trip():
    ids = np.sort(np.random.default_rng(1).integers(0, 100_000, 500))
    assert decode(encode(ids)).tolist() == ids.tolist()
    assert decode(encode(np.array([0, 0, 255, 510, 511]))).tolist() == [0, 0, 255, 510, 511]


def test_partial_sketch_caps_repeats():
    s = Sketch(rows=2, cell_bits=24, shard_bits=22, times=2)
    h = np.array([7 << 40] * 5 + [9 << 50], np.uint64)
    part = s.partial(h)
    assert sum(len(decode(b.as_py())) for b in part.column(1)) == 2 * 3
