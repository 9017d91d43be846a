"""Phrases, the prefix trie and token counts against plain versions, on awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from edgeatlas.llm import phrases, tokens, trie

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---- phrases

def plain_phrases(rows, least, longest, top, subsumed=80):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang][tuple(w[i : i + k])] += 1
    out = set()
    for lang, c in f.items():
        found = {p: a for p, a in c.items() if a >= least and len(p) > 1}
        inside = Counter()
        for p, a in found.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i : i + k]] = max(inside[p[i : i + k]], a)
        ranked = []
        for p, a in found.items():
            if 100 * inside[p] < subsumed * a:
                score, _, left, right = min((2000000 * a // (c[p[:k]] + c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
                ranked.append((-score, -a, " ".join(p).encode(), left, right))
        for i, (s, a, p, left, right) in enumerate(sorted(ranked)[:top], 1):
            out.add((lang, i, p.decode(), -a, left, right, n[lang], -s))
    return out


def phrase_rows(seed=3):
    rng = random.Random(seed)
    vocabulary = [*"abcdefg", "É", "ß", "a b", "x" * 300]
    rows = []
    for i in range(120):
        t = "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ". ", "\n", "!?", " \r\n"]) for _ in range(rng.randint(0, 60)))
        rows.append((rng.choice(["en", "de", None]), t + ("The Same Old Story. " * (i % 3))))
    return rows + [("en", None), ("en", ""), ("und", "a b"), ("en", " . , "), ("fr", "once only"), ("en", "long tail " * 20_000), rows[5], rows[5]]


@pytest.mark.parametrize("least,longest,top", [(5, 4, 2000), (2, 4, 7), (3, 3, 50)])
def test_phrases(spark, least, longest, top):
    docs = spark.createDataFrame(phrase_rows(), "lang string, text string").repartition(3)
    docs = docs.withColumns({c: F.lit(1) for c in ("phrase", "n", "k", "rank", "score", "part", "salt", "m")})
    got = {tuple(r) for r in phrases.collocations(docs, least, longest, top).collect()}
    assert got == plain_phrases(phrase_rows(), least, longest, top)


def test_phrases_of_small_shards(spark):
    """Counts do not depend on how many automata there are."""
    docs = spark.createDataFrame(phrase_rows(), "lang string, text string").select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").repartition(2).cache()
    words = phrases.count_words(docs, held=50)
    everything = phrases.Filter(spark, phrases.hash_words(words), words.count())
    pairs = phrases.count_pairs(docs, everything, held=50)
    near = phrases.Filter(spark, pairs.select("h"), pairs.count())
    counts = [{(r.lang, r.phrase): r.n for r in phrases.count_phrases(docs, everything, near, shard=s).collect()} for s in (1, 300, 1 << 20)]
    assert counts[0] == counts[1] == counts[2]


def test_automaton():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 4, 400)
    ends = np.unique(np.append(rng.integers(1, 400, 30), 400))
    left = np.concatenate([np.arange(b - a, 0, -1) for a, b in zip(np.append(0, ends[:-1]), ends, strict=True)])
    plain = defaultdict(set)
    for i in range(400):
        for k in range(1, min(4, left[i]) + 1):
            plain[tuple(words[i : i + k])].add(i + k)
    a = phrases.Automaton(words, left, 4)
    got = {tuple(words[p : p + k]): c for k, at, n in a.substrings(1) for p, c in zip(at, n, strict=True)}
    assert got == {s: len(e) for s, e in plain.items()}
    assert sum(len(at) for _, at, _ in a.substrings(1)) == len(plain), "each substring once"
    for k in range(1, 5):
        size, to = a.link(k)
        for p, s, t in zip(a.at[k], size, to, strict=True):
            own = tuple(words[p : p + k])
            want = next((own[-j:] for j in range(k - 1, 0, -1) if plain[own[-j:]] != plain[own]), ())
            q = a.at[s][t] if s else 0
            assert tuple(words[q : q + s]) == want


def test_no_phrases(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert phrases.collocations(empty).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert phrases.collocations(empty).count() == 0
    assert phrases.collocations(spark.createDataFrame([(None, None), ("en", "a")], "lang string, text string")).count() == 0


def test_scores_beyond_64_bits(spark):
    big = 9 * 10**17
    row = spark.createDataFrame([(big, big, big)], "a long, l long, r long")
    assert row.select(F.expr("cast(cast(2000000 as decimal(10,0)) * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0))) as long)")).first()[0] == 1_000_000


# ---- the trie

def plain_trie(rows, rebuild=True):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, role, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest(), text))
    own = {c: [(r, t) for _, _, r, _, t in sorted(v)] for c, v in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 4 if rebuild else 0 for c in own}
    full = {c: own.get(c - (c % 20 if c >= 0 else -(-c % 20)), [])[: h[c]] + own[c][h[c] :] for c in own}
    members = defaultdict(list)
    for c in sorted(full):
        for d in range(len(full[c]) + 1):
            members[tuple(full[c][:d])].append(c)
    kids, leaves, saved = Counter(k[:-1] for k in members if k), Counter(), Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not kids[k]
            saved[k[:d]] += (len(m) - 1) * len(WORD.findall(k[-1][1])) if k else 0
    ends = lambda k, m: hashlib.sha256(",".join(str(c) for c in m if len(full[c]) == len(k)).encode()).hexdigest()
    return Counter((m[0], len(k), members[k[:-1]][0] if k else None, len(m), kids[k], leaves[k], saved[k], ends(k, m)) for k, m in members.items())


def turn_rows(seed=5):
    rng = random.Random(seed)
    say = ["hi there", "what is this", "", "a b c d", "same", "x\ty  z"]
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice([*say, None])) for c in range(70) for t in range(rng.choice([1, 2, 3, 5]))]
    rows += [(c, t, "user", f"common {t}") for c in range(100, 160) for t in range(4)]  # a large group of copies
    rows += [(c, t, "user", f"common {t}" if t < 6 else f"own {c}") for c in range(160, 180) for t in range(8)]
    rows += [(200, t, "user", f"long {t}") for t in range(200)]  # several blocks of turns, where blocks are small
    rows += [(201, t, "user", f"long {t}") for t in range(199)]  # ends inside the other
    rows += [(300, 0, None, None), (300, None, "user", "before"), (301, 1, "a", "tie"), (301, 1, "b", "tie"), (301, 1, "a", "eit"), (301, 1, "a", "eit")]
    return rows + [(None, 1, "user", "nobody"), (-7, 0, "user", "minus"), (2**40, 0, "user", "far"), (2**40 + 20, 0, "user", "far")]


DDL = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("local", [1, 7, 100, trie.LOCAL])
def test_trie(spark, monkeypatch, local):
    monkeypatch.setattr(trie, "BLOCK_BITS", 5)
    rows = turn_rows()
    t = spark.createDataFrame(rows, DDL).repartition(5).withColumns({c: F.lit("x") for c in ("pos", "id", "words", "node", "rep", "depth", "part", "digest")})
    got = trie.prefix_trie(*trie.shared_starts(trie.encode_turns(t)), local=local)
    assert Counter(tuple(r) for r in got.collect()) == plain_trie(rows)


def test_trie_of_conversations_as_they_are(spark):
    rows = [r for r in turn_rows() if r[0] is None or r[0] < 200]
    got = trie.prefix_trie(trie.encode_turns(spark.createDataFrame(rows, DDL)))
    assert Counter(tuple(r) for r in got.collect()) == plain_trie(rows, rebuild=False)


def test_trie_without_turns(spark):
    empty = spark.createDataFrame([], DDL)
    assert trie.prefix_trie(*trie.shared_starts(trie.encode_turns(empty))).collect() == []
    nobody = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(nobody, t, "user", "gone") for t in range(2)]
    got = trie.prefix_trie(*trie.shared_starts(trie.encode_turns(spark.createDataFrame(rows, DDL))))
    assert Counter(tuple(r) for r in got.collect()) == plain_trie(rows)


def test_lists_of_ids_in_blocks(spark, monkeypatch):
    """The digest of a large class is that of one list, however many blocks it came in."""
    monkeypatch.setattr(trie, "BLOCK_BITS", 2)
    rows = [(c, t, "user", f"t{t}") for c in [-9, -1, *range(0, 1000, 3)] for t in range(9)]
    got = trie.prefix_trie(trie.encode_turns(spark.createDataFrame(rows, DDL)))
    assert Counter(tuple(r) for r in got.collect()) == plain_trie(rows, rebuild=False)


# ---- token counts

TEXTS = ["it's a test", "", None, "  spaces \n\n tabs\t", "Éè 你好 🙂", "a <|endoftext|> b", "x" * 30_000, " ".join(map(str, range(3_000))), "it's a test", "<|startoftext|>", "\x00  "]


@pytest.fixture(scope="module")
def token_docs(spark):
    rows = [(i, t, 7) for i, t in enumerate(TEXTS)] + [(None, "no id", 7), (0, "it's a test", 7), (3, "other text of an id", 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, N_Tokens int")


def plain_count(name, text):
    if name.endswith(".json"):
        from tokenizers import Tokenizer

        return len(Tokenizer.from_file(tokens.tokenizer_path(name)).encode(text, add_special_tokens=False).ids)
    from sentencepiece import SentencePieceProcessor

    return len(SentencePieceProcessor(model_file=tokens.tokenizer_path(name)).encode(text))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts(spark, token_docs, tmp_path, name):
    got = tokens.count_tokens(token_docs, f"file://{tmp_path}/cache", tokens.tokenizer_path(name), limit=5)
    assert got.columns == ["doc_id", "N_Tokens", "n_bytes", "_n_tokens", "over_limit"]
    want = Counter((r.doc_id, 7, len((r.text or "").encode()), n := plain_count(name, r.text or ""), n > 5) for r in token_docs.collect())
    assert Counter(tuple(r) for r in got.collect()) == want


def test_quick_counts_are_the_librarys():
    """Every character the quick encoder takes, in several surroundings."""
    path = tokens.tokenizer_path()
    count = tokens.counter(path)
    chars = [chr(c) for c in [*range(0x250), *range(0x2000, 0x2070)]]
    texts = [s.format(c) for c in chars for s in ("{0}", "a{0}b", " {0}{0} 1{0}2", "{0} x  {0}\n\n{0}", "'{0}s it'{0}", "  {0}\t {0}9")]
    rng = random.Random(4)
    texts += ["".join(rng.choices(chars, k=200)) for _ in range(500)] + ["z" * 20_000, " " * 20_000, "a" + " " * 1_000_000 + "b", "漢字 text", "a<|endoftext|>b", "\U0001f642"]
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    assert count(texts) == [len(tok.encode(t, add_special_tokens=False).ids) for t in texts]


@pytest.mark.parametrize("bound", [0, 1 << 18])
def test_only_distinct_misses_are_encoded(spark, token_docs, tmp_path, monkeypatch, bound):
    monkeypatch.setattr(tokens, "BROADCAST_ROWS", bound)
    cache, path = f"file://{tmp_path}/cache", tokens.tokenizer_path()
    some = token_docs.where("doc_id < 4")
    assert tokens.append_missing(some, cache, path) == 4  # null and empty are one content
    assert tokens.append_missing(some, cache, path) == 0
    before = spark.read.parquet(cache).count()
    rest = len({r.text or "" for r in token_docs.collect()}) - before
    assert tokens.append_missing(token_docs, cache, path) == rest
    assert spark.read.parquet(cache).groupBy("content").count().where("count > 1").count() == 0
    # stored counts are used as they are
    spark.read.parquet(cache).withColumn("n_tokens", F.lit(99).cast("long")).write.partitionBy("tokenizer").parquet(f"{cache}-99")
    assert {r["_n_tokens"] for r in tokens.count_tokens(token_docs, f"{cache}-99").collect()} == {99}
    # another tokenizer has counts of its own in the same cache
    other = tokens.tokenizer_path("piece_bpe_32k.model")
    assert tokens.append_missing(some, cache, other) == 4
    # rows that two writers appended count once
    spark.read.parquet(cache).write.mode("append").partitionBy("tokenizer").parquet(cache)
    assert tokens.count_tokens(token_docs, cache).count() == token_docs.count()


def test_malformed_bytes_and_empty_tables(spark, tmp_path):
    broken = spark.createDataFrame([(1, b"ok \xff\xfe end")], "doc_id long, b binary").selectExpr("doc_id", "cast(b as string) as text")
    r = tokens.count_tokens(broken, f"file://{tmp_path}/a").first()
    assert (r.n_bytes, r.n_tokens) == (len("ok �� end".encode()), plain_count("byte_bpe_50k.json", "ok �� end"))
    assert tokens.count_tokens(spark.createDataFrame([], "doc_id long, text string"), f"file://{tmp_path}/b").count() == 0
    with pytest.raises(ValueError, match="no library"):
        tokens.count_tokens(broken, f"file://{tmp_path}/c", "/x/y.bin")
