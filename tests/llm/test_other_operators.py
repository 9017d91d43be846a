"""Archives, chat, vectors, the pipeline, and the queries with SQL."""

import gzip
import hashlib
import io
import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from edgeatlas.llm import chat, queries, vectors, warc
from edgeatlas.llm.components import components
from tests.oracle import connect, same


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_match_sql(spark, sf, name):
    same(queries.QUERIES[name](spark, sf), connect(sf), queries.SQL[name])


# ---- archives

PAGES = [(1, "http://a/\r\nx", "<p>" + "é" * 200), (2, "http://b", "<p>" + "é" * 200), (3, None, None), (4, "http://d", ""), (5, "http://e", "tiny"), (6, "http://f", "tiny"), (7, "http://g", "WARC/1.1\r\n\r\n\r\nWARC/1.1\r\nx: y\r\n\r\n" * 9), (0, "http://h", "<p>" + "é" * 200), (0, "http://h", "<p>" + "é" * 200), (8, "u", "x" * 3_000_000)]


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_archive_round_trip(spark, tmp_path, compression):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("record_type", F.lit("x")).repartition(3)
    path = f"file://{tmp_path}/w"
    warc.write_warc(pages, path, compression=compression)
    got = Counter(tuple(r) for r in warc.archive_digest(warc.read_warc(spark, path)).collect())
    first = {}
    for i, _, h in PAGES:
        first[h] = min(first.get(h, i), i)
    want = Counter()
    for i, _, h in PAGES:
        b = (h or "").encode()
        again = len(b) >= 100 and first[h] != i
        want[i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[h] if again else None] += 1
    assert got == want


def test_filters_are_taken_and_payloads_skipped(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    warc.write_warc(spark.createDataFrame(PAGES, "page_id long, url string, html string"), path)
    df = warc.read_warc(spark, path)
    assert df.where("record_type = 'revisit'").count() == 2
    assert {r[0] for r in df.where("target_uri like 'http://e%' and content_length < 100000").select("record_id").collect()} == {"<urn:page:5>"}
    assert {bytes(r[0]) if r[0] else None for r in warc.read_warc(spark, path, payload=False).select("payload").collect()} == {None}
    reader = warc.WarcReader({"path": path}, None)
    from pyspark.sql.datasource import EqualTo, Not, StringContains

    rest = list(reader.pushFilters([EqualTo(("record_type",), "response"), EqualTo(("http_length",), 3), Not(EqualTo(("date",), "x")), StringContains(("target_uri",), "a")]))
    assert [f.attribute for f in rest] == [("http_length",)] and len(reader.kept) == 3


def test_members_and_broken_archives():
    one = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nX-Long: a\r\n b\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    both = gzip.compress(one) + gzip.compress(one)
    got = list(warc.records(io.BytesIO(both)))
    assert [r["payload"] for r in got] == [b"abc", b"abc"] and dict(got[0]["headers"])["x-long"] == "a b"
    with pytest.raises(ValueError, match="ends inside"):
        list(warc.records(io.BytesIO(one[:-6])))
    with pytest.raises(ValueError, match="not a WARC"):
        list(warc.records(io.BytesIO(b"junk\r\n")))


def test_no_pages(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_warc(spark, path).count() == 0


# ---- chat

def brute(roles):
    best = 10**9
    for labels in itertools.product(range(3), repeat=len(roles)):
        for joins in itertools.product((0, 1), repeat=len(roles)):
            cost, at, fine = 0, chat.START, True
            for r, q, j in zip(roles, labels, joins, strict=True):
                cost += 0 if r == q else chat.COST["name"] if r == 3 else chat.COST["relabel"]
                if j:
                    fine &= at == q
                    cost += chat.COST["merge"]
                else:
                    ways = [len(chat.INSERTS[at, m]) for m in range(4) if q in chat.NEXT[m] and (at, m) in chat.INSERTS]
                    fine &= bool(ways)
                    cost += chat.COST["insert"] * min(ways, default=0)
                    at = q
            if fine:
                best = min(best, cost + chat.END[at])
    return best


def test_repair_is_cheapest():
    for n in range(1, 5):
        for roles in itertools.product(range(4), repeat=n):
            assert chat.trace(list(roles), chat.START)[0] == brute(roles), roles


def test_long_conversation_is_cut_and_agrees(spark):
    rng = random.Random(6)
    names = ["system", "user", "assistant", "Human", None, "tool"]
    rows = [(1, i, rng.choice(names), f"t{i}") for i in range(400)] + [(k, i, rng.choice(names), None if i == 1 else f"é{i}") for k in range(2, 30) for i in range(rng.randint(1, 9))] + [(None, 1, "user", "x"), (5, 0, "user", "dup"), (5, 0, "user", "dup")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("cost", F.lit("x"))
    by = {}
    for c, t, r, x in sorted(rows, key=lambda v: (v[0] is not None, v[0] or 0, v[1], v[2] is not None, v[2] or "", v[3] is not None, v[3] or "")):
        by.setdefault(c, []).append((r, x))
    for parts in (1, 7):
        turns = chat.turns_repaired(df, partitions=parts)
        if parts == 7:
            assert turns.where("conv_id = 1").select("stretch").distinct().count() > 1
        got = {r["conv_id"]: r for r in chat.render(df, partitions=parts).collect()}
        assert set(got) == set(by)
        for c, v in by.items():
            assert got[c]["cost"] == chat.trace([chat.role_code(r) for r, _ in v], chat.START)[0]
            text = got[c]["rendered"]
            roles = [x.split("\n", 1)[0] for x in text.split(chat.OPEN)[1:]]
            assert roles[-1] == "assistant" and roles[0] in ("system", "user") and "system" not in roles[1:]
            assert all(a != b for a, b in zip(roles, roles[1:], strict=False)) and text.endswith(chat.CLOSE) and text.count(chat.OPEN) == text.count(chat.CLOSE)
            assert len(roles) == len(v) - got[c]["n_merged"] + got[c]["n_inserted"]


# ---- vectors and components

def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(40, 24))
    v = np.stack([base[i % 40] + rng.normal(size=24) * rng.uniform(0, 0.45) for i in range(400)])
    rows = [(i, [float(x) for x in r], 0) for i, r in enumerate(v.astype(np.float32))]
    rows += [(400, None, 0), (401, [0.0] * 24, 0), (402, [float("nan")] * 24, 0), (403, [None] + [1.0] * 23, 0), (404, rows[3][1], 0), (405, rows[3][1], 0), (406, [1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("n_links", F.lit("x"))
    got = {r["vec_id"]: r for r in vectors.near_duplicates(df).collect()}
    m = np.array([r[1] for r in rows if r[0] < 400 or r[0] in (404, 405)], float)
    ids = [r[0] for r in rows if r[0] < 400 or r[0] in (404, 405)]
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    link = m @ m.T >= 0.9
    np.fill_diagonal(link, False)
    found = sum(got[i]["n_links"] for i in ids)
    assert found >= 0.95 * link.sum() and all(got[i]["n_links"] <= link[k].sum() for k, i in enumerate(ids))
    for i in (400, 401, 402, 403, 406):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert got[404]["component_id"] == got[405]["component_id"] == got[3]["component_id"]
    assert vectors.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


@pytest.mark.parametrize("block", [128, 4096])
def test_every_link_of_a_large_group_counts(spark, monkeypatch, block):
    """A third of the vectors are near copies of each other with independent noise, links down to the threshold; others are alone or in pairs."""
    monkeypatch.setattr(vectors, "BLOCK", block)
    rng = np.random.default_rng(5)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    alone = unit(rng.normal(size=(1000, 64)))
    v = np.concatenate([unit(rng.normal(size=(1, 64))) + rng.normal(size=(700, 64)) * 0.0405, alone, alone[:400] + rng.normal(size=(400, 64)) * 0.055]).astype(np.float32)
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<float>")
    got = {r["vec_id"]: r for r in vectors.near_duplicates(df).collect()}
    m = unit(v.astype(float))
    link = m @ m.T >= 0.9
    np.fill_diagonal(link, False)
    assert 0.2 < link[:700, :700].mean() < 0.99 and 0.2 < link[1700:, 700:1100].sum() / 400 < 0.99
    assert [got[i]["n_links"] for i in range(len(v))] == link.sum(1).tolist()
    label = vectors.unite(np.arange(len(v)), *np.nonzero(link))
    assert [got[i]["component_id"] for i in range(len(v))] == label.tolist()


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(3)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    a, b = unit(rng.normal(size=(300, 64))), unit(rng.normal(size=(300, 64)))
    turn = vectors.rotation(64)
    assert np.allclose(turn @ turn.T, np.eye(64))
    ca, cb = vectors.Codes(a, turn), vectors.Codes(b, turn)
    off = ca.estimate(cb) - a @ b.T
    assert abs(off.mean()) < 0.005 and (np.abs(off) <= vectors.DEVIATIONS * ca.deviation[:, None]).mean() > 0.999
    near = unit(a + rng.normal(size=a.shape) * 0.04)
    x, y, exact = vectors.linked(a, near, turn)
    assert set(zip(*np.nonzero(a @ near.T >= 0.9), strict=True)) == set(zip(x, y, strict=True)) and exact < 0.1 * 300 * 300


def test_near_keeps_every_pair_that_may_link_and_few_others():
    rng = np.random.default_rng(4)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    turn = vectors.rotation(64)
    a = unit(rng.normal(size=(300, 64)))
    for b in (unit(a + rng.normal(size=a.shape) * 0.06), unit(a[:1] + rng.normal(size=a.shape) * 0.06)):  # few links, and nearly all
        for left in (a, b):
            exact = left @ b.T
            ca, cb = vectors.Codes(left, turn), vectors.Codes(b, turn)
            got = np.zeros(exact.shape, bool)
            got[ca.near(cb, 0.9, vectors.DEVIATIONS)] = True
            assert not (ca.may_link(cb, 0.9, vectors.DEVIATIONS) & (exact >= 0.9) & ~got).any() and exact[got].min(initial=1) > 0.85


def _records(spark, run):
    """Records that the stages of ``run`` wrote to shuffles."""
    sc = spark.sparkContext._jsc.sc()
    jvm, gateway = spark._jvm, spark.sparkContext._gateway

    def stages():
        sc.listenerBus().waitUntilEmpty()
        found = sc.statusStore().stageList(jvm.java.util.ArrayList(), False, False, gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (found.apply(k) for k in range(found.size()))}

    before = stages()
    run()
    return sum(n for k, n in stages().items() if k not in before)


def test_what_is_sent_grows_with_the_vectors(spark, monkeypatch):
    """Where no bound excludes a cell, a vector was sent to as many jobs as there are blocks, and fetched whole for nearly all of them."""
    monkeypatch.setattr(vectors, "BLOCK", 64)
    v = np.random.default_rng(9).normal(size=(4000, 64))
    v[1::2] = v[::2] + np.random.default_rng(10).normal(size=(2000, 64)) * 0.2  # everyone has one partner
    df = lambda n: spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v[:n])], "vec_id long, embedding array<double>")
    got = []
    few, many = (_records(spark, lambda n=n: got.append({r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_duplicates(df(n)).collect()})) for n in (1000, 4000))
    assert all(g == {i: (1, i - i % 2) for i in range(len(g))} for g in got)
    assert many < 6 * few and many < 40 * 4000


def test_more_groups_than_usual(spark, monkeypatch):
    """Groups of two blocks at most, so more than ``GROUPS``: a vector meets every other one once all the same."""
    for name, value in (("BLOCK", 40), ("GROUPS", 3), ("WIDE", 2), ("ROWS", 16)):
        monkeypatch.setattr(vectors, name, value)
    rng = np.random.default_rng(6)
    v = np.concatenate([rng.normal(size=(1, 32)) + rng.normal(size=(150, 32)) * 0.3, rng.normal(size=(450, 32))])
    got = {r["vec_id"]: r for r in vectors.near_duplicates(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "vec_id long, embedding array<double>")).collect()}
    m = v / np.linalg.norm(v, axis=1, keepdims=True)
    link = m @ m.T >= 0.9
    np.fill_diagonal(link, False)
    assert 0.1 < link[:150, :150].mean() < 0.99
    assert [got[i]["n_links"] for i in range(len(v))] == link.sum(1).tolist()
    assert [got[i]["component_id"] for i in range(len(v))] == vectors.unite(np.arange(len(v)), *np.nonzero(link)).tolist()


def test_components(spark):
    rng = random.Random(2)
    e = [(rng.randrange(-200, 200), rng.randrange(-200, 200)) for _ in range(260)] + [(900 + i, 901 + i) for i in range(60)] + [(5, 5), (None, 3)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in e:
        if a is not None and a != b:
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    want = {(x, find(x)) for x in root}
    assert {tuple(r) for r in components(spark.createDataFrame(e, "a long, b long")).collect()} == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- the pipeline

def test_pipeline(spark, sf):
    import corpus_pipeline as p
    from edgeatlas.llm import jaccard, quality

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    at, seen = docs, {}
    for name, stage in p.STAGES[:-1]:
        at = stage(spark, at, sf).cache()
        assert at.columns == docs.columns, name
        seen[name] = Counter(r["doc_id"] for r in at.collect())
    q, j, d, m = seen.values()
    stats = {r["doc_id"]: r["f"] for r in quality.assess(docs, []).select("doc_id", F.col("__quality.base_failed").alias("f")).collect()}
    assert not any(stats[i] for i in q)
    comps = jaccard.jaccard_components(docs.where(F.col("doc_id").isin(list(q)))).collect()
    assert j == Counter({r["component_id"]: 1 for r in comps})
    assert d == j and set(m) <= set(d) and max(m.values()) <= 2
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").collect()
    good = [r["doc_id"] for r in labels if not stats[r["doc_id"]]]
    assert sum(i in q for i in good) >= 0.95 * len(good)
    whole = p.run(spark, sf)
    assert set(whole.columns) == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}
    assert {r["doc_id"] for r in whole.select("doc_id").distinct().collect()} == set(m)


@pytest.mark.parametrize("cells", [3, 26])
def test_pipeline_near_copies_leave_other_texts_in_place(spark, monkeypatch, cells):
    """Texts are shuffled only of names that go or have several rows; names that share a cell with such (3 bits: all do) change nothing."""
    import corpus_pipeline as p
    from edgeatlas.llm.sketch import Sketch

    monkeypatch.setattr(p, "UNSETTLED", Sketch(rows=1, cell_bits=cells, shard_bits=min(cells, 22), times=1))
    own = [(i, " ".join(f"w{i}x{j}" for j in range(9)), "a") for i in range(10, 40)]
    near = [(3, "one two three four five six", "a"), (5, "One two three four five six", "a"), (3, "one two three four five six", "b")]
    odd = [(3, "another text of one id again", "z"), (None, "one two three four five six", "c"), (None, None, None), (None, None, None), (7, "", "e"), (8, None, "f"), (8, None, "f")]
    df = p.ngram_jaccard(spark, spark.createDataFrame(own + near + odd, "doc_id long, text string, lang string"), "")
    assert Counter(map(tuple, df.collect())) == Counter(own + [near[0], *odd[:1], odd[2], odd[4], odd[5]])
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Union") < plan.index("Join") and "unsettled" in plan


def test_components_keep_no_rounds(spark, tmp_path):
    """The shared folder keeps the last round's table, not those before it."""
    from edgeatlas import session

    before = set(session._made)
    got = components(spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long"))
    assert len(set(session._made) - before) == 1
    assert {tuple(r) for r in got.collect()} == {(i, 0) for i in range(41)}


def test_written_tables_tidy_the_driver(spark, monkeypatch):
    """Writing a table collects the JVM's garbage, but not again within some seconds."""
    from edgeatlas import session

    factory = spark.sparkContext._jvm.java.lang.management.ManagementFactory
    calls = lambda: sum(b.getCollectionCount() for b in factory.getGarbageCollectorMXBeans() if "Old" in b.getName() or "MarkSweep" in b.getName())
    monkeypatch.setattr(session, "_tidied", [float("-inf")])
    before = calls()
    session.cut(spark.range(3))
    once = calls()
    assert once > before
    session.tidy(spark)
    assert calls() == once
