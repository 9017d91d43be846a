import random

from pyspark.sql import functions as F

from edgeatlas.operators import trigrams as t
from edgeatlas.operators.symbols import matches
from edgeatlas.plans.fragments import FragmentStore

DDL = "symbol_id long, name string, qualified_name string"


def symbols(seed=2, n=400):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcAB_é", k=rng.randint(1, 9)))
    rows = [(i, name := word(), f"{word()}.{name}") for i in range(n)]
    return rows + [(n, None, None), (n + 1, "", ""), (n + 2, "aaa", None), (n + 3, "aaaa" * 2000, "long.aaaa"), (n + 4, "same", "x.same"), (n + 5, "same", "x.same")]


def test_trigrams(spark):
    got = spark.createDataFrame([("ABab",), ("ab",), ("",), (None,), ("aaaa",), ("éÀb",)], "s string").select(t.trigrams(F.col("s")).alias("g")).collect()
    assert [r.g for r in got] == [["aba", "bab"], [], [], [], ["aaa"], ["éàb"]]


def test_find_equals_a_scan(spark):
    rows = symbols()
    s = spark.createDataFrame(rows, DDL)
    needles = ["aba", "ABAB", "cab", "aaaaa", "zzz", "same", ".aa", "x.same", "nothing at all", "ab", "", None, "bcab_a", "é"]
    got = t.find(t.postings(s), s, spark.createDataFrame([(n,) for n in [*needles, "aba"]], "needle string"))
    want = {(n, i) for n in needles if n and len(n) >= 3 for i, a, q in rows if n.lower() in (a or "").lower() or n.lower() in (q or "").lower()}
    assert sorted((r.needle, r.symbol_id) for r in got.collect()) == sorted(want)
    for n in ("aba", "cab"):
        assert s.where(matches(n)).count() == len([1 for m, _ in want if m == n])
    assert t.find(t.postings(s), s, spark.createDataFrame([], "needle string")).count() == 0
    assert t.find(t.postings(s.limit(0)), s.limit(0), spark.createDataFrame([("abc",)], "needle string")).count() == 0


def test_only_the_postings_of_a_needle_are_read(spark, tmp_path):
    s = spark.range(20_000).select(F.col("id").alias("symbol_id"), F.concat(F.lit("sym_"), F.hex("id")).alias("name")).withColumn("qualified_name", F.concat(F.lit("m."), "name"))
    store = FragmentStore(spark, f"file://{tmp_path}/s")
    m = store.start(buckets=32)
    store.replace(m, "trigrams", t.postings(s), ["trigram"])
    store.commit(m)
    asked = spark.createDataFrame([("4e1f",)], "needle string")
    buckets = {r[0] for r in asked.select(F.explode(t.trigrams(F.col("needle"))).alias("trigram")).select(store.bucket(m, ["trigram"])).collect()}
    part = store.read("trigrams", buckets=buckets)
    assert len(buckets) == 2 and len({f.rsplit("/", 2)[1] for f in part.inputFiles()}) == 2
    met = part.join(asked.select(F.explode(t.trigrams(F.col("needle"))).alias("trigram")), "trigram", "left_semi")
    assert met.count() < t.postings(s).count() / 50
    assert t.find(part, s, asked).count() == s.where(matches("4e1f")).count() > 0
