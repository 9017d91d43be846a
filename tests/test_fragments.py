"""Versions of a table against plain dictionaries, on a path that only Spark's file systems reach."""

import pytest
from pyspark.sql import functions as F

from edgeatlas.plans.fragments import Conflict, FragmentStore


@pytest.fixture(scope="module")
def disk(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("fragments")
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.fragments.link./in", f"file://{at}")
    return at


@pytest.fixture
def folder(disk, request):
    return f"viewfs://fragments/in/{request.node.name}"


def rows(spark, ids, text="t"):
    return spark.createDataFrame([(i, f"{text}{i}") for i in ids], "k long, text string")


def content(df):
    return {r.k: r.text for r in df.collect()}


def test_one_change_rewrites_one_fragment(spark, folder, disk):
    store = FragmentStore(spark, folder)
    assert store.manifest() is None and store.versions() == []
    everything = spark.range(10_000).select(F.col("id").alias("k"), F.concat(F.lit("t"), "id").alias("text"))
    nothing = everything.limit(0)
    m = store.start(buckets=64)
    assert store.upsert(m, "t", everything, nothing, ["k"]) == 64
    assert store.commit(m) == 1
    m = store.start()
    assert store.upsert(m, "t", rows(spark, [77], "new"), nothing, ["k"]) == 1
    assert store.commit(m) == 2
    one, two = (store.manifest(v)["tables"]["t"]["fragments"] for v in (1, 2))
    assert sum(one[b] != two[b] for b in one) == 1
    assert content(store.read("t", store.manifest(1)))[77] == "t77", "an older version stays as it was"
    m = store.start()
    assert store.upsert(m, "t", nothing, rows(spark, [77, 5, 123_456]), ["k"]) <= 3
    store.commit(m)
    want = {i: f"t{i}" for i in range(10_000) if i not in (77, 5)}
    assert content(store.read("t")) == want
    assert store.read("t", buckets=[1, 2]).count() < 1_000
    # nothing deleted is left
    assert store.retain(1) > 0
    assert store.versions() == [3]
    assert content(store.read("t")) == want
    kept = set(store.manifest()["tables"]["t"]["fragments"].values())
    at = disk / folder.rsplit("/", 1)[1]
    assert {str(p.parent.relative_to(at)) for p in at.rglob("part-*.parquet")} == kept
    assert store.retain(1) == 0


def test_steps_equal_all_at_once(spark, folder):
    store = FragmentStore(spark, folder)
    m = store.start(buckets=4)
    state = {}
    for step, (put, out) in enumerate([([1, 2, 3], []), ([2, 9], [1]), ([], [2, 3, 9]), ([4], [])]):
        store.upsert(m, "t", rows(spark, put, f"s{step}-"), rows(spark, out), ["k"])
        state = {k: v for k, v in state.items() if k not in out} | {i: f"s{step}-{i}" for i in put}
        assert content(store.read("t", m)) == state
    store.commit(m)
    assert content(store.read("t")) == {4: "s3-4"}


def test_only_fragments_that_differ_are_replaced(spark, folder):
    store = FragmentStore(spark, folder)
    m = store.start(buckets=8)
    df = rows(spark, range(100))
    assert store.replace(m, "t", df, ["k"]) == 8
    assert store.replace(m, "t", df.repartition(3), ["k"]) == 0
    changed = df.withColumn("text", F.when(F.col("k") == 7, "x").otherwise(F.col("text")))
    assert store.replace(m, "t", changed, ["k"]) == 1
    assert content(store.read("t", m))[7] == "x"
    assert store.replace(m, "t", df.where("k < 3"), ["k"]) >= 1
    assert content(store.read("t", m)) == {i: f"t{i}" for i in range(3)}
    assert store.replace(m, "t", df.limit(0), ["k"]) == 0
    assert store.read("t", m).count() == 0
    assert store.replace(m, "u", rows(spark, [1])) == 1
    assert content(store.read("u", m)) == {1: "t1"}


def test_of_two_writers_one_has_to_start_again(spark, folder):
    a, b = FragmentStore(spark, folder), FragmentStore(spark, folder)
    m1, m2 = a.start(), b.start()
    a.upsert(m1, "t", rows(spark, [1], "a"), rows(spark, []), ["k"])
    b.upsert(m2, "t", rows(spark, [1], "b"), rows(spark, []), ["k"])
    assert a.commit(m1) == 1
    with pytest.raises(Conflict):
        b.commit(m2)
    assert content(a.read("t")) == {1: "a1"}
    m2 = b.start()
    b.upsert(m2, "t", rows(spark, [1], "b"), rows(spark, []), ["k"])
    assert b.commit(m2) == 2
    assert content(a.read("t")) == {1: "b1"}
