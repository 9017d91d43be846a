import pytest

from edgeatlas.operators import graph
from edgeatlas.plans.envelope import ToolError

SCHEMA = "from_id long, to_id long, from_name string, to_name string, kind string, rule string, confidence double, path string, line int"


def edges(spark, *rows):
    return spark.createDataFrame([(a, b, f"s{a}", f"s{b}", k, "same_file", c, "f", i) for i, (a, b, k, c) in enumerate(rows, 1)], SCHEMA)


def starts(spark, *ids):
    return spark.createDataFrame([("q", i) for i in ids], "query_id string, id long")


def pairs(spark, a, b):
    return spark.createDataFrame([("q", a, b)], "query_id string, from_id long, to_id long")


def test_edges_to_seen_symbols_are_emitted_but_not_followed(spark):
    e = edges(spark, (1, 2, "call", 0.9), (2, 1, "call", 0.9), (2, 3, "call", 0.9))
    got = {(r["depth"], r["from_id"], r["to_id"]) for r in graph.traverse(e, starts(spark, 1), 3, 0.5, None, reverse=False).collect()}
    assert got == {(1, 1, 2), (2, 2, 1), (2, 2, 3)}


def test_threshold_kinds_and_limit(spark):
    e = edges(spark, (1, 2, "call", 0.4), (1, 3, "inherit", 1.0), (1, 4, "instantiate", 0.6), (1, 5, "call", 0.7))
    got = [r["to_id"] for r in graph.traverse(e, starts(spark, 1), 1, 0.5, 1, reverse=False).collect()]
    assert got == [5]
    hidden = graph.hidden(e, starts(spark, 1), 0.65, reverse=False).first()
    assert (hidden["n_hidden"], hidden["max_confidence"], hidden["suggested"]) == (2, 0.6, 0.4)


def test_path_prefers_confidence_then_place(spark):
    e = edges(spark, (1, 2, "call", 0.6), (1, 3, "call", 0.9), (2, 4, "call", 0.9), (3, 4, "call", 0.7), (4, 1, "call", 0.9))
    got = [r["symbol_id"] for r in graph.shortest_paths(e, pairs(spark, 1, 4)).orderBy("step").collect()]
    assert got == [1, 2, 4]


def test_path_to_itself_and_to_nowhere(spark):
    e = edges(spark, (1, 2, "call", 0.9))
    assert [r["step"] for r in graph.shortest_paths(e, pairs(spark, 1, 1)).collect()] == [0]
    assert graph.shortest_paths(e, pairs(spark, 2, 1)).count() == 0


@pytest.mark.parametrize(("depth", "limit", "confidence"), [(0, 25, 0.5), (4, 25, 0.5), (1, 0, 0.5), (1, 201, 0.5), (1, 25, 1.5), (True, 25, 0.5)])
def test_ranges(spark, depth, limit, confidence):
    with pytest.raises(ToolError) as e:
        graph.traverse(edges(spark, (1, 2, "call", 0.9)), starts(spark, 1), depth, confidence, limit)
    assert e.value.error == "invalid_argument"
