import pytest

from edgeatlas import session
from edgeatlas.operators import evaluation


def test_a_table_is_written_once_and_dropped(spark):
    met = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            met.add(b.num_rows)
            yield b

    t = session.cut(spark.range(10).mapInArrow(count, "id long"), "once")
    assert [t.count(), t.count(), met.value] == [10, 10, 10]
    assert all("/once-" in f for f in t.inputFiles())
    files = t.inputFiles()
    session.drop(spark, t)
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    path = fs.Path(files[0]).getParent()
    assert not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def test_a_cluster_needs_a_shared_folder():
    class Nothing:
        def __getattr__(self, name):
            return lambda *a: self if name not in ("isDefined", "get") else False if name == "isDefined" else None

    class Context(Nothing):
        master = "spark://host:7077"
        _jsc = Nothing()

    class Session:
        sparkContext = Context()
        conf = Nothing()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())


def test_scores_by_item_equal_scores_by_arrays(spark):
    q = [("a", [1, 2, 3], [2, 3, 4]), ("b", [], []), ("c", [1], []), ("d", [], [5]), ("e", [1, 1, 2], [2, 2])]
    arrays = spark.createDataFrame([(i, "t", e, a) for i, e, a in q], "id string, tool string, expected array<int>, answered array<int>")
    items = [(i, "t", x, x in e, x in a) for i, e, a in q for x in [*e, *a]] + [("b", "t", 9, False, None)]
    got = evaluation.score_items(spark.createDataFrame(items, "id string, tool string, item int, expected boolean, answered boolean"))
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in evaluation.score(arrays).collect()}
