from pyspark.sql import functions as F

from edgeatlas.functions import names
from edgeatlas.operators import config_keys, evaluation
from edgeatlas.sources.scip import read_index


def test_names(spark):
    rows = [("a.b", True), ("1a", False), ("a" * 65, False), ("a\n", False), ("", False)]
    df = spark.createDataFrame(rows, "v string, ok boolean")
    assert all(r["x"] == r["ok"] == names.is_name(r["v"]) for r in df.withColumn("x", names.name_shaped(F.col("v"))).collect())
    d = spark.createDataFrame([("job",)], "v string").select(names.name_digest(F.col("v"))).first()[0]
    assert d == names.digest("job")


def test_globs_and_languages(spark):
    df = spark.createDataFrame([("src/a.py",), ("x/node_modules/y.py",), ("appsettings.Dev.json",), ("b.cs",), ("pyproject.toml",), ("c.txt",), ("edgeatlas.overrides.yaml",)], "p string")
    got = {r["p"]: (r["l"], r["i"]) for r in df.select("p", names.language(F.col("p")).alias("l"), names.included(F.col("p"), [], ["*/node_modules/*"]).alias("i")).collect()}
    assert got["appsettings.Dev.json"][0] == "config" and got["b.cs"][0] == "csharp" and got["c.txt"][0] is None and got["edgeatlas.overrides.yaml"][0] == "overrides"
    assert not got["x/node_modules/y.py"][1] and got["src/a.py"][1]


def test_modules(spark):
    for p, m in (("src/a/b.py", "a.b"), ("a/__init__.py", "a"), ("x.py", "x")):
        assert names.module_name(p) == m
        assert spark.createDataFrame([(p,)], "p string").select(names.module_of(F.col("p"))).first()[0] == m


def test_config_patterns():
    assert config_keys.like_pattern("A__B") == "%a:b%"
    assert config_keys.like_pattern("a*b") == "a%b"
    assert config_keys.like_pattern("100%") == "100\\%"


def test_scores(spark):
    q = spark.createDataFrame([("1", "what_calls", ["a", "b"], ["b", "c"]), ("2", "what_calls", [], []), ("3", "find_path", ["a"], ["a"]), ("4", "what_calls", ["a"], [])], "id string, tool string, expected array<string>, answered array<string>")
    got = {r["id"]: (r["precision"], r["recall"], r["f1"]) for r in evaluation.score(q).collect()}
    assert got == {"1": (0.5, 0.5, 0.5), "2": (1.0, 1.0, 1.0), "3": (1.0, 1.0, 1.0), "4": (0.0, 0.0, 0.0)}


def test_scip_wire_format():
    def field(n, payload):
        return bytes([n << 3 | 2, len(payload)]) + payload

    occurrence = field(1, bytes([4, 2, 9])) + field(2, b"sym a") + bytes([3 << 3, 1])
    doc = field(1, b"src/x.py") + field(2, occurrence)
    got = list(read_index(field(2, doc) + bytes([7 << 3 | 5, 0, 0, 0, 0])))
    assert got == [("src/x.py", "sym a", 5, 1)]
