"""Relational tables presented as a code graph, so that graph operators run on them and SQL can check the results.

A vertex is named ``<table>:<key>``; its repository is a region and its file a nation. The numeric id is the key times eight plus the
table's code: the same in every run, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CODES = {"region": 0, "nation": 1, "customer": 2, "supplier": 3, "part": 4, "orders": 5}
KINDS = {"region": "module", "nation": "module", "customer": "function", "supplier": "method", "part": "class", "orders": "function"}
LINE_RULES = ((0, "same_file", 0.95), (1, "import_scope", 0.9), (2, "repo_unique", 0.7), (3, "cross_repo_unique", 0.6), (4, "ambiguous", 0.15))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vertex_id(name: str, key: Column | str) -> Column:
    key = F.col(key) if isinstance(key, str) else key
    return key.cast("long") * 8 + CODES[name]


def vertex_name(name: str, key: Column | str) -> Column:
    key = F.col(key) if isinstance(key, str) else key
    return F.concat(F.lit(f"{name}:"), key.cast("string"))


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_nationkey, repo, path: a dimension of nations, broadcast by its size."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", F.col("r_name").alias("repo"), F.col("n_name").alias("path"))


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol_id, kind, name, qualified_name, repo, path, line. Vertices without a nation are in the repository GLOBAL."""
    t = lambda n: table(spark, sf_dir, n)
    p = places(spark, sf_dir)

    def of(name: str, key: str, label: Column, df: DataFrame, repo: Column, path: Column) -> DataFrame:
        return df.select(vertex_id(name, key).alias("symbol_id"), F.lit(KINDS[name]).alias("kind"), label.alias("name"), vertex_name(name, key).alias("qualified_name"), repo.alias("repo"), path.alias("path"), F.lit(1).alias("line"))

    c = t("customer").join(p, F.col("c_nationkey") == F.col("n_nationkey"))
    s = t("supplier").join(p, F.col("s_nationkey") == F.col("n_nationkey"))
    o = t("orders").join(c.select("c_custkey", "repo", "path"), F.col("o_custkey") == F.col("c_custkey"), "left")
    here = (F.col("repo"), F.col("path"))
    parts = [
        of("region", "r_regionkey", F.col("r_name"), t("region"), F.col("r_name"), F.lit("__init__")),
        of("nation", "n_nationkey", F.col("path"), p, *here),
        of("customer", "c_custkey", F.col("c_name"), c, *here),
        of("supplier", "s_suppkey", F.col("s_name"), s, *here),
        of("part", "p_partkey", F.col("p_name"), t("part"), F.lit("GLOBAL"), F.col("p_brand")),
        of("orders", "o_orderkey", vertex_name("orders", "o_orderkey"), o, F.coalesce("repo", F.lit("GLOBAL")), F.coalesce("path", F.lit("orders"))),
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def edges(spark: SparkSession, sf_dir: str, kinds: tuple[str, ...] | None = None, once: bool = True) -> DataFrame:
    """from_id, to_id, from_name, to_name, kind, rule, confidence, path, line; parallel edges that differ in rule or line stay.

    Without ``once`` equal calls may repeat, which spares a shuffle where they are made distinct later.
    """
    t = lambda n: table(spark, sf_dir, n)

    def of(df: DataFrame, a: str, ak: str, b: str, bk: str, kind: str, rule: Column, confidence: Column, line: Column) -> DataFrame:
        return df.select(vertex_id(a, ak).alias("from_id"), vertex_id(b, bk).alias("to_id"), vertex_name(a, ak).alias("from_name"), vertex_name(b, bk).alias("to_name"), F.lit(kind).alias("kind"), rule.alias("rule"), confidence.alias("confidence"), F.lit(f"{a}.tbl").alias("path"), line.cast("int").alias("line"))

    lit = F.lit
    li = t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    slot = F.col("l_linenumber") % 5
    rule, confidence = F.when(slot == 0, lit(LINE_RULES[0][1])), F.when(slot == 0, lit(LINE_RULES[0][2]))
    for k, r, c in LINE_RULES[1:]:
        rule, confidence = rule.when(slot == k, lit(r)), confidence.when(slot == k, lit(c))
    parts = {
        "call": [
            of(t("orders"), "customer", "o_custkey", "orders", "o_orderkey", "call", lit("import_scope"), lit(0.9), lit(1)),
            of(li.dropDuplicates(["l_orderkey", "l_partkey", "l_linenumber"]) if once else li, "orders", "l_orderkey", "part", "l_partkey", "call", rule, confidence, F.col("l_linenumber")),
            of(t("supplier"), "supplier", "s_suppkey", "nation", "s_nationkey", "call", lit("same_file"), lit(0.95), lit(1)),
        ],
        "instantiate": [of(li.groupBy("l_partkey", "l_suppkey").agg(F.min("l_linenumber").alias("l_linenumber")), "part", "l_partkey", "supplier", "l_suppkey", "instantiate", lit("declared_type"), lit(0.85), F.col("l_linenumber"))],
        "inherit": [of(t("nation"), "nation", "n_nationkey", "region", "n_regionkey", "inherit", lit("import_scope"), lit(0.9), lit(1))],
    }
    chosen = [e for k, es in parts.items() if kinds is None or k in kinds for e in es]
    out = chosen[0]
    for x in chosen[1:]:
        out = out.unionByName(x)
    return out


SYMBOLS_SQL = """
places AS (SELECT n_nationkey, r_name AS repo, n_name AS path FROM nation JOIN region ON n_regionkey = r_regionkey),
symbols AS (
  SELECT CAST(r_regionkey AS BIGINT) * 8 AS symbol_id, 'module' AS kind, r_name AS name, 'region:' || r_regionkey AS qualified_name, r_name AS repo, '__init__' AS path, 1 AS line FROM region
  UNION ALL SELECT CAST(n_nationkey AS BIGINT) * 8 + 1, 'module', path, 'nation:' || n_nationkey, repo, path, 1 FROM places
  UNION ALL SELECT c_custkey * 8 + 2, 'function', c_name, 'customer:' || c_custkey, repo, path, 1 FROM customer JOIN places ON c_nationkey = n_nationkey
  UNION ALL SELECT s_suppkey * 8 + 3, 'method', s_name, 'supplier:' || s_suppkey, repo, path, 1 FROM supplier JOIN places ON s_nationkey = n_nationkey
  UNION ALL SELECT p_partkey * 8 + 4, 'class', p_name, 'part:' || p_partkey, 'GLOBAL', p_brand, 1 FROM part
  UNION ALL SELECT o_orderkey * 8 + 5, 'function', 'orders:' || o_orderkey, 'orders:' || o_orderkey, COALESCE(repo, 'GLOBAL'), COALESCE(path, 'orders'), 1
    FROM orders LEFT JOIN (SELECT c_custkey, repo, path FROM customer JOIN places ON c_nationkey = n_nationkey) ON o_custkey = c_custkey)
"""

EDGES_SQL = """
edges AS (
  SELECT o_custkey * 8 + 2 AS from_id, o_orderkey * 8 + 5 AS to_id, 'customer:' || o_custkey AS from_name, 'orders:' || o_orderkey AS to_name, 'call' AS kind, 'import_scope' AS rule, CAST(0.9 AS DOUBLE) AS confidence, 'customer.tbl' AS path, 1 AS line FROM orders
  UNION ALL SELECT DISTINCT l_orderkey * 8 + 5, l_partkey * 8 + 4, 'orders:' || l_orderkey, 'part:' || l_partkey, 'call',
    CASE l_linenumber % 5 WHEN 0 THEN 'same_file' WHEN 1 THEN 'import_scope' WHEN 2 THEN 'repo_unique' WHEN 3 THEN 'cross_repo_unique' ELSE 'ambiguous' END,
    CAST(CASE l_linenumber % 5 WHEN 0 THEN 0.95 WHEN 1 THEN 0.9 WHEN 2 THEN 0.7 WHEN 3 THEN 0.6 ELSE 0.15 END AS DOUBLE), 'orders.tbl', l_linenumber FROM lineitem
  UNION ALL SELECT s_suppkey * 8 + 3, CAST(s_nationkey AS BIGINT) * 8 + 1, 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'call', 'same_file', 0.95, 'supplier.tbl', 1 FROM supplier
  UNION ALL SELECT l_partkey * 8 + 4, l_suppkey * 8 + 3, 'part:' || l_partkey, 'supplier:' || l_suppkey, 'instantiate', 'declared_type', 0.85, 'part.tbl', MIN(l_linenumber) FROM lineitem GROUP BY l_partkey, l_suppkey
  UNION ALL SELECT CAST(n_nationkey AS BIGINT) * 8 + 1, CAST(n_regionkey AS BIGINT) * 8, 'nation:' || n_nationkey, 'region:' || n_regionkey, 'inherit', 'import_scope', 0.9, 'nation.tbl', 1 FROM nation)
"""
