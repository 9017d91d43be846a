"""Extraction and resolution as queries, over source files that are written from the relational tables."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeatlas.functions.names import SALT, language
from edgeatlas.operators.resolve import resolve
from edgeatlas.plans.index import clean_facts, rows_of, tables_of
from edgeatlas.sources.generated import SUPPLIERS, source_files

NOW = __import__("datetime").datetime(2024, 1, 1)
REPOS = [*(f"market{i}" for i in range(5)), "supply", "places", "settings"]


def files(spark: SparkSession, corpus: dict[str, dict[str, str]]) -> DataFrame:
    """Files of a few repositories given as texts."""
    rows = [(r, p, bytearray(t.encode()), hashlib.sha256(t.encode()).hexdigest()) for r, fs in corpus.items() for p, t in fs.items()]
    df = spark.createDataFrame(rows, "repo string, path string, content binary, content_hash string")
    return df.withColumn("lang", language(F.col("path"))).where("lang is not null")


def tables(spark: SparkSession, corpus: dict[str, dict[str, str]]) -> dict[str, DataFrame]:
    facts = clean_facts(files(spark, corpus))
    return tables_of(facts, [(r, f"/{r}", "0" * 40) for r in corpus], NOW)


def generated(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return tables_of(clean_facts(source_files(spark, sf_dir)), [(r, f"/{r}", "0" * 40) for r in REPOS], NOW)


def named_edges(spark: SparkSession, t: dict[str, DataFrame]) -> DataFrame:
    """from_name, to_name, kind, rule, confidence, candidates."""
    s = t["symbols"].select("id", "qualified_name")
    e = resolve(t)
    return e.join(s.withColumnsRenamed({"id": "from_symbol_id", "qualified_name": "from_name"}), "from_symbol_id").join(s.withColumnsRenamed({"id": "to_symbol_id", "qualified_name": "to_name"}), "to_symbol_id").select("from_name", "to_name", "kind", "rule", "confidence", "candidates")


#: The columns of each table that do not depend on how files are numbered.
COLUMNS = {
    "files": "repo path lang loc parse_error module",
    "symbols": "path kind name qualified_name line_start line_end visibility param_count",
    "refs": "path from_qualified to_name kind line",
    "imports": "path local_name target line",
    "config_keys": "path key_path key_norm line origin reader_qualified",
    "entry_points": "path kind name target line",
    "queue_handlers": "path protocol name handler_qualified line",
    "string_consts": "path qualified_name value line",
}


def _table(name: str):
    def run(spark, sf_dir):
        facts = clean_facts(source_files(spark, sf_dir))  # these columns need no numbers of files: facts go out as they come
        return (facts if name == "files" else rows_of(facts, name, "path")).select(*COLUMNS[name].split())

    return run


QUERIES = {f"code_{n}": _table(n) for n in COLUMNS}
QUERIES["code_edges"] = lambda spark, sf_dir: named_edges(spark, generated(spark, sf_dir))

_C = f"c AS (SELECT CAST(c_custkey AS VARCHAR) AS c, CAST(c_custkey % {SUPPLIERS} AS VARCHAR) AS k, 'market' || c_custkey % 5 AS repo, 'c' || c_custkey AS m, 'c' || c_custkey || '.py' AS path FROM customer)"
_S = "s AS (SELECT CAST(s_suppkey AS VARCHAR) AS k, 's' || s_suppkey AS m, 's' || s_suppkey || '.py' AS path FROM supplier)"
_N = "n AS (SELECT CAST(n_nationkey AS VARCHAR) AS n, 'Nation' || n_nationkey || '.cs' AS path FROM nation)"
_R = "r AS (SELECT CAST(r_regionkey AS VARCHAR) AS r, 'r' || r_regionkey || '/appsettings.json' AS path FROM region)"


def _rows(name: str, **of: list[str]) -> str:
    """SELECTs of literal rows for each of the tables c, s, n and r; a row is written as SQL expressions."""
    columns = COLUMNS[name].split() if name in COLUMNS else ["from_name", "to_name", "kind", "rule", "confidence", "candidates"]
    parts = [f"SELECT {', '.join(f'{v} AS {c}' for c, v in zip(columns, row.split(' | '), strict=True))} FROM {t}" for t, rows in of.items() for row in rows]
    return f"WITH {_C}, {_S}, {_N}, {_R} {' UNION ALL '.join(parts)}"


SQL: dict[str, str] = {
    "code_files": _rows(
        "files", c=["repo | path | 'python' | 13 | false | m"], s=["'supply' | path | 'python' | 14 | false | m"], n=["'places' | path | 'csharp' | 5 | false | 'Places'"], r=["'settings' | path | 'config' | 4 | false | NULL"]
    ),
    "code_symbols": _rows(
        "symbols",
        c=["path | 'module' | m | m | 1 | 13 | 'public' | NULL", "path | 'function' | 'buy_' || c | m || '.buy_' || c | 5 | 8 | 'public' | 1", "path | 'class' | 'Account' || c | m || '.Account' || c | 11 | 13 | 'public' | NULL", "path | 'method' | 'settle_' || c | m || '.Account' || c || '.settle_' || c | 12 | 13 | 'public' | 0"],
        s=["path | 'module' | m | m | 1 | 14 | 'public' | NULL", "path | 'function' | 'ship_' || k | m || '.ship_' || k | 5 | 6 | 'public' | 1", "path | 'function' | 'serve_' || k | m || '.serve_' || k | 9 | 10 | 'public' | 0"],
        n=["path | 'module' | 'Places' | 'Places' | 1 | 5 | 'public' | NULL", "path | 'class' | 'Nation' || n | 'Places.Nation' || n | 2 | 5 | 'public' | NULL", "path | 'method' | 'Code' | 'Places.Nation' || n || '.Code' | 4 | 4 | 'public' | 0"],
    ),
    "code_refs": _rows(
        "refs",
        c=["path | m | 'os' | 'import' | 1", "path | m | 's' || k || '.serve_' || k | 'import' | 2", "path | m || '.buy_' || c | 'serve_' || k | 'call' | 6", "path | m || '.buy_' || c | 'x.settle_' || c | 'call' | 7", "path | m || '.buy_' || c | 'os.getenv' | 'call' | 8", "path | m || '.Account' || c || '.settle_' || c | 'buy_' || c | 'call' | 13"],
        s=["path | m | 'dramatiq' | 'import' | 1", "path | m | 'dramatiq.actor' | 'call' | 4", "path | m || '.serve_' || k | 'ship_' || k || '.send' | 'call' | 10", "path | m || '.serve_' || k | 'ship_' || k | 'queue_actor' | 10", "path | m | 'serve_' || k | 'call' | 14"],
    ),
    "code_imports": _rows("imports", c=["path | 'os' | 'os' | 1", "path | 'serve_' || k | 's' || k || '.serve_' || k | 2"], s=["path | 'dramatiq' | 'dramatiq' | 1"]),
    "code_config_keys": _rows("config_keys", c=["path | 'SEGMENT_' || c | 'segment_' || c | 8 | 'code-read' | m || '.buy_' || c"], r=["path | 'Region:Code' | 'region:code' | 2 | 'json' | NULL", "path | 'Code' || r | 'code' || r | 3 | 'json' | NULL"]),
    "code_entry_points": _rows("entry_points", s=["path | 'main-block' | m | NULL | 13"]),
    "code_queue_handlers": _rows("queue_handlers", s=["path | 'dramatiq' | 'job-' || k | m || '.ship_' || k | 4"]),
    "code_string_consts": _rows("string_consts", n=[f"path | 'Places.Nation' || n || '.Name' | substr(sha256('{SALT}' || 'nation-' || n), 1, 24) | 3"]),
    "code_edges": _rows(
        "edges",
        c=["m || '.buy_' || c | 's' || k || '.serve_' || k | 'call' | 'import_scope' | 0.9 | 1", "m || '.buy_' || c | m || '.Account' || c || '.settle_' || c | 'call' | 'repo_unique' | 0.7 | 1", "m || '.Account' || c || '.settle_' || c | m || '.buy_' || c | 'call' | 'same_file' | 0.95 | 1", "m | 's' || k || '.serve_' || k | 'import' | 'import_scope' | 0.9 | 1"],
        s=["m | m || '.serve_' || k | 'call' | 'same_file' | 0.95 | 1", "m || '.serve_' || k | m || '.ship_' || k | 'call' | 'queue_match' | 0.9 | 1"],
    ),
}
