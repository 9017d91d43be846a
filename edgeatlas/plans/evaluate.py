"""Labelled questions run against an index: scores per tool, calibration per rule, latencies, the text-search baseline, reports and the gate."""

from __future__ import annotations

import json
import math
import time
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeatlas.functions.names import normal_key
from edgeatlas.operators import evaluation, graph
from edgeatlas.operators.baseline import answers
from edgeatlas.plans.engine import Engine
from edgeatlas.plans.envelope import ToolError

ANSWERED_FROM, LIMIT = 0.5, 200
QUESTIONS = "id string, tool string, expected array<string>, answered array<string>, ms double"


@dataclass
class Golden:
    id: str
    tool: str
    args: dict[str, str]
    expected: list[str]
    ci: bool = False
    note: str = ""


@dataclass
class Results:
    scores: list[dict[str, Any]] = field(default_factory=list)
    tools: list[dict[str, Any]] = field(default_factory=list)
    rules: list[dict[str, Any]] = field(default_factory=list)
    latency: dict[str, float] = field(default_factory=dict)
    baseline: list[dict[str, Any]] = field(default_factory=list)


def load_golden(path: str | Path) -> list[Golden]:
    out = [Golden(**q) for q in yaml.safe_load(Path(path).read_text(encoding="utf-8"))]
    if twice := sorted({g.id for g in out if sum(x.id == g.id for x in out) > 1}):
        raise ValueError(f"question ids must be unique: {', '.join(twice)}")
    return out


def nearest_rank(values: list[float], q: float) -> float:
    return sorted(values)[math.ceil(q * len(values)) - 1]


def ask(engine: Engine, g: Golden) -> tuple[list[str], list[tuple[str, bool]]]:
    """What the tool answers at the usual threshold, and each edge's rule with whether it is right, at none."""
    tool = engine.tools()[g.tool]
    try:
        if g.tool == "find_config_key":
            key = normal_key(g.args["pattern"])
            return sorted({f"{p['repo']}:{p['path']}:{p['line']}" for d in tool(**g.args).data if d["key"] == key for p in (*d["definitions"], *d["reads"])}), []
        if g.tool == "find_path":
            return [d["symbol"] for d in tool(**g.args).data], []
        a = tool(**g.args, min_confidence=0.0, limit=LIMIT)
    except ToolError:
        return [], []
    end = "from" if g.tool == "what_calls" else "to"
    pairs = [(d[end], e["rule"], e["confidence"]) for d, e in zip(a.data, a.evidence, strict=True)]
    return sorted({n for n, _, c in pairs if c >= ANSWERED_FROM}), [(r, n in g.expected) for n, r, _ in pairs]


def baseline(spark: SparkSession, golden: list[Golden], texts: DataFrame) -> list[dict[str, Any]]:
    """Scores per tool of text search over ``texts`` (repo, path, text); paths have no such answer."""
    rows = [(g.id, g.tool, g.args.get("symbol") or g.args.get("pattern"), g.expected) for g in golden if g.tool in ("what_calls", "what_does_it_call", "find_config_key")]
    q = spark.createDataFrame(rows, "id string, tool string, subject string, expected array<string>")
    got = q.join(answers(q, texts), "id", "left").withColumn("answered", F.coalesce("answered", F.array().cast("array<string>")))
    return [r.asDict() for r in evaluation.by_tool(evaluation.score(got)).orderBy("tool").collect()]


def run(spark: SparkSession, engine: Engine, golden: list[Golden], texts: DataFrame | None = None) -> Results:
    """Every question asked; with ``texts`` (repo, path, text), text search's scores beside the engine's."""
    rows, hits = [], []
    for g in golden:
        began = time.perf_counter()
        answered, own = ask(engine, g)
        rows.append((g.id, g.tool, g.expected, answered, (time.perf_counter() - began) * 1000))
        hits += own
    q = spark.createDataFrame(rows, QUESTIONS)
    scores = evaluation.score(q)
    rules = evaluation.calibration(spark.createDataFrame(hits, "rule string, right boolean"), graph.rule_table(spark)).orderBy(F.desc("nominal"), "rule")
    ms = [r[-1] for r in rows]
    return Results([r.asDict() for r in scores.orderBy("id").collect()], [r.asDict() for r in evaluation.by_tool(scores).orderBy("tool").collect()], [r.asDict() for r in rules.collect()], {"p50": nearest_rank(ms, 0.5), "p95": nearest_rank(ms, 0.95)} if ms else {}, baseline(spark, golden, texts) if texts is not None else [])


def write_report(results: Results, folder: str | Path) -> None:
    folder = Path(folder)
    folder.mkdir(parents=True, exist_ok=True)
    (folder / "results.json").write_text(json.dumps(vars(results), indent=1))
    (folder / "baseline.json").write_text(json.dumps({r["tool"]: round(r["f1"], 4) for r in results.tools}, indent=1))
    search = {r["tool"]: f"{r['f1']:.2f}" for r in results.baseline}
    table = ["| tool | n | precision | recall | F1 | F1 of text search |", "|-|-|-|-|-|-|"] + [f"| {r['tool']} | {r['n']} | {r['precision']:.2f} | {r['recall']:.2f} | {r['f1']:.2f} | {search.get(r['tool'], '-')} |" for r in results.tools]
    rules = ["| rule | nominal | observed | edges |", "|-|-|-|-|"] + [f"| {r['rule']} | {r['nominal']:.2f} | {r['observed']:.2f} | {r['n']} |" for r in results.rules]
    latency = ", ".join(f"{k} {v:.0f} ms" for k, v in results.latency.items())
    (folder / "report.md").write_text("\n".join([f"Latency: {latency}", "", *table, "", *rules, ""]))


def gate(results: Results, baseline: str | Path, spark: SparkSession) -> list[str]:
    """One line per tool whose F1 fell below the baseline by more than the tolerance."""
    before = json.loads(Path(baseline).read_text())
    now = spark.createDataFrame([(r["tool"], r["f1"]) for r in results.tools], "tool string, f1 double")
    base = spark.createDataFrame([(k, float(v)) for k, v in before.items()], "tool string, f1 double")
    return [f"{r['tool']}: {r['before']:.4f} -> {r['f1']:.4f}" for r in evaluation.regressions(now, base).orderBy("tool").collect()]
