"""Command line: index, query, status, serve, audit, leak-scan, eval."""

from __future__ import annotations

import argparse
import json
import os
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from edgeatlas.functions import secrets
from edgeatlas.plans import evaluate
from edgeatlas.plans.engine import Engine
from edgeatlas.plans.envelope import ToolRunner
from edgeatlas.plans.index import Catalog, index_root
from edgeatlas.sources import audit
from edgeatlas.sources.repos import ConfigError, IngestError, load_config

NUMBERS = {"depth": int, "limit": int, "max_depth": int, "min_confidence": float}


def home() -> Path:
    return Path(os.environ.get("EDGEATLAS_HOME", Path.home() / ".edgeatlas"))


def arguments(pairs: list[str]) -> dict:
    out = {}
    for p in pairs:
        k, eq, v = p.partition("=")
        if not eq:
            raise SystemExit(f"not key=value: {p}")
        out[k] = NUMBERS.get(k, str)(v)
    return out


def scan_paths(paths: list[str]) -> list[str]:
    """``path:line: kind`` of every secret in the files, never its value."""
    found = []
    for p in map(Path, paths):
        for f in sorted(x for x in (p.rglob("*") if p.is_dir() else [p]) if x.is_file() and not x.is_symlink()):
            text = secrets.decode_text(f.read_bytes())
            for kind, s, _ in secrets.find_secrets(text) if text else []:
                found.append(f"{f}:{text.count(chr(10), 0, s) + 1}: {kind}")
    return found


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="edgeatlas")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("index")
    a.add_argument("root")
    for name in ("query", "status", "serve"):
        a = sub.add_parser(name)
        if name == "query":
            a.add_argument("tool")
            a.add_argument("args", nargs="*")
    a = sub.add_parser("audit")
    a.add_argument("what", choices=["tail", "stats"])
    a.add_argument("-n", type=int, default=20)
    a = sub.add_parser("leak-scan")
    a.add_argument("paths", nargs="+")
    a.add_argument("--fail-on-findings", action="store_true")
    a = sub.add_parser("eval")
    a.add_argument("golden")
    a.add_argument("--report")
    a.add_argument("--baseline")
    a.add_argument("--ci", action="store_true")
    o = p.parse_args(argv)
    if o.command == "leak-scan":
        found = scan_paths(o.paths)
        print("\n".join(found))
        return int(bool(found) and o.fail_on_findings)
    spark = SparkSession.builder.appName("edgeatlas").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    folder, logs = str(home() / "catalog"), str(home() / "audit")
    show = lambda x: print(json.dumps(x, indent=1, default=str))
    try:
        if o.command == "index":
            show(index_root(spark, Catalog(spark, folder), o.root, load_config(home() / "config.toml")))
        elif o.command == "audit":
            log = audit.entries(spark, logs)
            show([r.asDict() for r in (audit.tail(log, o.n) if o.what == "tail" else audit.summary(log).orderBy("tool")).collect()])
        elif o.command == "eval":
            golden = [g for g in evaluate.load_golden(o.golden) if g.ci or not o.ci]
            results = evaluate.run(spark, Engine(spark, folder), golden)
            if o.report:
                evaluate.write_report(results, o.report)
            show(results.tools)
            if o.baseline and (worse := evaluate.gate(results, o.baseline, spark)):
                print("\n".join(worse), file=sys.stderr)
                return 1
        else:
            runner = ToolRunner(Engine(spark, folder).tools(), audit.AuditLog(logs, secrets.sanitize_obj), secrets.sanitize_obj)
            if o.command == "serve":  # a request and an answer a line, as JSON
                for line in sys.stdin:
                    request = json.loads(line)
                    print(json.dumps(runner.run(request.get("tool", ""), request.get("args", {}), "serve"), default=str), flush=True)
                return 0
            out = runner.run(o.command if o.command == "status" else o.tool, {} if o.command == "status" else arguments(o.args), "cli")
            show(out)
            return int("error" in out)
    except (ConfigError, IngestError) as e:
        print(e, file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
