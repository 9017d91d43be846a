"""The nine questions over an index, each an ``Answer`` with evidence."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeatlas.operators import config_keys, graph, overview, symbols as sym
from edgeatlas.operators.trigrams import candidates
from edgeatlas.plans.envelope import Answer, HeadCache, ToolError, weakest, with_staleness
from edgeatlas.plans.index import Catalog
from edgeatlas.sources.repos import head_or_none

ENTRY_POINTS_SHOWN, MODULES_SHOWN, HOTSPOTS_SHOWN = 50, 10, 10


class Engine:
    def __init__(self, spark: SparkSession, folder: str, head_fn: Callable[[str], str | None] | None = None):
        self.spark, self.catalog, self.head = spark, Catalog(spark, folder), HeadCache(head_fn or head_or_none)
        self.kept: tuple[Any, DataFrame, DataFrame] | None = None

    def tools(self) -> dict[str, Callable[..., Answer]]:
        return {f.__name__: f for f in (self.status, self.search_symbols, self.get_symbol, self.what_calls, self.what_does_it_call, self.find_path, self.find_config_key, self.repo_overview, self.explain_edge)}

    # ---- views

    def views(self) -> tuple[DataFrame, DataFrame]:
        """(symbols, edges) of the current snapshot, joined once and cached."""
        at = self.catalog.current()
        if self.kept is None or self.kept[0] != at:
            t = self.catalog.table
            repos = t("repos").select(F.col("id").alias("repo_id"), F.col("name").alias("repo"))
            files = t("files").join(repos, "repo_id").select(F.col("id").alias("file_id"), "repo", "path", "lang", "module")
            s = t("symbols").withColumnRenamed("id", "symbol_id").withColumn("line", F.col("line_start")).join(files, "file_id")
            name = s.select(F.col("symbol_id").alias("from_id"), F.col("qualified_name").alias("from_name"))
            refs = t("refs").select(F.col("id").alias("ref_id"), "file_id", "line", "note").join(files.select("file_id", "repo", "path"), "file_id")
            e = t("edges").drop("file_id").withColumnsRenamed({"from_symbol_id": "from_id", "to_symbol_id": "to_id"}).join(refs, "ref_id").join(name, "from_id").join(name.withColumnsRenamed({"from_id": "to_id", "from_name": "to_name"}), "to_id")
            self.kept = (at, s.cache(), e.cache())
        return self.kept[1], self.kept[2]

    def answer(self, data: list[Any], evidence: list[dict[str, Any]], confidence: float = 1.0, notes: list[str] | None = None, sources: list[str] | None = None, repos: set[str] | None = None) -> Answer:
        names = repos if repos is not None else {e["repo"] for e in evidence if e.get("repo")}
        rows = [r.asDict() for r in self.catalog.table("repos").where(F.col("name").isin(*names)).collect()] if names else []
        return with_staleness(Answer(data, evidence, weakest(sources or []), confidence=confidence, notes=notes or []), rows, self.head)

    # ---- tools

    def status(self) -> Answer:
        t = self.catalog.table
        repos = [r.asDict() for r in t("repos").orderBy("name").collect()]
        if not repos:
            raise ToolError("not_indexed", "the index is empty", "index a folder with repositories")
        f = t("files").join(t("repos").select(F.col("id").alias("repo_id"), F.col("name").alias("repo")), "repo_id")
        s = t("symbols").join(f.select(F.col("id").alias("file_id"), "repo"), "file_id")
        counts = {r["repo"]: r for r in overview.per_repo(t("repos").select(F.col("name").alias("repo")), f, s).collect()}
        totals = overview.resolved_ratio(t("refs").select(F.col("id").alias("ref_id"), "kind"), t("edges")).first().asDict()
        run = t("index_runs").orderBy(F.desc("id")).first().asDict()
        loose = overview.unresolved(t("refs").where("kind = 'curated'").withColumnRenamed("id", "ref_id"), t("edges")).count()
        data = [{"repo": r["name"], "files": counts[r["name"]]["n_files"], "symbols": counts[r["name"]]["n_symbols"], "indexed_sha": r["head_sha"], "current_sha": self.head(r["path"])} for r in repos]
        notes = [f"{loose} declared links could not be resolved"] if loose else []
        return self.answer([{"repos": data, **totals, "last_run": run, "unresolved_links": loose}], [], notes=notes, repos={r["name"] for r in repos})

    def search_symbols(self, query: str, kind: str | None = None, repo: str | None = None, limit: int = 25) -> Answer:
        s, _ = self.views()
        if len(query) >= 3:  # what the trigram index leaves, compared with the names as ever
            needle = self.spark.createDataFrame([(query,)], "needle string")
            s = s.join(candidates(self.catalog.postings_of(query), needle).select("symbol_id"), "symbol_id", "left_semi")
        rows = sym.search(s, query, kind, repo, limit).collect()
        pool = s.where(sym.matches(query))
        pool = pool.where(F.col("kind") == kind) if kind else pool
        more = (pool.where(F.col("repo") == repo) if repo else pool).count() - len(rows)
        return self.answer([_symbol(r) for r in rows], [_place(r) for r in rows], notes=[f"truncated: {more} more; narrow with repo= or kind="] if more else [])

    def get_symbol(self, name: str) -> Answer:
        s, _ = self.views()
        ids = sym.resolve_symbol(s, name)
        r = s.where(F.col("symbol_id").isin(ids)).orderBy("symbol_id").first()
        q = r["qualified_name"]
        below = s.where((F.col("repo") == r["repo"]) & F.col("qualified_name").startswith(q + ".") & ~F.substring("qualified_name", len(q) + 2, 1000).contains("."))
        rows = below.orderBy("line", "symbol_id").limit(sym.CHILDREN_SCANNED + 1).collect()
        kinds: dict[str, list[str]] = {}
        for c in rows[: sym.CHILDREN_SCANNED]:
            kinds.setdefault(c["kind"], []).append(c["qualified_name"])
        more = sum(max(0, len(v) - sym.CHILDREN_SHOWN) for v in kinds.values())
        notes = [f"truncated: children capped at {sym.CHILDREN_SHOWN} per kind; {more} more not shown"] if more else []
        notes += [f"truncated: child scan capped at {sym.CHILDREN_SCANNED} rows; more children may exist"] if len(rows) > sym.CHILDREN_SCANNED else []
        detail = _symbol(r) | {"container": q.rpartition(".")[0] or None, "visibility": r["visibility"], "param_count": r["param_count"], "declarations": len(ids), "children": {k: v[: sym.CHILDREN_SHOWN] for k, v in kinds.items()}}
        return self.answer([detail], [_place(r)], notes=notes)

    def _hidden(self, e: DataFrame, starts: DataFrame, min_confidence: float, reverse: bool) -> tuple[list[str], float]:
        """The note on the symbol's own edges under the threshold, and the best one's confidence (1 without any)."""
        under = graph.hidden(e, starts, min_confidence, reverse).first()
        if not under:
            return [], 1.0
        noun = "candidate" if under["n_hidden"] == 1 else "candidates"
        rules = under["rules"].replace(",", ", ")
        return [f"{under['n_hidden']} lower-confidence {noun} hidden (rules: {rules}); pass min_confidence={under['suggested']:g} to see them"], under["max_confidence"]

    def _edges(self, symbol: str, depth: int, min_confidence: float, limit: int, reverse: bool) -> Answer:
        graph.check_range("limit", limit, 1, graph.MAX_LIMIT)
        s, e = self.views()
        ids = sym.resolve_symbol(s, symbol)
        starts = self.spark.createDataFrame([("q", i) for i in ids], "query_id string, id long")
        met = graph.traverse(e, starts, depth, min_confidence, None, reverse)
        # what is not shown is counted where it is; only the rows shown come here
        shown, total = met.orderBy(*graph.order()).limit(limit).collect(), met.count()
        end = "from" if reverse else "to"
        notes = [f"{r[end + '_name']}: 1 of {r['candidates']} candidates (matched by name only)" for r in shown if r["rule"] == "ambiguous"]
        if total > limit:
            notes.append(f"truncated: {total - limit} more; lower depth or raise min_confidence")
        if not shown:
            notes.append(f"no {'callers' if reverse else 'callees'} at min_confidence >= {min_confidence}")
        note, best = self._hidden(e, starts, min_confidence, reverse)
        evidence = [{"repo": r["repo"], "path": r["path"], "line": r["line"], "rule": r["rule"], "confidence": r["confidence"]} for r in shown]
        data = [{"from": r["from_name"], "to": r["to_name"], "kind": r["kind"], "depth": r["depth"]} for r in shown]
        return self.answer(data, evidence, min((r["confidence"] for r in shown), default=best), notes + note, ["curated" if r["rule"] == "curated" else "derived" for r in shown] or ["derived"])

    def what_calls(self, symbol: str, depth: int = 1, min_confidence: float = 0.5, limit: int = 25) -> Answer:
        return self._edges(symbol, depth, min_confidence, limit, True)

    def what_does_it_call(self, symbol: str, depth: int = 1, min_confidence: float = 0.5, limit: int = 25) -> Answer:
        return self._edges(symbol, depth, min_confidence, limit, False)

    def find_path(self, from_symbol: str, to_symbol: str, max_depth: int = 6, min_confidence: float = 0.5) -> Answer:
        s, e = self.views()
        a, b = sym.resolve_symbol(s, from_symbol), sym.resolve_symbol(s, to_symbol)
        pairs = self.spark.createDataFrame([("q", x, y) for x in a for y in b], "query_id string, from_id long, to_id long")
        rows = graph.shortest_paths(e, pairs, max_depth, min_confidence).orderBy("step").collect()
        names = {r["symbol_id"]: r for r in s.where(F.col("symbol_id").isin(*{r["symbol_id"] for r in rows})).collect()} if rows else {}
        data = [{"symbol": names[r["symbol_id"]]["qualified_name"], "via": r["via_kind"]} for r in rows]
        evidence = [{"repo": names[r["symbol_id"]]["repo"], "path": r["via_path"], "line": r["via_line"], "rule": r["via_rule"], "confidence": r["via_confidence"]} for r in rows]
        confidence = min((r["via_confidence"] for r in rows if r["via_confidence"] is not None), default=1.0)
        notes = []
        if not rows:
            starts = self.spark.createDataFrame([("q", x) for x in a], "query_id string, id long")
            notes = [f"no call path within {max_depth} hops at min_confidence >= {min_confidence}", *self._hidden(e, starts, min_confidence, False)[0]]
        return self.answer(data, evidence, confidence, notes, ["derived"] if len(rows) > 1 else [])

    def find_config_key(self, pattern: str, limit: int = 25) -> Answer:
        graph.check_range("limit", limit, 1, graph.MAX_LIMIT)
        t = self.catalog.table
        files = t("files").join(t("repos").select(F.col("id").alias("repo_id"), F.col("name").alias("repo")), "repo_id").select(F.col("id").alias("file_id"), "repo", "path")
        rows = config_keys.find(t("config_keys").join(files, "file_id"), pattern, limit).orderBy("key_norm").collect()
        total = config_keys.find(t("config_keys").join(files, "file_id"), pattern, None).count() if len(rows) == limit else len(rows)
        data = [{"key": r["key_norm"], "definitions": [x.asDict() for x in r["definitions"]], "reads": [x.asDict() for x in r["reads"]]} for r in rows]
        notes = [f"truncated: {total - limit} more keys; use a more specific pattern"] if total > limit else []
        notes += [f"truncated: {r['key_norm']} has {r['n_' + what] - config_keys.SHOWN} more {what}" for r in rows for what in ("definitions", "reads") if r["n_" + what] > config_keys.SHOWN]
        notes += [] if rows else [f"no config keys match {pattern!r}"]
        return self.answer(data, [x for d in data for x in (*d["definitions"], *d["reads"])], notes=notes)

    def repo_overview(self, repo: str) -> Answer:
        t, (s, e) = self.catalog.table, self.views()
        known = t("repos").where(F.col("name") == repo).first()
        if known is None:
            raise ToolError("not_found", f"no repository {repo!r}", "", [r["name"] for r in t("repos").orderBy("name").collect()])
        files = t("files").where(F.col("repo_id") == known["id"])
        langs = {r["lang"]: {"files": r["n_files"], "loc": r["loc"]} for r in overview.languages(files.withColumn("repo", F.lit(repo))).orderBy("lang").collect()}
        entries = t("entry_points").join(files.select(F.col("id").alias("file_id"), "path"), "file_id")
        points, n_points = entries.orderBy("path", "line").limit(ENTRY_POINTS_SHOWN).collect(), entries.count()
        hot = overview.hotspots(e, s.where(F.col("repo") == repo)).join(s.select(F.col("symbol_id").alias("to_id"), "qualified_name"), "to_id").orderBy(F.desc("n_callers"), "to_id").collect()
        modules = overview.top_modules(s, repo).collect()
        data = {"repo": repo, "languages": langs, "top_modules": [(r["module"], r["n_symbols"]) for r in modules], "entry_points": [{"kind": p["kind"], "name": p["name"], "path": p["path"], "line": p["line"]} for p in points], "hotspots": [(r["qualified_name"], r["n_callers"]) for r in hot]}
        return self.answer([data], [], notes=[f"truncated: {n_points - len(points)} more entry points"] if n_points > len(points) else [], repos={repo})

    def explain_edge(self, from_symbol: str, to_symbol: str) -> Answer:
        s, e = self.views()
        a, b = sym.resolve_symbol(s, from_symbol), sym.resolve_symbol(s, to_symbol)
        rows = graph.explain(e, a, b).collect()
        named = lambda ids: s.where(F.col("symbol_id").isin(ids)).first()["qualified_name"]
        data = [{"from": r["from_name"], "to": r["to_name"], "kind": r["kind"], "rule": r["rule"], "meaning": r["meaning"]} for r in rows]
        evidence = [{"path": r["path"], "line": r["line"], "rule": r["rule"], "confidence": r["confidence"]} for r in rows]
        return self.answer(data, evidence, min((r["confidence"] for r in rows), default=1.0), [] if rows else [f"no edge from {named(a)} to {named(b)}"], ["curated" if r["rule"] == "curated" else "derived" for r in rows])


def _symbol(r) -> dict[str, Any]:
    return {"qualified_name": r["qualified_name"], "kind": r["kind"], "name": r["name"], "repo": r["repo"]}


def _place(r) -> dict[str, Any]:
    return {"repo": r["repo"], "path": r["path"], "line": r["line"]}
