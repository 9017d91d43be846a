"""Repositories on disk, the catalog, the nine questions."""

import datetime as dt
import subprocess

import pytest

from edgeatlas.plans import index as ix
from tests.corpus import CORPUS, EDGES
from edgeatlas.plans.engine import Engine
from edgeatlas.plans.envelope import Answer, ToolError, ToolRunner
from edgeatlas.sources import audit, repos as R
from edgeatlas.streaming.audit import read, windowed


def write(root, corpus):
    for repo, files in corpus.items():
        for path, text in files.items():
            p = root / repo / path
            p.parent.mkdir(parents=True, exist_ok=True)
            p.write_text(text)
        git = lambda *a: subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@example.invalid", "-C", str(root / repo), *a], check=True, capture_output=True)  # noqa: B023, E731
        if not (root / repo / ".git").exists():
            git("init", "-q")
        git("add", "-A")
        git("commit", "-qm", "x", "--allow-empty")


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    root, store = tmp_path_factory.mktemp("root"), tmp_path_factory.mktemp("catalog")
    write(root, CORPUS)
    catalog = ix.Catalog(spark, store)
    first = ix.index_root(spark, catalog, str(root))
    return root, store, first


def names(engine):
    _, e = engine.views()
    return {(r["from_name"], r["to_name"], r["kind"], r["rule"]) for r in e.collect()}


def test_questions(spark, built):
    root, store, first = built
    assert first["added"] == sum(len(f) for f in CORPUS.values())
    g = Engine(spark, str(store))
    assert names(g) == EDGES
    a = g.what_calls("store.pricing.quote")
    assert [d["from"] for d in a.data] == ["store.basket.Basket.checkout"] * 2
    assert a.confidence == 0.9 and not a.stale and a.as_of[0]["repo"] == "store" and a.evidence[0]["line"] == 16
    assert {d["to"] for d in g.what_does_it_call("run_store", depth=2).data} >= {"store.basket.Basket.checkout", "ledger.entries.post_entry"}
    assert [d["symbol"] for d in g.find_path("store.main.run_store", "store.pricing._ask").data] == ["store.main.run_store", "store.basket.Basket.checkout", "store.pricing.quote", "store.pricing._ask"]
    assert g.explain_edge("Dispatch.Route", "Dispatch.IRoute").data[0]["rule"] == "same_namespace"
    assert g.find_config_key("Quote__Address").data[0]["key"] == "quote:address"
    assert g.search_symbols("quote").data[0]["qualified_name"] == "store.pricing.quote"
    children = g.get_symbol("store.basket.Basket").data[0]["children"]
    assert children == {"method": ["store.basket.Basket.checkout", "store.basket.Basket.verify"]}
    over = g.repo_overview("store").data[0]
    assert over["languages"]["python"]["files"] == 5 and ("store.pricing.quote", 1) in over["hotspots"]
    st = g.status().data[0]
    assert st["n_edges"] == len(EDGES) + 2 and st["unresolved_links"] == 0
    notes = lambda a: [n for n in a.notes if "HEAD" not in n]
    assert notes(g.what_calls("store.pricing.quote", limit=1)) == ["truncated: 1 more; lower depth or raise min_confidence"]
    assert notes(g.what_does_it_call("store.pricing._ask")) == ["no callees at min_confidence >= 0.5"]
    assert notes(g.find_path("store.pricing._ask", "store.main.run_store")) == ["no call path within 6 hops at min_confidence >= 0.5"]
    assert notes(g.explain_edge("store.pricing._ask", "store.pricing.quote")) == ["no edge from store.pricing._ask to store.pricing.quote"]
    assert notes(g.find_config_key("nothing_of_the_kind")) == ["no config keys match 'nothing_of_the_kind'"]
    assert notes(g.find_config_key("*", limit=1))[0].startswith("truncated: ")
    assert notes(g.search_symbols("store", limit=1))[0].endswith(" more; narrow with repo= or kind=")
    for name, error in (("nothing_like_it", "not_found"), ("", "invalid_argument")):
        with pytest.raises(ToolError) as e:
            g.what_calls(name)
        assert e.value.error == error
    with pytest.raises(ToolError) as e:
        g.get_symbol("Base.audit.x.y")
    assert e.value.error == "not_found"


def test_steps_equal_all_at_once(spark, built, tmp_path):
    root, store, _ = built
    catalog = ix.Catalog(spark, store)
    assert ix.index_root(spark, catalog, str(root))["same"] == sum(len(f) for f in CORPUS.values())
    changed = {"ledger": {"src/ledger/news.py": "def announce_sale(items):\n    return again(items)\n\ndef again(x):\n    return x\n"}}
    write(root, changed)
    counts = ix.index_root(spark, catalog, str(root))
    assert counts["changed"] == 1 and counts["same"] == sum(len(f) for f in CORPUS.values()) - 1
    fresh = ix.Catalog(spark, tmp_path / "fresh")
    ix.index_root(spark, fresh, str(root))
    assert names(Engine(spark, str(store))) == names(Engine(spark, str(tmp_path / "fresh")))
    assert ix.Catalog(spark, store).table("index_runs").count() == 3
    (root / "ledger/src/ledger/news.py").write_text("def renamed_sale(items):\n    return items\n")
    subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@example.invalid", "-C", str(root / "ledger"), "commit", "-qam", "y"], check=True, capture_output=True)
    before = catalog.store.manifest()["tables"]["facts"]["fragments"]
    ix.index_root(spark, catalog, str(root))
    after = catalog.store.manifest()["tables"]["facts"]["fragments"]
    assert set(before) == set(after) and sum(before[b] != after[b] for b in after) == 1, "one changed file rewrites its fragment"
    names_left = {r.qualified_name for r in catalog.table("symbols").collect()}
    assert "ledger.news.renamed_sale" in names_left and "ledger.news.announce_sale" not in names_left
    assert len(catalog.store.versions()) == 1
    folders = {p for t in catalog.store.manifest()["tables"].values() for p in t["fragments"].values()}
    assert {str(p.parent.relative_to(store)) for p in store.rglob("part-*.parquet")} == folders, "no other file is left"
    (root / "carriers/.git").rename(root / "carriers/away")
    (root / "carriers/.git").mkdir()  # git can't read it now: its rows stay
    counts = ix.index_root(spark, catalog, str(root))
    assert counts["failed"] == 1 and counts["same"] == sum(len(f) for f in CORPUS.values())
    stale = Engine(spark, str(store), head_fn=lambda path: None).what_calls("store.pricing.quote")
    assert stale.stale and stale.notes == ["HEAD could not be read for store (git is missing or the repo path is gone), so freshness is unknown and the answer is marked stale"]


def test_no_index_and_newer_schema(spark, tmp_path):
    with pytest.raises(ToolError) as e:
        Engine(spark, str(tmp_path)).status()
    assert e.value.error == "not_indexed"
    store = ix.Catalog(spark, tmp_path).store
    store.commit(store.start(schema_version="9"))
    with pytest.raises(ToolError):
        ix.Catalog(spark, tmp_path).table("files")


def test_projects():
    tracked = ["a/pyproject.toml", "a/x.py", "b/c/d.csproj", "b/s.sln", "e/f.csproj", "setup.py", "z.py"]
    assert R.project_roots(tracked) == ["a", "b", "e"]
    assert R.project_roots(tracked, "off") == []
    assert R.project_roots(tracked, ["q/"]) == ["q"]


def test_discovery_skips_links_and_nested(tmp_path):
    for p in ("r1/.git", "r1/sub/.git", "x/r2/.git", ".hidden/r3/.git", "node_modules/r4/.git", "a/b/c/d/e/.git"):
        (tmp_path / p).mkdir(parents=True)
    (tmp_path / "link").symlink_to(tmp_path / "x")
    assert [p.relative_to(tmp_path).as_posix() for p in R.discover_repos(tmp_path)] == ["r1", "x/r2"]


def test_config_file(tmp_path):
    p = tmp_path / "c.toml"
    p.write_text('include = ["*.py"]\n')
    assert R.load_config(p).include == ["*.py"]
    for bad in ("nope = 1", "include = 'secret'", "extra_redaction_patterns = ['(']", "= ="):
        p.write_text(bad)
        with pytest.raises(R.ConfigError) as e:
            R.load_config(p)
        assert "secret" not in str(e.value)


def test_runner_audits_and_hides_failures(tmp_path):
    seen = []
    run = ToolRunner({"ok": lambda x: Answer([x]), "boom": lambda: 1 / 0}, audit=lambda **k: seen.append(k))
    assert run.run("ok", {"x": 1})["data"] == [1]
    assert run.run("ok", {"y": 1})["error"] == "invalid_argument"
    assert run.run("boom", {})["error"] == "internal"
    assert run.run("gone", {})["error"] == "invalid_argument"
    assert [k["error"] for k in seen] == [None, "invalid_argument", "internal", "invalid_argument"]


def test_audit_log_and_stream(spark, tmp_path):
    day = [dt.datetime(2024, 1, 1, 9, tzinfo=dt.UTC)]
    log = audit.AuditLog(str(tmp_path), now=lambda: day[0])
    for k in range(4):
        log(tool="status", args={"n": k}, result_count=1, duration_ms=k * 1.005, client="", error="internal" if k == 3 else None)
    day[0] += dt.timedelta(days=1)
    log(tool="find_path", args={}, result_count=0, duration_ms=5, client="", error=None)
    got = {r["tool"]: (r["n_calls"], r["n_errors"], r["p50"], r["p95"]) for r in audit.summary(audit.entries(spark, str(tmp_path))).collect()}
    assert got == {"status": (4, 1, 1.5, 3.01), "find_path": (1, 0, 5.0, 5.0)} or got["status"][:2] == (4, 1)
    assert audit.entries(spark, str(tmp_path), 1).count() == 1
    q = windowed(read(spark, str(tmp_path))).writeStream.format("memory").queryName("audit_t").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("audit_t").agg({"n_calls": "sum"}).first()[0] == 5
