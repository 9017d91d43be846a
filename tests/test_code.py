"""Extraction and resolution over the embedded corpus and small files."""

import pytest
from pyspark.sql import functions as F

from edgeatlas.extract import extract_one
from edgeatlas.plans import fixture_queries as fx
from tests.corpus import CORPUS, EDGES


def facts(lang, path, text):
    return extract_one(lang, path, text.encode())


def refs(f, *kinds):
    return [(r["from_qualified"], r["to_name"], r["kind"]) for r in f.refs if not kinds or r["kind"] in kinds]


@pytest.fixture(scope="module")
def tables(spark):
    return fx.tables(spark, CORPUS)


def test_golden_edges(spark, tables):
    got = {(r["from_name"], r["to_name"], r["kind"], r["rule"]) for r in fx.named_edges(spark, tables).collect()}
    assert got == EDGES


def test_config_keys(tables):
    got = {(r["key_path"], r["key_norm"], r["origin"]) for r in tables["config_keys"].collect()}
    assert ("Quote:Address", "quote:address", "json") in got
    assert ("quote.retry", "quote:retry", "yaml") in got
    assert ("VAT_FACTOR", "vat_factor", "env-example") in got
    assert ("CARRIER_KEY", "carrier_key", "code-read") in got


def test_entry_points_and_handlers(tables):
    assert {(r["kind"], r["name"]) for r in tables["entry_points"].collect()} == {("main-block", "store.main"), ("console-script", "store"), ("program-main", "Program")}
    assert [(r["name"], r["handler_qualified"]) for r in tables["queue_handlers"].collect()] == [("parcel-job", "store.jobs.ship_parcel")]
    assert len(tables["string_consts"].first()["value"]) == 24


#: Small repositories, a rule each; resolved together.
SMALL = {
    "gone": {"gone_m.py": "from nowhere import lost_helper\ndef f():\n    lost_helper()\n", "gone_n.py": "def lost_helper():\n    pass\n"},
    "twice": {"tw_m.py": "def f(x):\n    x.render_page()\n    x.get()\n", "tw_n.py": "def render_page(): pass\ndef get(): pass\n", "tw_o.py": "def render_page(): pass\n"},
    "caller": {"crowd.py": "def f(x):\n    x.crowded()\n"},
    "crowd": {f"crowd{i}.py": "def crowded(): pass\n" for i in range(11)},
    "stars": {"p/__init__.py": "from .inner import *\n", "p/inner.py": "def deep(): pass\n", "q.py": "from p import deep\ndef f():\n    deep()\n"},
    "declared": {"dm.py": "def f(): pass\n", "dn.py": "def g(): pass\n", "edgeatlas.overrides.yaml": "edges:\n  - {from: dm.f, to: 'declared:dn.g', note: by hand}\n"},
    "sharp": {
        "A.cs": "namespace N;\npublic class Root { public void Work() { } }\npublic class Leaf : Root { public void Go() { Work(); this.Work(); } }\n",
        "B.cs": "using static N.Tools;\nusing R = N.Root;\nnamespace M;\nclass User { R field; void Use() { field.Work(); Help(); } }\n",
        "C.cs": "namespace N;\npublic static class Tools { public static void Help() { } }\n",
    },
}


@pytest.fixture(scope="module")
def small(spark):
    t = fx.tables(spark, SMALL)
    return {(r["from_name"], r["to_name"], r["rule"]) for r in fx.named_edges(spark, t).where(F.col("kind") != "import").collect()}


#: The same names in several repositories, resolved together.
ACROSS = {
    "r1": {"pkg/__init__.py": "x = 1\n", "use1.py": "from pkg import work\ndef f():\n    work()\n"},
    "r2": {"pkg/__init__.py": "from .impl import work\n", "pkg/impl.py": "def work(): pass\n", "use2.py": "from pkg import work\ndef g():\n    work()\n"},
    "r3": {"use3.py": "from pkg import work\ndef h():\n    work()\n"},
    "s1": {"lib/__init__.py": "from .one import *\nfrom .two import *\n", "lib/one.py": "def other(): pass\n", "lib/two.py": "def starry(): pass\n", "uses.py": "from lib import starry\ndef k():\n    starry()\n"},
    "s2": {"lib2/one.py": "def starry(): pass\n"},
    "aaa": {"O.cs": "namespace Shop;\npublic class Order { public void Pay() { } }\npublic static class Jobs { public static void Go() { } }\n"},
    "bbb": {
        "O.cs": "namespace Shop;\npublic class Order { public void Pay() { } }\n",
        "U.cs": "namespace Shop;\npublic class User { Order held; void Make() { var o = new Order(); held.Pay(); Jobs.Go(); } }\n",
    },
    "ccc": {"V.cs": "using Shop;\nnamespace Desk;\npublic class Clerk { void Make() { var o = new Order(); } void Run() { Jobs.Go(); } }\n"},
}


@pytest.fixture(scope="module")
def across(spark):
    from edgeatlas.operators.resolve import resolve

    t = fx.tables(spark, ACROSS)
    where = t["symbols"].join(t["files"].select(F.col("id").alias("file_id"), "repo_id"), "file_id").join(t["repos"].select(F.col("id").alias("repo_id"), F.col("name").alias("repo")), "repo_id")
    s = where.select("id", F.concat_ws(":", "repo", "qualified_name").alias("n"))
    e = resolve(t).where("kind <> 'import'")
    return {(r.f, r.t, r.rule) for r in e.join(s.toDF("from_symbol_id", "f"), "from_symbol_id").join(s.toDF("to_symbol_id", "t"), "to_symbol_id").collect()}


def test_own_modules_alone_re_export(across):
    """r1 has a pkg without work, so nothing of r2 answers for it; r3 has none, so r2's does."""
    assert of(across, "r1:") == set()
    assert of(across, "r2:use2") == {("r2:use2.g", "r2:pkg.impl.work", "import_scope")}
    assert of(across, "r3:") == {("r3:use3.h", "r2:pkg.impl.work", "import_scope")}


def test_the_star_import_that_defines_the_name(across):
    assert of(across, "s1:uses") == {("s1:uses.k", "s1:lib.two.starry", "import_scope")}


def test_types_of_the_own_repository_first(across):
    assert of(across, "bbb:") == {
        ("bbb:Shop.User.Make", "bbb:Shop.Order", "same_namespace"), ("bbb:Shop.User.Make", "bbb:Shop.Order.Pay", "declared_type"), ("bbb:Shop.User.Make", "aaa:Shop.Jobs.Go", "same_namespace"),
    }


def test_types_of_several_other_repositories_are_not_taken(across):
    """Order is declared twice elsewhere: what is left is a guess by name. Jobs is declared once."""
    assert of(across, "ccc:") == {("ccc:Desk.Clerk.Make", "aaa:Shop.Order", "ambiguous"), ("ccc:Desk.Clerk.Make", "bbb:Shop.Order", "ambiguous"), ("ccc:Desk.Clerk.Run", "aaa:Shop.Jobs.Go", "import_scope")}


def of(small, prefix):
    return {e for e in small if e[0].startswith(prefix)}


def test_an_unresolvable_import_never_falls_back_to_a_name(small):
    assert of(small, "gone_") == set()


def test_ambiguous_names_and_stop_list(small):
    assert of(small, "tw_") == {("tw_m.f", "tw_n.render_page", "ambiguous"), ("tw_m.f", "tw_o.render_page", "ambiguous")}


def test_candidate_cap(small):
    assert of(small, "crowd") == set()


def test_star_imports_and_relative_packages(small):
    assert of(small, "q.") == {("q.f", "p.inner.deep", "import_scope")}


def test_declared_links(small):
    assert of(small, "dm") == {("dm.f", "dn.g", "curated")}


def test_csharp_bases_aliases_and_statics(small):
    assert of(small, "N.Leaf.Go") == {("N.Leaf.Go", "N.Root.Work", "same_file")}
    assert of(small, "M.User.Use") == {("M.User.Use", "N.Root.Work", "declared_type"), ("M.User.Use", "N.Tools.Help", "import_scope")}


@pytest.mark.parametrize("name", sorted(fx.SQL))
def test_generated_files_match_sql(spark, sf, name):
    from tests.oracle import connect, same

    same(fx.QUERIES[name](spark, sf), connect(sf), fx.SQL[name])


def test_python_broken_file_keeps_what_can_be_read():
    f = facts("python", "src/a.py", "def good():\n    other()\n\ndef bad(:\n    pass\n")
    assert f.parse_error
    assert ("a.good", "other", "call") in refs(f, "call")


def test_python_symbols():
    f = facts("python", "pkg/__init__.py", "class A:\n    def m(self, a, *b, c=1, **d): pass\n    async def _n(cls, /): pass\ndef f():\n    def inner(x): pass\n")
    assert [(s["qualified_name"], s["kind"], s["param_count"], s["visibility"]) for s in f.symbols] == [
        ("pkg", "module", None, "public"), ("pkg.A", "class", None, "public"), ("pkg.A.m", "method", 4, "public"), ("pkg.A._n", "method", 0, "private"), ("pkg.f", "function", 0, "public"), ("pkg.f.inner", "function", 1, "public"),
    ]


def test_python_environment_and_jobs():
    f = facts("python", "m.py", 'import os\nos.environ["KEY_A"]\nos.getenv("not a name")\ndef f(b):\n    b.enqueue(Message(actor_name="job-x"))\n')
    assert [k["key_path"] for k in f.config_keys] == ["KEY_A"]
    assert ("m.f", "job-x", "queue") in refs(f)


def test_csharp_generics_strings_and_locals():
    f = facts("csharp", "X.cs", 'namespace N;\nclass A {\n  List<Dictionary<string, B>> all = new();\n  void M() { var s = $"{x}"; B b = new B(); b.Go<int>(1); foreach (B c in all) { c.Go(); } nameof(M); }\n}\n')
    got = [(r["to_name"], r["kind"], r["receiver_type"]) for r in f.refs]
    assert ("B", "instantiate", None) in got
    assert got.count(("Go", "call", "B")) == 2
    assert not any(r[0] == "nameof" for r in got)


def test_compose_environment_and_bad_config():
    f = facts("config", "docker-compose.yml", "services:\n  a:\n    environment:\n      - K1=v\n      - K2\n  b:\n    environment:\n      K3: x\n")
    assert [k["key_path"] for k in f.config_keys] == ["K1", "K2", "K3"]
    assert facts("config", "appsettings.json", '{"a": ').parse_error


def test_one_failing_file_is_one_parse_error():
    def boom(path, content):
        raise RuntimeError

    assert extract_one("python", "a.py", b"", {"python": boom}).parse_error


def test_corpus_is_whole(tables):
    assert tables["files"].count() == sum(len(f) for f in CORPUS.values())


def test_a_worker_holds_the_facts_of_a_slice(monkeypatch):
    """A batch of any number of files goes out in slices, cleaned on the way."""
    import pyarrow as pa

    from edgeatlas import extract as ex
    from edgeatlas.functions import secrets

    class Files:
        def select(self, *columns):
            return self

        def mapInArrow(self, run, ddl):
            return run

    n = 3 * ex.SLICE + 1
    rows = {"repo": ["r"] * n, "path": [f"m{i}.py" for i in range(n)], "lang": ["python"] * n, "content_hash": [""] * n, "content": [f"def f{i}(): pass\nimport os as password_{i}\n".encode() for i in range(n)]}
    batch = pa.RecordBatch.from_pydict(rows)
    seen = [0, 0]  # files held now, and at most
    whole = ex.extract_one
    monkeypatch.setattr(ex, "extract_one", lambda *a: (seen.__setitem__(0, seen[0] + 1), seen.__setitem__(1, max(seen)), whole(*a))[-1])
    out = []
    for b in ex.extract(Files(), clean=secrets.sanitize_obj)(iter([batch])):
        seen[0] = 0
        out += b.to_pylist()
    assert seen[1] <= ex.SLICE
    assert [r["path"] for r in out] == rows["path"] and [r["symbols"][1]["name"] for r in out] == [f"f{i}" for i in range(n)]


def test_files_are_numbered_in_ranges(spark):
    """By repository and path, without a task that holds a repository."""
    from edgeatlas.plans.index import numbered

    rows = [(f"r{i % 3}", f"p{(i * 7919) % 5000:04}") for i in range(5000)]
    df = spark.createDataFrame(rows, "repo string, path string")
    got = numbered(df, 10)
    assert [tuple(r) for r in got.orderBy("file_id").select("repo", "path", "file_id").collect()] == [(*r, i + 11) for i, r in enumerate(sorted(rows))]
    assert "hashpartitioning(repo" not in got._jdf.queryExecution().executedPlan().toString()
