"""Statements, scopes and the text-search baseline against plain versions."""

import ast
import re

import pytest

from edgeatlas.extract import scopes
from edgeatlas.operators import baseline
from edgeatlas.plans import evaluate

CODE = '''import os
x = [
    1,
def_ == 3,
] \\
    + [4]


class A(
    B,
):
    """Text with
def not_one(): in it
    """

    def m(self, a={
        "k": 1}):
        s = """
  dedented()
"""
        helper(a); other(s)  # comment(call)

        if a:
            return self.m(a)
    # comment at a lesser indent
    async def n(self):
        def inner():
            helper(1)
        return inner()


def helper(v):
\treturn print(v)
helper(2)
'''


def plain_starts(text):
    """Statements of a file that parses: first lines of the nodes, decorators left out; clauses such as else by their words."""
    out = {n.lineno for n in ast.walk(ast.parse(text)) if isinstance(n, ast.stmt)}
    return out | {i for i, line in enumerate(text.split("\n"), 1) if re.match(r"\s*(else|elif|except|finally|try)\b", line)}


def test_statement_lines():
    assert scopes.statement_lines(CODE) == plain_starts(CODE)
    for text in ("", "\n\n", "# only\n", "a = 1 \\\n  + 2\nb = 3", "if x:\n    y\nelse:\n    z\n", "f(\n)\n\n'''a\nb'''\nc\n"):
        assert scopes.statement_lines(text) == plain_starts(text)


@pytest.mark.parametrize("broken", ["def f(:\n  x = (\n # c\n\n y\n", "s = '''open\nx\n", "if a:\n    b\n  c\n"])
def test_lines_of_files_without_tokens(broken):
    assert scopes.statement_lines(broken) == {i for i, line in enumerate(broken.split("\n"), 1) if line.strip() and not line.strip().startswith("#")}


def test_scopes():
    rows = {r[0]: r for r in scopes.scopes(CODE, "m")}
    defined = {r[4]: (r[0], r[6]) for r in rows.values() if r[4]}
    tree = {"m.A": (9, 32), "m.A.m": (16, 26), "m.A.n": (27, 32), "m.A.n.inner": (28, 29), "m.helper": (33, 34)}
    assert set(defined) == set(tree)
    at = CODE.split("\n")
    assert {q: at[a - 1].strip().split("(")[0].split()[-1] for q, (a, _) in defined.items()} == {q: q.rsplit(".", 1)[1] for q in tree}
    inside = lambda name: next(r[3] for r in rows.values() if name in at[r[0] - 1])
    assert inside("dedented()") == "m.A.m" and inside("not_one") == "m.A" and inside("helper(1)") == "m.A.n.inner" and inside("return inner()") == "m.A.n" and inside("helper(2)") == "m"
    assert inside("helper(a)") == "m.A.m" and rows[len(at)][3] == "m"
    assert next(r[7] for r in rows.values() if "helper(a)" in at[r[0] - 1]) == ["helper", "other", "comment"]
    assert next(r[7] for r in rows.values() if "return print" in at[r[0] - 1]) == []


def test_table_functions(spark):
    scopes.register(spark)
    spark.createDataFrame([(1, "A=1\n export B_2 =x\n=\nnot this\n", '{"a": {"b": 1}, "c": []}', "a:\n  b: 1\nc: x\n"), (2, None, None, None), (3, "", "{broken", "a: [")], "id int, env string, js string, yml string").createOrReplaceTempView("config_texts")
    got = lambda f, c: {tuple(r) for r in spark.sql(f"SELECT id, k.key, k.line FROM config_texts, LATERAL {f}({c}) k").collect()}
    assert got("env_keys", "env") == {(1, "A", 1), (1, "B_2", 2)}
    assert got("json_leaf_keys", "js") == {(1, "a:b", 1), (1, "c", 1)}
    assert got("yaml_keys", "yml") == {(1, "a.b", 2), (1, "c", 3)}
    spark.createDataFrame([("p.py", CODE)], "path string, text string").createOrReplaceTempView("code_texts")
    rows = spark.sql("SELECT l.* FROM code_texts, LATERAL python_scopes(text, 'm') l").collect()
    assert [tuple(r) for r in rows] == [tuple(r) for r in scopes.scopes(CODE, "m")]


WORDS = ["he", "hers", "her", "a_b", "b", "x.y", "+1", "İ", "foo", "FOO"]
TEXTS = ["he hers her, hehe\nfoo(1) foo (2) foo\n(3)", "a_b b a_b_c x.y x.yz ax.y +1 2+1 +12", None, "", "Foo FOO foo\n\nHERS\tİ foo", "her" * 50 + " her"]


@pytest.mark.parametrize("any_case", [False, True])
@pytest.mark.parametrize("at_once", [2, 1 << 18])
def test_mentions(spark, any_case, at_once):
    words = WORDS if not any_case else [w for w in WORDS if w != "İ"]
    t = spark.createDataFrame(list(enumerate(TEXTS)), "path int, text string")
    w = spark.createDataFrame([(x,) for x in [*words, words[0], "", None]], "word string")
    want = []
    for p, text in enumerate(TEXTS):
        for word in {x.lower() if any_case else x for x in words}:
            before = r"(?<![A-Za-z0-9_])" if re.match("[A-Za-z0-9_]", word) else ""
            after = r"(?![A-Za-z0-9_])" if re.search("[A-Za-z0-9_]$", word) else ""
            for m in re.finditer(before + re.escape(word) + after, text or "", re.I if any_case else 0):
                want.append((p, word, text.count("\n", 0, m.end() - 1) + 1, bool(re.match(r"[^\S\n]*\(", text[m.end() :]))))
    got = baseline.mentions(t, w, any_case, at_once=at_once)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_no_words(spark):
    t = spark.createDataFrame(list(enumerate(TEXTS)), "path int, text string")
    assert baseline.mentions(t, spark.createDataFrame([], "word string")).count() == 0


def test_answers_beside_the_engines(spark):
    files = spark.createDataFrame([("r", "m.py", CODE), ("r", "src/use.py", "from m import helper\n\ndef go():\n    helper(3)\n    absent()\n"), ("r", "app.yaml", "server:\n  Port: 1\nport_x: 2\n"), ("q", "other.py", "PORT = 1\ndef helper(): pass\n")], "repo string, path string, text string")
    golden = [
        evaluate.Golden("callers", "what_calls", {"symbol": "r:m.helper"}, ["r:m", "r:m.A.m", "r:m.A.n.inner", "r:use.go"]),
        evaluate.Golden("callees", "what_does_it_call", {"symbol": "r:use.go"}, ["q:other.helper", "r:m.helper"]),
        evaluate.Golden("keys", "find_config_key", {"pattern": "port"}, ["q:other.py:1", "r:app.yaml:2"]),
        evaluate.Golden("nothing", "what_calls", {"symbol": "r:m.unheard_of"}, []),
        evaluate.Golden("path", "find_path", {"source": "a", "target": "b"}, ["a"]),
    ]
    q = spark.createDataFrame([(g.id, g.tool, g.args.get("symbol") or g.args.get("pattern")) for g in golden[:4]], "id string, tool string, subject string")
    got = {r.id: r.answered for r in baseline.answers(q, files).collect()}
    assert got == {g.id: g.expected for g in golden[:3]}
    scores = evaluate.baseline(spark, golden, files)
    assert [(r["tool"], r["n"], r["f1"]) for r in scores] == [("find_config_key", 1, 1.0), ("what_calls", 2, 1.0), ("what_does_it_call", 1, 1.0)]


def test_golden_candidates_are_dealt_over_tasks_by_their_number(spark, monkeypatch):
    """A task holds a bounded number of edges; repeated edges count once."""
    import hashlib

    from edgeatlas.operators import evaluation

    rows = [(f"f{i % 30}", f"t{i % 7}") for i in range(400)] + [(f"g{i}", "hot") for i in range(40)] + [("f1", "one")] * 5
    want = {}
    for a, b in rows:
        want.setdefault(b, set()).add(a)
    want = sorted(((hashlib.sha256(b.encode()).hexdigest(), b, len(s)) for b, s in want.items() if len(s) <= 15))
    monkeypatch.setattr(evaluation, "TASK_ROWS", 20)
    got = evaluation.golden_candidates(spark.createDataFrame(rows, "from_name string, to_name string"))
    assert [tuple(r) for r in got.select("to_name", "n_callers").collect()] == [w[1:] for w in want]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count(f", {len(rows) // 20 + 1}), REPARTITION_BY_NUM") >= 2
