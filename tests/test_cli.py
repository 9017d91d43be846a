import json

import pytest

from edgeatlas import cli
from edgeatlas.plans import evaluate
from tests.corpus import LEDGER
from edgeatlas.plans.engine import Engine
from tests.test_index import write

GOLDEN = """
- {id: a, tool: what_calls, args: {symbol: ledger.entries.format_entry}, expected: [ledger.entries.post_entry], ci: true}
- {id: b, tool: what_does_it_call, args: {symbol: ledger.entries.post_entry}, expected: [ledger.entries.format_entry, gone]}
- {id: c, tool: find_path, args: {from_symbol: post_entry, to_symbol: format_entry}, expected: [ledger.entries.post_entry, ledger.entries.format_entry]}
- {id: d, tool: what_calls, args: {symbol: no_such_symbol}, expected: []}
"""


def test_leak_scan(tmp_path, capsys):
    (tmp_path / "a.txt").write_text('x\ntoken = "abcd1234efgh5678"\n')
    (tmp_path / "b.bin").write_bytes(b'\0token = "abcd1234efgh5678"')
    assert cli.main(["leak-scan", str(tmp_path), "--fail-on-findings"]) == 1
    assert capsys.readouterr().out.strip() == f"{tmp_path}/a.txt:2: secret-assignment"


def test_index_query_and_evaluation(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setenv("EDGEATLAS_HOME", str(tmp_path / "home"))
    write(tmp_path / "root", {"ledger": LEDGER})
    assert cli.main(["query", "what_calls", "symbol=x"]) == 1
    assert json.loads(capsys.readouterr().out)["error"] == "not_indexed"
    assert cli.main(["index", str(tmp_path / "root")]) == 0
    capsys.readouterr()
    assert cli.main(["query", "what_calls", "symbol=format_entry", "depth=1"]) == 0
    assert json.loads(capsys.readouterr().out)["data"][0]["from"] == "ledger.entries.post_entry"
    assert cli.main(["audit", "stats"]) == 0
    assert {r["tool"]: (r["n_calls"], r["n_errors"]) for r in json.loads(capsys.readouterr().out)} == {"what_calls": (2, 1)}
    (tmp_path / "g.yaml").write_text(GOLDEN)
    golden = evaluate.load_golden(tmp_path / "g.yaml")
    got = evaluate.run(spark, Engine(spark, str(tmp_path / "home/catalog")), golden)
    f1 = {r["id"]: round(r["f1"], 3) for r in got.scores}
    assert f1 == {"a": 1.0, "b": 0.667, "c": 1.0, "d": 1.0}
    assert [(r["rule"], r["observed"], r["n"]) for r in got.rules] == [("same_file", 1.0, 2)]
    evaluate.write_report(got, tmp_path / "report")
    assert "| what_calls | 2 |" in (tmp_path / "report/report.md").read_text()
    assert evaluate.gate(got, tmp_path / "report/baseline.json", spark) == []
    (tmp_path / "base.json").write_text('{"what_calls": 1.0, "find_config_key": 0.5}')
    assert evaluate.gate(got, tmp_path / "base.json", spark) == ["find_config_key: 0.5000 -> 0.0000"]
    (tmp_path / "g.yaml").write_text(GOLDEN.replace("id: b", "id: a"))
    with pytest.raises(ValueError, match="unique"):
        evaluate.load_golden(tmp_path / "g.yaml")
