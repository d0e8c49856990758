import json

from rulewright import cli

PROGRAM = '.decl edge(x: symbol, y: symbol) mutable\n.input edge\n.decl reach(x: symbol, y: symbol)\nreach(x, y) :- edge(x, y).\nreach(x, z) :- reach(x, y), edge(y, z).\n.output reach(filename="r.tsv")\n'


def test_commands(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setattr(cli, "session", lambda: spark)
    (tmp_path / "p.dl").write_text(PROGRAM)
    facts = tmp_path / "facts"
    facts.mkdir()
    args = [f"{tmp_path}/p.dl", str(facts)]
    assert cli.main(["solve", *args]) == 1 and "MissingRelationError" in capsys.readouterr().err
    (facts / "edge.facts").write_text("a\tb\nb\tc\n")
    assert cli.main(["manifest", args[0]]) == 0
    assert json.loads(capsys.readouterr().out)["inputs"] == {"edge": [["x", "symbol"], ["y", "symbol"]]}
    assert cli.main(["solve", *args, f"{tmp_path}/out"]) == 0
    assert (tmp_path / "out/r.tsv").read_text() == "a\tb\na\tc\nb\tc\n"
    capsys.readouterr()
    assert cli.main(["profile", *args]) == 0
    assert [json.loads(x)["rows"] for x in capsys.readouterr().out.splitlines()] == [2, 3]
    assert cli.main(["bench", *args]) == 0
    assert json.loads(capsys.readouterr().out)["restored"] is True
    (tmp_path / "p.dl").write_text("nonsense")
    assert cli.main(["solve", *args]) == 1
