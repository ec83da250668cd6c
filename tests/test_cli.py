from __future__ import annotations

import json

from factloom import cli


def test_commands(spark, tmp_path, capsys):
    store = str(tmp_path / "store")
    (tmp_path / "a.json").write_text(json.dumps([{"subject": "a", "relation": "knows", "objects": ["b"]}, {"subject": "b", "relation": "knows", "objects": ["c"]}]))
    assert cli.main(["init", store]) == 0
    assert cli.main(["ingest", store, str(tmp_path / "a.json")]) == 0
    assert cli.main(["sparql", store, "SELECT ?x WHERE { ?x knows b }"]) == 0
    assert "|a  |" in capsys.readouterr().out
    assert cli.main(["select", store, "SELECT ?f.subject AS s FROM facts ?f WHERE ?f.arg0 = 'c'"]) == 0
    assert "|b  |" in capsys.readouterr().out
    assert cli.main(["statistics", store]) == 0
    assert json.loads(capsys.readouterr().out)["facts"] == 2
    assert cli.main(["verify", store]) == 0
    assert cli.main(["export", store, str(tmp_path / "out"), "--format", "parquet"]) == 0
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    assert cli.main(["compact", store]) == 0 and cli.main(["lookup", store, "a"]) == 0
    assert cli.main(["rebuild", store]) == 0 and cli.main(["clean", store]) == 0 and cli.main(["doctor", store]) == 0
    assert cli.main(["profile", store, "SELECT ?f.subject AS s FROM facts ?f"]) == 0 and "Scan parquet" in capsys.readouterr().out
    assert cli.main(["benchmark", store, "--runs", "1"]) == 0 and "lookup" in capsys.readouterr().out
    assert cli.main(["dashboard", store, str(tmp_path / "board")]) == 0
    assert "| facts | 2 |" in [r.value for r in spark.read.text(str(tmp_path / "board")).collect()]
    assert cli.main(["doctor", str(tmp_path / "none")]) == 1
    assert cli.main(["drop", store]) == 0 and not (tmp_path / "store").exists()
