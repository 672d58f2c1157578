import json
from pathlib import Path

import pytest

from paperloom import __main__ as cli

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


def test_index_prints_its_outcome(spark, tmp_path, capsys):
    codes = [cli.main(["index", str(DATA), str(tmp_path / "t"), "--buckets", "2"]) for _ in range(2)]
    first, second = (json.loads(x) for x in capsys.readouterr().out.strip().splitlines())
    assert first == second and first["n_papers"] == first["n_ok"] + first["n_failed"] and codes == [int(first["all_failed"])] * 2
    assert sum(first["failed_by_stage"].values()) == first["n_failed"]


def test_evaluate_writes_a_run(spark, tmp_path):
    code = cli.main(["evaluate", str(DATA), "--out", str(tmp_path / "run"), "--save-baseline", str(tmp_path / "base.json")])
    assert code in (0, 1) and "## Gates" in (tmp_path / "run/report.md").read_text()
    base = json.loads((tmp_path / "base.json").read_text())
    assert base["target"] == "lexical" and 0 <= base["aggregate"]["recall@5"] <= 1
    assert cli.main(["query", "nothing", str(DATA)]) == 2
