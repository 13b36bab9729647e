"""The reviewer's commands, one after the other on one folder."""

import datetime as dt

import pytest

from claimweave import review_cli


def test_commands(spark, tmp_path):
    day = dt.datetime(2026, 1, 1)
    rows = [("t1", "a", "pending", 2, day), ("t2", "b", "pending", 1, day), ("u3", "c", "cancelled", 1, day)]
    spark.createDataFrame(rows, review_cli.SCHEMAS["tasks"]).write.parquet(str(tmp_path / "tasks"))
    ask = lambda *words: review_cli.run(spark, ["--tables", str(tmp_path), *words])
    assert [x.split("\t")[0] for x in ask("list")] == ["t2", "t1"]
    assert ask("next") == ["t2\tpending\t1\tb"] and ask("show", "u") == ["u3\tcancelled\t1\tc"]
    assert ask("accept", "t2", "--reviewer", "ann") == ["accepted t2"]
    assert ask("next") == ["t1\tpending\t2\ta"]
    with pytest.raises(ValueError, match="closed"):
        ask("reject", "t2", "--reviewer", "ann", "--reason", "late")
    with pytest.raises(ValueError, match="no reason"):
        ask("reject", "t1", "--reviewer", "ann", "--reason", " ")
    with pytest.raises(LookupError):
        ask("show", "t")
    assert ask("reject", "t1", "--reviewer", "bo", "--reason", "wrong") == ["rejected t1"] and ask("list") == []
    why = ("--reviewer", "ann", "--reason", "the same")
    assert ask("merge", "x", "y", *why) == ["x is now y"] and ask("merge", "w", "x", *why) == ["w is now y"]
    with pytest.raises(ValueError, match="cycle"):
        ask("merge", "y", "x", *why)
    with pytest.raises(ValueError, match="already"):
        ask("merge", "x", "z", *why)
    with pytest.raises(ValueError, match="no reason"):
        ask("merge", "p", "q", "--reviewer", "ann", "--reason", " ")
    assert {r["created_by"] for r in spark.read.parquet(str(tmp_path / "redirects")).collect()} == {"ann"}
    assert [r["seq"] for r in spark.read.parquet(str(tmp_path / "decisions")).orderBy("seq").collect()] == [1, 2]
