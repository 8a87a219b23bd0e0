"""Commands over files."""

from timberline import cli

HEAD = "2022-06-22 14:{:02d}:{:02d} 10236 1 "


def test_commands(spark, tmp_path, capsys):
    assert cli.main(["config"]) == 0 and "library_size: 500" in capsys.readouterr().out
    kinds = ["Status: Connected", "Command: USER", "Command: PASS", "Status: Logged in"]
    for c in ("c001", "c002"):
        (tmp_path / "logs" / c).mkdir(parents=True)
        for f in range(2):
            lines = [HEAD.format(f, i) + ("Response: 550 Permission denied" if c == "c002" and i % 10 == 9 else kinds[i % 4]) for i in range(40)]
            lines[7] = HEAD.format(f, 7) + "abn: Error: broken pipe" if c == "c002" else lines[7]
            (tmp_path / "logs" / c / f"x_00{f}.txt").write_text("\n".join(lines) + "\n")
    logs, lib = str(tmp_path / "logs"), str(tmp_path / "lib")
    assert cli.main(["templates", logs, "--out", str(tmp_path / "s"), "--library", lib], spark) == 0
    assert spark.read.parquet(str(tmp_path / "s")).count() == 160
    eid = spark.read.parquet(lib).where("eventtemplate LIKE 'Response%'").first()["eventid"]
    (tmp_path / "kb.yaml").write_text(f"{eid}:\n  severity: error\n  contxt: true\n  descpt: Look.\n")
    (tmp_path / "classes.yaml").write_text("c001:\n  desc: fine\n  refs: N/A\nc002:\n  desc: bad\n  refs: N/A\n")
    (tmp_path / "own.yaml").write_text("template:\n  library_size: 12\nsequences:\n  width: 2\n  top: 2\n")
    own = ["--config", str(tmp_path / "own.yaml")]
    assert cli.main(["report", logs, "--out", str(tmp_path / "r"), "--library", lib, "--rules", str(tmp_path / "kb.yaml")], spark) == 0
    assert spark.read.csv(str(tmp_path / "r/report"), header=True).count() == 8
    for phase in ("train", "predict"):
        assert cli.main([*own, "sequences", logs, "--out", str(tmp_path / f"q{phase}"), "--library", lib, "--phase", phase, "--model-dir", str(tmp_path / "m1")], spark) == 0
        args = ["diagnose", logs, "--out", str(tmp_path / f"d{phase}"), "--library", lib, "--phase", phase, "--model-dir", str(tmp_path / "m2"), "--model", "logistic_multi"]
        assert cli.main([*own, *args, "--rules", str(tmp_path / "kb.yaml"), "--classes", str(tmp_path / "classes.yaml")], spark) == 0
    best = spark.read.csv(str(tmp_path / "dpredict"), header=True).where("rank = 1")
    assert sorted((r["sample_id"], r["class_label"]) for r in best.collect()) == [("0", "c001"), ("1", "c001"), ("2", "c002"), ("3", "c002")]
    assert spark.read.csv(str(tmp_path / "qpredict"), header=True).count() > 0


def _logs(spark, tmp_path, n=20):
    (tmp_path / "logs" / "c001").mkdir(parents=True)
    lines = [HEAD.format(0, i) + ("abn: Response: 550 Permission denied" if i % 10 == 9 else "Status: Connected") for i in range(n)]
    (tmp_path / "logs" / "c001" / "x_000.txt").write_text("\n".join(lines) + "\n")
    logs, lib = str(tmp_path / "logs"), str(tmp_path / "lib")
    assert cli.main(["templates", logs, "--out", str(tmp_path / "s"), "--library", lib], spark) == 0
    return logs, lib


def test_small_commands(spark, tmp_path, capsys):
    logs, lib = _logs(spark, tmp_path)
    out = lambda n: str(tmp_path / n)
    eid = spark.read.parquet(lib).where("eventtemplate LIKE 'Status%'").first()["eventid"]
    assert cli.main(["find", logs, "--out", out("x"), "--library", lib, "--event", eid], spark) == 0 and spark.read.csv(out("x"), header=True).count() == 18
    assert cli.main(["duplicates", logs, "--out", out("d"), "--library", lib], spark) == 0 and spark.read.csv(out("d"), header=True).count() == 0
    (tmp_path / "a.lst").write_text(str(tmp_path / "logs/c001/x_000.txt") + "\n")
    assert cli.main(["times", str(tmp_path / "a.lst"), "--list", "--out", out("t")], spark) == 0
    assert spark.read.text(out("t")).where("value LIKE '2022-01-01 00:00:0%'").count() == 20
    for action in ("sort", "delete"):
        assert cli.main(["library", action, "--library", lib], spark) == 0
    assert cli._library(spark, lib).count() == 0
    assert cli.main(["config", "set", "windows.step_ms=7", "--out", out("c.yaml")]) == 0 and "step_ms: 7" in (tmp_path / "c.yaml").read_text()
    assert cli.main(["info"]) == 0 and "library" in capsys.readouterr().out
