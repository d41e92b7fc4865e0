"""The command's bundle: steps, their cost, and runs that go on."""

import json

import pytest
from pyspark.sql import functions as F

from nichegraph.jobs import cli
from nichegraph.jobs.bundle import Bundle, files_key

GOLDEN = [("A", 1, 1), ("A", 3, 1), ("B", 2, 5), ("B", 4, 5), ("B", 6, 5), ("A", 9, 1), ("A", 11, 3), ("C", 100, 100), ("B", -1, -1), ("B", -3, -1)]


def test_steps_are_read_again_until_something_changes(spark, tmp_path):
    made = []

    def run(base=1, factor=2):
        b = Bundle(spark, str(tmp_path / "out"))
        made.clear()
        one = b.step("one", lambda: made.append("one") or spark.range(5).withColumn("v", F.lit(base)), base=base)
        two = b.step("two", lambda: made.append("two") or one.withColumn("v", F.col("v") * factor), ("one",), factor=factor)
        three = b.step("three", lambda: made.append("three") or two.groupBy("v").count(), ("two",))
        other = b.step("other", lambda: made.append("other") or one.limit(1), ("one",))
        b.publish()
        return three.first().v, other.count(), list(made), b

    assert run()[:3] == (2, 1, ["one", "two", "three", "other"])
    assert run()[:3] == (2, 1, [])
    v, _, again, b = run(factor=3)
    assert v == 3 and again == ["two", "three"]  # the changed step and what follows it
    rows = {r.step: r for r in b.metrics().collect()}
    assert {k: (r.rows, r.resumed) for k, r in rows.items()} == {"one": (5, True), "two": (5, False), "three": (1, False), "other": (1, True)}
    assert all(r.seconds > 0 for r in rows.values())
    assert run(base=4)[2] == ["one", "two", "three", "other"]
    whole = json.loads((tmp_path / "out" / "manifest.json").read_text())
    assert [s["step"] for s in whole["steps"]] == ["one", "two", "three", "other"] and whole["steps"][1]["parameters"] == {"factor": 2}
    assert whole["steps"][0]["schema"]["fields"][1]["name"] == "v"


def test_a_killed_run_goes_on(spark, tmp_path):
    out = str(tmp_path / "out")

    def killed():
        raise KeyboardInterrupt

    b = Bundle(spark, out)
    b.step("one", lambda: spark.range(3))
    with pytest.raises(KeyboardInterrupt):
        b.step("two", killed, ("one",))
    (tmp_path / "out" / "two").mkdir()  # half a table
    (tmp_path / "out" / "two" / "part-0.parquet").write_bytes(b"half")
    (tmp_path / "out" / "steps" / "two.json").write_text('{"key": ')  # half a manifest
    b = Bundle(spark, out)
    b.step("one", killed)
    assert b.step("two", lambda: spark.range(2), ("one",)).count() == 2
    with pytest.raises(KeyboardInterrupt):
        Bundle(spark, out, restart=True).step("one", killed)


def test_command_resumes(spark, tmp_path):
    source = str(tmp_path / "in")
    points = spark.createDataFrame([(g, float(x), float(y), f"c{x}") for g, x, y in GOLDEN], "target string, x_global_px float, y_global_px float, cell string")
    points.write.parquet(source)
    (tmp_path / "sets").mkdir()
    (tmp_path / "sets" / "h.gmt").write_text("T\tabout\tA\tB\n")
    (tmp_path / "sets" / "m.gmt").write_text("U\tabout\tA\tC\n")
    common = ["--transcripts-path", source, "--output-dir", str(tmp_path / "out"), "--mode", "cosmx_prefiltered", "--k", "2", "--cell-col", "cell", "--gene-sets", str(tmp_path / "sets")]
    assert cli.parse(common).organism == "Human"
    first = cli.main(common)
    assert first["assignment_stats"].count() == 2 and first["enrichment"].filter("term = 'U'").isEmpty()
    steps = ["points", "clusters", "pairs", "edges", "weights", "modules", "enrichment", "niche_values", "niche_background", "grid", "assignment_stats"]
    assert [r.step for r in first["timings"].collect() if not r.resumed] == steps
    assert all(r.resumed for r in cli.main(common)["timings"].collect())
    changed = {r.step for r in cli.main([*common, "--threshold", "p50"])["timings"].collect() if not r.resumed}
    assert changed == {"assignment_stats"}
    changed = {r.step for r in cli.main([*common, "--bin-size", "4"])["timings"].collect() if not r.resumed}
    assert changed == {"niche_values", "niche_background", "grid", "assignment_stats"}
    before = files_key(spark, source)
    points.limit(3).write.mode("append").parquet(source)
    assert files_key(spark, source) != before
    again = {r.step: r.resumed for r in cli.main(common)["timings"].collect()}
    assert not any(again.values())
    with pytest.raises(ValueError):
        cli.main(["--transcripts-path", source, "--output-dir", str(tmp_path / "o2"), "--mode", "cosmx_prefiltered", "--weights", source])
