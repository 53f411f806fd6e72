"""Run folders, resume, report files, versions and units, planned reads."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from axonframe import __main__ as command
from axonframe.config import Settings
from axonframe.operators import curate, sort
from axonframe.sources import recordings, runs


@pytest.fixture(scope="module")
def trace(spark):
    rng = np.random.default_rng(8)
    rows = []
    for c in ("a", "b"):
        v = rng.standard_normal(12_000) * 0.3
        for k, p in enumerate(np.arange(300, 11_700, 97)):
            v[p - 2 : p + 3] -= np.array([4, 20, 40, 20, 4]) * (1 + (k % 2)) * (1 + rng.standard_normal() * 0.02)
        rows += [(c, i, float(y)) for i, y in enumerate(v)]
    return spark.createDataFrame(rows, "channel string, ix long, v double")


SETTINGS = Settings(cluster_max_clusters=2, cluster_random_restarts=2)
HOW = {"filtered": True, "least_seconds": 1}


def test_a_killed_run_goes_on(spark, tmp_path, trace, monkeypatch):
    folder = runs.RunFolder(spark, str(tmp_path / "run"))
    assert folder.read("spikes") is None and folder.status().count() == 0
    first = runs.sort_into(folder, trace.where("channel = 'a'"), SETTINGS, 10_000.0, "one", **HOW)
    assert [tuple(r) for r in first.collect()] == [("a", "sorted")]
    files = lambda c: {r.path for r in spark.read.format("binaryFile").load(f"{folder.path}/spikes/channel={c}").select("path").collect()}
    before, labels = files("a"), folder.read("labels", channel="a").count()

    def killed(*_):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(runs, "write_reports", killed)
        with pytest.raises(RuntimeError):
            runs.sort_into(folder, trace, SETTINGS, 10_000.0, "two", **HOW)
    assert {r.channel for r in folder.status().collect()} == {"a"} and files("a") == before
    sorted_channels = []
    whole = sort.sort_traces

    def watched(part, *a, **k):
        sorted_channels.extend(r.channel for r in part.select("channel").distinct().collect())
        return whole(part, *a, **k)

    monkeypatch.setattr(sort, "sort_traces", watched)
    assert [tuple(r) for r in runs.sort_into(folder, trace, SETTINGS, 10_000.0, "three", **HOW).collect()] == [("b", "sorted")]
    assert sorted_channels == ["b"] and files("a") == before
    assert folder.read("labels", channel="a").count() == labels and folder.read("labels", channel="b").groupBy("k", "spike_id").count().where("count > 1").count() == 0
    assert runs.sort_into(folder, trace, SETTINGS, 10_000.0, "four", **HOW).count() == 0
    info = {r.run: r for r in folder.info().collect()}
    assert set(info) == {"one", "two", "three"} and info["two"].finished is None and info["three"].finished and Settings.from_json(info["one"].settings) == SETTINGS
    assert {(r.channel, r.k) for r in runs.usable_solutions(folder).collect()} == {("a", 2), ("b", 2)}

    plan = folder.read("labels", channel="a", k=2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(channel" in plan or "(channel#" in plan.split("PartitionFilters")[1].split("]")[0]
    assert folder.read("labels", channel="a", k=9).count() == 0 and folder.read("nothing") is None
    asked = spark.createDataFrame([("b",)], "channel string")
    assert {r.channel for r in folder.read_for("spikes", asked).select("channel").distinct().collect()} == {"b"}

    kinds = "cluster int, n long, rejected long, v1 long, v2 long, v1_pct double, v2_pct double, l_ratio double, isolated boolean, severity string"
    wanted = spark.createDataFrame([("a", 2), ("b", 2), ("c", 2), ("a", 7)], "channel string, k int")
    broken = tmp_path / "run" / "reports" / "channel=b" / "k=2" / "more.csv"
    broken.write_text("cluster,n,rejected,v1,v2,v1_pct,v2_pct,l_ratio,isolated,severity\nnonsense,x\n")
    rows, missing, bad = runs.read_reports(spark, f"{folder.path}/reports", kinds, wanted)
    assert {(r.channel, r.k) for r in missing.collect()} == {("c", 2), ("a", 7)}
    assert [(r.channel, r.k, r.line, r.file.endswith("more.csv")) for r in bad.collect()] == [("b", 2, "nonsense,x", True)]
    assert {(r.channel, r.k, r.cluster) for r in rows.collect()} == {(c, 2, k) for c in "ab" for k in (0, 1)} and rows.where("file is null").count() == 0


def test_command_line(spark, tmp_path, trace, capsys):
    trace.where("channel = 'a'").write.parquet(str(tmp_path / "traces"))
    (tmp_path / "s.json").write_text(SETTINGS.to_json())
    command.main(["sort", str(tmp_path / "traces"), str(tmp_path / "out"), "--fs", "10000", "--settings", str(tmp_path / "s.json"), "--filtered", "--least-seconds", "1"])
    command.main(["status", str(tmp_path / "out")])
    trace.where("channel = 'b'").coalesce(1).write.parquet(str(tmp_path / "many"))
    trace.where("channel = 'a'").coalesce(1).write.mode("append").parquet(str(tmp_path / "many"))
    names = recordings.first_files(spark, str(tmp_path / "many"), 1)
    assert len(names) == 1 and names == sorted(recordings.first_files(spark, str(tmp_path / "many"), 9))[:1]
    (tmp_path / "one.json").write_text(Settings(cluster_max_clusters=2, cluster_random_restarts=2, run_run_type="Manual", run_manual_run=1).to_json())
    command.main(["sort", str(tmp_path / "many"), str(tmp_path / "part"), "--fs", "10000", "--settings", str(tmp_path / "one.json"), "--some-files", "--filtered", "--least-seconds", "1"])
    assert runs.RunFolder(spark, str(tmp_path / "part")).read("channels").count() == 1
    assert capsys.readouterr().out.count("|a ") >= 2


def test_versions_outlive_the_session(spark, tmp_path):
    base = spark.createDataFrame([(i, i % 4, float(i)) for i in range(40)], "spike_id long, cluster int, t double")
    path = str(tmp_path / "session")
    clusters = lambda v: {r.cluster: r["count"] for r in v.spikes().groupBy("cluster").count().collect()}
    one = runs.Versions(spark, path)
    assert one.head() is None
    one.start(base)
    assert one.undo() == 0 and clusters(one) == {0: 10, 1: 10, 2: 10, 3: 10}
    assert one.edit("merge", curate.merge(one.spikes(), [0, 1], 9)) == 1
    assert one.edit("drop", curate.discard(one.spikes(), [2])) == 2
    two = runs.Versions(spark, path)  # another driver
    two.start(base.limit(0))
    assert clusters(two) == {9: 20, 3: 10} and two.undo() == 1 and clusters(two) == {9: 20, 2: 10, 3: 10}
    for wrong in (([9, 77], [True] * 2), ([9], [True, False]), ([9, 9], [True] * 2)):
        with pytest.raises(ValueError):
            two.save("no", wrong[0], wrong[1], wrong[1], wrong[1])
    assert two.save("keep", [3, 9], [True, False], [False, False], [False, True]) == 3
    named = {(r.unit, r.cluster, r.single, r.interneuron): r["count"] for r in two.units().groupBy("unit", "cluster", "single", "interneuron").count().collect()}
    assert named == {("unit000", 3, True, False): 10, ("unit001", 9, False, True): 20} and clusters(two) == {2: 10}
    three = runs.Versions(spark, path)
    assert three.undo() == 1 and clusters(three) == {9: 20, 2: 10, 3: 10} and three.units().count() == 0
    assert three.save("again", [2], [True], [False], [False]) == 4 and {r.unit for r in three.units().collect()} == {"unit000"}
    assert three.edit("split", curate.relabel(three.spikes(), base.selectExpr("spike_id", "int(spike_id % 2) as part"), 9)) == 5
    assert clusters(three) == {90: 10, 91: 10, 3: 10} and three.chain() == [1, 4, 5]
    three.edit("back", three.spikes().withColumn("cluster", F.when(F.col("cluster") > 89, 9).otherwise(F.col("cluster"))))
    assert clusters(three) == {9: 20, 3: 10} and [three.undo(), three.undo(), three.undo(), three.undo(), three.undo()] == [5, 4, 1, 0, 0]
    assert clusters(three) == {0: 10, 1: 10, 2: 10, 3: 10} and [r.action for r in three.log()].count("undo") == 6


def test_a_retried_append_adds_nothing(spark, tmp_path):
    folder = runs.RunFolder(spark, str(tmp_path / "units"))
    spikes = spark.createDataFrame([(i, i % 7) for i in range(70)], "spike_id long, cluster int")
    one = {r.cluster: r.unit for r in runs.append_units(folder, spikes, "one").collect()}
    assert one == {k: f"unit{k:03d}" for k in range(7)}
    assert {r.cluster: r.unit for r in runs.append_units(folder, spikes, "one").collect()} == one and folder.read("run_units").count() == 70
    two = runs.append_units(folder, spikes.where("cluster in (2, 5)"), "two").collect()
    assert {r.cluster: r.unit for r in two} == {2: "unit007", 5: "unit008"} and folder.read("run_units").count() == 90
