import datetime as dt
from collections import namedtuple

import pytest
from pyspark.sql import functions as F

from axonframe.config import Settings
from axonframe.sources import recordings
from axonframe.streaming.breaches import breach_counts


def test_settings(tmp_path):
    s = Settings(cluster_min_clusters=1, cluster_max_clusters=5)
    assert s.cluster_min_clusters == 2
    s.write(tmp_path / "a.ini")
    assert Settings.read(tmp_path / "a.ini") == s
    assert (s.files_for(dt.date(2024, 1, 5)), s.files_for(dt.date(2024, 1, 6))) == (8, 2)
    with pytest.raises(ValueError):
        Settings(run_run_type="Never").files_for(dt.date(2024, 1, 5))


def test_arrays_and_partitions(spark, tmp_path):
    pair = namedtuple("Pair", "spikes times")
    a = recordings.from_arrays(spark, 1, "U1", {"spikes": [[1, 2], [3, 4]], "times": [5, 9]})
    b = recordings.from_arrays(spark, 2, "U2", pair([[1, 2]], [7]))
    path = str(tmp_path / "out")
    recordings.write_spikes(a.union(b), path)
    recordings.write_spikes(b.withColumn("t_sample", F.lit(8).cast("long")), path)
    got = spark.read.parquet(path)
    assert {(r.rec, r.channel, r.t_sample) for r in got.collect()} == {(1, "U1", 5), (1, "U1", 9), (2, "U2", 8)}
    with pytest.raises(TypeError):
        recordings.from_arrays(spark, 1, "U1", [1, 2])


def test_stream(spark, tmp_path):
    rows = [("a", f"2024-01-01 00:00:0{i % 3}", float(i)) for i in range(9)]
    table = spark.createDataFrame(rows, "channel string, ts string, v double").withColumn("ts", F.to_timestamp("ts"))
    table.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    query = breach_counts(stream, 4.0).writeStream.format("memory").queryName("breaches").outputMode("complete").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(spark.table("breaches")) == key(breach_counts(table, 4.0)) and len(key(spark.table("breaches"))) == 3


def test_values_as_text(spark):
    df = spark.createDataFrame([(1, bytearray(b"\x00\xff"), [1.5, None])], "id int, b binary, x array<double>")
    assert recordings.encoded(df, "b").first().json == '{"b":"AP8="}' and recordings.encoded(df, "x").first().json == '{"x":[1.5,null]}'


def test_settings_as_json():
    s = Settings(cluster_max_clusters=5)
    assert Settings.from_json(s.to_json()) == s and Settings.from_json('{"cluster_max_clusters": 4, "unknown": 1}').cluster_max_clusters == 4
