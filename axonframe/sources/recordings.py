"""Readers and writers of recordings and results: Parquet by channel and cluster, arrays, CSV reports, optional HDF5."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SPIKES = "rec int, channel string, spike_id long, t_sample long, waveform array<double>"


def from_arrays(spark: SparkSession, rec: int, channel: str, data) -> DataFrame:
    """Spikes of a mapping or a tuple with fields `spikes` and `times`; other types are a TypeError."""
    if isinstance(data, dict):
        spikes, times = data["spikes"], data["times"]
    elif isinstance(data, tuple) and hasattr(data, "spikes") and hasattr(data, "times"):
        spikes, times = data.spikes, data.times
    else:
        raise TypeError("a mapping or a named tuple with spikes and times")
    rows = [(rec, channel, i, int(t), [float(x) for x in w]) for i, (w, t) in enumerate(zip(spikes, times, strict=True))]
    return spark.createDataFrame(rows, SPIKES)


def write_spikes(spikes: DataFrame, path: str) -> None:
    """One folder a recording and channel; only the partitions that the rows hold are replaced."""
    spikes.write.partitionBy("rec", "channel").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def first_files(spark: SparkSession, path: str, n: int) -> list[str]:
    """The first n Parquet files of a folder by name: what a run of limited length takes."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select("path").distinct()
    return [r["path"] for r in files.orderBy("path").limit(n).collect()]  # n rows


def encoded(rows: DataFrame, column: str) -> DataFrame:
    """rows with `json`: the column as JSON text, binary values in base64."""
    kind = dict(rows.dtypes)[column]
    return rows.withColumn("json", F.to_json(F.struct((F.base64(column) if kind == "binary" else F.col(column)).alias(column))))


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir, which driver and executors share; where it is unset, a local master gets one of its own."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where and sc._jsc.sc().getCheckpointDir().isDefined():
        where = sc._jsc.sc().getCheckpointDir().get()
    if not where and not sc.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(where or "/tmp/checkpoints")
    return (where or "/tmp/checkpoints").rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """The rows computed once and kept in the checkpoint folder; what follows starts there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


class Hdf5Channels(DataSource):
    """spark.read.format("hdf5_channels").option("path", file): spikes of the channels whose name holds a u; needs h5py."""

    @classmethod
    def name(cls) -> str:
        return "hdf5_channels"

    def schema(self) -> str:
        return SPIKES

    def reader(self, schema) -> DataSourceReader:
        return _Hdf5Reader(self.options)


class _Hdf5Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.rec = options["path"], int(options.get("rec", "0"))

    def partitions(self) -> list[InputPartition]:
        import h5py

        with h5py.File(self.path) as f:
            return [InputPartition(k) for k in sorted(f["data"]) if "u" in k.lower()]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import h5py

        with h5py.File(self.path) as f:
            group = f["data"][partition.value]
            for i, (w, t) in enumerate(zip(group["spikes"], group["times"], strict=True)):
                yield self.rec, partition.value, i, int(t), [float(x) for x in w]
