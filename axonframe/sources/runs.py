"""A run's folder: artefacts by channel that a retry replaces, a status log with its latest state, run information, report files."""

from __future__ import annotations

import dataclasses
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from axonframe.config import Settings
from axonframe.operators import sort as so
from axonframe.sources.recordings import settled, shared_folder

STATUS = "seq long, run string, channel string, stage string, state string, at timestamp"
INFO = "seq long, run string, event string, detail string, at timestamp"


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(where)


class RunFolder:
    """Tables of one folder, which driver and executors share.

    Artefacts are Parquet by partition columns, and only the partitions that rows hold are replaced, when their job commits; a
    status is noted after that. So what a killed run has noted is finished, and what it has not noted is done again and
    replaces what was there. The logs only grow; one run writes at a time."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def commit(self, name: str, rows: DataFrame, keys: list[str]) -> None:
        rows.write.partitionBy(*keys).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(f"{self.path}/{name}")

    def read(self, name: str, **where) -> DataFrame | None:
        """An artefact's rows with these values of its partition columns, read from their folders alone; None if it is not stored.
        Values that are not stored give no rows."""
        if not exists(self.spark, f"{self.path}/{name}"):
            return None
        rows = self.spark.read.parquet(f"{self.path}/{name}")
        for column, value in where.items():
            rows = rows.where(F.col(column).eqNullSafe(F.lit(value)))
        return rows

    def read_for(self, name: str, keys: DataFrame) -> DataFrame | None:
        """An artefact's rows for all rows of keys (some of its partition columns); what is not asked for is not read."""
        rows = self.read(name)
        return None if rows is None else rows.join(F.broadcast(keys.distinct()) if keys.isLocal() else keys.distinct(), keys.columns, "left_semi")

    def _log(self, name: str, schema: str) -> DataFrame:
        path = f"{self.path}/{name}"
        return self.spark.read.schema(schema).parquet(path) if exists(self.spark, path) else self.spark.createDataFrame([], schema)

    def _add(self, name: str, schema: str, rows: DataFrame) -> None:
        last = self._log(name, schema).agg(F.max("seq")).first()[0]
        columns = [f.name for f in T._parse_datatype_string(schema).fields]
        rows.withColumn("seq", F.lit(0 if last is None else last + 1).cast("long")).withColumn("at", F.current_timestamp()).select(columns).coalesce(1).write.mode("append").parquet(f"{self.path}/{name}")

    def note(self, rows: DataFrame, stage: str, run: str) -> None:
        """Adds the states of channels (channel, state) in a stage to the log."""
        self._add("status", STATUS, rows.select("channel", "state").withColumn("stage", F.lit(stage)).withColumn("run", F.lit(run)))

    def status(self) -> DataFrame:
        """(channel, stage, state, run): the latest state of each."""
        last = self._log("status", STATUS).groupBy("channel", "stage").agg(F.max(F.struct("seq", "state", "run")).alias("m"))
        return last.select("channel", "stage", "m.state", "m.run")

    def pending(self, channels: DataFrame, stage: str, done: str = "done") -> DataFrame:
        """The channels whose latest state in a stage is not `done`, those without a state included."""
        return channels.select("channel").distinct().join(self.status().where((F.col("stage") == stage) & (F.col("state") == done)).select("channel"), "channel", "left_anti")

    def inform(self, run: str, event: str, detail: str = "") -> None:
        self._add("info", INFO, self.spark.createDataFrame([(run, event, detail)], "run string, event string, detail string"))

    def info(self) -> DataFrame:
        """(run, started, settings, finished): one row a run; finished is null for a run that was killed or still goes on."""
        of = lambda e, c: F.max(F.when(F.col("event") == e, F.col(c)))
        return self._log("info", INFO).groupBy("run").agg(of("start", "at").alias("started"), of("start", "detail").alias("settings"), of("end", "at").alias("finished"))


def sort_into(folder: RunFolder, trace: DataFrame, settings: Settings, fs: float, run: str, **how) -> DataFrame:
    """Sorts the channels that the folder has not done with these settings, and returns their states (channel, state).

    All artefacts are stored first, then the reports, then the states; a channel is done once its state is noted. A second run
    does nothing for channels that are done; other settings do all again."""
    stage = f"sort {json.dumps(dataclasses.asdict(settings) | {'fs': fs} | how, sort_keys=True)}"
    todo = settled(folder.pending(trace, stage))
    if todo.isEmpty():
        return folder.spark.createDataFrame([], "channel string, state string")
    folder.inform(run, "start", settings.to_json())
    found = so.sort_traces(trace.join(todo, "channel", "left_semi"), settings, fs, **how)
    folder.commit("spikes", found.spikes.drop("x"), ["channel"])
    folder.commit("components", found.components, ["channel"])
    folder.commit("fits", found.fits, ["channel", "k"])
    folder.commit("labels", found.labels.drop("x"), ["channel", "k", "cluster"])
    folder.commit("solutions", found.solutions, ["channel"])
    folder.commit("channels", found.channels, ["channel"])
    write_reports(found.report, f"{folder.path}/reports")
    folder.note(found.channels.select("channel", F.lit("done").alias("state")), stage, run)
    folder.inform(run, "end")
    return found.channels.select("channel", "state")


def usable_solutions(folder: RunFolder) -> DataFrame:
    """(channel, k, seed, bic): the stored converged fit of least BIC of each channel and cluster count: what a later run reuses."""
    fits = folder.read("fits")
    empty = folder.spark.createDataFrame([], "channel string, k int, seed int, bic double")
    if fits is None:
        return empty
    return fits.where("converged and bic is not null").groupBy("channel", "k").agg(F.min(F.struct("bic", "seed")).alias("m")).select("channel", "k", "m.seed", "m.bic")


def store_rates(folder: RunFolder, rates: DataFrame) -> None:
    """Stores rates (unit, trial, center, rate) and their means over a unit's trials; the units at hand replace what they had."""
    rates = settled(rates)
    folder.commit("rates", rates, ["unit"])
    folder.commit("mean_rates", rates.groupBy("unit", "center").agg(F.avg("rate").alias("rate"), F.count("*").alias("trials")), ["unit"])


def write_reports(report: DataFrame, path: str) -> None:
    """One folder of CSV with a header for each channel and solution (channel, k, …); these folders alone are replaced."""
    report.repartition("channel", "k").write.partitionBy("channel", "k").option("header", True).option("partitionOverwriteMode", "dynamic").mode("overwrite").csv(path)


def read_reports(spark: SparkSession, path: str, schema: str, expected: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, missing, broken) of report files: rows with the `file` they come from, the rows of expected (channel, k) without a
    file, and lines that do not fit the schema (channel, k, file, line)."""
    kinds = T._parse_datatype_string(schema)
    lines = spark.read.schema(T.StructType([*kinds.fields, T.StructField("line", T.StringType())])).option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "line").csv(path)
    lines = settled(lines.select("*", F.col("_metadata.file_path").alias("file")).withColumn("channel", F.col("channel").cast("string")).withColumn("k", F.col("k").cast("int")))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(path).select(F.col("channel").cast("string").alias("channel"), F.col("k").cast("int").alias("k")).distinct()
    missing = expected.select(F.col("channel").cast("string").alias("channel"), F.col("k").cast("int").alias("k")).distinct().join(files, ["channel", "k"], "left_anti")
    return lines.where("line is null").drop("line"), missing, lines.where("line is not null").select("channel", "k", "file", "line")


class Versions:
    """Versions of the spikes (spike_id, cluster, …) of a curation session that outlive the driver.

    A base table is stored once. An edit stores what it changes: the spikes whose cluster is another or null (gone), and the
    units it saves. A log only grows, and its last row points at a version; versions know the one before, so undo, of a save
    as well, is one more row of the log that points back. The spikes of a version are the base under the latest changes of
    the versions that lead to it. A retried edit overwrites what its first try left."""

    LOG = "seq long, action string, head long, parent long, note string, at timestamp"

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self.folder = spark, path.rstrip("/"), RunFolder(spark, path)

    def start(self, spikes: DataFrame) -> None:
        """Stores the base, if the session has none yet: version 0."""
        if self.head() is None:
            spikes.write.mode("overwrite").parquet(f"{self.path}/base")
            self._point("start", 0, None, "")

    def log(self) -> list:
        """The log's rows, oldest first: one for each action of a person."""
        return self.folder._log("log", self.LOG).orderBy("seq").collect()

    def head(self) -> int | None:
        rows = self.log()
        return rows[-1]["head"] if rows else None

    def chain(self) -> list[int]:
        """The versions that lead to the current one, oldest first, without the base."""
        rows = self.log()
        parents = {r["head"]: r["parent"] for r in rows if r["action"] not in ("undo", "start")}
        at, out = rows[-1]["head"] if rows else 0, []
        while at in parents:
            out.append(at)
            at = parents[at]
        return out[::-1]

    def spikes(self) -> DataFrame:
        """The spikes of the current version."""
        base, chain = self.spark.read.parquet(f"{self.path}/base"), self.chain()
        if not chain:
            return base
        changes = self.folder.read("changes").where(F.col("version").isin(chain))
        last = changes.groupBy("spike_id").agg(F.max_by(F.struct(F.col("cluster").alias("c")), "version").alias("now"))
        met = base.join(last, "spike_id", "left").withColumn("cluster", F.when(F.col("now").isNull(), F.col("cluster")).otherwise(F.col("now.c")))
        return met.where("now is null or now.c is not null").select(base.columns)

    def edit(self, note: str, edited: DataFrame) -> int:
        """Makes `edited` (spike_id, cluster), made from the current spikes, the current version, and returns its number."""
        now = self.spikes().select("spike_id", F.col("cluster").alias("was"))
        met = now.join(edited.select("spike_id", F.col("cluster").alias("cluster"), F.lit(True).alias("there")), "spike_id", "left")
        return self._store("edit", note, met.where("there is null or not (was <=> cluster)").select("spike_id", "cluster"))

    def save(self, note: str, targets: list[int], single: list[bool], pyramidal: list[bool], interneuron: list[bool]) -> int:
        """Saves active clusters as units, which are active no more, and returns the version's number.

        Lists of unequal length and clusters that are not active, or named twice, are a ValueError and change nothing. Units are
        named on from those that the current version has, in the order of targets, without gaps."""
        if not len(targets) == len(single) == len(pyramidal) == len(interneuron):
            raise ValueError(f"{len(targets)} clusters need as many flags of each kind")
        active = self.spikes()
        found = {r[0] for r in active.where(F.col("cluster").isin(targets)).select("cluster").distinct().collect()}
        if found != set(targets) or len(set(targets)) != len(targets):
            raise ValueError(f"clusters {sorted(set(targets) - found) or targets} are not active, or named twice")
        taken = self.units().select("unit").distinct().count()
        names = [(c, f"unit{taken + k:03d}", s, p, i) for k, (c, s, p, i) in enumerate(zip(targets, single, pyramidal, interneuron, strict=True))]
        flags = self.spark.createDataFrame(names, T.StructType([active.schema["cluster"], *T._parse_datatype_string("unit string, single boolean, pyramidal boolean, interneuron boolean").fields]))
        units = active.join(F.broadcast(flags), "cluster")  # one row a chosen cluster
        return self._store("save", note, units.select("spike_id", F.lit(None).cast(active.schema["cluster"].dataType).alias("cluster")), units)

    def units(self) -> DataFrame:
        """The spikes of all units that the current version has saved, with `unit` and its kinds."""
        units = self.folder.read("units")
        if units is None:
            empty = self.spark.read.parquet(f"{self.path}/base").where("false")
            return empty.selectExpr("*", "'' as unit", "false as single", "false as pyramidal", "false as interneuron", "0L as version")
        return units.where(F.col("version").isin(self.chain()))

    def undo(self) -> int:
        """Goes back by one version, if there is one, and returns the current one's number."""
        chain = self.chain()
        if chain:
            self._point("undo", ([0, *chain])[-2], None, "")
        return self.head()

    def _store(self, action: str, note: str, changes: DataFrame, units: DataFrame | None = None) -> int:
        head, version = self.head(), max(r["head"] for r in self.log()) + 1
        changes, units = settled(changes), units if units is None else settled(units)
        self.folder.commit("changes", changes.withColumn("version", F.lit(version).cast("long")), ["version"])
        if units is not None:
            self.folder.commit("units", units.withColumn("version", F.lit(version).cast("long")), ["version"])
        self._point(action, version, head, note)
        return version

    def _point(self, action: str, head: int, parent: int | None, note: str) -> None:
        self.folder._add("log", self.LOG, self.spark.createDataFrame([(action, head, parent, note)], "action string, head long, parent long, note string"))


def append_units(folder: RunFolder, spikes: DataFrame, run: str, key: str = "cluster") -> DataFrame:
    """Appends the spikes of a run's new units and returns (key, unit), their names, gap-free after those of other runs.

    The names of a run are counted within stretches of its keys' order, so no task names all. A run that is tried again
    replaces what it appended and keeps its names, if it comes with the same units and no other run appended since."""
    before = folder.read("run_units")
    taken = 0 if before is None else before.where(F.col("run") != run).select("unit").distinct().count()
    keys = spikes.select(key).distinct()
    dealt = settled(keys.repartitionByRange(key).sortWithinPartitions(key).withColumn("stretch", F.spark_partition_id()))
    within = F.row_number().over(Window.partitionBy("stretch").orderBy(key))
    sizes = dealt.groupBy("stretch").agg(F.count("*").alias("c"))
    starts = sizes.select("stretch", F.coalesce(F.sum("c").over(Window.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))  # one row a stretch
    named = dealt.withColumn("k", within).join(starts, "stretch").select(key, F.format_string("unit%03d", F.col("start") + F.col("k") - 1 + taken).alias("unit"))
    named = settled(named)
    folder.commit("run_units", spikes.join(named, key).withColumn("run", F.lit(run)), ["run"])
    return named


def scratch_folder(spark: SparkSession, name: str) -> RunFolder:
    """A new run folder among the checkpoints."""
    import uuid

    return RunFolder(spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}")
