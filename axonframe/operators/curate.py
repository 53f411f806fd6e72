"""Curation of sorted clusters as versions: every edit gives a new table (rec, cluster, spike_id, t) and a line of the log."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axonframe.operators.cluster import chosen_models, labelled, mixtures


def merge(spikes: DataFrame, clusters: list[int], into: int) -> DataFrame:
    return spikes.withColumn("cluster", F.when(F.col("cluster").isin(clusters), into).otherwise(F.col("cluster")))


def split_by_recording(spikes: DataFrame, cluster: int) -> DataFrame:
    """The cluster's spikes get ids of ten times the cluster plus the recording."""
    return spikes.withColumn("cluster", F.when(F.col("cluster") == cluster, F.col("cluster") * 10 + F.col("rec")).otherwise(F.col("cluster")))


def discard(spikes: DataFrame, clusters: list[int]) -> DataFrame:
    return spikes.where(~F.col("cluster").isin(clusters))


def delete_spikes(spikes: DataFrame, gone: DataFrame) -> DataFrame:
    return spikes.join(gone.select("spike_id"), "spike_id", "left_anti")


def relabel(spikes: DataFrame, labels: DataFrame, cluster: int) -> DataFrame:
    """A split by labels (spike_id, part): ids of ten times the cluster plus the part."""
    found = spikes.join(labels.select("spike_id", "part"), "spike_id", "left")
    hit = (F.col("cluster") == cluster) & F.col("part").isNotNull()
    return found.withColumn("cluster", F.when(hit, F.col("cluster") * 10 + F.col("part")).otherwise(F.col("cluster"))).drop("part")


def solution_clusters(labels: DataFrame, channel: str, solution: int, clusters: list[int] | None = None) -> DataFrame:
    """The spikes that a stored solution (channel, solution, cluster, spike_id, …) puts into some clusters, or into any: what a
    session activates. A solution that is not stored gives no rows."""
    found = labels.where((F.col("channel") == channel) & (F.col("solution") == solution))
    return found if clusters is None else found.where(F.col("cluster").isin(clusters))


def split_by_mixture(spikes: DataFrame, cluster: int, columns: list[str], parts: int, restarts: int = 10) -> DataFrame:
    """(spike_id, part): a proposed split of a cluster by the best converged mixture of so many components on its rows' columns.

    Nothing is changed before `commit_split`; without a converged fit there are no rows."""
    own = spikes.where(F.col("cluster") == cluster).withColumn("channel", F.lit("split"))
    models = chosen_models(mixtures(own, "channel", columns, parts, parts, restarts))
    found = labelled(own.drop("cluster"), models, columns)
    return found.where("cluster is not null").select("spike_id", F.col("cluster").alias("part"))


def commit_split(spikes: DataFrame, labels: DataFrame, cluster: int, parts: list[int]) -> DataFrame:
    """The chosen parts of a proposed split as clusters of their own, the rest of the cluster gone; with no choice all stays."""
    if not parts:
        return spikes
    found = relabel(spikes, labels, cluster)
    chosen = [cluster * 10 + p for p in parts]
    others = spikes.where(F.col("cluster") != cluster).select("spike_id")
    return found.join(others, "spike_id", "left_semi").unionByName(found.join(others, "spike_id", "left_anti").where(F.col("cluster").isin(chosen)))


def invalid_clusters(spikes: DataFrame, recordings: DataFrame) -> DataFrame:
    """(cluster, no_rec, no_time, no_wave): clusters with spikes of recordings that the map lacks, or without time or waveform."""
    known = recordings.select("rec", F.lit(True).alias("known"))
    found = spikes.join(known, "rec", "left").groupBy("cluster").agg(
        F.count_if(F.col("known").isNull()).alias("no_rec"), F.count_if(F.col("t").isNull()).alias("no_time"), F.count_if(F.coalesce(F.size("w"), F.lit(0)) <= 0).alias("no_wave")
    )
    return found.where("no_rec + no_time + no_wave > 0")


def rerooted(recordings: DataFrame, paths: DataFrame) -> DataFrame:
    """recordings (rec, path) with the path of paths (path) that ends in the same name, or their own if none does."""
    base = lambda c: F.regexp_extract(c, r"([^/\\\\]+)[/\\\\]*$", 1)
    new = paths.groupBy(base("path").alias("base")).agg(F.min("path").alias("new"))
    found = recordings.withColumn("base", base("path")).join(new, "base", "left")
    return found.select("rec", F.coalesce("new", "path").alias("path"))


def detection_complete(status: DataFrame) -> DataFrame:
    """(rec, complete): whether every channel of a recording is done; status (rec, channel, done), null for not."""
    return status.groupBy("rec").agg(F.every(F.coalesce("done", F.lit(False))).alias("complete"))


def equal_clusters(a: DataFrame, b: DataFrame, time: str = "t") -> DataFrame:
    """(equal): whether the clusters hold the same times as often. Counts are compared, so nothing is sorted as a whole."""
    both = a.select(time, F.lit(1).alias("s")).unionByName(b.select(time, F.lit(-1).alias("s")))
    return both.groupBy(time).agg(F.sum("s").alias("d")).agg((F.count_if(F.col("d") != 0) == 0).alias("equal"))


def missing(expected: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the expected grid without a match: work that is pending, files that are missing, keys that a map lacks."""
    return expected.join(found.select(*keys).distinct(), keys, "left_anti")


def save_units(spikes: DataFrame, flags: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(units, rest): spikes of the clusters in flags (cluster, single, pyramidal, interneuron) with these columns, and the others."""
    return spikes.join(flags, "cluster"), spikes.join(flags.select("cluster"), "cluster", "left_anti")


@dataclass
class Session:
    """Versions of the active spikes; undo goes back by one. Tables are lazy, so versions cost nothing until they are read."""

    spikes: DataFrame
    versions: list[tuple[str, DataFrame]] = field(default_factory=list)

    def edit(self, note: str, edited: DataFrame) -> DataFrame:
        self.versions.append((note, self.spikes))
        self.spikes = edited
        return edited

    def undo(self) -> DataFrame:
        if self.versions:
            _, self.spikes = self.versions.pop()
        return self.spikes

    def log(self) -> list[str]:
        return [note for note, _ in self.versions]
