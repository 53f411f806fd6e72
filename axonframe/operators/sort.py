"""From traces to units: filter, detection, features, mixtures, labels and quality of all channels and solutions in one job."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from axonframe.config import Settings
from axonframe.operators import cluster as cl
from axonframe.operators import detect as de
from axonframe.operators import quality as qu
from axonframe.operators import trains as tr
from axonframe.sources.recordings import settled


@dataclass
class Sorted:
    """What a run leaves, all of it kept as checkpoints but for `report`.

    * channels: channel, seconds, cutoff, threshold, n_spikes, n_pc, n_solutions and state, one row a channel: `early cutoff`,
      `no spikes`, `no solution` or `sorted`
    * spikes: channel, spike_id, ix, w, amplitude, energy, slope, pcs and x (the columns that are clustered), one row a spike
    * components: channel, n, mean, axes, ratios, n_pc
    * fits: of all cluster counts and seeds
    * solutions: channel, k, bic and valid, the best fit of each count
    * labels: channel, k, spike_id, ix, amplitude, x, component and cluster (-1 if rejected), of valid solutions
    * report: channel, k, cluster, n, rejected, v1, v2, v1_pct, v2_pct, l_ratio, isolated and severity"""

    channels: DataFrame
    spikes: DataFrame
    components: DataFrame
    fits: DataFrame
    solutions: DataFrame
    labels: DataFrame
    report: DataFrame


#: Samples of a stretch that one group cuts waveforms from, waveforms that are cut at a time, and samples for one of a spike.
BLOCK, CUT, FINE = 65_536, 4096, 10


def waveforms(trace: DataFrame, limits: DataFrame, settings: Settings, fs: float) -> DataFrame:
    """(channel, ix, spike_id, w): each spike below its channel's threshold (channel, threshold), with its waveform at ten times
    the rate, cut about its own least sample; spikes whose waveform does not reach as far are left out, as are those whose snapshot
    leaves the trace.

    Samples and spikes go to blocks, samples to those within reach as well, and each block cuts all of its waveforms at once."""
    shifted = trace.join(limits, "channel").select("channel", "ix", (F.col("v") - F.col("threshold")).alias("v"), "threshold")
    found = de.detected_spikes(shifted.select("channel", "ix", "v"), 0.0)
    places = np.array(de.snapshot_places(fs, settings.spike_pre_time, settings.spike_post_time))
    pre, post = (int(ms * fs / 1000) * FINE for ms in (settings.spike_pre_time, settings.spike_post_time))
    reach = int(np.abs(places).max())
    near = F.explode(F.expr(f"sequence(greatest(0, floor((ix - {reach}) / {BLOCK})), floor((ix + {reach}) / {BLOCK}))"))
    samples = shifted.select("channel", near.alias("block"), "ix", "v", "threshold", F.lit(False).alias("spike"))
    spikes = found.select("channel", F.floor(F.col("ix") / BLOCK).alias("block"), "ix", F.lit(None).cast("double").alias("v"), F.lit(None).cast("double").alias("threshold"), F.lit(True).alias("spike"))
    schema = T.StructType([trace.schema["channel"], T.StructField("ix", T.LongType()), T.StructField("w", T.ArrayType(T.DoubleType()))])
    n = FINE * len(places)
    x = np.arange(n) * (1.0 / FINE)  # as `wf.resampled`
    low = np.minimum(np.floor(x).astype(int), len(places) - 1)
    high = np.minimum(low + 1, len(places) - 1)
    part = np.minimum(x - low, 1.0)

    def cut(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        ix, is_spike = group["ix"].to_numpy() - group["block"][0].as_py() * BLOCK + reach, group["spike"].to_numpy()
        v, own = group["v"].to_numpy()[~is_spike], ix[~is_spike]
        level = group["threshold"].drop_null()[0].as_py() if len(own) else 0.0
        line, hole = np.zeros(BLOCK + 2 * reach), np.zeros(BLOCK + 2 * reach, bool)
        line[own] = v
        hole[own] = group["v"].is_null().to_numpy()[~is_spike]
        count = np.bincount(own, minlength=len(line))
        at = np.sort(ix[is_spike])[:, None] + places
        at, out = at[(count[at] == 1).all(1)], []
        for first in range(0, len(at), CUT):
            some = at[first : first + CUT]
            w = line[some] + level
            fine = w[:, low] + (w[:, high] - w[:, low]) * part
            gone = hole[some][:, low] | hole[some][:, high]
            dip = np.argmin(np.where(gone | np.isnan(fine), np.inf, fine), 1)
            inside = (dip >= pre) & (dip + post <= n)
            to = dip[inside, None] - pre + np.arange(pre + post)
            values = pa.array(np.take_along_axis(fine[inside], to, 1).ravel(), mask=np.take_along_axis(gone[inside], to, 1).ravel())
            ends = pa.array(np.arange(inside.sum() + 1) * (pre + post), pa.int32())
            spot = pa.array(some[inside, 0] - places[0] - reach + group["block"][0].as_py() * BLOCK, pa.int64())
            out.append(pa.table({"channel": group["channel"].take(pa.array(np.zeros(len(spot), int))), "ix": spot, "w": pa.ListArray.from_arrays(ends, values)}))
        kind = {"channel": group["channel"].type, "ix": pa.int64(), "w": pa.list_(pa.float64())}
        return pa.concat_tables([pa.schema(list(kind.items())).empty_table(), *out])

    whole = samples.union(spikes).groupBy("channel", "block").applyInArrow(cut, schema)
    return whole.select("channel", "ix", F.xxhash64("channel", "ix").alias("spike_id"), "w")


def detection(trace: DataFrame, settings: Settings, fs: float, filtered: bool = False, times: float = 5.0, least_seconds: int = 60) -> tuple[DataFrame, DataFrame]:
    """(channels, spikes) of traces (channel, ix, v): filtered unless they are already, cut at breaches, channels that end before
    least_seconds out, spikes `times` medians below the mean. channels: channel, seconds, cutoff, threshold."""
    line = settled(trace if filtered else de.bandpass(trace, fs, settings.filter_low_cutoff, settings.filter_high_cutoff))
    cutoffs = settled(de.recording_cutoff(line, int(fs), settings.breach_voltage_cutoff, settings.breach_max_breach_rate, settings.breach_max_breach_count, settings.breach_max_breach_avg))
    kept = de.truncated(line, cutoffs, int(fs), least_seconds)
    limits = settled(de.detection_threshold(kept, times))
    spikes = settled(waveforms(kept, limits, settings, fs))
    return cutoffs.select("channel", "seconds", "cutoff").join(limits, "channel", "left"), spikes


def valid_solutions(labels: DataFrame, models: DataFrame, components: DataFrame) -> DataFrame:
    """(channel, k, bic, valid): a solution is valid if each of its k components has more than n_pc + 2 of the spikes."""
    grid = models.join(components.select("channel", "n_pc"), "channel").select("channel", "k", "bic", "n_pc", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("component"))
    sizes = labels.groupBy("channel", "k", "component").agg(F.count("*").alias("n"))
    found = grid.join(sizes, ["channel", "k", "component"], "left").groupBy("channel", "k")
    return found.agg(F.first("bic").alias("bic"), (~F.bool_or(F.coalesce("n", F.lit(0)) <= F.col("n_pc") + 2)).alias("valid"))


def sort_traces(trace: DataFrame, settings: Settings, fs: float, filtered: bool = False, times: float = 5.0, least_seconds: int = 60, restarts: int | None = None) -> Sorted:
    """The whole job over traces (channel, ix, v), for all channels at once.

    Band-pass filter, cut at breaches, guard against early cutoffs, threshold, snapshots, waveforms at ten times the rate about
    their least sample, principal components of each channel and how many count, features, mixtures over cluster counts and
    seeds, the best of each count, its labels and whether it is valid, low amplitudes to -1, interval violations and L-ratios of
    every cluster of every valid solution. fs is in samples a second. No sample is taken out as an artefact."""
    channels, spikes = detection(trace, settings, fs, filtered, times, least_seconds)
    share = settings.pca_variance_explained if settings.pca_use_percent_variance == 1 else None
    components = settled(cl.channel_components(spikes, share, settings.pca_principal_component_n))
    spikes = settled(cl.channel_metrics(spikes, components))
    fits = cl.mixtures(spikes, "channel", "x", settings.cluster_min_clusters, settings.cluster_max_clusters, restarts or settings.cluster_random_restarts, settings.cluster_convergence_criterion, settings.cluster_max_iterations)
    fits = settled(fits)
    models = settled(cl.solution_models(fits))
    each = settled(spikes.where("x is not null").select("channel", "spike_id", "ix", "amplitude", "x").join(models.select("channel", "k"), "channel"))
    labels = settled(cl.labelled(each, models, "x", keys=["channel", "k"], out="component").drop("log_density"))
    solutions = settled(valid_solutions(labels, models, components))
    labels = labels.join(solutions.where("valid").select("channel", "k"), ["channel", "k"])
    labels = settled(qu.without_outliers(labels, "amplitude", settings.cluster_intra_cluster_cutoff, "component", ["channel", "k"]).withColumnRenamed("kept_cluster", "cluster"))
    counts = spikes.groupBy("channel").agg(F.count("*").alias("n_spikes"))
    solved = solutions.groupBy("channel").agg(F.count_if("valid").alias("n_solutions"))
    channels = channels.join(counts, "channel", "left").join(components.select("channel", "n_pc"), "channel", "left").join(solved, "channel", "left").fillna(0, ["n_spikes", "n_solutions"])
    state = F.when(F.col("cutoff") < least_seconds, "early cutoff").when(F.col("n_spikes") == 0, "no spikes").when(F.col("n_solutions") == 0, "no solution").otherwise("sorted")
    return Sorted(settled(channels.withColumn("state", state)), spikes, components, fits, solutions, labels, unit_report(labels, fs))


def unit_report(labels: DataFrame, fs: float) -> DataFrame:
    """(channel, k, cluster, n, rejected, v1, v2, v1_pct, v2_pct, l_ratio, isolated, severity) of labels; see `Sorted`."""
    of = ["channel", "k", "cluster"]
    kept = labels.where("cluster >= 0")
    isi = tr.intervals(kept.select(*of, F.col("ix").cast("double").alias("at")), of, "at", fs * 3600)
    violations = tr.isi_violations(isi, of, F.col("isi") * 1000.0 / fs).drop("n", "n_isi")
    gone = labels.where("cluster < 0").groupBy("channel", "k", F.col("component").alias("cluster")).agg(F.count("*").alias("rejected"))
    found = qu.isolation(labels, "channel", "k").join(violations, of).join(gone, of, "left").fillna(0, ["rejected"])
    found = found.withColumn("isolated", qu.isolated(F.col("v1_pct"), F.col("l_ratio"))).withColumn("severity", qu.severity(F.col("v1_pct"), F.col("l_ratio")))
    return found.select(*of, "n", "rejected", "v1", "v2", "v1_pct", "v2_pct", "l_ratio", "isolated", "severity")
