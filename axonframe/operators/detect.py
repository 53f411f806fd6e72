"""Spike detection on traces (channel, ix, v): thresholds, runs, spikes, snapshots, recording cutoff."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from axonframe.functions.ranks import quantiles


def detection_threshold(trace: DataFrame, times: float = 5.0) -> DataFrame:
    """(channel, threshold): mean less `times` the median of |v| / 0.6745."""
    middle = quantiles(trace, ["channel"], F.abs("v") / 0.6745, {"middle": 0.5})
    return trace.groupBy("channel").agg(F.avg("v").alias("mean")).join(middle, "channel").select("channel", (F.col("mean") - times * F.col("middle")).alias("threshold"))


#: Samples of a stretch, within which windows run.
STRETCH = 65_536


def runs(places: DataFrame, keys: list[str], ix: str = "ix", width: int = STRETCH) -> DataFrame:
    """places with `run`: the number, from 1, of the run of consecutive ix within its keys that a row belongs to.

    Windows hold a stretch of `width` samples; a table with one row a stretch says how many runs began before it and whether
    its first run goes on from the stretch before. A repeated ix begins a run; rows without keys or ix are left out.
    """
    cut = places.withColumn("stretch", F.floor(F.col(ix) / width))
    w = Window.partitionBy(*keys, "stretch").orderBy(ix)
    marked = cut.withColumn("new", F.when(F.col(ix) - F.lag(ix).over(w) == 1, 0).otherwise(1))
    ends = marked.groupBy(*keys, "stretch").agg(F.min(ix).alias("first"), F.max(ix).alias("last"), F.sum("new").alias("begun"))
    by = Window.partitionBy(*keys).orderBy("stretch")
    ends = ends.withColumn("goes_on", F.when(F.col("first") - F.lag("last").over(by) == 1, 1).otherwise(0))
    before = F.coalesce(F.sum(F.col("begun") - F.col("goes_on")).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = ends.select(*keys, "stretch", (before - F.col("goes_on")).alias("carried"))
    inside = marked.withColumn("inside", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return inside.join(ends, [*keys, "stretch"]).select(*[F.col(c) for c in places.columns], (F.col("inside") + F.col("carried")).alias("run"))


def threshold_runs(trace: DataFrame, threshold: float) -> DataFrame:
    """(channel, run, first_ix, last_ix, n): runs of samples at or below the threshold."""
    below = runs(trace.where(F.col("v") <= threshold), ["channel"])
    return below.groupBy("channel", "run").agg(F.min("ix").alias("first_ix"), F.max("ix").alias("last_ix"), F.count("*").alias("n"))


def detected_spikes(trace: DataFrame, threshold: float) -> DataFrame:
    """(channel, run, ix, v): the first least sample of each run at or below the threshold."""
    below = runs(trace.where(F.col("v") <= threshold), ["channel"])
    low = below.groupBy("channel", "run").agg(F.min(F.struct("v", "ix")).alias("m"))
    return low.select("channel", "run", F.col("m.ix").alias("ix"), F.col("m.v").alias("v"))


def snapshot_places(fs: float, pre_ms: float, post_ms: float) -> list[int]:
    """Offsets of a snapshot's samples from the spike: steps of one from a tenth of a millisecond before the first to one after the
    last, each cut toward zero, so that the spike's own sample stands twice where the first step is not whole."""
    first, end = -(pre_ms + 0.1) * fs / 1000, 1 + (post_ms + 0.1) * fs / 1000
    return [int(first + i) for i in range(math.ceil(end - first))]


def spike_snapshots(trace: DataFrame, threshold: float, fs: float, pre_ms: float = 0.5, post_ms: float = 1.0) -> DataFrame:
    """(channel, ix, pos, v): samples around each spike; spikes whose snapshot leaves the trace are dropped."""
    places = snapshot_places(fs, pre_ms, post_ms)
    found = detected_spikes(trace, threshold).select("channel", "ix")
    wanted = found.select("channel", F.col("ix").alias("spike"), F.posexplode(F.array(*[F.lit(p) for p in places])).alias("pos", "at"))
    got = wanted.withColumn("ix", F.col("spike") + F.col("at")).join(trace, ["channel", "ix"]).withColumn("n", F.count("*").over(Window.partitionBy("channel", "spike")))
    return got.where(F.col("n") == len(places)).select("channel", F.col("spike").alias("ix"), F.col("pos").cast("long").alias("pos"), "v")


def recording_cutoff(trace: DataFrame, fs: int, voltage: float, max_rate: float, max_secs: int, max_mean: float) -> DataFrame:
    """(channel, seconds, breach_rate, secs_above, mean_breaches, cutoff) of each channel.

    Breaches are samples above the voltage, counted in whole seconds. If their rate, the seconds that have any and their mean
    in these reach all limits, the recording is cut at the first second with more than max_mean breaches, else not.
    """
    sizes = trace.groupBy("channel").agg(F.max("ix").alias("last"), F.count_if(F.col("v") > voltage).alias("breaches"))
    sizes = sizes.select("channel", "breaches", (F.col("last") + 1).alias("n"), F.expr(f"(last + 1) div {fs}").alias("seconds"))
    by_second = trace.groupBy("channel", F.expr(f"ix div {fs}").alias("sec")).agg(F.count_if(F.col("v") > voltage).alias("b"))
    whole = by_second.join(sizes, "channel").where("sec < seconds")
    stats = whole.groupBy("channel").agg(
        F.count_if(F.col("b") > 0).alias("secs_above"), F.coalesce(F.avg(F.when(F.col("b") > 0, F.col("b"))), F.lit(0.0)).alias("mean_breaches"), F.min(F.when(F.col("b") > max_mean, F.col("sec"))).alias("early")
    )
    out = sizes.join(stats, "channel", "left").withColumn("breach_rate", F.col("breaches") * float(fs) / F.col("n"))
    bad = (F.col("breach_rate") >= max_rate) & (F.col("secs_above") >= max_secs) & (F.col("mean_breaches") >= max_mean)
    return out.select("channel", "seconds", "breach_rate", "secs_above", "mean_breaches", F.when(bad, F.coalesce("early", "seconds")).otherwise(F.col("seconds")).alias("cutoff"))


def truncated(trace: DataFrame, cutoffs: DataFrame, fs: int, least_seconds: int = 60) -> DataFrame:
    """The samples before the channel's cutoff, of channels that last for least_seconds."""
    kept = cutoffs.where(F.col("cutoff") >= least_seconds).select("channel", "cutoff")
    return trace.join(kept, "channel").where(F.col("ix") < F.col("cutoff") * fs).select(*trace.columns)


def voltage_per_second(trace: DataFrame, fs: int) -> DataFrame:
    return trace.groupBy("channel", F.expr(f"ix div {fs}").alias("sec")).agg(F.avg("v").alias("mean_v"))


def without_artifacts(trace: DataFrame, deviations: float = 10.0) -> DataFrame:
    """Samples whose magnitude is below so many standard deviations of the channel."""
    spread = trace.groupBy("channel").agg(F.stddev_pop("v").alias("sd"))
    return trace.join(spread, "channel").where(F.abs("v") < deviations * F.col("sd")).select(*trace.columns)


def bandpass_kernel(fs: float, low: float, high: float, taps: int = 101) -> np.ndarray:
    """A windowed-sinc kernel (Hamming) that passes frequencies from low to high."""
    k = np.arange(taps) - taps // 2
    sinc = lambda f: 2 * f / fs * np.sinc(2 * f / fs * k)
    return (sinc(high) - sinc(low)) * np.hamming(taps)


def bandpass(trace: DataFrame, fs: float, low: float, high: float, taps: int = 101) -> DataFrame:
    """(channel, ix, v): a windowed-sinc FIR filter (Hamming); ends see zeros. Samples go to blocks with half a filter of
    margin on both sides, so a task filters a block and no window spans a channel."""
    half, block = taps // 2, 65_536
    kernel = bandpass_kernel(fs, low, high, taps)
    near = F.array_distinct(F.array(F.expr(f"(ix - {half}) div {block}"), F.expr(f"ix div {block}"), F.expr(f"(ix + {half}) div {block}")))
    dealt = trace.withColumn("block", F.explode(near)).where("block >= 0")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        at = int(group["block"].iloc[0]) * block
        line = np.zeros(block + 2 * half)
        line[group["ix"].to_numpy() - at + half] = group["v"].to_numpy()
        own = np.sort(group["ix"][(group["ix"] >= at) & (group["ix"] < at + block)].to_numpy())
        return pd.DataFrame({"channel": group["channel"].iloc[0], "ix": own, "v": np.convolve(line, kernel, "valid")[own - at]})

    return dealt.groupBy("channel", "block").applyInPandas(run, "channel string, ix long, v double")
