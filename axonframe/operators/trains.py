"""Spike-train analytics: intervals, correlograms, rates around events, baselines, response tests."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from axonframe.functions.ranks import cumulative, quantiles


def intervals(spikes: DataFrame, keys: list[str], time: str, width: float) -> DataFrame:
    """spikes with `isi`, the time since the key's spike before (null for the first).

    Windows hold the spikes of a key within one stretch of `width`; the first of a stretch takes the latest time of the
    stretches before, from a table with one row a stretch.
    """
    cut = spikes.withColumn("stretch", F.floor(F.col(time) / F.lit(width)))
    ends = cut.groupBy(*keys, "stretch").agg(F.max(time).alias("last"))
    before = Window.partitionBy(*keys).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*keys, "stretch", F.max("last").over(before).alias("carried"))
    inside = F.lag(time).over(Window.partitionBy(*keys, "stretch").orderBy(time))
    joined = cut.withColumn("inside", inside).join(ends, [*keys, "stretch"])
    return joined.withColumn("isi", F.col(time) - F.coalesce("inside", "carried")).drop("inside", "carried", "stretch")


def isi_violations(with_isi: DataFrame, keys: list[str], isi_ms: Column) -> DataFrame:
    """keys, spikes, intervals, those below 1 and 2 ms, and these in per cent of the spikes."""
    v = with_isi.select(*keys, isi_ms.alias("ms")).groupBy(*keys).agg(
        F.count("*").alias("n"), F.count("ms").alias("n_isi"), F.count_if(F.col("ms") < 1.0).alias("v1"), F.count_if(F.col("ms") < 2.0).alias("v2")
    )
    return v.withColumn("v1_pct", F.col("v1") * 100.0 / F.col("n")).withColumn("v2_pct", F.col("v2") * 100.0 / F.col("n"))


def isi_histogram(with_isi: DataFrame, keys: list[str], isi_ms: Column, last: int = 10) -> DataFrame:
    """Intervals by whole millisecond, all from `last` ms on in one bin; bins without intervals included."""
    counts = with_isi.where(isi_ms.isNotNull()).groupBy(*keys, F.least(F.floor(isi_ms), F.lit(last)).cast("int").alias("bin")).agg(F.count("*").alias("c"))
    grid = with_isi.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(last))))
    return grid.join(counts, [*keys, "bin"], "left").select(*keys, "bin", F.coalesce("c", F.lit(0)).alias("n"))


def band_join(x: DataFrame, y: DataFrame, keys: list[str], time_x: str, time_y: str, reach: float) -> DataFrame:
    """Pairs of rows with |x - y| <= reach: both sides by stretches of that length, x met by y's of three, checked exactly."""
    left = x.withColumn("stretch", F.floor(F.col(time_x) / F.lit(reach)))
    near = F.floor(F.col(time_y) / F.lit(reach))
    right = y.withColumn("stretch", F.explode(F.array(near - 1, near, near + 1)))
    return left.join(right, [*keys, "stretch"]).where(F.abs(F.col(time_x) - F.col(time_y)) <= reach).drop("stretch")


def correlogram_edges(reach: int, binsize: int = 1) -> list[int]:
    """Where the bins over [-reach, reach] begin, and where the last one, which is closed, ends."""
    bins = -(-(2 * reach + 1) // binsize) - 1
    return [-reach + i * binsize for i in range(bins + 1)]


def correlogram(pairs: DataFrame, keys: list[str], difference: Column, n_x: DataFrame, reach: int, binsize: int = 1) -> DataFrame:
    """keys, bin_start, n and counts_per_spike_ms: histogram of differences over [-reach, reach], the last bin closed."""
    edges = correlogram_edges(reach, binsize)
    ix = F.least(F.floor((F.col("d") + reach) / binsize), F.lit(len(edges) - 2)).cast("int")
    found = pairs.select(*keys, difference.alias("d")).where((F.col("d") >= -reach) & (F.col("d") <= edges[-1])).groupBy(*keys, ix.alias("ix")).agg(F.count("*").alias("c"))
    return on_grid(found, keys, n_x, reach, binsize)


def on_grid(found: DataFrame, keys: list[str], n_x: DataFrame, reach: int, binsize: int = 1) -> DataFrame:
    """Counts (keys, ix, c) as a correlogram with all bins of the keys in n_x (keys, n_x)."""
    grid = n_x.withColumn("ix", F.explode(F.sequence(F.lit(0), F.lit(len(correlogram_edges(reach, binsize)) - 2))))
    out = grid.join(found, [*keys, "ix"], "left").withColumn("n", F.coalesce("c", F.lit(0)))
    return out.select(*keys, (F.col("ix") * binsize - reach).alias("bin_start"), "n", (F.col("n") / (F.col("n_x") * float(binsize))).alias("counts_per_spike_ms"))


#: Stretches of a pair count, in reaches, and distinct times of a stretch that one task compares with others at a time.
STRETCHED, DENSE = 5, 1_000_000


def pair_lags(spikes: DataFrame, unit: str, time: str, reach: int, binsize: int = 1, dense: int = DENSE) -> DataFrame:
    """(x, y, ix, c): how many pairs of spikes of units x < y have a difference of times x - y in bin ix of a correlogram.

    Pairs are counted, not made: sorted times of y tell how many lie before each edge of x's bins, so work grows as spikes and
    bins do, however many pairs these are. Equal times of a unit count at once. Spikes go to their stretch of time, and those of y to the next ones as
    far as the reach; a stretch of more than `dense` times is cut into parts, whose pairs add up. Units are few, as those of an electrode are;
    spikes without a unit or time have no pair."""
    edges = np.array(correlogram_edges(reach, binsize), float)
    wide = STRETCHED * reach
    fine = spikes.select(F.col(unit).alias("unit"), F.col(time).cast("double").alias("t")).where("unit is not null and not isnan(t)")
    times = fine.groupBy("unit", "t").agg(F.count("*").alias("c"))
    at = lambda off: F.floor((F.col("t") + off) / wide)
    near = times.withColumn("stretch", F.explode(F.sequence(at(-edges[-1]), at(reach)))).withColumn("own", F.col("stretch") == at(0))
    sizes = near.groupBy("stretch").agg(F.ceil(F.count("*") / dense).cast("int").alias("parts"))
    met = near.join(sizes, "stretch").withColumn("part", F.pmod(F.xxhash64("t", "unit"), "parts").cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    x = met.where("own").select("stretch", "part", every.alias("other"), F.lit(True).alias("is_x"), "unit", "t", "c")
    y = met.select("stretch", every.alias("part"), F.col("part").alias("other"), F.lit(False).alias("is_x"), "unit", "t", "c")
    kind = fine.schema["unit"].dataType
    schema = T.StructType([T.StructField("x", kind), T.StructField("y", kind), T.StructField("ix", T.IntegerType()), T.StructField("c", T.LongType())])

    def counted(group: pa.Table) -> pa.Table:
        code = group["unit"].combine_chunks().dictionary_encode()
        units, code = code.dictionary, code.indices.to_numpy()
        is_x, t, c = group["is_x"].to_numpy(), group["t"].to_numpy(), group["c"].to_numpy()
        order = np.argsort(t, kind="stable")
        is_x, t, c, code = is_x[order], t[order], c[order], code[order]
        sides = [[(t[k], c[k]) for k in (np.flatnonzero((code == u) & (is_x == side)) for u in range(len(units)))] for side in (True, False)]
        found = ([], [], [], [])
        for u, a in enumerate(units.to_pylist()):
            for v, b in enumerate(units.to_pylist()):
                (tx, cx), (ty, cy) = sides[0][u], sides[1][v]
                if not a < b or not len(tx) or not len(ty):
                    continue
                upto = np.concatenate([[0], np.cumsum(cy)])
                least = [int((cx * upto[np.searchsorted(ty, tx - e, "right")]).sum()) for e in edges[:-1]]  # differences of e or more
                least.append(int((cx * upto[np.searchsorted(ty, tx - edges[-1], "left")]).sum()))
                n = -np.diff(np.array(least, dtype=np.int64))
                for ix in np.flatnonzero(n):
                    for column, value in zip(found, (u, v, int(ix), int(n[ix])), strict=True):
                        column.append(value)
        names = [units.take(pa.array(found[k], pa.int64())) for k in (0, 1)]
        return pa.table({"x": names[0], "y": names[1], "ix": pa.array(found[2], pa.int32()), "c": pa.array(found[3], pa.int64())})

    return x.union(y).groupBy("stretch", "part", "other").applyInArrow(counted, schema).groupBy("x", "y", "ix").agg(F.sum("c").alias("c"))


def window_counts(spikes: DataFrame, keys: list[str], time: str, first: int, last: int, step: int, width: int) -> DataFrame:
    """(keys, start, n): spikes in the closed windows [start, start + width] for start = first, first + step, … last.

    Times are whole numbers. A spike knows its windows, so there is no join of spikes with windows; silent windows of keys
    with a spike are filled from the grid.
    """
    low = F.greatest(F.ceil((F.col(time) - width - first) / step), F.lit(0))
    high = F.least(F.floor((F.col(time) - first) / step), F.lit((last - first) // step))
    hit = spikes.select(*keys, low.cast("long").alias("low"), high.cast("long").alias("high")).where("low <= high")
    found = hit.select(*keys, F.explode(F.sequence("low", "high")).alias("k")).groupBy(*keys, "k").agg(F.count("*").alias("c"))
    grid = spikes.select(*keys).distinct().withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit((last - first) // step).cast("long"))))
    return grid.join(found, [*keys, "k"], "left").select(*keys, (F.col("k") * step + first).alias("start"), F.coalesce("c", F.lit(0)).alias("n"))


def psth(spikes: DataFrame, keys: list[str], time: str, begin: int, end: int, width: int, step: int, unit: float) -> DataFrame:
    """(keys, center, rate): centres from begin + width / 2 by step, below end - width / 2; closed windows; a thousand times the
    count by the width in `unit`s of time."""
    last = begin + ((end - width - begin - 1) // step) * step
    counts = window_counts(spikes, keys, time, begin, last, step, width)
    return counts.select(*keys, (F.col("start") + width // 2).alias("center"), (F.col("n") * 1000.0 / (width / unit)).alias("rate"))


def binned_rate(spikes: DataFrame, keys: list[str], time: str, begin: int, end: int, size: int, step: int, unit: float) -> DataFrame:
    """Like psth, for starts begin, begin + step, … up to the one whose window ends at `end` or just beyond."""
    last = begin + ((end - size + step - begin - 1) // step) * step
    counts = window_counts(spikes, keys, time, begin, last, step, size)
    return counts.select(*keys, (F.col("start") + size // 2).alias("center"), (F.col("n") * 1000.0 / (size / unit)).alias("rate"))


def mean_psth(rates: DataFrame, unit: str = "unit", trial: str = "trial") -> DataFrame:
    """Mean rate of a unit over all trials, silent ones included."""
    trials = rates.select(trial).distinct().agg(F.count("*").alias("trials"))
    return rates.groupBy(unit, "center").agg(F.sum("rate").alias("s")).crossJoin(F.broadcast(trials)).select(unit, "center", (F.col("s") / F.col("trials")).alias("rate"))


def gaussian_weights(sigma: float, truncate: float = 4.0) -> list[float]:
    radius = int(truncate * sigma + 0.5)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    return [x / sum(w) for x in w]


#: Outputs of a block that is smoothed in one go.
BLOCK = 4096


def smoothed(rates: DataFrame, keys: list[str], sigma: float = 3.0, at: str = "center", value: str = "rate", block: int = BLOCK) -> DataFrame:
    """(keys, at, value): each key's values, in the order of `at`, smoothed by a Gaussian and mirrored at both true ends.

    A key's values go to blocks with half a kernel of neighbours on each side, mirrored ones included, so a series of any length
    is many small groups. Where `at` ties, values are smoothed in any order; a null value takes no part and comes out null."""
    weights = gaussian_weights(sigma)
    radius = len(weights) // 2
    # places from 0 come from cumulative counts, which are cut into ranges
    rows = cumulative(rates.select(*keys, at, F.col(value).cast("double").alias(value), F.lit(1).alias("one")), keys, at, ["one"])
    rows = rows.select(*keys, at, value, (F.col("upto_one") - 1).alias("ix"), F.col("total_one").alias("n"))
    turns = F.explode(F.expr(f"sequence(cast(-(({radius} + 2 * n - 1) div (2 * n)) as long), cast(({radius} + 2 * n - 1) div (2 * n) as long))"))
    mirrored = rows.withColumn("turn", turns).withColumn("ways", F.explode(F.expr("array(2 * n * turn + ix, 2 * n * turn - 1 - ix)")))
    near = mirrored.where(f"ways between -{radius} and n - 1 + {radius}")
    first, last = f"greatest(0L, floor((ways - {radius}) / {block}))", f"least((n - 1) div {block}, floor((ways + {radius}) / {block}))"
    dealt = near.withColumn("block", F.explode(F.expr(f"sequence({first}, {last})"))).withColumn("own", F.expr(f"ways = ix and ix div {block} = block"))
    schema = T.StructType([*[rates.schema[k] for k in keys], rates.schema[at], T.StructField(value, T.DoubleType())])
    kernel = np.array(weights)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("ways", kind="stable")
        line = group[value].to_numpy(float)
        out = np.convolve(np.where(np.isnan(line), 0.0, line), kernel, "same")
        if np.isnan(line).any():
            share = np.convolve((~np.isnan(line)).astype(float), kernel, "same")
            out = np.where(np.isnan(line), np.nan, out / np.where(share > 0, share, 1))
        found = group[[*keys, at]].assign(**{value: out})
        return found[group["own"].to_numpy(bool)]

    out = dealt.select(*keys, "block", at, value, "ways", "own").groupBy(*keys, "block").applyInPandas(run, schema)
    return out.withColumn(value, F.nanvl(value, F.lit(None).cast("double")))


def ensemble_raster(spikes: DataFrame, time: str, bins_a_second: float = 100.0, sigma: float = 25.0, unit: str = "unit") -> tuple[DataFrame, DataFrame]:
    """(cells, places): the smoothed raster of all units over a session, and (unit, median, place) by the median spike time.

    Times are in seconds from 0. A bin, numbered by its nearest whole, is 1 if the unit has a spike in it; the rows of all units
    reach from bin 0 to the session's last and are smoothed as `smoothed` does. cells: unit, bin, value."""
    ones = spikes.select(unit, F.round(F.col(time) * bins_a_second).cast("long").alias("bin")).where("bin is not null")
    middle = quantiles(ones, [unit], F.col("bin").cast("double"), {"median": 0.5})
    places = middle.withColumn("place", F.row_number().over(Window.orderBy("median", unit)) - 1)  # one row a unit
    last = ones.agg(F.max("bin").alias("last"))
    stretches = places.select(unit).crossJoin(F.broadcast(last)).withColumn("s", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"last div {BLOCK}"))))  # one row of a number
    grid = stretches.select(unit, F.explode(F.expr(f"sequence(s * {BLOCK}, least(last, s * {BLOCK} + {BLOCK - 1}))")).alias("bin"))
    full = grid.join(ones.distinct().withColumn("value", F.lit(1.0)), [unit, "bin"], "left").fillna(0.0, ["value"])
    return smoothed(full, [unit], sigma, "bin", "value"), places


def zscored(rates: DataFrame, unit: str = "unit", trial: str = "trial") -> DataFrame:
    """Rates less the mean, by the population deviation, of the trials' mean rates at negative times."""
    base = rates.where("center < 0").groupBy(unit, trial).agg(F.avg("rate").alias("m")).groupBy(unit).agg(F.avg("m").alias("mean"), F.stddev_pop("m").alias("sd"))
    return rates.join(base, unit).select(unit, trial, "center", ((F.col("rate") - F.col("mean")) / F.nullif("sd", F.lit(0.0))).alias("z"))


def without_baseline(rates: DataFrame, unit: str = "unit") -> DataFrame:
    base = rates.where("center < 0").groupBy(unit).agg(F.avg("rate").alias("base"))
    return rates.join(base, unit).withColumn("rate", F.col("rate") - F.col("base")).drop("base")


def mean_difference(rows: DataFrame, keys: list[str], value: str, is_b: Column) -> DataFrame:
    """Mean of B less mean of A, and sqrt(sd_a^2 / n_a + sd_b^2 / n_b) / sqrt(n_a + n_b) with population deviations."""
    a, b = F.when(~is_b, F.col(value)), F.when(is_b, F.col(value))
    s = rows.groupBy(*keys).agg(F.avg(a).alias("ma"), F.avg(b).alias("mb"), F.var_pop(a).alias("va"), F.var_pop(b).alias("vb"), F.count(a).alias("na"), F.count(b).alias("nb"))
    sem = F.sqrt(F.col("va") / F.col("na") + F.col("vb") / F.col("nb")) / F.sqrt(F.col("na") + F.col("nb"))
    return s.select(*keys, (F.col("mb") - F.col("ma")).alias("difference"), sem.alias("sem"))


def mann_whitney(rows: DataFrame, keys: list[str], value: str, is_b: Column) -> DataFrame:
    """(keys, n_a, n_b, u, z): U of A against B from tie counts, and its normal score with tie and continuity correction.

    Values are counted first, so ranks come from one row a distinct value, cut into ranges. Without spread z is 0.
    """
    v = rows.groupBy(*keys, F.col(value).alias("v")).agg(F.count_if(~is_b).alias("a"), F.count_if(is_b).alias("b"))
    u = cumulative(v, keys, "v", ["b"]).withColumn("b_below", F.col("upto_b") - F.col("b")).withColumn("t", F.col("a") + F.col("b"))
    s = u.groupBy(*keys).agg(
        F.sum("a").alias("n_a"), F.sum("b").alias("n_b"), F.sum(F.col("a") * (F.col("b_below") + F.col("b") / 2.0)).alias("u"), F.sum(F.pow("t", F.lit(3.0)) - F.col("t")).alias("ties")
    )
    n = F.col("n_a") + F.col("n_b")
    var = F.col("n_a") * F.col("n_b") / 12.0 * ((n + 1) - F.coalesce(F.col("ties") / F.nullif(n * (n - 1), F.lit(0)), F.lit(0.0)))
    off = F.col("u") - F.col("n_a") * F.col("n_b") / 2.0
    return s.select(*keys, "n_a", "n_b", "u", F.when(var > 0, F.signum(off) * F.greatest(F.abs(off) - 0.5, F.lit(0.0)) / F.sqrt(var)).otherwise(F.lit(0.0)).alias("z"))


def two_sided_p(z: Column) -> Column:
    """2 * (1 - Phi(|z|)), the exponential of Abramowitz and Stegun 7.1.26 (error below 1.5e-7)."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return F.least(F.lit(1.0), poly * F.exp(-x * x))


def response_test(rows: DataFrame, keys: list[str], value: str, is_after: Column) -> DataFrame:
    """(keys, n_before, n_after, mean_before, sem_before, mean_after, sem_after, delta, delta_sem, u, z, p): the rates before and
    after an event, their difference, and the Mann-Whitney test of after against before.

    Standard errors take the population deviation. Where a side is missing or all values are equal, p is 1 and u 0."""
    before, after = F.when(~is_after, F.col(value)), F.when(is_after, F.col(value))
    sides = rows.groupBy(*keys).agg(
        F.count(before).alias("n_before"), F.count(after).alias("n_after"), F.avg(before).alias("mean_before"), (F.stddev_pop(before) / F.sqrt(F.count(before))).alias("sem_before"),
        F.avg(after).alias("mean_after"), (F.stddev_pop(after) / F.sqrt(F.count(after))).alias("sem_after"), (F.min(value) == F.max(value)).alias("flat"),
    )
    delta = mean_difference(rows, keys, value, is_after).withColumnsRenamed({"difference": "delta", "sem": "delta_sem"})
    test = mann_whitney(rows, keys, value, ~is_after).select(*keys, "u", "z")
    none = F.col("flat") | (F.col("n_before") == 0) | (F.col("n_after") == 0)
    out = sides.join(delta, keys).join(test, keys)
    return out.select(*keys, "n_before", "n_after", "mean_before", "sem_before", "mean_after", "sem_after", "delta", "delta_sem", F.when(none, 0.0).otherwise(F.col("u")).alias("u"), F.when(none, 0.0).otherwise(F.col("z")).alias("z"), F.when(none, 1.0).otherwise(two_sided_p(F.col("z"))).alias("p"))


def raster(spikes: DataFrame, recordings: DataFrame, units: str = "s") -> tuple[DataFrame, DataFrame]:
    """(points, borders): each spike (rec, sample, unit) at its time over all recordings, and (rec, time) where recordings begin."""
    per = F.lit(1.0) if units == "samples" else F.col("fs") / (1000.0 if units == "ms" else 1.0)
    return unit_times(spikes, recordings, units).select("unit", "time"), recordings.select("rec", (F.col("offset") / per).alias("time"))


def overlay_psth(rates: DataFrame, begin: float, end: float, sigma: float = 3.0, unit: str = "unit", trial: str = "trial") -> DataFrame:
    """(unit, center, rate, sem): the mean over trials within [begin, end] and its standard error (ddof 1), smoothed over the centres."""
    inside = rates.where(F.col("center").between(begin, end))
    stats = inside.groupBy(unit, "center").agg(F.avg("rate").alias("rate"), (F.stddev_samp("rate") / F.sqrt(F.count("*"))).alias("sem"))
    mean = smoothed(stats.select(unit, "center", "rate"), [unit], sigma)
    return mean.join(stats.select(unit, "center", "sem"), [unit, "center"])


def held_criterion(within: DataFrame, across: DataFrame, value: str, percent: float = 95.0, bins: int = 20) -> tuple[DataFrame, DataFrame]:
    """(bars, criterion) of how alike pairs of units are within a session and across sessions: bars (bin, start, within, across), equal
    bins over both, the last closed, and criterion (at, held): the percentile of the pairs within, and how many pairs across
    lie at or below it. Nulls are left out; without any pair within, the criterion is null and nothing is held."""
    sides = within.select(F.col(value).alias("v"), F.lit(True).alias("own")).union(across.select(F.col(value).alias("v"), F.lit(False).alias("own"))).where("v is not null")
    ends = sides.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    place = F.least(F.floor((F.col("v") - F.col("lo")) / F.nullif((F.col("hi") - F.col("lo")) / bins, F.lit(0.0))), F.lit(bins - 1))
    placed = sides.crossJoin(F.broadcast(ends)).withColumn("bin", F.coalesce(place, F.lit(0)).cast("int"))  # one row of two numbers
    counts = placed.groupBy("bin").agg(F.count_if("own").alias("within"), F.count_if(~F.col("own")).alias("across"))
    grid = ends.select(F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda k: F.col("lo") + k * (F.col("hi") - F.col("lo")) / bins)).alias("bin", "start"))
    bars = grid.where("start is not null").join(counts, "bin", "left").fillna(0, ["within", "across"]).select("bin", "start", "within", "across")
    at = quantiles(within.where(F.col(value).isNotNull()).select(F.lit(0).alias("all"), F.col(value).cast("double").alias("v")), ["all"], F.col("v"), {"at": percent / 100}).select("at")
    at = at.agg(F.max("at").alias("at"))
    held = across.crossJoin(F.broadcast(at)).agg(F.count_if(F.col(value) <= F.col("at")).alias("held"))
    return bars, at.crossJoin(held)


def held_units(table: DataFrame, name: str = "name") -> DataFrame:
    """(name, recording, unit): a wide table of held units (name and one column a recording) in long form, without empty cells."""
    columns = [c for c in table.columns if c != name]
    return table.unpivot([name], columns, "recording", "unit").where(F.col("unit").isNotNull())


def unit_times(spikes: DataFrame, recordings: DataFrame, units: str = "samples") -> DataFrame:
    """spikes (rec, sample, …) with `time`: the sample plus the recording's offset, in samples, ms or s."""
    per = {"samples": F.lit(1.0), "ms": F.col("fs") / 1000.0, "s": F.col("fs")}
    if units not in per:
        raise ValueError(f"units are samples, ms or s, not {units}")
    joined = spikes.join(recordings, "rec")
    return joined.withColumn("time", (F.col("sample") + F.col("offset")) / per[units]).drop("fs", "offset")


def recording_offsets(spikes: DataFrame, recordings: DataFrame) -> DataFrame:
    """(rec, offset): the sum over the recordings before of their last sample and three seconds, whole samples."""
    last = recordings.select("rec", "fs").join(spikes.groupBy("rec").agg(F.max("sample").alias("last")), "rec", "left")
    before = Window.orderBy("rec").rowsBetween(Window.unboundedPreceding, -1)  # one row a recording
    return last.select("rec", F.floor(F.coalesce(F.sum(F.coalesce("last", F.lit(0)) + 3 * F.col("fs")).over(before), F.lit(0.0))).cast("long").alias("offset"))


def windows_over_time(spikes: DataFrame, keys: list[str], time: str, width: float, most: int = 10) -> DataFrame:
    """(keys, window, n, first_t, last_t): windows of `width` from a key's first spike; keys with more than `most` windows are left out."""
    first = spikes.groupBy(*keys).agg(F.min(time).alias("t0"), F.max(time).alias("t1")).where((F.col("t1") - F.col("t0")) / width < most)
    cut = spikes.join(first, keys).withColumn("window", F.floor((F.col(time) - F.col("t0")) / F.lit(width)).cast("int"))
    return cut.groupBy(*keys, "window").agg(F.count("*").alias("n"), F.min(time).alias("first_t"), F.max(time).alias("last_t"))
