"""Unit quality: Mahalanobis distances, L-ratio, isolation criteria, mean waveforms, waveform density."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from axonframe.functions import waveform as wf
from axonframe.functions.ranks import cumulative, quantiles
from axonframe.operators.moments import grouped_moments, matrix, sound, with_models
from axonframe.sources.recordings import settled


def cluster_models(rows: DataFrame, columns: list[str], cluster: str = "cluster") -> DataFrame:
    """(cluster, n, mean_<c>, inv_<c>_<d>): means and the inverse of the sample covariance, of any number of columns.

    Sums come from one aggregate; the small matrices, one row a cluster, are inverted in Arrow batches. Inverses are null
    where the covariance has none."""
    k = len(columns)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    stats = [F.avg(c).alias(f"mean_{c}") for c in columns] + [F.covar_samp(columns[i], columns[j]).alias(f"s{i}_{j}") for i, j in pairs]
    m = rows.groupBy(cluster).agg(F.count("*").alias("n"), *stats)
    cov = F.array(*[F.array(*[F.col(f"s{min(i, j)}_{max(i, j)}") for j in range(k)]) for i in range(k)])
    return inverted(m.select(cluster, "n", F.array(*[f"mean_{c}" for c in columns]).alias("mean"), cov.alias("cov")), columns)


def inverted(models: DataFrame, columns: list[str]) -> DataFrame:
    """(…, mean_<c>, inv_<c>_<d>) of models (…, mean, cov): the inverse's upper half, null if the covariance is singular."""
    k = len(columns)
    keys = [c for c in models.columns if c not in ("mean", "cov")]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]

    def run(batches):
        for batch in batches:
            flat = []
            for cov in batch["cov"]:
                a = np.array([[np.nan if v is None else v for v in row] for row in cov], float)
                scale = np.sqrt(np.abs(np.diag(a))) if np.isfinite(a).all() else np.zeros(k)
                sound = (scale > 0).all() and np.linalg.cond(unit := a / np.outer(scale, scale)) < 1e12
                inverse = np.linalg.inv(unit) / np.outer(scale, scale) if sound else None
                flat.append(None if inverse is None else [float(inverse[i, j]) for i, j in pairs])
            yield batch[keys].assign(mean=batch["mean"], inverse=flat)

    schema = T.StructType([*[models.schema[c] for c in keys], T.StructField("mean", T.ArrayType(T.DoubleType())), T.StructField("inverse", T.ArrayType(T.DoubleType()))])
    found = models.mapInPandas(run, schema)
    means = [F.get("mean", F.lit(i)).alias(f"mean_{c}") for i, c in enumerate(columns)]
    return found.select(*keys, *means, *[F.get("inverse", F.lit(x)).alias(f"inv_{columns[i]}_{columns[j]}") for x, (i, j) in enumerate(pairs)])


def component_models(models: DataFrame, columns: list[str]) -> DataFrame:
    """(channel, component, mean_<c>, inv_<c>_<d>): every component of fitted mixtures (channel, means, covs) as `mahalanobis` takes it."""
    each = models.select("channel", F.posexplode(F.arrays_zip("means", "covs")).alias("component", "m"))
    return inverted(each.select("channel", "component", F.col("m.means").alias("mean"), F.col("m.covs").alias("cov")), columns)


def squared_distance(columns: list[str]) -> Column:
    """The quadratic form of a row's columns less the model's means."""
    d = [F.col(c) - F.col(f"mean_{c}") for c in columns]
    out = F.lit(0.0)
    for i, a in enumerate(columns):
        for j in range(i, len(columns)):
            out = out + (1 if i == j else 2) * d[i] * d[j] * F.col(f"inv_{a}_{columns[j]}")
    return out


def with_each(rows: DataFrame, models: DataFrame) -> DataFrame:
    """Each row with each of the models, one a cluster: these travel as one row that holds them all, and rows do not move."""
    listed = models.agg(F.collect_list(F.struct(*models.columns)).alias("_models"))
    return rows.crossJoin(listed).withColumn("_m", F.explode("_models")).select(*rows.columns, "_m.*")


def mahalanobis(rows: DataFrame, columns: list[str], cluster: str = "cluster", models: DataFrame | None = None) -> DataFrame:
    """Every row against every cluster's model: rows with `component` and `distance`.

    Models are the clusters' sample moments or, if given, those of a fit (component, mean_<c>, inv_<c>_<d>, and `channel`
    where rows have it too: then rows meet the components of their own channel)."""
    if models is None:
        models = cluster_models(rows.where(F.col(cluster).isNotNull()), columns, cluster).withColumnRenamed(cluster, "component").drop("n")
    met = rows.join(models, "channel") if "channel" in models.columns else with_each(rows, models)
    return met.withColumn("distance", F.sqrt(squared_distance(columns))).select(*rows.columns, "component", "distance")


def equal_bins(values: DataFrame, keys: list[str], value: str, bins: int = 10) -> DataFrame:
    """(keys, bin, n): equal bins between a key's least and greatest value, the last closed; empty bins are not listed."""
    ends = values.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    ix = F.least(F.floor((F.col(value) - F.col("lo")) / F.nullif((F.col("hi") - F.col("lo")) / bins, F.lit(0.0))), F.lit(bins - 1))
    return values.join(ends, keys).groupBy(*keys, F.coalesce(ix, F.lit(0)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


#: Chebyshev coefficients of erfc, relative error 1.2e-7 everywhere (Numerical Recipes, 6.2): fixed values.
_ERFC = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]


def erfc(x: Column) -> Column:
    """The complementary error function of numbers that are not negative."""
    t = 1 / (1 + 0.5 * x)
    power = F.lit(_ERFC[-1])
    for c in _ERFC[-2::-1]:
        power = power * t + c
    return t * F.exp(power - x * x)


def chi2_sf(x: Column, df: int) -> Column:
    """The chance that a chi-squared of df degrees of freedom exceeds x, in closed form: a finite sum, with erfc for odd df."""
    if df % 2 == 0:
        return F.exp(-x / 2) * sum((F.pow(x / 2, F.lit(j)) / math.factorial(j) for j in range(df // 2)), F.lit(0.0))
    terms = sum((F.pow(x / 2, F.lit(j + 0.5)) / math.gamma(j + 1.5) for j in range((df - 1) // 2)), F.lit(0.0))
    return erfc(F.sqrt(x / 2)) + F.exp(-x / 2) * terms


def l_ratios(rows: DataFrame, columns: list[str], cluster: str = "cluster", keys: list[str] | None = None) -> DataFrame:
    """(keys, cluster, n, l_ratio): the summed chance that each row outside of the cluster lies as far from it, by the cluster's rows.

    Rejected rows (-1) count as outside of all clusters and are no cluster. With keys, say a channel and a solution, the
    clusters of each are apart; a cluster whose covariance has no inverse gets a null ratio."""
    keys = keys or []
    named = rows.withColumn("_of", F.struct(*keys, cluster))
    models = cluster_models(named.where(F.col(cluster) >= 0), columns, "_of").withColumnRenamed("_of", "_model")
    met = with_each(named, models)
    if keys:
        same = [F.col(key).eqNullSafe(F.col(f"_model.{key}")) for key in keys]
        met = named.join(models, same)
    outside = met.where(F.col(cluster) != F.col(f"_model.{cluster}"))
    sums = outside.groupBy("_model").agg(F.sum(chi2_sf(squared_distance(columns), len(columns))).alias("s"), F.count("*").alias("m"))
    found = models.select("_model", "n", F.col(f"inv_{columns[0]}_{columns[0]}").alias("inv")).join(sums, "_model", "left")
    ratio = F.when(F.col("inv").isNotNull(), F.coalesce("s", F.lit(0.0)) / F.col("n"))
    return found.select(*[F.col(f"_model.{c}").alias(c) for c in [*keys, cluster]], "n", ratio.alias("l_ratio"))


def chi2_tail(x: np.ndarray, df: int) -> np.ndarray:
    """As `chi2_sf`, for arrays."""
    half = x / 2
    if df % 2 == 0:
        return np.exp(-half) * sum(half**j / math.factorial(j) for j in range(df // 2))
    terms = sum((half ** (j + 0.5) / math.gamma(j + 1.5) for j in range((df - 1) // 2)), np.zeros(len(x)))
    return np.array([math.erfc(v) for v in np.sqrt(half)]) + np.exp(-half) * terms


def _sound_inverse(cov: np.ndarray) -> np.ndarray | None:
    """The inverse of a covariance, None if it has none to speak of."""
    scale = np.sqrt(np.abs(np.diag(cov))) if np.isfinite(cov).all() else np.zeros(len(cov))
    if not (scale > 0).all() or np.linalg.cond(unit := cov / np.outer(scale, scale)) >= 1e12:
        return None
    return np.linalg.inv(unit) / np.outer(scale, scale)


def isolation(rows: DataFrame, channel: str, solution: str, x: str = "x", cluster: str = "cluster") -> DataFrame:
    """(channel, solution, cluster, n, l_ratio): as `l_ratios`, of arrays whose length may differ between channels.

    The clusters' moments come from one pass; rows meet those of their channel and solution as `with_models` says."""
    of = [channel, solution]
    moments = grouped_moments(rows.where(F.col(cluster) >= 0), [*of, cluster], x)
    models = moments.groupBy(*of).agg(F.collect_list(F.struct(F.col(cluster).alias("cluster"), "n", "mean", "m2")).alias("clusters"))
    schema = T.StructType([*[rows.schema[k] for k in [*of, cluster]], T.StructField("far", T.DoubleType()), T.StructField("sound", T.BooleanType())])

    def run(batch: pa.RecordBatch, model: dict | None) -> pa.RecordBatch:
        found = []
        if model:
            data, labels = matrix(batch.column(x)), batch.column(cluster).to_numpy(zero_copy_only=False)
            for c in model["clusters"]:
                d, inverse = data.shape[1], None
                if c["n"] > 1:
                    inverse = _sound_inverse(np.array(c["m2"]).reshape(d, d) / (c["n"] - 1))
                off = data[labels != c["cluster"]] - np.array(c["mean"])
                far = 0.0 if inverse is None else float(chi2_tail(np.maximum(((off @ inverse) * off).sum(1), 0), d).sum())
                found.append((c["cluster"], far, inverse is not None))
        keys = [pa.array([model[k] if model else None] * len(found), batch.schema.field(k).type) for k in of]
        labels, far, fine = zip(*found, strict=True) if found else ((), (), ())
        return pa.RecordBatch.from_arrays([*keys, pa.array(labels, batch.schema.field(cluster).type), pa.array(far, pa.float64()), pa.array(fine, pa.bool_())], names=schema.names)

    sums = with_models(rows.where(sound(x)).select(*of, cluster, x), models, of, run, schema).groupBy(*of, cluster).agg(F.sum("far").alias("far"), F.every("sound").alias("sound"))
    return moments.select(*of, cluster, "n").join(sums, [*of, cluster]).select(*of, cluster, "n", F.when(F.col("sound"), F.col("far") / F.col("n")).alias("l_ratio"))


def severity(v1_pct: Column, l_ratio: Column, cutoff: float = 0.1) -> Column:
    """red, orange, yellow or null from the 1 ms violations in per cent and the L-ratio."""
    bad = l_ratio > cutoff
    return F.when((v1_pct > 1) & bad, "red").when(((v1_pct > 0.5) & bad) | (v1_pct > 1), "orange").when((v1_pct > 0.5) | bad, "yellow")


def isolated(v1_pct: Column, l_ratio: Column) -> Column:
    return (v1_pct <= 0.5) & (l_ratio <= 0.1)


def without_outliers(rows: DataFrame, value: str, times: float = 3.0, cluster: str = "cluster", keys: list[str] | None = None) -> DataFrame:
    """rows with `kept_cluster`: -1 where the value is at or below the cluster's mean less `times` its population deviation.

    With keys, say a channel, the clusters of each are apart. The deviation and mean come from an aggregate that is
    joined back, not from a window, so a large cluster is not one task."""
    of = [*(keys or []), cluster]
    stats = rows.groupBy(*of).agg(F.avg(value).alias("m"), F.stddev_pop(value).alias("sd"))
    out = rows.join(stats, of)
    return out.withColumn("kept_cluster", F.when(F.col(value) <= F.col("m") - times * F.col("sd"), F.lit(-1)).otherwise(F.col(cluster))).drop("m", "sd")


def compiled_report(quality: DataFrame, grid: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(report, missing): the quality rows (keys, cluster, n, v1_pct, v2_pct, l_ratio) of all solutions of all channels with
    `isolated` and `severity`, and the rows of the grid (keys) that have none."""
    report = quality.withColumn("isolated", isolated(F.col("v1_pct"), F.col("l_ratio"))).withColumn("severity", severity(F.col("v1_pct"), F.col("l_ratio")))
    return report.join(grid.select(*keys).distinct(), keys, "left_semi"), grid.join(quality.select(*keys).distinct(), keys, "left_anti")


def mean_waveforms(spikes: DataFrame, cluster: str = "cluster") -> DataFrame:
    """(cluster, pos, mean_v, sd_v, n) for each sample place."""
    return spikes.select(cluster, F.posexplode("w").alias("pos", "v")).groupBy(cluster, "pos").agg(F.avg("v").alias("mean_v"), F.stddev_pop("v").alias("sd_v"), F.count("*").alias("n"))


def waveform_range(spikes: DataFrame, cluster: str = "cluster") -> DataFrame:
    return spikes.groupBy(cluster).agg(F.min(F.array_min("w")).alias("lo"), F.max(F.array_max("w")).alias("hi"))


def waveform_density(spikes: DataFrame, height: int = 50, cluster: str = "cluster") -> DataFrame:
    """(cluster, pos, level, n, shade): points of a cluster's waveforms by sample place and height between its 5th and 95th
    percentile, and the share of filled cells with as few points or fewer (histogram equalisation)."""
    points = spikes.select(cluster, F.posexplode("w").alias("pos", "v")).where(~F.isnan("v"))
    ends = settled(quantiles(points, [cluster], F.col("v"), {"lo": 0.05, "hi": 0.95}))
    inside = points.join(ends, cluster).where("v between lo and hi")
    level = F.least(F.floor((F.col("v") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * height), F.lit(height - 1)).cast("int")
    cells = inside.groupBy(cluster, "pos", F.coalesce(level, F.lit(0)).alias("level")).agg(F.count("*").alias("n"))
    return equalised(cells, [cluster])


#: Shades that travel to all tasks at once.
SHADES = 250_000


def equalised(cells: DataFrame, keys: list[str]) -> DataFrame:
    """cells (keys, n, …) with `shade`: the share of a key's cells with as few points or fewer. Distinct counts are ranked, not cells.

    Cells are settled, as they are read twice. What they are drawn from may be far smaller, and Spark, which goes by its size, would
    send them through the driver; so the shades, few as distinct counts are, go to the cells, or merge with them if there are many."""
    cells = settled(cells)
    kinds = settled(cells.groupBy(*keys, "n").agg(F.count("*").alias("c")))
    shades = cumulative(kinds, keys, "n", ["c"]).select(*keys, "n", (F.col("upto_c") / F.col("total_c")).alias("shade"))
    return cells.join(shades.hint("broadcast" if kinds.count() <= SHADES else "merge"), [*keys, "n"])


#: Columns of a canvas that one task draws, and tasks at least.
STRIP, DRAWERS = 32, 64


def waveform_lines(spikes: DataFrame, cluster: str = "cluster", column: str = "w", step: int = 10, width: int = 1600, height: int = 1200) -> DataFrame:
    """(cluster, x, y, n, shade): how many waveforms' lines pass each cell of a canvas, and its shade by histogram equalisation.

    Every step-th sample of a waveform is a vertex. The canvas reaches from the first to the last vertex and from the 5th to the
    95th percentile of a cluster's vertices; lines are clipped to it. A line takes one cell for each step along its longer
    side, at the nearest cell of the other; a vertex between two lines counts once. Equal lines of a cluster are drawn once, with
    their number, so the drawing depends on the canvas and not on the number of spikes. Samples that are null or no number
    break a line; a waveform of fewer than two vertices draws nothing."""
    w = wf.every(wf.doubles(F.col(column)), step)
    lines = spikes.select(cluster, w.alias("w"))
    fine = lambda v: v.isNotNull() & ~F.isnan(v)
    values = lines.select(cluster, F.explode("w").alias("v")).where(fine(F.col("v")))
    ends = settled(quantiles(values, [cluster], F.col("v"), {"lo": 0.05, "hi": 0.95}))
    segments = lines.where(F.size("w") > 1).withColumn("i", F.explode(F.sequence(F.lit(0), F.size("w") - 2)))
    segments = segments.select(cluster, "i", F.size("w").alias("m"), F.get("w", F.col("i")).alias("a"), F.get("w", F.col("i") + 1).alias("b"))
    segments = segments.where(fine(F.col("a")) & fine(F.col("b"))).join(ends, cluster)
    segments = segments.where("greatest(a, b) >= lo and least(a, b) <= hi")
    at = lambda v: f"case when {v} < lo then lo when {v} > hi then hi else {v} end"
    place = lambda v: f"i + case when {v} < lo then (lo - a) / (b - a) when {v} > hi then (hi - a) / (b - a) else {int(v == 'b')}.0 end"
    column_of = lambda x: f"cast(least(floor(({x}) / (m - 1) * {width}), {width - 1}) as int)"
    row_of = lambda y: f"cast(least(coalesce(floor((({y}) - lo) / nullif(hi - lo, 0.0) * {height}), 0), {height - 1}) as int)"
    drawn = segments.selectExpr(cluster, f"{column_of(place('a'))} as x0", f"{row_of(at('a'))} as y0", f"{column_of(place('b'))} as x1", f"{row_of(at('b'))} as y1", "i > 0 and a between lo and hi as goes_on")
    drawn = drawn.groupBy(cluster, "x0", "y0", "x1", "y1", "goes_on").agg(F.count("*").alias("c"))
    drawn = drawn.withColumn("long", F.greatest(F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0"))))
    drawn = drawn.where("long > 0 or not goes_on").withColumn("strip", F.explode(F.expr(f"sequence(x0 div {STRIP}, x1 div {STRIP})")))
    tasks = max(DRAWERS, int(spikes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    drawn = drawn.repartition(tasks, cluster, "strip")  # lines move, not their cells; by number, as they are small until they are drawn
    first = f"if(x1 > x0, floor(long * (strip * {STRIP} - x0 - 1) / (x1 - x0)), 0)"  # a step or two too many on both sides
    last = f"if(x1 > x0, ceil(long * ((strip + 1) * {STRIP} - x0) / (x1 - x0)), long)"
    ends_at = f"cast(greatest({first}, int(goes_on)) as int), cast(least({last}, long) as int)"
    drawn = drawn.withColumn("k", F.explode(F.expr(f"sequence({ends_at})")))
    cell = lambda p, q: f"cast({p} + if(long > 0, floor((2 * k * ({q} - {p}) + long) / (2 * long)), 0) as int)"
    placed = drawn.select(cluster, "strip", "c", F.expr(cell("x0", "x1")).alias("x"), F.expr(cell("y0", "y1")).alias("y")).where(f"x div {STRIP} = strip")
    cells = placed.groupBy(cluster, "strip", "x", "y").agg(F.sum("c").alias("n")).drop("strip")
    return equalised(cells, [cluster])
