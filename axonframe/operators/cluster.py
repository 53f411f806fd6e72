"""Reduction and clustering: PCA, component counts, the grid of mixtures, model choice, feature tables."""

from __future__ import annotations

import math

from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from axonframe.functions import waveform as wf
from axonframe.functions.ranks import _same, cumulative
from axonframe.operators.mixture import bic, chosen_models, labelled, mixtures, solution_models
from axonframe.operators.moments import components, projected

__all__ = ["bic", "chosen_models", "labelled", "mixtures", "solution_models"]


def pca_model(rows: DataFrame, column: str = "w", k: int | None = None):
    """(scaler, model): centring and principal components of an array column; k components, all if None."""
    vectors = rows.select(array_to_vector(F.col(column)).alias("raw"))
    scaler = StandardScaler(inputCol="raw", outputCol="centred", withMean=True, withStd=False).fit(vectors)
    size = k or int(scaler.mean.size)
    return scaler, PCA(k=size, inputCol="centred", outputCol="pcs").fit(scaler.transform(vectors))


def pca_scores(rows: DataFrame, k: int = 3, column: str = "w") -> DataFrame:
    """rows with `pcs`, the scores on k components of the centred arrays; signs are arbitrary."""
    scaler, model = pca_model(rows, column, k)
    scored = model.transform(scaler.transform(rows.withColumn("raw", array_to_vector(F.col(column)))))
    return scored.withColumn("pcs", vector_to_array("pcs")).drop("raw", "centred")


def variance_curve(ratios: DataFrame, limit: float = 0.999, keys: list[str] | None = None) -> DataFrame:
    """(keys, component, ratio, cumulative) up to the first component that brings a key's sum above the limit; ratios (keys, component,
    ratio), components from 0 in falling order. Null ratios give no rows."""
    w = Window.partitionBy(*(keys or [])).orderBy("component").rowsBetween(Window.unboundedPreceding, 0)  # one row a component
    total = ratios.withColumn("cumulative", F.sum("ratio").over(w))
    return total.where(F.col("cumulative") - F.col("ratio") <= limit)


def component_count(ratios: DataFrame, share: float = 0.95, keys: list[str] | None = None) -> DataFrame:
    """(keys, n): components until their share of the variance is above `share`; keys without variance are left out."""
    return variance_curve(ratios, share, keys).groupBy(*(keys or [])).agg(F.count("*").alias("n"))


def channel_components(spikes: DataFrame, settings_share: float | None = 0.95, fixed: int = 5, channel: str = "channel", column: str = "w") -> DataFrame:
    """(channel, n, mean, axes, ratios, n_pc): the principal components of each channel's waveforms by their energy, in one job,
    and how many count: until their share of the variance is above settings_share, or `fixed` of them if that is None. A channel
    without variance has none."""
    found = components(spikes.withColumn("_scaled", wf.scaled(F.col(column))), [channel], "_scaled")
    if settings_share is None:
        return found.withColumn("n_pc", F.when(F.col("ratios").isNull(), 0).otherwise(F.least(F.lit(fixed), F.size("mean"))))
    count = component_count(found.select(channel, F.posexplode("ratios").alias("component", "ratio")), settings_share, [channel])
    return _same(found, count.withColumn("n", F.col("n").cast("int")).withColumnRenamed("n", "n_pc"), [channel], "left").fillna(0, ["n_pc"])


def channel_metrics(spikes: DataFrame, models: DataFrame, channel: str = "channel", column: str = "w") -> DataFrame:
    """spikes with `amplitude`, `energy`, `slope`, `pcs` (scores on the channel's counted components) and `x`, all of these in an
    array. A waveform without a slope (its least sample is the first) has slope 0; one of zero energy has no scores and no x."""
    w = F.col(column)
    shaped = spikes.withColumn("amplitude", wf.amplitude(w)).withColumn("energy", wf.energy(w)).withColumn("slope", F.coalesce(wf.slope(w), F.lit(0.0)))
    scored = projected(shaped.withColumn("_scaled", wf.scaled(w)), models, [channel], "_scaled").drop("_scaled")
    return scored.withColumn("x", F.when(F.col("pcs").isNotNull(), F.concat(F.array("amplitude", "energy", "slope"), "pcs")))


def lilliefors(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, n, d): the largest gap between the empirical distribution and the normal one of the same mean and deviation.

    Constant groups have a null d. Ranks come from one row a distinct value of a key, cut into ranges."""
    stats = rows.groupBy(*keys).agg(F.avg(value).alias("m"), F.stddev_samp(value).alias("sd"), F.count("*").alias("n"))
    counts = rows.groupBy(*keys, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    counts = cumulative(counts, keys, "v", ["c"]).join(stats, keys)
    z = (F.col("v") - F.col("m")) / F.nullif("sd", F.lit(0.0))
    gap = counts.withColumn("e", F.col("upto_c") / F.col("n")).withColumn("phi", normal_cdf(z))
    return gap.groupBy(*keys).agg(F.max("n").alias("n"), F.max(F.greatest(F.abs(F.col("e") - F.col("phi")), F.abs(F.col("phi") - F.col("e") + F.col("c") / F.col("n")))).alias("d"))


def normal_cdf(z: Column) -> Column:
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    tail = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * F.exp(-x * x) / 2
    return F.when(z >= 0, 1 - tail).otherwise(tail)


def selected_coefficients(coefficients: DataFrame, n: int = 10) -> DataFrame:
    """(k, d): the n places of (spike_id, k, coef) whose values are least normal."""
    return lilliefors(coefficients, ["k"], "coef").where("d is not null").orderBy(F.desc("d"), "k").limit(n).select("k", "d")


def cluster_grid(channels: DataFrame, least: int = 2, most: int = 7, restarts: int = 10) -> DataFrame:
    """channels with `k` (least to most, both included) and `seed`."""
    grid = channels.withColumn("k", F.explode(F.sequence(F.lit(least), F.lit(most))))
    return grid.withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(restarts - 1))))


def metric_table(spikes: DataFrame, n_pc: int = 3) -> DataFrame:
    """spikes with `amplitude`, `energy`, `slope` and `pc0`, …: the principal components of the waveforms by their energy."""
    w = F.col("w")
    shaped = spikes.withColumn("amplitude", wf.amplitude(w)).withColumn("energy", wf.energy(w)).withColumn("slope", wf.slope(w))
    scored = pca_scores(shaped.withColumn("scaled", wf.scaled(w)), n_pc, "scaled").drop("scaled")
    return scored.select(*shaped.columns, *[F.get("pcs", F.lit(i)).alias(f"pc{i}") for i in range(n_pc)])


def assembled(artefacts: list[DataFrame], key: str = "spike_id") -> DataFrame:
    """Stored artefacts of the same spikes side by side, by equi-joins on the key; spikes that any of them lacks are left out."""
    out = artefacts[0]
    for other in artefacts[1:]:
        out = out.join(other, key)
    return out


def pooled_components(spikes: DataFrame, clusters: list[int], n_pc: int = 3, column: str = "w") -> DataFrame:
    """The spikes of some clusters with `pcs`, scores on components that are fitted on all of them together."""
    return pca_scores(spikes.where(F.col("cluster").isin(clusters)), n_pc, column)


def best_fits(fits: DataFrame, keys: list[str]) -> DataFrame:
    """Of each key's converged fits the one with the least BIC, the first seed of equals."""
    return fits.where("converged").groupBy(*keys).agg(F.min(F.struct("bic", "seed")).alias("m")).select(*keys, "m.seed", "m.bic")


def valid_solutions(sizes: DataFrame, n_pc: int) -> DataFrame:
    """(solution, valid): whether each component has more than n_pc + 2 spikes; sizes (solution, component, n), n null if empty."""
    return sizes.groupBy("solution").agg((~F.bool_or(F.coalesce("n", F.lit(0)) <= n_pc + 2)).alias("valid"))


def feature_pairs(names: DataFrame) -> DataFrame:
    """(a, b): all pairs of (pos, name) rows, the earlier first; the names are few."""
    a, b = names.select(F.col("pos").alias("i"), F.col("name").alias("a")), names.select(F.col("pos").alias("j"), F.col("name").alias("b"))
    return a.join(b, F.col("i") < F.col("j")).select("a", "b")
