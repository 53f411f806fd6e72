"""Detection, trains, quality, clustering and curation against NumPy and planted truth."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from axonframe.config import Settings
from axonframe.functions import ranks
from axonframe.operators import cluster, curate, detect, mixture, moments, quality, sort, trains


def test_runs_and_spikes(spark):
    v = [0, -9, -9, 0, -7, 0, 0, -8]
    t = spark.createDataFrame([("a", i, float(x)) for i, x in enumerate(v)], "channel string, ix long, v double")
    assert sorted((r.first_ix, r.last_ix) for r in detect.threshold_runs(t, -5).collect()) == [(1, 2), (4, 4), (7, 7)]
    assert sorted(r.ix for r in detect.detected_spikes(t, -5).collect()) == [1, 4, 7]
    assert detect.snapshot_places(18_518.0, 0.2, 0.6) == [*range(-5, 1), *range(14)] and len(detect.snapshot_places(30_000.0, 0.5, 1.0)) == 52
    got = detect.spike_snapshots(t, -5, 1000.0, 1.0, 1.0)
    assert sorted({r.ix for r in got.collect()}) == [1, 4]


def test_runs_cross_stretches(spark):
    ix = [0, 1, 2, 3, 4, 5, 8, 11, 12, 13, 15, 16, 17, 30]
    t = spark.createDataFrame([(c, i, -9.0) for c in "ab" for i in ix], "channel string, ix long, v double")
    want, run = [], 0
    for i, x in enumerate(ix):
        run += i == 0 or x != ix[i - 1] + 1
        want.append((x, run))
    for width in (1, 3, 4, 100):
        got = detect.runs(t, ["channel"], width=width)
        assert got.columns == ["channel", "ix", "v", "run"]
        for c in "ab":
            assert sorted((r.ix, r.run) for r in got.where(F.col("channel") == c).collect()) == want
    assert detect.runs(t.limit(0), ["channel"]).count() == 0


def test_cumulative_counts_and_quantiles(spark):
    draw = np.random.default_rng(8)
    data = {"a": draw.normal(size=501), "b": draw.integers(0, 4, 300).astype(float), "c": np.array([7.0]), None: draw.normal(size=12)}
    rows = spark.createDataFrame([(k, float(v)) for k, vs in data.items() for v in vs] + [("a", None), ("d", None)], "k string, v double")
    got = {r.k: r for r in ranks.quantiles(rows, ["k"], F.col("v"), {"low": 0.05, "mid": 0.5, "top": 1.0}).collect()}
    assert set(got) == {*data, "d"}
    for k, vs in data.items():
        assert (got[k].low, got[k].mid, got[k].top) == pytest.approx(tuple(np.quantile(vs, [0.05, 0.5, 1.0])), abs=1e-12)
    assert got["d"].mid is None
    counts = rows.where("v is not null").groupBy("k", "v").agg(F.count("*").alias("n"))
    for r in ranks.cumulative(counts, ["k"], "v", ["n"], 5).collect():
        assert (r.upto_n, r.total_n) == ((data[r.k] <= r.v).sum(), len(data[r.k]))
    assert ranks.quantiles(rows.limit(0), ["k"], F.col("v"), {"mid": 0.5}).count() == 0


def test_bandpass_blocks(spark):
    n = 70_000
    x = np.sin(np.arange(n) / 7) + np.random.default_rng(1).standard_normal(n)
    t = spark.createDataFrame([("a", i, float(y)) for i, y in enumerate(x)], "channel string, ix long, v double")
    got = np.array([r.v for r in detect.bandpass(t, 20_000.0, 300.0, 3000.0).orderBy("ix").collect()])
    k = np.arange(101) - 50
    sinc = lambda f: 2 * f / 20_000 * np.sinc(2 * f / 20_000 * k)
    assert np.allclose(got, np.convolve(x, (sinc(3000) - sinc(300)) * np.hamming(101), "same"))


def test_intervals_cross_stretches(spark):
    times = [0, 1, 25, 26, 99, 100]
    df = spark.createDataFrame([("u", float(t)) for t in times], "unit string, t double")
    got = trains.intervals(df, ["unit"], "t", 10.0).orderBy("t").collect()
    assert [r.isi for r in got] == [None, 1, 24, 1, 73, 1]


def test_window_counts_are_closed(spark):
    df = spark.createDataFrame([("u", t) for t in (0, 10, 20, 35)], "unit string, t long")
    got = trains.window_counts(df, ["unit"], "t", 0, 30, 10, 10).orderBy("start").collect()
    assert [r.n for r in got] == [2, 2, 1, 1]


def test_correlogram_edges(spark):
    x = spark.createDataFrame([("x", 0.0)], "x string, tx double")
    y = spark.createDataFrame([(t,) for t in (-20.0, -19.5, 0.0, 20.0, 20.5)], "ty double")
    pairs = trains.band_join(x, y, [], "tx", "ty", 20.0)
    got = trains.correlogram(pairs, ["x"], F.col("tx") - F.col("ty"), x.select("x", F.lit(1).alias("n_x")), 20)
    by = {r.bin_start: r.n for r in got.collect()}
    assert (by[19], by[0], by[-20], sum(by.values())) == (2, 1, 1, 4)


def test_mann_whitney(spark):
    a, b = [1, 2, 2, 3, 9], [2, 4, 4, 7]
    df = spark.createDataFrame([("u", float(x), i) for i, side in ((False, a), (True, b)) for x in side], "unit string, v double, b boolean")
    r = trains.mann_whitney(df, ["unit"], "v", F.col("b")).first()
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    assert min(r.u, len(a) * len(b) - r.u) == min(u, len(a) * len(b) - u)
    p = df.sparkSession.range(1).select(trains.two_sided_p(F.lit(1.96))).first()[0]
    assert p == pytest.approx(math.erfc(1.96 / math.sqrt(2)), abs=1e-6)


def test_chi_squared(spark):
    for df in (1, 2, 3, 4, 5):
        f = quality.chi2_sf
        got = spark.createDataFrame([(3.7,)], "x double").select(f(F.col("x"), df)).first()[0]
        u = np.linspace(0, 1, 400_001)[1:]  # survival by integrating the density over x / u
        x = 3.7 / u
        density = x ** (df / 2 - 1) * np.exp(-x / 2) / (2 ** (df / 2) * math.gamma(df / 2))
        assert got == pytest.approx((density * 3.7 / u**2).sum() / 400_000, rel=1e-3)


def planted(spark, d=2):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.standard_normal((80, d)) * 0.3 + np.eye(d)[i % d] * 5 * (i > 0) for i in range(3)])
    names = [f"f{i}" for i in range(d)]
    return x, names, spark.createDataFrame([("c", i, *map(float, r)) for i, r in enumerate(x)], f"channel string, spike_id long, {', '.join(f'{c} double' for c in names)}")


def test_mixture_labels(spark):
    x, names, df = planted(spark, 3)
    best = cluster.chosen_models(cluster.mixtures(df, "channel", names, 2, 4, 3))
    assert best.first().k == 3
    got = {r.spike_id: r.cluster for r in cluster.labelled(df, best, names).collect()}
    for i in range(3):
        assert len({got[j] for j in range(80 * i, 80 * i + 80)}) == 1
    assert len(set(got.values())) == 3
    rough = df.withColumn("f0", F.when(F.col("spike_id") > 5, F.col("f0")))
    assert cluster.labelled(rough, best, names).where("cluster is null").count() == 6
    assert cluster.labelled(df.withColumn("channel", F.lit("other")), best, names).where("cluster is not null").count() == 0


def test_mixture_by_jobs_is_the_same(spark):
    """Channels too large for a group are fitted by jobs over all of them at once, in the same steps; the input is read once."""
    x, names, df = planted(spark)
    other = df.withColumn("channel", F.lit(None).cast("string")).withColumn("f0", F.col("f0") * 2 + 1)
    few = df.where("spike_id % 40 = 0").withColumn("channel", F.lit("few"))
    df, read = df.union(other).union(few), spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    df = df.mapInPandas(counted, df.schema)
    kinds = ["channel", "k", "seed", "n", "converged"]
    order = lambda fits: sorted(fits.collect(), key=lambda r: (str(r.channel), r.k, r.seed))
    one = order(cluster.mixtures(df, "channel", names, 2, 3, 2))
    assert read.value == 486
    two = order(cluster.mixtures(df, "channel", names, 2, 3, 2, group_rows=100))
    assert read.value == 2 * 486
    assert [[r[c] for c in kinds] for r in one] == [[r[c] for c in kinds] for r in two] and len(one) == 12
    for a, b in zip(one, two, strict=True):
        assert a.bic == pytest.approx(b.bic, rel=1e-9) and np.allclose(a.means, b.means) and np.allclose(a.covs, b.covs)
    cut = order(cluster.mixtures(df, "channel", names, 3, 3, 1, tol=0.0, steps=3, group_rows=100))
    whole = order(cluster.mixtures(df, "channel", names, 3, 3, 1, tol=0.0, steps=3))
    assert not any(r.converged for r in cut) and np.allclose([r.log_likelihood for r in cut], [r.log_likelihood for r in whole])
    assert cluster.mixtures(df.limit(0), "channel", names, 2, 3, 2).count() == 0


def test_mixture_steps_against_numpy(spark):
    """One step from given means, and densities, against the formulas written out."""
    x = np.random.default_rng(3).standard_normal((50, 2)) @ np.array([[2.0, 0.5], [0, 1]])
    means = x[[3, 20, 40]]
    near = np.argmin(((x[:, None] - means) ** 2).sum(2), axis=1)
    weights, mu, covs = (p[0] for p in mixture.next_model(mixture.moment_sums(x, means[None])[1], 2))
    for j in range(3):
        own = x[near == j]
        assert weights[j] == pytest.approx(len(own) / 50) and np.allclose(mu[j], own.mean(0)) and np.allclose(covs[j], np.cov(own.T, bias=True) + 1e-6 * np.eye(2), atol=1e-9)
    dense = np.array([[w * np.exp(-(r - m) @ np.linalg.inv(c) @ (r - m) / 2) / (2 * np.pi * np.sqrt(np.linalg.det(c))) for w, m, c in zip(weights, mu, covs, strict=True)] for r in x])
    total, sums = mixture.moment_sums(x, (weights[None], mu[None], covs[None]))
    share = dense / dense.sum(1)[:, None]
    assert total[0] == pytest.approx(np.log(dense.sum(1)).sum()) and np.allclose(sums[0, :, 0], share.sum(0)) and np.allclose(sums[0, :, 1:3], share.T @ x)


def test_moments_and_components_of_groups(spark):
    rng = np.random.default_rng(11)
    data = {"a": rng.standard_normal((70, 4)) @ rng.standard_normal((4, 4)) + 1e3, None: rng.standard_normal((9, 3)), "flat": np.ones((5, 2)), "one": np.array([[1.0, 2.0]])}
    rows = [(c, x.tolist()) for c, xs in data.items() for x in xs] + [("a", None), ("a", [1.0, None, 2.0, 3.0]), ("a", [float("nan")] * 4), ("none", [])]
    df = spark.createDataFrame(rows, "channel string, x array<double>").repartition(5)
    got = {r.channel: r for r in moments.grouped_moments(df, ["channel"]).collect()}
    assert set(got) == set(data)
    for c, x in data.items():
        assert got[c].n == len(x) and np.allclose(got[c].mean, x.mean(0), rtol=1e-12)
        assert np.allclose(np.reshape(got[c].m2, (x.shape[1], -1)), (x - x.mean(0)).T @ (x - x.mean(0)), atol=1e-8)
    models = moments.components(df, ["channel"])
    found = {r.channel: r for r in models.collect()}
    assert found["flat"].ratios is None and found["one"].ratios is None
    for c in ("a", None):
        off = data[c] - data[c].mean(0)
        _, size, axes = np.linalg.svd(off, full_matrices=False)
        assert np.allclose(found[c].ratios, size**2 / (size**2).sum()) and np.allclose(np.abs(np.array(found[c].axes) @ axes.T), np.eye(len(size)), atol=1e-6)
    scored = moments.projected(df, models, ["channel"]).where("x is not null").collect()
    for r in scored:
        sound = r.x and all(v is not None and v == v for v in r.x)
        assert (r.pcs is None) if not sound else np.allclose(r.pcs, (np.array(r.x) - data[r.channel].mean(0)) @ np.array(found[r.channel].axes).T)
    assert moments.components(df.limit(0), ["channel"]).count() == 0


def test_component_counts_of_channels(spark):
    rng = np.random.default_rng(12)
    w = {"a": rng.standard_normal((60, 6)) * [9, 5, 1, 0.1, 0.1, 0.1], "b": rng.standard_normal((60, 6)), "zero": np.zeros((4, 6))}
    df = spark.createDataFrame([(c, i, x.tolist()) for c, xs in w.items() for i, x in enumerate(xs)], "channel string, spike_id int, w array<double>")
    models = cluster.channel_components(df, 0.9)
    got = {r.channel: r.n_pc for r in models.collect()}
    for c in ("a", "b"):
        scaled = w[c] / (np.sqrt((w[c] ** 2).sum(1)) / 6)[:, None]
        ratios = np.linalg.svd(scaled - scaled.mean(0), compute_uv=False) ** 2
        assert got[c] == np.flatnonzero(np.cumsum(ratios / ratios.sum()) > 0.9)[0] + 1
    assert got["a"] < got["b"] and got.get("zero", 0) == 0
    assert {r.channel: r.n_pc for r in cluster.channel_components(df, None, 2).collect()}["b"] == 2
    metrics = cluster.channel_metrics(df, models)
    assert {(r.channel, len(r.x)) for r in metrics.where("x is not null").collect()} == {("a", 3 + got["a"]), ("b", 3 + got["b"])}
    curve = cluster.variance_curve(models.select("channel", F.posexplode("ratios").alias("component", "ratio")), 0.9, ["channel"]).groupBy("channel").count()
    assert {r.channel: r["count"] for r in curve.collect()} == {"a": got["a"], "b": got["b"]}


def test_rows_meet_models_either_way(spark):
    """Broadcast models, and rows dealt with them in several parts, give the same labels."""
    _, names, df = planted(spark)
    df = df.union(df.withColumn("channel", F.lit(None).cast("string"))).union(df.limit(5).withColumn("channel", F.lit("other")))
    best = cluster.chosen_models(cluster.mixtures(df.where("channel is null or channel = 'c'"), "channel", names, 3, 3, 1))
    one = cluster.labelled(df, best, names)
    models = best.select("channel", "weights", "means", "covs")

    def run(batch, model):
        return batch.append_column("k", pa.array([None if model is None else len(model["weights"])] * batch.num_rows, pa.int32()))

    schema = T.StructType([*df.schema.fields, T.StructField("k", T.IntegerType())])
    key = lambda r: (str(r.channel), r.spike_id)
    for most in (10**9, 0):
        got = moments.with_models(df, models, ["channel"], run, schema, most, 37).collect()
        assert sorted((*key(r), r.k or 0) for r in got) == sorted((*key(r), 0 if r.channel == "other" else 3) for r in one.collect())


def test_isolation_of_arrays(spark):
    x, names, df = planted(spark, 3)
    df = df.withColumn("cluster", F.when(F.col("spike_id") % 9 == 0, -1).otherwise((F.col("spike_id") / 80).cast("int"))).withColumn("k", F.lit(3))
    df = df.union(df.withColumn("k", F.lit(4)).withColumn("f0", F.col("f0") * 1.5))
    want = {(r.k, r.cluster): (r.n, r.l_ratio) for r in quality.l_ratios(df, names, "cluster", ["channel", "k"]).collect()}
    got = {(r.k, r.cluster): (r.n, r.l_ratio) for r in quality.isolation(df.withColumn("x", F.array(*names)), "channel", "k").collect()}
    assert set(got) == set(want) and all(got[c][0] == want[c][0] and got[c][1] == pytest.approx(want[c][1], rel=1e-6) for c in want)
    flat = df.withColumn("x", F.array("f0", "f0", F.lit(1.0)))
    assert {r.l_ratio for r in quality.isolation(flat, "channel", "k").collect()} == {None}
    for d in range(1, 8):
        got = spark.createDataFrame([(v,) for v in (0.0, 0.3, 4.0, 30.0)], "x double").select(quality.chi2_sf(F.col("x"), d)).collect()
        assert np.allclose([r[0] for r in got], quality.chi2_tail(np.array([0.0, 0.3, 4.0, 30.0]), d), rtol=1e-6)


def test_component_models_against_numpy(spark):
    models = spark.createDataFrame([("c", [[1.0, 2.0], [0.0, 0.0]], [[[2.0, 0.5], [0.5, 1.0]], [[1.0, 1.0], [1.0, 1.0]]])], "channel string, means array<array<double>>, covs array<array<array<double>>>")
    got = {r.component: r for r in quality.component_models(models, ["a", "b"]).collect()}
    inverse = np.linalg.inv([[2.0, 0.5], [0.5, 1.0]])
    assert (got[0].mean_a, got[0].mean_b) == (1, 2) and np.allclose([got[0].inv_a_a, got[0].inv_a_b, got[0].inv_b_b], inverse[[0, 0, 1], [0, 1, 1]])
    assert got[1].inv_a_a is None
    row = spark.createDataFrame([("c", 4.0, 1.0)], "channel string, a double, b double")
    far = {r.component: r.distance for r in quality.mahalanobis(row, ["a", "b"], models=quality.component_models(models, ["a", "b"])).collect()}
    assert far[0] == pytest.approx(math.sqrt(np.array([3, -1]) @ inverse @ np.array([3, -1]))) and far[1] is None


def test_metric_table(spark):
    rng = np.random.default_rng(4)
    w = rng.standard_normal((60, 8)) * np.arange(1, 9)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(w)], "spike_id int, w array<double>")
    got = cluster.metric_table(df).orderBy("spike_id").toPandas()
    energy = np.sqrt((w * w).sum(1)) / 8
    scaled = w / energy[:, None]
    off = scaled - scaled.mean(0)
    _, _, axes = np.linalg.svd(off, full_matrices=False)
    assert np.allclose(got.amplitude, w.min(1)) and np.allclose(got.energy, energy)
    assert np.allclose(got[["pc0", "pc1", "pc2"]].abs(), np.abs(off @ axes[:3].T), atol=1e-6)


def test_distances_in_six_columns(spark):
    x, names, df = planted(spark, 6)
    df = df.withColumn("cluster", (F.col("spike_id") / 80).cast("int"))
    got = quality.l_ratios(df, names).orderBy("cluster").collect()
    far = quality.mahalanobis(df, names).where("spike_id = 100").orderBy("component").collect()
    for i in range(3):
        own, rest = x[80 * i : 80 * i + 80], np.delete(x, range(80 * i, 80 * i + 80), 0)
        inverse = np.linalg.inv(np.cov(own.T))
        d2 = np.einsum("ni,ij,nj->n", rest - own.mean(0), inverse, rest - own.mean(0))
        tail = np.exp(-d2 / 2) * (1 + d2 / 2 + (d2 / 2) ** 2 / 2)
        assert got[i].l_ratio == pytest.approx(tail.sum() / 80, rel=1e-6)
        off = x[100] - own.mean(0)
        assert far[i].distance == pytest.approx(math.sqrt(off @ inverse @ off), rel=1e-9)
    same = df.withColumn("f1", F.col("f0"))
    assert {r.l_ratio for r in quality.l_ratios(same, names).collect()} == {None}
    models = quality.component_models(cluster.chosen_models(cluster.mixtures(df, "channel", names[:2], 2, 2, 1)), names[:2])
    assert quality.mahalanobis(df, names[:2], models=models).count() == 480


def test_split_by_mixture(spark):
    _, names, df = planted(spark, 3)
    spikes = df.withColumn("cluster", F.lit(4)).withColumn("t", F.col("spike_id"))
    labels = curate.split_by_mixture(spikes, 4, names, 3, 3)
    sizes = {r.part: r["count"] for r in labels.groupBy("part").count().collect()}
    assert sorted(sizes.values()) == [80, 80, 80]
    kept = curate.commit_split(spikes, labels, 4, [0, 2])
    assert {r.cluster for r in kept.select("cluster").distinct().collect()} == {40, 42} and kept.count() == 160
    assert curate.commit_split(spikes, labels, 4, []).count() == 240


def test_sort_finds_planted_spikes(spark):
    """Two shapes of spikes in noise through all steps: all found, in two units a channel; channels that end early or are silent."""
    rng = np.random.default_rng(8)
    rows, places = [], {}
    for c in ("a", "b", "late"):
        v = rng.standard_normal(30_000) * 0.3
        at = np.arange(300, 29_700, 294)
        shapes = np.array([[0, 0, 5, 30, 60, 30, 5, 0, 0], [2, 10, 35, 40, 60, 10, -20, -25, -5]])
        for k, p in enumerate(at):
            v[p - 4 : p + 5] -= shapes[k % 2] * (1 + (k % 2)) * (1 + rng.standard_normal() * 0.02)
        if c == "late":
            v[4000:] += 2000 * np.sin(np.arange(26_000) * 0.2 * np.pi)  # breaches from 0.4 s on
        places[c] = at
        rows += [(c, i, float(y)) for i, y in enumerate(v)]
    rows += [("silent", i, 0.0) for i in range(30_000)]
    trace = spark.createDataFrame(rows, "channel string, ix long, v double")
    settings = Settings(cluster_max_clusters=3, cluster_random_restarts=3, breach_max_breach_count=2)
    got = sort.sort_traces(trace, settings, 10_000.0, least_seconds=1)
    state = {r.channel: r for r in got.channels.collect()}
    assert {c: r.state for c, r in state.items()} == {"a": "sorted", "b": "sorted", "late": "early cutoff", "silent": "no spikes"}
    assert (state["a"].seconds, state["late"].cutoff) == (3, 0) and 1 <= state["a"].n_pc <= 8
    spikes = got.spikes.toPandas()
    assert set(spikes.channel) == {"a", "b"} and {len(w) for w in spikes.w} == {80}
    best = {r.channel: r.k for r in cluster.chosen_models(got.fits).collect()}
    labels = got.labels.toPandas()
    for c in ("a", "b"):
        own = spikes[spikes.channel == c]
        gap = np.abs(own.ix.to_numpy()[:, None] - places[c]).min(0)
        assert (gap <= 3).all()  # every planted spike, where the filter leaves its least sample
        two = labels[(labels.channel == c) & (labels.k == best[c])]
        two = two[np.abs(two.ix.to_numpy()[:, None] - places[c]).min(1) <= 3]  # the filter's own ripples may be spikes as well
        order = np.argmin(np.abs(two.ix.to_numpy()[:, None] - places[c]), axis=1) % 2
        shares = [two.component[order == k].value_counts(normalize=True) for k in (0, 1)]
        assert best[c] >= 2 and all(x.max() > 0.95 for x in shares) and shares[0].idxmax() != shares[1].idxmax()
        assert (two.cluster >= 0).mean() > 0.9
    report = got.report.toPandas()
    kept = labels[labels.cluster >= 0].groupby(["channel", "k", "cluster"]).size()
    assert {(r.channel, r.k, r.cluster): r.n for r in report.itertuples()} == kept.to_dict()
    assert set(report.l_ratio[report.severity.isna()] <= 0.1) <= {True}
    assert got.solutions.where("valid").count() >= 2


def test_response_of_flat_rates(spark):
    df = spark.createDataFrame([("u", 1.0, b) for b in (False, True, True)] + [("v", 2.0, True)], "unit string, rate double, after boolean")
    got = {r.unit: r for r in trains.response_test(df, ["unit"], "rate", F.col("after")).collect()}
    assert (got["u"].u, got["u"].p, got["u"].delta) == (0, 1, 0) and (got["v"].u, got["v"].p, got["v"].n_before) == (0, 1, 0)


def test_rasters_overlays_held_units(spark):
    spikes = spark.createDataFrame([(0, 10, "u"), (1, 20, "u")], "rec int, sample long, unit string")
    recordings = spark.createDataFrame([(0, 10.0, 0), (1, 10.0, 100)], "rec int, fs double, offset long")
    points, borders = trains.raster(spikes, recordings)
    assert sorted(r.time for r in points.collect()) == [1.0, 12.0] and sorted(r.time for r in borders.collect()) == [0.0, 10.0]
    rates = spark.createDataFrame([("u", str(t), float(c), float(c + t)) for t in range(3) for c in range(-40, 41, 10)], "unit string, trial string, center double, rate double")
    over = trains.overlay_psth(rates, -20, 20).orderBy("center").collect()
    assert [r.center for r in over] == [-20, -10, 0, 10, 20] and all(r.sem == pytest.approx(1 / math.sqrt(3)) for r in over)
    wide = spark.createDataFrame([("x", "u1", None), ("y", None, "u3")], "name string, day1 string, day2 string")
    assert sorted(tuple(r) for r in trains.held_units(wide).collect()) == [("x", "day1", "u1"), ("y", "day2", "u3")]


def test_smoothing_in_blocks(spark):
    """Blocks and halos give what the whole series gives, mirrored at its ends, also where it is shorter than the kernel."""
    rng = np.random.default_rng(9)
    for n, sigma in ((1, 3.0), (5, 3.0), (12, 3.0), (13, 3.0), (400, 3.0), (150, 25.0)):
        v = rng.standard_normal(n)
        df = spark.createDataFrame([(u, float(3 * i), float(x) + (u == "b")) for u in ("a", "b") for i, x in enumerate(v)], "unit string, center double, rate double").repartition(3)
        weights = np.array(trains.gaussian_weights(sigma))
        r = len(weights) // 2
        line = np.array([v[p if p < n else 2 * n - 1 - p] for p in np.arange(-r, n + r) % (2 * n)])
        for block in (7, 4096):
            got = {(x.unit, x.center): x.rate for x in trains.smoothed(df, ["unit"], sigma, block=block).collect()}
            assert len(got) == 2 * n and np.allclose([got["a", 3.0 * i] for i in range(n)], np.convolve(line, weights, "valid"))
            assert got["b", 0.0] == pytest.approx(got["a", 0.0] + 1)
    rough = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.0, None), ("a", 3.0, 2.0), (None, 1.0, 5.0)], "unit string, center double, rate double")
    assert sorted((str(r.unit), r.center, r.rate and round(r.rate, 9)) for r in trains.smoothed(rough, ["unit"]).collect()) == [("None", 1.0, 5.0), ("a", 1.0, 2.0), ("a", 2.0, None), ("a", 3.0, 2.0)]
    assert trains.smoothed(rough.limit(0), ["unit"]).count() == 0


def test_ensemble_raster(spark):
    spikes = spark.createDataFrame([("u", 0.0), ("u", 0.011), ("u", 0.0099), ("v", 0.5), (None, 0.2)], "unit string, t double")
    cells, places = trains.ensemble_raster(spikes.where("unit is not null"), "t", 100.0, 2.0)
    got = {(r.unit, r.bin): r.value for r in cells.collect()}
    assert len(got) == 102 and got["u", 0] > got["u", 5] > 0 and got["u", 40] == 0 and got["v", 50] == max(v for (u, _), v in got.items() if u == "v")
    assert {r.unit: (r.median, r.place) for r in places.collect()} == {"u": (1.0, 0), "v": (50.0, 1)}


def test_waveform_lines(spark):
    """Clipped lines on a small canvas, against a canvas that is drawn step by step."""
    rng = np.random.default_rng(10)
    w = [*(np.round(rng.standard_normal((30, 5)), 1)), np.array([0.0, np.nan, 1.0, 1.0, -1.0]), np.array([0.5]), *[np.zeros(5)] * 3]
    rows = [(i, 0, [None if v != v and i % 2 else float(v) for v in x]) for i, x in enumerate(w)] + [(99, 1, [2.0] * 4), (100, 1, None)]
    df = spark.createDataFrame(rows, "spike_id int, cluster int, w array<double>")
    width, height = 40, 30
    got = {(r.cluster, r.x, r.y): r for r in quality.waveform_lines(df, step=1, width=width, height=height).collect()}
    values = np.concatenate(w)
    lo, hi = np.quantile(values[~np.isnan(values)], [0.05, 0.95])
    canvas = {}
    for x in w:
        for i in range(len(x) - 1):
            a, b = x[i], x[i + 1]
            if a != a or b != b or max(a, b) < lo or min(a, b) > hi:
                continue
            ends = []
            for v, t in ((a, 0.0), (b, 1.0)):
                edge = min(max(v, lo), hi)
                ends.append((i + (t if edge == v else (edge - a) / (b - a)), edge))
            (x0, y0), (x1, y1) = ((min(int(p / (len(x) - 1) * width), width - 1), min(int((q - lo) / (hi - lo) * height), height - 1)) for p, q in ends)
            far = max(abs(x1 - x0), abs(y1 - y0))
            for k in range(int(i > 0 and lo <= a <= hi), far + 1):
                cell = (x0 + ((2 * k * (x1 - x0) + far) // (2 * far) if far else 0), y0 + ((2 * k * (y1 - y0) + far) // (2 * far) if far else 0))
                canvas[cell] = canvas.get(cell, 0) + 1
    assert {(x, y): r.n for (c, x, y), r in got.items() if c == 0} == canvas
    counts = np.array(list(canvas.values()))
    assert all(r.shade == pytest.approx((counts <= r.n).mean()) for (c, _, _), r in got.items() if c == 0)
    assert {(x, y): r.n for (c, x, y), r in got.items() if c == 1} == {(x, 0): 1 for x in range(width)}


def test_curation(spark):
    df = spark.createDataFrame([(i % 2, i % 3, i, float(i)) for i in range(12)], "rec int, cluster int, spike_id long, t double")
    s = curate.Session(df)
    s.edit("split 1", curate.split_by_recording(s.spikes, 1))
    s.edit("merge", curate.merge(s.spikes, [10, 11], 1))
    assert curate.equal_clusters(df.where("cluster = 1"), s.spikes.where("cluster = 1")).first().equal
    s.edit("drop", curate.discard(s.spikes, [1]))
    assert s.spikes.count() == 8 and s.log() == ["split 1", "merge", "drop"] and s.undo().count() == 12
    assert not curate.equal_clusters(df.where("cluster = 1"), df.where("cluster = 2")).first().equal


def test_pca_scores(spark):
    x = np.random.default_rng(5).standard_normal((50, 6)) * [5, 3, 2, 1, 0.5, 0.1] + 7
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "spike_id int, w array<double>")
    got = np.array([r.pcs for r in cluster.pca_scores(df, 3).orderBy("spike_id").collect()])
    off = x - x.mean(0)
    _, _, axes = np.linalg.svd(off, full_matrices=False)
    assert np.allclose(np.abs(got), np.abs(off @ axes[:3].T), atol=1e-6)


def test_lilliefors(spark):
    v = np.random.default_rng(6).exponential(size=40)
    df = spark.createDataFrame([("u", float(y)) for y in v], "k string, v double")
    z = np.sort((v - v.mean()) / v.std(ddof=1))
    phi = np.array([0.5 * (1 + math.erf(y / math.sqrt(2))) for y in z])
    e = np.arange(1, 41) / 40
    assert cluster.lilliefors(df, ["k"], "v").first().d == pytest.approx(max(np.abs(e - phi).max(), np.abs(phi - e + 1 / 40).max()), abs=1e-6)


def test_cells_of_drawn_lines_do_not_travel_through_the_driver(spark):
    rng = np.random.default_rng(2)
    rows = spark.createDataFrame([(0, rng.normal(0, 1, 64).tolist()) for _ in range(40)], "cluster int, w array<double>")
    drawn = quality.waveform_lines(rows)
    assert drawn.count() > 50_000
    drawn.collect()
    plan = drawn._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan  # cells are drawn once, not for each of their uses
    assert "BuildLeft" not in plan.split("ExistingRDD")[0]  # and stay where they are


@pytest.mark.parametrize("dense", [7, 10**6])
def test_pair_lags_against_all_pairs(spark, dense):
    rng = np.random.default_rng(4)
    rows = [(str(u), float(t)) for u, t in zip(rng.integers(0, 3, 400), rng.integers(0, 900, 400) / 2, strict=True)] + [(None, 1.0), ("1", None)]
    want = {}
    for a, s in rows[:400]:
        for b, t in rows[:400]:
            if a < b and abs(s - t) <= 20:
                key = a, b, min(int(np.floor(s - t + 20)), 39)
                want[key] = want.get(key, 0) + 1
    got = trains.pair_lags(spark.createDataFrame(rows, "unit string, t double"), "unit", "t", 20, dense=dense).collect()
    assert {(r.x, r.y, r.ix): r.c for r in got} == want


def test_pair_lags_count_pairs_without_making_them(spark):
    n = 100_000  # ten thousand million pairs
    rows = spark.range(2 * n).select(F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("unit"), (F.col("id") / n).alias("t"))
    from axonframe.plans import catalog

    got = catalog.tr.pair_lags(rows, "unit", "t", 20).agg(F.sum("c")).first()[0]
    assert got == n * n


@pytest.mark.parametrize("block", [37, 65_536])
def test_waveforms_across_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(sort, "BLOCK", block)
    v = np.random.default_rng(9).normal(0, 1, 600)
    settings = Settings(spike_pre_time=0.2, spike_post_time=0.6)
    trace = spark.createDataFrame([("a", i, float(x)) for i, x in enumerate(v)], "channel string, ix long, v double")
    limits = spark.createDataFrame([("a", -0.5)], "channel string, threshold double")
    got = {r.ix: r.w for r in sort.waveforms(trace, limits, settings, 10_000.0).collect()}
    places = detect.snapshot_places(10_000.0, 0.2, 0.6)
    low = [i for i in range(600) if v[i] <= -0.5]
    runs = np.split(low, [k for k in range(1, len(low)) if low[k] != low[k - 1] + 1])
    want = {}
    for run in runs:
        spot = int(run[np.argmin(v[run])])
        if spot + places[0] >= 0 and spot + places[-1] < 600:
            fine = np.interp(np.arange(10 * len(places)) / 10, np.arange(len(places)), v[[spot + p for p in places]])
            dip = int(np.argmin(fine))
            if dip >= 20 and dip + 60 <= len(fine):
                want[spot] = fine[dip - 20 : dip + 60]
    assert len(want) > 50 and sorted(got) == sorted(want)
    assert all(np.allclose(got[spot], want[spot], atol=1e-12) for spot in want)
