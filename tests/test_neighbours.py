"""Neighbour graphs against brute force, layouts of planted clusters."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from axonframe.operators import neighbours


def recall(got, x, k):
    far = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(far, np.inf)
    true = np.sort(far, axis=1)[:, :k]
    return np.mean([np.sum(far[a, b] <= true[a, -1] + 1e-12) for a, b in got.items()]) / k


def test_graph_recall(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.standard_normal((700, 12)), rng.standard_normal((700, 12)) * 0.3 + 4, np.repeat(rng.standard_normal((20, 12)), 10, axis=0)])
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(9000, None), (9001, [1.0, None] * 6), (None, [0.0] * 12)], "spike_id long, w array<double>").repartition(5)
    graph = neighbours.neighbour_graph(df, "spike_id", "w", k=10, block=100).cache()
    got = {}
    for r in graph.collect():
        got.setdefault(r.a, []).append(r.b)
        assert r.a != r.b and r.d == pytest.approx(np.linalg.norm(x[r.a] - x[r.b]), abs=1e-6)
    assert set(got) == set(range(len(x))) and {len(set(b)) for b in got.values()} == {10}
    assert recall(got, x, 10) >= 0.9
    assert neighbours.neighbour_graph(df.limit(0), "spike_id", "w").count() == 0
    few = neighbours.neighbour_graph(df.where("spike_id < 30"), "spike_id", "w", k=4)
    got = {}
    for r in few.collect():
        got.setdefault(r.a, []).append(r.b)
    assert recall(got, x[:30], 4) == 1


def test_layout_keeps_clusters_apart(spark):
    rng = np.random.default_rng(5)
    centres = np.eye(10)[:3] * 6
    label = np.arange(180) % 3
    x = centres[label] + rng.standard_normal((180, 10))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "spike_id long, w array<double>")
    for how, options in (("neighbours", {"k": 8}), ("pca", {})):
        got = {r.spike_id: r["at"] for r in neighbours.reduced(df, how, 2, **options).collect()}
        at = np.array([got[i] for i in range(180)])
        middle = np.array([at[label == c].mean(0) for c in range(3)])
        nearest = np.argmin(((at[:, None] - middle) ** 2).sum(2), axis=1)
        assert (nearest == label).mean() > 0.97, how
    with pytest.raises(ValueError):
        neighbours.reduced(df, "magic")
    alone = neighbours.reduced(df.limit(1), "neighbours", 2)
    assert alone.where(F.col("at").isNull()).count() == 1


def test_exact_graph_over_parts(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((900, 8))
    x[400:430] = x[0]  # equal rows: the smaller ids are taken
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (None, x[0].tolist())], "id long, x array<double>")
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(far, np.inf)
    for part in (5000, 200):
        got = neighbours.exact_graph(rows, "id", "x", 6, part).toPandas().sort_values(["a", "d", "b"])
        want = np.argsort(far, axis=1, kind="stable")[:, :6]
        assert got["b"].to_numpy().reshape(-1, 6).tolist() == want.tolist()
        assert np.allclose(got["d"].to_numpy().reshape(-1, 6), np.take_along_axis(far, want, 1), rtol=0, atol=1e-12)
    assert neighbours.exact_graph(rows.limit(1), "id", "x").count() == 0


def test_nearest_neighbours_of_more_than_a_block(spark, tmp_path):
    from axonframe.plans import catalog

    x = np.random.default_rng(5).standard_normal((3000, 32))
    spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = catalog.QUERIES["nearest_neighbours"](spark, str(tmp_path)).toPandas().sort_values(["spike_id", "place"])
    square = (x * x).sum(1)
    far = square[:, None] + square[None] - 2 * x @ x.T
    np.fill_diagonal(far, np.inf)
    assert np.abs(got["distance"].to_numpy().reshape(-1, 5) - np.sqrt(np.sort(far, axis=1)[:, :5])).max() < 6e-6
