"""Nearest-neighbour graphs by neighbour descent, and layouts from them: reducers beside principal components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from axonframe.operators.cluster import pca_scores
from axonframe.operators.moments import matrix, sound
from axonframe.sources.recordings import settled

#: Rows that are compared with each other in one go where a projection is sorted.
BLOCK = 512
#: Rows of a part that is compared whole with another part, and rows of it at a time.
PART, TILE = 8192, 512
#: New neighbours that each member of a neighbourhood is offered in a round.
OFFERED = 6


def _best(edges: DataFrame, k: int) -> DataFrame:
    """(a, b, d): the k nearest others of each a, the smaller id of those that tie."""
    best = edges.groupBy("a", "b").agg(F.min("d").alias("d")).groupBy("a").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "b"))), 1, k).alias("n"))
    return best.select("a", F.explode("n").alias("n")).select("a", "n.b", "n.d")


def _near(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, other, distance): the k nearest other rows of each row, exactly."""
    square = (x * x).sum(1)
    far = np.maximum(square[:, None] + square[None, :] - 2 * x @ x.T, 0)
    np.fill_diagonal(far, np.inf)
    k = min(k, len(x) - 1)
    other = np.argsort(far, axis=1, kind="stable")[:, :k]
    row = np.repeat(np.arange(len(x)), k)
    return row, other.ravel(), np.sqrt(((x[row] - x[other.ravel()]) ** 2).sum(1))


def _along(points: DataFrame, k: int, seed: int, schema: T.StructType, block: int) -> DataFrame:
    """Edges between points that stand in one block when all are sorted along a random direction. Each partition is a range."""
    d = points.select(F.size("x")).first()[0]
    way = np.random.default_rng(seed).standard_normal(d)
    place = F.aggregate(F.zip_with("x", F.array(*[F.lit(float(v)) for v in way]), lambda v, w: v * w), F.lit(0.0), lambda a, v: a + v)
    parts = points.count() // (8 * block) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows = [], []

        def edges(whole: bool) -> Iterator[pa.RecordBatch]:
            while len(ids) >= 2 * block or whole and len(ids) > 1:  # the last block is not left small
                size = block if len(ids) >= 2 * block else len(ids)
                row, other, far = _near(np.stack(rows[:size]), k)
                own = pa.array(ids[:size], kind)
                yield pa.RecordBatch.from_arrays([own.take(pa.array(row)), own.take(pa.array(other)), pa.array(far)], names=["a", "b", "d"])
                step = size if size == len(ids) else size // 2  # blocks overlap by half
                del ids[:step], rows[:step]

        kind = None
        for batch in batches:
            kind = batch.schema.field("id").type
            ids += batch.column("id").to_pylist()
            rows += list(matrix(batch.column("x")))
            yield from edges(False)
        if ids:
            yield from edges(True)

    return points.withColumn("place", place).repartitionByRange(parts, "place").sortWithinPartitions("place", "id").select("id", "x").mapInArrow(run, schema)


def neighbour_graph(rows: DataFrame, id_column: str, x: str = "x", k: int = 15, rounds: int = 8, ways: int = 3, enough: float = 0.002, block: int = BLOCK) -> DataFrame:
    """(a, b, d): for each row about its k nearest others and their distances.

    Sorting along some random directions gives the first neighbours. Then, in each round, every row introduces its neighbours,
    and some of the rows it is a neighbour of, to each other; a round that changes fewer than `enough` of all neighbours is the
    last. Rows that many others have as a neighbour take a sample of these, so no group is large. Tables of one block are exact.
    Arrays that are null or hold a null or no number, and null ids, have no neighbours; ids are one row each, and equal rows
    are neighbours at distance 0. Each round ends in a checkpoint."""
    points = settled(rows.where(F.col(id_column).isNotNull() & sound(x)).select(F.col(id_column).alias("id"), F.transform(x, lambda v: v.cast("double")).alias("x")).dropDuplicates(["id"]))
    schema = T.StructType([T.StructField("a", points.schema["id"].dataType), T.StructField("b", points.schema["id"].dataType), T.StructField("d", T.DoubleType())])
    n = points.count()
    if n < 2:
        return points.sparkSession.createDataFrame([], schema)
    graph = _along(points, k, 0, schema, block)
    if n < 2 * block:
        return settled(_best(graph, k))
    for seed in range(1, ways):
        graph = graph.union(_along(points, k, seed, schema, block))
    graph = settled(_best(graph, k))
    own = T.StructType([*schema.fields])

    def introduced(group: pa.Table) -> pa.Table:
        at = group["member"].combine_chunks()
        row, other, far = _near(matrix(group["x"]), OFFERED)
        return pa.table({"a": at.take(pa.array(row)), "b": at.take(pa.array(other)), "d": pa.array(far)})

    for turn in range(rounds):
        popular = graph.groupBy("b").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / k)).alias("every"))
        back = graph.join(popular, "b").where(F.pmod(F.xxhash64("a", "b", F.lit(turn)), F.col("every")) == 0).select(F.col("b").alias("host"), F.col("a").alias("member"))
        members = graph.select(F.col("a").alias("host"), F.col("b").alias("member")).union(back).distinct()
        met = members.join(points.withColumnRenamed("id", "member"), "member").groupBy("host").applyInArrow(introduced, own)
        found = settled(_best(graph.union(met), k))
        new = found.join(graph.select("a", "b"), ["a", "b"], "left_anti").count()
        graph = found
        if new < enough * k * n:
            break
    return graph


def _nearest(x: np.ndarray, y: np.ndarray, names: np.ndarray, k: int, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, row of y, distance): the k nearest rows of y for each of x, by their names where distances tie; if both are the
    same rows, none is its own neighbour. Inner products choose, with room for their rounding, and differences decide."""
    k = min(k, len(y) - same)
    squares, found = (y * y).sum(1), []
    for first in range(0, len(x) if k > 0 else 0, TILE):
        tile = x[first : first + TILE]
        own = (tile * tile).sum(1)
        far = own[:, None] + squares[None, :] - 2 * tile @ y.T
        if same:
            far[np.arange(len(tile)), first + np.arange(len(tile))] = np.inf
        spare = 4 * (x.shape[1] + 4) * np.finfo(float).eps * (own + squares.max())
        row, other = np.nonzero(far <= (np.partition(far, k - 1, axis=1)[:, k - 1] + spare)[:, None])
        if same:
            row, other = row[other != first + row], other[other != first + row]
        d = np.concatenate([np.sqrt(((tile[row[i : i + 65_536]] - y[other[i : i + 65_536]]) ** 2).sum(1)) for i in range(0, len(row), 65_536)])
        order = np.lexsort((names[other], d, row))
        row, other, d = row[order], other[order], d[order]
        kept = np.arange(len(row)) - np.searchsorted(row, row) < k
        found.append((first + row[kept], other[kept], d[kept]))
    if not found:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def exact_graph(rows: DataFrame, id_column: str, x: str = "x", k: int = 15, part: int = PART) -> DataFrame:
    """(a, b, d): the k nearest others of each row and their distances, exactly, the smaller id of those that tie.

    Rows are dealt into parts by hash, and each pair of parts is a group, in which the rows of either meet those of the other; each row's
    k of every part are then merged. Work grows with the square of the rows and is shared by all tasks, a group holds two
    parts. Rows are left out, and ids taken, as `neighbour_graph` does."""
    points = settled(rows.where(F.col(id_column).isNotNull() & sound(x)).select(F.col(id_column).alias("id"), F.transform(x, lambda v: v.cast("double")).alias("x")).dropDuplicates(["id"]))
    kind = points.schema["id"].dataType
    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind), T.StructField("d", T.DoubleType())])
    parts = points.count() // part + 1
    own = points.withColumn("own", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))
    met = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    met = met.select(F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "id", "x")

    def compared(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        ids, data, side = group["id"].combine_chunks(), matrix(group["x"]), group["own"].to_numpy()
        names = ids.to_numpy(zero_copy_only=False)
        low, high = (np.flatnonzero(side == group[c][0].as_py()) for c in ("low", "high"))
        same = group["low"][0].as_py() == group["high"][0].as_py()
        ways, out = [(low, low)] if same else [(low, high), (high, low)], []
        for a, b in ways:
            row, other, d = _nearest(data[a], data[b], names[b], k, same)
            out.append(pa.table({"a": ids.take(pa.array(a[row])), "b": ids.take(pa.array(b[other])), "d": pa.array(d)}))
        return pa.concat_tables(out)

    # a task a pair of parts, as these take seconds each
    edges = met.repartition(min(4096, parts * (parts + 1) // 2), "low", "high").groupBy("low", "high").applyInArrow(compared, schema)
    best = edges.groupBy("a").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "b"))), 1, k).alias("n"))  # k a part
    return best.select("a", F.explode("n").alias("n")).select("a", "n.b", "n.d")


def layout(graph: DataFrame, dimensions: int = 2, steps: int = 16) -> DataFrame:
    """(id, at): a place for each node of a neighbour graph (a, b, d), near places for rows that are joined by near neighbours.

    Edges weigh exp(-d ** 2 / (s_a * s_b)), s the distance of a node's farthest neighbour. The places are the leading vectors of
    the normalised weights after the first, by subspace iteration: each step is a join and a sum over edges, and only the
    inner products of the vectors, a small matrix, reach the driver to keep them apart. Signs are arbitrary."""
    reach = graph.groupBy("a").agg(F.greatest(F.max("d"), F.lit(1e-12)).alias("s"))
    weights = graph.join(reach, "a").join(reach.select(F.col("a").alias("b"), F.col("s").alias("t")), "b").select("a", "b", F.exp(-F.col("d") * F.col("d") / (F.col("s") * F.col("t"))).alias("w"))
    both = weights.union(weights.select("b", "a", "w")).groupBy("a", "b").agg(F.max("w").alias("w"))
    degree = both.groupBy("a").agg(F.sqrt(F.sum("w")).alias("g"))
    edges = both.join(degree, "a").join(degree.select(F.col("a").alias("b"), F.col("g").alias("h")), "b")
    edges = settled(edges.select("a", "b", (F.col("w") / (F.col("g") * F.col("h"))).alias("w")))
    if edges.isEmpty():
        return edges.select(F.col("a").alias("id"), F.array().cast("array<double>").alias("at"))
    q = dimensions + 1
    rest = [(F.xxhash64("a", F.lit(j)) / 2.0**63).alias(f"v{j}") for j in range(1, q)]
    now = settled(degree.select(F.col("a").alias("id"), F.col("g").alias("v0"), *rest))
    for _ in range(steps):
        sums = edges.join(now.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(*[F.sum(F.col("w") * F.col(f"v{j}")).alias(f"s{j}") for j in range(q)])
        moved = settled(now.join(sums, "id").select("id", *[((F.col(f"v{j}") + F.col(f"s{j}")) / 2).alias(f"v{j}") for j in range(q)]))  # kept positive by half of itself
        inner = moved.agg(*[F.sum(F.col(f"v{i}") * F.col(f"v{j}")).alias(f"p{i}_{j}") for i in range(q) for j in range(i, q)]).first()
        gram = np.array([[inner[f"p{min(i, j)}_{max(i, j)}"] for j in range(q)] for i in range(q)])
        apart = np.linalg.inv(np.linalg.cholesky(gram + 1e-14 * np.trace(gram) * np.eye(q)))
        now = moved.select("id", *[sum((F.lit(float(apart[i, j])) * F.col(f"v{j}") for j in range(i + 1)), F.lit(0.0)).alias(f"v{i}") for i in range(q)])
    return settled(now.select("id", F.array(*[f"v{j}" for j in range(1, q)]).alias("at")))


def reduced(spikes: DataFrame, reducer: str = "pca", dimensions: int = 3, column: str = "w", id_column: str = "spike_id", **options) -> DataFrame:
    """spikes with `at`: their scores on principal components (`pca`), or their places in a layout of the neighbour graph
    (`neighbours`, with options of `neighbour_graph`). Spikes without neighbours have a null place."""
    if reducer == "pca":
        return pca_scores(spikes, dimensions, column).withColumnRenamed("pcs", "at")
    if reducer != "neighbours":
        raise ValueError(f"a reducer is pca or neighbours, not {reducer}")
    places = layout(neighbour_graph(spikes, id_column, column, **options), dimensions)
    return spikes.join(places.withColumnRenamed("id", id_column), id_column, "left")
