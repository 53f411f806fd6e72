"""Gaussian mixtures of all channels, cluster counts and seeds: expectation-maximisation in groups, or by one job a step."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from axonframe.functions.ranks import _same
from axonframe.operators.moments import HELD, grouped_rows, matrix, sound, with_models
from axonframe.sources.recordings import settled

#: Distinct rows of a channel, first by hash, from which a fit's first means come.
START_ROWS = 4096
#: Rows of the largest channel whose fits run within one group; larger ones are fitted by a Spark job a step for all of them.
GROUP_ROWS = 1_000_000
#: Rows of a block of a large channel, and rows that one step takes at once.
BLOCK_ROWS, CHUNK = 8192, 4096
FIT = "k int, seed int, n long, converged boolean, log_likelihood double, bic double, weights array<double>, means array<array<double>>, covs array<array<array<double>>>"


def bic(log_likelihood: float, n: int, k: int, d: int) -> float:
    """-2 lnL + p ln n with the p free numbers of a mixture of k full-covariance components in d dimensions."""
    p = k * d * (d + 1) / 2 + k * d + k - 1
    return -2 * log_likelihood + p * math.log(n)


def first_means(sample: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k rows of the sample, each after the first drawn by its squared distance to the ones before."""
    rng = np.random.default_rng(seed)
    centres = [sample[rng.integers(len(sample))]]
    for _ in range(1, k):
        gap = np.min([((sample - c) ** 2).sum(1) for c in centres], axis=0)
        centres.append(sample[rng.choice(len(sample), p=gap / gap.sum())] if gap.sum() > 0 else sample[rng.integers(len(sample))])
    return np.array(centres)


def expanded(x: np.ndarray) -> np.ndarray:
    """A column of ones, the columns, and the products of each two."""
    i, j = np.triu_indices(x.shape[1])
    return np.concatenate([np.ones((len(x), 1)), x, x[:, i] * x[:, j]], axis=1)


def log_densities(x: np.ndarray, model: tuple) -> np.ndarray:
    """The log of weight times density at each row (first axis) of the components of several mixtures (weights, means, covs),
    whose first axis is the mixture and whose second the component."""
    weights, means, covs = model
    fits, k, d = means.shape
    root = np.linalg.cholesky(covs)
    inverse = np.linalg.inv(root)
    flat = inverse.reshape(-1, d)
    off = (inverse @ means[..., None]).ravel()
    gap = ((x @ flat.T - off) ** 2).reshape(len(x), fits, k, d).sum(3)
    height = np.log(weights) - np.log(np.diagonal(root, axis1=2, axis2=3)).sum(2) - d * np.log(2 * np.pi) / 2
    return height - gap / 2


def moment_sums(x: np.ndarray, model: tuple | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What rows add to a step of several mixtures: the log-likelihood of each, and each component's sums of `expanded` rows. A
    model of means alone shares rows out to the nearest."""
    fits, k, d = (model[1] if isinstance(model, tuple) else model).shape
    total, sums = np.zeros(fits), np.zeros((fits * k, 1 + d + d * (d + 1) // 2))
    for at in range(0, len(x), CHUNK):
        part = x[at : at + CHUNK]
        if isinstance(model, tuple):
            logs = log_densities(part, model)
            top = logs.max(2)
            share = np.exp(logs - top[..., None])
            each = share.sum(2)
            total += (top + np.log(each)).sum(0)
            share /= each[..., None]
        else:
            nearest = np.argmin(((part[:, None, None, :] - model) ** 2).sum(3), axis=2)
            share = (nearest[..., None] == np.arange(k)).astype(float)
        sums += share.reshape(len(part), -1).T @ expanded(part)
    return total, sums.reshape(fits, k, -1)


def next_model(sums: np.ndarray, d: int, ridge: float = 1e-6) -> tuple:
    """(weights, means, covs) of several mixtures from the sums of all rows."""
    weight = sums[..., 0] + 1e-12
    means = sums[..., 1 : 1 + d] / weight[..., None]
    i, j = np.triu_indices(d)
    covs = np.empty((*weight.shape, d, d))
    covs[..., i, j] = covs[..., j, i] = sums[..., 1 + d :] / weight[..., None]
    covs -= means[..., :, None] * means[..., None, :]
    return weight / weight.sum(-1, keepdims=True), means, covs + ridge * np.eye(d)


def fits_of(x: np.ndarray, starts: np.ndarray, tol: float, most: int) -> list[tuple]:
    """(model, log-likelihood, converged) for each of several first means (fit, component, column): expectation-maximisation until
    the mean log-likelihood changes by less than tol, or for so many steps. Fits that are done take no part in further steps."""
    n, d = x.shape
    moving, before = np.arange(len(starts)), np.full(len(starts), -np.inf)
    model, out = next_model(moment_sums(x, starts)[1], d), {}
    for turn in range(most + 1):
        total, sums = moment_sums(x, model)
        done = np.abs(total / n - before) < tol
        for i in range(len(moving)):
            if done[i] or turn == most:
                out[moving[i]] = tuple(p[i] for p in model), float(total[i]), bool(done[i])
        if done.all():
            break
        moving, before = moving[~done], total[~done] / n
        model = next_model(sums[~done], d)
    return [out[i] for i in range(len(starts))]


def _row(k: int, seed: int, n: int, found: tuple, centre: np.ndarray) -> tuple:
    (weights, means, covs), log_likelihood, converged = found
    return k, seed, n, converged, log_likelihood, bic(log_likelihood, n, k, len(centre)), weights.tolist(), (means + centre).tolist(), covs.tolist()


def mixtures(rows: DataFrame, channel: str, columns: list[str] | str, least: int = 2, most: int = 7, restarts: int = 10, tol: float = 1e-4, steps: int = 1000, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(channel, k, seed, n, converged, log_likelihood, bic, weights, means, covs): a mixture for each channel, cluster count and seed.

    The columns are named one by one or are an array's, whose length may differ between channels. Channels of up to
    group_rows rows are fitted in groups, one for each channel and count, all seeds at once. All larger ones take a step of all
    their fits in each job; rows are packed into blocks once, and no model or moment reaches the driver. Both ways take the same
    steps. Rows with a null or no number are left out; a channel of fewer rows than k has no such fit. The input is read once.
    """
    kind = rows.schema[channel].dataType
    schema = T.StructType([T.StructField("channel", kind), *T._parse_datatype_string(FIT).fields])
    x = F.col(columns) if isinstance(columns, str) else F.array(*[F.col(c).cast("double") for c in columns])
    x = rows.select(F.col(channel).alias("channel"), x.alias("x")).where(sound("x"))
    x = settled(x.withColumn("h", F.xxhash64("x")))
    sizes = x.groupBy("channel").agg(F.count("*").alias("n"), F.approx_count_distinct("h").alias("kinds"))
    large = settled(sizes.where(F.col("n") > group_rows))
    found = None
    if not large.isEmpty():
        big = _same(x, large.select("channel"), ["channel"], "left_semi")
        found = _large_fits(big, large, schema, least, most, restarts, tol, steps)
        x = _same(x, large.select("channel"), ["channel"], "left_anti")

    def fit(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        k = int(key[1])
        group = group.sort_values("h", kind="stable")
        data = np.stack(group["x"].to_numpy())
        n, centre = len(data), np.sort(data, axis=0).mean(0)
        data = data - centre  # in the order of hashes, whatever the order of arrival
        if n < k:
            return pd.DataFrame([], columns=schema.names)
        sample = data[np.unique(group["h"].to_numpy(), return_index=True)[1][:START_ROWS]]
        fits = fits_of(data, np.stack([first_means(sample, k, seed) for seed in range(restarts)]), tol, steps)
        return pd.DataFrame([(key[0], *_row(k, seed, n, fits[seed], centre)) for seed in range(restarts)], columns=schema.names)

    counts = x.withColumn("k", F.explode(F.sequence(F.lit(least), F.lit(most))))
    fits = counts.groupBy("channel", "k").applyInPandas(fit, schema)
    return fits if found is None else fits.union(found)


def _blocks(x: DataFrame) -> DataFrame:
    """(channel, data): the rows of large channels as blocks of doubles; rows do not move."""
    schema = T.StructType([x.schema["channel"], T.StructField("data", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        kind = None
        for batch in batches:
            kind = batch.schema.field("channel").type
            for (name,), places in grouped_rows(batch, ["channel"]):
                held.setdefault(name, []).append(matrix(batch.column("x"), places))
            full = [c for c, parts in held.items() if sum(map(len, parts)) >= BLOCK_ROWS]
            for name in full or (list(held) if sum(p.size for parts in held.values() for p in parts) > HELD else []):
                yield pa.RecordBatch.from_arrays([pa.array([name], kind), pa.array([np.concatenate(held.pop(name)).tobytes()], pa.binary())], names=["channel", "data"])
        for name, parts in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([name], kind), pa.array([np.concatenate(parts).tobytes()], pa.binary())], names=["channel", "data"])

    return x.select("channel", "x").mapInArrow(run, schema)


def _packed(model: tuple | np.ndarray) -> bytes:
    return np.concatenate([np.ravel(p) for p in model]).tobytes() if isinstance(model, tuple) else np.ravel(model).tobytes()


def _unpacked(models: list[bytes], k: int, d: int) -> tuple | np.ndarray:
    """Several models of one shape; a model that is means alone is shorter."""
    flat = np.stack([np.frombuffer(m) for m in models])
    if flat.shape[1] == k * d:
        return flat.reshape(-1, k, d)
    cut = k, k + k * d
    return flat[:, : cut[0]], flat[:, cut[0] : cut[1]].reshape(-1, k, d), flat[:, cut[1] :].reshape(-1, k, d, d)


_STATE = "k int, seed int, n long, centre array<double>, model binary, before double, converged boolean, log_likelihood double"


def _starts(x: DataFrame, large: DataFrame, least: int, most: int, restarts: int) -> DataFrame:
    """The first means of all fits of the large channels, about the channel's centre; before is null at the start."""
    middle = x.select("channel", F.posexplode("x").alias("i", "v")).groupBy("channel", "i").agg(F.avg("v").alias("v"))
    middle = middle.groupBy("channel").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("c")).select("channel", F.col("c.v").alias("centre"))
    known = settled(_same(large, middle, ["channel"]))
    some = _same(x, known, ["channel"]).where(F.col("h") / 2.0**64 + 0.5 < 4.0 * START_ROWS / F.col("kinds")).select("channel", "n", "centre", "x", "h").distinct()
    schema = T.StructType([x.schema["channel"], *T._parse_datatype_string(_STATE).fields])

    def draw(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("h", kind="stable")[:START_ROWS]
        centre = np.array(group["centre"].iloc[0], float)
        sample = np.stack(group["x"].to_numpy()) - centre
        grid = [(k, seed) for k in range(least, most + 1) for seed in range(restarts)]
        rows = [(group["channel"].iloc[0], k, seed, int(group["n"].iloc[0]), centre.tolist(), _packed(first_means(sample, k, seed)), None, None, None) for k, seed in grid]
        return pd.DataFrame(rows, columns=schema.names)

    return some.groupBy("channel").applyInPandas(draw, schema)


def _large_fits(x: DataFrame, large: DataFrame, schema: T.StructType, least: int, most: int, restarts: int, tol: float, steps: int) -> DataFrame:
    """The fits of all channels in large (channel, n, kinds): each job takes a step of all fits that still move.

    Blocks of rows meet their channel's moving fits, as one row, by a join; each task adds up the moments of its blocks, and the
    sums of a fit meet its model in a group of one row a task. Models and moments are tables throughout."""
    blocks = settled(_blocks(x))
    fits = settled(_starts(x, large, least, most, restarts))
    name = fits.schema["channel"]
    sums = T.StructType([name, *T._parse_datatype_string("k int, seed int, part double, sums array<double>").fields])
    by = ["channel", "k", "seed"]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            for channel, centre, data, moving in zip(*(batch.column(c).to_pylist() for c in ("channel", "centre", "data", "fits")), strict=True):
                rows = np.frombuffer(data).reshape(-1, len(centre)) - np.array(centre)
                shapes: dict = {}
                for f in moving:
                    shapes.setdefault((f["k"], len(f["model"])), []).append(f)
                for (k, _), same in shapes.items():
                    total, found = moment_sums(rows, _unpacked([f["model"] for f in same], k, len(centre)))
                    for i, f in enumerate(same):
                        key = channel, k, f["seed"]
                        old = held.get(key, (0.0, 0.0))
                        held[key] = old[0] + total[i], old[1] + found[i]
        if held:
            keys = [pa.array([key[i] for key in held], t) for i, t in enumerate((batch.schema.field("channel").type, pa.int32(), pa.int32()))]
            values = [pa.array([float(v[0]) for v in held.values()]), pa.array([v[1].ravel().tolist() for v in held.values()], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*keys, *values], names=sums.names)

    def step(state: pa.Table, parts: pa.Table) -> pa.Table:
        row = state.to_pylist()[0]
        if row["converged"] is not None:
            return state
        k, d, n = row["k"], len(row["centre"]), row["n"]
        total = float(np.sum(parts["part"].to_numpy()))
        started = len(row["model"]) > 8 * k * d
        if started and row["before"] is not None and abs(total / n - row["before"]) < tol:
            row |= {"converged": True, "log_likelihood": total}
        else:
            found = matrix(parts["sums"]).sum(0).reshape(1, k, -1)
            row |= {"model": _packed(tuple(p[0] for p in next_model(found, d))), "before": total / n if started else None, "log_likelihood": total}
        return pa.Table.from_pylist([row], schema=state.schema)

    def closed(state: pa.Table, parts: pa.Table) -> pa.Table:
        row = state.to_pylist()[0]
        if row["converged"] is not None:
            return state
        total = float(np.sum(parts["part"].to_numpy()))
        done = row["before"] is not None and abs(total / row["n"] - row["before"]) < tol
        return pa.Table.from_pylist([row | {"converged": done, "log_likelihood": total}], schema=state.schema)

    for turn in range(steps + 2):
        moving = fits.where("converged is null")
        packed = moving.groupBy("channel").agg(F.first("centre").alias("centre"), F.collect_list(F.struct("k", "seed", "model")).alias("fits"))
        parts = _same(blocks, packed, ["channel"]).mapInArrow(add, sums)
        fits = settled(fits.groupBy(*by).cogroup(parts.groupBy(*by)).applyInArrow(closed if turn > steps else step, fits.schema))
        if fits.where("converged is null").isEmpty():
            break

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                model = _unpacked([r.model], r.k, len(r.centre))
                out.append((r.channel, *_row(r.k, r.seed, r.n, (tuple(p[0] for p in model), r.log_likelihood, r.converged), np.array(r.centre))))
            yield pd.DataFrame(out, columns=schema.names)

    return fits.mapInPandas(rows, schema)


def labelled(rows: DataFrame, models: DataFrame, columns: list[str] | str, channel: str = "channel", keys: list[str] | None = None, out: str = "cluster") -> DataFrame:
    """rows with `out` (from 0), the component of the greatest posterior under the model of their channel, and `log_density`.

    models has one row a channel (channel, weights, means, covs), or one for each value of `keys`, which rows have too. Rows
    without a model or with a null or no number get null. Rows and models meet as `with_models` says."""
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.IntegerType()), T.StructField("log_density", T.DoubleType())])
    keys = keys or [channel]
    one = models.withColumnRenamed("channel", channel) if channel not in models.columns else models
    one = one.select(*keys, "weights", "means", "covs")

    def run(batch: pa.RecordBatch, model: dict | None) -> pa.RecordBatch:
        cluster, dense = [None] * batch.num_rows, [None] * batch.num_rows
        if model:
            d = len(model["means"][0])
            if isinstance(columns, str):
                values = [v if v is not None and len(v) == d else [None] * d for v in batch.column(columns).to_pylist()]
                x = np.array([[np.nan if y is None else y for y in v] for v in values], float).reshape(-1, d)
            else:
                x = np.column_stack([batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in columns]).astype(float)
            fine = np.flatnonzero(np.isfinite(x).all(1))
            packed = tuple(np.array(model[p], float)[None] for p in ("weights", "means", "covs"))
            for at in range(0, len(fine), CHUNK):
                logs = log_densities(x[fine[at : at + CHUNK]], packed)[:, 0]
                for i, c, t in zip(fine[at : at + CHUNK].tolist(), logs.argmax(1).tolist(), np.logaddexp.reduce(logs, axis=1).tolist(), strict=True):
                    cluster[i], dense[i] = c, t
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(cluster, pa.int32()), pa.array(dense, pa.float64())], names=[*batch.schema.names, out, "log_density"])

    return with_models(rows, one, keys, run, schema)


def chosen_models(fits: DataFrame) -> DataFrame:
    """(channel, k, seed, bic, weights, means, covs): of each channel's converged fits the one with the least BIC, the first of equals."""
    return _best(fits, ["channel"], ["bic", "k", "seed"])


def solution_models(fits: DataFrame) -> DataFrame:
    """As `chosen_models`, one for each channel and cluster count."""
    return _best(fits, ["channel", "k"], ["bic", "seed"])


def _best(fits: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    model = F.struct("k", "seed", "bic", "weights", "means", "covs")
    best = fits.where("converged").groupBy(*by).agg(F.min_by(model, F.struct(*order)).alias("m"))
    return best.select("channel", "m.*")
