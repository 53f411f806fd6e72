"""Moments and principal components of many groups at once, and rows meeting the model of their group, for groups of any size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from axonframe.functions.ranks import _same

#: Numbers that a task holds in partial sums before it passes them on (512 MB of doubles at most).
HELD = 1 << 26
#: Models up to this size together (as JSON text) are broadcast; beyond it, rows and models are dealt by group.
BROADCAST_BYTES = 64_000_000
#: Rows of a group that meet its model in one task where rows and models are dealt.
PART = 100_000


def grouped_rows(batch: pa.RecordBatch, keys: list[str]) -> Iterator[tuple[tuple, np.ndarray]]:
    """(key, places) of each group of a batch; nulls are a key of their own."""
    code = np.zeros(batch.num_rows, np.int64)
    for k in keys:
        own = pc.dictionary_encode(batch.column(k), null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
        code = np.unique(code * (own.max(initial=0) + 1) + own, return_inverse=True)[1]
    order = np.argsort(code, kind="stable")
    ends = np.flatnonzero(np.diff(code[order], prepend=-1, append=-1))
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        yield tuple(batch.column(k)[int(order[a])].as_py() for k in keys), order[a:b]


def matrix(column: pa.Array, places: np.ndarray | None = None) -> np.ndarray:
    """Arrays of one length as rows of a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column if places is None else column.take(pa.array(places))
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def sound(x: str) -> F.Column:
    """Whether an array has elements, all of them numbers."""
    return F.coalesce(F.size(x) > 0, F.lit(False)) & F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))


def _joined(a: tuple, b: tuple) -> tuple:
    """(n, mean, m2) of two sets of rows together."""
    n, gap = a[0] + b[0], b[1] - a[1]
    return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)


def grouped_moments(rows: DataFrame, keys: list[str], x: str = "x") -> DataFrame:
    """(keys, n, mean, m2) of each group: the number, the mean and the sums of products about the mean (all of a d by d matrix in a
    row) of the arrays in x, which are of one length within a group.

    Each task adds up its rows of all groups, and partial sums are joined twice, first within 32 parts of the tasks. Arrays that
    are null, empty or hold a null or no number are left out. One pass, whatever the number of groups."""
    schema = T.StructType([*[rows.schema[k] for k in keys], *T._parse_datatype_string("n long, mean array<double>, m2 array<double>").fields])
    types = {k: None for k in keys}

    def passed(held: dict, types: dict) -> pa.RecordBatch:
        columns = [pa.array([key[i] for key in held], types[k]) for i, k in enumerate(keys)]
        n, mean, m2 = ([v[i] for v in held.values()] for i in range(3))
        columns += [pa.array(n, pa.int64()), pa.array([m.tolist() for m in mean], pa.list_(pa.float64())), pa.array([m.ravel().tolist() for m in m2], pa.list_(pa.float64()))]
        return pa.RecordBatch.from_arrays(columns, names=[*keys, "n", "mean", "m2"])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        kinds = dict(types)
        for batch in batches:
            kinds.update({k: batch.schema.field(k).type for k in keys})
            for key, places in grouped_rows(batch, keys):
                data = matrix(batch.column(x), places)
                mean = data.mean(0)
                own = len(data), mean, (data - mean).T @ (data - mean)
                held[key] = _joined(held[key], own) if key in held else own
            if held and len(held) * next(iter(held.values()))[2].size > HELD:
                yield passed(held, kinds)
                held = {}
        if held:
            yield passed(held, kinds)

    def joined(group: pa.Table) -> pa.Table:
        d = len(group["mean"][0])
        total = None
        for n, mean, m2 in zip(group["n"].to_pylist(), matrix(group["mean"]), matrix(group["m2"]), strict=True):
            own = n, mean, m2.reshape(d, d)
            total = own if total is None else _joined(total, own)
        found = group.slice(0, 1).select(keys).append_column("n", pa.array([total[0]], pa.int64()))
        found = found.append_column("mean", pa.array([total[1].tolist()], pa.list_(pa.float64())))
        return found.append_column("m2", pa.array([total[2].ravel().tolist()], pa.list_(pa.float64())))

    parts = rows.where(sound(x)).select(*keys, F.transform(x, lambda v: v.cast("double")).alias(x)).mapInArrow(partial, schema)
    some = parts.withColumn("part", F.spark_partition_id() % 32).groupBy(*keys, "part").applyInArrow(joined, schema)
    return some.groupBy(*keys).applyInArrow(joined, schema)


def components(rows: DataFrame, keys: list[str], x: str = "x") -> DataFrame:
    """(keys, n, mean, axes, ratios) of each group: its principal components, the one of the largest variance first, and their shares
    of the variance. axes has an array a component, of unit length, its element of largest size positive.

    A group without any variance has null ratios. All groups in one job; see `grouped_moments`."""
    moments = grouped_moments(rows, keys, x)
    schema = T.StructType([*[moments.schema[k] for k in keys], *T._parse_datatype_string("n long, mean array<double>, axes array<array<double>>, ratios array<double>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            axes, ratios = [], []
            for m2 in batch.column("m2"):
                flat = np.array(m2.as_py())
                d = int(round(len(flat) ** 0.5))
                variance, vectors = np.linalg.eigh(flat.reshape(d, d))
                variance, vectors = np.maximum(variance[::-1], 0), vectors[:, ::-1].T
                vectors = vectors * np.sign(vectors[np.arange(d), np.abs(vectors).argmax(1)])[:, None]
                axes.append(vectors.tolist())
                ratios.append((variance / variance.sum()).tolist() if variance.sum() > 0 else None)
            columns = [batch.column(k) for k in [*keys, "n", "mean"]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(axes, pa.list_(pa.list_(pa.float64()))), pa.array(ratios, pa.list_(pa.float64()))], names=[*keys, "n", "mean", "axes", "ratios"])

    return moments.mapInArrow(run, schema)


def with_models(rows: DataFrame, models: DataFrame, keys: list[str], run: Callable, schema: T.StructType, most_bytes: int = BROADCAST_BYTES, part: int = PART) -> DataFrame:
    """run(batch, model) over rows of one group at a time, where model is the group's row of models as a dict, None without one.

    models has one row a group. Up to most_bytes of them are broadcast and rows stay where they are; beyond that rows and models
    are dealt by group, groups of more than `part` rows in several parts. A row's place deals it, so give stored rows."""
    if (models.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0) <= most_bytes:
        known = {tuple(r[k] for k in keys): r.asDict(recursive=True) for r in models.collect()}
        shared = rows.sparkSession.sparkContext.broadcast(known)

        def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for key, places in grouped_rows(batch, keys):
                    yield run(batch.take(pa.array(places)), shared.value.get(key))

        return rows.mapInArrow(over, schema)

    sizes = rows.groupBy(*keys).agg(F.ceil(F.count("*") / part).alias("__parts"))
    dealt = _same(rows.withColumn("__id", F.monotonically_increasing_id()), sizes, keys).withColumn("__part", F.pmod("__id", "__parts"))
    copies = _same(models, sizes, keys).withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__parts") - 1)))
    names = rows.columns

    def met(own: pa.Table, model: pa.Table) -> pa.Table:
        if not own.num_rows:
            return pa.table({f.name: [] for f in schema.fields})
        batches = own.select(names).combine_chunks().to_batches()
        found = model.slice(0, 1).to_pylist()[0] if model.num_rows else None
        return pa.Table.from_batches([run(batch, found) for batch in batches])

    by = [*keys, "__part"]
    return dealt.drop("__id", "__parts").groupBy(*by).cogroup(copies.drop("__parts").groupBy(*by)).applyInArrow(met, schema)


def projected(rows: DataFrame, models: DataFrame, keys: list[str], x: str = "x", out: str = "pcs") -> DataFrame:
    """rows with `out`: the scores of the arrays in x on the components of their group (keys, mean, axes and, if models has it, n_pc,
    how many to keep). Null without a model or with an array that is not sound."""
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))])

    def run(batch: pa.RecordBatch, model: dict | None) -> pa.RecordBatch:
        found: list = [None] * batch.num_rows
        if model:
            mean, axes = np.array(model["mean"]), np.array(model["axes"])[: model.get("n_pc")]
            for i, value in enumerate(batch.column(x).to_pylist()):
                if value is not None and len(value) == len(mean) and all(v is not None and np.isfinite(v) for v in value):
                    found[i] = value
            fine = [i for i, v in enumerate(found) if v is not None]
            if fine:
                for i, score in zip(fine, ((np.array([found[i] for i in fine], float) - mean) @ axes.T).tolist(), strict=True):
                    found[i] = score
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.float64()))], names=[*batch.schema.names, out])

    return with_models(rows, models, keys, run, schema)
