"""Embedding near-dedup by sorted projection passes.

In each pass, vectors are ordered by label and the first bits of random projections. Vectors that share these bits are a
run, and a run is compared whole, however many vectors it holds: short runs together, longer ones block against block. So
a linked pair is missed only if its bits differ in every pass, which depends on its angle alone and not on how the vectors
lie. The number of bits is the cheapest one by the measured lengths of the runs, and the number of passes follows from it.
Pairs found in all passes are joined into components. Since linked vectors share a component, a last step compares all
pairs within the components found, block by block, which counts each vector's links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, saved

COSINE = 0.93
#: Rows of a block of a run. Labels of at most that many rows are compared whole, in one pass.
WINDOW = 2048
#: Bits of a key; the first ones make the runs.
BITS = 62
#: Bits of a run that are weighed against each other.
CHOICES = range(0, 41, 4)
#: What a row costs in a pass, in comparisons.
ROW_COST = 4096
#: Share of linked pairs, at the least cosine, that all passes together may miss.
MISSED = 0.02
#: Rows of a block in the comparison within components.
BLOCK = 512


def passes_for(bits: int, cosine: float = COSINE, missed: float = MISSED) -> int:
    """Passes that let at most `missed` of the pairs at the least cosine go: a pair is compared if the first bits agree,
    each with probability 1 - angle / pi. Without bits, one pass compares all pairs."""
    agree = (1 - math.acos(cosine) / math.pi) ** bits
    return 1 if bits == 0 else max(4, math.ceil(math.log(missed) / math.log1p(-min(agree, 0.999))))


def bits_for(rows: DataFrame, cosine: float = COSINE, missed: float = MISSED) -> int:
    """The bits that cost least over all their passes, by the measured number of rows that share them. They change what a
    run costs and not what it may miss."""
    prefix = F.explode(F.array(*[F.struct(F.lit(b).alias("bits"), F.shiftright("key", BITS - b).alias("prefix")) for b in CHOICES]))
    runs = _keyed(rows, 0).select("label", prefix.alias("x")).groupBy("label", "x").agg(F.count("*").cast("double").alias("c"))
    costs = runs.groupBy(F.col("x.bits").alias("bits")).agg(F.sum(F.col("c") * (F.col("c") / 2 + ROW_COST)).alias("cost")).collect()
    return min(costs, key=lambda r: (passes_for(r.bits, cosine, missed) * r.cost, r.bits)).bits


def _clean(vectors: DataFrame, id_column: str, vector_column: str, label_column: str) -> DataFrame:
    """(id, label, v): rows that can link, with unit vectors of doubles."""
    v = F.transform(F.col(vector_column), lambda x: x.cast("double"))
    ok = F.col("label").isNotNull() & F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_column).alias("id"), F.col(label_column).alias("label"), v.alias("v")).where(ok)
    top = rows.withColumn("top", F.array_max(F.transform("v", F.abs))).where("top > 0")  # scaled first: squares neither overflow nor vanish
    scaled = top.select("id", "label", F.transform("v", lambda x: x / F.col("top")).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    return scaled.withColumn("norm", norm).select("id", "label", F.transform("v", lambda x: x / F.col("norm")).alias("v"))


def _keyed(rows: DataFrame, seed: int) -> DataFrame:
    """rows with `key`: the sign bits of BITS random projections, first ones first."""
    schema = T.StructType([*rows.schema.fields, T.StructField("key", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            key = np.zeros(batch.num_rows, np.int64)
            lists = batch["v"]
            size = np.diff(lists.offsets.to_numpy())
            for d in np.unique(size):
                if d not in planes:
                    planes[d] = np.random.default_rng([seed, int(d)]).standard_normal((d, BITS))
                at = np.flatnonzero(size == d)
                flat = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), d)
                key[at] = (flat @ planes[d] > 0) @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(key)], schema=pa.schema([*batch.schema, ("key", pa.int64())]))

    return rows.mapInArrow(run, schema)


def _near(a: pd.DataFrame, b: pd.DataFrame, cosine: float, step: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Places in a and b of pairs of one label and dimension with at least the cosine."""
    found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, int), np.zeros(0, int))]
    size_a, size_b = a["v"].map(len).to_numpy(), b["v"].map(len).to_numpy()
    label_a, label_b = a["label"].to_numpy(), b["label"].to_numpy()
    for d in np.intersect1d(size_a, size_b):
        i, j = np.flatnonzero(size_a == d), np.flatnonzero(size_b == d)
        one, other = np.stack(a["v"].to_numpy()[i]), np.stack(b["v"].to_numpy()[j]).T
        for k in range(0, len(i), step):
            x, y = np.nonzero(one[k : k + step] @ other >= cosine)
            same = label_a[i[x + k]] == label_b[j[y]]
            found.append((i[x[same] + k], j[y[same]]))
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def _first_reached(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of 0 .. n - 1, the smallest place that links (i, j) lead to."""
    now, before = np.arange(n), None
    while before is None or (now != before).any():
        before = now.copy()
        least = np.minimum(now[i], now[j])
        np.minimum.at(now, i, least)
        np.minimum.at(now, j, least)
        now = now[now]
    return now


def _pass(rows: DataFrame, seed: int, bits: int, window: int, cosine: float) -> DataFrame:
    """Pairs (a, b) that join what one pass links: in each comparison of two blocks every linked row is paired with one row
    that it reaches there, so a dense run gives as many pairs as rows and not as many as links."""
    runs = saved(_keyed(rows, seed).withColumn("run", F.xxhash64("label", F.shiftright("key", BITS - bits))).drop("key"))
    large = runs.groupBy("run").agg(F.count("*").alias("size")).where(F.col("size") > window)
    packs = max(1, -(-2 * runs.count() // window))
    cut = runs.join(large, "run", "left").withColumn("k", F.coalesce(F.ceil(F.col("size") / window), F.lit(1)).cast("long"))
    cut = cut.withColumn("cell", F.when(F.col("size").isNull(), F.pmod("run", F.lit(packs))).otherwise(F.col("run"))).withColumn("own", F.pmod(F.xxhash64("id"), F.col("k")))
    pairs = cut.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
    dealt = pairs.select("id", "v", "label", "cell", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        lo, hi = group["lo"].iloc[0], group["hi"].iloc[0]
        low = group[group["own"] == lo].reset_index(drop=True)
        high = low if lo == hi else group[group["own"] == hi].reset_index(drop=True)
        i, j = _near(low, high, cosine)
        ids = low["id"].to_numpy() if lo == hi else np.concatenate([low["id"].to_numpy(), high["id"].to_numpy()])
        reached = _first_reached(len(ids), i, j if lo == hi else j + len(low))
        apart = np.flatnonzero(reached != np.arange(len(ids)))
        return pd.DataFrame({"a": ids[reached[apart]], "b": ids[apart]})

    kind = rows.schema["id"].dataType
    return dealt.groupBy("cell", "lo", "hi").applyInPandas(compare, T.StructType([T.StructField("a", kind), T.StructField("b", kind)]))


def _found(rows: DataFrame, cosine: float, window: int, missed: float) -> DataFrame:
    """Pairs of all passes. Labels of up to a block are compared whole in one, which misses nothing."""
    large = rows.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") > window).select("label")
    large = saved(large)
    many = rows.join(large, "label", "left_semi")
    bits = 0 if large.isEmpty() else bits_for(many, cosine, missed)
    if bits == 0:
        return saved(_pass(rows, 0, 0, window, cosine))
    found = saved(_pass(rows.join(large, "label", "left_anti"), 0, 0, window, cosine))
    for k in range(passes_for(bits, cosine, missed)):
        found = found.union(saved(_pass(many, k, bits, window, cosine)))
    return found


def _counted(members: DataFrame, cosine: float) -> DataFrame:
    """(a, b, n_a, n_b) of the linked pairs within components: members (id, v, label, component, copies), cut into blocks by
    place in the component, each pair of blocks compared in a group of its own."""
    parts = members.groupBy("component").agg(F.count("*").alias("size"))
    cut = members.join(parts, "component").withColumn("k", F.ceil(F.col("size") / BLOCK)).withColumn("own", F.pmod(F.xxhash64("id"), F.col("k")))
    pairs = cut.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
    dealt = pairs.select("id", "v", "label", "copies", "component", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        low, high = (group[group["own"] == group[k].iloc[0]].reset_index(drop=True) for k in ("lo", "hi"))
        i, j = _near(low, high, cosine)
        differ = (low["id"].to_numpy()[i] != high["id"].to_numpy()[j]) if group["lo"].iloc[0] != group["hi"].iloc[0] else low["id"].to_numpy()[i] < high["id"].to_numpy()[j]
        i, j = i[differ], j[differ]
        links = np.bincount(i, weights=high["copies"].to_numpy()[j], minlength=len(low)).astype(int), np.bincount(j, weights=low["copies"].to_numpy()[i], minlength=len(high)).astype(int)
        ids = np.concatenate([low["id"].to_numpy(), high["id"].to_numpy()])
        total = np.concatenate(links)
        first = pd.DataFrame({"id": ids, "n": total})
        return first[first["n"] > 0]

    kind = members.schema["id"].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("n", T.LongType())])
    return dealt.groupBy("component", "lo", "hi").applyInPandas(compare, schema).groupBy("id").agg(F.sum("n").alias("n"))


def near_vectors(
    vectors: DataFrame, cosine: float = COSINE, window: int = WINDOW, missed: float = MISSED,
    id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label",
) -> DataFrame:
    """One row (id, n_links, component_id, kept) for each row of vectors.

    Vectors of equal labels link at the cosine or more. Equal vectors are one while pairs are sought, and count as
    many. A null label, a null, empty or zero vector, and one with null or non-finite components links with
    nothing: n_links 0, its own component. Vectors of unlike length never link. component_id is the smallest id
    reachable; rows with one id are taken for one vector; an empty table gives no rows; other columns are not read.
    """
    rows = saved(_clean(vectors, id_column, vector_column, label_column))
    classes = saved(rows.groupBy("label", "v").agg(F.min("id").alias("rep"), F.count("*").alias("copies")))
    singles = classes.select(F.col("rep").alias("id"), "label", "v", "copies")
    found = None if singles.isEmpty() else _found(singles.drop("copies"), cosine, window, missed)
    every = vectors.select(F.col(id_column).alias("id"))
    if found is None:
        return every.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    labels = components(found)
    members = singles.join(labels.select(F.col("node").alias("id"), "component"), "id")
    links = saved(_counted(members, cosine))
    reps = singles.join(labels.select(F.col("node").alias("id"), "component"), "id", "left").join(links, "id", "left")
    reps = reps.select(F.col("id").alias("rep"), F.coalesce("component", "id").alias("component_id"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    by_class = rows.join(classes.select("label", "v", "rep"), ["label", "v"]).select("id", "rep").dropDuplicates(["id"]).join(reps, "rep")
    out = every.join(by_class.drop("rep"), "id", "left")
    out = out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    return near_vectors(vectors).withColumnRenamed("id", "vec_id")


SQL = """
with recursive v as (
  select vec_id, label, list_transform(embedding, lambda x: x::double) as v
  from embeddings where label is not null and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
pairs as (
  select p.vec_id as a, q.vec_id as b from v p join v q on p.label = q.label and p.vec_id <> q.vec_id and len(p.v) = len(q.v)
  where list_cosine_similarity(p.v, q.v) >= 0.93),
reach as (
  select vec_id, vec_id as r from embeddings
  union
  select reach.vec_id, pairs.b from reach join pairs on pairs.a = reach.r),
smallest as (select vec_id, min(r) as component_id from reach group by 1),
counts as (select a, count(*) as n from pairs group by 1)
select smallest.vec_id, coalesce(n, 0)::bigint as n_links, component_id, smallest.vec_id = component_id as kept
from smallest left join counts on counts.a = smallest.vec_id
"""
