"""Cumulative counts and exact quantiles of keys of any size: values are cut into ranges, so no task sorts or holds a whole key."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from axonframe.sources.recordings import settled

#: Ranges that a key's values are cut into: the session's shuffle partitions, within these.
LEAST_RANGES, MOST_RANGES = 64, 4096


def _same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """An equi-join on the keys that also matches nulls; the keys come from the left."""
    named = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    hit = functools.reduce(operator.and_, [left[k].eqNullSafe(named[f"__{k}"]) for k in keys], F.lit(True))
    return left.join(named, hit, how).drop(*[f"__{k}" for k in keys])


def cumulative(counts: DataFrame, keys: list[str], value: str, columns: list[str], ranges: int | None = None) -> DataFrame:
    """counts (one row a key and value) with `upto_<c>`, the sum of each column c over the key's values up to the row's own, and
    `total_<c>`.

    Approximate quantiles cut each key's values into ranges; windows run within a range and over one row a range, so the sums
    are exact wherever the cuts lie. The cuts depend on the order in which rows arrive, so rows with their ranges are settled:
    cut twice, a value may lie in two ranges. Nulls come before all values, NaN after them. There are as many ranges as the
    session has shuffle partitions, which is set by the size of the data, from LEAST_RANGES to MOST_RANGES.
    """
    if ranges is None:
        ranges = min(MOST_RANGES, max(LEAST_RANGES, int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    shares = [i / ranges for i in range(1, ranges)]
    cuts = counts.groupBy(*keys).agg(F.percentile_approx(value, shares, 50 * ranges).alias("__cuts"), *[F.sum(c).alias(f"total_{c}") for c in columns])
    cut = settled(_same(counts, cuts, keys).withColumn("__range", F.size(F.filter(F.coalesce("__cuts", F.array()), lambda c: c < F.col(value)))).drop("__cuts"))
    inner = Window.partitionBy(*keys, "__range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    ends = cut.groupBy(*keys, "__range").agg(*[F.sum(c).alias(f"__in_{c}") for c in columns])
    ends = ends.select(*keys, "__range", *[F.coalesce(F.sum(f"__in_{c}").over(before), F.lit(0)).alias(f"__before_{c}") for c in columns])
    inside = cut.withColumns({f"upto_{c}": F.sum(c).over(inner) for c in columns})
    out = _same(inside, ends, [*keys, "__range"])
    return out.withColumns({f"upto_{c}": F.col(f"upto_{c}") + F.col(f"__before_{c}") for c in columns}).drop("__range", *[f"__before_{c}" for c in columns])


def quantiles(rows: DataFrame, keys: list[str], value: Column, shares: dict[str, float]) -> DataFrame:
    """keys with a column for each name in shares: the exact quantile of the values that are not null, interpolated between
    the two next to the place (n - 1) * share. Keys without a value have nulls."""
    all_keys = rows.select(*keys).distinct()
    counts = rows.select(*keys, value.alias("v")).where("v is not null").groupBy(*keys, "v").agg(F.count("*").alias("c"))
    ranked = cumulative(counts, keys, "v", ["c"])
    place = {name: (F.col("total_c") - 1) * F.lit(float(share)) for name, share in shares.items()}
    at = lambda i: F.min(F.when(F.col("upto_c") > i, F.col("v")))
    ends = [x for name, p in place.items() for x in (at(F.floor(p)).alias(f"low_{name}"), at(F.ceil(p)).alias(f"high_{name}"), F.max(p - F.floor(p)).alias(f"part_{name}"))]
    found = ranked.groupBy(*keys).agg(*ends)
    found = found.select(*keys, *[(F.col(f"low_{n}") + (F.col(f"high_{n}") - F.col(f"low_{n}")) * F.col(f"part_{n}")).alias(n) for n in shares])
    return _same(all_keys, found, keys, "left")
