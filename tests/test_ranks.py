"""Cumulative counts whose rows come out differently each time they are computed."""

import numpy as np
from pyspark.sql import functions as F

from axonframe.functions.ranks import cumulative


def test_counts_hold_where_rows_are_not_computed_alike_twice(spark):
    def moved(batches):
        for frame in batches:
            yield frame.assign(v=frame["v"] + np.random.default_rng().normal(0, 50, len(frame)))

    rows = spark.range(2000).select((F.col("id") % 2).alias("k"), F.col("id").cast("double").alias("v"), F.lit(1).alias("n")).mapInPandas(moved, "k long, v double, n int")
    got = cumulative(rows, ["k"], "v", ["n"]).toPandas()
    for _, own in got.groupby("k"):
        assert len(own) == 1000
        assert own.sort_values("v")["upto_n"].tolist() == list(range(1, 1001))
