"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import gc
import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: space, and tab to carriage return.
BLANKS = r"[\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; set only where it is unset, and only for a
    local master, whose executors share any folder."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not where:
        set_already = sc._jsc.sc().getCheckpointDir()
        if set_already.isEmpty() and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = set_already.get() if set_already.isDefined() else "/tmp/checkpoints"
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(where)
    return where


#: Paths of tables saved within the scratch blocks that are open, the innermost last.
_scratch: list[list[str]] = []


def saved(df: DataFrame, keep: bool = False) -> DataFrame:
    """The rows written once to the shared folder and read from there: lineage ends, lost executors cost nothing.

    Within a `scratch` block the files go at its end, or at the end of the block around it if they are to be kept."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if len(_scratch) > keep:
        _scratch[-1 - keep].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """A block whose saved tables nothing reads after it: their files are deleted at its end, and so are, by Spark's cleaner,
    the shuffle files of its jobs, which would otherwise wait for the driver's next garbage collection."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            _delete(spark, path)
        gc.collect()
        spark.sparkContext._jvm.System.gc()


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def folders(df: DataFrame) -> set[str]:
    """Where the files of a table lie; one folder for a saved one."""
    return {f.rpartition("/")[0] for f in df.inputFiles()}


def dropped(df: DataFrame) -> None:
    """Deletes the files of a saved table that nothing will read again."""
    for folder in folders(df):
        _delete(df.sparkSession, folder)


def words(text) -> F.Column:
    """The words [^\\x20\\x09-\\x0D]+ of a text, in order; an empty array for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda w: w != "")


#: Edges of a task in a round over few edges, and what counts as few; more edges are dealt as the session is set to.
EDGES, FEW = 250_000, 1_000_000


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an edge list as rows (node, component), component the smallest node.

    Nodes without an edge to another node are left out; self-loops, repeated edges and nulls are
    ignored. Each round makes every node point to the smallest neighbour, first from larger
    neighbours (large star) and then among smaller ones (small star), until the edges are stars
    around the smallest node. Only minima are aggregated, so a hub's neighbours never meet in one
    row, and each round ends in a written table. A round over few edges takes as many tasks as these need, dealt by node
    once, instead of all of the session's shuffle partitions several times.
    """
    with scratch(edges.sparkSession):
        return saved(_stars(edges.select(F.col(a).alias("p"), F.col(b).alias("q"))), keep=True)


def _stars(edges: DataFrame) -> DataFrame:
    start = edges.where("p is not null and q is not null and p <> q")
    now = saved(start.select(F.least("p", "q").alias("r"), F.greatest("p", "q").alias("n")).distinct())
    seen, k = None, now.count()
    while True:
        tasks = k // EDGES + 1
        dealt = lambda df: df.repartition(tasks, "n") if k <= FEW else df  # noqa: E731, B023
        both = dealt(now.union(now.select("n", "r")).toDF("n", "x"))
        low = both.groupBy("n").agg(F.least("n", F.min("x")).alias("m"))
        large = dealt(both.join(low, "n").where("x > n").select(F.col("m").alias("r"), F.col("x").alias("n"))).distinct()
        low = large.groupBy("n").agg(F.min("r").alias("m"))
        small = large.join(low, "n").where("r <> m").select(F.col("m").alias("r"), F.col("r").alias("n"))
        now = saved(dealt(small.union(low.select("m", "n")).where("r <> n")).distinct())
        state = now.agg(F.count("*").alias("k"), F.bit_xor(F.xxhash64("n", "r")).alias("s")).first()
        if state == seen or state["k"] == 0:
            return now.select(F.col("n").alias("node"), F.col("r").alias("component")).union(now.select("r", "r").distinct())
        seen, k = state, state["k"]
