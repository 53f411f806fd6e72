"""MinHash near-dedup with HyperMinHash sketches: banded compressed registers, corrected estimates, exact checks.

A document's set holds its distinct five-word shingles, as 64-bit hashes. Its sketch has 1,024 registers: a shingle
falls into one by its first bits, and the register keeps the smallest of a second hash as the number of leading
zeros and ten mantissa bits. Documents with equal sets form a class, and one of them stands for it. Bands of four
registers (empty ones filled from others chosen by hash) give buckets, and each bucket pairs one member, the one that
shares most buckets, with the others. Pairs whose estimated similarity allows a link are confirmed on whole sets: first
one pair for each document, then the pairs whose ends are still apart, last what else a bucket holds whose ends are still
apart: pairs of small buckets one by one, in large buckets the documents outside its main component, in blocks, against
themselves and the rest. No pair that shares a bucket goes unchecked unless it is connected already.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, saved, scratch

WORDS = 5
REGISTERS = 1024
BANDS, ROWS = 24, 4
MANTISSA = 10
#: Share of registers that agree by chance in unlike sets of equal size, times 2 ** MANTISSA (HyperMinHash paper).
BY_CHANCE = 0.169919487159739
#: An estimate may miss the similarity by so many standard deviations before a pair is left unchecked.
DEVIATIONS = 5
#: Buckets above this size are compared in blocks.
SMALL = 32
BLOCK = 512
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_REMEMBERED = 400_000


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def _mixed(h: np.ndarray, factor: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(factor)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def shingle_set(text: bytes | None, known: dict) -> np.ndarray:
    """The sorted distinct hashes of a text's five-word shingles; of all its words if they are fewer; empty without words."""
    found = (text or b"").translate(_LOWER).split()
    if not found:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
    if len(w) < WORDS:
        return _mixed((w * _FACTORS[: len(w)]).sum(keepdims=True) + np.uint64(len(w)), 0xD6E8FEB86659FD93)
    n = len(w) - WORDS + 1
    h = w[:n] * _FACTORS[0]
    for k in range(1, WORDS):
        h += w[k : n + k] * _FACTORS[k]
    return np.unique(_mixed(h, 0xD6E8FEB86659FD93))


def registers(found: np.ndarray) -> np.ndarray:
    """The sketch of a set: for each register leading zeros and mantissa of its least hash, 0 if it is empty."""
    out = np.zeros(REGISTERS, np.uint16)
    if len(found):
        cell = (found >> np.uint64(54)).astype(np.int64)
        bits = _mixed(found, 0xA0761D6478BD642F).astype(np.float64).view(np.uint64)
        zeros = np.clip(1086 - (bits >> np.uint64(52)).astype(np.int64), 0, 63)
        tail = 1023 - ((bits >> np.uint64(52 - MANTISSA)) & np.uint64(1023)).astype(np.int64)
        value = np.maximum(zeros << MANTISSA | tail, 1)
        starts = np.flatnonzero(np.diff(cell, prepend=-1))  # sets are sorted, and the cell is the first bits
        out[cell[starts]] = np.maximum.reduceat(value, starts)
    return out


_TRIES = np.random.default_rng(5).integers(0, REGISTERS, (1024, BANDS * ROWS))


def band_keys(sketches: np.ndarray) -> np.ndarray:
    """A key for each band of each sketch (rows), after empty registers are filled from others chosen by hash."""
    full = sketches[:, : BANDS * ROWS].astype(np.uint64)
    row, col = np.nonzero(full == 0)
    for places in _TRIES:
        if not len(row):
            break
        got = sketches[row, places[col]]
        full[row, col] = got
        row, col = row[got == 0], col[got == 0]
    for r, c in zip(row, col, strict=True):  # a few registers of very small sets
        full[r, c] = next((x for x in np.roll(sketches[r], -c) if x), 0)
    used = full.reshape(len(full), BANDS, ROWS)
    packed = used[..., 0] << np.uint64(48) | used[..., 1] << np.uint64(32) | used[..., 2] << np.uint64(16) | used[..., 3]
    return _mixed(packed + _mixed(np.arange(BANDS, dtype=np.uint64) + np.uint64(1), 0xE7037ED1A0B428DB), 0x8EBC6AF09C88C6E3).view(np.int64)


def may_link(same: np.ndarray, used: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    """Whether pairs may have the similarity, from the registers that agree and those in use in either sketch.

    The estimate is less what agrees by chance. Registers sample the union without replacement, so it deviates by
    the binomial's root less the sampled share.
    """
    goal = percent / 100
    total = n_a + n_b
    chance = used * BY_CHANCE / 2**MANTISSA * 4.0 * n_a * n_b / np.maximum(total.astype(float) ** 2, 1)
    value = (same - chance) / np.maximum(used - chance, 1)
    left = np.clip(1 - used / np.maximum(total / (1 + goal), 1), 0.02, 1)
    return value >= goal - DEVIATIONS * np.sqrt(goal * (1 - goal) * left / np.maximum(used, 1)) - 1 / np.maximum(used, 1)


def _blockwise(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Registers that agree and that are in use in either, for all pairs of rows of a and b."""
    same = np.stack([((row == b) & (row > 0)).sum(1) for row in a])
    used = np.stack([((row > 0) | (b > 0)).sum(1) for row in a])
    return same, used


def sketched(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row a document: id, n (size of its set), fa and fb (fingerprints of the set), sketch."""
    schema = T.StructType([T.StructField("id", docs.schema[id_column].dataType), T.StructField("n", T.LongType()), T.StructField("fa", T.LongType()), T.StructField("fb", T.LongType()), T.StructField("sketch", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHash()
        for batch in batches:
            n, fa, fb, sk = [], [], [], []
            for text in batch["text"].cast(pa.binary()):
                s = shingle_set(text.as_py(), known)
                n.append(len(s))
                fa.append(int(_mixed(s, 0x589965CC75374CC3).sum().astype(np.int64)))
                fb.append(int(_mixed(s, 0x1D8E4E27C47D124F).sum().astype(np.int64)))
                sk.append(registers(s).tobytes())
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(n, pa.int64()), pa.array(fa, pa.int64()), pa.array(fb, pa.int64()), pa.array(sk, pa.binary())], names=["id", "n", "fa", "fb", "sketch"])

    return docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInArrow(run, schema)


def _banded(sketches: DataFrame) -> DataFrame:
    """(key, id, n), a row for each band of each sketch."""
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("id", sketches.schema["id"].dataType), T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                keys = band_keys(np.stack([np.frombuffer(x, np.uint16) for x in part["sketch"].to_pylist()]))
                row = pa.array(np.repeat(np.arange(len(keys)), BANDS))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), part["id"].take(row), part["n"].take(row)], names=["key", "id", "n"])

    return sketches.select("id", "n", "sketch").mapInArrow(run, schema)


def _likely(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose estimate lies within DEVIATIONS of the similarity."""
    side = lambda x: sketches.select(F.col("id").alias(x), F.col("sketch").alias(f"s_{x}"), F.col("n").alias(f"n_{x}"))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "s_a", "s_b", "n_a", "n_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                a, b = (np.stack([np.frombuffer(x, np.uint16) for x in part[k].to_pylist()]) for k in ("s_a", "s_b"))
                near = may_link(((a == b) & (a > 0)).sum(1), ((a > 0) | (b > 0)).sum(1), part["n_a"].to_numpy(), part["n_b"].to_numpy(), percent)
                yield part.select(["a", "b"]).filter(pa.array(near))

    return both.mapInArrow(run, pairs.select("a", "b").schema)


def _confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets have 100 * intersection >= percent * union."""
    side = lambda x: texts.select(F.col("id").alias(x), F.col("text").alias(f"t_{x}"))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "t_a", "t_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, last, kept = _WordHash(), b"", np.zeros(0, np.uint64)
        for batch in batches:
            ok = []
            for x, y in zip(batch["t_a"].cast(pa.binary()), batch["t_b"].cast(pa.binary()), strict=True):
                x, y = x.as_py(), y.as_py()
                if x != last:
                    last, kept = x, shingle_set(x, known)
                other = shingle_set(y, known)
                shared = len(kept) + len(other) - len(np.unique(np.concatenate([kept, other])))
                ok.append(100 * shared >= percent * (len(kept) + len(other) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.mapInArrow(run, pairs.select("a", "b").schema)


def _of_blocks(mixed: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of large buckets in different components that may link: (key, id, n, component, main, most, size), where
    most rows of a bucket are of its main component. The first blocks hold the outsiders and meet every block; the others
    hold the main component and meet only those, so a few outsiders do not deal a large bucket again and again. A pair
    that shares several buckets counts in the first of its bands."""
    cut = mixed.withColumn("outer", F.ceil((F.col("size") - F.col("most")) / BLOCK)).withColumn("k", F.col("outer") + F.ceil(F.col("most") / BLOCK))
    outside, at = F.col("component") != F.col("main"), F.xxhash64("id")
    cut = cut.withColumn("own", F.when(outside, F.pmod(at, "outer")).otherwise(F.col("outer") + F.pmod(at, F.col("k") - F.col("outer"))))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.when(outside, F.col("k")).otherwise(F.col("outer")) - 1)))
    dealt = cut.select("key", "id", "n", "component", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi")).join(sketches.select("id", "sketch"), "id")

    def compare(group: pa.Table) -> pa.Table:
        own, ids = group["own"].to_numpy(), group["id"].combine_chunks()
        n, comp = group["n"].to_numpy(), group["component"].to_pandas().factorize()[0]
        sk = np.stack([np.frombuffer(x, np.uint16) for x in group["sketch"].to_pylist()])
        keys, key = band_keys(sk), group["key"][0].as_py()
        i, j = np.flatnonzero(own == group["lo"][0].as_py()), np.flatnonzero(own == group["hi"][0].as_py())
        out: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, int), np.zeros(0, int))]
        for at in range(0, len(i), 64):
            rows = i[at : at + 64]
            open_ = comp[rows][:, None] != comp[j][None, :]
            if group["lo"][0] == group["hi"][0]:
                open_ &= rows[:, None] < j[None, :]
            band = int(np.argmax(keys[rows[0]] == key))
            for b in range(band):
                open_ &= keys[rows, b][:, None] != keys[j, b][None, :]
            if open_.any():
                same, used = _blockwise(sk[rows], sk[j])
                ok = open_ & may_link(same, used, n[rows][:, None], n[j][None, :], percent)
                x, y = np.nonzero(ok)
                out.append((rows[x], j[y]))
        a, b = (np.concatenate([o[k] for o in out]) for k in (0, 1))
        return pa.table({"a": ids.take(pa.array(a)), "b": ids.take(pa.array(b))})

    kind = mixed.schema["id"].dataType
    found = dealt.groupBy("key", "lo", "hi").applyInArrow(compare, T.StructType([T.StructField("a", kind), T.StructField("b", kind)]))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs (a, b) whose ends are in different components (nodes without a label are their own)."""
    side = lambda x: labels.select(F.col("node").alias(x), F.col("component").alias(f"c_{x}"))
    both = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    return both.where(F.coalesce("c_a", "a") != F.coalesce("c_b", "b")).select(*pairs.columns)


def _class_labels(docs: DataFrame, sketches: DataFrame, classes: DataFrame, by_set: list[str], percent: int, id_column: str, text_column: str) -> DataFrame:
    """(node, component) of the classes' representatives that link with another."""
    reps = sketches.join(classes.select(F.col("rep").alias("id"), *by_set), ["id", *by_set], "left_semi").dropDuplicates(["id"])
    reps = saved(reps.where(F.col("n") * (100 - percent) >= percent))  # smaller sets are equal or not linked
    bands = saved(_banded(reps))
    shared = bands.groupBy("key").agg(F.count("*").alias("many")).where("many > 1")
    bands = saved(bands.join(shared, "key"))
    known = bands.groupBy("id").agg(F.sum("many").alias("known"))  # an original shares more buckets with its copies than they share
    leaders = bands.join(known, "id").groupBy("key").agg(F.max(F.struct("known", "n", "id")).alias("m"))
    leaders = leaders.select("key", F.col("m.id").alias("first"), F.col("m.n").alias("n_first"), F.col("m.known").alias("known"))
    close = f"least(n, n_first) * 100L >= greatest(n, n_first) * {percent}L"
    stars = bands.join(leaders, "key").where("id <> first").where(close).groupBy("first", "id").agg(F.max("known").alias("c"))
    stars = saved(stars.select(F.col("first").alias("a"), F.col("id").alias("b"), "c"))
    member = bands.select("id").distinct()
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    texts = saved(texts.join(member, "id", "left_semi").dropDuplicates(["id"]))

    best = stars.groupBy("b").agg(F.min(F.struct((-F.col("c")).alias("c"), "a")).alias("m")).select("m.a", "b")
    best = saved(best)
    links = saved(_confirmed(_likely(best, reps, percent), texts, percent))
    labels = components(links)

    rest = _apart(stars.select("a", "b").join(best, ["a", "b"], "left_anti"), labels)
    links = saved(links.union(_confirmed(_likely(rest, reps, percent), texts, percent)))
    labels = components(links)

    own = bands.join(labels.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    counted = own.groupBy("key", "component").agg(F.count("*").alias("c"))
    main = counted.groupBy("key").agg(F.max(F.struct("c", "component")).alias("m"), F.count("*").alias("k"), F.sum("c").alias("size"))
    mixed = saved(own.join(main.where("k > 1").select("key", "size", F.col("m.component").alias("main"), F.col("m.c").alias("most")), "key"))
    small = mixed.where(f"size <= {SMALL}")
    x = small.where("component <> main").select("key", F.col("id").alias("a"), "n", F.col("component").alias("ca"))
    y = small.select("key", F.col("id").alias("b"), F.col("n").alias("n_first"), F.col("component").alias("cb"), "main")
    cross = x.join(y, "key").where("ca <> cb and (cb = main or a < b)").where(close)
    cross = cross.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    cross = _likely(cross, reps, percent).union(_of_blocks(mixed.where(f"size > {SMALL}"), reps, percent)).distinct()
    done = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = saved(_confirmed(cross.join(done, ["a", "b"], "left_anti"), texts, percent))
    return labels if more.isEmpty() else components(links.union(more))


def linked(docs: DataFrame, percent: int = 85, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row (id, n_shingles, component_id, kept) for each row of docs.

    Documents are linked if 100 * intersection >= percent * union of their sets; component_id is the smallest
    id reachable by links, itself included, and kept says that it is the row's own. Without words or text a
    document's set is empty and it is linked with nothing. Rows with one id are one node, so
    copies of a row share its component. A null id takes the component of its class if another row has the
    same set. An empty table gives no rows; other columns are not read.
    """
    by_set, spark = ["n", "fa", "fb"], docs.sparkSession
    with scratch(spark):
        sketches = saved(sketched(docs, id_column, text_column))
        classes = saved(sketches.where("n > 0").groupBy(*by_set).agg(F.min("id").alias("rep"), F.count("*").alias("copies")), keep=True)
        labels = saved(_class_labels(docs, sketches, classes, by_set, percent, id_column, text_column), keep=True)
        sketches = saved(sketches.select("id", *by_set), keep=True)

    named = sketches.select("id", *by_set).join(classes.where("copies > 1").select(*by_set, "rep"), by_set, "left").select("id", "n", F.coalesce("rep", "id").alias("rep"))
    found = named.join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left")
    found = found.select("id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))
    return found.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))


def drop_near_copies(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of docs, same columns, but of each component of linked documents only the one with the smallest id.

    Rows that share an id are one document; rows without an id stay."""
    found = linked(docs.select("doc_id", "text"), percent)
    gone = found.where(~F.col("kept")).select("id").distinct()
    return docs.join(gone, F.col("doc_id") == gone["id"], "left_anti")


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return linked(docs).withColumnRenamed("id", "doc_id")


SQL = r"""
with recursive d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents),
sets as (
  select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) end) as s
  from d),
items as (select doc_id, len(s) as n, unnest(s) as x from sets),
shared as (
  select p.doc_id as a, q.doc_id as b, count(*) as i, any_value(p.n) + any_value(q.n) - count(*) as u
  from items p join items q on p.x = q.x and p.doc_id < q.doc_id group by 1, 2),
links as (select a, b from shared where 100 * i >= 85 * u),
both_ways as (select a, b from links union all select b, a from links),
reach as (
  select doc_id, doc_id as r from sets
  union
  select reach.doc_id, both_ways.b from reach join both_ways on both_ways.a = reach.r),
smallest as (select doc_id, min(r) as component_id from reach group by 1)
select sets.doc_id, len(s)::bigint as n_shingles, component_id, sets.doc_id = component_id as kept
from sets join smallest on smallest.doc_id = sets.doc_id
"""
