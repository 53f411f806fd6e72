"""Benchmark decontamination by winnowing: which words of a document stand in windows of benchmark items.

Of any SPAN words in a row, the least of the hashes of their GRAM-word runs is their fingerprint (a winnow), so a span that
a document and an item share has the same fingerprint in both. Items give their spans and fingerprints as tables. A bitmap of
the items' fingerprints, of bounded size, goes to all tasks; each document's winnows are looked up in it, and only those found
leave the task, each with the words around that belong to its spans. They are joined with the items' fingerprints and, where
these agree, extended: each span's words are joined with the items' distinct spans, one row at most for each, so a passage
that many items and documents share is never multiplied out. Items of fewer than SPAN words are found by their whole runs.
Documents with the same spans share one list of items.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import saved, scratch
from .neardup import _mixed, _WordHash

#: Words of a window, and of the runs whose hashes are winnowed.
SPAN, GRAM = 10, 5
#: Bits of the bitmap for each fingerprint of the items, and its largest size: 16 MB.
BITS_EACH, MOST_BITS = 64, 1 << 27
#: Bits of one row of Spark's bitmap functions.
_ROW_BITS = 32_768
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
#: Bytes of words as lower case, all others as blanks; bytes above 127 belong to words.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def leak_words(text: bytes | None) -> list[bytes]:
    """The words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of a text after A-Z are lower-cased."""
    return (text or b"").translate(_WORD_BYTES).split()


def _runs(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of so many words, which depends on its words, their order and their number."""
    n = len(h) - size + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    out = h[:n] * _FACTORS[0]
    for k in range(1, size):
        out += h[k : n + k] * _FACTORS[k]
    return _mixed(out + np.uint64(size), 0xD6E8FEB86659FD93)


def winnowed(h: np.ndarray, size: int) -> np.ndarray:
    """The fingerprint of each run of so many words: the least hash of its GRAM-word runs, or the run's own below SPAN words."""
    if size < SPAN:
        return _runs(h, size)
    grams = _runs(h, GRAM)
    width = SPAN - GRAM + 1
    if len(grams) < width:
        return np.zeros(0, np.uint64)
    pairs = np.minimum(grams[:-1], grams[1:])  # of two; two such lie apart in four, three in six
    return np.minimum(np.minimum(pairs[: len(pairs) - 4], pairs[2 : len(pairs) - 2]), pairs[4:])


def _hashed(words: list[bytes], known: dict) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def item_spans(items: DataFrame, id_column: str = "item_id", text_column: str = "text") -> DataFrame:
    """A row for each window of each item: id, size (SPAN words, or all of a shorter item), words (text), print (fingerprint)."""
    schema = T.StructType([T.StructField("id", items.schema[id_column].dataType), T.StructField("size", T.IntegerType()), T.StructField("words", T.StringType()), T.StructField("print", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHash()
        for batch in batches:
            for key, text in zip(batch["id"], batch["text"].cast(pa.binary()), strict=True):
                found = leak_words(text.as_py())
                if not found:
                    continue
                size = min(SPAN, len(found))
                prints = winnowed(_hashed(found, known), size).view(np.int64)
                for at in range(0, len(prints), 10_000):  # items of any length in batches of bounded size
                    texts = [b" ".join(found[k : k + size]).decode() for k in range(at, min(at + 10_000, len(prints)))]
                    same = pa.array([key.as_py()] * len(texts), batch["id"].type)
                    yield pa.RecordBatch.from_arrays([same, pa.array([size] * len(texts), pa.int32()), pa.array(texts), pa.array(prints[at : at + 10_000])], names=["id", "size", "words", "print"])

    return items.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInArrow(run, schema)


def _bitmap(prints: DataFrame) -> np.ndarray:
    """Which last bits the prints have, as bytes of 0 and 1: about BITS_EACH for each print, MOST_BITS at most."""
    bits = min(MOST_BITS, max(_ROW_BITS, 1 << (BITS_EACH * prints.count()).bit_length()))
    place = F.col("print").bitwiseAND(bits - 1) + 1
    rows = prints.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("b"))
    out = np.zeros((bits // _ROW_BITS, _ROW_BITS // 8), np.uint8)
    for row in rows.collect():  # MOST_BITS / _ROW_BITS rows at most
        out[row["at"] - 1] = np.frombuffer(row["b"], np.uint8)
    return out.ravel()


def marked(docs: DataFrame, bitmap: np.ndarray, sizes: list[int], id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each row of docs: id, row (a number of its own), n_words, and found, the winnows that the bitmap has: size,
    print, first (place of the first window they stand for), many (such windows in a row), words (text of these)."""
    one = T.StructType([T.StructField("size", T.IntegerType()), T.StructField("print", T.LongType()), T.StructField("first", T.IntegerType()), T.StructField("many", T.IntegerType()), T.StructField("words", T.StringType())])
    schema = T.StructType([T.StructField("id", docs.schema[id_column].dataType), T.StructField("row", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("found", T.ArrayType(one))])
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)
    arrow = pa.list_(pa.struct([("size", pa.int32()), ("print", pa.int64()), ("first", pa.int32()), ("many", pa.int32()), ("words", pa.string())]))

    def of(found: list[bytes], known: dict, bits: np.ndarray) -> Iterator[dict]:
        h, mask = _hashed(found, known), np.uint64(len(bits) * 8 - 1)
        for size in sizes:
            prints = winnowed(h, size)
            place = prints & mask
            hits = np.flatnonzero(bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1)
            if len(hits):
                new = np.flatnonzero((np.diff(hits, prepend=-2) > 1) | (np.diff(prints[hits], prepend=~prints[hits[0]]) != 0))
                cuts = [c for a, b in zip(new.tolist(), [*new[1:].tolist(), len(hits)], strict=True) for c in range(a, b, SPAN)]
                for a, b in zip(cuts, [*cuts[1:], len(hits)], strict=True):  # SPAN windows at most, also where words repeat on and on
                    first, many = int(hits[a]), b - a
                    yield {"size": size, "print": int(prints[first].astype(np.int64)), "first": first, "many": many, "words": b" ".join(found[first : first + many + size - 1]).decode()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, bits, row = _WordHash(), shared.value, TaskContext.get().partitionId() << 40
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [leak_words(x.as_py()) for x in part["text"].cast(pa.binary())]
                hits = pa.array([list(of(x, known, bits)) if x else [] for x in found], arrow)
                yield pa.RecordBatch.from_arrays([part["id"], pa.array(range(row, row + len(found)), pa.int64()), pa.array(map(len, found), pa.int64()), hits], names=["id", "row", "n_words", "found"])
                row += len(found)

    return docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInArrow(run, schema)


def leaks(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", item_column: str = "item_id", text_column: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """What of items stands in docs, as three tables.

    * documents: id, row, n_words, n_hit (words inside a window that occurs), spans (sorted numbers of the windows that
      occur, null if none), one row for each row of docs
    * places: row, first, size, span: where the windows occur
    * owners: span, item (as a string): the items that have a window; rows of items with one id are one item, and one without
      an id marks words but is nobody's

    Null texts have no words; an item without words has no windows. Empty tables give no rows, or no hits. Other columns are
    not read."""
    spark = docs.sparkSession
    with scratch(spark):
        windows = saved(item_spans(items, item_column, text_column))
        spans = windows.groupBy("size", "words", "print").agg(F.count("*").alias("times"))
        spans = saved(spans.withColumn("span", F.monotonically_increasing_id()))
        sizes = sorted(r["size"] for r in spans.select("size").distinct().collect())  # SPAN at most
        owners = windows.where("id is not null").join(spans, ["size", "words", "print"]).select("span", F.col("id").cast("string").alias("item")).distinct()
        owners = saved(owners, keep=True)
        prints = saved(spans.select("size", "print").distinct())
        base = saved(marked(docs, _bitmap(prints), sizes, id_column, text_column))

        found = base.where("size(found) > 0").select("row", F.explode("found").alias("f")).select("row", "f.*")
        found = found.join(prints, ["size", "print"], "left_semi").select("row", "size", "print", "first", F.split("words", " ").alias("w"), F.explode(F.sequence(F.lit(0), F.col("many") - 1)).alias("k"))
        found = found.select("row", "size", "print", (F.col("first") + F.col("k")).alias("first"), F.array_join(F.slice("w", F.col("k") + 1, F.col("size")), " ").alias("words"))
        places = saved(found.join(spans, ["size", "words", "print"]).select("row", "first", "size", "span"), keep=True)

        step = "(a, x) -> named_struct('n', a.n + greatest(0, x.first + x.size - greatest(a.last, x.first)), 'last', greatest(a.last, x.first + x.size))"
        covered = f"aggregate(array_sort(collect_list(struct(first, size))), named_struct('n', 0, 'last', 0), {step}, a -> bigint(a.n))"
        hit = places.groupBy("row").agg(F.expr(covered).alias("n_hit"), F.array_sort(F.collect_set("span")).alias("spans"))
        documents = saved(base.drop("found").join(hit, "row", "left").withColumn("n_hit", F.coalesce("n_hit", F.lit(0).cast("long"))), keep=True)
    return documents, places, owners


def contamination(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", item_column: str = "item_id", text_column: str = "text") -> DataFrame:
    """One row for each row of docs: id, n_words, n_hit, n_items (items with windows that occur), items_sha256 (hex, of these
    ids as sorted strings, joined by commas), contaminated (n_hit > 0). What `leaks` says of rough input holds."""
    documents, _, owners = leaks(docs, items, id_column, item_column, text_column)
    lists = documents.where("spans is not null").select("spans").distinct()  # copies share one list
    named = lists.select("spans", F.explode("spans").alias("span")).join(owners, "span").groupBy("spans").agg(F.array_sort(F.collect_set("item")).alias("items"))
    named = named.select("spans", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    clean = documents.where("spans is null").select("id", "n_words", "n_hit", F.lit(0).cast("long").alias("n_items"), F.sha2(F.lit(""), 256).alias("items_sha256"))
    hit = documents.where("spans is not null").join(named, "spans", "left")
    hit = hit.select("id", "n_words", "n_hit", F.coalesce("n_items", F.lit(0).cast("long")), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)))
    return clean.union(hit).withColumn("contaminated", F.col("n_hit") > 0)


def without_contaminated(docs: DataFrame, items: DataFrame, least_hit: int = 1) -> DataFrame:
    """The rows of docs, same columns, of whose words fewer than least_hit stand in windows of items; rows that share an id go
    together, rows without an id stay."""
    gone = contamination(docs, items).where(F.col("n_hit") >= least_hit).select("id").distinct()
    return docs.join(gone, F.col("doc_id") == gone["id"], "left_anti")


def op13_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return contamination(docs, items).withColumnRenamed("id", "doc_id")


SQL = r"""
with lowered as (
  select 'd' as t, doc_id as id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents
  union all select 'b', item_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') from benchmark),
split as (select t, id, regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from lowered),
items as (select id, w, least(10, len(w)) as size from split where t = 'b' and len(w) > 0),
windows as (
  select distinct id, size, array_to_string(list_slice(w, i, i + size - 1), ' ') as words
  from (select id, w, size, unnest(range(1, len(w) - size + 2)) as i from items)),
sizes as (select distinct size from windows),
docs as (select id, w from split where t = 'd'),
places as (
  select id, size, i, array_to_string(list_slice(w, i, i + size - 1), ' ') as words
  from (select id, w, size, unnest(range(1, len(w) - size + 2)) as i from docs, sizes where len(w) >= size)),
hits as (select places.id, places.size, i, windows.id as item from places join windows using (size, words)),
counted as (
  select id, count(distinct k) as n_hit from (select id, unnest(range(i, i + size)) as k from (select distinct id, size, i from hits)) group by id),
listed as (
  select id, count(*) as n_items, string_agg(item, ',' order by item) as joined
  from (select distinct id, item::varchar as item from hits) group by id)
select docs.id as doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(joined, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from docs left join counted on counted.id = docs.id left join listed on listed.id = docs.id
"""
