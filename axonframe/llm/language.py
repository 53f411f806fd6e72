"""Language ID: nearest of several TF-IDF centroids per language, with rejection by distance."""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Buckets of hashed byte n-grams (two and three bytes of UTF-8, A-Z lower-cased).
BUCKETS = 4096
#: Labelled rows that the model learns from, all languages together: the bound of the sample, but for LEAST_ROWS of each language.
SAMPLE_ROWS = 2400
LEAST_ROWS = 4
#: Centroids per language.
CENTROIDS = 4
#: A text is rejected if its cosine is below this part of the lowest cosine of the centroid's own sample.
SLACK = 0.5
#: With fewer n-grams than this, the cosine falls as the root of their number, and so does the bound.
FULL_GRAMS = 400
#: Bytes of text that are counted together.
_CHUNK = 4 << 20

#: Bytes as they count: A-Z lower-cased, other ASCII than letters as a blank.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[i for i in range(1, 128) if not chr(i).isalpha()]] = 32


def _counts(texts: list[bytes]) -> np.ndarray:
    """Counts of hashed n-grams, one row a text; texts longer than a chunk are counted in overlapping pieces."""
    out = np.zeros((len(texts), BUCKETS), dtype=np.float32)
    pieces = [(k, t[at : at + _CHUNK + 2]) for k, t in enumerate(texts) for at in range(0, max(len(t), 1), _CHUNK)]
    group: list[tuple[int, bytes]] = []
    size = 0
    for piece in [*pieces, None]:
        if group and (piece is None or size + len(piece[1]) > _CHUNK or len(group) >= 512):
            data = _FOLD[np.frombuffer(b"\0\0\0".join(t for _, t in group) + b"\0\0\0", dtype=np.uint8)].astype(np.uint32)
            ends = np.cumsum([len(t) + 3 for _, t in group])
            row = np.repeat(np.arange(len(group)), np.diff(ends, prepend=0))[:-2]
            pair = data[:-2] << 8 | data[1:-1]
            whole2 = (pair > 255) & (data[1:-1] > 0) & (pair != 0x2020)
            three = pair << 8 | data[2:]
            base = row * BUCKETS
            h2 = (pair * np.uint32(2654435761) >> np.uint32(20))[whole2]
            whole3 = whole2 & (data[2:] > 0) & ((three & 0xFFFF) != 0x2020)
            h3 = ((three + np.uint32(0x9E3779B9)) * np.uint32(2246822519) >> np.uint32(20))[whole3]
            cells = np.concatenate([base[whole2] + h2, base[whole3] + h3])
            found = np.bincount(cells, minlength=len(group) * BUCKETS).reshape(len(group), BUCKETS)
            for (k, _), cells_of in zip(group, found, strict=True):
                out[k] += cells_of
            group, size = [], 0
        if piece is not None:
            group.append(piece)
            size += len(piece[1])
    return out


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def _centroids(rows: np.ndarray, k: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means: centroids, and for each the lowest cosine of the rows nearest to it."""
    at = rows[rng.choice(len(rows), min(k, len(rows)), replace=False)]
    for _ in range(12):
        own = np.argmax(rows @ at.T, axis=1)
        at = _unit(np.stack([rows[own == i].sum(0) if (own == i).any() else at[i] for i in range(len(at))]))
    near = rows @ at.T
    own, best = near.argmax(1), near.max(1)
    return at, np.array([best[own == i].min() if (own == i).any() else 1.0 for i in range(len(at))])


class LanguageModel:
    """Languages, their centroids and rejection bounds, of bounded size; tasks get `parts()` by broadcast.

    vectors holds a row of counts for each text, langs its language."""

    def __init__(self, vectors: np.ndarray, langs: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.langs = sorted(set(langs))
        seen = np.count_nonzero(vectors, axis=0)
        self.idf = (np.log((1 + len(vectors)) / (1 + seen)) + 1).astype(np.float32)
        rows = _weighed(vectors, self.idf)
        which = np.array([self.langs.index(x) for x in langs])
        found = [_centroids(rows[which == i], CENTROIDS, rng) for i in range(len(self.langs))]
        self.owner = np.repeat(np.arange(len(found)), [len(a) for a, _ in found])
        self.centroids = np.concatenate([a for a, _ in found]).astype(np.float32) if found else np.zeros((0, BUCKETS), np.float32)
        self.bounds = np.concatenate([b for _, b in found]) * SLACK if found else np.zeros(0)

    def parts(self) -> dict:
        return {"langs": [self.langs[i] for i in self.owner], "idf": self.idf, "centroids": self.centroids, "bounds": self.bounds}


def _weighed(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return _unit(np.log1p(counts) * idf)


def _predict(model: dict, texts: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray]:
    counts = _counts(texts)
    near = _weighed(counts, model["idf"]) @ model["centroids"].T
    best = near.argmax(1)
    score = near[np.arange(len(texts)), best].clip(0, 1).astype(float)
    few = np.sqrt(np.minimum(1, counts.sum(1) / FULL_GRAMS))
    return [model["langs"][i] for i in best], score, score < model["bounds"][best] * few


def _hash_of_id(column: str, modulus: int) -> Column:
    """crc32 of an id as text modulo a number; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def _train_rows(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", "lang").where((_hash_of_id("doc_id", 5) != 0) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))


def fit_language_model(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> dict:
    """The parts of a model from about sample_rows labelled rows whose crc32(doc_id) mod 5 is not 0, whole texts, the same share
    of the bound for each language, at least LEAST_ROWS, chosen by hash. Their n-gram counts are taken in tasks, the
    sample is clustered in one, and only the model reaches the driver."""
    rows = _train_rows(docs)
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language
    nothing = LanguageModel(np.zeros((0, BUCKETS), np.float32), []).parts()
    if not sizes:
        return nothing
    each = max(LEAST_ROWS, sample_rows // len(sizes))
    share = F.create_map(*[x for k, n in sorted(sizes.items()) for x in (F.lit(k), F.lit(min(1.0, each / n)))])
    place = F.pmod(F.xxhash64(F.lit("language sample"), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    taken = rows.where(place < share[F.col("lang")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                found = _counts([t.as_buffer().to_pybytes() for t in part["text"].cast(pa.binary())])
                cells = [zlib.compress(x.tobytes(), 1) for x in found]
                yield pa.RecordBatch.from_arrays([part["lang"].cast(pa.string()), pa.array(cells, pa.binary())], ["lang", "cells"])

    def fit(group: pa.Table) -> pa.Table:
        got = sorted(zip(group["lang"].to_pylist(), group["cells"].to_pylist(), strict=True))
        vectors = np.stack([np.frombuffer(zlib.decompress(x), np.float32) for _, x in got])
        return pa.table({"model": pa.array([pickle.dumps(LanguageModel(vectors, [lang for lang, _ in got]).parts())], pa.binary())})

    found = taken.mapInArrow(count, "lang string, cells binary").withColumn("all", F.lit(True)).groupBy("all").applyInArrow(fit, "model binary").first()
    return pickle.loads(found["model"]) if found else nothing


def identify(docs: DataFrame, model: dict, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row (id, lang_pred, score, rejected) for each row of docs, over whole texts.

    lang_pred is the language of the nearest centroid, score its cosine (0 to 1), rejected whether it is
    below the centroid's bound. A null text, a text without a letter, and every text if the model has
    learned nothing, is `und` with score 0 and rejected. Repeated rows are judged one by one; ties go to
    the first language by name; ids may be null; other columns are not read.
    """
    schema = T.StructType([T.StructField("id", docs.schema[id_column].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    handed = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                n = part.num_rows
                lang, score, reject = ["und"] * n, np.zeros(n), np.ones(n, bool)
                here = np.flatnonzero(part["lettered"].to_numpy(zero_copy_only=False))
                if len(here) and handed.value["langs"]:
                    texts = [x.as_buffer().to_pybytes() for x in part["text"].cast(pa.binary()).take(pa.array(here))]
                    names, score[here], reject[here] = _predict(handed.value, texts)
                    for i, name in zip(here, names, strict=True):
                        lang[i] = name
                yield pa.RecordBatch.from_arrays([part["id"], pa.array(lang), pa.array(score), pa.array(reject)], names=["id", "lang_pred", "score", "rejected"])

    lettered = F.coalesce(F.col(text_column).rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"), lettered.alias("lettered"))
    return rows.mapInArrow(run, schema)


def drop_rejected(docs: DataFrame, model: dict) -> DataFrame:
    """The rows of docs, same columns, that `identify` does not reject."""
    judged = identify(docs.select(F.struct("*").alias("row"), F.col("text").alias("text")), model, "row", "text")
    return judged.where(~F.col("rejected")).select("id.*")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs.select("doc_id", "text"), fit_language_model(docs))
    return found.select(F.col("id").alias("doc_id"), (_hash_of_id("id", 5) == 0).alias("held_out"), "lang_pred", "score", "rejected")
