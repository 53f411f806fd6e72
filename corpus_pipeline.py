"""The corpus pipeline: documents through language ID, line dedup, near-dedup, mixing and encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axonframe.llm import language, lines, mixing, neardup, pieces
from axonframe.llm.common import dropped, saved


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model does not reject."""
    return language.drop_rejected(docs, language.fit_language_model(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents, their texts without lines that repeat."""
    return lines.without_repeated_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return neardup.drop_near_copies(docs, 80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents, laid out in the order in which the sources mix; their places go with them to the next stage."""
    return mixing.in_mixed_order(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document with its slot in the mix and its place within the source, in the order of the mix.

    The places are those that the mixing stage has given; documents that it has not placed come last, with null places."""
    order = [F.col("slot").asc_nulls_last(), F.col("ix")]
    mixed = mixing.places_of(docs).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = mixed.select(F.struct(F.coalesce("doc.doc_id").alias("doc_id"), "slot", "ix").alias("place"), "doc.text")
    return pieces.encode_pieces(placed, pieces.read_model(), "place", "text").select("id.*", "ids", "n_pieces", "n_byte_pieces", "round_trip")


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("mixing sources", mix),
    ("SentencePiece encoding", encode),
]

#: Classification, sketches and piece encoding have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of sf_dir through all stages, each reading what the one before has written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = saved(docs)
            if before is not None:
                dropped(before)
            before = docs
    return docs
