"""A corpus from raw documents to packed sequences: five stages, each over all that the one before kept.

Edge cases, stage by stage. quality: null and empty texts have the score of no features, like any other text; rows with null ids
are scored too. lines: a null text stays null; a document that loses all its lines stays as an empty one. near_dedup: all texts
without words are near-duplicates of each other, so one of them stays; of repeated rows one stays; rows with null ids take part and
lose against an id; between equal ids the hash of the text decides. decontaminate: rows are told by id and text, so of repeated
ids only those whose own text holds a window go; null texts stay. pack: a null text is an empty one, one token. Columns of any
name pass all stages but the last untouched, but for text and n_chars (length of the text as it is then; null of a null text).
Empty tables give empty stages."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwake.llm import decontaminate, jaccard, lines, packing, quality
from driftwake.llm.common import delete, shared_folder, table


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    own = "_".join([*docs.columns, "score"])  # no column of docs has this name
    return quality.score(docs, model, docs.columns, name=own).filter(F.col(own) >= quality.KEEP).drop(own)


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand earlier, equal or one word apart; n_chars follows the text. A document
    that loses all its lines stays as an empty one."""
    out = lines.dedup(docs, told=())
    return out.select(*(F.char_length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: SimHash fingerprints by pivots, and beyond their four bits shared minima, all
    held against the true similarity of five-word shingles, 0.8 or more."""
    return jaccard.one_of_each(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    told = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    bad = told.filter("contaminated").select(F.col("doc_id").alias("_id"), "text_hash")
    return docs.join(bad, (F.xxhash64(docs["text"]) == bad["text_hash"]) & docs["doc_id"].eqNullSafe(bad["_id"]), "left_anti")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens."""
    return packing.pack(docs)


STAGES = [("quality", good), ("lines", fresh_lines), ("near_dedup", distinct), ("decontaminate", clean), ("pack", packed)]

ORACLE_SQL = None  # a trained classifier and a tokenizer stand in the way; tests hold each stage against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage but the last is written to the shared folder and read again; packing leaves a checkpoint of its own,
    so these tables go as soon as it has run, or a stage has failed."""
    home = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    try:
        for name, stage in STAGES[:-1]:
            stage(spark, docs, sf_dir).write.parquet(f"{home}/{name}")
            docs = spark.read.parquet(f"{home}/{name}")
        return STAGES[-1][1](spark, docs, sf_dir)
    finally:
        delete(spark, home)
