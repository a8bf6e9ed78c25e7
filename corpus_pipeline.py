"""A corpus pipeline of five stages; each calls one operator of ``quadloom.llm`` and works on what its predecessor kept.

A stage is called with (spark, docs, sf_dir) and returns a DataFrame, which is written and read again before the next.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.llm import decontaminate, language_id, line_dedup, ngram_join, packing
from quadloom.llm.queries import packing_items
from quadloom.llm.runtime import discard, shared_dir, temporary_cuts

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in a known language; the others go. ``lang`` becomes the language that was found.

    Each row is judged by itself: rows that repeat an id, and rows with a null id, stay or go by their own text. Null,
    empty and blank texts, and those of numbers and addresses alone, go. Ties between languages go to the first by name.
    An empty table gives an empty result. Columns beyond ``COLUMNS``, whatever their names, are left out.
    """
    return language_id.keep_known(docs.select(*COLUMNS), declared=F.col("lang"), host=F.col("source"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that occur before; documents of which nothing is left go.

    Of a class of lines that of the least id stays (null ids last; of rows that repeat an id, the text of the least hash),
    and there the first. Rows equal in id and text keep the same lines. Null, empty and blank texts lose nothing and
    stay. ``n_chars`` follows the text. An empty table gives an empty result; columns beyond ``COLUMNS`` are left out.
    """
    kept = line_dedup.dedup_lines(docs.select(*COLUMNS)).where("lines_dropped = 0 or trim(text) <> ''")
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: that with the least id (null ids last).

    Rows that repeat an id are documents of their own; of rows equal in id and text one stays. Texts without words are
    copies of each other. An empty table gives an empty result; columns beyond ``COLUMNS`` are left out.
    """
    return ngram_join.drop_near_duplicates(docs.select(*COLUMNS))


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark.

    Each row is judged by its own text, also where its id is null or repeats. Null, empty and blank texts stay. An empty
    table gives an empty result; columns beyond ``COLUMNS`` are left out.
    """
    return decontaminate.drop_leaks(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in training sequences, by their tokens.

    Null and empty texts need no room: one row with null ``bin``. Rows that repeat an id are pieces of one document, in
    different sequences; rows with a null id likewise. Pieces of equal length go by id and a hash of the row. An empty
    table gives an empty result.
    """
    return packing.best_fit_pack(packing_items(docs), capacity=2048)


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("benchmark_decontamination", benchmark_stage),
    ("best_fit_packing", packing_stage),
]

#: Trained models, edit distances and greedy packing have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to the shared folder and read again.

    What a stage has cut, and what it has read of its predecessor, is deleted once its own rows are written.
    """
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with temporary_cuts(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        if before:
            discard(spark, before)
        before = f"{folder}/{name}"
        docs = spark.read.parquet(before)
    return docs
