"""A corpus pipeline of four stages over ``documents``, each one operator of ``loamline.llm``.

Every stage takes what its predecessor kept.  All but the last return the columns of
``documents``; the last returns the packed pieces.  A row is what a stage keeps or drops:
rows without an id, and rows that share an id with other texts, are kept like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamline.llm import language, mixing, ngram_join, packing
from loamline.llm.common import Stash, checked_broadcast, table
from loamline.llm.registry import tokenizer_file

#: Predictions with a lower calibrated probability are rejected.
LEAST_SURE = 0.5

#: The stages learn, sample and number rows in ways SQL does not express; the tests hold them against brute force.
ORACLE_SQL = None


def keyed(docs: DataFrame, stash: Stash) -> tuple[DataFrame, str]:
    """``docs`` and the name of a long column that tells its rows apart.

    That is ``doc_id`` where no id is null or repeated; else rows are numbered, and written
    first, so that whoever reads them again sees the same numbers.
    """
    ids = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("doc_id is null or n > 1")
    if not ids.limit(1).count():
        return docs, "doc_id"
    key = "row_" + "x" * max(map(len, docs.columns))
    return stash.save(docs.withColumn(key, F.monotonically_increasing_id()), "rows"), key


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: those without a letter or with an unsure prediction go."""
    return language.spoken(docs, LEAST_SURE)


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the least id (where ids are repeated, its first row).

    Different texts under one id are no copies; each stays.  Texts without words are copies of nothing.
    """
    stash = Stash(spark, "distinct")
    rows, key = keyed(docs, stash)
    found = ngram_join.ngram_components(rows, id_col=key)
    gone = stash.save(found.where(F.col(key) != F.col("component_id")).select(key), "gone")
    return rows.join(checked_broadcast(gone), key, "left_anti").select(docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it; those with 0 copies go."""
    stash = Stash(spark, "mixed")
    rows, key = keyed(docs, stash)
    copies = mixing.mix(rows, id_col=key).where("copies > 0").select(F.col(key), F.col("copies").alias("times"))
    fresh = "times_" + "x" * max(map(len, docs.columns))
    taken = rows.join(copies.withColumnRenamed("times", fresh), key)
    return taken.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(fresh)))).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in windows of 1024."""
    return packing.pack(docs, tokenizer_file()).drop("ids")


STAGES = [("language", identified), ("ngram_join", distinct_texts), ("mixing", mixed), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; what a stage keeps is written as Parquet and read by the next."""
    docs, stash = table(spark, sf_dir, "documents"), Stash(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = stash.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
