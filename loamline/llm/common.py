"""Helpers that several corpus operators share: tables, shared storage, checked broadcasts."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only when it was counted and has no more rows, and no more bytes, than this.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only where the session names none and runs in one process (tests) a temporary folder is
    made; on a cluster, whose machines share none, that is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        where = "file://" + tempfile.mkdtemp(prefix="loamline-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


class Stash:
    """Intermediate tables in the shared folder; they cut the lineage and outlive executors.

    ``drop`` removes a table as soon as nothing reads it any more; what the returned
    frame of an operator still reads stays until the folder is cleaned.
    """

    def __init__(self, spark: SparkSession, purpose: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/loamline-{purpose}-{uuid.uuid4().hex[:12]}"

    def save(self, df: DataFrame, name: str, **options) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").options(**options).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def row_bytes(side: DataFrame) -> Column:
    """About the bytes of a row: 8 for each plain value, and what strings, binaries and arrays hold."""
    size = F.lit(8 * len(side.columns))
    for name, kind in side.dtypes:
        if kind in ("string", "binary"):
            size = size + F.coalesce(F.octet_length(F.col(f"`{name}`")), F.lit(0))
        elif kind.startswith("array"):
            size = size + F.coalesce(8 * F.greatest(F.size(F.col(f"`{name}`")), F.lit(0)), F.lit(0))
    return size.cast("long")


def checked_broadcast(side: DataFrame, limit: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> DataFrame:
    """``side`` with a broadcast hint if it has at most ``limit`` rows of ``most`` bytes, else unchanged.

    Beyond the limits Spark plans a shuffled join, whose skewed partitions it can split.
    Pass a materialised side: it is counted here.
    """
    seen = side.limit(limit + 1).select(row_bytes(side).alias("bytes")).agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes")).first()
    return F.broadcast(side) if seen["n"] <= limit and (seen["bytes"] or 0) <= most else side


def word_count(text: Column) -> Column:
    """Number of maximal runs of ``[^\\x20\\x09-\\x0D]``; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
