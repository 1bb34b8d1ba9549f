"""Writing and keeping tables: append, deduplication, latest rows, retention, deletion."""

from __future__ import annotations

import json
import random
import time
from collections.abc import Callable
from typing import Any

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Partition column and sort key of the stored tables.
LAYOUT = {
    "event_log": ("event_date", ["cluster_guid", "infobase_guid", "event_time", "session_id", "record_hash"]),
    "tech_log": ("ts_date", ["cluster_guid", "infobase_guid", "name", "ts", "record_hash"]),
}
RETENTION_DAYS = {"event_log": 30, "tech_log": 30, "parser_metrics": 90, "file_reading_progress": 90}


def deduplicated(rows: DataFrame, key: str = "record_hash") -> DataFrame:
    """One of the rows with equal hashes."""
    return rows.dropDuplicates([key])


def unseen(rows: DataFrame, stored: DataFrame, key: str = "record_hash") -> DataFrame:
    """Rows whose hash is not stored yet; equal rows among the new ones count once."""
    return deduplicated(rows, key).join(stored.select(key), key, "left_anti").select(rows.columns)


def append(rows: DataFrame, path: str, table: str) -> None:
    """Rows added to a table's folder, by day and sorted by its key, with filters for look-ups by hash."""
    day, key = LAYOUT[table]
    if day not in rows.columns:
        rows = rows.withColumn(day, F.to_date("ts"))
    writer = rows.repartition(day, F.pmod(F.xxhash64("record_hash"), F.lit(8))).sortWithinPartitions(day, *key).write.mode("append").partitionBy(day)
    writer.option("compression", "zstd").option("parquet.bloom.filter.enabled#record_hash", "true").parquet(path)


def append_unseen(rows: DataFrame, path: str, table: str) -> None:
    """``append`` of what is not stored; only the days that the new rows have are read."""
    spark, (day, _) = rows.sparkSession, LAYOUT[table]
    if day not in rows.columns:
        rows = rows.withColumn(day, F.to_date("ts"))
    try:
        stored = spark.read.parquet(path)
    except AnalysisException:
        stored = None
    if stored is None:
        append(deduplicated(rows), path, table)
        return
    bounds = rows.agg(F.min(day).alias("a"), F.max(day).alias("b")).first()
    if bounds["a"] is not None:
        append(unseen(rows, stored.where(F.col(day).between(bounds["a"], bounds["b"]))), path, table)


def latest(rows: DataFrame, keys: list[str], version: str = "updated_at") -> DataFrame:
    """The row with the highest version of every key."""
    rest = [c for c in rows.columns if c not in keys]
    picked = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("row"))
    return picked.select(*keys, "row.*").select(rows.columns)


def merged(stored: DataFrame, changes: DataFrame, keys: list[str], version: str = "updated_at") -> DataFrame:
    """An upsert: stored rows and changes, the latest of every key."""
    return latest(stored.unionByName(changes), keys, version)


def retained(rows: DataFrame, time_column: str, days: int, now) -> DataFrame:
    return rows.where(F.col(time_column) >= F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {days} DAY"))


def without_day(rows: DataFrame, time_column: str, day: str) -> DataFrame:
    return rows.where(F.to_date(time_column) != F.lit(day).cast("date"))


def drop_days(spark: SparkSession, path: str, day_column: str, keep: Callable[[str], bool]) -> list[str]:
    """Removes the partitions of a table whose day ``keep`` refuses; the days removed."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    system, gone = root.getFileSystem(conf), []
    for status in system.listStatus(root):
        name = status.getPath().getName()
        if name.startswith(f"{day_column}=") and not keep(day := name.partition("=")[2]):
            system.delete(status.getPath(), True)
            gone.append(day)
    return sorted(gone)


def truncate(spark: SparkSession, path: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    root.getFileSystem(conf).delete(root, True)


def metrics_with_times(metrics: DataFrame, dedup_ns: float, write_ns: float) -> DataFrame:
    """Metrics with estimated times: averages per record times records, at least 1 ms; reading is what parsing leaves, else 15 %."""
    each = lambda ns: F.greatest(F.lit(1), F.floor(F.col("records_parsed") * F.lit(ns) / 1e6))
    left = F.col("parsing_time_ms") - F.col("record_parsing_time_ms")
    reading = F.when(F.col("file_reading_time_ms") > 0, F.col("file_reading_time_ms")).when(left > 0, left).otherwise(F.greatest(F.lit(1), F.floor(F.col("parsing_time_ms") * 0.15)))
    return metrics.withColumns({"deduplication_time_ms": each(dedup_ns).cast("long"), "writing_time_ms": each(write_ns).cast("long"), "file_reading_time_ms": reading.cast("long")})


def with_progress(progress: DataFrame) -> DataFrame:
    share = F.when(F.col("file_size_bytes") > 0, F.col("offset_bytes") * 100.0 / F.col("file_size_bytes")).otherwise(0.0)
    return progress.withColumn("progress_percent", share)


def as_json(rows: DataFrame, indent: int = 2, strict: bool = False) -> str:
    """The rows as a JSON array; no rows are ``[]``, or ``null`` if ``strict``.  For bounded results."""
    out = [json.loads(x) for x in rows.toJSON().toLocalIterator()]
    return "null" if strict and not out else json.dumps(out, ensure_ascii=False, indent=indent)


def retry(action: Callable[[], Any], attempts: int = 3, first: float = 0.1, factor: float = 2.0, most: float = 5.0) -> Any:
    """``action`` again after passing failures, with growing pauses; errors in a query are not repeated."""
    for turn in range(attempts):
        try:
            return action()
        except (AnalysisException, ParseException, ValueError, TypeError):
            raise
        except Exception:
            if turn + 1 == attempts:
                raise
            time.sleep(min(most, first * factor**turn) * random.uniform(0.9, 1.1))
    return None
