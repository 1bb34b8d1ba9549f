"""Documented queries over fingerprints, metrics and progress, and the checks of parsed data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import readable_size
from ..operators.store import latest
from ..schemas import FILE_KEY
from .boards import Times, distinct_count, stamp, within


def error_fingerprints(rows: DataFrame, window: Times | None = None, level: str = "Error", limit: int = 20) -> DataFrame:
    """Fingerprints of a level's errors, the most frequent first."""
    from ..lookups import level_spellings

    found = within(rows, window).where(F.col("level").isin(level_spellings(level)) & (F.col("comment_normalized") != ""))
    out = found.groupBy("comment_normalized").agg(F.count(F.lit(1)).alias("error_count"), F.min("event_time").alias("first_seen"), F.max("event_time").alias("last_seen"), F.min("comment").alias("example"))
    return out.orderBy(F.desc("error_count"), "comment_normalized").limit(limit)


def fingerprint_impact(rows: DataFrame, window: Times | None = None, exact: bool = False) -> DataFrame:
    found = within(rows, window).where(F.col("level").isin("Error", "Ошибка") & (F.col("comment_normalized") != ""))
    out = found.groupBy("comment_normalized").agg(F.count(F.lit(1)).alias("total_errors"), distinct_count("user_name", exact).alias("affected_users"), distinct_count("infobase_name", exact).alias("affected_databases"))
    return out.orderBy(F.desc("total_errors"), "comment_normalized")


def tech_fingerprints(rows: DataFrame, window: Times | None = None, limit: int = 20) -> DataFrame:
    found = within(rows, window, "ts", None).where("raw_line_normalized <> ''")
    out = found.groupBy("raw_line_normalized").agg(F.count(F.lit(1)).alias("record_count"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.min("raw_line").alias("example"))
    return out.orderBy(F.desc("record_count"), "raw_line_normalized").limit(limit)


def sql_latency(rows: DataFrame, window: Times | None = None, name: str = "DBMSSQL", limit: int = 50, exact: bool = False) -> DataFrame:
    found = within(rows, window, "ts", None).where((F.col("name") == name) & (F.col("raw_line_normalized") != ""))
    tail = F.percentile("duration", 0.95) if exact else F.percentile_approx("duration", 0.95, 10_000).cast("double")
    out = found.groupBy("raw_line_normalized").agg(F.count(F.lit(1)).alias("total_queries"), F.avg("duration").alias("avg_duration"), tail.alias("p95_duration"), distinct_count("session_id", exact).alias("affected_sessions"))
    return out.orderBy(F.desc("total_queries"), "raw_line_normalized").limit(limit)


def similar_errors(rows: DataFrame, window: Times | None = None, least: int = 10) -> DataFrame:
    found = within(rows, window, "ts", None).where((F.col("level") == "ERROR") & (F.col("raw_line_normalized") != ""))
    out = found.groupBy("raw_line_normalized").agg(F.count(F.lit(1)).alias("error_count"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    return out.where(F.col("error_count") > least).orderBy(F.desc("error_count"), "raw_line_normalized")


def new_tech_errors(rows: DataFrame, now: str, hours: int = 24) -> DataFrame:
    """Errors of the last hours whose signature (event and text) the hours before did not have."""
    text = F.coalesce(F.when(F.col("system_txt") != "", F.col("system_txt")), F.try_element_at("property_value", F.array_position("property_key", "Txt").cast("int")), F.lit(""))
    span, end = F.expr(f"INTERVAL {hours} HOUR"), stamp(now)
    errors = rows.where(F.col("level") == "ERROR").select("name", text.alias("error_text"), "ts", "cluster_guid", "infobase_guid")
    keys = ["cluster_guid", "infobase_guid", "name", "error_text"]
    fresh = errors.where((F.col("ts") >= end - span) & (F.col("ts") < end))
    before = errors.where((F.col("ts") >= end - span - span) & (F.col("ts") < end - span)).select(*keys).distinct()
    out = fresh.join(before, keys, "left_anti").groupBy(*keys).agg(F.count(F.lit(1)).alias("occurrences"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    return out.orderBy(F.desc("occurrences"), *keys)


def long_operations(rows: DataFrame, least_us: int, window: Times | None = None, limit: int = 1000) -> DataFrame:
    """Trace records that took at least so many microseconds, the longest first."""
    found = within(rows, window, "ts", None).where(F.col("duration") >= least_us)
    return found.orderBy(F.desc("duration"), "ts", "record_hash").limit(limit)


def trace_events(rows: DataFrame, names: tuple[str, ...], window: Times | None = None) -> DataFrame:
    """Counts and times of some trace events, as of locks (``TLOCK``, ``TTIMEOUT``, ``TDEADLOCK``) or exceptions."""
    found = within(rows, window, "ts", None).where(F.col("name").isin(*names))
    return found.groupBy("name").agg(F.count(F.lit(1)).alias("events"), F.sum("duration").alias("total_duration"), F.max("duration").alias("max_duration")).orderBy("name")


def metrics_extended(metrics: DataFrame) -> DataFrame:
    """The latest metrics of every file with the total time and each part's share of it."""
    total = F.col("parsing_time_ms") + F.col("deduplication_time_ms") + F.col("writing_time_ms")
    share = lambda part: F.when(total > 0, F.round(F.col(part) * 100.0 / total, 2)).otherwise(0.0)
    return latest(metrics, FILE_KEY).select(
        "parser_type", "cluster_name", "infobase_name", "file_path", "start_time", "end_time", total.alias("total_time_ms"), "records_parsed", "records_per_second",
        "file_reading_time_ms", "record_parsing_time_ms", "deduplication_time_ms", "writing_time_ms", share("file_reading_time_ms").alias("file_reading_percentage"),
        share("record_parsing_time_ms").alias("parsing_percentage"), share("deduplication_time_ms").alias("deduplication_percentage"), share("writing_time_ms").alias("writing_percentage"),
    )


def total_times(metrics: DataFrame) -> DataFrame:
    return metrics_extended(metrics).select("file_path", "total_time_ms")


def recent_metrics(metrics: DataFrame, limit: int = 10) -> DataFrame:
    return metrics.orderBy(F.desc("timestamp"), "file_path").limit(limit)


def progress_share() -> Column:
    return F.when(F.col("file_size_bytes") > 0, F.round(F.col("offset_bytes") * 100.0 / F.col("file_size_bytes"), 2)).otherwise(0.0)


def progress_all(progress: DataFrame, parser: str = "event_log") -> DataFrame:
    rows = latest(progress, FILE_KEY).where(F.col("parser_type") == parser).orderBy(F.desc("updated_at"), "file_path")
    return rows.select("cluster_name", "infobase_name", "file_name", readable_size(F.col("file_size_bytes")).alias("file_size"), readable_size(F.col("offset_bytes")).alias("offset"), progress_share().alias("progress_percent"), "records_parsed", "last_timestamp", "updated_at")


def progress_one(progress: DataFrame, path: str) -> DataFrame:
    rows = latest(progress, FILE_KEY).where(F.col("file_path") == path).orderBy(F.desc("updated_at")).limit(1)
    size = {"file_size": F.col("file_size_bytes"), "offset": F.col("offset_bytes"), "remaining": F.col("file_size_bytes") - F.col("offset_bytes")}
    return rows.select("file_name", *(readable_size(c).alias(n) for n, c in size.items()), progress_share().alias("progress_percent"), "records_parsed", "last_timestamp", "updated_at")


def progress_largest(progress: DataFrame, parser: str = "event_log", limit: int = 10) -> DataFrame:
    rows = latest(progress, FILE_KEY).where((F.col("parser_type") == parser) & (progress_share() < 100))
    rows = rows.orderBy(F.desc("file_size_bytes"), "file_path").limit(limit)
    return rows.select("cluster_name", "infobase_name", "file_name", readable_size(F.col("file_size_bytes")).alias("file_size"), progress_share().alias("progress_percent"), "records_parsed", "updated_at")


def summary(rows: DataFrame, key: str = "infobase_name") -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("total_records"), F.min("event_time").alias("first_event"), F.max("event_time").alias("last_event")).orderBy(key)


def extract(rows: DataFrame, window: Times | None = None, infobase: str | None = None, size: int = 50) -> DataFrame:
    """Rows as a person compares them with the application's window: formatted times, cut texts, oldest first."""
    rows = within(rows if infobase is None else rows.where(F.col("infobase_name") == infobase), window)
    cut = {c: F.substring(c, 1, size) for c in ("comment", "data_presentation") if c in rows.columns}
    return rows.orderBy("event_time", "comment").select(F.date_format("event_time", "dd.MM.yyyy HH:mm:ss").alias("time"), "level", "event_presentation", "user_name", F.col("session_id").cast("string").alias("session"), *(c.alias(n) for n, c in cut.items()))


def probe(rows: DataFrame, column: str, pattern: str, at: str | None = None, limit: int = 5) -> DataFrame:
    """Some rows whose column is like a pattern, optionally at one time of day."""
    found = rows.where(F.col(column).like(pattern) & (F.col(column) != ""))
    if at is not None:
        found = found.where(F.date_format("event_time", "HH:mm:ss") == at)
    return found.orderBy("event_time", column).limit(limit)


def conditional_counts(rows: DataFrame, key: str = "infobase_name") -> DataFrame:
    counted = {"session_starts": F.col("event_presentation").like("%Сеанс.Начало%"), "session_ends": F.col("event_presentation").like("%Сеанс.Завершение%"), "file_loads": F.col("comment").like("%.dt%") | F.col("comment").like("%click%")}
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("total_records"), F.min("event_time").alias("first_event"), F.max("event_time").alias("last_event"), *(F.count_if(c).alias(n) for n, c in counted.items())).orderBy(key)


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    from functools import reduce

    parts = [df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)
