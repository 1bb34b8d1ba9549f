"""The query tools: journal rows, trace rows, and the last time that is stored."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import utc_text
from ..lookups import level_spellings
from .boards import within

MINIMAL_EVENT = ["event_time", "level", "event_presentation", "user_name", "comment", "metadata_presentation"]
FULL_EVENT = "event_time cluster_guid cluster_name infobase_guid infobase_name level event event_presentation user_name user_id computer application application_presentation session_id connection_id transaction_status transaction_id data_separation metadata_name metadata_presentation comment data data_presentation server primary_port secondary_port event_date".split()
MINIMAL_TECH = ["ts", "duration", "name", "level", "depth", "process", "os_thread", "session_id", "usr", "interface"]
FULL_TECH = [*MINIMAL_TECH, "raw_line"]
DEFAULT_LIMIT, MOST = 1000, 10_000


def bounded(limit: int | None) -> int:
    return DEFAULT_LIMIT if not limit or limit < 0 else min(limit, MOST)


def scoped(rows: DataFrame, cluster: str, infobase: str, window: tuple[datetime | str, datetime | str], time: str) -> DataFrame:
    own = rows.where((F.col("cluster_guid") == cluster) & (F.col("infobase_guid") == infobase))
    return within(own, (str(window[0]), str(window[1])), time)


def event_log(rows: DataFrame, cluster: str, infobase: str, window, level: str | None = None, mode: str = "minimal", limit: int | None = None) -> DataFrame:
    """The latest journal rows of an infobase in a time window; a level is found in either language."""
    found = scoped(rows, cluster, infobase, window, "event_time")
    if level:
        found = found.where(F.col("level").isin(level_spellings(level)))
    return found.orderBy(F.desc("event_time"), "record_hash").limit(bounded(limit)).select(FULL_EVENT if mode == "full" else MINIMAL_EVENT)


def tech_scope(rows: DataFrame, cluster: str, infobase: str, window, name: str | None = None) -> DataFrame:
    found = scoped(rows, cluster, infobase, window, "ts")
    return found.where(F.col("name") == name) if name else found


def tech_rows(rows: DataFrame, cluster: str, infobase: str, window, name: str | None = None, mode: str = "minimal") -> DataFrame:
    """All trace rows of an infobase in a time window, in no order; only the full mode reads whole lines."""
    return tech_scope(rows, cluster, infobase, window, name).select(FULL_TECH if mode == "full" else MINIMAL_TECH)


def tech_log(rows: DataFrame, cluster: str, infobase: str, window, name: str | None = None, mode: str = "minimal", limit: int | None = None) -> DataFrame:
    """The latest of ``tech_rows``, as many as an answer of the tool may have."""
    found = tech_scope(rows, cluster, infobase, window, name)
    return found.orderBy(F.desc("ts"), "record_hash").limit(bounded(limit)).select(FULL_TECH if mode == "full" else MINIMAL_TECH)


def actual_timestamp(rows: DataFrame, infobase: str, time: str = "event_time") -> DataFrame:
    """``max_timestamp, has_data`` of an infobase; without rows null and false."""
    last = rows.where(F.col("infobase_guid") == infobase).agg(F.max(time).alias("last"))
    return last.select(utc_text(F.col("last")).alias("max_timestamp"), F.col("last").isNotNull().alias("has_data"))
