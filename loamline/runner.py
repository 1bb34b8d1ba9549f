"""Ingest as a whole: find journals and trace logs, follow or read them, keep the tables in bounds."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from .config import Settings
from .operators import store
from .sources import journal, lines
from .streaming import tail


def journal_names(spark: SparkSession, location: dict) -> dict:
    """Cluster and infobase names of a journal's location, from the registry above it."""
    names = {"cluster_guid": "", "cluster_name": "", "infobase_name": ""}
    for path, _ in journal.files_under(location["registry"], "1cv8clst.lst")[:1]:
        for row in journal.registry(spark, path).toLocalIterator():
            names |= {"cluster_guid": row.cluster_guid, "cluster_name": row.cluster_name}
            if row.infobase_guid == location["infobase_guid"].lower():
                names["infobase_name"] = row.infobase_name
    return names


def mapped_names(spark: SparkSession, path: str) -> DataFrame | None:
    """``cluster_guid, cluster_name, infobase_guid, infobase_name`` of the mapping document; None without one."""
    system, where = journal.file_system(path)
    if system.get_file_info(where).type.name != "File":
        return None
    with system.open_input_stream(where) as file:
        document = lines.read_mapping(file.read().decode("utf-8"))
    clusters = document.get("clusters") or {}
    rows = [(cluster := (entry or {}).get("cluster_guid", ""), (clusters.get(cluster) or {}).get("name", cluster), base, (entry or {}).get("name") or base) for base, entry in (document.get("infobases") or {}).items()]
    return spark.createDataFrame(rows, "cluster_guid string, cluster_name string, infobase_guid string, infobase_name string")


def start(spark: SparkSession, settings: Settings) -> list[StreamingQuery]:
    """A stream for every journal and every trace folder; with ``read_only`` they end when all is read."""
    follow, queries = not settings.read_only, []
    how = {"deduplicate": settings.deduplicate, "retry": {"attempts": settings.retry_attempts, "first": settings.retry_first_ms / 1000, "factor": settings.retry_factor, "most": settings.retry_most_ms / 1000}}
    names = mapped_names(spark, settings.cluster_map)
    for location in lines.journal_locations(settings.log_dirs):
        mark = f"{settings.lake}/_checkpoints/journal-{location['infobase_guid']}"
        queries.append(tail.follow_journal(spark, location, f"{settings.lake}/event_log", mark, journal_names(spark, location), follow, **how))
    for root in settings.trace_dirs:
        for place in lines.trace_locations(root):
            mark = f"{settings.lake}/_checkpoints/trace-{place['cluster_guid']}-{place['infobase_guid']}"
            queries.append(tail.follow_traces(spark, place["path"], f"{settings.lake}/tech_log", mark, names, follow, **how))
    return queries


def keep(spark: SparkSession, settings: Settings, today: Callable[[], date] = date.today) -> dict[str, list[str]]:
    """Drops the days that are older than the retention; the days dropped from each table."""
    oldest = (today() - timedelta(days=settings.retention_days)).isoformat()
    out = {}
    for table, (day, _) in store.LAYOUT.items():
        path = f"{settings.lake}/{table}"
        if journal.file_system(path)[0].get_file_info(journal.file_system(path)[1]).type.name == "Directory":
            out[table] = store.drop_days(spark, path, day, lambda d: d >= oldest)
    return out
