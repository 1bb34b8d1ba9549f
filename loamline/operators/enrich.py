"""Dictionary and name joins of journal and trace rows, all against small dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import journal as fields
from ..functions import trace
from ..sources import journal, lines

#: A dimension is broadcast only if it was counted and has no more rows.
DIMENSION_ROWS = 500_000
#: Object types of a dictionary.
USERS, COMPUTERS, APPLICATIONS, EVENTS, METADATA = 1, 2, 3, 4, 5


def dimension(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if it is small; beyond that the join is shuffled."""
    return F.broadcast(df) if df.limit(DIMENSION_ROWS + 1).count() <= DIMENSION_ROWS else df


def held(df: DataFrame) -> DataFrame:
    """A dimension that several joins use, read once: its rows, if they are few, with a broadcast hint."""
    table = df.limit(DIMENSION_ROWS + 1).toArrow()
    return F.broadcast(df.sparkSession.createDataFrame(table)) if table.num_rows <= DIMENSION_ROWS else df


def with_dictionary(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """Decoded journal rows with ``*_value`` and ``*_uuid`` of their five kinds of numbers; 0 has none.

    Entries with an ``infobase`` are only those of rows with that ``infobase_guid``.
    """
    each = "infobase" in entries.columns
    entries = held(entries)
    if each:
        rows = rows.withColumn("infobase", F.lower("infobase_guid"))
    for name, kind in (("user", USERS), ("computer", COMPUTERS), ("application", APPLICATIONS), ("event", EVENTS), ("metadata", METADATA)):
        own = entries.where((F.col("object_type") == kind) & (F.col("number") > 0)).select(*(["infobase"] if each else []), F.col("number").alias(f"{name}_number"), F.col("value").alias(f"{name}_value"), F.col("uuid").alias(f"{name}_uuid"))
        rows = rows.join(own, [*(["infobase"] if each else []), f"{name}_number"], "left")
    return rows.drop("infobase") if each else rows


def with_names(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Cluster and infobase names by GUID in any case; unknown ones are ''.

    ``names``: cluster_guid, cluster_name, infobase_guid, infobase_name.
    """
    names = dimension(names)
    clusters = names.select(F.lower("cluster_guid").alias("c"), "cluster_name").dropDuplicates(["c"])
    bases = names.select(F.lower("cluster_guid").alias("c"), F.lower("infobase_guid").alias("i"), "infobase_name").dropDuplicates(["c", "i"])
    rows = rows.drop("cluster_name", "infobase_name").withColumns({"c": F.lower("cluster_guid"), "i": F.lower("infobase_guid")})
    rows = rows.join(clusters, "c", "left").join(bases, ["c", "i"], "left")
    return rows.withColumns({k: F.coalesce(k, F.lit("")) for k in ("cluster_name", "infobase_name")}).drop("c", "i")


def with_mapping(rows: DataFrame, names: DataFrame, guid: str, name: str) -> DataFrame:
    """``name`` from a mapping document's (guid, name); a GUID without one stands for itself."""
    mapped = dimension(names.select(F.col("guid").alias("g"), F.col("name").alias("n")))
    return rows.join(mapped, F.col(guid) == F.col("g"), "left").withColumn(name, F.coalesce("n", guid)).drop("g", "n")


def read_journal(spark: SparkSession, location: dict, strict: bool = False) -> DataFrame:
    """The journal's table for one of ``lines.journal_locations``: scanned, decoded, joined and named."""
    rows = journal.raw_records(spark, location["path"], strict)
    cluster = {"cluster_guid": "", "cluster_name": "", "infobase_name": ""}
    found = [p for p, _ in journal.files_under(location["registry"], "1cv8clst.lst")]
    if found:
        names = journal.registry(spark, found[0]).collect()
        own = [r for r in names if r.infobase_guid == location["infobase_guid"].lower()]
        if names:
            cluster = {"cluster_guid": names[0].cluster_guid, "cluster_name": names[0].cluster_name, "infobase_name": own[0].infobase_name if own else ""}
    rows = rows.withColumns({k: F.lit(v) for k, v in (cluster | {"infobase_guid": location["infobase_guid"]}).items()})
    dictionary = [p for p, _ in journal.files_under(location["path"], "1cv8.lgf")]
    return fields.journal_records(with_dictionary(fields.decoded(rows), journal.dictionary(spark, dictionary[0])))


def read_journals(spark: SparkSession, locations: list[dict], strict: bool = False) -> DataFrame:
    """``read_journal`` of many locations (in one file system) in one pass: one scan, one dictionary, one table of names.

    Infobases are told by their folders; each takes names from the registry above it.
    """
    rows = journal.raw_records(spark, [x["path"] for x in locations], strict).withColumn("infobase_guid", F.regexp_extract("path", r"([^/\\]*)[/\\][^/\\]*[/\\][^/\\]*$", 1))
    named: dict[str, list] = {}
    for folder in sorted({x["registry"] for x in locations}):
        found = [p for p, _ in journal.files_under(folder, "1cv8clst.lst")]
        named[folder] = journal.registry(spark, found[0]).collect() if found else []
    names = []
    for x in locations:
        known = named[x["registry"]]
        own = {r.infobase_guid: r.infobase_name for r in known}.get(x["infobase_guid"].lower(), "")
        names.append((x["infobase_guid"], known[0].cluster_guid if known else "", known[0].cluster_name if known else "", own))
    table = dimension(spark.createDataFrame(names, "infobase_guid string, cluster_guid string, cluster_name string, infobase_name string").distinct())
    dictionary = journal.dictionary(spark, [journal.files_under(x["path"], "1cv8.lgf")[0][0] for x in locations], by_infobase=True)
    return fields.journal_records(with_dictionary(fields.decoded(rows.join(table, "infobase_guid", "left")), dictionary))


def read_trace(spark: SparkSession, path: str, names: DataFrame | None = None, join_lines: bool = False) -> DataFrame:
    """The trace log's table from every log file under a folder; optionally with lines of a record joined."""
    text = lines.trace_lines(spark, path)
    if join_lines:
        text = lines.joined_lines(text.withColumn("at", F.monotonically_increasing_id()), "at")
    rows = trace.tech_records(text)
    return rows if names is None else with_names(rows, names).select(rows.columns)
