"""SHA-1 row hashes over the fields that identify a row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import utc_text

#: The hashed fields in order; names ending in ``_time`` or ``ts`` are times.
EVENT_FIELDS = (
    "event_time cluster_guid infobase_guid level event event_presentation user_name computer application session_id connection_id transaction_status transaction_id transaction_datetime "
    "transaction_number data_separation metadata_name metadata_presentation comment data data_presentation server primary_port secondary_port"
).split()
TECH_FIELDS = (
    "ts duration name level depth process os_thread client_id session_id transaction_id usr app_id connection_id interface method call_id cluster_guid infobase_guid raw_line sql plan_sql_text rows "
    "rows_affected dbms database dbpid db_copy n_params mdx db_conn_id db_conn_str db_usr query sdbl query_fields exception exception_descr exception_context func line file module os_exception locks "
    "regions wait_connections lka lkp lkpid lkaid lksrc lkpto lkato deadlock_connection_intersections server port sync_port connection session_nmb seance_id proc_id pid process_name finish exit_code "
    "m_name i_name dst_client_id ret_excp memory memory_peak duration_us host val err calls in_bytes out_bytes"
).split()
TIMES = {"event_time", "transaction_datetime", "ts"}


def row_hash(fields: list[str], properties: Column) -> Column:
    """Hex SHA-1 of every field's text and a bar, then of the properties (a map) by key."""
    parts = [F.coalesce(utc_text(F.col(f)) if f in TIMES else F.col(f).cast("string"), F.lit("")) for f in fields]
    pairs = F.transform(F.array_sort(F.map_entries(properties)), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")), F.lit("|")))
    return F.sha1(F.concat(*(x for p in parts for x in (p, F.lit("|"))), F.coalesce(F.array_join(pairs, ""), F.lit(""))))
