"""The event journal's fields, from a record's tokens to typed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lookups import APPLICATION, SEVERITY, TRANSACTION_STATUS, event_shown, shown
from ..schemas import EVENT_LOG, columns
from .rowhash import EVENT_FIELDS, row_hash
from .text import comment_fingerprint, trimmed, unsigned

#: Seconds that a stored transaction time is ahead of Unix time, as the format's readers have it.
EPOCH_SHIFT = 62_451_156_554
ZERO_GUID = "00000000-0000-0000-0000-000000000000"
NO_TRANSACTION = "1980-01-01 00:00:00"


def token(k: int) -> Column:
    return F.coalesce(F.get("tokens", F.lit(k)), F.lit(""))


def unquoted(text: Column) -> Column:
    """Without one pair of quotes around the whole; doubled quotes inside stay."""
    return F.regexp_replace(trimmed(text), r'(?s)^"(.*)"$', "$1")


def number(text: Column) -> Column:
    plain = trimmed(text)
    return F.coalesce(F.when(plain.rlike(r"^[+-]?\d{1,18}$"), plain).try_cast("bigint"), F.lit(0))


def journal_time(text: Column) -> Column:
    return F.when(text.rlike(r"^\d{14}$"), F.try_to_timestamp(text, F.lit("yyyyMMddHHmmss")))


def transaction(text: Column) -> tuple[Column, Column]:
    """Time and number of ``{hex ten-thousandths of a second, hex number}``; null without a transaction."""
    pattern = r"^\s*\{?\s*([0-9A-Fa-f]+)\s*,\s*([0-9A-Fa-f]+)\s*\}?\s*$"
    when, n = (F.conv(F.regexp_extract(text, pattern, k), 16, 10).try_cast("bigint") for k in (1, 2))
    return F.when(when > 0, F.timestamp_seconds(F.floor(when / 10_000) - EPOCH_SHIFT)), F.when(when > 0, n)


def data_shown(text: Column, items: Column) -> Column:
    """A ``{type,value}`` field: strings and references as they are, flags as words, lists item by item.

    ``items`` holds the (type, value) pairs of a list, which the record's scanner cuts.
    """
    inner = F.regexp_replace(trimmed(text), r"(?s)^\{(.*)\}$", "$1")
    kind = F.replace(trimmed(F.regexp_extract(inner, r"(?s)^([^,]*),?", 1)), F.lit('"'), F.lit(""))
    value = F.regexp_extract(inner, r"(?s)^[^,]*,(.*)$", 1)
    one = lambda k, v: F.when(k.isin("R", "S"), unquoted(v)).when(k == "B", F.when(trimmed(v) == "0", "false").otherwise("true")).otherwise("")
    listed = F.transform(items, lambda e, i: F.struct((i + 1).alias("n"), one(e["kind"], e["value"]).alias("text")))
    lines = F.transform(F.filter(listed, lambda e: e["text"] != ""), lambda e: F.concat(F.lit("Item "), e["n"].cast("string"), F.lit(": "), e["text"]))
    return F.when(kind == "P", F.coalesce(F.array_join(lines, "\n"), F.lit(""))).otherwise(one(kind, value))


def decoded(records: DataFrame) -> DataFrame:
    """Records (tokens, items, the four names) with every field that needs no dictionary.

    Records with fewer than nine tokens or without a valid time are dropped.
    """
    when, n = transaction(token(2))
    session = unsigned(trimmed(token(16)), "u64")
    port = lambda k: F.when(number(token(k)).between(0, 65535), number(token(k))).otherwise(0).cast("int")
    rows = records.where(F.size("tokens") >= 9).withColumn("event_time", journal_time(token(0))).where("event_time is not null")
    return rows.withColumns({
        "event_date": F.to_date("event_time"), "transaction_status": shown(token(1), TRANSACTION_STATUS),
        "transaction_datetime": F.coalesce(when, F.lit(NO_TRANSACTION).cast("timestamp")), "transaction_number": F.coalesce(n, F.lit(0)),
        "user_number": number(token(3)), "computer_number": number(token(4)), "application_number": number(token(5)),
        "connection": unquoted(token(6)), "event_number": number(token(7)), "level": shown(token(8), SEVERITY),
        "comment": unquoted(token(9)), "metadata_number": number(token(10)), "data": data_shown(token(11), F.col("items")),
        "data_presentation": unquoted(token(12)), "server": token(13), "primary_port": port(14), "secondary_port": port(15),
        "session_id": F.coalesce(session, F.lit(0)), "session_string": F.when(session.isNull() & (token(16) != ""), token(16)),
    })


def journal_records(rows: DataFrame) -> DataFrame:
    """The journal's table from decoded rows whose dictionary values (user, computer, ...) were joined."""
    text = lambda *cols: F.coalesce(*cols, F.lit(""))
    given = lambda c: F.when(F.col(c) != "", F.col(c))
    props = F.map_filter(F.create_map(F.lit("user_id"), token(3), F.lit("computer_id"), token(4), F.lit("metadata_id"), token(10), F.lit("session_string"), F.col("session_string")), lambda k, v: v.isNotNull() & (v != ""))
    application = F.coalesce(given("application_value"), unquoted(token(5)))
    event = unquoted(F.coalesce(given("event_value"), token(7)))
    rows = rows.withColumns({
        "user_name": text(given("user_value"), given("user_uuid")), "user_id": F.coalesce(F.lower(given("user_uuid")), F.lit(ZERO_GUID)), "computer": text(given("computer_value")),
        "application": application, "application_presentation": shown(application, APPLICATION), "event": event, "event_presentation": event_shown(event),
        "metadata_name": text(given("metadata_uuid"), given("metadata_value")), "metadata_presentation": text(given("metadata_value")),
        "connection_id": F.col("transaction_number"), "transaction_id": F.col("transaction_number").cast("string"), "data_separation": F.lit(""), "properties": props,
    })
    error = F.col("level").isin("Error", "Ошибка") & (F.col("comment") != "")
    entries = F.array_sort(F.map_entries("properties"))
    rows = rows.withColumns({
        "props_key": F.transform(entries, lambda e: e["key"]), "props_value": F.transform(entries, lambda e: e["value"]), "record_hash": row_hash(EVENT_FIELDS, F.col("properties")),
        "comment_normalized": F.when(error, comment_fingerprint(F.col("comment"))).otherwise(""),
    })
    return rows.select(columns(EVENT_LOG))
