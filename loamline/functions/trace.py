"""Trace-log lines (plain, hourly and JSON) and their properties as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import NEVER_KEPT, PROMOTED, TECH_LOG, UNFILLED, columns
from .rowhash import TECH_FIELDS, row_hash
from .text import bound, line_fingerprint, trimmed, unsigned

#: key=value with a value in double or single quotes (doubled inside) or up to a comma; an
#: unterminated quote takes the rest of the line and counts as empty.  Nothing is tried twice,
#: so that values of any length pass.
PROPERTY = r"""([^=]*+)=("[^"]*+(?:""[^"]*+)*+"|'[^']*+(?:''[^']*+)*+'|["'][\s\S]*+|[^,]*+),?"""
GUID = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def properties(text: Column) -> Column:
    """The property list of a line as a map; the last of repeated keys counts.

    Two passes over the line give all keys and all values as they are written.
    """

    def value(raw: Column) -> Column:
        def quoted(mark: str) -> Column:
            inner = F.substring(raw, F.lit(2), F.length(raw) - 2)
            # Of an unterminated value that ends with a quote, one without its pair is left.
            whole = (F.length(raw) > 1) & F.endswith(raw, F.lit(mark)) & ~F.contains(F.replace(inner, F.lit(mark * 2), F.lit("")), F.lit(mark))
            return F.when(whole, F.replace(inner, F.lit(mark * 2), F.lit(mark))).otherwise("")

        return F.when(F.startswith(raw, F.lit('"')), quoted('"')).when(F.startswith(raw, F.lit("'")), quoted("'")).otherwise(trimmed(raw))

    keys = F.transform(F.regexp_extract_all(text, F.lit(PROPERTY), F.lit(1)), trimmed)
    values = F.transform(F.regexp_extract_all(text, F.lit(PROPERTY), F.lit(2)), value)
    return F.map_filter(last_wins(keys, values), lambda k, v: k != "")


def last_wins(keys: Column, values: Column) -> Column:
    """A map of keys and values; independent of the session's policy for repeated keys."""

    def picked(all_: Column) -> Column:
        def reduced(entries: Column) -> Column:
            last = F.filter(entries, lambda e, i: F.array_position(F.slice(all_, i + 2, F.size(all_)), e["k"]) == 0)
            return F.map_from_entries(last)

        entries = F.zip_with(all_, values, lambda k, v: F.struct(k.alias("k"), v.alias("v")))
        once = F.size(F.array_distinct(all_)) == F.size(all_)
        return F.when(once, F.map_from_arrays(all_, values)).otherwise(reduced(entries))

    return bound(keys, picked)


def plain_stamp(head: Column) -> tuple[Column, Column]:
    """Time and duration of ``2024-01-31T10:20:30.000001-15``; null where either is malformed."""
    time = F.regexp_extract(head, r"^(.*)-([^-]*)$", 1)
    exact = time.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{6}$")
    return F.when(exact, time.try_cast("timestamp")), unsigned(F.regexp_extract(head, r"-([^-]*)$", 1), "u64")


def hourly_stamp(head: Column, hour: Column) -> tuple[Column, Column]:
    """Time and duration of ``45:31.831006-1`` within a file's hour; the fraction is a number of microseconds."""
    pattern = r"^(\d{1,9}):(\d{1,9})\.(\d{1,9})-(\d+)$"
    minute, second, micro = (F.regexp_extract(head, pattern, k).try_cast("bigint") for k in (1, 2, 3))
    micros = F.unix_micros(hour) + (minute * 60 + second) * 1_000_000 + micro
    return F.timestamp_micros(micros), unsigned(F.regexp_extract(head, pattern, 4), "u64")


def is_plain(line: Column) -> Column:
    """Whether a line starts with a whole date; others start with minutes of their file's hour."""
    return line.rlike(r"^\d{4}-\d{2}-\d{2}T")


def file_hour(name: Column) -> Column:
    """The hour in a file's name, its first eight digits ``yyMMddHH``; null if it has none."""
    digits = F.regexp_extract(F.regexp_replace(name, r"\.(log|zip|gz)$", ""), r"(\d{8})", 1)
    return F.try_to_timestamp(F.concat(F.lit("20"), digits), F.lit("yyyyMMddHH"))


def guids_of(path: Column) -> Column:
    """``cluster`` and ``infobase`` of a path: its last two directories that are GUIDs; empty if there are fewer."""
    found = F.filter(F.split(F.lower(path), r"[/\\]"), lambda part: (F.length(part) == 36) & part.rlike(GUID))

    def last_two(guids: Column) -> Column:
        both = F.size(guids) >= 2
        return F.struct(*(F.when(both, F.try_element_at(guids, F.lit(k))).otherwise("").alias(n) for k, n in ((-2, "cluster"), (-1, "infobase"))))

    return bound(found, last_two)


def path_guids(path: Column) -> tuple[Column, Column]:
    both = guids_of(path)
    return both["cluster"], both["infobase"]


def coerced(raw: Column, kind: str) -> Column:
    if kind in ("u8", "u32", "u64"):
        return unsigned(raw, kind)
    if kind in ("i32", "i64"):
        return F.when(raw.rlike("^[+-]?[0-9]+$"), raw).try_cast("int" if kind == "i32" else "bigint")
    if kind == "flag":
        return F.when(raw.isin("1", "t", "T", "TRUE", "true", "True"), F.lit(1)).cast("smallint")
    if kind == "time":
        time = F.coalesce(F.try_to_timestamp(raw), F.lit("1925-01-01").cast("timestamp"))
        inside = time.between(F.lit("1925-01-01").cast("timestamp"), F.lit("2283-11-11").cast("timestamp"))
        return F.when(inside, time).otherwise(F.lit("1925-01-01").cast("timestamp"))
    return raw


def promoted(props: Column, name: Column) -> dict[str, Column]:
    """A column for every promoted property of the map ``props``; missing ones are '' or 0."""
    out = {}
    for p in PROMOTED:
        raw = F.coalesce(*(F.element_at(props, k) for k in p.keys))
        if p.events:
            raw = F.when(name.isin(*p.events), raw)
        elif p.elsewhere:
            other = sorted({e for q in PROMOTED if q.events and set(q.keys) & set(p.keys) for e in q.events})
            raw = F.when(~name.isin(*other), raw)
        value = coerced(raw, p.kind)
        out[p.column] = F.coalesce(value, F.lit("")) if p.kind == "text" else value if p.kind == "time" else F.coalesce(value, F.lit(0).cast({"flag": "smallint", "u8": "smallint", "i32": "int"}.get(p.kind, "bigint")))
    return out


KNOWN_KEYS = sorted({k for p in PROMOTED for k in p.keys} | NEVER_KEPT)
JSON_CORE = ["ts", "duration", "name", "depth"]


def split_lines(lines: DataFrame) -> DataFrame:
    """Lines (value, path) as ts, duration, name, depth, props; malformed ones are dropped.

    Each line is told by its first character: JSON objects have one.  A text line is cut
    at its first commas; properties are parsed apart from that, so that rows which a filter
    on time or name drops are dropped before.
    """
    text = F.regexp_replace("value", "^\ufeff", "")
    rows = lines.withColumn("json", text.startswith("{"))
    whole = F.when(F.col("json"), F.from_json(text, "map<string,string>"))
    rows = rows.withColumns({"all": last_wins(F.map_keys(whole), F.map_values(whole)), "parts": F.split("value", ",", 3)})
    # Fields of JSON lines; a null value counts as none.
    item = lambda k: F.element_at("all", F.lit(k))
    json_stamp = F.when(item("ts").rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{6}$"), item("ts").try_cast("timestamp"))
    # Fields of text lines; the third part starts with the depth.
    head, rest = F.get("parts", F.lit(0)), F.get("parts", F.lit(2))
    stamp, took = plain_stamp(head)
    in_hour, its = hourly_stamp(head, file_hour(F.regexp_extract("path", r"([^/\\]*)$", 1)))
    plain = is_plain(F.col("value"))
    either = lambda a, b: F.when(F.col("json"), a).otherwise(b)
    rows = rows.withColumns({
        "ts": either(json_stamp, F.when(plain, stamp).otherwise(in_hour)),
        "duration": either(F.when(item("duration").isNull(), F.lit(0)).otherwise(unsigned(item("duration"), "u64")), F.when(plain, took).otherwise(its)),
        "name": either(F.coalesce(item("name"), F.lit("")), F.get("parts", F.lit(1))),
        "depth": either(F.coalesce(unsigned(item("depth"), "u8"), F.lit(0).cast("smallint")), unsigned(F.substring_index(rest, ",", 1), "u8")),
    })
    rows = rows.where(F.col("ts").isNotNull() & F.col("duration").isNotNull() & F.col("depth").isNotNull())
    own = F.map_filter("all", lambda k, v: v.isNotNull() & ~k.isin(*JSON_CORE))
    listed = F.when(F.contains(rest, F.lit(",")), properties(F.substring(rest, F.instr(rest, ",") + 1, F.length(rest))))
    return rows.withColumn("props", either(own, listed)).drop("json", "all", "parts")


def tech_records(lines: DataFrame) -> DataFrame:
    """The trace log's table from lines: value, path, file and a frame's name columns.

    ``lines`` has value and path; optionally cluster_name and infobase_name.  The layout is
    told by a line's first character.  Rows are hashed and fingerprinted.
    """
    for name in ("cluster_name", "infobase_name"):
        if name not in lines.columns:
            lines = lines.withColumn(name, F.lit(""))
    base = lines.select("value", "path", guids_of(F.col("path")).alias("guids"), "cluster_name", "infobase_name")
    guids = [F.col(f"guids.{n}").alias(f"{n}_guid") for n in ("cluster", "infobase")]
    return completed(split_lines(base).select("ts", "duration", "name", "depth", "props", *guids, "cluster_name", "infobase_name", F.col("value").alias("raw_line")))


def completed(rows: DataFrame) -> DataFrame:
    """All columns of the table from the core ones and the property map."""
    rows = rows.withColumn("props", F.coalesce("props", F.create_map().cast("map<string,string>")))
    props = F.col("props")
    rest = F.map_filter(props, lambda k, v: ~k.isin(*KNOWN_KEYS))
    sorted_rest = F.array_sort(F.map_entries(rest))
    wide = rows.select("*", *(c.alias(n) for n, c in promoted(props, F.col("name")).items()), *(F.lit("" if t == "string" else 0).cast(t).alias(c) for c, t in UNFILLED.items()), rest.alias("rest"))
    # A duration among the properties replaces that of the stamp.
    stated = unsigned(F.coalesce(F.element_at("props", "Durationus"), F.element_at("props", "Duration")), "u64")
    wide = wide.withColumn("duration", F.coalesce(stated, "duration"))
    wide = wide.withColumns({
        "property_key": F.transform(sorted_rest, lambda e: e["key"]), "property_value": F.transform(sorted_rest, lambda e: e["value"]),
        "record_hash": row_hash(TECH_FIELDS, F.col("rest")), "raw_line_normalized": line_fingerprint(F.col("raw_line")),
    })
    return wide.select(columns(TECH_LOG))
