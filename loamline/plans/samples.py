"""Journals as files, written from the ``events`` table, so that the whole load can be run and checked.

A site has one cluster; every infobase has a journal of several ``.lgp`` files and a
dictionary, and the cluster has a registry.  Comments hold quotes, braces, commas, line
breaks and escaped quotes.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.journal import file_system

CLUSTER = "af4fcd7c-0a86-11e7-8e5a-00155d000b0b"
BASES = 5
EVENTS = {"error": "_$PerformError$_", "view": "_$Session$_.Start", "click": "_$Transaction$_.Begin", "signup": "_$User$_.New", "purchase": "_$User$_.Update"}
USERS = 1 << 14


def base_guid(number: int) -> str:
    return f"b8d1c34e-5f2e-11e9-80e4-00155d00000{number}"


def person_guid(number: int) -> str:
    return f"3f2504e0-4f89-11d3-9a0c-{number:012d}"


def thing_guid(number: int) -> str:
    return f"6fa459ea-ee8a-3ca4-894e-{number:012d}"


def folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share; in one process a temporary one if none is named."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        where = "file://" + tempfile.mkdtemp(prefix="loamline-")
    return f"{where.rstrip('/')}/site-{uuid.uuid4().hex[:12]}"


def records(events: DataFrame) -> DataFrame:
    """``base, part, event_id, record`` of every event; a record may span lines."""
    comment = F.concat(F.lit('Ошибка {'), F.col("event_id").cast("string"), F.lit('}, ""'), F.col("event_type"), F.lit('"" \\" конец,\nuser: user_'), F.col("user_id").cast("string"))
    hexed = lambda c: F.lower(F.hex(c))
    fields = {
        "time": F.date_format("ts", "yyyyMMddHHmmss"), "status": F.element_at(F.array(*map(F.lit, "UCRN")), (F.col("event_id") % 4 + 1).cast("int")),
        "transaction": F.when(F.col("event_id") % 4 == 3, "{0,0}").otherwise(F.concat(F.lit("{"), hexed((F.unix_seconds("ts") + 62_451_156_554) * 10_000), F.lit(","), hexed(F.col("event_id") + 1), F.lit("}"))),
        "user": F.col("user_id") % USERS + 1, "computer": F.col("user_id") % 9 + 1, "application": F.col("user_id") % 2 + 1, "connection": F.col("event_id") % 31,
        "event": F.array_position(F.array(*map(F.lit, EVENTS)), F.col("event_type")), "severity": F.element_at(F.array(*map(F.lit, "IEWN")), (F.col("event_id") % 4 + 1).cast("int")),
        "comment": F.concat(F.lit('"'), comment, F.lit('"')), "metadata": F.when(F.col("event_id") % 11 == 0, F.lit(0)).otherwise(F.col("user_id") % 20 + 1),
        "data": F.when(F.col("event_id") % 5 == 0, '{"U"}').when(F.col("event_id") % 5 == 1, F.concat(F.lit('{"B",'), (F.col("event_id") % 2).cast("string"), F.lit("}"))).otherwise(F.concat(F.lit('{"S","value, '), (F.col("event_id") % 13).cast("string"), F.lit('"}'))),
        "shown": F.concat(F.lit('"data '), (F.col("event_id") % 7).cast("string"), F.lit('"')), "server": F.lit("1"), "port": 1540 + F.col("user_id") % 2, "second": F.lit(0), "session": F.col("event_id") % 97,
    }
    record = F.concat(F.lit("{"), F.concat_ws(",", *(v.cast("string") for v in fields.values())), F.lit("}"))
    return events.select((F.col("user_id") % BASES).cast("int").alias("base"), (F.col("event_id") % 4).cast("int").alias("part"), "event_id", record.alias("record"))


def write_site(spark: SparkSession, sf_dir: str) -> str:
    """Writes the journals of all events and returns the site's folder."""
    root = folder(spark)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    system, where = file_system(root)

    def put(system, path: str, text: str) -> None:
        system.create_dir(path.rpartition("/")[0], recursive=True)
        with system.open_output_stream(path) as out:
            out.write(text.encode("utf-8"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """One file for each run of rows with the same journal and part; a repeated task writes the same files."""
        system, where = file_system(root)
        out, now, size = None, None, 0
        for batch in batches:
            for base, part, record in zip(batch["base"], batch["part"], batch["record"], strict=True):
                if (base, part) != now:
                    if out is not None:
                        out.close()
                    now, path = (base, part), f"{where}/reg_1541/{base_guid(base)}/1Cv8Log/2024010{part + 1}000000.lgp"
                    system.create_dir(path.rpartition("/")[0], recursive=True)
                    out = system.open_output_stream(path)
                    out.write(f"1CV8LOG(ver 2.0)\r\n{base_guid(base)}\r\n\r\n".encode())
                    between = ""
                out.write(f"{between}{record}".encode())
                between, size = ",\r\n", size + 1
        if out is not None:
            out.close()
        yield pd.DataFrame({"n": [size]})

    records(events).repartition("base", "part").sortWithinPartitions("base", "part", "event_id").mapInPandas(write, "n long").agg(F.sum("n")).collect()
    users = sorted(r[0] for r in events.select((F.col("user_id") % USERS + 1).alias("n")).distinct().collect())
    entries = [f'{{1,{person_guid(n)},"user_{n}",{n}}}' for n in users]
    entries += [f'{{2,"host{n}",{n}}}' for n in range(1, 10)] + ['{3,"1CV8C",1}', '{3,"Designer",2}']
    entries += [f'{{4,"{code}",{n}}}' for n, code in enumerate(EVENTS.values(), 1)] + [f'{{5,{thing_guid(n)},"Документ.Obj{n}",{n}}}' for n in range(1, 21)]
    bases = [f'{{{base_guid(k)},"base {k}","",{{}}}}' for k in range(BASES)]
    put(system, f"{where}/reg_1541/1CV8Clst.lst", f'{{0,{{{CLUSTER},"Main cluster",1541}},{{{len(bases)},' + ",".join(bases) + "}}")
    for k in range(BASES):
        put(system, f"{where}/reg_1541/{base_guid(k)}/1Cv8Log/1Cv8.lgf", f"1CV8LOG(ver 2.0)\r\n{base_guid(k)}\r\n\r\n" + ",\r\n".join(entries))
    return root


#: The columns that the load's queries compare.
SHOWN = (
    "event_time event_date cluster_guid cluster_name infobase_guid infobase_name level event event_presentation user_name user_id computer application application_presentation session_id connection "
    "transaction_status transaction_number transaction_datetime metadata_name metadata_presentation comment data data_presentation server primary_port secondary_port"
).split()


def site_sql(names: dict[str, dict[str, str]]) -> str:
    """The journals' table, selected from ``events`` in DuckDB's SQL; ``names`` are the presentations of codes."""

    def chosen(value: str, cases: dict) -> str:
        return f"case {value} " + " ".join(f"when {k} then '{v}'" for k, v in cases.items()) + " end"

    word = lambda v: f"'{v}'"
    return (
        "select date_trunc('second', ts) as event_time, cast(ts as date) as event_date, " + f"'{CLUSTER}' as cluster_guid, 'Main cluster' as cluster_name, 'b8d1c34e-5f2e-11e9-80e4-00155d00000' || cast(user_id % {BASES} as varchar) as infobase_guid, "
        f"'base ' || cast(user_id % {BASES} as varchar) as infobase_name, " + chosen("event_id % 4", dict(enumerate(names["severity"][k] for k in "IEWN"))) + " as level, "
        + chosen("event_type", {word(k): v for k, v in EVENTS.items()}) + " as event, " + chosen("event_type", {word(k): names["event"][v] for k, v in EVENTS.items()}) + " as event_presentation, "
        f"'user_' || cast(user_id % {USERS} + 1 as varchar) as user_name, '3f2504e0-4f89-11d3-9a0c-' || lpad(cast(user_id % {USERS} + 1 as varchar), 12, '0') as user_id, 'host' || cast(user_id % 9 + 1 as varchar) as computer, "
        "case when user_id % 2 = 0 then '1CV8C' else 'Designer' end as application, " + f"case when user_id % 2 = 0 then '{names['application']['1CV8C']}' else '{names['application']['Designer']}' end as application_presentation, "
        "event_id % 97 as session_id, cast(event_id % 31 as varchar) as connection, " + chosen("event_id % 4", dict(enumerate(names["status"][k] for k in "UCRN"))) + " as transaction_status, "
        "case when event_id % 4 = 3 then 0 else event_id + 1 end as transaction_number, case when event_id % 4 = 3 then timestamp '1980-01-01 00:00:00' else date_trunc('second', ts) end as transaction_datetime, "
        "case when event_id % 11 = 0 then '' else '6fa459ea-ee8a-3ca4-894e-' || lpad(cast(user_id % 20 + 1 as varchar), 12, '0') end as metadata_name, case when event_id % 11 = 0 then '' else 'Документ.Obj' || cast(user_id % 20 + 1 as varchar) end as metadata_presentation, "
        "'Ошибка {' || cast(event_id as varchar) || '}, \"\"' || event_type || '\"\" \\\" конец,' || chr(10) || 'user: user_' || cast(user_id as varchar) as comment, "
        "case event_id % 5 when 0 then '' when 1 then case when event_id % 2 = 0 then 'false' else 'true' end else 'value, ' || cast(event_id % 13 as varchar) end as data, "
        "'data ' || cast(event_id % 7 as varchar) as data_presentation, '1' as server, cast(1540 + user_id % 2 as int) as primary_port, cast(0 as int) as secondary_port from events"
    )
