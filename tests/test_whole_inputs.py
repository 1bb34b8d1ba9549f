"""Queries and finite runs that must take all of their input."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader

from __spark_entry__ import queries
from loamline.operators import compare
from loamline.plans import tools
from loamline.sources import journal
from loamline.streaming import tail

from .test_engine import HEAD, START

LINE = START.replace("\n", "")

SF = "/root/testdata/sf0.001"


def test_every_event_is_compared(spark):
    events = spark.read.parquet(f"{SF}/events.parquet")
    got = queries()["compare_by_place"](spark, SF).collect()
    assert len(got) == events.count() and {r.place for r in got} == set(range(1, len(got) + 1))
    assert sum(r.status == "missing" for r in got) == events.where("event_id % 3 = 1 and event_id >= 5000").count()


@pytest.fixture(scope="module")
def many_errors(spark, tmp_path_factory):
    """More events of one kind in one infobase than an answer of the tools may have."""
    where = tmp_path_factory.mktemp("errors")
    stamp = F.timestamp_seconds(F.lit(1_704_100_000) + F.col("id")).cast("timestamp_ntz")
    rows = spark.range(tools.MOST + 500).select(F.col("id").alias("event_id"), stamp.alias("ts"), F.lit(0).cast("long").alias("user_id"), F.lit("error").alias("event_type"), F.lit(1.5).alias("value"), F.lit("{}").alias("props"))
    rows.write.parquet(f"{where}/events.parquet")
    return str(where)


@pytest.mark.parametrize("name", ["tool_tech_log_full", "tool_tech_log_minimal"])
def test_every_trace_row_in_scope_is_returned(spark, many_errors, name):
    got = queries()[name](spark, many_errors)
    assert got.agg(F.count("ts"), F.countDistinct("ts")).first()[:] == (tools.MOST + 500,) * 2


def test_numbering_loses_no_row(spark):
    rows = spark.range(300_000).select(F.when(F.col("id") % 1000 > 0, F.col("id")).alias("k"), F.repeat(F.lit("x"), 40).alias("v"))
    found = compare.numbered(rows, ["k"]).agg(F.count("place"), F.min("place"), F.max("place"), F.countDistinct("place")).first()
    assert tuple(found) == (300_000, 1, 300_000, 300_000)
    wrong = compare.numbered(rows.where("k is not null"), ["k"]).where("place <> k - floor(k / 1000)")
    assert wrong.count() == 0 and compare.numbered(rows.limit(0), ["k"]).count() == 0


def test_every_line_is_judged(spark):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_returnflag").collect()
    keys = [set(), set()]
    for r in lines:
        keys[r.l_orderkey % 97 != 0].add((r.l_orderkey % 500, r.l_partkey % 10, r.l_returnflag))
    assert queries()["dedup_against_stored"](spark, SF).count() == len(keys[1] - keys[0])


@pytest.mark.parametrize("kind", ["journal", "tracelog"])
def test_a_run_that_ends_reads_files_beyond_its_bytes_at_once(spark, tmp_path, kind):
    big = LINE.replace('""', '"' + "x" * 5000 + '"', 1)
    records = [big if k % 7 == 3 else LINE for k in range(40)]
    if kind == "journal":
        (tmp_path / "20251113000000.lgp").write_text(HEAD + ",\r\n".join(records) + ",\r\n{2025", encoding="utf-8", newline="")
    else:
        (tmp_path / "25011408.log").write_text("\n".join(records) + "\n45:32", encoding="utf-8")
    for source in (journal.JournalSource, tail.LogSource):
        spark.dataSource.register(source)
    counts = []
    rows = spark.readStream.format(kind).option("maxbytesperfile", 400).option("untilend", True).load(str(tmp_path))
    query = rows.writeStream.foreachBatch(lambda batch, _: counts.append(batch.count())).option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start()
    assert query.awaitTermination(120) and query.exception() is None
    assert sum(counts) == len(records)


@pytest.mark.parametrize("stream, ending", [(journal.JournalStream, "lgp"), (tail.LogStream, "log")])
def test_a_record_longer_than_a_batch_is_passed(tmp_path, monkeypatch, stream, ending):
    monkeypatch.setattr(tail, "BACK", 16)
    head = HEAD if ending == "lgp" else ""
    file = tmp_path / f"a.{ending}"
    file.write_text(head + LINE[:-1] + "y" * 3000 + "}\n" + LINE + "\n", encoding="utf-8", newline="")
    follows = stream({"path": str(tmp_path), "maxbytesperfile": "100"})
    seen = [json.loads(follows.latestOffset()["files"])[str(file)] for _ in range(5)]
    assert 3000 < seen[0] <= seen[-1] and seen[-1] >= file.stat().st_size - 1


@pytest.mark.parametrize("follow", [True, False])
def test_runs_that_end_ask_for_all(spark, tmp_path, monkeypatch, follow):
    asked, option = [], DataStreamReader.option
    monkeypatch.setattr(DataStreamReader, "option", lambda self, key, value: asked.append((key, value)) or option(self, key, value))
    monkeypatch.setattr(tail, "_start", lambda *_: None)
    tail.follow_traces(spark, str(tmp_path), "t", "c", follow=follow)
    tail.follow_journal(spark, {"path": str(tmp_path), "infobase_guid": ""}, "t", "c", follow=follow)
    assert asked == [("untilend", not follow)] * 2
