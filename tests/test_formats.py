"""Edges of the two formats: escapes in quotes, foreign files, long and odd trace lines."""

import json

import pytest
from pyspark.sql import functions as F

from loamline.functions import trace
from loamline.operators import compare
from loamline.plans import boards, registry
from loamline.sources import framing, journal

HEAD = "1CV8LOG(ver 2.0)\nd723aefd-7992-420d-b5f9-a273fd4146be\n\n"


def line(k, comment):
    return "{2024010112%02d00,N,\n{0,0},1,1,1,5,1,I,%s,0,{\"U\"},\"\",1,1560,0,%d}" % (k % 60, comment, k)


def test_a_backslash_takes_the_next_character_along():
    data = (HEAD + ",\n".join([line(1, r'"a \" } b"'), line(2, r'"path \\"'), line(3, '"doubled "" } quote"'), line(4, '""')])).encode()
    found = [framing.record_row(r) for _, r in framing.records(data, framing.body_start(data))]
    assert [x[0][16] for x in found] == ["1", "2", "3", "4"]
    assert [x[0][9] for x in found] == [r'"a \" } b"', r'"path \\"', '"doubled "" } quote"', '""']
    plain = (HEAD + ",\n".join([line(1, '"C:\\"'), line(2, '"x"')])).encode()
    assert [framing.record_row(r, escapes=False)[0][16] for _, r in framing.records(plain, framing.body_start(plain), escapes=False)] == ["1", "2"]
    assert len(list(framing.records(b"{1,\\{2}}", 0))) == 1


def test_files_that_are_no_journals_are_skipped(spark, tmp_path):
    (tmp_path / "20240101000000.lgp").write_text(HEAD + line(1, '"one \\" {"') + ",\n" + line(2, '"two"'), encoding="utf-8")
    (tmp_path / "20240102000000.lgp").write_bytes(b"\x00\x01 something else {1,2}")
    (tmp_path / "20240103000000.lgp").write_bytes(b"")
    rows = journal.raw_records(spark, str(tmp_path)).collect()
    assert sorted(r.tokens[16] for r in rows) == ["1", "2"]
    spark.dataSource.register(journal.JournalSource)
    stream = spark.readStream.format("journal").option("untilend", "true").option("maxbytesperfile", 40).load(str(tmp_path))
    query = stream.writeStream.format("memory").queryName("odd").option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert spark.table("odd").count() == 2


def properties_of(spark, text):
    return spark.createDataFrame([(text,)], "v string").select(trace.properties(F.col("v")).alias("p")).first().p


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("a=1,b=2", {"a": "1", "b": "2"}),
        ("a=1,a=2, b = x ", {"a": "2", "b": "x"}),
        ('a="x, ""y""",b=\'it\'\'s, z\',c=', {"a": 'x, "y"', "b": "it's, z", "c": ""}),
        ('a="",b=\'\'', {"a": "", "b": ""}),
        ('a=1,b="open, c', {"a": "1", "b": ""}),
        ('a="open, c=3,d=4', {"a": ""}),
        ('a="odd"",b=2', {"a": ""}),
        ('a="pair""",b="""",c=1', {"a": 'pair"', "b": '"', "c": "1"}),
        ("=1,b=2", {"b": "2"}),
        ("", {}),
    ],
)
def test_properties(spark, text, want):
    assert properties_of(spark, text) == want


def test_long_values_and_lines(spark):
    sql = "select \"x\" " * 200_000
    text = "2024-01-31T10:20:30.000001-15,DBMSSQL,0,Sql=\"" + sql.replace('"', '""') + "\",Usr=me"
    doc = json.dumps({"ts": "2024-01-31T10:20:30.000001", "duration": "15", "name": "DBMSSQL", "depth": "0", "Sql": sql, "Usr": "me"})
    rows = trace.tech_records(spark.createDataFrame([(text, "/x.log"), (doc, "/x.log")], "value string, path string")).select("sql", "usr", "duration").collect()
    assert [(r.sql == sql, r.usr, r.duration) for r in rows] == [(True, "me", 15)] * 2


def test_filters_lie_below_the_parse(spark):
    lines = registry.plain_lines(registry.trace_fields(spark, "/root/testdata/sf0.001"))
    lines.write.mode("overwrite").parquet("/tmp/loamline-lines")
    rows = trace.tech_records(spark.read.parquet("/tmp/loamline-lines")).where("name = 'DBMSSQL'").select("ts", "sql")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Filter", 1)
    assert trace.PROPERTY[:12] in above and trace.PROPERTY[:12] not in below and "DBMSSQL" in below.split("Relation")[0]


def test_absent_columns_are_an_error(spark):
    rows = registry.evlog(spark, "/root/testdata/sf0.001")
    assert boards.explorer(rows).columns == boards.EXPLORER
    with pytest.raises(Exception, match="server"):
        boards.explorer(rows.drop("server"))


def test_columns_that_vary_among_equal_hashes(spark):
    rows = spark.createDataFrame([("h", "a", None, 1), ("h", "a", "x", 1), ("g", "b", None, 1), ("g", "c", None, 1)], "record_hash string, x string, y string, z int")
    assert {r.record_hash: r.varied for r in compare.repeated(rows).collect()} == {"h": ["y"], "g": ["x"]}


def test_equal_records_are_kept_and_a_repeated_batch_adds_nothing(spark, tmp_path):
    from loamline.streaming import tail

    rows = trace.tech_records(spark.createDataFrame([("2024-01-31T10:20:30.000001-15,EXCP,0,a=1", "/x.log")] * 3, "value string, path string"))
    table, mark = str(tmp_path / "tech"), str(tmp_path / "mark")
    for _ in range(2):
        tail.stored(rows, table, "tech_log", mark, 0, False, {})
    assert spark.read.parquet(table).count() == 3
    tail.stored(rows, table, "tech_log", mark, 1, False, {"attempts": 1})
    assert spark.read.parquet(table).count() == 6
    tail.stored(rows, str(tmp_path / "once"), "tech_log", mark, 0, True, {})
    assert spark.read.parquet(str(tmp_path / "once")).count() == 1


def test_settings_reach_the_ingest(spark, tmp_path):
    from loamline import runner
    from loamline.config import load

    cluster, base = "11111111-1111-4111-8111-111111111111", "22222222-2222-4222-8222-222222222222"
    folder = tmp_path / "logs" / cluster / base / "rphost_1"
    folder.mkdir(parents=True)
    (folder / "24013110.log").write_text("20:30.000001-15,EXCP,0,a=1\n" * 4, encoding="utf-8")
    (tmp_path / "map.yaml").write_text(f"clusters:\n  {cluster}:\n    name: Main\ninfobases:\n  {base}:\n    name: Trade\n    cluster_guid: {cluster}\n", encoding="utf-8")
    settings = load({"LAKE_DIR": str(tmp_path / "lake"), "TECHLOG_DIRS": str(tmp_path / "logs"), "READ_ONLY": "true", "CLUSTER_MAP_PATH": str(tmp_path / "map.yaml"), "RETRY_MAX_ATTEMPTS": "2"})
    for query in runner.start(spark, settings):
        query.awaitTermination(120)
    rows = spark.read.parquet(f"{settings.lake}/tech_log").collect()
    assert len(rows) == 4 and {(r.cluster_name, r.infobase_name) for r in rows} == {("Main", "Trade")}


def test_journals_read_together_are_those_read_one_by_one(spark):
    from loamline.operators import enrich
    from loamline.plans import samples
    from loamline.sources import lines

    found = lines.journal_locations([samples.write_site(spark, "/root/testdata/sf0.001")])
    assert len(found) == samples.BASES
    together = enrich.read_journals(spark, found)
    alone = enrich.read_journal(spark, found[2])
    guid = found[2]["infobase_guid"]
    key = lambda df: sorted((r.event_time, r.session_id, r.record_hash, r.user_name, r.infobase_name) for r in df.collect())
    assert key(together.where(F.col("infobase_guid") == guid)) == key(alone) and together.columns == alone.columns
