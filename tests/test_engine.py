import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loamline import schemas, service
from loamline.operators import compare, enrich, store
from loamline.plans import boards, guides, registry
from loamline.sources import framing, journal, lines
from loamline.streaming import tail

CLUSTER, BASE = "b0881663-f2a7-4195-b7a2-f7f8e6c3a8f3", "d723aefd-7992-420d-b5f9-a273fd4146be"
HEAD = f"\ufeff1CV8LOG(ver 2.0)\r\n{BASE}\r\n\r\n"
START = '{20251113133657,N,\n{0,0},1,1,1,5,1,I,"",0,{"U"},"",1,1560,0,1}'
FAILED = '{20251113134012,C,\n{2449a7b7b6cd0,3f},1,1,1,5,2,E,"Сбой {12} в ""Поле"",\nпользователь: Иван",2,{S,"abc"},"Док 1",1,1560,0,4}'
LIST = '{20251113134013,X,{0,0},9,0,7,5,77,Q,"c",0,{"P",{2,{S,"a"},{B,0}}},"",1,70000,0,web}'
DICTIONARY = (
    f"\ufeff1CV8LOG(ver 2.0)\r\n{BASE}\r\n" + '{1,3f2504e0-4f89-11d3-9a0c-0305e82c3301,"Первый",1},\r\n{1,3F2504E0-4f89-11d3-9a0c-0305e82c3301,"Администратор",1},\r\n{2,"PC-1",1},\r\n{3,"Designer",1},\r\n'
    '{4,"_$Session$_.Start",1},\r\n{4,"_$PerformError$_",2},\r\n{5,6fa459ea-ee8a-3ca4-894e-db77e160355e,"Документ.Заказ",2},\r\n{9,"x",1},\r\n'
)


@pytest.fixture
def site(tmp_path):
    folder = tmp_path / "reg_1541" / BASE / "1Cv8Log"
    folder.mkdir(parents=True)
    (folder / "1Cv8.lgf").write_text(DICTIONARY, encoding="utf-8", newline="")
    (folder / "20251113000000.lgp").write_text(HEAD + ",\r\n".join([START, FAILED, "{}", "{1,2,3}", LIST]) + ",\r\n{20251113134", encoding="utf-8", newline="")
    (tmp_path / "reg_1541" / "1CV8Clst.lst").write_text(f'{{0,{{{CLUSTER},"Главный",1541}},{{1,{{{BASE},"Торговля","x"}},{{{CLUSTER[::-1]},"-"}}}}', encoding="utf-8")
    return tmp_path


def test_framing_and_tokens():
    data = (START + "," + FAILED + ",{open").encode()
    assert [r.decode() for _, r in framing.records(data)] == [START, FAILED]
    assert framing.tokens('a,"b,{c",{d,{e,f}},,g') == ["a", '"b,{c"', "{d,{e,f}}", "", "g"]
    assert framing.tokens("a,,b", keep_empty=False) == ["a", "b"]
    assert framing.listed_items('{"P",{2,{S,"a,b"},{B,0}}}') == [("S", '"a,b"'), ("B", "0")]
    with pytest.raises(ValueError):
        framing.body_start(b"something else\n")


def test_journal_from_files_to_rows(spark, site, monkeypatch):
    monkeypatch.setattr(journal, "WINDOW", 64)
    (location,) = lines.journal_locations([str(site), "/nowhere"])
    assert location["infobase_guid"] == BASE and len(location["files"]) == 1
    first, second, third = enrich.read_journal(spark, location).orderBy("event_time").collect()
    assert (first.event_time, first.level, first.event_presentation, first.user_name, first.computer) == (datetime(2025, 11, 13, 13, 36, 57), "Информация", "Сеанс.Начало", "Администратор", "PC-1")
    assert (first.application_presentation, first.cluster_name, first.infobase_name, first.user_id) == ("Конфигуратор", "Главный", "Торговля", "3f2504e0-4f89-11d3-9a0c-0305e82c3301")
    assert first.transaction_datetime == datetime(1980, 1, 1) and first.transaction_status == "Нет транзакции" and first.comment_normalized == ""
    assert (second.level, second.event, second.metadata_presentation, second.data, second.data_presentation, second.transaction_number, second.connection_id) == ("Ошибка", "_$PerformError$_", "Документ.Заказ", "abc", "Док 1", 63, 63)
    assert second.transaction_datetime == datetime(1970, 1, 1) + timedelta(seconds=0x2449A7B7B6CD0 // 10_000 - 62_451_156_554)
    assert second.comment_normalized == "Сбой {<NUMBER>} в <STRING>Поле<STRING>,\nпользователь: <USER>"
    assert (third.user_name, third.application, third.event, third.level, third.session_id, third.primary_port) == ("", "7", "77", "Q", 0, 0)
    assert third.data == "Item 1: a\nItem 2: false" and dict(zip(third.props_key, third.props_value, strict=True))["session_string"] == "web"
    assert len({first.record_hash, second.record_hash, third.record_hash}) == 3
    assert enrich.read_journal(spark, location).columns == schemas.columns(schemas.EVENT_LOG)


def test_dictionary_and_registry(spark, site):
    folder = site / "reg_1541"
    entries = {(r.object_type, r.number): (r.value, r.uuid) for r in journal.dictionary(spark, str(folder / BASE / "1Cv8Log" / "1Cv8.lgf")).collect()}
    assert entries[1, 1][0] == "Администратор" and entries[2, 1] == ("PC-1", "") and (9, 1) not in entries
    (base,) = journal.registry(spark, str(folder / "1CV8Clst.lst")).collect()
    assert (base.cluster_guid, base.cluster_name, base.infobase_guid, base.infobase_name) == (CLUSTER, "Главный", BASE, "Торговля")


def test_names_by_mapping(spark):
    document = lines.read_mapping(f'clusters:\n  {CLUSTER}:\n    name: "Main"\n    notes: n\ninfobases:\n  {BASE}:\n    name: Trade\n')
    assert document["clusters"][CLUSTER]["name"] == "Main" and document["infobases"][BASE]["name"] == "Trade"
    rows = spark.createDataFrame([(CLUSTER,), ("other",)], "cluster_guid string")
    got = enrich.with_mapping(rows, lines.names_from_mapping(spark, document, "clusters"), "cluster_guid", "cluster_name").collect()
    assert {r.cluster_guid: r.cluster_name for r in got} == {CLUSTER: "Main", "other": "other"}


def trace_folder(root):
    folder = root / CLUSTER / BASE / "rphost_1"
    folder.mkdir(parents=True)
    return folder


def test_trace_files(spark, tmp_path):
    folder = trace_folder(tmp_path)
    (folder / "25011408.log").write_text("45:31.000001-1,SCALL,0,a=1\n45:32.000001-2,EXCP,0,Descr='one\ntwo'\n", encoding="utf-8")
    got = enrich.read_trace(spark, str(tmp_path), join_lines=True).orderBy("duration").collect()
    assert [(r.name, r.cluster_guid, r.infobase_guid) for r in got] == [("SCALL", CLUSTER, BASE), ("EXCP", CLUSTER, BASE)]
    assert got[1].exception_descr == "one\ntwo" and got[1].ts == datetime(2025, 1, 14, 8, 45, 32, 1)
    assert lines.trace_locations(str(tmp_path))[0]["infobase_guid"] == BASE and lines.trace_format(str(folder)) == "text"
    (folder / "logcfg.xml").write_text(service.logcfg("/x", layout="json"))
    assert lines.trace_format(str(folder)) == "json"


def test_spreadsheet_export(spark, tmp_path):
    cells = ["Дата, время", "13.11.2025 13:36:57", "Сеанс.Начало", "Администратор", "13.11.2025 13:37:00", "x"]
    rows = "".join(f"<Row><Cell><Data>{a}</Data></Cell><Cell><Data>{b}</Data></Cell></Row>" for a, b in zip(cells[::2], cells[1::2], strict=True))
    (tmp_path / "x.xml").write_text(f"<Workbook><Worksheet><Table>{rows}</Table></Worksheet></Workbook>", encoding="utf-8")
    got = lines.spreadsheet_records(spark, str(tmp_path / "x.xml")).orderBy("record").collect()
    assert [(r.DateTime, r.Fields) for r in got] == [("13.11.2025 13:36:57", ["Сеанс.Начало", "Администратор"]), ("13.11.2025 13:37:00", ["x"])]


def test_streams_follow_growth_and_store_once(spark, site, tmp_path):
    folder, table, mark = trace_folder(tmp_path / "traces"), str(tmp_path / "tech"), str(tmp_path / "mark")
    file = folder / "25011408.log"
    file.write_text("45:31.000001-1,SCALL,0,a=1\n45:31.000001-1,SCALL,0,a=1\n45:32.0000", encoding="utf-8")

    def run():
        query = tail.follow_traces(spark, str(tmp_path / "traces"), table, mark, follow=False)
        assert query.awaitTermination(120) and query.exception() is None
        return sorted(r.duration for r in spark.read.parquet(table).collect())

    assert run() == [1]
    with file.open("a") as more:
        more.write("02-2,SCALL,0,a=1\n45:33.000003-3,CALL,0,a=1\n")
    assert run() == [1, 2, 3]
    assert run() == [1, 2, 3]
    file.write_text("45:34.000004-4,CALL,0,a=1\n")  # the file was rotated
    assert run() == [1, 2, 3, 4]
    (location,) = lines.journal_locations([str(site)])
    events = str(tmp_path / "events")
    for want in (3, 4):
        query = tail.follow_journal(spark, location, events, str(tmp_path / "mark2"), {"cluster_guid": CLUSTER}, follow=False)
        assert query.awaitTermination(120) and query.exception() is None
        assert spark.read.parquet(events).count() == want
        with open(location["files"][0], "a", encoding="utf-8") as more:
            more.write('000,N,{0,0},1,1,1,5,1,I,"",0,{"U"},"",1,1560,0,1},\n')


def test_storage(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, 10), ("a", 2, 20), ("b", 1, 5)], "k string, updated_at int, v int")
    assert sorted((r.k, r.v) for r in store.latest(rows, ["k"]).collect()) == [("a", 20), ("b", 5)]
    assert sorted((r.k, r.v) for r in store.merged(rows, spark.createDataFrame([("b", 9, 7)], rows.schema), ["k"]).collect()) == [("a", 20), ("b", 7)]
    days = spark.sql("select timestamp'2024-01-01 10:00:00' as ts, 'h1' as record_hash, 'c' as cluster_guid, 'i' as infobase_guid, 'n' as name union all select timestamp'2024-01-02 10:00:00', 'h2', 'c', 'i', 'n'")
    path = str(tmp_path / "t")
    for _ in range(2):
        store.append_unseen(days, path, "tech_log")
    assert spark.read.parquet(path).count() == 2
    assert store.drop_days(spark, path, "ts_date", lambda day: day > "2024-01-01") == ["2024-01-01"]
    assert [r.record_hash for r in spark.read.parquet(path).collect()] == ["h2"]
    assert json.loads(store.as_json(rows.where("k = 'b'"))) == [{"k": "b", "updated_at": 1, "v": 5}] and store.as_json(rows.limit(0)) == "[]" and store.as_json(rows.limit(0), strict=True) == "null"
    tries = []

    def fails_once():
        tries.append(1)
        if len(tries) < 2:
            raise OSError("passing")
        return "done"

    assert store.retry(fails_once, first=0.01) == "done" and len(tries) == 2
    with pytest.raises(ValueError):
        store.retry(lambda: int("x"))


def test_metrics_and_progress(spark):
    base = spark.sql("select 100 as records_parsed, 40L as parsing_time_ms, 0L as record_parsing_time_ms, 0L as file_reading_time_ms, 200L as file_size_bytes, 50L as offset_bytes")
    row = store.with_progress(store.metrics_with_times(base, 1e6, 10.0)).first()
    assert (row.deduplication_time_ms, row.writing_time_ms, row.file_reading_time_ms, row.progress_percent) == (100, 1, 40, 25.0)


def test_repeated_rows_and_comparison(spark):
    rows = spark.createDataFrame([("h", "a", 1), ("h", "b", 1), ("g", "c", 2)], "record_hash string, x string, y int")
    assert [(r.record_hash, r.copies, r.varied) for r in compare.repeated(rows).collect()] == [("h", 2, ["x"])]
    a = spark.createDataFrame([(k, datetime(2024, 1, 1, 0, k), f"text {k}") for k in range(5)], "k int, t timestamp, x string")
    b = a.where("k < 4").withColumn("x", F.when(F.col("k") == 2, "other").when(F.col("k") == 1, "text 1 and more").otherwise(F.col("x"))).withColumn("t", F.when(F.col("k") == 3, F.col("t") + F.expr("interval 2 minutes")).otherwise(F.col("t")))
    got = {r.place: (r.status, r.differs) for r in compare.compared(a, b, ["k"], "t", ["x"]).collect()}
    assert got == {1: ("same", []), 2: ("same", []), 3: ("differs", ["x"]), 4: ("differs", ["t"]), 5: ("missing", [])}


def test_fractions_of_a_second_count_in_the_tolerance(spark):
    at = datetime(2024, 1, 1)
    moved = [timedelta(seconds=60), timedelta(seconds=60, microseconds=1), timedelta(seconds=60, microseconds=900_000), timedelta(seconds=59, microseconds=999_999)]
    a = spark.createDataFrame([(k, at, "") for k in range(4)], "k int, t timestamp, x string")
    for sign in (1, -1):
        b = spark.createDataFrame([(k, at + sign * by, "") for k, by in enumerate(moved)], "k int, t timestamp, x string")
        got = {r.place: r.status for r in compare.compared(a, b, ["k"], "t", ["x"]).collect()}
        assert got == {1: "same", 2: "differs", 3: "differs", 4: "same"}


SF = "/root/testdata/sf0.001"


def test_plans_have_the_shape_they_should(spark):
    rows = registry.evlog(spark, SF)

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    assert "LeftAnti" in plan(boards.new_error_keys(rows, registry.RECENT))
    assert "TakeOrderedAndProject" in plan(boards.explorer(rows))
    assert "comment" not in plan(boards.activity_by_hour(rows, registry.MONTH)).split("ReadSchema")[1].splitlines()[0]
    assert "Python" not in plan(registry.tech(spark, SF).select("raw_line_normalized", "record_hash"))


def test_probe_and_counts(spark):
    rows = registry.evlog(spark, SF)
    assert guides.probe(rows, "event_presentation", "%Нет%").count() == 0
    assert guides.table_counts({"a": rows, "b": rows.limit(3)}).count() == 2


@pytest.fixture(scope="module")
def tools(spark):
    events = registry.evlog(spark, SF).cache()
    traces = registry.tech(spark, SF).cache()
    return service.Service(events, traces, now=lambda: datetime(2024, 1, 31))


def call(tools, tool, **arguments):
    return tools.answer(json.dumps({"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {"name": tool, "arguments": arguments}}))


def test_tools_answer(tools, tmp_path):
    scope = {"cluster_guid": registry.CLUSTERS[1], "infobase_guid": registry.BASES[1], "from": "2024-01-01T00:00:00Z", "to": "2024-01-31"}
    found = json.loads(call(tools, "logc_get_event_log", **scope, limit=3)["result"]["content"][0]["text"])
    assert len(found) == 3 and {r["level"] for r in found} == {"Ошибка"}
    assert len(json.loads(call(tools, "logc_get_tech_log", **scope, name="EXCP", limit=2)["result"]["content"][0]["text"])) == 2
    assert json.loads(call(tools, "logc_get_actual_log_timestamp", base_id=registry.BASES[1])["result"]["content"][0]["text"])[0]["has_data"] is True
    assert call(tools, "logc_get_event_log", **(scope | {"infobase_guid": "x"}))["error"]["code"] == service.INVALID_PARAMS
    assert call(tools, "logc_get_event_log", **(scope | {"from": "2025-01-01"}))["error"]["code"] == service.INVALID_PARAMS
    assert call(tools, "nothing")["error"]["code"] == service.UNKNOWN_METHOD
    assert tools.answer("{")["error"]["code"] == service.PARSE_ERROR and tools.answer("[]")["error"]["code"] == service.INVALID_REQUEST
    assert tools.answer('{"method": "initialized"}') is None
    asked = ['{"id": 1, "method": "tools/list"}', "", '{"id": 2, "method": "initialize"}']
    assert [json.loads(x)["id"] for x in tools.handle(asked)] == [1, 2]


def test_configuration_files(tools, spark, tmp_path):
    config = str(tmp_path / "conf" / "logcfg.xml")
    location = f"/logs/{registry.CLUSTERS[0].upper()}/{registry.BASES[0]}"
    scope = {"cluster_guid": registry.CLUSTERS[0], "infobase_guid": registry.BASES[0], "config": config, "location": location}
    tools.base = "/logs"
    assert "error" not in call(tools, "logc_configure_techlog", **scope, events=["EXCP", "TLOCK"])
    xml = service.get_techlog_config(config)
    assert xml.count("<event>") == 2
    assert {r.name for r in service.filtered_by_logcfg(registry.tech(spark, SF), xml).select("name").distinct().collect()} == {"EXCP", "TLOCK"}
    call(tools, "logc_save_techlog", config=config)
    call(tools, "logc_disable_techlog", config=config)
    assert "<event>" not in service.get_techlog_config(config)
    call(tools, "logc_restore_techlog", config=config)
    assert service.get_techlog_config(config) == xml
    assert call(tools, "logc_configure_techlog", **(scope | {"location": "/elsewhere"}))["error"]["code"] == service.INVALID_PARAMS
