import hashlib
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from loamline.functions import journal, text, trace
from loamline.functions.rowhash import row_hash
from loamline.lookups import EVENT, event_shown, level_spellings, shown
from loamline.schemas import PROMOTED, TECH_LOG, column_name, columns

GUID = "0f8fad5b-d9cb-469f-a165-70867728950e"


def mapped(spark, function, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.out for r in rows.select("i", function(F.col("v")).alias("out")).orderBy("i").collect()]


def test_comment_fingerprints(spark):
    cases = {
        "": "",
        "  Сбой записи  ": "Сбой записи",
        f"Сбой {GUID}": "Сбой <GUID>",
        "в 2024-02-03 04:05:06 и 2024-02-03T04:05:06": "в <TIMESTAMP> и <TIMESTAMP>",
        'поле "Имя 12" номер 77': "поле <STRING> номер <NUMBER>",
        "вид12 12вид 12 абв12": "вид<NUMBER> <NUMBER>вид <NUMBER> абв<NUMBER>",
        "x12 12x _12 12": "x12 12x _12 <NUMBER>",
        "компьютер: PC-1, пользователь: Иван Петров, конец": "компьютер: <COMPUTER>, пользователь: <USER>, конец",
        "Computer: мой компьютер, USER: a": "компьютер: <COMPUTER>, user: <USER>",
        "on computer : srv 12": "on computer: <COMPUTER>",
        "user: пользователь Иван": "пользователь: <USER>",
    }
    assert mapped(spark, text.comment_fingerprint, list(cases)) == list(cases.values())


def test_line_fingerprints(spark):
    cases = {
        "": "",
        "2024-02-03T04:05:06.123456-77,SCALL,1": "<TIMESTAMP>.<NUMBER>-77,SCALL,1",
        "took 12345 of 123456": "took 12345 of <NUMBER>",
        'field "Name 1"': 'field "Name 1"',
        "exec sp_executesql N'select * from #tt12 where a=@p',N'@p int',@p=1": "select * from #tt where a=@p",
        "EXEC sp_executesql N'select 1', N'@p int'": "select 1",
        "select * from #tt1, #tt22": "select * from #tt, #tt",
        "a=$1 b=$22": "a=$<NUMBER> b=$<NUMBER>",
        "EXECUTE $1, $2": "EXECUTE $<NUMBER>, $<NUMBER>",
        f"t,DBPOSTGRS,1,sql=select #tt5 where g='{GUID}' and x=$3": "t,DBPOSTGRS,1,sql=select #tt5 where g='<GUID>' and x=$<NUMBER>",
        "t,DBMSSQL,1,компьютер: A, пользователь: B, sql=exec sp_executesql N'select 1',N'@p int'": "t,DBMSSQL,1,компьютер: <COMPUTER>, пользователь: <USER>, sql=select 1",
        "no words #tt7": "no words #tt7",
    }
    assert mapped(spark, text.line_fingerprint, list(cases)) == list(cases.values())


def test_small_functions(spark):
    assert mapped(spark, lambda c: text.readable_size(c.cast("bigint")), ["0", "1023", "1024", "1152", "5242880", "3221225472"]) == ["0.00 B", "1023.00 B", "1.00 KiB", "1.13 KiB", "5.00 MiB", "3.00 GiB"]
    assert mapped(spark, lambda c: text.utc_text(c.cast("timestamp")), ["2024-01-02 03:04:05", "2024-01-02 03:04:05.120", "2024-01-02 03:04:05.000001"]) == ["2024-01-02T03:04:05Z", "2024-01-02T03:04:05.12Z", "2024-01-02T03:04:05.000001Z"]
    assert mapped(spark, lambda c: text.unsigned(c, "u8"), ["0", "255", "256", " 1", "-1", "x", ""]) == [0, 255, None, None, None, None, None]
    assert mapped(spark, lambda c: text.shortened(c, 4), ["abcd", "abcde", "пять"]) == ["abcd", "abcd...", "пя..."]
    assert mapped(spark, lambda c: shown(c, {"A": "a"}), ["A", "B"]) == ["a", "B"]
    assert mapped(spark, event_shown, ["_$Session$_.Start", "_$User$_.AuthenticationUnlockError", "own"]) == [EVENT["_$Session$_.Start"], "Пользователи.Ошибка разблокировки аутентификации", "own"]
    assert level_spellings("Error") == ["Error", "Ошибка"] and level_spellings("Ошибка") == ["Ошибка", "Error"]


def test_property_lists(spark):
    cases = {
        "level=INFO,process=1cv8,OSThread=1": {"level": "INFO", "process": "1cv8", "OSThread": "1"},
        "a='x, y',b=\"p=q, r\",c=": {"a": "x, y", "b": "p=q, r", "c": ""},
        "a='it''s',b=\"say \"\"hi\"\"\"": {"a": "it's", "b": 'say "hi"'},
        " a = 1 ,a=2": {"a": "2"},
        "a=1,b='open, c": {"a": "1", "b": ""},
        "": {},
    }
    rows = spark.createDataFrame([(k,) for k in cases], "v string")
    got = {r.v: r.m for r in rows.select("v", trace.properties(F.col("v")).alias("m")).collect()}
    assert got == cases


def test_paths_and_hours(spark):
    a, b = "b0881663-f2a7-4195-b7a2-f7f8e6c3a8f3", "d723aefd-7992-420d-b5f9-a273fd4146be"
    cases = {
        rf"D:\Logs\{a}\{b}\rphost_1\25011408.log": (a, b),
        f"/var/{a}/{b}/rphost_5/sub/25011409.log": (a, b),
        rf"D:\L\{a.upper()}\{b.upper()}\x.log": (a, b),
        f"/var/{GUID}/{a}/{b}/x.log": (a, b),
        f"/var/{a}/x.log": ("", ""),
        "x.log": ("", ""),
        "": ("", ""),
    }
    rows = spark.createDataFrame([(k,) for k in cases], "v string")
    cluster, base = trace.path_guids(F.col("v"))
    assert {r.v: (r.c, r.b) for r in rows.select("v", cluster.alias("c"), base.alias("b")).collect()} == cases
    assert mapped(spark, trace.file_hour, ["25011408.log", "rphost_1234_25011409.log", "x.log", "25131408.log"]) == [datetime(2025, 1, 14, 8), datetime(2025, 1, 14, 9), None, None]


def lines(spark, values, path="/logs/x/rphost_1/25011408.log"):
    return trace.tech_records(spark.createDataFrame([(v, path) for v in values], "value string, path string"))


def test_text_lines(spark):
    got = lines(spark, [
        "2023-08-01T15:01:45.259000-14998,SCALL,0,level=INFO,process=1cv8c,OSThread=2732,ClientID=8,Own=1,Also='a, b'",
        "45:31.831006-1,SCALL,2,level=INFO,Txt='Hello, world',Rows=5",
        "75:01.5-3,EXCP,1,Exception=E,File=f.cpp,Line=7", "", "no commas here at all, none", "2023-08-01T15:01:45.259000-x,SCALL,0,a=1", "45:31.831006-1,SCALL,300,a=1", "45:31.1-2-3,SCALL,0,a=1",
    ]).orderBy("duration").collect()
    assert [r.duration for r in got] == [1, 3, 14998]
    hourly, late, plain = got
    assert (hourly.ts, hourly.depth, hourly.system_txt, hourly.rows, hourly.name) == (datetime(2025, 1, 14, 8, 45, 31, 831006), 2, "Hello, world", 5, "SCALL")
    assert late.ts == datetime(2025, 1, 14, 9, 15, 1, 5) and (late.file, late.system_file, late.line, late.system_line) == ("f.cpp", "", 7, 0)
    assert plain.ts == datetime(2023, 8, 1, 15, 1, 45, 259000) and (plain.level, plain.process, plain.os_thread, plain.client_id) == ("INFO", "1cv8c", 2732, 8)
    assert (plain.property_key, plain.property_value) == (["Also", "Own"], ["a, b", "1"])


def test_json_lines(spark):
    got = {r.name: r for r in lines(spark, [
        '{"ts":"2023-08-02T08:48:05.982000","duration":"46998","name":"SCALL","depth":"0","OSThread":"15968","Method":"0","Interface":"i"}',
        '﻿{"ts":"2023-08-02T08:48:06.100000","duration":"1","name":"DBMSSQL","depth":"1","Sql":"select \\"a\\"","Rows":850,"duration":"8500000","Trans":"1:1"}',
        '{"ts":"2023-08-02T08:48:08.300000","name":"TTIMEOUT","depth":"x","Txt":"wait","WaitTime":"5000","Deep":{"a":1}}',
        '{"ts":"yesterday","name":"BAD"}', "{broken", '{"name":"NOTIME"}',
    ]).collect()}
    assert set(got) == {"SCALL", "DBMSSQL", "TTIMEOUT"}
    assert got["DBMSSQL"].duration == 8_500_000 and got["DBMSSQL"].rows == 850 and got["DBMSSQL"].sql == 'select "a"' and got["DBMSSQL"].transaction_id == "1:1"
    assert got["TTIMEOUT"].depth == 0 and got["TTIMEOUT"].system_txt == "wait" and got["TTIMEOUT"].property_key == ["Deep", "WaitTime"]
    assert got["SCALL"].method == "0" and got["SCALL"].exception == ""


def test_keys_that_depend_on_the_event(spark):
    names = {"FTEXTUPD": "File=a,Info=b,Result=1", "SYSTEM": "File=a,Line=3", "ADDIN": "Result=2,Crashed=1", "VIDEOCALL": "Connection=c,Status=s", "VRSRESPONSE": "Status=200,Phrase=OK,Method=GET", "STT": "Id=i,Status=s", "CONN": "Connection=12,Id=i,Status=gone", "SDGC": "Method=m", "MAILPARSEERR": "Method=m", "CALL": "Method=m,SearchByMask=true,Separation=no,Memory=18446744073709551615"}
    got = {r.name: r for r in lines(spark, [f"45:31.000001-1,{n},0,{p}" for n, p in names.items()]).collect()}
    assert (got["FTEXTUPD"].ftext_file, got["FTEXTUPD"].ftext_info, got["FTEXTUPD"].ftext_result, got["FTEXTUPD"].file) == ("a", "b", 1, "")
    assert (got["SYSTEM"].system_file, got["SYSTEM"].system_line, got["SYSTEM"].line) == ("a", 3, 0)
    assert (got["ADDIN"].addin_result, got["ADDIN"].addin_crashed, got["ADDIN"].ftext_result) == (2, 1, 0)
    assert (got["VIDEOCALL"].video_connection, got["VIDEOCALL"].video_status, got["VIDEOCALL"].connection) == ("c", "s", 0)
    assert (got["VRSRESPONSE"].vrs_status, got["VRSRESPONSE"].vrs_phrase, got["VRSRESPONSE"].vrs_method, got["VRSRESPONSE"].stt_phrase) == (200, "OK", "GET", "")
    assert (got["STT"].stt_id, got["STT"].stt_status, got["STT"].store_id) == ("i", "s", "")
    assert (got["CONN"].connection, got["CONN"].store_id, got["CONN"].property_key) == (12, "i", [])
    assert got["SDGC"].sdgc_method == got["MAILPARSEERR"].mail_method == got["CALL"].method == "m"
    assert (got["CALL"].search_by_mask, got["CALL"].ftext_separation, got["CALL"].memory) == (1, 0, 0)


def test_schema_follows_the_rule():
    assert [column_name(k) for k in ("ClientID", "OSThread", "SearchByMask", "hResultNC2005", "Rows")] == ["client_id", "os_thread", "search_by_mask", "h_result_nc2005", "rows"]
    assert len(columns(TECH_LOG)) == 272 and len({p.column for p in PROMOTED}) == len(PROMOTED)


def test_row_hash_is_sha1_of_fields_and_sorted_properties(spark):
    row = spark.sql("select timestamp'2024-01-02 03:04:05.5' as event_time, 'a' as x, 7 as n, map('b', '2', 'a', '1') as props")
    want = hashlib.sha1(b"2024-01-02T03:04:05.5Z|a|7|a=1|b=2|").hexdigest()
    assert row.select(row_hash(["event_time", "x", "n"], F.col("props"))).first()[0] == want


@pytest.mark.parametrize(("field", "items", "want"), [("{S,\"abc\"}", [], "abc"), ('{"S","abc"}', [], "abc"), ("{U}", [], ""), ("{B,0}", [], "false"), ("{B,1}", [], "true"), ("{R,12:ab}", [], "12:ab"), ("{N,5}", [], ""), ("", [], ""), ("{P,{2,{S,\"a\"},{B,1}}}", [("S", '"a"'), ("B", "1")], "Item 1: a\nItem 2: true")])
def test_data_fields(spark, field, items, want):
    row = spark.createDataFrame([(field, items)], "f string, items array<struct<kind:string,value:string>>")
    assert row.select(journal.data_shown(F.col("f"), F.col("items"))).first()[0] == want
