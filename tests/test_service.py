import json
import threading
import urllib.error
import urllib.request
from datetime import date, datetime

import pytest

from loamline import config, runner, service
from loamline.plans import registry

from .test_engine import BASE, CLUSTER, site, trace_folder  # noqa: F401

SF = "/root/testdata/sf0.001"


def test_settings_from_the_environment():
    got = config.load({"LOG_DIRS": "/a; /b,/c", "LOG_RETENTION_DAYS": "7", "READ_ONLY": "true", "MAX_WORKERS": "many", "RETRY_MULTIPLIER": "1.5"})
    assert (got.log_dirs, got.retention_days, got.read_only, got.max_workers, got.retry_factor, got.lake) == (["/a", "/b", "/c"], 7, True, 4, 1.5, "lake")
    for wrong in ({"LOG_RETENTION_DAYS": "0"}, {"MCP_PORT": "70000"}, {"LAKE_DIR": ""}):
        with pytest.raises(ValueError):
            config.load(wrong)


def test_parameters_are_checked():
    assert service.checked_time("2024-01-31T12:00:00+03:00", "from") == "2024-01-31 09:00:00"
    assert service.checked_time("2024-01-31", "from") == "2024-01-31 00:00:00"
    for wrong in (lambda: service.checked_guid(service.NIL, "x"), lambda: service.checked_guid("12", "x"), lambda: service.checked_time("soon", "x"), lambda: service.checked_mode("all")):
        with pytest.raises(service.Invalid):
            wrong()
    assert service.checked_path(f"C:\\logs\\{CLUSTER.upper()}\\{BASE}\\x", "C:\\logs", CLUSTER, BASE)
    for path, cluster in ((f"/other/{CLUSTER}/{BASE}", CLUSTER), (f"/logs/{BASE}/{CLUSTER}", CLUSTER), ("/logs", CLUSTER), (f"/logs/../etc/{CLUSTER}", CLUSTER)):
        with pytest.raises(service.Invalid):
            service.checked_path(path, "/logs", cluster, BASE)


def test_ingest_of_a_whole_site(spark, site, tmp_path):  # noqa: F811
    (trace_folder(tmp_path / "traces") / "25011408.log").write_text("45:31.000001-1,SCALL,0,a=1\n", encoding="utf-8")
    settings = config.Settings(lake=str(tmp_path / "lake"), log_dirs=[str(site / "reg_1541")], trace_dirs=[str(tmp_path / "traces")], read_only=True)
    for query in runner.start(spark, settings):
        assert query.awaitTermination(120) and query.exception() is None
    events = spark.read.parquet(f"{settings.lake}/event_log")
    assert events.count() == 3 and {r.cluster_name for r in events.collect()} == {"Главный"} and {r.infobase_name for r in events.collect()} == {"Торговля"}
    assert spark.read.parquet(f"{settings.lake}/tech_log").first().cluster_guid == CLUSTER
    gone = runner.keep(spark, settings, lambda: date(2025, 3, 1))
    assert gone == {"event_log": [], "tech_log": ["2025-01-14"]}


def test_tools_over_http(spark):
    tools = service.Service(registry.evlog(spark, SF), registry.tech(spark, SF), now=lambda: datetime(2024, 1, 31))
    http = service.server(tools, 0)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{http.server_address[1]}"

    def post(tool, **arguments):
        with urllib.request.urlopen(urllib.request.Request(f"{base}/tools/{tool}", json.dumps(arguments).encode())) as answer:
            return json.load(answer)

    scope = {"cluster_guid": registry.CLUSTERS[1], "infobase_guid": registry.BASES[1], "from": "2024-01-01", "to": "2024-01-31"}
    assert json.load(urllib.request.urlopen(f"{base}/health")) == {"status": "ok"}
    assert len(post("logc_get_event_log", **scope, limit=2)) == 2
    for tool, arguments, code in (("logc_get_event_log", scope | {"from": "soon"}, 400), ("nothing", {}, 404)):
        with pytest.raises(urllib.error.HTTPError) as failed:
            post(tool, **arguments)
        assert failed.value.code == code
    http.shutdown()


def test_tools_are_described_and_arguments_checked():
    import json

    from loamline import service

    def unused(_):
        raise AssertionError

    own = service.Service(None, None)
    own.tools = dict.fromkeys(own.tools, unused)
    listed = own.answer('{"jsonrpc": "2.0", "id": 1, "method": "tools/list"}')["result"]["tools"]
    assert {t["name"] for t in listed} == set(own.tools) == set(service.TOOLS)
    for tool in listed:
        schema = tool["inputSchema"]
        assert tool["description"] and schema["type"] == "object" and set(schema["required"]) <= set(schema["properties"])
    for arguments in ({"limit": "5"}, {"limit": 0}, {"limit": True}, {"mode": "all"}, {"cluster_guid": 7}):
        asked = {"jsonrpc": "2.0", "id": 2, "method": "tools/call", "params": {"name": "logc_get_event_log", "arguments": arguments}}
        assert own.answer(json.dumps(asked))["error"]["code"] == service.INVALID_PARAMS
    assert service.checked_arguments("logc_get_techlog_config", {"config_path": "/x"})["config"] == "/x"
