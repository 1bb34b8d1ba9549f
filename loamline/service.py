"""The tools: checked parameters in, JSON out, and the trace log's configuration files.

Thin Python over ``plans.tools``; ``handle`` answers JSON-RPC requests line by line.
"""

from __future__ import annotations

import json
import os
import re
import shutil
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterable, Iterator
from datetime import datetime, timedelta, timezone
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any

from pyspark.sql import DataFrame

from .operators.store import as_json
from .plans import tools

GUID = re.compile(r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$")
NIL = "00000000-0000-0000-0000-000000000000"
PLACEHOLDERS = {"", "null", "undefined", "none", "your-guid-here", NIL}
#: JSON-RPC error codes.
PARSE_ERROR, INVALID_REQUEST, UNKNOWN_METHOD, INVALID_PARAMS, INTERNAL = -32700, -32600, -32601, -32602, -32603


class Invalid(ValueError):
    def __init__(self, field: str, message: str, instructions: str = ""):
        super().__init__(f"{field}: {message}")
        self.field, self.message, self.instructions = field, message, instructions


def checked_guid(value: str, field: str) -> str:
    if (value or "").strip().lower() in PLACEHOLDERS:
        raise Invalid(field, "is missing or a placeholder", "take it from the cluster map")
    if not GUID.match(value):
        raise Invalid(field, f"{value!r} is no GUID", "xxxxxxxx-xxxx-xxxx-xxxx-xxxxxxxxxxxx")
    return value


def checked_time(value: str, field: str) -> str:
    """ISO time with or without zone; without one it is UTC, as stored times are."""
    try:
        when = datetime.fromisoformat(str(value).replace("Z", "+00:00"))
    except ValueError:
        raise Invalid(field, f"{value!r} is no time", "2024-01-31T10:00:00Z") from None
    return (when.astimezone(timezone.utc).replace(tzinfo=None) if when.tzinfo else when).isoformat(sep=" ")


def checked_window(start: str, end: str) -> tuple[str, str]:
    window = checked_time(start, "from"), checked_time(end, "to")
    if window[0] > window[1]:
        raise Invalid("from", "is after to")
    return window


def checked_mode(mode: str | None) -> str:
    if mode not in (None, "", "minimal", "full"):
        raise Invalid("mode", f"{mode!r} is unknown", "minimal or full")
    return mode or "minimal"


def checked_path(path: str, base: str, cluster: str | None = None, infobase: str | None = None) -> str:
    """A path below ``base`` whose first two folders are the expected GUIDs, in any case."""
    clean, root = os.path.normpath(path.replace("\\", "/")), os.path.normpath(base.replace("\\", "/"))
    if clean != root and not clean.startswith(root.rstrip("/") + "/"):
        raise Invalid("path", f"is not below {root}")
    parts = [p for p in clean[len(root) :].split("/") if p]
    for k, (name, want) in enumerate((("cluster_guid", cluster), ("infobase_guid", infobase))):
        if want and (len(parts) <= k or parts[k].lower() != want.lower()):
            raise Invalid("path", f"{name} mismatch")
    return clean


def logcfg(location: str, history: int = 24, layout: str = "json", events: Iterable[str] = (), properties: Iterable[str] = ("all",)) -> str:
    """A ``logcfg.xml``: where, how long and in what layout trace events are written; no events means all."""
    root = ET.Element("config", xmlns="http://v8.1c.ru/v8/tech-log")
    log = ET.SubElement(root, "log", location=location, history=str(history), format=layout)
    for name in list(events) or [None]:
        event = ET.SubElement(log, "event")
        ET.SubElement(event, "eq" if name else "ne", property="name", value=name or "")
    for name in properties:
        ET.SubElement(log, "property", name=name)
    ET.indent(root)
    return '<?xml version="1.0" encoding="UTF-8"?>\n' + ET.tostring(root, encoding="unicode") + "\n"


def configure_techlog(config: str, location: str, base: str, cluster: str, infobase: str, **options: Any) -> str:
    checked_path(location, base, checked_guid(cluster, "cluster_guid"), checked_guid(infobase, "infobase_guid"))
    os.makedirs(os.path.dirname(config) or ".", exist_ok=True)
    with open(config, "w", encoding="utf-8") as file:
        file.write(logcfg(location, **options))
    return config


def save_techlog(config: str) -> str:
    return shutil.copyfile(config, f"{config}.OLD")


def restore_techlog(config: str) -> str:
    os.replace(f"{config}.OLD", config)
    return config


def disable_techlog(config: str) -> str:
    with open(config, "w", encoding="utf-8") as file:
        file.write('<?xml version="1.0" encoding="UTF-8"?>\n<config xmlns="http://v8.1c.ru/v8/tech-log"/>\n')
    return config


def get_techlog_config(config: str) -> str:
    with open(config, encoding="utf-8") as file:
        return file.read()


def filtered_by_logcfg(rows: DataFrame, xml: str) -> DataFrame:
    """Trace rows that a ``logcfg.xml`` would write: any event whose conditions all hold."""
    from pyspark.sql import functions as F

    number = {"eq": "=", "ne": "<>", "gt": ">", "ge": ">=", "lt": "<", "le": "<="}
    kept = F.lit(False)
    for event in (e for e in ET.fromstring(xml.encode()).iter() if e.tag.endswith("event")):
        holds = F.lit(True)
        for condition in event:
            kind = condition.tag.rpartition("}")[2]
            column, value = F.col(condition.get("property", "name").lower()), condition.get("value", "")
            if kind == "like":
                holds &= column.like(value)
            else:
                right = F.lit(int(value)) if value.isdigit() and kind not in ("eq", "ne") else F.lit(value)
                left = column.cast("long") if value.isdigit() and kind not in ("eq", "ne") else column.cast("string")
                holds &= {"=": left == right, "<>": left != right, ">": left > right, ">=": left >= right, "<": left < right, "<=": left <= right}[number[kind]]
        kept |= holds
    return rows.where(kept)


#: Every argument of the tools: its JSON type, what it is, and its bounds.
ARGUMENTS: dict[str, dict[str, Any]] = {
    "cluster_guid": {"type": "string", "description": "GUID of the cluster, from the cluster map"},
    "infobase_guid": {"type": "string", "description": "GUID of the infobase, from the cluster map"},
    "base_id": {"type": "string", "description": "GUID of the infobase whose last stored time is asked for"},
    "from": {"type": "string", "description": "first time, ISO 8601; ten minutes before the last one if absent"},
    "to": {"type": "string", "description": "last time, ISO 8601; now if absent"},
    "level": {"type": "string", "description": "level of the records, in either language; empty for all", "default": "Error"},
    "name": {"type": "string", "description": "trace event, as EXCP or TLOCK; all if absent"},
    "mode": {"type": "string", "description": "few columns or all", "enum": ["minimal", "full"], "default": "minimal"},
    "limit": {"type": "integer", "description": "most records", "minimum": 1, "maximum": tools.MOST, "default": tools.DEFAULT_LIMIT},
    "config_path": {"type": "string", "description": "the trace configuration file"},
    "location": {"type": "string", "description": "folder of the trace log; its first two folders are the GUIDs"},
    "history": {"type": "integer", "description": "hours that trace files are kept", "minimum": 1, "default": 24},
    "format": {"type": "string", "description": "layout of the trace log", "enum": ["json", "text"], "default": "json"},
    "events": {"type": "array", "items": {"type": "string"}, "description": "trace events that are written; all if empty"},
    "properties": {"type": "array", "items": {"type": "string"}, "description": "properties that are written"},
}
_SCOPE = ("cluster_guid", "infobase_guid")
#: What each tool does, the arguments it needs, and those it takes besides.
TOOLS: dict[str, tuple[str, tuple[str, ...], tuple[str, ...]]] = {
    "logc_get_event_log": ("Records of an infobase's event journal in a time window, the latest first.", _SCOPE, ("from", "to", "level", "mode", "limit")),
    "logc_get_tech_log": ("Records of an infobase's trace log in a time window, the latest first.", _SCOPE, ("from", "to", "name", "mode", "limit")),
    "logc_get_actual_log_timestamp": ("The time of the last stored journal record of an infobase.", (), ("base_id", "infobase_guid")),
    "logc_configure_techlog": ("Writes a trace configuration file.", (*_SCOPE, "location"), ("config_path", "history", "format", "events", "properties")),
    "logc_save_techlog": ("Keeps a copy of the trace configuration file.", (), ("config_path",)),
    "logc_restore_techlog": ("Brings the kept copy of the trace configuration file back.", (), ("config_path",)),
    "logc_disable_techlog": ("Writes a trace configuration without events.", (), ("config_path",)),
    "logc_get_techlog_config": ("The text of the trace configuration file.", (), ("config_path",)),
}


def described() -> list[dict]:
    """The tools with the JSON schemas of their arguments."""
    return [{"name": name, "description": what, "inputSchema": {"type": "object", "properties": {k: ARGUMENTS[k] for k in (*needed, *more)}, "required": list(needed)}} for name, (what, needed, more) in TOOLS.items()]


def checked_arguments(name: str, given: Any) -> dict:
    """A tool's arguments with the types, choices and bounds that its schema states."""
    if not isinstance(given, dict):
        raise Invalid("arguments", "are no object")
    out = dict(given)
    if "config_path" in out:
        out["config"] = out["config_path"]
    kinds = {"string": str, "integer": int, "array": (list, tuple)}
    for key in (k for k in (*TOOLS[name][1], *TOOLS[name][2]) if out.get(k) is not None):
        value, schema = out[key], ARGUMENTS[key]
        if not isinstance(value, kinds[schema["type"]]) or isinstance(value, bool):
            raise Invalid(key, f"{value!r} is no {schema['type']}")
        if "enum" in schema and value not in ("", *schema["enum"]):
            raise Invalid(key, f"{value!r} is unknown", " or ".join(schema["enum"]))
        if schema["type"] == "integer" and value < schema["minimum"]:
            raise Invalid(key, f"{value} is below {schema['minimum']}")
    return out


class Service:
    """The query tools over the stored tables; ``now`` gives the present time, for defaults."""

    def __init__(self, event_log: DataFrame, tech_log: DataFrame, config: str = "logcfg.xml", base: str = "/", now: Callable[[], datetime] = lambda: datetime.now(timezone.utc)):
        self.events, self.traces, self.config, self.base, self.now = event_log, tech_log, config, base, now
        self.tools: dict[str, Callable[[dict], str]] = {
            "logc_get_event_log": self.get_event_log, "logc_get_tech_log": self.get_tech_log, "logc_get_actual_log_timestamp": self.get_actual_log_timestamp,
            "logc_configure_techlog": self.configure, "logc_save_techlog": lambda a: save_techlog(a.get("config", self.config)), "logc_restore_techlog": lambda a: restore_techlog(a.get("config", self.config)),
            "logc_disable_techlog": lambda a: disable_techlog(a.get("config", self.config)), "logc_get_techlog_config": lambda a: get_techlog_config(a.get("config", self.config)),
        }

    def _scope(self, a: dict) -> tuple[str, str, tuple[str, str]]:
        end = a.get("to") or self.now().isoformat()
        start = a.get("from") or (datetime.fromisoformat(str(end).replace("Z", "+00:00")) - timedelta(minutes=10)).isoformat()
        return checked_guid(a.get("cluster_guid", ""), "cluster_guid"), checked_guid(a.get("infobase_guid", ""), "infobase_guid"), checked_window(start, end)

    def get_event_log(self, a: dict) -> str:
        return as_json(tools.event_log(self.events, *self._scope(a), a.get("level", "Error") or None, checked_mode(a.get("mode")), a.get("limit")))

    def get_tech_log(self, a: dict) -> str:
        return as_json(tools.tech_log(self.traces, *self._scope(a), a.get("name"), checked_mode(a.get("mode")), a.get("limit")))

    def get_actual_log_timestamp(self, a: dict) -> str:
        return as_json(tools.actual_timestamp(self.events, checked_guid(a.get("base_id") or a.get("infobase_guid", ""), "base_id")))

    def configure(self, a: dict) -> str:
        return configure_techlog(a.get("config", self.config), a["location"], self.base, a.get("cluster_guid", ""), a.get("infobase_guid", ""), history=int(a.get("history", 24)), layout=a.get("format", "json"), events=a.get("events", ()), properties=a.get("properties", ("all",)))

    def answer(self, request: str) -> dict | None:
        """The answer to one JSON-RPC request; none to a notification."""

        def failed(code: int, message: str, id_: Any = None) -> dict:
            return {"jsonrpc": "2.0", "id": id_, "error": {"code": code, "message": message}}

        try:
            asked = json.loads(request)
        except ValueError:
            return failed(PARSE_ERROR, "no JSON")
        if not isinstance(asked, dict) or "method" not in asked:
            return failed(INVALID_REQUEST, "no request")
        id_, method, params = asked.get("id"), asked["method"], asked.get("params") or {}
        if id_ is None:
            return None
        if method == "initialize":
            result: Any = {"protocolVersion": "2024-11-05", "capabilities": {"tools": {}}, "serverInfo": {"name": "loamline", "version": "1"}}
        elif method == "tools/list":
            result = {"tools": described()}
        elif method == "tools/call":
            if (tool := self.tools.get(params.get("name", ""))) is None:
                return failed(UNKNOWN_METHOD, f"unknown tool {params.get('name')!r}", id_)
            try:
                result = {"content": [{"type": "text", "text": tool(checked_arguments(params["name"], params.get("arguments") or {}))}]}
            except (Invalid, KeyError) as error:
                return failed(INVALID_PARAMS, str(error), id_)
            except Exception as error:
                return failed(INTERNAL, str(error)[:500], id_)
        else:
            return failed(UNKNOWN_METHOD, f"unknown method {method!r}", id_)
        return {"jsonrpc": "2.0", "id": id_, "result": result}

    def handle(self, lines: Iterable[str]) -> Iterator[str]:
        for line in lines:
            if line.strip() and (answer := self.answer(line)) is not None:
                yield json.dumps(answer, ensure_ascii=False)


def server(service: Service, port: int, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """An HTTP server: ``GET /health``, and ``POST /tools/<name>`` with a tool's arguments as JSON."""

    class Handler(BaseHTTPRequestHandler):
        def reply(self, code: int, text: str) -> None:
            body = text.encode("utf-8")
            self.send_response(code)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def do_GET(self) -> None:
            self.reply(200, '{"status": "ok"}') if self.path == "/health" else self.reply(405, '{"error": "POST only"}')

        def do_POST(self) -> None:
            name = self.path.removeprefix("/tools/")
            tool = service.tools.get(name)
            if tool is None:
                self.reply(404, '{"error": "unknown tool"}')
                return
            try:
                asked = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or b"{}")
                self.reply(200, tool(checked_arguments(name, asked)))
            except (Invalid, KeyError, ValueError) as error:
                self.reply(400, json.dumps({"error": str(error)}, ensure_ascii=False))

        def log_message(self, *_: Any) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
