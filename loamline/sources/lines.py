"""Trace-log files as lines, and other small inputs of the engine."""

from __future__ import annotations

import io
import os
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .journal import file_system, files_under

GUID = re.compile(r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")
#: A line that starts a trace record in one of the three layouts.
STARTS = r"^(\x{FEFF})?(\{|\d{2,}:\d{2}\.\d+-\d+,|\d{4}-\d{2}-\d{2}T)"


def trace_lines(spark: SparkSession, path: str) -> DataFrame:
    """``value, path`` of the lines of every ``.log`` file under a folder, and of gzipped ones."""
    text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{log,log.gz}").text(path)
    return text.where("value <> ''").select("value", F.input_file_name().alias("path"))


def zipped_lines(spark: SparkSession, path: str) -> DataFrame:
    """The same from the ``.log`` members of ``.zip`` files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.zip").load(path).select("path", "content")

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for where, content in zip(batch["path"], batch["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as box:
                    for name in box.namelist():
                        if name.endswith(".log"):
                            with box.open(name) as member:
                                lines = [x.decode("utf-8", "replace").rstrip("\r\n") for x in member]
                            yield pd.DataFrame({"value": [x for x in lines if x], "path": f"{os.path.dirname(where)}/{name}"})

    return files.mapInPandas(unpack, "value string, path string")


def joined_lines(lines: DataFrame, order: str) -> DataFrame:
    """Lines that start no record put after the one that does, within a file (``path``)."""
    running = Window.partitionBy("path").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    numbered = lines.withColumn("record", F.sum(F.col("value").rlike(STARTS).cast("int")).over(running)).where("record > 0")
    whole = numbered.groupBy("path", "record").agg(F.sort_array(F.collect_list(F.struct(order, "value"))).alias("parts"), F.min(order).alias(order))
    return whole.select("path", order, F.array_join(F.transform("parts", lambda x: x["value"]), "\n").alias("value"))


def journal_locations(roots: list[str]) -> list[dict]:
    """Every journal below the roots: a folder ``1Cv8Log`` with a dictionary file.

    ``path, infobase_guid, registry`` (the folder of the cluster's registry) ``, files``.
    """
    out = []
    for root in roots:
        try:
            found = files_under(root, "1cv8.lgf")
        except OSError:
            continue
        for path, _ in found:
            folder = os.path.dirname(path)
            if os.path.basename(folder) == "1Cv8Log":
                infobase = os.path.dirname(folder)
                out.append({"path": folder, "infobase_guid": os.path.basename(infobase), "registry": os.path.dirname(infobase), "files": [p for p, _ in files_under(folder, ".lgp")]})
    return out


def trace_locations(root: str) -> list[dict]:
    """Folders ``<cluster GUID>/<infobase GUID>`` directly below a trace log's root."""
    from pyarrow import fs

    system, base = file_system(root)

    def folders(where: str) -> list[str]:
        return sorted(x.path for x in system.get_file_info(fs.FileSelector(where)) if x.type == fs.FileType.Directory and GUID.match(x.base_name.lower()))

    return [{"path": inner, "cluster_guid": os.path.basename(outer).lower(), "infobase_guid": os.path.basename(inner).lower()} for outer in folders(base) for inner in folders(outer)]


def trace_format(folder: str) -> str:
    """``json`` or ``text``: as a ``logcfg.xml`` in the folder says, else by the newest log's first character."""
    system, base = file_system(folder)
    for path, _ in files_under(folder, "logcfg.xml"):
        with system.open_input_file(path) as file:
            for element in ET.fromstring(file.read()).iter():
                if element.tag.endswith("log") and (said := element.get("format", "").lower()) in ("json", "text"):
                    return said
    for path, _ in reversed(files_under(folder, ".log")):
        with system.open_input_file(path) as file:
            head = file.read_at(min(file.size(), 4096), 0).removeprefix(b"\xef\xbb\xbf").lstrip()
            if head:
                return "json" if head.startswith(b"{") else "text"
    return "text"


def names_from_mapping(spark: SparkSession, document: dict, kind: str) -> DataFrame:
    """``guid, name`` of a mapping document's ``clusters`` or ``infobases``."""
    rows = [(guid, (entry or {}).get("name") or guid) for guid, entry in (document.get(kind) or {}).items()]
    return spark.createDataFrame(rows, "guid string, name string")


def read_mapping(text: str) -> dict:
    """The mapping document's text: two levels of keys and plain values, as YAML writes them.

    PyYAML is used where it is installed.
    """
    try:
        import yaml

        return yaml.safe_load(text) or {}
    except ImportError:
        out: dict = {}
        path: list[tuple[int, dict]] = [(-1, out)]
        for line in text.splitlines():
            if not line.strip() or line.lstrip().startswith("#"):
                continue
            indent, (key, _, value) = len(line) - len(line.lstrip()), line.strip().partition(":")
            while path[-1][0] >= indent:
                path.pop()
            value = value.strip().strip("\"'")
            if value:
                path[-1][1][key.strip("\"'")] = value
            else:
                path[-1][1][key.strip("\"'")] = inner = {}
                path.append((indent, inner))
        return out


#: Labels of a spreadsheet export's columns, which are no values.
LABELS = ["Дата, время", "Событие", "Пользователь", "Компьютер", "Приложение", "Сеанс", "Комментарий", "Метаданные", "Данные", "Представление данных", "Уровень"]


def spreadsheet_records(spark: SparkSession, path: str) -> DataFrame:
    """A spreadsheet-XML export as ``record, DateTime, Fields``: a cell with a time opens a record."""
    rows = spark.read.format("xml").option("rowTag", "Row").schema("Cell array<struct<Data:struct<_VALUE:string>>>").load(path)
    cells = rows.select(F.monotonically_increasing_id().alias("row"), F.posexplode("Cell").alias("col", "cell")).select("row", "col", F.trim("cell.Data._VALUE").alias("text"))
    cells = cells.where(F.col("text").isNotNull() & (F.col("text") != "") & ~F.col("text").isin(*LABELS))
    is_time = F.col("text").rlike(r"^\d{2}\.\d{2}\.\d{4} \d{2}:\d{2}:\d{2}$")
    order = Window.orderBy("row", "col").rowsBetween(Window.unboundedPreceding, 0)
    numbered = cells.withColumn("record", F.sum(is_time.cast("int")).over(order)).where("record > 0")
    whole = numbered.groupBy("record").agg(F.sort_array(F.collect_list(F.struct("row", "col", "text"))).alias("parts"))
    texts = F.transform("parts", lambda x: x["text"])
    return whole.select("record", F.get(texts, F.lit(0)).alias("DateTime"), F.slice(texts, 2, F.greatest(F.size(texts) - 1, F.lit(0))).alias("Fields"))
