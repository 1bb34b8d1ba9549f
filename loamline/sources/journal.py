"""The event journal as a Spark data source: batch, and streams that follow growing files.

``spark.read.format("journal").load(folder)`` reads every ``*.lgp`` file under a folder;
``spark.readStream.format("journal")`` follows them from the byte after the last whole
record.  Files are listed and read through pyarrow's file systems.  A file is a partition
of a batch read, as quotes may cross any place that it could be split at; very large files
are read in windows, never whole.
"""

from __future__ import annotations

import json
import logging
import os
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from . import framing

log = logging.getLogger(__name__)

SCHEMA = "path string, end_offset bigint, tokens array<string>, items array<struct<kind:string,value:string>>"
#: Bytes read at once; a record that is longer makes the window grow.
WINDOW = 16 << 20
#: Bytes that one micro-batch takes from a file, about.
BATCH_BYTES = 256 << 20


def file_system(path: str):
    """A pyarrow file system and the path in it; plain paths and ``file:`` URIs are local."""
    from pyarrow import fs

    if "://" not in path:
        return fs.LocalFileSystem(), os.path.abspath(path.removeprefix("file:"))
    return fs.FileSystem.from_uri(path)


def files_under(path: str, ending: str) -> list[tuple[str, int]]:
    """(path, size) of the files under a folder whose names end so, in order; a file stands for itself."""
    from pyarrow import fs

    system, root = file_system(path)
    info = system.get_file_info(root)
    found = system.get_file_info(fs.FileSelector(root, recursive=True)) if info.type == fs.FileType.Directory else [info]
    return sorted((x.path, x.size) for x in found if x.type == fs.FileType.File and x.path.lower().endswith(ending))


def read_records(root: str, path: str, start: int, stop: int, keep_empty: bool, escapes: bool = True) -> Iterator[tuple]:
    """Rows of the records that end in ``(start, stop]``; start 0 is before the header.

    A file that does not start like a journal, or cannot be read, has no rows and is told of in the log.
    """
    system, _ = file_system(root)
    try:
        opened = system.open_input_file(path)
    except FileNotFoundError:
        log.warning("%s is gone and was skipped", path)
        return
    with opened as file:
        if start == 0:
            try:
                start = framing.body_start(file.read_at(min(stop, 4096), 0))
            except ValueError as error:
                log.warning("%s was skipped: %s", path, error)
                return
        data, base = b"", start
        while base + len(data) < stop:
            data += file.read_at(min(max(WINDOW, len(data)), stop - base - len(data)), base + len(data))
            used = 0
            for end, record in framing.records(data, 0, escapes):
                used = end
                if (row := framing.record_row(record, keep_empty, escapes)) is not None:
                    yield path, base + end, row[0], row[1]
            data, base = data[used:], base + used


class FilePart(InputPartition):
    def __init__(self, path: str, start: int, stop: int):
        super().__init__((path, start, stop))
        self.path, self.start, self.stop = path, start, stop


def told(options: dict) -> tuple[bool, bool]:
    """Whether empty tokens are kept and backslashes escape, as the source's options say."""
    return options.get("strict", "false").lower() != "true", options.get("escapes", "true").lower() == "true"


class JournalReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folders, (self.keep_empty, self.escapes) = json.loads(options["folders"]) if "folders" in options else [options["path"]], told(options)
        self.root = self.folders[0] if self.folders else ""

    def partitions(self) -> list[FilePart]:
        return [FilePart(path, 0, size) for folder in self.folders for path, size in files_under(folder, ".lgp") if size]

    def read(self, part: FilePart) -> Iterator[tuple]:
        yield from read_records(self.root, part.path, part.start, part.stop, self.keep_empty, self.escapes)


def last_record(file, done: int, size: int, most: int, escapes: bool = True) -> int:
    """Where the last whole record of about ``most`` bytes from ``done`` ends; more are read until one fits.

    A file that is no journal (yet) stays where it is.
    """
    try:
        skip = 0 if done else framing.body_start(file.read_at(min(size, 4096), 0))
    except ValueError:
        return done
    while True:
        data, last = file.read_at(min(most, size - done), done), 0
        for last, _ in framing.records(data, skip, escapes):
            pass
        if last or done + len(data) >= size:
            return done + last
        most *= 2


def reached(step: Callable[[int], int], done: int, until_end: bool) -> int:
    """The offset after one step from ``done``; with ``until_end`` that from which no step goes on."""
    while (after := step(done)) > done and until_end:
        done = after
    return after


class JournalStream(DataSourceStreamReader):
    """Offsets are bytes per file, at the end of a whole record; a file that shrank starts anew.

    With ``untilend`` the latest offset is the end of what the files hold: a run that ends
    asks for it once only.
    """

    def __init__(self, options: dict):
        self.root, (self.keep_empty, self.escapes) = options["path"], told(options)
        self.most, self.until_end = int(options.get("maxbytesperfile", BATCH_BYTES)), options.get("untilend", "false").lower() == "true"
        self.known: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        system, _ = file_system(self.root)
        for path, size in files_under(self.root, ".lgp"):
            done = self.known.get(path, 0)
            done = 0 if size < done else done
            if size > done:
                with system.open_input_file(path) as file:
                    done = reached(lambda at: last_record(file, at, size, self.most, self.escapes), done, self.until_end)
            self.known[path] = done
        return {"files": json.dumps(self.known, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[FilePart]:
        before, after = json.loads(start["files"]), json.loads(end["files"])
        self.known = self.known or dict(after)
        parts = []
        for path, stop in after.items():
            begin = before.get(path, 0)
            begin = 0 if stop < begin else begin
            if stop > begin:
                parts.append(FilePart(path, begin, stop))
        return parts

    def read(self, part: FilePart) -> Iterator[tuple]:
        yield from read_records(self.root, part.path, part.start, part.stop, self.keep_empty, self.escapes)

    def commit(self, end: dict) -> None:
        pass


class JournalSource(DataSource):
    """Options: ``path``, or of a batch read ``folders`` (a JSON list in one file system); ``strict`` (true: empty tokens are left out, as other readers do);
    ``escapes`` (false: a backslash in quotes is a character like any other);
    of streams ``maxbytesperfile`` and ``untilend`` (true: a batch takes all there is)."""

    @classmethod
    def name(cls) -> str:
        return "journal"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> JournalReader:
        return JournalReader(self.options)

    def streamReader(self, schema) -> JournalStream:
        return JournalStream(self.options)


def raw_records(spark: SparkSession, path: str | list[str], strict: bool = False, escapes: bool = True) -> DataFrame:
    spark.dataSource.register(JournalSource)
    reader = spark.read.format("journal").options(strict=str(strict).lower(), escapes=str(escapes).lower())
    return reader.load(path) if isinstance(path, str) else reader.option("folders", json.dumps(path)).load()


def infobase_of(path: Column) -> Column:
    """The infobase that a file of a journal (``<infobase>/1Cv8Log/<file>``) belongs to."""
    return F.lower(F.regexp_extract(path, r"([^/\\]*)[/\\][^/\\]*[/\\][^/\\]*$", 1))


def dictionary(spark: SparkSession, path: str | list[str], by_infobase: bool = False) -> DataFrame:
    """A journal's dictionary file: ``object_type, number, value, uuid``; the last entry of a key counts.

    Users (1) and metadata (5) have a GUID before their name and need four parts; types from 9
    on are no dictionary.  Entries are lines, the first two of which are the header.  With
    ``by_infobase`` several files are read, and ``infobase`` tells whose an entry is.
    """
    own = ["infobase"] if by_infobase else []
    whole = spark.read.text(path, wholetext=True).select("value", infobase_of(F.input_file_name()).alias("infobase"))
    lines = whole.select(*own, F.posexplode(F.split(F.regexp_replace("value", "^﻿", ""), "\r?\n")).alias("line_no", "line")).where("line_no >= 2")
    body = F.regexp_extract(F.trim("line"), r"^\{(.*)\},?$", 1)
    parts = F.transform(F.regexp_extract_all(body, F.lit(r'("(?:[^"]|"")*"|[^,]*)(?:,|$)'), F.lit(1)), lambda x: F.regexp_replace(F.trim(x), '^"(.*)"$', "$1"))
    rows = lines.select(*own, "line_no", parts.alias("p")).withColumn("object_type", F.get("p", F.lit(0)).try_cast("int"))
    named = F.col("object_type").isin(1, 5)
    four = F.size(F.filter("p", lambda x: x.isNotNull())) >= 4
    rows = rows.where(F.col("object_type").between(1, 8) & (~named | (F.size("p") >= 5) | four))
    rows = rows.withColumns({
        "number": F.coalesce(F.when(named, F.get("p", F.lit(3))).otherwise(F.coalesce(F.when(F.get("p", F.lit(3)) != "", F.get("p", F.lit(3))), F.get("p", F.lit(2)))).try_cast("bigint"), F.lit(0)),
        "value": F.when(named, F.get("p", F.lit(2))).otherwise(F.get("p", F.lit(1))), "uuid": F.when(named, F.get("p", F.lit(1))).otherwise(""),
    })
    last = rows.groupBy(*own, "object_type", "number").agg(F.max_by(F.struct("value", "uuid"), "line_no").alias("x"))
    return last.select(*own, "object_type", "number", "x.value", "x.uuid")


def registry(spark: SparkSession, path: str) -> DataFrame:
    """A cluster registry file: ``cluster_guid, cluster_name, infobase_guid, infobase_name``.

    Pairs of a GUID and a quoted name; the first is the cluster, the others its infobases.
    """
    text = spark.read.text(path, wholetext=True)
    pair = r'\{([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}),"([^"]+)"'
    rows = text.select(F.monotonically_increasing_id().alias("file"), F.regexp_extract_all("value", F.lit(pair), F.lit(1)).alias("guids"), F.regexp_extract_all("value", F.lit(pair), F.lit(2)).alias("names"))
    rows = rows.where(F.size("guids") > 0).select("file", F.get("guids", F.lit(0)).alias("cluster_guid"), F.get("names", F.lit(0)).alias("cluster_name"), F.posexplode(F.arrays_zip("guids", "names")).alias("at", "pair"))
    return rows.where("at > 0").groupBy("cluster_guid", "cluster_name", F.col("pair.guids").alias("infobase_guid")).agg(F.max_by("pair.names", "at").alias("infobase_name"))
