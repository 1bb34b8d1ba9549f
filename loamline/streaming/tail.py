"""Following journals and trace logs with Structured Streaming.

The journal is followed by its own source (``sources.journal``); trace logs by ``tracelog``,
which reads what was appended to every log file since the last whole line.  Rows are stored
batch by batch, and the checkpoint holds the files' offsets.  A batch that is repeated after a
failure adds nothing: its number is noted beside the checkpoint once its rows are stored, or,
with ``deduplicate``, rows are known by their hashes, which also keeps equal records once.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..functions import journal as fields
from ..functions import trace
from ..operators import enrich, store
from ..sources import journal
from ..sources.journal import FilePart, file_system, files_under, reached

POLL = "500 milliseconds"


#: Bytes looked at at once for the last line's end.
BACK = 1 << 20


def last_line(file, done: int, size: int, most: int) -> int:
    """Where the last whole line of about ``most`` bytes from ``done`` ends; more are read until one fits."""
    while True:
        end = at = min(size, done + most)
        while at > done:
            begin = max(done, at - BACK)
            if (cut := file.read_at(at - begin, begin).rfind(b"\n")) >= 0:
                return begin + cut + 1
            at = begin
        if end >= size:
            return done
        most *= 2


class LogStream(DataSourceStreamReader):
    """Lines appended to ``.log`` files; offsets are bytes at the end of a line, and a shrunk file starts anew."""

    def __init__(self, options: dict):
        self.root, self.most = options["path"], int(options.get("maxbytesperfile", journal.BATCH_BYTES))
        self.until_end = options.get("untilend", "false").lower() == "true"
        self.known: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        system, _ = file_system(self.root)
        for path, size in files_under(self.root, ".log"):
            done = self.known.get(path, 0)
            done = 0 if size < done else done
            if size > done:
                with system.open_input_file(path) as file:
                    done = reached(lambda at: last_line(file, at, size, self.most), done, self.until_end)
            self.known[path] = done
        return {"files": json.dumps(self.known, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[FilePart]:
        before, after = json.loads(start["files"]), json.loads(end["files"])
        self.known = self.known or dict(after)
        return [FilePart(p, 0 if stop < before.get(p, 0) else before.get(p, 0), stop) for p, stop in after.items() if stop != before.get(p, 0) and stop > 0]

    def read(self, part: FilePart) -> Iterator[tuple]:
        system, _ = file_system(self.root)
        with system.open_input_file(part.path) as file:
            at, rest = part.start, b""
            while at < part.stop:
                data = rest + file.read_at(min(journal.WINDOW, part.stop - at), at)
                at += len(data) - len(rest)
                *whole, rest = data.split(b"\n")
                for line in whole:
                    if text := line.rstrip(b"\r").decode("utf-8", "replace"):
                        yield text, part.path

    def commit(self, end: dict) -> None:
        pass


class LogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tracelog"

    def schema(self) -> str:
        return "value string, path string"

    def streamReader(self, schema) -> LogStream:
        return LogStream(self.options)


def _start(rows: DataFrame, save: Callable[[DataFrame, int], None], checkpoint: str, follow: bool) -> StreamingQuery:
    writer = rows.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=POLL) if follow else writer.trigger(availableNow=True)).start()


def stored(rows: DataFrame, table: str, layout: str, checkpoint: str, number: int, deduplicate: bool, retry: dict) -> None:
    """Stores the rows of a stream's batch once."""
    spark = rows.sparkSession
    if deduplicate:
        store.retry(lambda: store.append_unseen(rows, table, layout), **retry)
        return
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}-stored/{number}")
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(path):
        store.retry(lambda: store.append(rows, table, layout), **retry)
        system.create(path).close()


def follow_traces(spark: SparkSession, folder: str, table: str, checkpoint: str, names: DataFrame | None = None, follow: bool = True, deduplicate: bool = True, retry: dict | None = None) -> StreamingQuery:
    """Stores a folder's trace records as they are written; ``follow=False`` stops when all is read."""
    spark.dataSource.register(LogSource)
    lines = spark.readStream.format("tracelog").option("untilend", not follow).load(folder)

    def save(batch: DataFrame, number: int) -> None:
        rows = trace.tech_records(batch)
        rows = rows if names is None else enrich.with_names(rows, names).select(rows.columns)
        stored(rows, table, "tech_log", checkpoint, number, deduplicate, retry or {})

    return _start(lines, save, checkpoint, follow)


def follow_journal(spark: SparkSession, location: dict, table: str, checkpoint: str, names: dict | None = None, follow: bool = True, deduplicate: bool = True, retry: dict | None = None) -> StreamingQuery:
    """Stores a journal's records as they are written; the dictionary is read anew for each batch."""
    spark.dataSource.register(journal.JournalSource)
    records = spark.readStream.format("journal").option("untilend", not follow).load(location["path"])
    shown = {"cluster_guid": "", "cluster_name": "", "infobase_name": ""} | (names or {}) | {"infobase_guid": location["infobase_guid"]}

    def save(batch: DataFrame, number: int) -> None:
        rows = batch.withColumns({k: F.lit(v) for k, v in shown.items()})
        path = journal.files_under(location["path"], "1cv8.lgf")[0][0]
        rows = fields.journal_records(enrich.with_dictionary(fields.decoded(rows), journal.dictionary(spark, path)))
        stored(rows, table, "event_log", checkpoint, number, deduplicate, retry or {})

    return _start(records, save, checkpoint, follow)


class MetricsListener(StreamingQueryListener):
    """Collects a metrics row for every batch of a stream; ``rows`` are those not yet taken."""

    def __init__(self, parser_type: str):
        self.parser_type, self.rows = parser_type, []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        took = p.durationMs.get("triggerExecution", 0)
        self.rows.append({"parser_type": self.parser_type, "records_parsed": p.numInputRows, "parsing_time_ms": took, "records_per_second": float(p.processedRowsPerSecond or 0), "writing_time_ms": p.durationMs.get("addBatch", 0), "updated_at": datetime.now(timezone.utc)})

    def onQueryTerminated(self, event) -> None:
        pass
