"""The dashboards' queries over the journal's table, as functions of a frame and parameters.

``window`` is a pair of times, both included; ``infobases`` limits the infobases, None being all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lookups import WEEKDAYS

ERRORS, WARNINGS = ("Error", "Ошибка"), ("Warning", "Предупреждение")
CHANGES = ("Данные.Изменение", "Данные.Создание", "Данные.Удаление")
Times = tuple[str, str]


def stamp(text: str) -> Column:
    return F.lit(text).cast("timestamp")


def within(rows: DataFrame, window: Times | None, time: str = "event_time", day: str | None = "event_date") -> DataFrame:
    """Rows of a time window; the day column is limited too, so that partitions are pruned."""
    if window is None:
        return rows
    start, end = map(stamp, window)
    rows = rows.where(F.col(time).between(start, end))
    return rows.where(F.col(day).between(F.to_date(start), F.to_date(end))) if day in rows.columns else rows


def among(rows: DataFrame, names: list[str] | None, column: str = "infobase_name") -> DataFrame:
    return rows if names is None else rows.where(F.col(column).isin(names))


def recent(now: str, hours: int) -> Times:
    from datetime import datetime, timedelta

    end = datetime.fromisoformat(now)
    return (end - timedelta(hours=hours)).isoformat(sep=" "), end.isoformat(sep=" ")


def _by_infobase(rows: DataFrame, value: Column) -> DataFrame:
    return rows.groupBy(F.col("infobase_name").alias("infobase")).agg(value).orderBy("infobase")


def errors_by_infobase(rows: DataFrame, window: Times | None = None, infobases=None) -> DataFrame:
    return _by_infobase(among(within(rows, window), infobases).where(F.col("level").isin(*ERRORS)), F.count(F.lit(1)).alias("errors_count"))


def warnings_by_infobase(rows: DataFrame, window: Times | None = None, infobases=None) -> DataFrame:
    return _by_infobase(among(within(rows, window), infobases).where(F.col("level").isin(*WARNINGS)), F.count(F.lit(1)).alias("warnings_count"))


def distinct_count(column: str, exact: bool) -> Column:
    return F.count_distinct(column) if exact else F.approx_count_distinct(column, 0.02)


def unique_users(rows: DataFrame, window: Times | None = None, infobases=None, exact: bool = False) -> DataFrame:
    return _by_infobase(among(within(rows, window), infobases).where("user_name <> ''"), distinct_count("user_name", exact).alias("unique_users"))


def unique_sessions(rows: DataFrame, window: Times | None = None, infobases=None, exact: bool = False) -> DataFrame:
    return _by_infobase(among(within(rows, window), infobases).where("session_id > 0"), distinct_count("session_id", exact).alias("unique_sessions"))


def list_infobases(rows: DataFrame, by_cluster: bool = False) -> DataFrame:
    """Infobases by name, or by their (first) cluster and name."""
    names = rows.where("infobase_name <> ''").groupBy("infobase_name").agg(F.min("cluster_name").alias("cluster"))
    return names.orderBy(*(["cluster", "infobase_name"] if by_cluster else ["infobase_name"])).select("infobase_name")


def list_comments(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("level").isin(*ERRORS) & (F.col("comment_normalized") != "")).select("comment_normalized").distinct().orderBy("comment_normalized")


def list_metadata(rows: DataFrame) -> DataFrame:
    names = rows.where("metadata_presentation <> ''").groupBy("metadata_presentation").agg(F.min("cluster_name").alias("cluster"))
    return names.orderBy("cluster", "metadata_presentation").select("metadata_presentation")


def _errors(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("level").isin(*ERRORS) & (F.col("comment_normalized") != "") & (F.col("comment") != ""))


def new_error_keys(rows: DataFrame, window: Times, infobases=None, days: int = 30) -> DataFrame:
    """Fingerprints of a window that their infobase did not have in the days before its first row."""
    rows = among(rows, infobases)
    now = within(rows, window)
    start = now.agg(F.min("event_time").alias("start"))
    earlier = rows.where(F.col("event_time").between(stamp(window[0]) - F.expr(f"INTERVAL {days} DAY"), stamp(window[1])))
    first = start.scalar()
    history = _errors(earlier).where((F.col("event_time") >= first - F.expr(f"INTERVAL {days} DAY")) & (F.col("event_time") < first))
    keys = ["comment_normalized", "infobase_name"]
    return _errors(now).select(*keys, "cluster_name").distinct().join(history.select(*keys).distinct(), keys, "left_anti")


def new_errors_by_infobase(rows: DataFrame, window: Times, infobases=None) -> DataFrame:
    found = new_error_keys(rows, window, infobases).groupBy("infobase_name", "cluster_name").agg(F.count(F.lit(1)).alias("new_errors_count"))
    return found.orderBy("cluster_name", "infobase_name").select(F.col("infobase_name").alias("infobase"), "new_errors_count")


def new_error_details(rows: DataFrame, window: Times, infobases=None, limit: int = 1000) -> DataFrame:
    keys = new_error_keys(rows, window, infobases).select("comment_normalized", "infobase_name").distinct()
    found = _errors(among(within(rows, window), infobases)).join(keys, ["comment_normalized", "infobase_name"], "left_semi")
    columns = ["comment_normalized", "infobase_name", "event_time", "user_name", "metadata_presentation", "data_presentation", "comment"]
    return found.orderBy("comment_normalized", F.desc("event_time"), "comment").limit(limit).select(columns)


def _top(rows: DataFrame, keys: list[Column], count: str, limit: int, *more: Column) -> DataFrame:
    grouped = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias(count), *more)
    names = [c for c in grouped.columns if c != count]
    return grouped.orderBy(F.desc(count), *names[: len(keys)]).limit(limit)


def _any_comment(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("level").isin(*ERRORS) & ((F.col("comment_normalized") != "") | (F.col("comment") != "")))


def top_fingerprints(rows: DataFrame, window: Times | None = None, infobases=None, limit: int = 20) -> DataFrame:
    found = _any_comment(among(within(rows, window), infobases))
    return _top(found, [F.col("comment_normalized")], "error_count", limit, F.min("event_time").alias("first_seen"), F.max("event_time").alias("last_seen"), F.min("comment").alias("example"))


def filled(*options: Column, default: str) -> Column:
    out = F.lit(default)
    for option in reversed(options):
        out = F.when(option != "", option).otherwise(out)
    return out


def errors_by_metadata(rows: DataFrame, window: Times | None = None, infobases=None, limit: int = 500) -> DataFrame:
    what = filled(F.col("metadata_presentation"), F.col("metadata_name"), default="(без метаданных)")
    return _top(_any_comment(among(within(rows, window), infobases)), [what.alias("metadata"), filled(F.col("comment_normalized"), default="(без нормализации)").alias("fingerprint")], "errors", limit)


def errors_by_user(rows: DataFrame, window: Times | None = None, infobases=None, limit: int = 500) -> DataFrame:
    who = filled(F.col("user_name"), default="(без пользователя)")
    return _top(_any_comment(among(within(rows, window), infobases)), [who.alias("user"), filled(F.col("comment_normalized"), default="(без нормализации)").alias("fingerprint")], "errors", limit)


EXPLORER = "event_time cluster_name infobase_name level event_presentation user_name computer application_presentation session_id connection transaction_status transaction_id metadata_presentation data_presentation comment comment_normalized server".split()


def explorer(rows: DataFrame, limit: int = 1000) -> DataFrame:
    return rows.orderBy(F.desc("event_time"), "record_hash").limit(limit).select(EXPLORER)


def metadata_top(rows: DataFrame, window: Times | None = None, metadata=None, limit: int = 20) -> DataFrame:
    return _top(among(within(rows, window), metadata, "metadata_presentation").where("metadata_presentation <> ''"), [F.col("metadata_presentation").alias("metadata")], "events", limit)


def metadata_types(rows: DataFrame, window: Times | None = None, metadata=None, exact: bool = False) -> DataFrame:
    kind = filled(F.split_part("metadata_presentation", F.lit("."), F.lit(1)), default="Unknown")
    found = among(within(rows, window), metadata, "metadata_presentation").where("metadata_presentation <> ''")
    out = found.groupBy(kind.alias("metadata_type")).agg(F.count(F.lit(1)).alias("events"), distinct_count("metadata_presentation", exact).alias("objects"))
    return out.orderBy(F.desc("events"), "metadata_type")


def bucket(time: Column, seconds: int) -> Column:
    micros = F.unix_micros(time.cast("timestamp"))
    return F.timestamp_micros(micros - F.pmod(micros, F.lit(seconds * 1_000_000)))


def changes_timeseries(rows: DataFrame, window: Times | None = None, metadata=None, events=CHANGES, seconds: int = 300) -> DataFrame:
    found = among(within(rows, window), metadata, "metadata_presentation").where(F.col("event_presentation").isin(*events) & (F.col("metadata_presentation") != ""))
    return found.groupBy(bucket(F.col("event_time"), seconds).alias("time"), F.col("event_presentation").alias("event")).agg(F.count(F.lit(1)).alias("events")).orderBy("time", "event")


def weekday(time: str = "event_time") -> Column:
    return F.weekday(time) + 1


def weekday_name(number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, WEEKDAYS)), number)


def activity_by_hour(rows: DataFrame, window: Times | None = None, infobases=None) -> DataFrame:
    return among(within(rows, window), infobases).groupBy(F.hour("event_time").alias("hour")).agg(F.count(F.lit(1)).alias("events")).orderBy("hour")


def activity_by_weekday(rows: DataFrame, window: Times | None = None, infobases=None) -> DataFrame:
    days = among(within(rows, window), infobases).groupBy(weekday().alias("day_order")).agg(F.count(F.lit(1)).alias("events"))
    return days.select(weekday_name(F.col("day_order")).alias("day_of_week"), "day_order", "events").orderBy("day_order")


def heatmap(rows: DataFrame, window: Times | None = None, infobases=None) -> DataFrame:
    cells = among(within(rows, window), infobases).groupBy(bucket(F.col("event_time"), 3600).alias("time")).agg(F.count(F.lit(1)).alias("value"))
    day, hour = weekday("time"), F.hour("time")
    label = F.concat(day.cast("string"), F.lit(". "), weekday_name(day), F.lit(" "), hour.cast("string"), F.lit(":00"))
    return cells.orderBy(day, hour, "time").select("time", label.alias("metric"), "value")


def _detail(exact: bool) -> list[Column]:
    return [F.count(F.lit(1)).alias("events"), distinct_count("user_name", exact).alias("users"), distinct_count("session_id", exact).alias("sessions")]


def hour_detail(rows: DataFrame, window: Times | None = None, infobases=None, exact: bool = False) -> DataFrame:
    return among(within(rows, window), infobases).groupBy(F.hour("event_time").alias("hour")).agg(*_detail(exact)).orderBy("hour")


def weekday_detail(rows: DataFrame, window: Times | None = None, infobases=None, exact: bool = False) -> DataFrame:
    days = among(within(rows, window), infobases).groupBy(weekday().alias("day_order")).agg(*_detail(exact))
    return days.select(weekday_name(F.col("day_order")).alias("day_of_week"), "day_order", "events", "users", "sessions").orderBy("day_order")
