"""Comparing two sets of records, and rows with equal hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Places that the order is cut at, so that no task numbers all rows.
CUTS = 200


def numbered(rows: DataFrame, order: list[str], name: str = "place") -> DataFrame:
    """Rows with their place from 1; the order's ranges are counted first, so no task holds all rows.

    The ranges are cut at the keys with the least hashes.  A row's range so depends on its key
    alone: partitions' numbers differ from one pass over the same rows to the next.
    """
    key = F.struct(*order)
    least = rows.select(key.alias("key")).distinct().orderBy(F.xxhash64("key"), "key").limit(CUTS)
    cuts = least.agg(F.sort_array(F.collect_list("key")).alias("cuts"))
    spread = rows.withColumn("cuts", cuts.scalar()).withColumn("part", F.size(F.filter("cuts", lambda cut: cut <= key))).drop("cuts")
    sizes = spread.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    spread = spread.withColumn("own", F.row_number().over(Window.partitionBy("part").orderBy(*order)))
    return spread.join(F.broadcast(before.select("part", "before")), "part").withColumn(name, F.col("before") + F.col("own")).drop("part", "own", "before")


def alike(a: Column, b: Column) -> Column:
    """Equal, or one starts with the other, as exports cut long values."""
    return (a == b) | a.startswith(b) | b.startswith(a)


def compared(expected: DataFrame, actual: DataFrame, order: list[str], time: str, texts: list[str], tolerance: int = 60) -> DataFrame:
    """Both sides zipped by place: ``place, status, differs`` (names of fields that do not agree).

    Times agree within ``tolerance`` seconds, fractions counted; a record without a partner is ``missing`` or ``extra``.
    """
    a = numbered(expected.select(*{*order, time, *texts}), order).select("place", *(F.col(c).alias(f"a_{c}") for c in [time, *texts]), F.lit(True).alias("in_a"))
    b = numbered(actual.select(*{*order, time, *texts}), order).select("place", *(F.col(c).alias(f"b_{c}") for c in [time, *texts]), F.lit(True).alias("in_b"))
    both = a.join(b, "place", "full_outer")
    micros = lambda side: F.unix_micros(F.col(f"{side}_{time}").cast("timestamp"))
    late = F.abs(micros("a") - micros("b")) > tolerance * 1_000_000
    off = [F.when(late, F.lit(time)), *(F.when(~alike(F.coalesce(F.col(f"a_{c}"), F.lit("")), F.coalesce(F.col(f"b_{c}"), F.lit(""))), F.lit(c)) for c in texts)]
    differs = F.filter(F.array(*off), lambda x: x.isNotNull())
    status = F.when(F.col("in_b").isNull(), "missing").when(F.col("in_a").isNull(), "extra").when(F.size(differs) > 0, "differs").otherwise("same")
    return both.select("place", status.alias("status"), F.when(F.col("in_a") & F.col("in_b"), differs).otherwise(F.array().cast("array<string>")).alias("differs"))


def repeated(rows: DataFrame, key: str = "record_hash") -> DataFrame:
    """Hashes that several rows have, how many, and which columns differ among them."""
    rest = [c for c in rows.columns if c != key]

    def spread(name: str) -> Column:
        """Whether a column has different values; null is one of its own."""
        text = F.col(name).cast("string")
        return F.coalesce(F.min(text) != F.max(text), F.lit(False)) | ((F.count(text) > 0) & (F.count(text) < F.count(F.lit(1))))

    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("copies"), *(spread(c).alias(f"n_{c}") for c in rest))
    varied = F.filter(F.array(*(F.when(F.col(f"n_{c}"), F.lit(c)) for c in rest)), lambda x: x.isNotNull())
    return counts.where("copies > 1").select(key, "copies", varied.alias("varied"))
