"""Mixing sources to target weights by pivotal dependent rounding.

A source's rate is its target over its size; a document is copied ``floor(rate)`` times
and once more with the fractional probability.  Fractions are rounded in pairs: words
move at random from one document's fraction to the other's until one is 0 or 1, with
odds that leave every document's expectation as it was.  The words of a pair, and so of
a source, stay the same; only the last fraction of a source is rounded by itself.

Documents are dealt into small groups by a hash; a group leaves one open fraction, and a
tree of further groups joins these, so no task holds more than a few dozen documents of
a source at once, however large the source.  Rows that agree in id, source and size are
counted first and numbered after, so that they are dealt into groups like all others.
Large documents come first in a group: what stays open at the end, the only words by which
a source can miss its target, is small.  DataFrame functions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Stash, checked_broadcast, word_count

#: Documents, or open fractions, that one group rounds.
FAN = 64
#: Sources at which the sources are cut into ranges; equal rows that are numbered at once.
CUTS, RUN = 200, 4096


def uniform(*cols: Column, seed: int) -> Column:
    """A reproducible number in [0, 1) from the values of some columns."""
    return F.pmod(F.xxhash64(*cols, F.lit(seed)), F.lit(1 << 53)) / F.lit(float(1 << 53))


def ranked(stash: Stash, sources: DataFrame) -> DataFrame:
    """``sources`` with ``place``, their number from 0 by code point, null last; no task sees all of them.

    The sources are cut into ranges at those with the least hashes, and a range's rows are
    numbered after the ranges before it.
    """
    cuts = sources.where("source is not null").select("source").orderBy(F.xxhash64("source"), "source").limit(CUTS)
    cuts = stash.save(cuts.agg(F.sort_array(F.collect_list("source")).alias("cuts")), "cuts")
    # Null compares with no cut; it is put behind all of them.
    part = F.when(F.col("source").isNull(), CUTS + 1).otherwise(F.size(F.filter(F.col("cuts"), lambda cut: cut <= F.col("source"))))
    spread = stash.save(sources.withColumn("cuts", cuts.scalar()).withColumn("part", part).drop("cuts"), "ranges")
    before = spread.groupBy("part").agg(F.count(F.lit(1)).alias("rows"))
    before = before.select("part", F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("part").orderBy("source")) - 1
    return spread.withColumn("own", own).join(F.broadcast(before), "part").withColumn("place", F.col("before") + F.col("own")).drop("part", "own", "before")


def targets(stash: Stash, sizes: DataFrame, share: float, cap: float, weights: tuple[int, ...]) -> DataFrame:
    """``source, source_size, n, target``: shares by weight, capped, the excess shared again.

    Sharing an excess until nothing is above its cap gives ``min(cap, level * weight)``.  The
    level rises with every source that is found to be capped; each step sums over all
    sources, and the last one caps no further source.  ``sizes`` holds ``source, size, n``.
    """
    rows = stash.save(sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n")), "totals")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("double")
    rows = ranked(stash, rows).withColumn("weight", weight).withColumn("most", F.col("source_size") * cap)
    rows = stash.save(rows, "weighed")
    words = (rows.agg(F.sum("source_size")).first()[0] or 0) * share
    level, capped = 0.0, -1
    while True:
        over = F.col("most") <= F.col("weight") * level
        seen = rows.agg(F.count_if(over).alias("n"), F.sum(F.when(over, F.col("most")).otherwise(0.0)).alias("given"), F.sum(F.when(over, 0.0).otherwise(F.col("weight"))).alias("ahead")).first()
        if seen["n"] == capped or not seen["ahead"]:
            level = level if seen["ahead"] else float("inf")
            break
        capped, level = seen["n"], max(0.0, words - seen["given"]) / seen["ahead"]
    return rows.select("source", "source_size", "n", F.least(F.col("most"), F.col("weight") * F.lit(level)).alias("target"))


def folded(items: Column) -> Column:
    """Pivotal rounding along an array of (size, id, twin, base, p, u): the decided ones and the last open one."""

    def step(acc: Column, item: Column) -> Column:
        a, b = acc["open"], item
        up = F.least((1 - a["p"]) * a["size"], b["p"] * b["size"])
        down = F.least(a["p"] * a["size"], (1 - b["p"]) * b["size"])
        rises = b["u"] * (up + down) < down
        first_ends = F.when(rises, (1 - a["p"]) * a["size"] <= b["p"] * b["size"]).otherwise(a["p"] * a["size"] <= (1 - b["p"]) * b["size"])
        # The one that ends becomes 1 if it rose; the other keeps the words of both.
        done = F.when(first_ends, F.struct(a["id"].alias("id"), a["size"].alias("size"), (a["base"] + rises.cast("int")).alias("copies"))).otherwise(
            F.struct(b["id"].alias("id"), b["size"].alias("size"), (b["base"] + (~rises).cast("int")).alias("copies"))
        )
        words = a["p"] * a["size"] + b["p"] * b["size"]

        def kept(x: Column, y: Column, y_rose: Column) -> Column:
            p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (words - F.when(y_rose, y["size"]).otherwise(0)) / x["size"]))
            return F.struct(x["size"].alias("size"), x["id"].alias("id"), x["twin"].alias("twin"), x["base"].alias("base"), p.alias("p"), x["u"].alias("u"))

        return F.struct(F.when(first_ends, kept(b, a, rises)).otherwise(kept(a, b, ~rises)).alias("open"), F.array_append(acc["done"], done).alias("done"))

    none = F.expr("cast(array() as array<struct<id:bigint,size:bigint,copies:int>>)")
    return F.aggregate(F.slice(items, 2, F.size(items)), F.struct(items[0].alias("open"), none.alias("done")), step)


def mix(docs: DataFrame, *, share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = (5, 2, 1), seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``id, size, source, source_size, target, copies, taken`` of every row.

    ``copies`` is at most ``ceil(cap)``; ``taken = copies * size``.  The same rows and seed
    give the same result, whatever their order and partitions.  Null texts and texts without
    words have size 0 and are not taken; null is a source of its own, the last.  A source's
    taken words differ from its target by less than one document.  Rows that repeat an id, or
    have none, are rounded each on its own; very long texts are counted whole; an empty table
    gives an empty result.
    """
    spark = docs.sparkSession
    stash = Stash(spark, "mixing")
    read = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    sizes = stash.save(read.groupBy("id", "source", "size").agg(F.count(F.lit(1)).alias("n")), "sizes")
    sources = stash.save(targets(stash, sizes, share, cap, weights), "sources")
    side = checked_broadcast(sources.select(F.col("source").alias("s"), "source_size", F.col("n").alias("rows"), "target"))
    # Equal rows are numbered, a run of them at a time, each run dealt out anew.
    runs = sizes.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / RUN))))
    if sizes.agg(F.max("n")).first()[0] not in (None, 1):
        runs = runs.repartition("id", "source", "size", "run")
    last = F.least(F.col("n"), (F.col("run") + 1) * RUN) - 1
    each = runs.select("id", "source", "size", F.explode(F.sequence(F.col("run") * RUN, last)).alias("twin"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = each.join(side, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("rate", rate)
    rows = rows.withColumn("base", F.floor(F.col("rate") + 1e-12).cast("int")).withColumn("p", F.greatest(F.lit(0.0), F.col("rate") - F.col("base")))
    open_ = (F.col("size") > 0) & (F.col("p") > 1e-12)
    settled = rows.where(~open_).select("id", "source", "size", F.when(F.col("size") > 0, F.col("base")).otherwise(0).alias("copies"))

    groups = F.greatest(F.lit(1), F.ceil(F.col("rows") / FAN))
    item = F.struct("size", "id", "twin", "base", "p", uniform(F.col("id"), F.col("size"), F.col("twin"), seed=seed).alias("u"))
    level = rows.where(open_).select("source", F.pmod(F.xxhash64("id", "size", "twin", F.lit(seed)), groups).alias("bucket"), item.alias("item"))
    most = sources.agg(F.max(F.greatest(F.lit(1), F.ceil(F.col("n") / FAN)))).first()[0] or 1
    parts, depth = [settled], 0
    while True:
        depth += 1
        done = level.groupBy("source", "bucket").agg(F.sort_array(F.collect_list("item"), asc=False).alias("items")).select("source", "bucket", folded(F.col("items")).alias("x"))
        done = stash.save(done.select("source", "bucket", "x.open", "x.done"), f"level{depth}")
        parts.append(done.select("source", F.inline("done")).select("id", "source", "size", "copies"))
        if most <= 1:
            break
        most = -(-most // FAN)
        again = F.struct("open.size", "open.id", "open.twin", "open.base", "open.p", uniform(F.col("open.id"), F.col("open.size"), F.col("open.twin"), F.lit(depth), seed=seed).alias("u"))
        level = done.select("source", F.floor(F.col("bucket") / FAN).alias("bucket"), again.alias("item"))
    last = uniform(F.col("open.id"), F.col("open.size"), F.col("open.twin"), F.lit(-1), seed=seed) < F.col("open.p")
    parts.append(done.select("open.id", "source", "open.size", (F.col("open.base") + last.cast("int")).alias("copies")))
    out = reduce(DataFrame.unionByName, parts).join(side, F.col("source").eqNullSafe(F.col("s"))).drop("s", "rows")
    return out.select(F.col("id").alias(id_col), "size", "source", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
