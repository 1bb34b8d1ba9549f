"""URL filter: host and path rules, and a character language-model ratio for the rest.

URLs that a rule settles are the labelled examples.  A fifth of them, told by a hash of the
URL, is held for the threshold; from all others two variable-order Markov models are
counted, one for accepted and one for rejected URLs.  Each smooths a context with the next
shorter one (Dirichlet prior of ``PRIOR`` counts, down to the uniform distribution).  A
URL's score is the log-likelihood difference per character, where a sequence never seen is
scored in its next shorter context; its threshold is the one with the best balanced
accuracy on all held URLs.

That score is a sum over the characters of what the longest counted sequence that ends there
gives, so sequences can be dealt by their ends over several tables of about ``HELD``, which
are applied one after another.  A table is one value with a slot for each sequence on
average; a slot lists all sequences that share it.

DataFrame functions only; URLs are scored in one narrow pass for each table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Stash

#: (host, path, verdict): the host and all its subdomains, paths that start with the path.
Rule = tuple[str, str, str]
#: Longest sequence: a character with up to four before it.
ORDER = 5
#: Prior counts of a context; classes of scores for the threshold.
PRIOR, STEPS = 4.0, 400
#: Sequences that one table holds at most, about; more are dealt over several.
HELD = 500_000
#: Characters at a sequence's end that tell its table.
END = 3
ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path; both empty if the URL is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    empty = F.lit("")
    return F.coalesce(F.translate(host, ASCII_UPPER, ASCII_LOWER), empty), F.coalesce(path, empty)


def ruled(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null if none does."""
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def folded(url: Column) -> Column:
    """What the models see: A-Z in lower case, every digit as 0, and padding before the start."""
    return F.concat(F.lit("^" * (ORDER - 1)), F.translate(F.coalesce(url, F.lit("")), ASCII_UPPER + "123456789", ASCII_LOWER + "0" * 9))


def slot(gram: Column, slots: Column) -> Column:
    return F.pmod(F.xxhash64(gram), slots.cast("long")).cast("int")


def models(stash: Stash, examples: DataFrame) -> DataFrame:
    """One row per counted sequence: ``slot`` (its hash), ``gram, ratio, back, gain, inner``, from ``text, accepted``.

    ``ratio`` is log p(last character | those before it) in the accepted model minus the
    same in the rejected one; ``back`` is what a step to the next shorter context adds;
    ``gain`` is ``ratio`` less all such steps to its last character, ``inner`` that and all
    steps to the next one: a text has the ``inner`` of each character, and ``gain`` of its last.
    """
    every = F.explode(F.sequence(F.lit(ORDER), F.length("text")))
    ends = examples.select("accepted", "text", every.alias("end"))
    grams = ends.select("accepted", F.explode(F.array(*[F.expr(f"substring(text, end - {n - 1}, {n})") for n in range(1, ORDER + 1)])).alias("gram"))
    sums = [F.sum(F.when(F.col("accepted") == flag, 1.0).otherwise(0.0)).alias(name) for flag, name in ((True, "a"), (False, "r"))]
    counts = stash.save(grams.groupBy("gram").agg(*sums).withColumn("n", F.length("gram")), "counts")
    tables, shorter = [], None
    for n in range(1, ORDER + 1):
        own = counts.where(F.col("n") == n).withColumn("before", F.expr("substring(gram, 1, n - 1)"))
        totals = own.groupBy("before").agg(F.sum("a").alias("ta"), F.sum("r").alias("tr"))
        own = own.join(totals, "before")
        if shorter is None:
            own = own.withColumns({"qa": F.lit(1 / 256), "qr": F.lit(1 / 256)})
        else:
            own = own.withColumn("tail", F.expr("substring(gram, 2, n)")).join(shorter, "tail").drop("tail")
        own = own.withColumns({k: (F.col(c) + PRIOR * F.col(q)) / (F.col(t) + PRIOR) for k, c, q, t in (("pa", "a", "qa", "ta"), ("pr", "r", "qr", "tr"))})
        shorter = own.select(F.col("gram").alias("tail"), F.col("pa").alias("qa"), F.col("pr").alias("qr"))
        tables.append((own.select("gram", F.log(F.col("pa") / F.col("pr")).alias("ratio")), totals))
    rows = None
    for n, (own, _) in enumerate(tables):
        if n + 1 < ORDER:
            back = tables[n + 1][1].select(F.col("before").alias("gram"), F.log((F.col("tr") + PRIOR) / (F.col("ta") + PRIOR)).alias("back"))
            own = own.join(back, "gram", "left")
        else:
            own = own.withColumn("back", F.lit(0.0))
        rows = own if rows is None else rows.unionByName(own)
    rows = stash.save(rows.select(F.xxhash64("gram").alias("slot"), "gram", "ratio", F.coalesce("back", F.lit(0.0)).alias("back")), "ratios")
    # All steps from a context: its own and those of its ends, which are counted too; padding may not be.
    padding = rows.sparkSession.range(1, ORDER).select(F.expr("repeat('^', cast(id as int))").alias("gram"), F.lit(0.0).alias("back"))
    contexts = rows.where(F.length("gram") < ORDER).select("gram", "back").unionByName(padding).groupBy("gram").agg(F.sum("back").alias("back"))
    own = [contexts.where(F.length("gram") == n).select(F.col("gram").alias("context"), F.col("back").alias("steps")) for n in range(1, ORDER)]
    steps = [own[0]]
    for longer in own[1:]:
        shorter = steps[-1].select(F.col("context").alias("end"), F.col("steps").alias("more"))
        steps.append(longer.withColumn("end", F.expr("substring(context, 2)")).join(shorter, "end").select("context", (F.col("steps") + F.col("more")).alias("steps")))
    every = steps[0]
    for some in steps[1:]:
        every = every.unionByName(some)
    every = stash.save(every, "steps")
    before = every.select(F.col("context").alias("before"), F.col("steps").alias("taken"))
    rows = rows.withColumns({"before": F.expr("substring(gram, 1, length(gram) - 1)"), "context": F.expr(f"right(gram, {ORDER - 1})")})
    rows = rows.join(before, "before", "left").join(every, "context").withColumn("gain", F.col("ratio") - F.coalesce("taken", F.lit(0.0)))
    return rows.select("slot", "gram", "ratio", "back", "gain", (F.col("gain") + F.col("steps")).alias("inner"))


def dealt(gram: Column, parts: int) -> Column:
    """The part of the table that has the sequences with this end; those shorter than it are in all."""
    return F.pmod(F.xxhash64(F.right(gram, F.lit(END))), F.lit(parts))


def as_value(rows: DataFrame, part: int = 0, parts: int = 1) -> DataFrame:
    """A part of the table as one value: an array with as many slots as sequences, each the array of its entries."""
    if parts > 1:
        rows = rows.where((F.length("gram") < END) | (dealt(F.col("gram"), parts) == part))
    spark, size = rows.sparkSession, max(1, rows.count())
    entries = rows.select(slot(F.col("gram"), F.lit(size)).alias("at"), F.struct("gram", "gain", "inner").alias("entry"))
    held = entries.groupBy("at").agg(F.sort_array(F.collect_list("entry")).alias("entries"))
    slots = spark.range(size).select(F.col("id").cast("int").alias("at")).join(held, "at", "left")
    ordered = slots.agg(F.sort_array(F.collect_list(F.struct("at", "entries"))).alias("table"))
    return ordered.select(F.col("table.entries").alias("table"))


def score(text: Column, table: Column, part: int = 0, parts: int = 1) -> Column:
    """Log-likelihood difference per character of a folded URL; 0 for one without characters.

    Of several parts each gives the share of the characters that are dealt to it.  The table
    is bound to a lambda's variable, so that the plan holds its value once.
    """

    def summed(table: Column) -> Column:
        def longest(end: Column, most: int, value) -> Column:
            def entry(size: int) -> Column:
                gram = F.substring(text, end - (size - 1), F.lit(size))
                return F.get(F.filter(F.get(table, slot(gram, F.size(table))), lambda entry: entry["gram"] == gram), F.lit(0))

            return F.coalesce(*(value(entry(n)) for n in range(most, 0, -1)), F.lit(0.0))

        def step(total: Column, end: Column) -> Column:
            # Padding gives the steps to the first character only.
            first = F.when(end < ORDER, longest(end, ORDER - 1, lambda x: x["inner"] - x["gain"]))
            value = first.when(end == F.length(text), longest(end, ORDER, lambda x: x["gain"])).otherwise(longest(end, ORDER, lambda x: x["inner"]))
            if parts > 1:
                value = F.when(dealt(F.substring(text, end - (END - 1), F.lit(END)), parts) == part, value).otherwise(0.0)
            return total + value

        return F.aggregate(F.sequence(F.lit(ORDER - 1), F.length(text)), F.lit(0.0), step)

    size = F.length(text) - (ORDER - 1)
    return F.when(size > 0, F.transform(F.array(table), summed)[0] / size).otherwise(0.0)


def scored(stash: Stash, rows: DataFrame, text: Column, tables: list[DataFrame], name: str) -> DataFrame:
    """``rows`` with ``score``; between two tables they are written, so that no task holds more than one."""
    for part, table in enumerate(tables):
        share = score(text, F.col("slot_table"), part, len(tables))
        rows = rows.withColumn("slot_table", table.scalar()).withColumn("score", F.col("score") + share if part else share).drop("slot_table")
        if part < len(tables) - 1:
            rows = stash.save(rows, f"{name}{part}")
            stash.drop(*[f"{name}{part - 1}"] * (part > 0))
    return rows


def threshold(scored: DataFrame) -> DataFrame:
    """The lower bound of accepted scores with the best balanced accuracy, from ``score, accepted``."""
    steps = scored.groupBy(F.floor(F.col("score") * STEPS).alias("step")).agg(F.sum(F.col("accepted").cast("double")).alias("a"), F.sum((~F.col("accepted")).cast("double")).alias("r"))
    up, all_ = Window.orderBy("step").rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    kept = F.sum("a").over(up) / F.greatest(F.sum("a").over(all_), F.lit(1.0))
    let_in = F.sum("r").over(up) / F.greatest(F.sum("r").over(all_), F.lit(1.0))
    steps = steps.withColumn("gain", kept - let_in)
    return steps.agg((F.max_by("step", F.struct("gain", -F.col("step"))) / STEPS).alias("threshold"))


def filter_urls(pages: DataFrame, rules: list[Rule], *, url_col: str = "url") -> DataFrame:
    """``pages`` with ``host, path, rule, verdict, score``; columns of these names are replaced.

    A rule's verdict counts; the others are allowed if their score reaches the threshold.
    Without examples of both kinds the ratio says little and the threshold may be 0.
    Null and empty URLs have empty host and path, no rule and score 0.  Repeated rows are
    judged alike; an empty table gives an empty result.
    """
    spark = pages.sparkSession
    stash = Stash(spark, "urls")
    url = F.col(url_col)
    host, path = host_and_path(url)
    rule, verdict = ruled(host, path, rules)
    labelled = pages.select(url.alias("url"), (verdict == "allow").alias("accepted")).where(F.col("accepted").isNotNull())
    labelled = labelled.select("accepted", folded(F.col("url")).alias("text"), (F.pmod(F.xxhash64("url"), F.lit(5)) == 0).alias("held"))
    model = stash.save(models(stash, labelled.where(~F.col("held")).select("accepted", "text")), "slots")
    parts = max(1, -(-model.count() // HELD))
    tables = [stash.save(as_value(model, part, parts), f"table{part}") for part in range(parts)]
    held = scored(stash, labelled.where("held").select("accepted", "text"), F.col("text"), tables, "held")
    limit = stash.save(threshold(held), "threshold")
    out = scored(stash, pages.withColumns({"host": host, "path": path, "rule": rule}), folded(url), tables, "pages")
    passed = F.when(F.col("score") >= F.coalesce(limit.scalar(), F.lit(0.0)), "allow").otherwise("block")
    return out.withColumn("verdict", F.coalesce(verdict, passed))
