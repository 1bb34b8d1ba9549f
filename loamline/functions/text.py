"""Scalar text functions and fingerprints as Column expressions.

Patterns are written for Java's dialect so that they match what RE2 matches: white space is
an explicit class, word borders are ASCII, and case is folded in Unicode.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The patterns of what is replaced by marks, and the words that tell SQL.
_S = r"[\t\n\f\r ]*"
_GUID = r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
_STAMP = r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}"
_WHOLE = r"(?=\d)(?<![0-9A-Za-z_])\d{%s,}(?![0-9A-Za-z_])"
#: Words, one of which marks a line as holding SQL.
SQL_WORDS = ["select", "insert", "update", "delete", "exec", "from", "where", "join", "union", "dbmssql", "dbpostgrs", "sql=", "query="]


def replaced(text: Column, *rules: tuple[str, str]) -> Column:
    return reduce(lambda c, rule: F.regexp_replace(c, F.lit(rule[0]), F.lit(rule[1])), rules, text)


#: Unicode's white space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def trimmed(text: Column) -> Column:
    """Without white space (Unicode's) at both ends."""
    return F.btrim(text, F.lit(WHITE))


def _named(ru: str, en: str, mark: str) -> list[tuple[str, str]]:
    """``ru: name`` and ``en: name`` up to a comma become a mark; the Russian word anywhere in the match decides."""
    russian = rf"(?iu)(?:{ru}{_S}:{_S}[^,]+|{en}{_S}:(?=[^,]*{ru}){_S}[^,]+)"
    return [(russian, f"{ru}: <{mark}>"), (rf"(?iu){en}{_S}:{_S}(?!<{mark}>)[^,]+", f"{en}: <{mark}>")]


#: Rules by what a text must hold, in lower case, for them to change anything.
_NAMES = [(("компьютер", "computer"), _named("компьютер", "computer", "COMPUTER")), (("пользователь", "user"), _named("пользователь", "user", "USER"))]


def unnamed(text: Column) -> Column:
    """Names of computers and users replaced by marks; texts without these words are left at once."""

    def changed(low: Column) -> Column:
        out = text
        for words, rules in _NAMES:
            held = reduce(Column.__or__, [F.contains(low, F.lit(w)) for w in words])
            out = F.when(held, replaced(out, *rules)).otherwise(out)
        return out

    return bound(F.translate(F.lower(text), "\u017f", "s"), changed)


def comment_fingerprint(comment: Column) -> Column:
    """A comment with its variable parts replaced by marks, so that like messages group together.

    In order: GUIDs, times, computers, users, whole numbers, quoted strings; then trimmed.
    """
    plain = replaced(comment, (_GUID, "<GUID>"), (_STAMP, "<TIMESTAMP>"))
    return bound(plain, lambda text: trimmed(replaced(unnamed(text), (_WHOLE % 1, "<NUMBER>"), ('"[^"]*"', "<STRING>"))))


def holds_sql(line: Column) -> Column:
    return F.lower(line).rlike("|".join(SQL_WORDS))


def dbms_of(line: Column) -> Column:
    low = F.lower(line)
    return F.when(low.rlike("dbmssql|sp_executesql"), "DBMSSQL").when(low.rlike(r"dbpostgrs|execute \$"), "DBPOSTGRS").otherwise("")


def mssql_statement(line: Column) -> Column:
    """The statement of a parameterised call: wrapper and parameter list cut off, temporary tables unnumbered."""
    calls = [(f"(?s)^(.*?){call} sp_executesql N'", "$1") for call in ("exec", "EXEC", "Exec")]
    # A parameter list at the very start is no statement's end.
    ends = [(f"(?s)^(?!{end})(.+?){end}.*$", "$1") for end in ("',N'", "',n'", "', N'")]
    return replaced(line, *calls, *ends, (r"#tt\d+", "#tt"))


def postgres_statement(line: Column) -> Column:
    return F.regexp_replace(line, r"\$\d+", r"\$<NUMBER>")


def bound(value: Column, use) -> Column:
    """``use(value)``, with the value computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


def once(rows: DataFrame) -> DataFrame:
    """The same rows; what computes their columns is not repeated in the expressions that use them."""
    return rows.select(F.inline(F.array(F.struct(*rows.columns))))


def line_fingerprint(line: Column) -> Column:
    """A trace line with its variable parts replaced by marks; quoted strings and short numbers stay."""

    def statement(plain: Column) -> Column:
        kind = dbms_of(plain)
        unwrap = ((kind == "DBMSSQL") | ((kind == "") & plain.rlike(r"#tt\d"))) & holds_sql(plain)
        return F.when(unwrap, mssql_statement(plain)).otherwise(plain)

    plain = F.when(F.contains(line, F.lit("$")), postgres_statement(line)).otherwise(line)
    marked = replaced(bound(plain, statement), (_GUID, "<GUID>"), (_STAMP, "<TIMESTAMP>"))
    return bound(marked, lambda text: trimmed(replaced(unnamed(text), (_WHOLE % 6, "<NUMBER>"))))


def utc_text(ts: Column) -> Column:
    """A time as ``2024-01-31T10:20:30.5Z``, without zeros at the end of the fraction."""
    return F.concat(F.regexp_replace(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.?0+$", ""), F.lit("Z"))


def readable_size(n: Column) -> Column:
    """Bytes with a binary unit and two digits, halves rounded up."""
    digits = lambda x: F.floor(x * 100 + 0.5) / 100.0
    out = F.format_string("%.2f B", digits(n.cast("double")))
    for power, unit in enumerate(("KiB", "MiB", "GiB", "TiB", "PiB"), 1):
        out = F.when(n >= 1024**power, F.format_string(f"%.2f {unit}", digits(n / float(1024**power)))).otherwise(out)
    return out


def shortened(text: Column, size: int) -> Column:
    """At most ``size`` bytes of UTF-8, and dots if something was cut."""
    raw = text.cast("binary")
    return F.when(F.octet_length(text) > size, F.concat(F.substring(raw, 1, size).cast("string"), F.lit("..."))).otherwise(text)


def unsigned(text: Column, kind: str) -> Column:
    """A strict base-10 unsigned number of the given width, else null."""
    from ..schemas import UNSIGNED

    most, spark_type = UNSIGNED[kind]
    value = F.when(text.rlike("^[0-9]+$"), text).try_cast("decimal(38,0)")
    return F.when(value <= most, value).try_cast(spark_type)
