"""License scans: canonical digests of whole texts, looked up among known licences.

A text is normalised (letter case, copyright notices, punctuation, equivalent spellings,
white space), its SHA-256 is taken, and the digest is joined with those of the known
licences, which pass through the same expressions.  DataFrame functions only; the known
licences are a list of texts, so their side is broadcast and documents are not shuffled.

The list is a parameter.  That of the query holds the short licences and notices of
``KNOWN`` and the whole texts in the folder ``known_licenses``, named by their identifiers.
"""

from __future__ import annotations

from functools import lru_cache, reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .url_filter import ASCII_LOWER, ASCII_UPPER

#: Spellings that count as equal, a word and what it is read as.
SPELLINGS = [
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"),
    ("authorisation", "authorization"), ("authorised", "authorized"), ("cancelled", "canceled"), ("catalogue", "catalog"),
    ("categorise", "categorize"), ("centre", "center"), ("emphasise", "emphasize"), ("favour", "favor"), ("favourite", "favorite"),
    ("fulfil", "fulfill"), ("fulfilment", "fulfillment"), ("initialise", "initialize"), ("judgement", "judgment"),
    ("labelling", "labeling"), ("labour", "labor"), ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"),
    ("maximise", "maximize"), ("modelled", "modeled"), ("offence", "offense"), ("optimise", "optimize"), ("organisation", "organization"),
    ("organise", "organize"), ("practise", "practice"), ("programme", "program"), ("realise", "realize"), ("recognise", "recognize"),
    ("signalling", "signaling"), ("sublicence", "sublicense"), ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "wilfull"),
]

#: Typographic quotes, dashes, dots, bullets and blanks, which count as blanks like ASCII's.
TYPOGRAPHIC = " «·»  ‐‑‒–—―‘’‚‛“”„‟•… 　﻿"
#: A notice in a line in lower case: a mark, years or their place, and a holder of up to 120
#: characters, up to the line's end or to words that a licence goes on with, which stay.
NOTICE = (
    r"(^|[^a-z0-9])(?:(?:copyright|©|\(c\))[ \t,:]*)+(?:[\[<{(]?(?:[0-9]{4}|year|yyyy)[\]>})]?[ \t]*(?:-|,|and|to)?[ \t]*)+[^\n]{0,120}?"
    r"(?:all rights reserved[. \t]*|(permission (?:is|to) |redistribution and |licen[sc]ed under |released under |everyone is permitted|this (?:software|program|library|file|work|package) )|$)"
)
#: A line that states a holder without a year, or that all rights are reserved, and nothing else.
LINES = r"^[ \t#*/;-]*(?:(?:copyright|©)[ \t:]*(?:\(c\)|©)?[ \t]+(?:by |the |<|\[)[^\n]{0,80}|all rights reserved[. \t]*)$"
MARKS = ("copyright", "©", "(c)", "all rights reserved")

_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
_BSD_TAIL = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_ISC_TAIL = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."

#: Known licences and notices, whole texts.
KNOWN = [
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n" + _AS_IS),
    ("MIT", "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n" + _AS_IS),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_THIRD + _BSD_TAIL),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n" + _ISC_TAIL),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n" + _ISC_TAIL),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("MIT", "Released under the MIT License."),
]


@lru_cache(maxsize=1)
def known_texts() -> list[tuple[str, str]]:
    """The known licences: ``KNOWN`` and the whole texts that are kept as files."""
    files = sorted((Path(__file__).parent / "known_licenses").glob("*.txt"))
    return [*KNOWN, *((f.stem, f.read_text(encoding="utf-8")) for f in files)]


def canonical(text: Column) -> Column:
    """The normal form of a text; null counts as empty.  Letters outside ASCII stay as they are.

    A copyright notice is taken out of its line; what the line goes on with stays.
    """
    lower = F.translate(F.coalesce(text, F.lit("")), ASCII_UPPER + TYPOGRAPHIC, ASCII_LOWER + " " * len(TYPOGRAPHIC))

    def marked(x: Column) -> Column:
        return reduce(Column.__or__, [F.contains(x, F.lit(mark)) for mark in MARKS])

    def plain(line: Column) -> Column:
        without = F.regexp_replace(line, NOTICE, "$1 $2")
        return F.when(marked(line), F.regexp_replace(without, LINES, "")).otherwise(line)

    kept = F.when(marked(lower), F.array_join(F.transform(F.split(lower, "\n"), plain), " ")).otherwise(lower)
    words = F.regexp_replace(kept, r"[\x00-/:-@\[-`{-\x7f]+", "  ")
    out = F.concat(F.lit(" "), words, F.lit(" "))
    for word, read in SPELLINGS:
        out = F.replace(out, F.lit(f" {word} "), F.lit(f" {read} "))
    return F.trim(F.regexp_replace(out, " +", " "))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_licenses(spark: SparkSession, known: list[tuple[str, str]]) -> DataFrame:
    """``license_digest, license`` of a list of (name, text), one row per digest."""
    rows = F.array(*[F.struct(F.lit(name).alias("license"), F.lit(text).alias("text")) for name, text in known])
    listed = spark.range(1).select(F.inline(rows)).select(digest(F.col("text")).alias("license_digest"), "license")
    return listed.groupBy("license_digest").agg(F.min("license").alias("license"))


def scan(docs: DataFrame, known: list[tuple[str, str]] | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, digest, license`` of every row; ``license`` is null where the whole text is no known licence.

    ``known`` are (name, text) pairs, those of ``known_texts`` if not given; they are
    broadcast and meant to be some hundreds of texts.  Null and empty texts, and texts of
    copyright lines alone, have the digest of the empty text, which is no licence.  Very long
    texts are digested whole.  Repeated rows give repeated results, a null id stays null;
    further columns are not read; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("id"), digest(F.col(text_col)).alias("digest"))
    found = rows.join(F.broadcast(known_licenses(docs.sparkSession, known_texts() if known is None else known)), F.col("digest") == F.col("license_digest"), "left")
    return found.select(F.col("id").alias(id_col), "digest", "license")


def scan_sql(known: list[tuple[str, str]] | None = None) -> str:
    """The same in DuckDB's SQL over ``documents``."""

    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    def marked(x: str) -> str:
        return "(" + " or ".join(f"contains({x}, {quoted(mark)})" for mark in MARKS) + ")"

    line = f"case when {marked('line')} then regexp_replace(regexp_replace(line, {quoted(NOTICE)}, '\\1 \\2', 'g'), {quoted(LINES)}, '', 'g') else line end"
    lowered = f"translate(coalesce({{}}, ''), '{ASCII_UPPER}{TYPOGRAPHIC}', '{ASCII_LOWER}{' ' * len(TYPOGRAPHIC)}')"
    out = f"' ' || regexp_replace(case when {marked('low')} then array_to_string(list_transform(string_split(low, chr(10)), lambda line: {line}), ' ') else low end" + r", '[\x00-/:-@\[-`{-\x7f]+', '  ', 'g') || ' '"
    for word, read in SPELLINGS:
        out = f"replace({out}, ' {word} ', ' {read} ')"
    normal = f"sha256(trim(regexp_replace({out}, ' +', ' ', 'g'), ' '))"

    values = ", ".join(f"({quoted(name)}, {quoted(text)})" for name, text in (known_texts() if known is None else known))
    return (
        f"with listed as (select license, {lowered.format('body')} as low from (values {values}) k(license, body)), "
        f"known as (select {normal} as license_digest, min(license) as license from listed group by 1), "
        f"lowered as (select doc_id, {lowered.format('text')} as low from documents), scanned as (select doc_id, {normal} as digest from lowered) "
        "select doc_id, digest, license from scanned left join known on digest = license_digest"
    )
