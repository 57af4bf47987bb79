"""Licence texts found by the digest of their canonical form.

Canonical form: lower case; lines that are a copyright notice dropped; everything
that is not a letter or digit read as a space; words with an equivalent spelling written
one way; single spaces. Known licences and statements have a digest of their whole text.
A document is looked up as a whole, and so is each of its lines, by an equi-join on the
SHA-256 digest. Lines whose length no known text has are not looked up, which loses
nothing.

Null texts count as empty; empty forms match nothing. Everything is built-in expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.materialize import materialize

from .licence_texts import APACHE, BSD, BSD_REGENTS, BY_SA, CC0, GPL

_YEAR = r"(19|20)[0-9][0-9]|<year>|\[year\]|\[yyyy\]"
#: Lines that open so, after any punctuation, are notices: "copyright" with a sign, a year or the
#: reservation of rights, the sign with a year, or that reservation. Other lines may be wrapped text.
NOTICE = (
    r"(?md)^[^\p{L}\p{N}\n]*(copyright[^\n]*(\(c\)|©|all rights reserved|" + _YEAR + r")|(\(c\)|©)[^\n]*(" + _YEAR
    + r")|all rights reserved)[^\n]*$"
)

# Words that licence texts spell in several ways, and the spelling kept.
SPELLINGS = (
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("licencing", "licensing"),
    ("sub  license", "sublicense"),
    ("non  commercial", "noncommercial"),
    ("trade  mark", "trademark"),
    ("acknowledgement", "acknowledgment"),
    ("judgement", "judgment"),
    ("organisation", "organization"),
    ("favour", "favor"),
    ("behaviour", "behavior"),
    ("per  cent", "percent"),
    ("https", "http"),
)

# Short statements and whole texts of widely used licences.
KNOWN = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    (
        "MIT",
        "MIT License\n\nCopyright (c) <year> <copyright holders>\n\n"
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
        ' documentation files (the "Software"), to deal in the Software without restriction, including without'
        " limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the"
        " Software, and to permit persons to whom the Software is furnished to do so, subject to the following"
        " conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or"
        ' substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND,'
        " EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR"
        " PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM,"
        " DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN"
        " CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    (
        "ISC",
        "ISC License\n\nCopyright (c) <year> <owner>\n\n"
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby"
        " granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n"
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING'
        " ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL,"
        " DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR"
        " PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION"
        " WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
)


def _usual(known: tuple[tuple[str, str], ...]) -> tuple[tuple[str, str], ...]:
    """Whole texts as they are found: with and without heading, numbers or closing instructions."""
    bare = BSD.replace("\n1. ", "\n").replace("\n2. ", "\n").replace("\n3. ", "\n")
    bodies = [(name, text.split("\n\n", 2)[2]) for name, text in known if text.startswith((f"{name} License\n\n",))]
    headed = [("BSD-3-Clause", f"{head}\n\n{body}") for head in ("BSD 3-Clause License", "The BSD 3-Clause License") for body in (BSD, bare)]
    return (
        *bodies,
        ("MIT", "The " + known[2][1]),
        *headed,
        ("BSD-3-Clause", BSD),
        ("BSD-3-Clause", bare),
        ("BSD-3-Clause", BSD_REGENTS),
        ("Apache-2.0", APACHE),
        ("Apache-2.0", APACHE.partition("APPENDIX: How to apply")[0]),
        ("GPL-3.0", GPL),
        ("GPL-3.0", GPL.partition("How to Apply These Terms")[0]),
        ("CC0-1.0", CC0),
        ("CC0-1.0", CC0.partition("Creative Commons Legal Code")[2]),
        ("CC-BY-SA-4.0", BY_SA),
        ("CC-BY-SA-4.0", "Creative Commons " + BY_SA),
    )


KNOWN += _usual(KNOWN)


def canonical_lines(text: Column) -> Column:
    """Canonical form of every line that has one, in order."""
    form = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), NOTICE, "")
    # two spaces between words give each its own on either side
    form = F.regexp_replace(form, r"[^\p{L}\p{N}\n]+", "  ")
    form = F.concat(F.lit("  "), F.replace(form, F.lit("\n"), F.lit("  \n  ")), F.lit("  "))
    for old, new in SPELLINGS:
        form = F.replace(form, F.lit(f" {old} "), F.lit(f" {new} "))
    form = F.regexp_replace(form, " +", " ")
    return F.filter(F.transform(F.split(form, "\n", -1), lambda line: F.trim(line)), lambda line: line != "")


def digest_of(form: Column) -> Column:
    return F.sha2(F.encode(form, "UTF-8"), 256)


def known_licences(spark: SparkSession, known: tuple[tuple[str, str], ...] = KNOWN) -> DataFrame:
    """Licence, digest and length of each different known text; of two with one digest the first name."""
    rows = F.explode(F.array(*(F.struct(F.lit(n).alias("licence"), F.lit(t).alias("text")) for n, t in known)))
    texts = spark.range(1).select(rows.alias("k")).select("k.*")
    form = F.array_join(canonical_lines(F.col("text")), " ")
    forms = texts.select("licence", form.alias("form")).filter("form != ''")
    return forms.groupBy(digest_of(F.col("form")).alias("digest"), F.length("form").alias("length")).agg(
        F.min("licence").alias("licence")
    )


def scan(docs: DataFrame, licences: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row of ``docs``: key, text_digest, licence of the whole text (or null), line_licences.

    ``line_licences`` is the sorted list of different licences that lines of the text state.
    The licences' different lengths are held as a literal list.
    """
    lengths = [r.length for r in licences.select("length").distinct().collect()]
    lines = F.col("lines")
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(f"`{key}`").alias("id"), canonical_lines(F.col(f"`{text}`")).alias("lines"))
    candidates = F.filter(lines, lambda line: F.length(line).isin(lengths) if lengths else F.lit(False))
    rows = materialize(
        rows.select(
            "row_id",
            "id",
            digest_of(F.array_join(lines, " ")).alias("text_digest"),
            F.array_distinct(F.transform(candidates, digest_of)).alias("line_digests"),
        )
    )
    book = licences.select("digest", "licence")
    stated = (
        rows.select("row_id", F.explode("line_digests").alias("digest"))
        .join(book, "digest")
        .groupBy("row_id")
        .agg(F.sort_array(F.collect_set("licence")).alias("line_licences"))  # at most every known one
    )
    whole = book.select(F.col("digest").alias("text_digest"), "licence")
    return (
        rows.join(whole, "text_digest", "left")
        .join(stated, "row_id", "left")
        .select(F.col("id").alias(key), "text_digest", "licence", F.coalesce("line_licences", F.array().cast("array<string>")).alias("line_licences"))
    )
