"""Licence scan by canonical digest: a text and a known licence are the same when their canonical
forms have one digest. Canonical form: lower case, lines of a copyright notice dropped, punctuation and
white space folded to single spaces, equivalent spellings made one.

Known texts are canonicalised by the same expressions and their digests broadcast after a size check, so
the hash join moves no document. ``scan`` looks up whole texts; ``scan_lines`` also looks up every line of
every text on its own, as one-line notices stand inside longer texts.

Defined results: a null text counts as empty; an empty canonical form matches nothing; repeated rows are
looked up one by one; a digest shared by several known names gives them all, in order; other columns pass
through. All work is DataFrame expressions.
"""

from __future__ import annotations

import re
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plantlog.functions.sizing import broadcast_if_bounded
from plantlog.llm.common import free_name
from plantlog.llm.near_join import row_key

#: Spellings that licence matching treats as equal (after punctuation became spaces): fixed values.
EQUAL_SPELLINGS = (
    ("licence", "license"), ("licenced", "licensed"), ("licences", "licenses"), ("licencing", "licensing"),
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"),
    ("artefact", "artifact"), ("authorisation", "authorization"), ("authorised", "authorized"),
    ("calibre", "caliber"), ("cancelled", "canceled"), ("capitalisations", "capitalizations"),
    ("catalogue", "catalog"), ("categorise", "categorize"), ("centre", "center"),
    ("emphasised", "emphasized"), ("favour", "favor"), ("favourite", "favorite"), ("fulfil", "fulfill"),
    ("fulfilment", "fulfillment"), ("initialise", "initialize"), ("judgement", "judgment"),
    ("labelling", "labeling"), ("labour", "labor"), ("maximise", "maximize"), ("modelled", "modeled"),
    ("modelling", "modeling"), ("offence", "offense"), ("optimise", "optimize"),
    ("organisation", "organization"), ("organise", "organize"), ("practise", "practice"),
    ("programme", "program"), ("realise", "realize"), ("recognise", "recognize"),
    ("signalling", "signaling"), ("utilisation", "utilization"), ("whilst", "while"),
    ("wilful", "willful"), ("non commercial", "noncommercial"), ("per cent", "percent"),
    ("sub license", "sublicense"), ("sub licensed", "sublicensed"), ("copyright owner", "copyright holder"),
    ("copyright owners", "copyright holders"), ("https", "http"), ("v2 0", "version 2 0"),
    ("v3 0", "version 3 0"))

#: Known texts: fixed values, the licences' own words.
KNOWN = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including
without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial
portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED
TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL
THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee
is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING
ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL,
DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR
PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION
WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee
is hereby granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING
ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL,
DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR
PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION
WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "MIT notice": "Released under the MIT License.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0 notice": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0 notice": "Released under CC0 1.0.",
    "BSD-3-Clause notice": "Released under the BSD 3-Clause License.",
    "MPL-2.0 notice": "This work is subject to the terms of the Mozilla Public License, v. 2.0.",
}

#: Whole licences kept as files of ``licence_texts``, by the names their projects use.
FILES = {"Apache-2.0": "Apache-2.0", "Artistic": "Artistic-1.0", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0",
         "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0",
         "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0"}
#: Lines before a text that carries no title of its own.
TITLES = {"MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"), "ISC": ("ISC License", "The ISC License"),
          "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD"),
          "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License")}


def known_texts() -> list[tuple[str, str]]:
    """(name, text) of the known texts, once for each title, each with and without "All rights reserved."."""
    folder = resources.files("plantlog.llm") / "licence_texts"
    texts = KNOWN | {name: (folder / f"{f}.txt").read_text("utf-8") for f, name in FILES.items()}
    out = list(texts.items())
    for name, titles in TITLES.items():
        body = re.sub(r"(?im)^(copyright .*|all rights reserved\.?)$", "", texts[name])
        out += [(name, f"{title}\n{rights}\n{body}") for title in ("", *titles)
                for rights in ("", "All rights reserved.")]
    return out


COPYRIGHT_LINE = (r"(^|\n)[^\p{L}\p{N}\n]*(?:copyright[ \t]*(?:\(c\)|©|[0-9<\[{(])|\(c\)[ \t]*[0-9<\[{]|©)"
                  r"[^\n]*")
PUNCTUATION = r"[^\p{L}\p{N}]+"


def canonical(text: Column) -> Column:
    t = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT_LINE, "\n")
    t = F.concat(F.lit(" "), F.trim(F.regexp_replace(t, PUNCTUATION, " ")), F.lit(" "))
    equal = t
    for spelling, same in EQUAL_SPELLINGS:
        # Twice: neighbours share the space between them.
        for _ in range(2):
            equal = F.replace(equal, F.lit(f" {spelling} "), F.lit(f" {same} "))
    has = "|".join(s for s, _ in EQUAL_SPELLINGS)
    return F.trim(F.when(t.rlike(f" (?:{has}) "), equal).otherwise(t))


def digest(text: Column) -> Column:
    c = canonical(text)
    return F.when(c != "", F.sha2(c, 256))


def known(spark: SparkSession, texts: dict[str, str] | None = None) -> DataFrame:
    """(``digest``, ``names``, ``word``) of the known texts; ``word`` is a word that every spelling of the
    text must contain: the longest one that no equal spelling touches, null if there is none."""
    rows = spark.createDataFrame(list(texts.items()) if texts else known_texts(), "name string, text string")
    touched = sorted({w for pair in EQUAL_SPELLINGS for side in pair for w in side.split()})
    plain = F.filter(F.split(canonical(F.col("text")), " "), lambda w: ~w.isin(*touched))
    longest = F.array_max(F.transform(plain, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    return rows.select("name", digest(F.col("text")).alias("digest"), longest.alias("word")).where(
        "digest IS NOT NULL").groupBy("digest").agg(
        F.array_join(F.sort_array(F.collect_set("name")), ", ").alias("names"), F.min("word").alias("word"))


def _possible(line: Column, table: DataFrame, most: int = 200) -> Column:
    """Whether a line can be one of the known texts: it holds the word of one of them. True where a text
    has no such word, or the table is too large for the words to be tested one by one."""
    words = [r["word"] for r in table.select("word").distinct().limit(most + 1).collect()] if (
        "word" in table.columns) else [None]
    if None in words or len(words) > most:
        return F.lit(True)
    low, test = F.lower(line), F.lit(False)
    for w in words:
        test = test | F.contains(low, F.lit(w))
    return test


def scan(docs: DataFrame, text: str = "text", table: DataFrame | None = None) -> DataFrame:
    """``docs`` with ``text_digest`` and ``licence`` (null if unknown); equal names are replaced."""
    table = known(docs.sparkSession) if table is None else table
    key = free_name(docs, "_digest")
    found = docs.withColumn(key, digest(F.col(text))).join(broadcast_if_bounded(
        table.select(F.col("digest").alias(key), F.col("names").alias(name := free_name(docs, "_names")))), key, "left")
    return found.withColumn("text_digest", F.col(key)).withColumn("licence", F.col(name)).drop(key, name)


def scan_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
               table: DataFrame | None = None) -> DataFrame:
    """``doc_id``, ``text_digest``, ``licence`` and ``notices``: the known texts among the lines, each
    once, in order, comma-joined ('' if none)."""
    table = known(docs.sparkSession) if table is None else table
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    whole = scan(rows, table=table).select(
        "doc_id", row_key(F.col("doc_id"), F.col("text")).alias("key"), "text_digest", "licence")
    lines = rows.select(row_key(F.col("doc_id"), F.col("text")).alias("key"),
                        F.explode(F.split("text", "\n")).alias("line"))
    found = lines.where(_possible(F.col("line"), table)).select("key", digest(F.col("line")).alias("digest")).join(
        broadcast_if_bounded(table), "digest").groupBy("key").agg(
        F.array_join(F.sort_array(F.collect_set("names")), ", ").alias("notices"))
    return whole.join(found, "key", "left").select(
        "doc_id", "text_digest", "licence", F.coalesce("notices", F.lit("")).alias("notices"))
