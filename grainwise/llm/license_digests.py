"""Licence texts found by the digest of their canonical form.

A text is brought to a canonical form (lines with copyright notices go, case and punctuation
are levelled, equivalent spellings become one) and its SHA-256 is joined with the digests of
known licences. Entire texts are compared: the whole document, and each of its lines as a
short notice of its own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grainwise.llm.license_texts import DIGESTS
from grainwise.llm.tables import small

COPYRIGHT_LINE = r"(?im)^[^\na-z0-9]*(copyright|\(c\) *[0-9]|©|all rights reserved)[^\n]*$"
#: Control characters, spaces and punctuation of ASCII, and common typographic marks.
LEVELLED = r"[\x00-/:-@\[-`{-\x7f«»“”‘’–—…·•©]+"
# Spellings that licence matching treats as the same.
SPELLINGS = (
    ("licence", "license"),
    ("licenced", "licensed"),
    ("sub license", "sublicense"),
    ("sub licence", "sublicense"),
    ("non commercial", "noncommercial"),
    ("no warranty", "no warranties"),
    ("per cent", "percent"),
    ("organisation", "organization"),
    ("favour", "favor"),
    ("whilst", "while"),
    ("merchantibility", "merchantability"),
    ("acknowledgement", "acknowledgment"),
    ("https", "http"),
)
# Published licence texts and notices.
_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE "
    "FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION "
    "WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_MIT_GRANT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the '
    '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
    "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject "
    "to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial "
    "portions of the Software.\n\n"
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
    'the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS '
    "ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE "
    "AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA "
    "OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
    "PERFORMANCE OF THIS SOFTWARE."
)
KNOWN_TEXTS = (
    ("MIT", _MIT_GRANT + _WARRANTY),
    ("MIT", "MIT License\n\n" + _MIT_GRANT + _WARRANTY),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("ISC", _ISC),
    ("ISC", "ISC License\n\n" + _ISC),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
)
# Names by which notices call a licence.
NAMES = {
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "AGPL-3.0", "AGPLv3"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0 License", "Apache 2.0 License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "3-Clause BSD License", "New BSD License"),
    "BSL-1.0": ("Boost Software License, Version 1.0", "Boost Software License 1.0"),
    "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-ND-4.0": ("CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"),
    "CC0-1.0": ("CC0 1.0", "CC0 1.0 Universal"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU General Public License v2.0", "GPL-2.0", "GPLv2"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU General Public License v3.0", "GPL-3.0", "GPLv3"),
    "ISC": ("ISC License",),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1", "LGPL-2.1", "LGPLv2.1"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "LGPL-3.0", "LGPLv3"),
    "MIT": ("MIT License", "MIT Licence"),
    "MPL-2.0": ("Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL-2.0"),
    "Unlicense": ("Unlicense",),
}
_SUBJECTS = ("", "This work is ", "This project is ", "This software is ", "This program is ", "This code is ", "This file is ")
_VERBS = ("licensed under ", "released under ", "distributed under ", "available under ")
#: Each known licence and notice holds one of these in its canonical form, and levelling joins no letters: a line without them is none.
TELLING = ("licen", "permi", "domain", "released", "distributed", "available")
#: What a line must hold in lower case to be a copyright line.
COPYRIGHT_SIGNS = ("copyright", "(c)", "©", "all rights reserved")
NOTICES = tuple((a, s + v + the + name) for a, names in NAMES.items() for name in names for s in _SUBJECTS for v in _VERBS for the in ("", "the ", "the terms of the "))


def holds_any(text: Column, parts: tuple[str, ...]) -> Column:
    return reduce(lambda x, y: x | y, (F.contains(text, F.lit(p)) for p in parts))


def canonical(text: Column) -> Column:
    """Canonical form of a text; empty if nothing but copyright lines and punctuation is left.

    Words are two blanks apart until their spellings are levelled, so that neighbours share none.
    """
    without = F.when(holds_any(F.lower(text), COPYRIGHT_SIGNS), F.regexp_replace(text, COPYRIGHT_LINE, " ")).otherwise(text)
    level = F.concat(F.lit("  "), F.regexp_replace(F.lower(without), LEVELLED, "  "), F.lit("  "))
    spelled = reduce(lambda x, pair: F.replace(x, F.lit(apart(pair[0])), F.lit(apart(pair[1]))), SPELLINGS, level)
    return F.trim(F.replace(spelled, F.lit("  "), F.lit(" ")))


def apart(words: str) -> str:
    return f" {words.replace(' ', '  ')} "


def digest(text: Column) -> Column:
    """SHA-256 of the canonical form; NULL where that is empty or the text is NULL."""
    form = canonical(text)
    return F.when(form != "", F.sha2(form, 256))


def known_licenses(spark: SparkSession, texts=KNOWN_TEXTS + NOTICES, digests=DIGESTS) -> DataFrame:
    """(digest, license_id); of two licences with one canonical form the first name counts."""
    made = spark.createDataFrame(list(texts), "license_id string, text string").select(digest(F.col("text")).alias("digest"), "license_id")
    whole = spark.createDataFrame([(d, a) for a, own in digests.items() for d in own], "digest string, license_id string")
    return made.union(whole).groupBy("digest").agg(F.min("license_id").alias("license_id")).where("digest is not null")


def scan(docs: DataFrame, known: DataFrame, key: str = "doc_id", text: str = "text", telling: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: key, digest, license_id of the whole text, notices, n_notice_lines.

    ``notices`` is the sorted, comma-separated list of licences that entire lines name, NULL if
    there is none. NULL or empty text has a NULL digest and no licence. Rows repeat as they do
    in the input; the lines of rows with the same key and text count once. The known digests
    are broadcast only if they are few; document texts are never shuffled. With ``telling``, letters
    of which every known canonical form holds one, lines without any of them are passed over.
    """
    known = small(known.select("digest", "license_id"))
    own = docs.select(F.col(key), F.xxhash64(text).alias("__same"), digest(F.col(text)).alias("digest"))
    lines = docs.select(F.col(key), F.col(text), F.xxhash64(text).alias("__same")).select(key, "__same", F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    if telling:
        lines = lines.where(holds_any(F.lower("line"), telling))
    hits = lines.select(key, "__same", "line_no", digest(F.col("line")).alias("digest")).join(known, "digest")
    notices = hits.groupBy(key, "__same").agg(F.array_join(F.array_sort(F.collect_set("license_id")), ",").alias("notices"), F.countDistinct("line_no").alias("n_notice_lines"))
    whole = own.join(known, "digest", "left")
    same = whole[key].eqNullSafe(notices[key]) & whole["__same"].eqNullSafe(notices["__same"])
    return whole.join(notices, same, "left").select(whole[key], "digest", "license_id", "notices", F.coalesce("n_notice_lines", F.lit(0)).cast("long").alias("n_notice_lines"))
