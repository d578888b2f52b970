"""License scans by canonical digest lookup, with DataFrame functions only.

A text's canonical form is in lower case, without copyright lines, with equivalent spellings
made one, and with every run of characters that aren't letters or digits as one space. The
digest of a whole text's canonical form is hash-joined to those of the known licences; so
are the digests of its lines that name a licence, as short notices stand on lines of their own.

A null or empty text, or one without letters or digits, matches nothing; its digest is
that of the empty text. Every row of the table keeps one row, repeated ones and null ids too; an
empty table gives no rows. Very long texts are digested whole. Extra columns are left out, whatever their names. The known
licences (files of licence_texts, their variants and the notices below) are a table of fixed size, the only side
that may be broadcast."""

from __future__ import annotations

import re
from importlib.resources import files

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BULLET = re.compile(r"(?m)^[ \t]*[0-9]+\.[ \t]+")


def _texts() -> list[tuple[str, str]]:
    """(license_id, text) of the files in licence_texts, which hold public texts as their authors publish them, without
    copyright lines, and of their usual variants: with a title or a reserve of rights, with bullets for numbers, and
    the licences that are another's with clauses left out."""
    texts = {f.name.removesuffix(".txt"): f.read_text(encoding="utf-8") for f in sorted(files(__package__).joinpath("licence_texts").iterdir(), key=lambda f: f.name)}
    bsd3 = texts["BSD-3-Clause"]
    texts["BSD-2-Clause"] = bsd3[: bsd3.index("3. Neither")] + bsd3[bsd3.index("THIS SOFTWARE") :]
    texts["0BSD"] = texts["ISC"].replace(", provided that the above copyright notice and this permission notice appear in all copies", "")
    texts["MIT-0"] = texts["MIT"].replace(", subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", ".")
    out = [*texts.items()]
    titles = {"MIT": ("MIT License", "The MIT License (MIT)", "The MIT License"), "MIT-0": ("MIT No Attribution",), "ISC": ("ISC License",), "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD"), "BSD-2-Clause": ("BSD 2-Clause License",), "BSD-3-Clause": ("BSD 3-Clause License",), "Zlib": ("zlib License", "The zlib/libpng License")}
    out += [(i, f"{title}\n{texts[i]}") for i, names in titles.items() for title in names]
    for i, text in out[:]:
        if i.startswith("BSD"):
            first = text.index("Redistribution")
            out.append((i, f"{text[:first]}All rights reserved.\n{text[first:]}"))
    return out + [(i, _BULLET.sub("* ", text)) for i, text in out if i.startswith("BSD")]


#: Notices that stand on a line of their own.
NOTICES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
]
LICENCES = _texts() + NOTICES
#: Spellings that count as one.
SPELLINGS = [("licence", "license"), ("sub license", "sublicense"), ("non infringement", "noninfringement"), ("acknowledgement", "acknowledgment"), ("copyright owner", "copyright holder"), ("version 2 0", "2 0"), ("http", "https"), ("httpss", "https")]
#: A line whose first letters or digits are (c) and a year, or the word copyright before (c), a year or a place for one.
COPYRIGHT_LINE = r"(^|\n)[^\p{L}\p{N}\n]*(copyright[ \t:]*(\(c\)|©|[0-9<\[{])|(\(c\)|©)[ \t]*[0-9])[^\n]*"
NOTICE = "licen|spdx"


def canonical(text: Column) -> Column:
    out = F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), COPYRIGHT_LINE, "\n")
    out = F.regexp_replace(out, r"[^\p{L}\p{N}]+", " ")
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.trim(out)


def known(spark) -> DataFrame:
    """(digest, license_id) of LICENCES."""
    table = spark.createDataFrame([(i, t) for i, t in LICENCES], "license_id string, text string")
    return table.select(F.sha2(canonical(F.col("text")), 256).alias("digest"), "license_id").distinct()


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, canonical_sha256, license_id, notice_ids, n_notices) of each row: the licence that the whole text is
    (else null), and the distinct licences and the number of its lines that are known notices."""
    licences = known(docs.sparkSession)
    by_digest = {r["digest"]: r["license_id"] for r in licences.collect()}  # this module's table
    ids = F.create_map(*(F.lit(x) for pair in sorted(by_digest.items()) for x in pair))
    lines = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: F.lower(x).rlike(NOTICE))
    lines = F.when(F.lower(F.col(text)).rlike(NOTICE), lines).otherwise(F.array().cast("array<string>"))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.sha2(canonical(F.col(text)), 256).alias("canonical_sha256"), F.transform(lines, lambda x: F.sha2(canonical(x), 256)).alias("lines"))
    rows = rows.join(F.broadcast(licences.withColumnRenamed("digest", "canonical_sha256")), "canonical_sha256", "left")
    notices = F.filter(F.transform("lines", lambda x: F.try_element_at(ids, x)), lambda x: x.isNotNull())
    rows = rows.select("doc_id", "canonical_sha256", "license_id", notices.alias("notices"))
    return rows.select("doc_id", "canonical_sha256", "license_id", F.array_join(F.array_sort(F.array_distinct("notices")), ",").alias("notice_ids"), F.size("notices").cast("long").alias("n_notices"))


def _duck(text: str) -> str:
    out = f"regexp_replace(lower(coalesce({text}, '')), '{COPYRIGHT_LINE}', chr(10), 'g')"
    out = f"regexp_replace({out}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')"
    for a, b in SPELLINGS:
        out = f"replace({out}, '{a}', '{b}')"
    return f"sha256(trim({out}))"


def oracle() -> str:
    """The scan as DuckDB SQL."""
    rows = ", ".join("('{}', '{}')".format(i, t.replace("'", "''")) for i, t in LICENCES)
    return f"""
WITH known AS (SELECT DISTINCT {_duck('t')} AS digest, license_id FROM (VALUES {rows}) AS l(license_id, t)),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE regexp_matches(lower(text), '{NOTICE}')),
hits AS (SELECT doc_id, k.license_id FROM lines JOIN known k ON k.digest = {_duck('line')} WHERE regexp_matches(lower(line), '{NOTICE}')),
found AS (SELECT doc_id, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notice_ids, count(*) AS n FROM hits GROUP BY doc_id)
SELECT d.doc_id, {_duck('d.text')} AS canonical_sha256, k.license_id, coalesce(f.notice_ids, '') AS notice_ids, CAST(coalesce(f.n, 0) AS BIGINT) AS n_notices
FROM documents d LEFT JOIN known k ON k.digest = {_duck('d.text')} LEFT JOIN found f ON f.doc_id = d.doc_id"""
