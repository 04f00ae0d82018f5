"""Licences by canonical digest: normalise a text, hash it, join the hash with those of known licence texts.

Normalisation drops copyright lines, folds A-Z to lower case, brings equivalent spellings to one, and makes every run
of punctuation and white space one space. Whole documents are looked up, and each of their lines, for notices that
are a line of their own. Built-in column functions only.
"""

from __future__ import annotations

import pkgutil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ“”‘’–—… "
_LOWER = "abcdefghijklmnopqrstuvwxyz        "
_COPYRIGHT = (r"(?m)^[ \t#*/;]*(copyright[ \t]*(\(c\)|©|[0-9]|<|\[|by )|\(c\)[ \t]*[0-9]|©|all rights reserved)"
              r"[^\n]*$")
#: Equivalent spellings, the second is used. Fixed values.
SPELLINGS = (
    ("licence", "license"), ("sublicence", "sublicense"), ("organisation", "organization"), ("authorised", "authorized"),
    ("acknowledgement", "acknowledgment"), ("merchantibility", "merchantability"), ("favour", "favor"),
    ("analogue", "analog"), ("judgement", "judgment"), ("per cent", "percent"), ("sub-license", "sublicense"),
    ("non-infringement", "noninfringement"), ("https://", "http://"), ("copyright holder", "copyright owner"),
)
_AS_IS = ("THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
          "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS "
          "OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
          "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")
_ISC = ("THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL "
        "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
        "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN "
        "AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
        "PERFORMANCE OF THIS SOFTWARE.")
_BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution.\n")
_BSD_3 = ("3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
          "products derived from this software without specific prior written permission.\n")
_BSD_END = ("THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
            "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
            "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
            "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
            "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
            "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
            "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
_MIT = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice "
        "and this permission notice shall be included in all copies or substantial portions of the Software.\n\n" + _AS_IS)
_GRANT = ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted")
_KEEP = ", provided that the above copyright notice and this permission notice appear in all copies.\n"
#: Licences whose whole text is a file of license_texts, in its current wording. Fixed values.
TEXTS = ("Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0", "Unlicense", "BSL-1.0", "Zlib")
_END = "END OF TERMS AND CONDITIONS"
#: (licence, names of it in notices, its SPDX forms). Fixed values.
NAMES = (
    ("MIT", ("MIT License",), ("MIT",)),
    ("Apache-2.0", ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"), ("Apache-2.0",)),
    ("ISC", ("ISC License",), ("ISC",)), ("0BSD", ("BSD Zero Clause License", "Zero-Clause BSD License"), ("0BSD",)),
    ("BSD-2-Clause", ("BSD 2-Clause License", "Simplified BSD License"), ("BSD-2-Clause",)),
    ("BSD-3-Clause", ("BSD 3-Clause License", "New BSD License", "Modified BSD License"), ("BSD-3-Clause",)),
    ("MPL-2.0", ("Mozilla Public License, version 2.0", "Mozilla Public License 2.0"), ("MPL-2.0",)),
    ("Unlicense", ("Unlicense",), ("Unlicense",)), ("Zlib", ("zlib License",), ("Zlib",)),
    ("BSL-1.0", ("Boost Software License, Version 1.0", "Boost Software License 1.0"), ("BSL-1.0",)),
    ("EPL-2.0", ("Eclipse Public License 2.0", "Eclipse Public License, version 2.0"), ("EPL-2.0",)),
)
_GNU = (("GPL-2.0", "General", "GPL", "2"), ("GPL-3.0", "General", "GPL", "3"), ("LGPL-2.1", "Lesser General", "LGPL", "2.1"),
        ("LGPL-3.0", "Lesser General", "LGPL", "3"), ("AGPL-3.0", "Affero General", "AGPL", "3"))
_CC = (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"),
       ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-ND", "Attribution-NoDerivatives"),
       ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))
_NOTICES = ("Released under {}.", "Licensed under {}.", "Distributed under {}.", "This project is licensed under {}.",
            "This work is licensed under {}.", "This software is licensed under {}.")


def _whole_texts() -> list[tuple[str, str]]:
    """The files of license_texts, and those with instructions after the terms also without them."""
    found = []
    for name in TEXTS:
        text = pkgutil.get_data(__package__, f"license_texts/{name}.txt").decode()
        found.append((name, text))
        if _END in text:
            found.append((name, text[:text.index(_END) + len(_END)]))
    return found


def _notices() -> list[tuple[str, str]]:
    """Notices and SPDX lines of the licences in NAMES, of the GNU licences and of Creative Commons."""
    named, spdx = [(a, f"the {n}") for a, names, _ in NAMES for n in names], [(a, x) for a, _, forms in NAMES for x in forms]
    for name, kind, short, version in _GNU:
        plain = version + ".0" * ("." not in version)
        for either, tail in ((name, ""), (name + "-or-later", " or later"), (name + "-or-later", " or any later version"),
                             (name + "-only", " only")):
            full = {f"GNU {kind} Public License, {word} {v}" for word in ("version", "v") for v in {version, plain}}
            named += [(either, f"{article}{n}{tail}") for article in ("the ", "")
                      for n in sorted({*full, f"GNU {short} v{version}", f"GNU {short} v{plain}", f"{short}-{plain}"})]
        spdx += [(name, name), (name + "-only", name + "-only"), (name + "-or-later", name + "-or-later")]
    for short, long in _CC:
        for version, law in (("4.0", "International"), ("3.0", "Unported")):
            name, full = f"CC-{short}-{version}", f"Creative Commons {long} {version} {law}"
            named += [(name, x) for x in (f"CC {short} {version}", f"a CC {short} {version} License", f"the CC {short} {version} License",
                                          full, f"a {full} License", f"the {full} License")]
            spdx.append((name, name))
    named += [("CC0-1.0", x) for x in ("CC0 1.0", "CC0 1.0 Universal", "the Creative Commons CC0 1.0 Universal License")]
    spdx.append(("CC0-1.0", "CC0-1.0"))
    return [(a, t.format(x)) for a, x in named for t in _NOTICES] + [(a, f"SPDX-License-Identifier: {x}") for a, x in spdx]


#: (licence, text or notice). Fixed values.
KNOWN = tuple({text: (name, text) for name, text in (
    ("MIT", _MIT), ("MIT", "MIT License\n" + _MIT), ("MIT", "The MIT License (MIT)\n" + _MIT),
    ("ISC", _GRANT + _KEEP + _ISC), ("ISC", "ISC License\n" + _GRANT + _KEEP + _ISC),
    ("0BSD", _GRANT + ".\n" + _ISC), ("BSD-2-Clause", _BSD + _BSD_END), ("BSD-3-Clause", _BSD + _BSD_3 + _BSD_END),
    ("BSD-2-Clause", "BSD 2-Clause License\n" + _BSD + _BSD_END),
    ("BSD-3-Clause", "BSD 3-Clause License\n" + _BSD + _BSD_3 + _BSD_END),
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."), ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"), ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    *_whole_texts(), *_notices(),
)}.values())


def canonical_lines(text: Column) -> Column:
    """The normalised text with its line breaks; a null stays null."""
    t = F.translate(text, _UPPER, _LOWER)
    t = F.regexp_replace(t, _COPYRIGHT, "")
    for other, one in SPELLINGS:
        t = F.replace(t, F.lit(other), F.lit(one))
    return F.regexp_replace(t, "[^a-z0-9\\n\\x{80}-\\x{10ffff}]+", " ")


def canonical(lines: Column) -> Column:
    """One line of words from the result of canonical_lines."""
    return F.trim(F.regexp_replace(lines, "[ \\n]+", " "))


def known_digests(spark: SparkSession, known=KNOWN) -> DataFrame:
    """(license_id, digest) of a bounded list of known texts; texts that are equal in normal form count once."""
    table = spark.createDataFrame(list(known), "license_id string, text string")
    digest = F.sha2(canonical(canonical_lines(F.col("text"))), 256)
    return table.select("license_id", digest.alias("digest")).groupBy("digest").agg(F.min("license_id").alias("license_id"))


def match_licenses(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line, license_id, digest) of every match; ``line`` is -1 for the whole text, else counted from 0.

    Null, empty and wordless texts match nothing. A text of one line that is a notice matches as whole and as line.
    Repeated rows each give their matches, null ids stay null, other columns are ignored. ``known`` has (digest,
    license_id); Spark's size check decides whether it is broadcast.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), canonical_lines(F.col(text_col)).alias("lines"))
    units = rows.select("doc_id", F.posexplode(F.concat(F.array(canonical(F.col("lines"))), F.transform(
        F.split("lines", "\n", -1), lambda x: F.trim(x)))).alias("at", "unit"))
    return (units.where("unit <> ''")
            .select("doc_id", (F.col("at") - 1).alias("line"), F.sha2(F.col("unit").cast("binary"), 256).alias("digest"))
            .join(known, "digest").select("doc_id", "line", "license_id", "digest"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def oracle_sql(known=KNOWN) -> str:
    """The same lookup for DuckDB."""
    def lines(text: str) -> str:
        t = f"translate({text}, {_quoted(_UPPER)}, {_quoted(_LOWER)})"
        t = f"regexp_replace({t}, {_quoted(_COPYRIGHT.replace(chr(92) + 'u00a9', chr(0xA9)))}, '', 'g')"
        for other, one in SPELLINGS:
            t = f"replace({t}, {_quoted(other)}, {_quoted(one)})"
        return f"regexp_replace({t}, '[^a-z0-9\\n\\x{{80}}-\\x{{10ffff}}]+', ' ', 'g')"
    one_line = "trim(regexp_replace({}, '[ \\n]+', ' ', 'g'), ' ')"
    values = ", ".join(f"({_quoted(a)}, {_quoted(b)})" for a, b in known)
    return f"""
WITH known AS (SELECT digest, min(license_id) AS license_id FROM (
  SELECT license_id, sha256({one_line.format(lines('text'))}) AS digest FROM (VALUES {values}) AS k(license_id, text)) GROUP BY 1),
folded AS (SELECT doc_id, {lines('text')} AS lines FROM documents WHERE text IS NOT NULL),
units AS (SELECT doc_id, -1 AS line, {one_line.format('lines')} AS unit FROM folded UNION ALL
  SELECT doc_id, CAST(unnest(range(len(parts))) AS INTEGER) AS line, trim(unnest(parts), ' ') AS unit FROM (
    SELECT doc_id, string_split(lines, chr(10)) AS parts FROM folded))
SELECT doc_id, CAST(line AS INTEGER) AS line, license_id, digest
FROM (SELECT doc_id, line, sha256(unit) AS digest FROM units WHERE unit <> '') JOIN known USING (digest)"""
