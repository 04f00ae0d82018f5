"""Normal forms by hand; the query has its SQL."""

import pathlib

from gatelake.llm import licenses


def matches(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return {(r.doc_id, r.line, r.license_id) for r in licenses.match_licenses(docs, licenses.known_digests(spark)).collect()}


def test_spelling_case_punctuation_and_copyright_lines(spark):
    text = next(t for name, t in licenses.KNOWN if name == "MIT")
    written = "Copyright (c) 2024 Somebody <a@b.c>\n\n" + text.upper().replace("SUBLICENSE", "sublicence").replace("\"", "”")
    wrapped = "\n".join("# " + text[i:i + 70] for i in range(0, 0)) or text.replace(" ", "\n", 40)
    rows = [(1, written), (2, wrapped), (3, text + " But not here."), (4, "intro\n  released under the MIT licence\nend"), (5, ""), (6, None)]
    assert matches(spark, rows) == {(1, -1, "MIT"), (2, -1, "MIT"), (4, 1, "MIT")}


def test_known_texts_do_not_meet(spark):
    assert licenses.known_digests(spark).count() == len({t for _, t in licenses.KNOWN})


def test_notices_of_the_tables_and_common_licences(spark):
    rows = [(1, "prose\nLicensed under CC BY-NC 4.0.\nprose"), (2, "x\n// SPDX-License-Identifier: CC-BY-NC-4.0\n"),
            (3, "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
            (4, "x\nSPDX-License-Identifier: AGPL-3.0-or-later"), (5, "x\nLicensed under the Mozilla Public License 2.0"),
            (6, "Licensed under CC BY-NC 4.0 terms.\nx"), (7, "x\nLicensed under the GNU General Public License, version 2 or later.")]
    assert matches(spark, rows) == {(1, 1, "CC-BY-NC-4.0"), (2, 1, "CC-BY-NC-4.0"), (3, -1, "CC-BY-SA-4.0"), (3, 0, "CC-BY-SA-4.0"),
                                    (4, 1, "AGPL-3.0-or-later"), (5, 1, "MPL-2.0"), (7, 1, "GPL-2.0-or-later")}


def test_whole_texts(spark):
    names = ("Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0", "Unlicense", "BSL-1.0", "Zlib")
    folder = pathlib.Path(licenses.__file__).parent / "license_texts"
    texts = {n: (folder / f"{n}.txt").read_text() for n in names}
    end = "END OF TERMS AND CONDITIONS"
    rows = [(i, "\n".join("# " + x for x in texts[n].upper().split("\n"))) for i, n in enumerate(names)]
    rows += [(100 + i, texts[n].split(end)[0] + end) for i, n in enumerate(names) if end in texts[n]]
    found = matches(spark, rows)
    assert {(d, name) for d, line, name in found if line == -1} == {(d, names[d % 100]) for d, _ in rows}


def test_odd_rows(spark, odd_docs):
    known = licenses.known_digests(spark)
    assert licenses.match_licenses(odd_docs, known).count() == 0
    assert licenses.match_licenses(odd_docs.limit(0), known).count() == 0
    twice = spark.createDataFrame([(None, "SPDX-License-Identifier: MIT", 1)] * 2, "doc_id long, text string, digest int")
    assert licenses.match_licenses(twice, known).count() == 4
    plan = licenses.match_licenses(odd_docs, known)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
