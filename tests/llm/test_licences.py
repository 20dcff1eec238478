import hashlib
import os
import re
import textwrap

import pytest

from nimbusvec.llm import licences
from tests.helpers import same, sql
from tests.llm.common import NASTY, docs, nasty

MIT = licences.LICENCES["MIT"]


def plain_line(line):
    low = line.lower()
    if re.match(r"^\W*(?:copyright\b(?! (?:holder|owner|notice))|\(c\)|©|all rights reserved\W*$)", low):
        return ""
    s = " ".join("".join(c if c.isalnum() else " " for c in low).split())
    for pattern, to in (("licence", "license"), ("merchantibility", "merchantability"), ("non infringement", "noninfringement")):
        s = s.replace(pattern, to)
    s = re.sub(r"\bcopyright owner(s?)\b", r"copyright holder\1", s)
    return re.sub(r"\bv(?:ersion)? ?(\d)", r"version \1", s)


def plain_body(text):
    lines = plain(text)
    while lines and len(plain(text)) - len(lines) < licences.TITLES and re.search(licences.TITLE, lines[0]):
        lines = lines[1:]
    return lines


def plain(text):
    return [x for x in map(plain_line, re.split("\r\n|\r|\n", text or "")) if x]


def scan(df, **more):
    return {r.doc_id: (r.canonical_sha256, r.licence, r.notices) for r in licences.scan(df, **more).collect()}


VARIANTS = [
    MIT, "Copyright (c) 2024 Somebody\n\n" + MIT, MIT.upper(), MIT.replace("\n\n", "\r\n\r\n"), "  " + MIT.replace(", ", " ,\t"), MIT.replace("NONINFRINGEMENT", "non-infringement"), "(c) 1999 A, B\nAll rights reserved.\n" + MIT.replace("License", "Licence"),
    MIT.replace("\n\n", " \n\n © 2020 X\n"),
]


def test_variants_of_one_text_are_known(spark):
    got = scan(docs(spark, VARIANTS))
    assert {g[1] for g in got.values()} == {"MIT"} and len({g[0] for g in got.values()}) == 1


TERMS = MIT.split("\n\n", 1)[1]
TITLED = [
    TERMS, "The MIT License (MIT)\n\n" + TERMS, "The MIT Licence\n\nCopyright 2020 X\n\n" + TERMS, "MIT License (Expat)\nhttps://opensource.org/licenses/\n" + TERMS,
    "\n".join(" * " + x for x in textwrap.wrap(MIT, 70, replace_whitespace=False)), "# " + MIT.replace(" software ", "\n# software ").replace("\n\n", "\n#\n# "),
]


def test_titles_wraps_and_comment_marks_do_not_count(spark):
    got = scan(docs(spark, [*TITLED, "MIT License", "The MIT License (MIT)\nversion 2", "Some Program\n" + TERMS]))
    assert [got[i][1] for i in range(len(TITLED) + 3)] == ["MIT"] * len(TITLED) + [None] * 3


@pytest.mark.skipif(not os.path.isdir("/usr/share/common-licenses"), reason="no licence texts on this machine")
def test_long_licences_are_known_by_their_digest(spark):
    named = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    texts = []
    for f in named:
        with open(f"/usr/share/common-licenses/{f}") as file:
            texts.append(file.read())
    got = scan(docs(spark, [x for t in texts for x in (t, "// " + t.replace("\n", "\n// ").upper(), t[:-60])]))
    assert [got[i][1] for i in range(3 * len(texts))] == [x for name in named.values() for x in (name, name, None)]
    assert hashlib.sha256(" ".join(plain_body(texts[0])).encode()).hexdigest() in licences.DIGESTS["Apache-2.0"]


def test_summary_tells_the_paths_apart(spark):
    scanned = licences.scan(docs(spark, [MIT, MIT, "Released under the MIT License.", "x"]))
    assert {tuple(r) for r in licences.summary(scanned).collect()} == {("text", "MIT", 2), ("line", "MIT", 1)}


def test_string_ids_with_nulls(spark):
    df = spark.createDataFrame([(None, "Released under the MIT License."), ("null", "Released under the MIT License.")], "doc_id string, text string")
    assert licences.scan(df).count() == 2


def test_query_matches_its_sql(spark):
    from nimbusvec.llm import queries

    same(queries.op2_license_scan(spark, "/root/testdata/sf0.01").toPandas(), sql(queries.op2_sql(), "/root/testdata/sf0.01"))

def test_every_licence_is_itself_and_changed_ones_are_not(spark):
    names = list(licences.LICENCES)
    texts = [licences.LICENCES[n] for n in names] + [licences.LICENCES[n] + " and more" for n in names]
    got = scan(docs(spark, texts))
    assert [got[i][1] for i in range(len(texts))] == names + [None] * len(names)


NOTICES = {
    "Released under the MIT License.": "MIT", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "# licenced under the Apache Licence, v2.0": "",
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "// Licensed under the Apache Licence, Version 2.0": "Apache-2.0", "Released under the MIT License, mostly.": "", "released": "",
}


def test_notices(spark):
    got = scan(docs(spark, ["some words\n" + x + "\nmore words" for x in NOTICES] + list(NOTICES)))
    for i, (line, name) in enumerate(NOTICES.items()):
        if name:
            assert got[i][2] == got[len(NOTICES) + i][2] == name, line
        assert got[i][1] is None


def test_brute_force_digests(spark):
    texts = [t for _, t, _ in NASTY] + VARIANTS + ["Copyright notice\nx", "v2 version 3 licenced LICENCE"]
    got = scan(docs(spark, texts))
    assert {i: g[0] for i, g in got.items()} == {i: hashlib.sha256(" ".join(plain(t)).encode()).hexdigest() for i, t in enumerate(texts)}


def test_nasty_rows(spark):
    assert licences.scan(nasty(spark)).count() == len(NASTY)
    assert licences.scan(docs(spark, [])).collect() == []
    assert scan(docs(spark, ["x"]), licences={}, lines={})[0][1:] == (None, "")
    two = licences.scan(docs(spark, [(1, MIT, "s"), (1, MIT, "s"), (None, "Released under the MIT License.", "s"), (None, None, "s")])).collect()
    assert sorted(((r.doc_id, r.licence, r.notices) for r in two), key=repr) == sorted([(1, "MIT", ""), (1, "MIT", ""), (None, None, "MIT"), (None, None, "")], key=repr)


def test_query(spark):
    from nimbusvec.llm.queries import op2_license_scan

    got = op2_license_scan(spark, "/root/testdata/sf0.1").where("notices <> ''").toPandas()
    rows = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").collect()
    known = {plain_line(k): v for k, v in licences.notices().items()}
    want = {}
    for r in rows:
        hit = {known[x] for x in plain(r.text) if x in known}
        if hit:
            want[r.doc_id] = ",".join(sorted(hit))
    assert dict(zip(got.doc_id, got.notices)) == want and len(want) > 100
