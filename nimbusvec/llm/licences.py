"""License scans: canonical digests of whole texts and of single lines, joined to those of known licences.

A text is put in canonical form line by line: lower case, copyright lines gone, equivalent
spellings made one, everything but letters and digits a single space, so that wraps and
comment marks don't count. The SHA-256 of all its lines together, without the titles that it
may begin with, meets the digests of whole licence texts: those given here, and those of long
ones that are known by their digest alone. Apart from that, the digests of its short lines
meet those of known notices. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nimbusvec.llm.shared import column, stored

# Texts of public licences, their holders' names left out.
_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. '
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
    "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
)
_BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
_BSD_TAIL = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
LICENCES = {
    "MIT": (
        "MIT License\n\n"
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, '
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\n"
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n"
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "ISC": "ISC License\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _AS_IS,
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n" + _AS_IS,
    "BSD-2-Clause": _BSD_HEAD + _BSD_TAIL,
    "BSD-3-Clause": _BSD_HEAD + _BSD_NAMES + _BSD_TAIL,
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.\n\n"
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\n"
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. "
        "We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\n"
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
        "IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n\n"
        "For more information, please refer to <https://unlicense.org>"
    ),
    "BSL-1.0": (
        "Boost Software License - Version 1.0 - August 17th, 2003\n\n"
        'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, '
        "and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:\n\n"
        "The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, "
        "unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.\n\n"
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. '
        "IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\n"
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n"
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n"
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n"
        "3. This notice may not be removed or altered from any source distribution."
    ),
}
# SHA-256 of the canonical forms of long public licences, titles left out; with and without the appendix where one follows the terms.
DIGESTS = {
    "Apache-2.0": ("54fb878b8e20d7e27c18524d72d5a94dd112f996bdb362eb2872373bd9ecfb67", "f5d470c2765a1d51794e31eb7b40d8b944dd3a60a62debdf18db8d0a253bd212"),
    "Artistic-1.0-Perl": ("09298ea5f55a44867296b42e98842579815a99e2b295c0aa24cf234134c9ebeb",),
    "CC0-1.0": ("e3ba2aff64372f535373996fe68b166f9e97dc1ead5b471981213ebb8f310ad6",),
    "GFDL-1.2": ("aa8e67692652aa0ece49069f2f9dffde6690debb563e627bab22508062ff269c", "8ba1d3a5e77649f38fcf5eed49c963b94e6e5dd9030997c1b85bb7065eb316bc"),
    "GFDL-1.3": ("2837649fc69f2b78b1c73c4bef637687dc74a9381faed9cf7df7eef537d330c0", "8b2e1bf047a0e628f2733f522e44835b432aec36a6a8b261627b2075435aefa2"),
    "GPL-1.0": ("7481518665d2db9ad29e3c605da9055f9b635541a3f6f50caea2de6e014e42f3", "733356cadf8ca8b0ac2db2d593fb7c1a2b0528c7e891f8a911fdaeb64719fff5"),
    "GPL-2.0": ("4767c85efb312bbe244abef9b752be38b44e810f05ed9bfae182caf068d13fd3", "8fa94d3d812775805528fff117ea835ed908322b039e129b957550c1e107d3e2"),
    "GPL-3.0": ("372bf286f2094dcdafac7a8f210246612fb612cff76a4cc408ce9949090c2481", "38e1da287a910dedf3f41aebb1b50dceabe7f4b57bab61c941324c85755d529b"),
    "LGPL-2.0": ("6bdaf0d88c2263fec5d9c536bd7aee96c7dc63c3282edd2e693611ba3878ead3", "7615904815ca48b3f30c1140a2afddcaa9c3859c36364dc81eaf71cffebb1a97"),
    "LGPL-2.1": ("ad65d00dc8afab68a244041ae84c72563ead06e0ac4dbdc6e3097fc3289909d4", "8c0ee8195f4f9613026227b85b65ff16a35fda7d0225620d25bc18312791ef3b"),
    "LGPL-3.0": ("13980739d6423be0921994d8ce3ce547437735b0e6733161f70b19c962f194b7",),
    "MPL-1.1": ("5f65790f99e609a9152deed8a1ad32c76ba56e2cd93b039597d4265afb177c60",),
    "MPL-2.0": ("429c0b9182631e671cffb0adc421caaacb2313655fb2c0aae033db4af1c395aa",),
}
# Names of licences as notices write them.
NAMES = {
    "Apache-2.0": ("apache license version 2.0", "apache license 2.0"),
    "MIT": ("mit license",),
    "GPL-3.0": ("gnu general public license version 3", "gnu gpl version 3", "gpl 3.0"),
    "GPL-2.0": ("gnu general public license version 2", "gnu gpl version 2", "gpl 2.0"),
    "LGPL-3.0": ("gnu lesser general public license version 3",),
    "AGPL-3.0": ("gnu affero general public license version 3",),
    "MPL-2.0": ("mozilla public license version 2.0", "mozilla public license 2.0"),
    "BSD-3-Clause": ("3 clause bsd license", "bsd 3 clause license"),
    "BSD-2-Clause": ("2 clause bsd license", "bsd 2 clause license"),
    "CC-BY-4.0": ("cc by 4.0",),
    "CC-BY-SA-4.0": ("cc by sa 4.0",),
    "CC-BY-NC-4.0": ("cc by nc 4.0",),
    "CC0-1.0": ("cc0 1.0",),
}
OPENINGS = ("licensed under", "released under", "distributed under", "this work is licensed under", "this file is licensed under", "this software is licensed under")
#: Equivalent spellings, as pattern and what it becomes, on lower-case text of letters, digits and single spaces.
SPELLINGS = ((r"\blicence(s|d)?\b", "license$1"), (r"\b(un|sub)licenced?\b", "$1license"), (r"\bcopyright owner(s?)\b", "copyright holder$1"), (r"\bmerchantibility\b", "merchantability"), (r"\bnon infringement\b", "noninfringement"), (r"\bv(?:ersion)? ?(\d)", "version $1"))
#: Known texts up to which their digests, about a hundred bytes each, are sent to every task.
BROADCAST_ROWS = 50_000
#: Lines that a licence may begin with and that say nothing but its name; at most TITLES of them are left out.
TITLE = (
    r"^(?:the )?(?:(?:mit|isc|bsd|0bsd|zlib|apache|artistic|unlicense|gnu(?: [a-z]+){2,4}|mozilla public|boost software|creative commons|[0-9] clause bsd|(?:new|simplified|modified|original) bsd|bsd [0-9] clause)"
    r"(?: license)?(?: (?:mit|isc|expat|x11))?(?: version [0-9 ]+)?(?: [a-z]+ [0-9a-z]+ [0-9]{4})?|version [0-9 ]+(?:[a-z]+ )?[0-9]{0,4}|https? [a-z ]+|creative commons legal code|cc0 1 0 universal)$"
)
TITLES = 3
COPYRIGHT = r"^\W*(?:copyright\b(?! (?:holder|owner|notice))|\(c\)|©|all rights reserved\W*$).*"


def _canonical_line(line: Column) -> Column:
    low = F.lower(line)
    plain = F.trim(F.regexp_replace(F.when(low.rlike(COPYRIGHT), F.lit("")).otherwise(low), r"[^\p{L}\p{N}]+", " "))
    spelt = plain
    for pattern, to in SPELLINGS:
        spelt = F.regexp_replace(spelt, pattern, to)
    # only lines that hold one of the words need the spellings looked at
    return F.when(plain.rlike(r"licence|owner|merchantib|non infr|\bv(?:ersion)? ?\d"), spelt).otherwise(plain)


def canonical_lines(text: Column) -> Column:
    """The canonical lines of a text that have anything left."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n"), _canonical_line), lambda x: x != "")


def canonical(text: Column) -> Column:
    return F.array_join(canonical_lines(text), " ")


def body(lines: Column) -> Column:
    """Canonical lines without the titles that they begin with."""
    title = [F.coalesce(F.get(lines, F.lit(i)).rlike(TITLE), F.lit(False)) for i in range(TITLES)]
    gone = F.lit(0)
    for i in reversed(range(TITLES)):
        gone = F.when(title[i], gone + 1).otherwise(F.lit(0))
    return F.slice(lines, gone + 1, F.greatest(F.size(lines), F.lit(1)))


def notices() -> dict[str, str]:
    """Notice -> licence, every opening with every name, with and without an article."""
    return {f"{o} {the}{n}": spdx for spdx, names in NAMES.items() for n in names for o in OPENINGS for the in ("", "the ")} | {f"spdx license identifier {spdx}": spdx for spdx in [*NAMES, *LICENCES]}


def known(spark: SparkSession, texts: dict[str, str], digests: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(digest, licence, chars) of known texts and of digests alone; two licences of one canonical text count as the first by name."""
    table = spark.createDataFrame(list(texts.items()), "licence string, text string").select("licence", F.array_join(body(canonical_lines(F.col("text"))), " ").alias("canon"))
    own = table.select("licence", F.sha2("canon", 256).alias("digest"), F.length("canon").alias("chars"))
    listed = spark.createDataFrame([(k, d, None) for k, ds in (digests or {}).items() for d in ds], "licence string, digest string, chars int")
    return own.unionByName(listed).groupBy("digest").agg(F.min("licence").alias("licence"), F.max("chars").alias("chars"))


def _sent(table: DataFrame, n: int) -> DataFrame:
    """A table of n known digests, sent to every task if they are few enough; else Spark decides."""
    return F.broadcast(table) if n <= BROADCAST_ROWS else table


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", licences: dict[str, str] | None = None, lines: dict[str, str] | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, canonical_sha256, licence, notices.

    licence: the known licence whose whole text the document's is, but for titles before it,
    else null. notices, found apart from that: the licences that single lines of it name,
    sorted, with commas between; empty if none. A null text counts as empty, which matches
    nothing; long ones count whole. Repeated rows get the same answer each. Other columns are
    not read; an empty table gives an empty one. licences (name -> text) and lines (notice ->
    name) replace the known ones.
    """
    spark = docs.sparkSession
    whole, single = LICENCES if licences is None else licences, notices() if lines is None else lines
    digests = DIGESTS if licences is None else {}
    # a notice may be the name alone, which is no title here
    noted = spark.createDataFrame(list(single.items()), "text string, licence string").withColumn("canon", canonical(F.col("text")))
    noted = noted.groupBy(F.sha2("canon", 256).alias("digest")).agg(F.min("licence").alias("licence"), F.max(F.length("canon")).alias("chars"))
    texts = known(spark, whole, digests)
    low, high = noted.agg(F.coalesce(F.min("chars"), F.lit(1)), F.coalesce(F.max("chars"), F.lit(0))).first()
    canon = docs.select(column(doc_id).alias("doc_id"), F.monotonically_increasing_id().alias("row"), canonical_lines(column(text)).alias("lines"))
    short = F.array_distinct(F.filter("lines", lambda x: F.length(x).between(low, high)))
    digest = lambda x: F.sha2(F.array_join(x, " "), 256)
    facts, _ = stored(canon.select("doc_id", "row", digest("lines").alias("canonical_sha256"), digest(body(F.col("lines"))).alias("body"), F.transform(short, lambda x: F.sha2(x, 256)).alias("short")), "canonical")
    named = facts.select("row", F.explode("short").alias("digest")).join(_sent(noted.select("digest", "licence"), len(single)), "digest")
    per_row = named.groupBy("row").agg(F.array_join(F.array_sort(F.collect_set("licence")), ",").alias("notices"))
    out = facts.drop("short").join(per_row, "row", "left")
    out = out.join(_sent(texts.select(F.col("digest").alias("body"), "licence"), len(whole) + len(digests)), "body", "left")
    return out.select("doc_id", "canonical_sha256", "licence", F.coalesce("notices", F.lit("")).alias("notices"))


def summary(scanned: DataFrame) -> DataFrame:
    """(path, licence, rows) of what scan() gives: how many rows each path, text or line, found each licence in."""
    by_text = scanned.where("licence is not null").select(F.lit("text").alias("path"), "licence")
    by_line = scanned.where("notices <> ''").select(F.lit("line").alias("path"), F.explode(F.split("notices", ",")).alias("licence"))
    return by_text.unionByName(by_line).groupBy("path", "licence").agg(F.count("*").alias("rows"))
