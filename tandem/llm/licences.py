"""Licence scans: canonical texts, hash-joined to the digests of known licences and notices."""

from __future__ import annotations

from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.llm.common import whole

# Spellings that count as equal, applied in this order to lower-case text.
SPELLINGS = (
    ("licence", "license"), ("sub-license", "sublicense"), ("non-commercial", "noncommercial"),
    ("organisation", "organization"), ("favour", "favor"), ("acknowledgement", "acknowledgment"),
    ("per cent", "percent"), ("https://", "http://"), ("&", " and "),
)

# Well-known short licences and notices. The SPDX name, then the wording.
KNOWN = (
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,
and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE."""),
    ("0BSD", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE."""),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors
be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter
it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If
you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not
required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original
software.
3. This notice may not be removed or altered from any source distribution."""),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What the SQL twin cuts; the scan itself uses NOTICES, as this also takes lines of the wordings.
RIGHTS = r"(^|\n)[^a-z0-9\n]*(copyright|\(c\)|©|all rights reserved)[^\n]*"
#: Characters that are neither a letter, a digit nor a line end; all letters outside ASCII count as letters.
MARKS = r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F“”‘’–—«»]+"

# Files of whole licences in licence_texts and their SPDX names; also known without what follows their end.
FILES = (
    ("BSD-2-Clause", "BSD-2-Clause"), ("BSD-3-Clause", "BSD-3-Clause"), ("Apache-2.0", "Apache-2.0"), ("GPL-2.0-only", "GPL-2"),
    ("GPL-3.0-only", "GPL-3"), ("LGPL-2.1-only", "LGPL-2.1"), ("LGPL-3.0-only", "LGPL-3"), ("MPL-2.0", "MPL-2.0"),
    ("Unlicense", "Unlicense"), ("CC0-1.0", "CC0-1.0"),
)
END = "END OF TERMS AND CONDITIONS"
YEAR = r"(?:(?:19|20)[0-9]{2}|<year>|\[year\]|\[yyyy\]|\{yyyy\})"
SIGN = r"(?:\(c\)|©|&copy;)"
TERMS = (
    r"permission|permitted|hereby|granted|redistribut|provided|warrant|notice|liable|liability|license|everyone|conditions"
)
#: Lines that only say who holds the rights: with a sign or year anywhere, with a bare name where a paragraph begins.
NOTICES = (
    # Notices inside licences, which may stand in the middle of a line.
    (
        r"copyright[^a-z0-9]+c[^a-z0-9]+(?:1989[^a-z0-9]+1991|1991[^a-z0-9]+1999|2007)[^a-z0-9]+free[^a-z0-9]+software[^a-z0-9]+"
        r"foundation[^a-z0-9]+inc(?:[^a-z0-9]+http://fsf\.org)?|"
        r"copyright[^a-z0-9]+(?:c[^a-z0-9]+)?(?:year|yyyy)[^a-z0-9]+name[^a-z0-9]+of[^a-z0-9]+(?:author|copyright[^a-z0-9]+owner)",
        " ",
    ),
    (
        rf"(?md)^[^a-z0-9\n©(]*(?:(?:portions |parts )?copyright\b:?[ \t]*(?:by )?(?:{SIGN}|{YEAR})|{SIGN}[ \t]*{YEAR})"
        rf"(?![^\n]*(?:{TERMS}))[^\n]*$",
        "",
    ),
    (r"(?md)^[^a-z0-9\n]*all rights reserved[^a-z0-9\n]*$", ""),
    (
        r"(\A|\n[^a-z0-9\n]*\n|\A[^\n]{0,40}\blicense\b[^\n]{0,30}\n)"
        r"(?:[^a-z0-9\n]*copyright[ \t]+(?=[a-z])(?![^\n]*\b(?:"
        + TERMS + r"|holders?|owners?|laws?|interest|material|protection|statement|shall|must|means?|also|this|that|is|are|on|in|or"
        r"|to|any|not|under|resulting|be)\b)[^\n]*(?:\n|\z))+",
        "$1\n",
    ),
)
#: Headings of licences, canonical.
TITLES = (
    "the mit license mit", "the mit license", "mit license mit", "mit license", "mit license expat", "expat license",
    "isc license isc", "isc license", "the isc license", "bsd license", "the bsd license", "new bsd license", "the new bsd license",
    "modified bsd license", "revised bsd license", "simplified bsd license", "the simplified bsd license", "bsd 2 clause license",
    "the bsd 2 clause license", "the 2 clause bsd license", "bsd 2 clause simplified license", "bsd 3 clause license",
    "the bsd 3 clause license", "the 3 clause bsd license", "bsd 3 clause new or revised license", "bsd zero clause license",
    "bsd zero clause license 0bsd", "zero clause bsd license", "zero clause bsd", "0bsd", "zlib license", "the zlib license",
    "zlib libpng license", "the zlib libpng license", "apache license", "apache license version 2 0", "version 2 0 january 2004",
    "http www apache org licenses", "gnu general public license", "gnu lesser general public license", "version 2 june 1991",
    "version 3 29 june 2007", "version 2 1 february 1999", "mozilla public license version 2 0", "mozilla public license 2 0",
    "the unlicense", "unlicense", "creative commons legal code", "cc0 1 0 universal", "license",
)
#: How the texts begin, canonical: a notice may stand before that on the same line or over several.
STARTS = (
    "permission is hereby granted free of charge", "permission to use copy modify and or distribute this software",
    "redistribution and use in source and binary forms", "this software is provided as is without any express",
    "this is free and unencumbered software", "terms and conditions for use reproduction and distribution",
)
#: Applied in this order to the joined canonical lines.
FORMS = (
    (
        "^(?:(?:" + "|".join(sorted(TITLES, key=len, reverse=True)) + ") |(?:copyright c|copyright|c) (?:(?:19|20)[0-9]{2}|year|yyyy) "
        "[^\n]{1,100}?(?= (?:" + "|".join(STARTS) + ")) )+",
        "",
    ),
    ("(?<= )[123] (?=redistributions |neither the name of |the origin of this |altered source versions |this notice may not )", ""),
    (
        "neither the name of [^\n]{1,120}? nor the names of (?:its|their|the|any) contributors",
        "neither the name of the copyright holder nor the names of its contributors",
    ),
    (
        "this software is provided by [^\n]{1,160}? as is and any express",
        "this software is provided by the copyright holders and contributors as is and any express",
    ),
    (
        "in no event shall [^\n]{1,160}? be liable for any direct indirect incidental",
        "in no event shall the copyright holder or contributors be liable for any direct indirect incidental",
    ),
    (
        " (?:51 franklin st(?:reet)? fifth floor boston ma 02110 1301|59 temple place suite 330 boston ma 02111 1307) usa", "",
    ),
    ("(?<= )non commercial(?= )", "noncommercial"), ("(?<= )sub license(?= )", "sublicense"),
)


def wordings() -> list[tuple[str, str]]:
    """(SPDX name, text) of all known licences and notices."""
    out = list(KNOWN)
    for licence, name in FILES:
        text = (Path(__file__).parent / "licence_texts" / f"{name}.txt").read_text(encoding="utf-8")
        out.append((licence, text))
        if END in text:
            terms = text.split(END)[0]
            out += [(licence, terms), (licence, terms + END)]
    return out


def lines(text: Column) -> Column:
    """Canonical lines of a text: lower case, notices of rights gone, equal spellings, single spaces."""
    low = F.translate(text, UPPER, LOWER)
    spelt = reduce(lambda c, s: F.replace(c, F.lit(s[0]), F.lit(s[1])), SPELLINGS, low)
    cut = reduce(lambda c, s: F.regexp_replace(c, s[0], s[1]), NOTICES, spelt)
    bare = F.regexp_replace(cut, MARKS, " ")
    return F.transform(F.split(bare, "\n"), lambda x: F.trim(x))


def joined(canon: Column) -> Column:
    """One string of the canonical lines, so that line breaks, titles and the holder's name do not matter."""
    one = F.array_join(F.filter(canon, lambda x: x != ""), " ")
    return reduce(lambda c, s: F.regexp_replace(c, s[0], s[1]), FORMS, one)


def known(spark, texts=None) -> DataFrame:
    """(digest, licence) of the known wordings, canonical by the same expressions: as many rows as wordings."""
    rows = F.array(*[F.struct(F.lit(n).alias("licence"), F.lit(t).alias("text")) for n, t in texts or wordings()])
    return (
        spark.range(1).select(F.inline(rows))
        .select(F.sha2(joined(lines(F.col("text"))), 256).alias("digest"), "licence").distinct()
    )


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", texts=None) -> DataFrame:
    """Per document: ``key``, ``whole_licence`` (null, or whose text the document is), ``notices`` and ``n_notices``.

    The canonical form of the whole text and that of each line are looked up by
    digest; ``notices`` are the distinct licences of matching lines, sorted and
    joined by commas, ``n_notices`` counts the matching lines. Null counts as
    empty; an empty text has neither. Rows that share a key each keep their own
    result. The known digests are broadcast: they are the constants above, and ``licence_texts``.
    """
    table = F.broadcast(known(docs.sparkSession, texts).groupBy("digest").agg(F.min("licence").alias("licence")))
    canon = docs.select(F.col(key), F.monotonically_increasing_id().alias("row"), lines(whole(text)).alias("lines"))
    pieces = canon.select(
        key, "row",
        F.explode(
            F.concat(
                F.array(F.struct(F.lit(True).alias("full"), F.sha2(joined(F.col("lines")), 256).alias("digest"))),
                F.transform(
                    F.filter("lines", lambda x: x != ""), lambda x: F.struct(F.lit(False).alias("full"), F.sha2(x, 256).alias("digest"))
                ),
            )
        ).alias("p"),
    ).select(key, "row", "p.full", "p.digest")
    met = pieces.join(table, "digest", "left").where("full or licence is not null")
    return met.groupBy("row", key).agg(
        F.max(F.when(F.col("full"), F.col("licence"))).alias("whole_licence"),
        F.array_join(F.sort_array(F.collect_set(F.when(~F.col("full"), F.col("licence")))), ",").alias("notices"),
        F.count(F.when(~F.col("full"), F.lit(1))).alias("n_notices"),
    ).drop("row")


def _sql() -> str:
    spelt = f"translate(x, '{UPPER}', '{LOWER}')"
    for a, b in SPELLINGS:
        spelt = f"replace({spelt}, '{a}', '{b}')"
    bare = f"regexp_replace(regexp_replace({spelt}, '{RIGHTS}', chr(10), 'g'), '{MARKS}', ' ', 'g')"
    canon = f"list_transform(string_split({bare}, chr(10)), lambda y: trim(y))"
    values = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in KNOWN)
    return f"""
with k0(licence, x) as (values {values}),
k as (select sha256(array_to_string(list_filter({canon}, lambda y: y <> ''), ' ')) as digest, min(licence) as licence
      from k0 group by 1),
d as (select doc_id, list_filter({canon}, lambda y: y <> '') as lines from (select doc_id, coalesce(text, '') as x from documents)),
l as (select doc_id, count(*) as n_notices, string_agg(distinct licence, ',' order by licence) as notices
      from (select doc_id, unnest(lines) as line from d) join k on sha256(line) = digest group by doc_id)
select d.doc_id, k.licence as whole_licence, coalesce(l.notices, '') as notices, coalesce(l.n_notices, 0) as n_notices
from d left join k on sha256(array_to_string(d.lines, ' ')) = k.digest left join l on l.doc_id = d.doc_id
"""


SQL = _sql()
