"""License scan by canonical digests, in DataFrame functions alone.

A text is brought to a canonical form: lower case, copyright lines dropped, equivalent spellings made one, everything
but letters and digits one blank. The digest of the whole canonical text is looked up in the known digests; the lines
are looked up as license notices likewise.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import literal_table

# Public license texts, notices and spellings that count as one.
GRANT_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
    '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
    "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
)
NO_WARRANTY_MIT = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR "
    "ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH "
    "THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
NO_WARRANTY_ISC = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY "
    "DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
    "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
BSD_CLAUSES = (
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
NO_WARRANTY_BSD = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
LICENSES = {
    "MIT": f"{GRANT_MIT}, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n{NO_WARRANTY_MIT}",
    "MIT-titled": f"MIT License\n\n{GRANT_MIT}, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n{NO_WARRANTY_MIT}",
    "MIT-0": f"{GRANT_MIT}.\n\n{NO_WARRANTY_MIT}",
    "ISC": f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n{NO_WARRANTY_ISC}",
    "0BSD": f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n{NO_WARRANTY_ISC}",
    "BSD-2-Clause": f"{BSD_HEAD}\n\n{BSD_CLAUSES}\n\n{NO_WARRANTY_BSD}",
    "BSD-3-Clause": f"{BSD_HEAD}\n\n{BSD_CLAUSES}\n\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n{NO_WARRANTY_BSD}",
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\n"
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n"
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n"
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution."
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\n"
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. "
        "We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\n"
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
        "IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n\n"
        "For more information, please refer to <https://unlicense.org>"
    ),
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "MIT-notice": "Released under the MIT License.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
}
# Digests of the canonical forms of longer license texts as they are published.
DIGESTS: dict[str, str] = {
    "Apache-2.0": "659793c54e845dca2d231f525b1cb8233c5fc11ddfdc705b4407738584c2c5b2",
    "Artistic-1.0": "bc4d0c00d493021b9f3b1041689fa28b4bf980cf2e37601f7cb475a7265e3b93",
    "CC0-1.0": "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f",
    "GFDL-1.2": "b6270c129be9b0e0172ebf4f39b974d927f155b0569e6689a4fd15068977ecdd",
    "GFDL-1.3": "7a546845f0b9175c013adbd275ab046668c2cd62fa85809f866f6d3218d6adcd",
    "GPL-1.0": "11036dd613edaa380c98ffe46366a586ca973ce05d95faba2c23eaa2211b9175",
    "GPL-2.0": "69047ab7ef628a14d40a12cf6bb52e8f2c3a2a939a614dee1f026454553102da",
    "GPL-3.0": "85caff7ee1273a337e75a904a25954b83d865359ce9dd57ffceecdc4cd332ef6",
    "LGPL-2.0": "4b2bdf375b2a2d21a6940d69e474f04a99fb0c477bc425d2a16561242cf418da",
    "LGPL-2.1": "6ec15f92a398046c38e4b69c273de66c051dbdd42c86ebc67de87585dcd45a23",
    "LGPL-3.0": "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",
    "MPL-1.1": "a1b36de49a400e3d3385d5987188db954a084f9876243aa7207cd91de3f24a7b",
    "MPL-2.0": "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a",
}
SPELLINGS = {
    "licence": "license",
    "licensor": "licenser",
    "sub-license": "sublicense",
    "non-infringement": "noninfringement",
    "non-commercial": "noncommercial",
    "copyright holder": "copyright owner",
    "organisation": "organization",
    "merchantibility": "merchantability",
    "whilst": "while",
    "per cent": "percent",
    "https://": "http://",
    "&": " and ",
}
COPYRIGHT_LINE = r"(?m)^[ \t#*/;%-]*(copyright[ \t]*(\(c\)|©|[0-9]{4}|by )|©|\(c\)[ \t]*[0-9]{4}|all rights reserved)[^\n]*$"


def canonical_lines(text: Column) -> Column:
    """The canonical form, with line ends kept."""
    out = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, "")
    for spelling, one in SPELLINGS.items():
        out = F.replace(out, F.lit(spelling), F.lit(one))
    return F.regexp_replace(out, r"[^\p{L}\p{N}\n]+", " ")


def joined(lines: Column) -> Column:
    """Canonical lines as one line."""
    return F.trim(F.regexp_replace(lines, r"[ \n]+", " "))


def known(spark, texts: dict[str, str]) -> DataFrame:
    """(license_id, known_digest, notice) of known texts, by the same functions as those of the scanned texts; notice is the canonical text."""
    table = literal_table(spark, [{"license_id": k, "body": v} for k, v in texts.items()], "license_id string, body string")
    form = joined(canonical_lines(F.col("body")))
    return table.select("license_id", F.sha2(form.cast("binary"), 256).alias("known_digest"), form.alias("notice"))


def scan(docs: DataFrame, texts: dict[str, str] = LICENSES, digests: dict[str, str] = DIGESTS) -> DataFrame:
    """(doc_id, digest, license_id, notices) of every row of docs.

    digest: SHA-256 of the canonical whole text; null for a null text. license_id: the known license (of texts, or by its
    digest alone of digests) whose digest it is, or null; an empty canonical text has none. notices: ids of the texts
    that fill a line of their own, sorted, joined by commas; null if none. Repeated rows are repeated; extra columns are
    ignored; an empty table gives one. Known texts with equal canonical forms under two ids are an error.
    """
    spark = docs.sparkSession
    forms = docs.select("doc_id", canonical_lines(F.col("text")).alias("lines"))
    rows = known(spark, texts).where("notice != ''").collect()  # as many as texts
    digest_of = {r["license_id"]: r["known_digest"] for r in rows} | digests
    if len(set(digest_of.values())) < len(digest_of):
        raise ValueError("two known licenses have one canonical form")
    by_notice = F.from_json(F.lit(json.dumps({r["notice"]: r["license_id"] for r in rows})), "map<string,string>")
    ids = F.transform(F.array_intersect(F.transform(F.split("lines", "\n"), lambda x: F.trim(x)), F.map_keys(by_notice)), lambda x: by_notice[x])
    scanned = forms.select(
        "doc_id",
        F.sha2(joined(F.col("lines")).cast("binary"), 256).alias("digest"),
        F.nullif(F.array_join(F.array_sort(ids), ","), F.lit("")).alias("notices"),
    )
    table = literal_table(spark, [{"license_id": k, "known_digest": v} for k, v in digest_of.items()], "license_id string, known_digest string")
    return scanned.join(F.broadcast(table), F.col("digest") == F.col("known_digest"), "left").select("doc_id", "digest", "license_id", "notices")


def scan_sql(texts: dict[str, str] = LICENSES, digests: dict[str, str] = DIGESTS) -> str:
    """The same in DuckDB's SQL."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"

    def form(column: str) -> str:
        out = f"regexp_replace(lower({column}), {quote(COPYRIGHT_LINE)}, '', 'g')"
        for spelling, one in SPELLINGS.items():
            out = f"replace({out}, {quote(spelling)}, {quote(one)})"
        return f"regexp_replace({out}, '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g')"

    one_line = lambda x: f"trim(regexp_replace({x}, '[ \\n]+', ' ', 'g'), ' ')"
    rows = ", ".join(f"({quote(k)}, {quote(v)})" for k, v in texts.items())
    more = "".join(f" UNION ALL SELECT {quote(k)}, {quote(v)}" for k, v in digests.items())
    return f"""
WITH known AS (SELECT license_id, {one_line(form("body"))} AS notice FROM (VALUES {rows}) AS t(license_id, body)),
forms AS (SELECT doc_id, {form("text")} AS lines FROM documents),
lined AS (SELECT doc_id, {one_line("lines")} AS whole, list_distinct(list_transform(string_split(lines, chr(10)), lambda x: trim(x, ' '))) AS each_line FROM forms),
noted AS (SELECT l.doc_id, l.whole, (SELECT string_agg(k.license_id, ',' ORDER BY k.license_id) FROM known k WHERE list_contains(l.each_line, k.notice)) AS notices FROM lined l)
SELECT n.doc_id, sha256(n.whole) AS digest, k.license_id, n.notices FROM noted n
LEFT JOIN (SELECT license_id, sha256(notice) AS digest FROM known WHERE notice <> ''{more}) k ON k.digest = sha256(n.whole)
"""
