"""License scans by canonical digest.

A text's canonical form drops copyright lines, capitals, punctuation and white
space, and writes equivalent spellings alike; spellings of two words are sought
after white space is one blank, so that where lines break doesn't matter. Its
SHA-256 digest is joined to those of known license texts: a whole text is looked
up, never a part of it. The lines of a text are looked up the same way, for the
short notices that documents carry; that happens in the row, against the fixed
list, as a join would move or repeat the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import fresh, let

# Spellings that count as one, in the canonical form, in this order.
SPELLINGS = (
    ("licence", "license"), ("sub license", "sublicense"), ("organisation", "organization"), ("authorisation", "authorization"), ("acknowledgement", "acknowledgment"),
    ("copyright owner", "copyright holder"), ("non infringement", "noninfringement"), ("per cent", "percent"), ("merchantibility", "merchantability"),
    ("favour", "favor"), ("honour", "honor"), ("https", "http"),
)
#: Lines that name a copyright holder: the word or sign before a year, another sign or a blank to fill. Body lines that only break
#: before the word copyright are none. Both engines read these expressions alike.
COPYRIGHT_LINE = r"(?im)^[ \t\x{A0}>*#/;-]*(copyright[ \t\x{A0}:]*(\(c\)|©|[0-9<\[{])|(\(c\)|©)[ \t\x{A0}]*(copyright|[0-9<\[{])|all rights reserved)[^\n]*$"
MARKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F\x{A0}\x{A9}\x{AB}\x{AD}\x{BB}\x{2000}-\x{206F}\x{3000}\x{FEFF}]+"

# Pieces of the texts below.
AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
BSD_START = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
BSD_1 = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
BSD_2 = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
ISC_END = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
MIT_BODY = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + AS_IS
# License id and text. Whole texts and the notices that stand for them.
KNOWN = (
    ("MIT", "MIT License\n\nCopyright (c) <year> <holder>\n\n" + MIT_BODY),
    ("MIT", "The MIT License (MIT)\n\nCopyright (c) <year> <holder>\n\n" + MIT_BODY),
    ("MIT", MIT_BODY),
    ("ISC", "ISC License\n\nCopyright (c) <year> <holder>\n\n" + ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies. " + ISC_END),
    ("ISC", ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies. " + ISC_END),
    ("0BSD", ISC_GRANT + ". " + ISC_END),
    ("BSD-2-Clause", " ".join((BSD_START, BSD_1, BSD_2, BSD_END))),
    ("BSD-2-Clause", "BSD 2-Clause License\n\nCopyright (c) <year>, <holder>\n\n" + " ".join((BSD_START, BSD_1, BSD_2, BSD_END))),
    ("BSD-3-Clause", " ".join((BSD_START, BSD_1, BSD_2, BSD_3, BSD_END))),
    ("BSD-3-Clause", "BSD 3-Clause License\n\nCopyright (c) <year>, <holder>\n\n" + " ".join((BSD_START, BSD_1, BSD_2, BSD_3, BSD_END))),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
)
# License id and digest of the canonical form of its whole text, as Debian has it in /usr/share/common-licenses (BSD: that of the University of California).
# The text of a GNU license does not say whether later versions may be chosen: all have the ids of this version only.
WHOLE = (
    ("Apache-2.0", "04e64e0427d80fdde16fa8415931bf2c09bc943f13ec322a09df188bf23a3543"),
    ("Artistic-1.0-Perl", "e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2"),
    ("BSD-3-Clause", "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651"),
    ("CC0-1.0", "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e"),
    ("GFDL-1.2-only", "15f6a8d360ffdecc988c29279c00f23e20de17f14f2a06572ab0d41de6e98b7b"),
    ("GFDL-1.3-only", "2d36daeff2ad303badb6dee8149748be25e22974dd468e1e8a55cf40f16fc01d"),
    ("GPL-1.0-only", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-2.0-only", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-3.0-only", "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a"),
    ("LGPL-2.0-only", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.1-only", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-3.0-only", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "a1b36de49a400e3d3385d5987188db954a084f9876243aa7207cd91de3f24a7b"),
    ("MPL-2.0", "6fedd8db6adb0e102fc0f69b9e1501d2edaf25940e34910831cab46f9f5d4e4d"),
)


def bare(text: Column) -> Column:
    """A text without copyright lines, in lower case, a blank for each run of marks inside a line; line breaks stay."""
    return F.regexp_replace(F.lower(F.regexp_replace(text, COPYRIGHT_LINE, "")), MARKS.replace("\\x2F", "\\x09\\x0B-\\x2F", 1), " ")


def spelled(bare_text: Column) -> Column:
    """Equivalent spellings alike. None of them reaches over a line break."""
    for one, other in SPELLINGS:
        bare_text = F.replace(bare_text, F.lit(one), F.lit(other))
    return bare_text


def joined(bare_text: Column) -> Column:
    """The canonical form of a whole text, from its bare form."""
    return spelled(F.trim(F.regexp_replace(bare_text, "[ \n]+", " ")))


def digest(text: Column) -> Column:
    """SHA-256 of the canonical form of a text; null stays null."""
    return F.sha2(joined(bare(text)), 256)


def known_digests(spark: SparkSession, known=KNOWN, whole=WHOLE) -> DataFrame:
    """digest, license: one row for each digest; as long as ``known`` and ``whole``."""
    table = spark.createDataFrame(list(known), "license string, text string").select(digest(F.col("text")).alias("digest"), "license")
    return table.unionByName(spark.createDataFrame(list(whole), "license string, digest string")).dropDuplicates(["digest"])


def scan(documents: DataFrame, text: str = "text", known=KNOWN) -> DataFrame:
    """``documents`` with digest, license and notices.

    digest: of the canonical text (null and empty texts: that of the empty
    string); license: of the known text with this digest, else null; notices:
    sorted ids, each once, of known texts that are a line of the document.
    Columns of these names are replaced; no rows give no rows; rows that repeat
    get the same.
    """
    spark = documents.sparkSession
    table = known_digests(spark, known)
    pairs = [(r.digest, r.license) for r in table.collect()]  # the fixed list above
    digests, ids = F.array(*[F.lit(d) for d, _ in pairs]), F.create_map(*[F.lit(x) for pair in pairs for x in pair])

    def looked_up(b: Column) -> Column:
        lines = F.transform(F.split(spelled(b), "\n"), lambda line: F.sha2(F.trim(line), 256))
        notices = F.transform(F.array_intersect(lines, digests), lambda d: F.element_at(ids, d))
        return F.struct(F.sha2(joined(b), 256).alias("digest"), F.array_sort(F.array_distinct(notices)).alias("notices"))

    d = documents.drop("digest", "license", "notices")
    both = fresh(d, "_found")
    d = d.withColumn(both, let(bare(F.coalesce(F.col(text), F.lit(""))), looked_up))
    d = d.withColumns({"digest": F.col(both)["digest"], "notices": F.col(both)["notices"]}).drop(both)
    return d.join(F.broadcast(table), "digest", "left").select(*[F.col(f"`{c}`") for c in d.columns if c not in ("digest", "notices")], "digest", "license", "notices")


def oracle(known=KNOWN, whole=WHOLE) -> str:
    """The same in the other engine's SQL over ``documents``."""
    def form(x: str) -> str:
        out = f"trim(regexp_replace(lower(regexp_replace({x}, '{COPYRIGHT_LINE}', '', 'g')), '{MARKS}', ' ', 'g'))"
        for one, other in SPELLINGS:
            out = f"replace({out}, '{one}', '{other}')"
        return f"sha256({out})"

    values = ", ".join("('{}', '{}')".format(i, t.replace("'", "''")) for i, t in known)
    digests = ", ".join(f"('{i}', '{d}')" for i, d in whole)
    return f"""
        WITH known AS (SELECT license, {form('text')} AS digest FROM (VALUES {values}) v(license, text) UNION SELECT license, digest FROM (VALUES {digests}) w(license, digest)),
        d AS (SELECT doc_id, coalesce(text, '') AS t, {form("coalesce(text, '')")} AS digest FROM documents),
        lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
        found AS (SELECT doc_id, list_sort(list_distinct(list(license))) AS notices
                  FROM (SELECT doc_id, {form('line')} AS digest FROM lines) l JOIN known USING (digest) GROUP BY doc_id)
        SELECT doc_id, digest, license, coalesce(array_to_string(notices, ','), '') AS notices
        FROM d LEFT JOIN known USING (digest) LEFT JOIN found USING (doc_id)"""
