"""License scans by canonical digest lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Equivalent spellings, replaced wherever they occur in the lower-cased text.
SPELLINGS = (("licence", "license"), ("licencing", "licensing"), ("authoris", "authoriz"), ("organis", "organiz"), ("favour", "favor"),
             ("non-commercial", "noncommercial"), ("sub-licens", "sublicens"), ("https://", "http://"), ("&", " and "),
             ("copyright holder", "copyright owner"), ("fulfil ", "fulfill "), ("merchantibility", "merchantability"), ("while ", "whilst "))

_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted{}.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
{}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so{}:
"""

_APACHE = "http://www.apache.org" + "/licenses/LICENSE-2.0"

_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n"
_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"


def _titled(license_id: str, body: str, *titles: str) -> tuple[tuple[str, str], ...]:
    """A text without a title and under each of its usual ones."""
    return ((license_id, body), *((license_id, f"{t}\n{body}") for t in titles))


#: (licence, wording): the texts that are known in full and the usual one-line notices. A caller can pass more.
KNOWN: tuple[tuple[str, str], ...] = (
    *_titled("MIT", _MIT.format(", subject to the following conditions") + _NOTICE + _WARRANTY, "MIT License", "The MIT License", "The MIT License (MIT)", "Expat License"),
    *_titled("MIT-0", _MIT.format("") + _WARRANTY, "MIT No Attribution", "MIT No Attribution License", "MIT-0 License"),
    *_titled("ISC", _ISC.format(", provided that the above copyright notice and this permission notice appear in all copies"), "ISC License", "The ISC License", "ISC License (ISC)"),
    *_titled("0BSD", _ISC.format(""), "BSD Zero Clause License", "Zero-Clause BSD", "BSD Zero Clause License (0BSD)"),
    *_titled("BSD-2-Clause", _BSD.format(""), "BSD 2-Clause License", "The BSD 2-Clause License", "Simplified BSD License"),
    *_titled("BSD-3-Clause", _BSD.format("3. " + _NAMES), "BSD 3-Clause License", "The BSD 3-Clause License", "BSD License", "New BSD License"),
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."), ("MIT", "This project is licensed under the MIT License."), ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "Released under the Apache License, Version 2.0."), ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at ' + _APACHE + ' Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("GPL-3.0", "Licensed under the GNU General Public License, version 3."), ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."), ("GPL-2.0", "Licensed under the GNU General Public License, version 2."), ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."), ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC0-1.0", "Licensed under CC0 1.0."), ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."), ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."), ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
)
#: (licence, digest, length) of canonical texts that are too long to stand here: the whole licences as they are published,
#: and the parts that are often given alone (without the appendix on how to apply them).
LONG: tuple[tuple[str, str, int], ...] = (
    ("Apache-2.0", "7fa44a938f88545a14afe2f454ba8f878375d669a8b502076e6da59046e1006a", 8839),
    ("Apache-2.0", "ad43d8eef0ef003ab5b95192337af3cec3e9d56fceaf1701f54ebb7cc864a09c", 8867),
    ("Apache-2.0", "0b1eea27b827a454c7c3f5802b45d07b0581f19da2077765adea6e925113761e", 9922),
    ("Artistic-1.0-Perl", "b9039fa3e3abf261842ba3d22a27f89bc70885b5993065f1cb471cab489a730b", 5824),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f", 6692),
    ("GFDL-1.2", "ec59f60205d80eca4ff913aba62e9edf1abbfcdb04aadb92d31796f795b566fc", 18385),
    ("GFDL-1.2", "3a1205cbbc6ec235f5102e529da718c39760affd513721da8c4c4dcd7e9e300c", 19582),
    ("GFDL-1.3", "a71c842f2bec1b0e2b757a928b3ecad678e8ef4b13dcf65ce14ad752ec06f8d4", 20814),
    ("GFDL-1.3", "c9dbf03023bbdaa396068f70c178d2f2bb6e423a636d445b883cca4e8e5efe79", 22011),
    ("GPL-1.0", "4575f8cf583cfe5694de121df7d28ae3c2043234ee2357a6bc38c20fc1856cf0", 9384),
    ("GPL-1.0", "3b5b36de4a3801680b9eb44e80739b3aeb71c4bf6ca623ee5f87b2e2b03d3ed9", 9412),
    ("GPL-1.0", "37f380f152339f34a15db620545eb53f0b5c7d9e6a9542aa09ed0d22f186920f", 11762),
    ("GPL-2.0", "611467176757b44c5c63b6b18b9b61a9e3d7bd13d738d6dde1cdce99fb1f12ef", 14451),
    ("GPL-2.0", "a76cc6ce70778ba70e43b9b1838f9e3f88b3fc7c5acbb3b8a9847918003b63e0", 14479),
    ("GPL-2.0", "ae2be2aaa68f5e52ef402874fc8c7c691879b445cb12e49d84f88168cc2d7dd6", 17113),
    ("GPL-3.0", "53a654ec022bebac4b8c6908b7a8d7e2b63dd0b041d77833e8af6b3913048c9b", 30931),
    ("GPL-3.0", "158302bba42ffffd9ebd468b95aca480c990d662430ac44bb2edba378ebeb545", 30959),
    ("GPL-3.0", "42b67f6c2a10d2b6cb4c48a2c1a454953ad6d664174e0493c9d92e45feb4b408", 33397),
    ("LGPL-2.0", "8452fc957588900d86086f4e9b3196ba26f9109ca6609068a6a7475a4d433466", 22246),
    ("LGPL-2.0", "373c965bb5307988475b214dae67fc0c7c359cf68a9035c88cd28017504d337e", 22274),
    ("LGPL-2.0", "47d35625593b7f227a8eb6503754157e4458d4af0d06e383536d673cfc69e5ec", 24127),
    ("LGPL-2.1", "9c2c2afdce244f7835e438f43966f864ce47d82ebd6316bbcb123927f3280e30", 23333),
    ("LGPL-2.1", "65484d3c9f900f96945bd4e6c5397aaa24f93bdc8f720eae06fbd377c62cfe97", 23361),
    ("LGPL-2.1", "ed875dac9045cba09a17867210991f3a4a82f80b82096b054560a3a8dae9d692", 25213),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be", 7104),
    ("MPL-1.1", "80cd52a1836f5ea3706bd2afa402fc448999d4a22581ee62d4041bd8a08efd87", 21012),
    ("MPL-1.1", "cbbde7eeab9b4d180dc00b34252f800e97fb1cddbab38ed8c0c73b956dc2cbf6", 22447),
    ("MPL-2.0", "075fcdf87448c49dbad8c5f7963f0eb6907a3d8eae1b431ba2988508499ec0de", 13661),
    ("MPL-2.0", "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a", 14341),
)
#: Lines that are a copyright notice: with a year or a sign, in lower case; or no more than a name, in the case it has.
_COPYRIGHT = r"(?m)^[^\p{L}\p{N}\n]*(copyright|©|\(c\))[^\n]*([0-9]{4}|©|\(c\))[^\n]*$"
_NAMED = r"(?m)^[^\p{L}\p{N}\n]*(?:Copyright|COPYRIGHT)(?: by)?(?: [A-Z][\p{L}.'-]*| &| and| of| the){1,8},?[ \t]*$"
_RESERVED = r"(?m)^[^\p{L}\p{N}\n]*all rights reserved[^\p{L}\p{N}\n]*$"


def canonical_lines(text: Column) -> Column:
    """The canonical text, lines kept apart: lower case, equivalent spellings made one, lines that are a copyright
    notice or reserve all rights blank, and all but letters and digits a single space."""
    named = F.when(F.contains(text, F.lit("opyright")) | F.contains(text, F.lit("OPYRIGHT")), F.regexp_replace(text, _NAMED, "")).otherwise(text)
    t = F.regexp_replace(F.lower(named), _COPYRIGHT, "")
    t = F.when(F.contains(t, F.lit("all rights reserved")), F.regexp_replace(t, _RESERVED, "")).otherwise(t)
    for old, new in SPELLINGS:
        t = F.replace(t, F.lit(old), F.lit(new))
    return F.regexp_replace(t, r"[^\p{L}\p{N}\n]+", " ")


def whole(lines: Column) -> Column:
    return F.trim(F.regexp_replace(lines, r"[ \n]+", " "))


def known_digests(spark, known=KNOWN, long=LONG) -> DataFrame:
    """Rows (digest, size, license_id), one for each canonical wording. Of two licences with one wording the lesser counts."""
    rows = spark.createDataFrame([(a, b) for a, b in known], "license_id string, wording string")
    canonical = rows.select("license_id", whole(canonical_lines(F.col("wording"))).alias("u"))
    digests = canonical.select(F.sha2("u", 256).alias("digest"), F.length("u").alias("size"), "license_id")
    digests = digests.unionByName(spark.createDataFrame([(d, n, a) for a, d, n in long], "digest string, size int, license_id string"))
    return digests.groupBy("digest", "size").agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, known=KNOWN, long=LONG) -> DataFrame:
    """Rows (doc_id, scope, license_id, n): documents whose entire text is a known licence text (scope text), and
    how many of their lines are, each taken as an entire text (scope line).

    Texts are made canonical and looked up by SHA-256 in the digests of the known texts, which the driver holds
    (they don't grow with the data). Only texts and lines as long as some known text are hashed, which loses none.
    ``known`` are wordings, ``long`` digests of canonical texts. Cases: null and empty texts match nothing (unless "" is
    listed); a very long text is made canonical and compared whole; a null doc_id is reported as null; every repeated row
    gives its own rows; a one-line document gives both scopes; of licences with one wording (a tie) the least name counts;
    columns other than doc_id and text are not read, so their names can't clash; an empty table gives none.
    """
    spark = docs.sparkSession
    digests = known_digests(spark, known, long)
    sizes = F.array(*[F.lit(int(r["size"])) for r in digests.select("size").distinct().collect()])  # of the list, not of the data
    units = docs.filter("text IS NOT NULL").select("doc_id", canonical_lines(F.col("text")).alias("t"), F.monotonically_increasing_id().alias("row"))
    lines = F.filter(F.transform(F.split("t", "\n", -1), lambda x: F.trim(x)), lambda x: F.array_contains(sizes, F.length(x)))
    found = F.concat(
        F.array(F.struct(F.lit("text").alias("scope"), whole(F.col("t")).alias("u"))),
        F.transform(lines, lambda x: F.struct(F.lit("line").alias("scope"), x.alias("u"))),
    )
    found = units.select("doc_id", "row", F.explode(found).alias("f")).filter(F.array_contains(sizes, F.length("f.u")))
    hashed = found.select("doc_id", "row", "f.scope", F.sha2("f.u", 256).alias("digest"))
    hits = hashed.join(digests.select("digest", "license_id"), "digest")
    return hits.groupBy("row", "doc_id", "scope", "license_id").agg(F.count("*").alias("n")).drop("row")


def query(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def _sql_canonical(x: str) -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    x = f"lower(regexp_replace({x}, {q(_NAMED)}, '', 'g'))"
    x = f"regexp_replace(regexp_replace({x}, {q(_COPYRIGHT)}, '', 'g'), {q(_RESERVED)}, '', 'g')"
    for old, new in SPELLINGS:
        x = f"replace({x}, {q(old)}, {q(new)})"
    return f"regexp_replace({x}, {q(r'[^\p{L}\p{N}\n]+')}, ' ', 'g')"


def sql(known=KNOWN, long=LONG) -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({q(a)}, {q(b)})" for a, b in known)
    digests = ", ".join(f"({q(a)}, {q(d)})" for a, d, _ in long)
    return f"""
WITH w AS (SELECT license_id, sha256(trim(regexp_replace({_sql_canonical('wording')}, '[ \\n]+', ' ', 'g'))) AS digest FROM (VALUES {values}) v(license_id, wording)
           UNION ALL SELECT * FROM (VALUES {digests}) v(license_id, digest)),
k AS (SELECT digest, min(license_id) AS license_id FROM w GROUP BY digest),
d AS (SELECT doc_id, row_number() OVER () AS r, {_sql_canonical('text')} AS t FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, r, 'text' AS scope, trim(regexp_replace(t, '[ \\n]+', ' ', 'g')) AS u FROM d
      UNION ALL SELECT doc_id, r, 'line', trim(unnest(string_split(t, chr(10)))) FROM d)
SELECT doc_id, scope, license_id, count(*) AS n FROM u JOIN k ON sha256(u) = digest GROUP BY r, doc_id, scope, license_id
"""
