"""Licence scan by canonical digests of entire texts.

A document, and each of its lines, is normalised (case, punctuation, copyright
lines, equivalent spellings) and its digest looked up among those of known
licences and notices. Only entire texts match; nothing is searched inside them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grovemap.llm.common import cut, spread, table

#: Spellings that count as one, the second taken; replaced in this order in lower-case text.
EQUIVALENT = [
    ("https://", "http://"), ("©", "(c)"), ("licence", "license"), ("sub-license", "sublicense"), ("sub license", "sublicense"), ("non-commercial", "noncommercial"), ("copyright owner", "copyright holder"), ("organis", "organiz"), ("favour", "favor"),
    ("judgement", "judgment"), ("wilful", "willful"), ("fulfilment", "fulfillment"), ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("behaviour", "behavior"), ("whilst", "while"), ("per cent", "percent"), ("&", " and "),
]
_OTHER = r"[^\p{L}\p{N}\n]+"
_COPYRIGHT = r"(?m)^[ \t#*/;.-]*(copyright|\(c\))[ \t]+(\(c\)[ \t]*)?[0-9][^\n]*$|^[ \t#*/;.-]*all rights reserved[. \t]*$"
#: Also lines of a holder without a year, or with the year after the name.
_HOLDER = _COPYRIGHT + r"|^[ \t#*/;.-]*copyright[ \t]*\(c\)[^\n]*$|^[ \t#*/;.-]*copyright[ \t]+(?!notice|holder)[^\n]{1,120}?[ \t,]+(19|20)[0-9]{2}([ \t,-]+((19|20)?[0-9]{2}|present))*[ \t.,;]*(all rights reserved[ \t.]*)?$"
#: In texts that don't number their clauses by letters, lines that begin with the sign alone.
_SIGN = _HOLDER + r"|^[ \t#*/;.-]*\(c\)[ \t]+[^\n]*$"

_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n"
_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_ISC = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n"
_BSD3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n"
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."

#: Known texts: (licence, text). A scan can be given others.
KNOWN = [
    ("MIT", "MIT License\n\n" + _GRANT + _AS_IS), ("MIT", _GRANT + _AS_IS),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n" + _ISC),
    ("BSD-2-Clause", _BSD + _BSD_END), ("BSD-3-Clause", _BSD + _BSD3 + _BSD_END),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."), ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."), ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."), ("LGPL-3.0-only", "This work is licensed under the GNU Lesser General Public License, version 3."), ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    *[(f"CC-{kind}-4.0", f"Licensed under CC {kind} 4.0.") for kind in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND")],
    ("CC0-1.0", "Licensed under CC0 1.0."),
]

#: Digests of canonical texts too long to stand here: of each the published text, and where that has an appendix on its use, the text up to its last clause's end line.
DIGESTS = [
    ("Apache-2.0", "d03e86ac7a1ff3f8d928e1d6027bfd17"), ("Apache-2.0", "2f973fce6821968caa77d834b80cee7c"), ("Artistic-1.0-Perl", "01297679267ad921516667ccd889865e"), ("CC0-1.0", "93a180096f6cfcf2c0dd24f75c2eec48"), ("GFDL-1.2-only", "49ffacd2fea52c0c124f0d16bc990c74"), ("GFDL-1.3-only", "2d7ce083c264cf7f093acc742260e501"),
    ("GPL-1.0-only", "738cc3b112640d95d4cd79a58967ecea"), ("GPL-1.0-only", "dbf3c47f5a8f127e58d08cabc1ebb916"), ("GPL-2.0-only", "5e39ace6e62f5a7fe9c17b4da986ad8c"), ("GPL-2.0-only", "68380dbeadb093b94ecf563db7312db7"), ("GPL-3.0-only", "b79359b5e391fd47146ff34ae3db7ec0"), ("GPL-3.0-only", "444f95dc767ede978b60cfb20fbd0bca"),
    ("LGPL-2.0-only", "74cf7fcef3b29a39165a795b2cad3a3a"), ("LGPL-2.0-only", "c396ba2f94537628797123bc12cd2d6e"), ("LGPL-2.1-only", "f998bc436710cfece156aaa84fd26dd4"), ("LGPL-2.1-only", "3054b3781b1af43f906dc753acad15ee"), ("LGPL-3.0-only", "b31b7335bc37919e8cdd79154e04d88d"), ("MPL-1.1", "9fa8ae3e869a929215034d82982372b5"), ("MPL-2.0", "7d4b8b0889da3c01eff3fe431102e6d6"),
]


def canonical(text: Column) -> Column:
    """Normalised text, its lines kept. Null stays null."""
    t = F.lower(text)
    for old, new in EQUIVALENT:
        t = F.replace(t, F.lit(old), F.lit(new))
    t = F.when(t.contains("(a)") | t.contains("(b)"), F.regexp_replace(t, _HOLDER, "")).otherwise(F.regexp_replace(t, _SIGN, ""))
    return F.regexp_replace(t, _OTHER, " ")


def _flat(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "[ \n]+", " "))


def known_digests(spark: SparkSession, known: list[tuple[str, str]] = KNOWN, digests: list[tuple[str, str]] = DIGESTS) -> DataFrame:
    """(_gm_known, licence), one row for each digest of known (licence, text) or digests (licence, digest): of licences that share one the first by name."""
    texts = spark.createDataFrame(known, "licence string, text string").select("licence", F.md5(_flat(canonical(F.col("text")))).alias("_gm_known"))
    rows = texts.unionByName(spark.createDataFrame(digests, "licence string, _gm_known string")) if digests else texts
    # written out, its size is known to the planner
    return cut(rows.groupBy("_gm_known").agg(F.min("licence").alias("licence")), "licences")


def scan(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, licence, notices): the digest of the entire canonical text, the licence that has it, and the sorted names, comma-separated, of licences with a text that is an entire line.

    licence is null and notices empty where nothing matches. A null text has
    a null digest; texts that are empty once normalised have the digest of the
    empty text, which is no licence's. Texts of any length are read to their
    end. A null id is passed on. Rows of one id with one canonical text give
    one row; an empty table gives none; other columns are ignored. known: known_digests() or a table
    like it, which Spark broadcasts only if it finds it small.

    Units that match nothing are dropped right after the join, so that about
    one narrow row for each document is shuffled.
    """
    base = spread(docs.select(id_col, text_col)).select(F.col(id_col).alias("doc_id"), canonical(F.col(text_col).cast("string")).alias("_gm_text"))
    whole = F.struct(F.lit(True).alias("whole"), F.md5(_flat(F.col("_gm_text"))).alias("digest"))
    lines = F.transform(F.split("_gm_text", "\n"), lambda x: F.struct(F.lit(False).alias("whole"), F.md5(F.trim(x)).alias("digest")))
    units = base.select("doc_id", F.md5("_gm_text").alias("_gm_key"), F.explode(F.concat(F.array(whole), F.coalesce(lines, F.array().cast("array<struct<whole:boolean,digest:string>>")))).alias("u")).select("doc_id", "_gm_key", "u.*")
    found = units.join(known, units["digest"] == known["_gm_known"], "left").filter("whole OR licence IS NOT NULL")
    named = F.array_join(F.array_sort(F.collect_set(F.when(~F.col("whole"), F.col("licence")))), ",")
    return found.groupBy("doc_id", "_gm_key").agg(F.max(F.when(F.col("whole"), F.col("digest"))).alias("digest"), F.max(F.when(F.col("whole"), F.col("licence"))).alias("licence"), named.alias("notices")).drop("_gm_key")


def op3_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), known_digests(spark))


def licence_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scan of the documents together with the known texts, each in upper case below a copyright line and with commas for full stops, and once with a word too many."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    dressed = [(-2 * k - 1, "Copyright (c) 2019 Some Holder\n\n" + text.upper().replace(".", " ,")) for k, (_, text) in enumerate(KNOWN)] + [(-2 * k - 2, text + " more") for k, (_, text) in enumerate(KNOWN)]
    return scan(docs.unionByName(spark.createDataFrame(dressed, "doc_id long, text string")), known_digests(spark))


def _sql(more: bool = False) -> str:
    def norm(x: str) -> str:
        t = f"lower({x})"
        for old, new in EQUIVALENT:
            t = f"replace({t}, '{old}', '{new}')"
        return f"regexp_replace(regexp_replace({t}, '{_COPYRIGHT}', '', 'g'), '{_OTHER}', ' ', 'g')"

    flat = r"md5(trim(regexp_replace({}, '[ \n]+', ' ', 'g')))"
    quoted = ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in KNOWN)
    digests = ", ".join(f"('{a}', '{b}')" for a, b in DIGESTS)
    docs = "documents"
    if more:
        # the same texts as in licence_texts(), made by SQL
        docs = f"(SELECT doc_id, text FROM documents UNION ALL SELECT -2 * k - 1, 'Copyright (c) 2019 Some Holder' || chr(10) || chr(10) || replace(upper(t), '.', ' ,') FROM v UNION ALL SELECT -2 * k - 2, t || ' more' FROM v)"
    return f"""
WITH v AS (SELECT row_number() OVER () - 1 AS k, licence, t FROM (VALUES {quoted}) AS q(licence, t)),
k AS (SELECT known, min(licence) AS licence FROM (SELECT licence, {flat.format(norm("t"))} AS known FROM v UNION ALL SELECT * FROM (VALUES {digests}) AS d(licence, known)) GROUP BY known),
b AS (SELECT doc_id, {norm("text")} AS t FROM {docs}),
l AS (SELECT b.doc_id, b.t, k.licence FROM (SELECT doc_id, t, unnest(string_split(t, chr(10))) AS line FROM b) AS b JOIN k ON md5(trim(line)) = k.known),
n AS (SELECT doc_id, t, string_agg(DISTINCT licence, ',' ORDER BY licence) AS notices FROM l GROUP BY doc_id, t)
SELECT DISTINCT b.doc_id, {flat.format("b.t")} AS digest, k.licence AS licence, coalesce(n.notices, '') AS notices
FROM b LEFT JOIN k ON {flat.format("b.t")} = k.known LEFT JOIN n ON n.doc_id = b.doc_id AND n.t = b.t
"""


SQL, TEXTS_SQL = _sql(), _sql(True)
