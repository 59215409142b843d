"""Licence scans: digests of canonical texts, looked up among the digests of known licences. DataFrame functions only.

Canonical form: lower case; copyright lines and the publisher's postal address gone; equivalent spellings replaced;
everything but letters and digits one pair of blanks. A text is a licence when its canonical text as a whole has a known digest;
single lines are looked up likewise, which finds licence notices inside longer texts.

Short licences are listed with their texts, long ones with the digests of their canonical texts: as a whole, and up to the
end of the terms where an appendix on how to apply them follows. EPL, CDDL, AGPL and the Creative Commons licences but CC0 have
no text in the list; `known` takes further ones as a table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Licence texts and notices, as their publishers word them.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

"""
_BSD_3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

"""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_MIT_0_FIRST = _MIT.partition("\n\n")[0].replace(", subject to the following conditions:", ".")
_ISC_GRANT, _, _ISC_END = _ISC.partition("\n\n")
_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_UNLICENSE_END = "\n\nFor more information, please refer to <http://unlicense.org/>"
_BOOST = """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
_WTFPL = """DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE

TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION

0. You just DO WHAT THE FUCK YOU WANT TO."""
KNOWN_LICENSES = [
    ("MIT", _MIT),
    ("MIT", "MIT License\n\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n\n" + _MIT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("BSD-2-Clause", _BSD_2 + _BSD_END),
    ("BSD-2-Clause", "BSD 2-Clause License\n\n" + _BSD_2 + _BSD_END),
    ("BSD-3-Clause", _BSD_2 + _BSD_3 + _BSD_END),
    ("BSD-3-Clause", "BSD 3-Clause License\n\n" + _BSD_2 + _BSD_3 + _BSD_END),
    ("ISC", _ISC),
    ("ISC", "ISC License\n\n" + _ISC),
    ("MIT-0", _MIT_0_FIRST + "\n\n" + _MIT.split("\n\n")[2]),
    ("MIT-0", "MIT No Attribution\n\n" + _MIT_0_FIRST + "\n\n" + _MIT.split("\n\n")[2]),
    ("0BSD", _ISC_GRANT.partition(", provided")[0] + ".\n\n" + _ISC_END),
    ("0BSD", "BSD Zero Clause License\n\n" + _ISC_GRANT.partition(", provided")[0] + ".\n\n" + _ISC_END),
    ("Unlicense", _UNLICENSE),
    ("Unlicense", _UNLICENSE + _UNLICENSE_END),
    ("BSL-1.0", _BOOST),
    ("BSL-1.0", _BOOST.partition("\n\n")[2]),
    ("Zlib", _ZLIB),
    ("Zlib", "zlib License\n\n" + _ZLIB),
    ("Zlib", "The zlib License\n\n" + _ZLIB),
    ("WTFPL", _WTFPL),
    ("Apache-2.0", _APACHE_NOTICE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
]
# Digests of the canonical texts of long licences.
KNOWN_DIGESTS = [
    ("Apache-2.0", "cdeeb5f55d1ff3aa28f590bed4ac5849ef22efba7b5c0af70179cdd5a77af6f2"),
    ("Apache-2.0", "5c65388f0d04e0639eaececc922545c7abe191910e19100b6d2bb30d8bb58b3a"),
    ("Apache-2.0", "8e5cccb9b00a685882d999a6148207ee5cd97d69622a5fe7459597bddbacb88b"),
    ("Apache-2.0", "c8576ae30a0b39e9ce2d6e4bd15cfad76430fbf141a7db3a73e6e782c02e29f5"),
    ("Artistic-1.0", "68b9dd49ed1b1348e977ccc2468570a603d8075ede45354e352319821ca5469a"),
    ("CC0-1.0", "0a1be2017ec8d38dbb0dfb4f86e1c257728a1669c7fe4d3aa53a1c459e1018ee"),
    ("GFDL-1.2", "1b3d59c9862f59d21686f8ab2d51057ad0bf5a5e64a99840b7bbbcbc1f28a36b"),
    ("GFDL-1.3", "5e719d42b044f5a2be4336c9e91d4860266cc46522216361f4c9ccbb621b3657"),
    ("GPL-1.0", "0aea2e5a24dfa652e87d6db4afeea5078bd1e1dc80612dc4593d1f8604a0838c"),
    ("GPL-1.0", "74d52e3a923286548434252553889b034bb48cdd7faf61097e76671fcf8f2c8f"),
    ("GPL-1.0", "5fe6feaa141506043382865e76d80b5b5747ad5fbf32e08019ad44b0df56c66c"),
    ("GPL-2.0", "00646651bee1e32dbf4f08d5f9211363862e787663ac83b3d47700be19e24e65"),
    ("GPL-2.0", "b3faf8b797c03e59962ba1addea5e180e34800f5f3987604438eca0079fad061"),
    ("GPL-2.0", "d517a66442f4a09ada408f2685d8f3c30b5a744ac243ef526b25c503247d254c"),
    ("GPL-3.0", "fbf4c7854913caaf09c170805455959454d9447e36e4d6495f74d232da3fc175"),
    ("GPL-3.0", "0146dac78c87756d210fd3b26508bf1a3c85bb775a7a1fd6d471f4201103d236"),
    ("GPL-3.0", "c7c4b76179390b71d6bff6b733cb7894ed6499d9a3a9a174f0ae8c82d1ec8363"),
    ("LGPL-2.0", "82fbf2ce6e9eee1fc1770c15a33d8c5b536a72ca54e17cce6ffad62b178448b7"),
    ("LGPL-2.0", "2922f5fc660fc820d2f6113ca225f0e221ef09361af1b1426039a2cdb41339d3"),
    ("LGPL-2.0", "3481eadfb4767c0abaf9105890907a7778d620ac5b31eef5029dc0b4f5083ee2"),
    ("LGPL-2.1", "c0de486ab33c281643225c075cae414aefe780480a710a82b2fdc20c3c23ec49"),
    ("LGPL-2.1", "5a6d7d93f055022a3cce13b1ff3ed5f37cad90563aad8bdb704bdabad83f6473"),
    ("LGPL-2.1", "846f7d1a86e0cc44595720655d5ca887a4e34d0f60d37cc47ffc1ce29dc64b95"),
    ("LGPL-3.0", "572947626844a56d29ace510237040204d4085696621f319533ca366aa897913"),
    ("MPL-1.1", "d026e03207dbb501de50c6fb9fd1602e9391314f1ff2cbe2fa335e6dcedebbd3"),
    ("MPL-2.0", "085a00a7d5f35fd39ee7b08052486f5758ccc298a989a6393e2ce3ead8160650"),
]
# Parts of words and whole words, and what they count as.
STEMS = [("licenc", "licens")]
SPELLINGS = [
    ("sub license", "sublicense"), ("non infringement", "noninfringement"),
    ("authorisation", "authorization"), ("organisation", "organization"), ("acknowledgement", "acknowledgment"), ("favour", "favor"),
    ("copyright owner", "copyright holder"), ("copyright owners", "copyright holders"), ("per cent", "percent"), ("whilst", "while"), ("https", "http"),
]
#: A line that states a copyright, reserves all rights, or has the address of the publisher of the GNU licences.
COPYRIGHT_LINE = r"(?m)^[^a-z0-9\n]*(copyright[^a-z0-9\n]+(\(c\)|©|[0-9])|\(c\)[^a-z0-9\n]*[0-9]|©|all rights reserved|(51 franklin st|59 temple place|675 mass ave))[^\n]*$"


#: What every line of the list has one of.
LINE_WORDS = "licen[sc]e|permission|software|redistribution|cc0|cc by|unencumbered"


def canonical(text: Column) -> Column:
    """The canonical form of a text; '' for null."""
    out = F.lower(F.coalesce(text, F.lit("")))
    out = F.regexp_replace(out, COPYRIGHT_LINE, " ")
    for old, new in STEMS:
        out = F.replace(out, F.lit(old), F.lit(new))
    out = F.concat(F.lit("  "), F.regexp_replace(out, "[^a-z0-9]+", "  "), F.lit("  "))
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(_word(old)), F.lit(_word(new)))
    return F.trim(out)


def _word(words: str) -> str:
    """Words as they stand in a canonical text: two blanks apart, one of them on each side their own."""
    return f" {words.replace(' ', '  ')} "


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_digests(spark: SparkSession, known: DataFrame | None = None) -> DataFrame:
    """(digest, license_id) of the fixed lists above, and of the texts of `known` (license_id, text). A digest that several
    licences have goes to the first one by name."""
    texts = spark.createDataFrame(KNOWN_LICENSES, "license_id string, text string")
    if known is not None:
        texts = texts.unionByName(known.select("license_id", "text"))
    listed = spark.createDataFrame(KNOWN_DIGESTS, "license_id string, digest string")
    return texts.select("license_id", digest(F.col("text")).alias("digest")).union(listed).groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: DataFrame | None = None) -> DataFrame:
    """Licence of each whole text, and licences of its lines: (id, digest, license_id, line_licenses).

    digest: SHA-256 of the canonical text. license_id: of the known licence with this digest, else null; licences
    known besides the fixed lists may be given as rows (license_id, text). line_licenses: sorted licences of the lines that as
    a whole are a text of the fixed list. One row for each input row, repeated and null ids too; null and empty texts have
    the digest of '' and no licence. Only digests are joined, and the list of known ones is broadcast while Spark finds it
    small; no text is shuffled.
    """
    digests = known_digests(docs.sparkSession, known)
    names = {r.digest: r.license_id for r in known_digests(docs.sparkSession).collect()}  # the fixed lists
    lookup = F.create_map(*[F.lit(x) for pair in sorted(names.items()) for x in pair])
    # only a line with a licence word of the list can have a known digest: lines without one aren't hashed
    words = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    lines = F.filter(F.split(words, "\n"), lambda x: x.rlike(LINE_WORDS))
    found = F.array_sort(F.array_distinct(F.filter(F.transform(lines, lambda x: F.try_element_at(lookup, digest(x))), lambda x: x.isNotNull())))
    marked = docs.select(id_col, digest(F.col(text_col)).alias("digest"), found.alias("line_licenses"))
    return marked.join(digests, "digest", "left").select(id_col, "digest", "license_id", "line_licenses")


def _sql() -> str:
    def canon(x: str) -> str:
        out = f"regexp_replace(lower(coalesce({x}, '')), '{COPYRIGHT_LINE}', ' ', 'g')"
        for old, new in STEMS:
            out = f"replace({out}, '{old}', '{new}')"
        out = f"'  ' || regexp_replace({out}, '[^a-z0-9]+', '  ', 'g') || '  '"
        for old, new in SPELLINGS:
            out = f"replace({out}, '{_word(old)}', '{_word(new)}')"
        return f"trim({out})"

    values = ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in KNOWN_LICENSES)
    listed = ", ".join(f"('{a}', '{b}')" for a, b in KNOWN_DIGESTS)
    return f"""
WITH known AS (SELECT digest, min(license_id) AS license_id FROM (SELECT sha256({canon("t")}) AS digest, l AS license_id FROM (VALUES {values}) AS v(l, t) UNION ALL SELECT d, l FROM (VALUES {listed}) AS w(l, d)) GROUP BY digest),
docs AS (SELECT row_number() OVER () AS n, doc_id, text FROM documents),
lines AS (SELECT n, unnest(string_split(lower(coalesce(text, '')), chr(10))) AS x FROM docs),
hits AS (SELECT n, list_sort(list(DISTINCT license_id)) AS ids FROM (SELECT n, sha256({canon("x")}) AS digest FROM lines WHERE regexp_matches(x, '{LINE_WORDS}')) JOIN known USING (digest) GROUP BY n)
SELECT doc_id, digest, license_id, coalesce(hits.ids, []) AS line_licenses
FROM (SELECT n, doc_id, sha256({canon("text")}) AS digest FROM docs) d LEFT JOIN known USING (digest) LEFT JOIN hits USING (n)
"""


LICENSE_SQL = _sql()
