"""Operator 10: licence texts by canonical digest, with DataFrame functions only.

A text is brought to canonical form: lower case, lines of copyright notices dropped, all but letters and digits
made single spaces, equivalent spellings made one, word by word. The digests of whole texts are then joined with
those of known licences, which go through the same form. Short licences are known by their texts, long
ones by the digests of theirs.

A line is a copyright notice if it begins with "copyright" and holds a year, a sign (c) or a placeholder, or begins with
the sign and a year or placeholder; so lines of a licence's body stay, however it is wrapped.

Edge cases: null and empty texts, and texts of copyright notices only, have no digest and no
licence; a long text is digested whole; repeated rows stay rows; an empty table has no rows in the result; other columns,
whatever their names, are not read. The licence table is a constant of a few rows, so its broadcast has a fixed bound.
"""

from __future__ import annotations

import textwrap

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spellings that licence texts use for the same thing.
SPELLINGS = (("licence", "license"), ("licenced", "licensed"), ("sub license", "sublicense"), ("sublicence", "sublicense"), ("sublicences", "sublicenses"), ("licences", "licenses"), ("licencing", "licensing"), ("non infringement", "noninfringement"), ("merchantibility", "merchantability"), ("favour", "favor"), ("organisation", "organization"), ("per cent", "percent"), ("wilful", "willful"), ("acknowledgement", "acknowledgment"), ("all rights reserved", ""))

_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"""
_MIT_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_GRANT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"""
_ISC_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_WARRANTY = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
_APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_GPL3_NOTICE = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""
_MPL2_NOTICE = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""

_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_UNLICENSE_END = """For more information, please refer to <https://unlicense.org>"""
_BSL = """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

#: Public licence texts and standard notices by SPDX name. More than one text of a name is a known variant.
KNOWN = (
    ("MIT", f"MIT License\n\nCopyright (c) <year> <holder>\n\n{_MIT_GRANT}, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n{_MIT_WARRANTY}"),
    ("MIT", f"Copyright (c) <year> <holder>\n\n{_MIT_GRANT}, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n{_MIT_WARRANTY}"),
    ("MIT-0", f"MIT No Attribution\n\nCopyright <year> <holder>\n\n{_MIT_GRANT}.\n\n{_MIT_WARRANTY}"),
    ("ISC", f"ISC License\n\nCopyright (c) <year> <holder>\n\n{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_WARRANTY}"),
    ("ISC", f"Copyright (c) <year> <holder>\n\n{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_WARRANTY}"),
    ("0BSD", f"BSD Zero Clause License\n\nCopyright (c) <year> <holder>\n\n{_ISC_GRANT}.\n\n{_ISC_WARRANTY}"),
    ("BSD-2-Clause", f"BSD 2-Clause License\n\nCopyright (c) <year>, <holder>\n\n{_BSD_HEAD}\n\n{_BSD_WARRANTY}"),
    ("BSD-2-Clause", f"Copyright (c) <year>, <holder>\n\n{_BSD_HEAD}\n\n{_BSD_WARRANTY}"),
    ("BSD-3-Clause", f"BSD 3-Clause License\n\nCopyright (c) <year>, <holder>\n\n{_BSD_HEAD}\n\n{_BSD_THIRD}\n\n{_BSD_WARRANTY}"),
    ("BSD-3-Clause", f"Copyright (c) <year>, <holder>\n\n{_BSD_HEAD}\n\n{_BSD_THIRD}\n\n{_BSD_WARRANTY}"),
    ("Zlib", f"zlib License\n\nCopyright (c) <year> <holder>\n\n{_ZLIB}"),
    ("Zlib", f"Copyright (c) <year> <holder>\n\n{_ZLIB}"),
    ("Apache-2.0", f"Copyright <year> <holder>\n\n{_APACHE_NOTICE}"),
    ("GPL-3.0-or-later", f"Copyright (C) <year> <holder>\n\n{_GPL3_NOTICE}"),
    ("MPL-2.0", _MPL2_NOTICE),
    ("Unlicense", _UNLICENSE),
    ("Unlicense", f"{_UNLICENSE}\n\n{_UNLICENSE_END}"),
    ("Unlicense", f"{_UNLICENSE}\n\n{_UNLICENSE_END.replace('https', 'http')}"),
    ("BSL-1.0", _BSL),
)

#: Canonical digests of full texts by SPDX name, with and without what follows the terms ("how to apply").
DIGESTS = (
    ("Apache-2.0", "75acde0fb516a7ba4597dfc23680cf78281f7fae7f3b74a78e06ef83c1c375c6"),
    ("Apache-2.0", "f9138026e58bdb767e6c6e974637ff9aacbaedf2695e30fef144e5d7d84448ff"),
    ("Apache-2.0", "6fb8411669deea22294b6190fad00b8e39899d0b7b6c5cf97a3b15b47e129c38"),
    ("Artistic-1.0-Perl", "e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2"),
    ("CC0-1.0", "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e"),
    ("GFDL-1.2", "5379e6f33e826ba185b23fd11a414555c2161fda481478babd1e73a3ae098a71"),
    ("GFDL-1.3", "93d6108daecdddc5f284cf8f2512fb0d72f6e9ee12381feb9704ba194b00c3e6"),
    ("GPL-1.0", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-1.0", "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc"),
    ("GPL-1.0", "89f75ffda938e788be38679f9f83e317c2a03398fccf03ee60505d44d1bf9f70"),
    ("GPL-2.0", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-2.0", "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34"),
    ("GPL-2.0", "6d332dc4c3c5293a73c6c9da402f9bbc970b3bb1eb472f577e00580573469808"),
    ("GPL-3.0", "a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68"),
    ("GPL-3.0", "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636"),
    ("GPL-3.0", "092a7f3b82e6c22949b46388bca99e725b6e756f1c2b1e3f575447fbd44b6191"),
    ("LGPL-2.0", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.0", "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260"),
    ("LGPL-2.0", "430627da7218a92ab4a6d75d5140cdb70ee750be7a53f913299b37e0d1b0eea2"),
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-2.1", "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4"),
    ("LGPL-2.1", "bf2f0c6bf1c47b3b1e3cbedeefecddd1e7db21d1919858d45c2f918efaf426df"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "26ba73e836ecb04fe87d5eca80ca27cff1afa2d7683455be1517bd23b8d27986"),
    ("MPL-2.0", "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a"),
)


_SIGN, _HELD = r"(\(c\)|©)", r"([12][0-9]{3}|19yy|<[a-z ]+>|\[[a-z ]+\]|\{[a-z ]+\})"
#: A line that is a copyright notice, after the signs of a comment.
NOTICE = rf"(^|\n)[ \t*#/;-]*(copyright[^\n]*({_SIGN}|{_HELD})|{_SIGN}[ \t]*(copyright[ \t]*)?{_HELD})[^\n]*"


def canonical(text: Column) -> Column:
    """Canonical form of a text."""
    x = F.lower(F.coalesce(text.cast("string"), F.lit("")))
    x = F.regexp_replace(x, NOTICE, "\n")
    # each word has blanks of its own on both sides, so that neighbours can be replaced alike
    x = F.concat(F.lit(" "), F.trim(F.regexp_replace(x, r"[^\p{L}\p{N}]+", "  ")), F.lit(" "))
    for odd, usual in _WIDE:
        x = F.replace(x, F.lit(odd), F.lit(usual))
    return F.trim(F.regexp_replace(x, " +", " "))


_WIDE = tuple(tuple(" " + " ".join(f"{w} " for w in x.split()) if x else " " for x in pair) for pair in SPELLINGS)


def digest(text: Column) -> Column:
    """sha256 of the canonical form; null if nothing is left of the text."""
    form = canonical(text)
    return F.when(form != "", F.sha2(form, 256))


def known_licenses(spark: SparkSession, texts=KNOWN, digests=DIGESTS) -> DataFrame:
    """digest and license_id, one row a digest."""
    pairs = [F.struct(digest(F.lit(t)).alias("digest"), F.lit(i).alias("license_id")) for i, t in texts] + [F.struct(F.lit(d).alias("digest"), F.lit(i).alias("license_id")) for i, d in digests]
    rows = spark.range(1).select(F.inline(F.array(*pairs or [F.struct(F.lit(None).cast("string").alias("digest"), F.lit("").alias("license_id"))])))
    return rows.where("digest is not null").groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, texts=KNOWN, digests=DIGESTS) -> DataFrame:
    """Per row of `docs`: doc_id, its digest, and the licence whose canonical text it is (null: none)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest(F.col("text")).alias("digest"))
    return rows.join(F.broadcast(known_licenses(docs.sparkSession, texts, digests)), "digest", "left").select("doc_id", "digest", "license_id")


def variants() -> list[tuple[int, str]]:
    """Known texts as they are found in files: other case, wrapping, spelling, signs, holders; and texts that are none."""
    out = []
    for _, text in KNOWN:
        held = text.replace("<year> <holder>", "2019-2021 Some One and others").replace("<year>, <holder>", "2024, A Holder")
        out += [text, held.upper(), "\n".join(f" * {x}" for part in held.split("\n\n") for x in textwrap.wrap(part, 57, break_long_words=False)), held.replace("License", "Licence").replace(" license", " licence").replace("sublicense", "sublicence").replace(",", " , "), held + " And more."]
    out += ["licence licence organisation organisation per cent per cent", "Copyright (c) 2020 One\nCopyright (c) 2021 Two\n© 2022 Three", "copyright holders and (c) others", "", None]
    return list(enumerate(out))


def scan_sql(texts=KNOWN, digests=DIGESTS, table: str = "documents") -> str:
    """The same scan as DuckDB SQL over a table."""
    quoted = lambda x: "null" if x is None else "'{}'".format(x.replace("'", "''"))

    def form(x: str) -> str:
        y = f"lower(coalesce({x}, ''))"
        y = f"regexp_replace({y}, {quoted(NOTICE)}, chr(10), 'g')"
        y = f"' ' || trim(regexp_replace({y}, '[^\\p{{L}}\\p{{N}}]+', '  ', 'g')) || ' '"
        for odd, usual in _WIDE:
            y = f"replace({y}, '{odd}', '{usual}')"
        return f"trim(regexp_replace({y}, ' +', ' ', 'g'))"

    known = ", ".join(f"({quoted(i)}, {quoted(t)})" for i, t in texts)
    more = ", ".join(f"({quoted(i)}, {quoted(d)})" for i, d in digests)
    return f"""with forms as (select doc_id, {form('text')} as form from {table}),
known as (select digest, min(license_id) as license_id from (
    select license_id, sha256(form) as digest from (select license_id, {form('text')} as form from (values {known}) as k(license_id, text)) where form <> ''
    union all select license_id, digest from (values {more}) as d(license_id, digest)) group by 1)
select doc_id, d.digest, license_id from (select doc_id, case when form <> '' then sha256(form) end as digest from forms) d left join known on d.digest = known.digest"""


def variants_sql() -> str:
    """The scan of `variants`."""
    rows = ", ".join("({}, {})".format(i, "null" if t is None else "'{}'".format(t.replace("'", "''"))) for i, t in variants())
    return scan_sql(table=f"(values {rows}) as v(doc_id, text)")
