"""License scans with SQL functions only: canonical digest lookup.

A text's canonical form has lower case, no copyright statements, one spelling of equivalent words and only letters
and digits between single spaces. Its SHA-256 is hash-joined to the digests of known licences, so that a whole
text that is a licence is found however its lines are wrapped. Lines are looked up alike among known notices.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import common

#: Equivalent spellings, applied in order to lower-case text.
SPELLINGS = [
    ("licence", "license"),
    ("sub-license", "sublicense"),
    ("sub license", "sublicense"),
    ("non-commercial", "noncommercial"),
    ("non-infringement", "noninfringement"),
    ("&", " and "),
    ("https://", "http://"),
    ("per cent", "percent"),
    ("copyright owner", "copyright holder"),
    ("organisation", "organization"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("recognise", "recognize"),
    ("initialise", "initialize"),
    ("utilisation", "utilization"),
    ("acknowledgement", "acknowledgment"),
    ("judgement", "judgment"),
    ("cancelled", "canceled"),
    ("favour", "favor"),
    ("offence", "offense"),
    ("whilst", "while"),
    ("merchantibility", "merchantability"),
]
#: Signs that stand for words; and spellings of several words, which are told when lines are joined.
_SIGNS = [("©", " copyright ")]
_PHRASES = [x for x in SPELLINGS if " " in x[0]]
_WORDS = [x for x in SPELLINGS if " " not in x[0]] + _SIGNS
_MARKS = r"[^\p{L}\p{N}]+"
#: All but letters, digits and line ends; the gaps with a line end that are left.
_MARKS_IN_LINE, _LINE_ENDS = r"[^\p{L}\p{N}\n]+", r"[ \n]*\n[ \n]*"
#: Words that follow a copyright statement in known licences, and so end it wherever lines do.
OPENINGS = [
    "permission is hereby granted",
    "permission to use copy modify",
    "permission is granted to",
    "redistribution and use in source",
    "this software is provided",
    "this program is free software",
    "this library is free software",
    "this is free and unencumbered",
    "everyone is permitted to copy",
    "licensed under the",
    "boost software license",
]
_STATEMENT = r"(?:copyright(?:[ \n]c)?|c)[ \n](?:(?:19|20)[0-9]{2}|year|yyyy|19yy|20yy)"
#: A statement up to an opening, at most 60 words on; what is left of statements, to the end of a line that begins with one.
_BOUNDED = r"(^|[ \n])" + _STATEMENT + r"(?:[ \n][^ \n]+){0,60}?[ \n](" + "|".join(x.replace(" ", r"[ \n]") for x in OPENINGS) + ")"
_OWN_LINE = r"(^|\n)(?:copyright(?: c)?|c) (?:19|20)[0-9]{2}[^\n]*"
#: Known notices are looked up by a literal map of at most this many entries.
NOTICES_LIMIT = 10_000

_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
_BSD_WARRANTY = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
#: Texts of known licences without copyright lines and titles, by identifier.
LICENSES = {
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "ISC": f"{_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_WARRANTY}",
    "0BSD": f"{_GRANT}.\n\n{_ISC_WARRANTY}",
    "BSD-2-Clause": _BSD_GRANT + _BSD_WARRANTY,
    "BSD-3-Clause": _BSD_GRANT + _BSD_THIRD + _BSD_WARRANTY,
    "Unlicense": 'This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n\nFor more information, please refer to <https://unlicense.org>',
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution.",
    "BSL-1.0": 'Boost Software License - Version 1.0 - August 17th, 2003\n\nPermission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:\n\nThe copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
}
#: Titles that a licence's text may begin with, besides none.
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)"],
    "ISC": ["ISC License", "The ISC License"],
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD"],
    "BSD-2-Clause": ["BSD 2-Clause License", 'BSD 2-Clause "Simplified" License', "The BSD 2-Clause License"],
    "BSD-3-Clause": ["BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License', "The BSD 3-Clause License"],
    "Unlicense": ["The Unlicense"],
    "Zlib": ["zlib License", "The zlib License"],
}
#: Digests of the canonical forms of longer licences' published texts.
DIGESTS = {
    "Apache-2.0": "04e64e0427d80fdde16fa8415931bf2c09bc943f13ec322a09df188bf23a3543",
    "Artistic-1.0-Perl": "e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2",
    "CC0-1.0": "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f",
    "GFDL-1.2": "974d4803f32bc52585c91f1d63d572d8e11bf3d14744649accc62ae987441597",
    "GFDL-1.3": "34c73c47241aa82a5db0ec292e9a2c127d3bc8b07456d806aad74bbebcfc1f5d",
    "GPL-1.0": "d98bca1875592c382caba655043aec268528bc17c9d7c0a9e892b953378effa6",
    "GPL-2.0": "464b45d65c9fb612f6ba2e2d21a6aacd7b621de2ef4db62d3a6c599c228fd982",
    "GPL-3.0": "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a",
    "LGPL-2.0": "4401e0261a8caf4fd55eeb0e816fda06bbc9e4b2605767f5ffdf843a5c70e07e",
    "LGPL-2.1": "599d9303049b507aa89582ee08dd4ddaba298764648558e7bf8e78309807bfaa",
    "LGPL-3.0": "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",
    "MPL-1.1": "a1b36de49a400e3d3385d5987188db954a084f9876243aa7207cd91de3f24a7b",
    "MPL-2.0": "6fedd8db6adb0e102fc0f69b9e1501d2edaf25940e34910831cab46f9f5d4e4d",
}
#: One-line notices, by identifier of the licence they name.
NOTICES = {
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    'Licensed under the Apache License, Version 2.0 (the "License");': "Apache-2.0",
    "Licensed under the MIT License.": "MIT",
    "Released under the MIT License.": "MIT",
    "Licensed under the BSD 3-Clause License.": "BSD-3-Clause",
    "Licensed under CC BY 4.0.": "CC-BY-4.0",
    "Licensed under CC BY-SA 4.0.": "CC-BY-SA-4.0",
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
    "This work is licensed under the GNU General Public License v3.0.": "GPL-3.0",
    "This work is licensed under the GNU General Public License v3.": "GPL-3.0",
    "All rights reserved.": "proprietary",
}


def canonical(text: Column) -> Column:
    """The canonical form of a text; null for null. Only A-Z change case.

    A copyright statement is a year or the place for one after the word or sign. It goes with its holders up to words that
    known licences go on with, wherever lines end, or else to the end of a line that begins with it.
    """
    out = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for old, new in _WORDS:
        out = F.replace(out, F.lit(old), F.lit(new))
    out = F.trim(F.regexp_replace(F.regexp_replace(out, _MARKS_IN_LINE, " "), _LINE_ENDS, "\n"))
    out = F.regexp_replace(F.regexp_replace(out, _BOUNDED, "$1$2"), _OWN_LINE, "\n")
    out = F.regexp_replace(out, "[ \n]+", " ")
    for old, new in _PHRASES:
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.trim(out)


def _line(text: Column) -> Column:
    out = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.trim(F.regexp_replace(out, _MARKS, " "))


def texts(licenses: dict[str, str]) -> list[tuple[str, str]]:
    """(identifier, text) of licences, with each of their titles and without."""
    return [(k, title + "\n\n" + v if title else v) for k, v in licenses.items() for title in ("", *TITLES.get(k, ()))]


def known(spark: SparkSession, licenses: dict[str, str] | None = None) -> DataFrame:
    """(digest, license_id) of licence texts, or of the known ones; of equal texts the smallest identifier stays."""
    rows = spark.createDataFrame(texts(LICENSES if licenses is None else licenses), "license_id string, text string")
    rows = rows.select("license_id", F.sha2(canonical(F.col("text")).cast("binary"), 256).alias("digest"))
    if licenses is None:
        rows = rows.unionByName(spark.createDataFrame(list(DIGESTS.items()), "license_id string, digest string"))
    return rows.groupBy("digest").agg(F.min("license_id").alias("license_id"))


def anchor(form: str) -> str:
    """A pattern of the longest word of a notice's form, in all its spellings: no line has the form without it.

    Words that equivalent phrases or signs may stand for are passed over.
    """
    loose = {w for old, new in SPELLINGS if not (old.isalpha() and new.isalpha()) for w in re.findall(r"\w+", new)}
    words = sorted((w for w in form.split() if not any(x in w for x in loose)), key=lambda w: (-len(w), w))
    out = re.escape(words[0]) if words else ""
    for old, new in SPELLINGS:
        if old.isalpha() and new.isalpha():
            out = out.replace(new, f"(?:{new}|{old})")
    return out


def scan(docs: DataFrame, licenses: DataFrame | None = None, notices: dict[str, str] | None = None, text_col: str = "text") -> DataFrame:
    """docs with digest, license_id (null if the whole text is no known licence) and notices (sorted identifiers of known
    one-line notices), in place of columns of these names.

    licenses: (digest, license_id), as known() gives them. A null text has a null digest and no notices; an empty one the
    digest of the empty form, which no licence has. Repeated rows each have their result.
    """
    spark = docs.sparkSession
    lines = NOTICES if notices is None else notices
    if len(lines) > NOTICES_LIMIT:
        raise ValueError(f"more than {NOTICES_LIMIT} notices")
    licenses = licenses if licenses is not None else known(spark)
    few = licenses.limit(common.BROADCAST_IDS + 1).count() <= common.BROADCAST_IDS
    forms = {r[0]: r[1] for r in spark.createDataFrame(list(lines.items()) or [("", "")], "line string, id string").select(_line(F.col("line")), "id").collect() if r[0]}
    none = F.array().cast("array<string>")
    found = none
    if forms:
        table = F.create_map(*[F.lit(x) for pair in forms.items() for x in pair])
        marked = F.filter(F.split(F.col(text_col), "\n"), lambda s: s.rlike("(?i)" + "|".join(sorted({anchor(f) for f in forms}))))
        found = F.array_sort(F.array_distinct(F.filter(F.transform(marked, lambda s: F.element_at(table, _line(s))), lambda x: x.isNotNull())))
    key, name, notice = common.fresh("digest"), common.fresh("license"), common.fresh("notices")
    right = licenses.select(F.col("digest").alias(key), F.col("license_id").alias(name))
    digest = common.fresh("digest")
    out = docs.withColumns({digest: F.sha2(canonical(F.col(text_col)).cast("binary"), 256), notice: F.coalesce(found, none)})
    out = out.join(F.broadcast(right) if few else right, F.col(digest) == F.col(key), "left")
    return out.withColumns({"digest": F.col(digest), "license_id": F.col(name), "notices": F.col(notice)}).drop(digest, notice, key, name)


def op3_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each row of documents, repeated ones too; see scan() for nulls and empty texts."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan(docs).select("doc_id", "digest", "license_id", F.array_join("notices", ",").alias("notices"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql_line(text: str) -> str:
    out = f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    for old, new in SPELLINGS:
        out = f"replace({out}, {_quoted(old)}, {_quoted(new)})"
    return f"trim(regexp_replace({out}, {_quoted(_MARKS)}, ' ', 'g'))"


def _sql_form(text: str) -> str:
    out = f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    for old, new in _WORDS:
        out = f"replace({out}, {_quoted(old)}, {_quoted(new)})"
    for pattern, by in ((_MARKS_IN_LINE, "' '"), (_LINE_ENDS, "chr(10)"), (_BOUNDED, "'\\1\\2'"), (_OWN_LINE, "chr(10)"), (r"[ \n]+", "' '")):
        out = f"regexp_replace({out}, {_quoted(pattern)}, {by}, 'g')"
        out = f"trim({out})" if pattern == _LINE_ENDS else out
    for old, new in _PHRASES:
        out = f"replace({out}, {_quoted(old)}, {_quoted(new)})"
    return f"trim({out})"


ORACLE_SQL = f"""
WITH known AS (SELECT digest, min(id) AS license_id FROM (SELECT id, sha256({_sql_form('text')}) AS digest
               FROM (VALUES {', '.join(f'({_quoted(k)}, {_quoted(v)})' for k, v in texts(LICENSES))}) AS t(id, text)
               UNION ALL SELECT * FROM (VALUES {', '.join(f'({_quoted(k)}, {_quoted(v)})' for k, v in DIGESTS.items())}) AS t(id, digest)) GROUP BY 1),
notices AS (SELECT DISTINCT {_sql_line('line')} AS form, id
            FROM (VALUES {', '.join(f'({_quoted(k)}, {_quoted(v)})' for k, v in NOTICES.items())}) AS t(line, id)),
docs AS (SELECT row_number() OVER () AS n, doc_id, text, sha256({_sql_form('text')}) AS digest FROM documents),
lines AS (SELECT n, {_sql_line('line')} AS form FROM (SELECT n, unnest(string_split(text, chr(10))) AS line FROM docs)),
found AS (SELECT n, string_agg(DISTINCT id, ',' ORDER BY id) AS notices FROM lines JOIN notices USING (form) GROUP BY n)
SELECT doc_id, docs.digest, license_id, coalesce(notices, '') AS notices
FROM docs LEFT JOIN known USING (digest) LEFT JOIN found USING (n)"""
