"""Licence scan by canonical digest lookup, in DataFrame functions only.

A text is brought to canonical form: lower case, copyright lines dropped, spellings unified, everything
but letters and digits turned into single spaces.  Whole documents are brought to it, and so is each of
their lines as a text of its own, since sources carry one-line notices.  The SHA-256 digests of all these
forms are joined by hash with a table of the digests of known licence texts and notices; a caller can give
a table of their own (:func:`digest_table`).

Null and empty texts have the digest of the empty form and no licence.  Texts of any length are looked up
whole.  Rows are independent, so repeats need no rule; an empty table gives an empty table.  Only ``doc_id``
and ``text`` are read, so further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.visits import small
from . import common

# Spellings that licence texts use for one another, applied in this order to spaced lower case.
SPELLINGS = [
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("sublicence", "sublicense"),
    ("organisation", "organization"),
    ("organisations", "organizations"),
    ("merchantibility", "merchantability"),
    ("favour", "favor"),
    ("honour", "honor"),
    ("behaviour", "behavior"),
    ("acknowledgement", "acknowledgment"),
    ("v2", "version 2"),
    ("v3", "version 3"),
    ("noncommercial", "non commercial"),
]

# Well-known notices and short licence texts.
KNOWN = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("Apache-2.0", "Apache License Version 2.0"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "MIT License"),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    (
        "MIT",
        "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software "
        'and associated documentation files (the "Software"), to deal in the Software without restriction, including '
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies "
        "of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or "
        'substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, '
        "EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
        "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, "
        "DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
        "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "ISC License\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or "
        "without fee is hereby granted, provided that the above copyright notice and this permission notice appear in "
        'all copies.\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS '
        "SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE "
        "LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM "
        "LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING "
        "OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "GNU General Public License Version 3"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, "
        "this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the "
        "above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution.\n\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "
        '"AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF '
        "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
        "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
        "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR "
        "BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR "
        "TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF "
        "THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, "
        "this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the "
        "above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution.\n\n3. Neither the name of the copyright holder nor the names of its "
        "contributors may be used to endorse or promote products derived from this software without specific prior "
        "written permission.\n\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "
        '"AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF '
        "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
        "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
        "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR "
        "BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR "
        "TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF "
        "THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "0BSD",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        'granted.\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS '
        "SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE "
        "LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM "
        "LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING "
        "OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "MIT-0",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without '
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so.\n\nTHE SOFTWARE IS PROVIDED "
        '"AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
        "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT "
        "OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE "
        "SOFTWARE.",
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be "
        "held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use "
        "this software for any purpose, including commercial applications, and to alter it and redistribute it freely, "
        "subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must "
        "not claim that you wrote the original software. If you use this software in a product, an acknowledgment in "
        "the product documentation would be appreciated but is not required.\n\n2. Altered source versions must be "
        "plainly marked as such, and must not be misrepresented as being the original software.\n\n3. This notice may "
        "not be removed or altered from any source distribution.",
    ),
    (
        "BSL-1.0",
        "Boost Software License - Version 1.0 - August 17th, 2003\n\nPermission is hereby granted, free of charge, to "
        "any person or organization obtaining a copy of the software and accompanying documentation covered by this "
        'license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to '
        "prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do "
        "so, all subject to the following:\n\nThe copyright notices in the Software and this entire statement, including "
        "the above license grant, this restriction and the following disclaimer, must be included in all copies of the "
        "Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works "
        "are solely in the form of machine-executable object code generated by a source language processor.\n\nTHE "
        'SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO '
        "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT "
        "SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, "
        "WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR "
        "OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, "
        "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, "
        "for any purpose, commercial or non-commercial, and by any means.\n\nIn jurisdictions that recognize copyright "
        "laws, the author or authors of this software dedicate any and all copyright interest in the software to the "
        "public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs "
        "and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and "
        'future rights to this software under copyright law.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY '
        "KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A "
        "PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
        "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n\nFor more information, please refer to "
        "<https://unlicense.org>",
    ),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\n"
        'Unless required by applicable law or agreed to in writing, software distributed under the License is '
        'distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See '
        "the License for the specific language governing permissions and limitations under the License.",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
]

#: Titles that may stand before a licence's text and do not change what it is.
TITLES = {
    "MIT": ("The MIT License", "The MIT License (MIT)", ""),
    "ISC": ("The ISC License", ""),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD"),
    "MIT-0": ("MIT No Attribution",),
    "Zlib": ("zlib License", "The zlib/libpng License"),
}
# What a form must hold to be known: one of these is in every text of the table above, so other lines of a
# document need not be brought to canonical form.
MARKERS = ("licen", "unencumbered", "hereby granted", "redistribut")

# How a sentence goes on in which "copyright" names no holder, so that a line may begin with it.
GOES_ON = "notice|licen|holder|owner|law|interest|and |or |in |statement|protection|permission"
MARKED = r"\(c\)[ \t]*(?:©|copyright|[0-9]{4})|©"
COPYRIGHT = rf"(^|\n)[^\na-z0-9]*(?:copyright(?![ \t\r\n]+(?:{GOES_ON}))|{MARKED})[^\n]*"


def canonical(text: str) -> str:
    """The canonical form, for building the digest table; mirrors :func:`canonical_column`."""
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    text = re.sub(COPYRIGHT, r"\1", text)
    # two blanks between words, so that each has its own at either end
    text = "  " + re.sub(r"[^a-z0-9]+", "  ", text) + "  "
    for a, b in SPELLINGS:
        text = text.replace(f" {a} ", f" {b} ")
    return re.sub(r" +", " ", text).strip(" ")


def digests() -> list[tuple[str, str]]:
    """``(digest, licence)`` of the known texts, with each title that may precede them."""
    found: dict[str, str] = {}
    for name, text in KNOWN:
        forms = [canonical(text)]
        if "\n\n" in text:
            own = forms[0]
            for title in TITLES.get(name, ()):
                body = own
                for t in (*TITLES[name], f"{name} License"):
                    body = body.removeprefix(canonical(t) + " ") if t else body
                forms.append(f"{canonical(title)} {body}".strip(" "))
        for form in forms:
            found.setdefault(hashlib.sha256(form.encode()).hexdigest(), name)
    return sorted(found.items())


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lower(text):
    """A-Z in lower case; whole texts of ASCII are turned at once."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def canonical_column(text):
    c = _lower(text)
    c = F.regexp_replace(c, COPYRIGHT, "$1")
    c = F.concat(F.lit("  "), F.regexp_replace(c, "[^a-z0-9]+", "  "), F.lit("  "))
    for a, b in SPELLINGS:
        c = F.replace(c, F.lit(f" {a} "), F.lit(f" {b} "))
    return F.trim(F.regexp_replace(c, " +", " "))


def digest_table(texts: DataFrame) -> DataFrame:
    """``digest, license`` of ``texts(license, text)``, for :func:`scan`; of two licences with one text the first by name."""
    rows = texts.where(F.col("text").isNotNull()).select("license", F.sha2(canonical_column(F.col("text")), 256).alias("digest"))
    return rows.groupBy("digest").agg(F.min("license").alias("license"))


def _built_in(spark) -> DataFrame:
    rows = ", ".join(f"('{d}', '{n}')" for d, n in digests())
    return spark.sql(f"SELECT * FROM VALUES {rows} AS known(digest, license)")


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``doc_id, text_digest, text_license, n_notices, notice_licenses`` for each row.

    ``notice_licenses`` are the distinct licences of the lines, sorted and comma-joined, "" if none.
    ``known(digest, license)`` takes the place of the built-in table; each digest is in it once.
    """
    table = small(known) if known is not None else F.broadcast(_built_in(docs.sparkSession))
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.split(_lower(text), "\n")
    if known is None:
        lines = F.filter(lines, lambda x: reduce(lambda a, b: a | b, [x.contains(m) for m in MARKERS]))
    rows = common.texts(docs).select(F.monotonically_increasing_id().alias("row_no"), "doc_id", F.sha2(canonical_column(text), 256).alias("text_digest"), F.transform(lines, lambda x: F.sha2(canonical_column(x), 256)).alias("line_digests"))
    # the whole text's digest comes first; a row for each digest meets the table
    asked = rows.select("row_no", "doc_id", F.posexplode(F.concat(F.array("text_digest"), "line_digests")).alias("place", "digest"))
    met = asked.join(table, "digest", "left")
    whole, line = F.col("place") == 0, F.col("place") > 0
    found = met.groupBy("row_no", "doc_id").agg(
        F.max(F.when(whole, F.col("digest"))).alias("text_digest"),
        F.max(F.when(whole, F.col("license"))).alias("text_license"),
        F.count(F.when(line, F.col("license"))).alias("n_notices"),
        F.collect_set(F.when(line, F.col("license"))).alias("names"),
    )
    return found.select("doc_id", "text_digest", "text_license", "n_notices", F.array_join(F.array_sort("names"), ",").alias("notice_licenses"))


def _sql_canonical(text: str) -> str:
    c = f"translate({text}, '{UPPER}', '{LOWER}')"
    # its patterns cannot look ahead: what goes on is marked first
    c = f"regexp_replace({c}, 'copyright([ \\t\\r\\n]+({GOES_ON}))', 'copy_right\\1', 'g')"
    c = f"regexp_replace({c}, '(^|\\n)[^\\na-z0-9]*(copyright|{MARKED})[^\\n]*', '\\1', 'g')"
    c = f"replace({c}, 'copy_right', 'copyright')"
    c = f"'  ' || regexp_replace({c}, '[^a-z0-9]+', '  ', 'g') || '  '"
    for a, b in SPELLINGS:
        c = f"replace({c}, ' {a} ', ' {b} ')"
    return f"trim(regexp_replace({c}, ' +', ' ', 'g'), ' ')"


def sql() -> str:
    values = ", ".join(f"('{d}', '{n}')" for d, n in digests())
    return f"""
WITH known(digest, license) AS (VALUES {values}),
docs AS (SELECT row_number() OVER () AS r, CAST(doc_id AS BIGINT) AS doc_id, coalesce(text, '') AS text FROM documents),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM docs),
found AS (
  SELECT r, count(*) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS names
  FROM lines JOIN known ON known.digest = sha256({_sql_canonical("line")}) GROUP BY r)
SELECT d.doc_id, d.text_digest, k.license AS text_license, CAST(coalesce(f.n, 0) AS BIGINT) AS n_notices, coalesce(f.names, '') AS notice_licenses
FROM (SELECT r, doc_id, sha256({_sql_canonical("text")}) AS text_digest FROM docs) d
LEFT JOIN known k ON k.digest = d.text_digest LEFT JOIN found f ON f.r = d.r
"""


def query(spark, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents"))
