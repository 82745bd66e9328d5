"""License scans with DataFrame functions only.

For each template, windows overlap so that one of them holds every stretch of the template's length whole and has at
most half as many shingles again. A window's MinHash values are bands of one row: a window that holds 80 % of a
template's shingles has a Jaccard similarity of at least .8 / 1.7 with it and so collides in one of BANDS bands with a
probability above 1 - 1e-5. Exact containment of the template's shingles in the window decides.

Texts without any anchor word are passed by before windows are made. Anchors are picked from the templates so that
less than 80 % of any template's shingles have none: a match cannot lack them.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

WIDTH, PERCENT, BANDS = 5, 80, 20

# Sentences by which works state their license.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
    "LGPL-header": "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "AGPL-header": "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


# Whole texts of licenses, and whole notices of those whose texts are longer, without their copyright lines.
BSD_CONDITIONS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
TEMPLATES |= {
    "MIT-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause-text": BSD_CONDITIONS + "\n" + BSD_DISCLAIMER,
    "BSD-3-Clause-text": f"""{BSD_CONDITIONS}
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
{BSD_DISCLAIMER}""",
    "Zlib-text": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "Unlicense-text": """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "Apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "GPL-3.0-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
}


def template_words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def anchors(templates: dict[str, str], percent: int = PERCENT, width: int = WIDTH) -> list[str]:
    """Words, the fewest a greedy choice finds, preferring long ones, such that in no template `percent` of the
    shingles are without them."""
    chosen: set[str] = set()
    for text in templates.values():
        words = template_words(text)
        grams = [words[i : i + width] for i in range(len(words) - width + 1)]
        while 100 * sum(not chosen & set(g) for g in grams) >= percent * len(grams):
            bare = [g for g in grams if not chosen & set(g)]
            chosen.add(max(sorted(set(words)), key=lambda w: (len(w) > 5, sum(w in g for g in bare), len(w))))
    return sorted(chosen)


def shingle_hashes(words: Column) -> Column:
    n = F.size(words) - WIDTH + 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.xxhash64(F.slice(words, i, WIDTH)))).otherwise(
        F.array().cast("array<bigint>")
    )


def minhashes(grams: Column) -> Column:
    def salted(k: int):  # a second parameter of a lambda would be the element's index
        return lambda g: F.xxhash64(g, F.lit(k))

    return F.array(*[F.array_min(F.transform(grams, salted(k))) for k in range(BANDS)])


def shape(text: str) -> tuple[int, int]:
    """Window length and step of a template, in shingles."""
    n = len(template_words(text)) - WIDTH + 1
    if n < 1:
        raise ValueError(f"a template has at least {WIDTH} words: {text}")
    step = max(1, n // 2)
    return n + step - 1, step


def template_table(spark, templates: dict[str, str]) -> DataFrame:
    """(license, wide, step, grams): window length and step in shingles; a template has at least WIDTH words."""
    rows = [(name, *shape(text), " ".join(template_words(text))) for name, text in templates.items()]
    made = spark.createDataFrame(rows, "license string, wide int, step int, words string")
    return made.select("license", "wide", "step", F.array_distinct(shingle_hashes(F.split("words", " "))).alias("grams"))


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, percent: int = PERCENT) -> DataFrame:
    """(doc_id, license, first_word, windows, containment): licenses that a text states, one row for each and text.

    first_word is the 0-based word at which the first matching window starts, containment the greatest share of the
    template's shingles in one window. Words are lower-case runs of letters and digits. Null, empty and short texts
    and empty tables have none; rows that are equal in doc_id and text are one. Templates are a parameter, so the
    table that is broadcast has a bounded size.
    """
    templates = templates or TEMPLATES
    known = template_table(docs.sparkSession, templates)
    words = F.array_remove(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), "")
    marks = anchors(templates)
    some = docs.where(F.lower("text").rlike("|".join(map(re.escape, marks)))).select("doc_id", F.xxhash64("text").alias("tk"), words.alias("words"))
    at = F.filter(F.transform("words", lambda w, i: F.when(w.isin(marks), i)), lambda i: i.isNotNull())
    some = some.select("doc_id", "tk", shingle_hashes(F.col("words")).alias("grams"), at.alias("marks"))
    shapes = sorted({shape(text) for text in templates.values()})
    shapes = F.explode(F.array(*[F.struct(F.lit(w).alias("wide"), F.lit(s).alias("step")) for w, s in shapes])).alias("shape")
    shaped = some.select("doc_id", "tk", "grams", "marks", shapes).select("doc_id", "tk", "grams", "marks", "shape.*")
    # Windows start at multiples of the step up to the last shingle, so the text's end is covered; those that hold an
    # anchor follow from its place. No filter stands on computed columns: pushed down, it would compute them again.
    first = lambda m: F.greatest(F.lit(0), F.ceil((m - F.col("wide") - WIDTH + 2) / F.col("step")).cast("int") * F.col("step"))
    last = lambda m: F.floor(F.least(m, F.size("grams") - 1) / F.col("step")).cast("int") * F.col("step")
    none = F.array().cast("array<int>")
    starts = F.transform("marks", lambda m: F.when(first(m) <= last(m), F.sequence(first(m), last(m), F.col("step"))).otherwise(none))
    slices = F.transform(F.array_distinct(F.flatten(starts)), lambda s: F.struct(s.alias("start"), F.slice(F.col("grams"), s + 1, F.col("wide")).alias("window")))
    windows = shaped.select("doc_id", "tk", "wide", "step", F.explode(slices).alias("w")).select("doc_id", "tk", "wide", "step", "w.*")
    hashed = windows.select("*", F.posexplode(minhashes(F.col("window"))).alias("band", "value"))
    bands = known.select("license", "wide", "step", "grams", F.posexplode(minhashes(F.col("grams"))).alias("band", "value"))
    met = hashed.join(F.broadcast(bands), ["wide", "step", "band", "value"])
    share = F.size(F.array_intersect("window", "grams")) / F.size("grams")
    hits = met.select("doc_id", "tk", "license", "start", share.alias("share")).where(F.col("share") * 100 >= percent)
    out = hits.groupBy("doc_id", "tk", "license").agg(
        F.min("start").cast("long").alias("first_word"), F.countDistinct("start").alias("windows"), F.max("share").alias("containment")
    )
    return out.drop("tk")


def op6_license_scan(spark, sf_dir):
    return scan_licenses(table(spark, sf_dir, "documents"))
