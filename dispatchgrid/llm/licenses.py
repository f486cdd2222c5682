"""Licence scan: units of text against licence templates by the Dice coefficient over word bigrams, in SQL functions only.

Units are a text's lines, its paragraphs (divided at blank lines) and the text itself, normalised to lower-case runs of
a-z and 0-9. A unit matches a template when 2 |A n B| / (|A| + |B|) >= THRESHOLD over their sets of word bigrams. Since the
shared set is no larger than the smaller one, |A| must lie within t/(2-t) and (2-t)/t of |B|: templates outside these
bounds are not compared. Before that, a text without any of the bigrams that every match would need (of each template, one
more than a match can do without) has no unit worth dividing, and one without any of the words of these isn't normalised.
All of it is one narrow projection; no row moves.

Nulls and empty texts: no units, no match. Null doc_id: kept. Repeated rows: each on its own. Ties: the template whose
name comes first. Very long texts: a unit of n distinct words has n - 1 distinct bigrams or more, so one with too many for
the largest bound is not compared with any template. An empty table gives no rows. Other columns are ignored by the query.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8

#: Notices, permission texts and disclaimers by SPDX identifier, one-line ones and those of several sentences.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    # Headers of source files, their first paragraph alone and as a whole, and what stands at the head of the licences.
    *(
        (f"{spdx}-or-later", text)
        for spdx, name, thing, version in (
            ("GPL-2.0", "GNU General Public License", "program", "either version 2 of the License"),
            ("GPL-3.0", "GNU General Public License", "program", "either version 3 of the License"),
            ("LGPL-2.1", "GNU Lesser General Public License", "library", "either version 2.1 of the License"),
            ("LGPL-3.0", "GNU Lesser General Public License", "program", "either version 3 of the License"),
            ("AGPL-3.0", "GNU Affero General Public License", "program", "either version 3 of the License"),
        )
        for first in (f"This {thing} is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, {version}, or (at your option) any later version.",)
        for text in (
            first,
            f"{first} This {thing} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details. You should have received a copy of the {name} along with this {thing}. If not, see <https://www.gnu.org/licenses/>.",
        )
    ),
    *(
        (spdx, f"{name} Version {version} Copyright (C) {year} Free Software Foundation, Inc. <https://fsf.org/> Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.")
        for spdx, name, version, year in (
            ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE", "2, June 1991", "1989, 1991"),
            ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE", "3, 29 June 2007", "2007"),
            ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE", "3, 29 June 2007", "2007"),
            ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE", "3, 19 November 2007", "2007"),
        )
    ),
    ("GPL-3.0", "The GNU General Public License is a free, copyleft license for software and other kinds of works."),
    ("GPL-3.0", "The licenses for most software and other practical works are designed to take away your freedom to share and change the works. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change all versions of a program--to make sure it remains free software for all its users. We, the Free Software Foundation, use the GNU General Public License for most of our software; it applies also to any other work released this way by its authors. You can apply it to your programs, too."),
    ("GPL-3.0", "When we speak of free software, we are referring to freedom, not price. Our General Public Licenses are designed to make sure that you have the freedom to distribute copies of free software (and charge for them if you wish), that you receive source code or can get it if you want it, that you can change the software or use pieces of it in new free programs, and that you know you can do these things."),
    ("BSD-3-Clause", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)"),
    ("ISC", "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
)


def bigrams_of(text: str) -> list[str]:
    w = re.sub("[^a-z0-9]+", " ", text.lower()).split()
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:], strict=False)))


def anchors(templates=TEMPLATES, t: float = THRESHOLD) -> list[str]:
    """Bigrams of which a matching unit has at least one: of each template one more than a match can miss, those with the
    longest words first, since these are rare elsewhere."""
    out: dict[str, None] = {}
    for _, x in templates:
        own = sorted(bigrams_of(x), key=lambda b: (b not in out, -max(map(len, b.split(" "))), b))
        least = math.ceil(t * len(own) / (2 - t) - 1e-9)
        for b in own[: len(own) - least + 1]:
            out[b] = None
    return list(out)


def signs(bigrams: list[str], least: int = 6) -> tuple[list[str], list[str]]:
    """Words of `least` letters or more, found greedily, such that each bigram holds one of them, and the bigrams that have
    no word of that length."""
    words, left = [], [b.split(" ") for b in bigrams if max(map(len, b.split(" "))) >= least]
    while left:
        best = min({w for b in left for w in b if len(w) >= least}, key=lambda w: (-sum(any(w in x for x in b) for b in left), -len(w), w))
        words.append(best)
        left = [b for b in left if not any(best in x for x in b)]
    return words, [b for b in bigrams if max(map(len, b.split(" "))) < least]


def _unit_best(unit: Column, table: Column, t: float) -> Column:
    """The best (dice, negative place, id) over templates within the size bounds; null where none reaches t."""
    words = F.filter(F.split(unit, " "), lambda w: w != "")
    grams = F.transform(F.array(words), lambda w: F.array_distinct(F.when(F.size(w) > 1, F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.concat(F.get(w, i), F.lit(" "), F.get(w, i + 1)))).otherwise(F.array().cast("array<string>"))))
    scored = F.transform(
        grams,
        lambda g: F.array_max(
            F.filter(
                F.transform(
                    F.filter(table, lambda x: (F.size(g) * (2 - t) >= x["n"] * t) & (F.size(g) * t <= x["n"] * (2 - t))),
                    lambda x: F.struct((F.lit(2.0) * F.size(F.array_intersect(x["grams"], g)) / (x["n"] + F.size(g))).alias("dice"), x["rank"].alias("rank"), x["id"].alias("id")),
                ),
                lambda s: s["dice"] >= t,
            )
        ),
    )
    return F.get(scored, F.lit(0))


def scan(docs: DataFrame, templates=TEMPLATES, t: float = THRESHOLD) -> DataFrame:
    """doc_id, license, dice, n_matches: the best template of any unit, and how many units match one."""
    parts = [(i, n, bigrams_of(x)) for n, (i, x) in enumerate(sorted(templates))]
    table = F.array(*(F.struct(F.lit(i).alias("id"), F.lit(-n).alias("rank"), F.lit(len(g)).alias("n"), F.array(*map(F.lit, g)).alias("grams")) for i, n, g in parts))
    widest = int(max(len(g) for *_, g in parts) * (2 - t) / t + 1e-9)
    needed = anchors(templates, t)
    pattern = "|".join(map(re.escape, needed)).replace("\\ ", " ")
    low = F.lower(F.coalesce("text", F.lit("")))
    some = docs.select("doc_id", low.alias("low"))
    words, short = signs(needed)
    worth = F.lit(False)
    for w in words:
        worth = worth | F.contains(F.col("low"), F.lit(w))
    if short:
        worth = worth | F.col("low").rlike("|".join(b.replace(" ", "[^a-z0-9]+") for b in short))
    norm = some.select("doc_id", F.when(worth, F.regexp_replace("low", r"[^a-z0-9\n]+", " ")).otherwise("").alias("norm"))
    # Line feeds stay for dividing; a unit's own line feeds become blanks.
    flat = lambda u: F.translate(u, "\n", " ")
    lines = F.split("norm", "\n", -1)
    paragraphs = F.when(F.col("norm").rlike(r"\n ?\n"), F.split("norm", r"\n ?\n[ \n]*", -1)).otherwise(F.array().cast("array<string>"))
    whole = F.when(F.instr("norm", "\n") > 0, F.array("norm")).otherwise(F.array().cast("array<string>"))
    narrow = lambda u: F.size(F.array_distinct(F.split(F.btrim(u), " +"))) <= widest + 1
    near = F.filter(F.transform(F.concat(lines, paragraphs, whole), flat), lambda u: u.rlike(pattern))
    near = F.filter(near, narrow)
    best = F.filter(F.transform(near, lambda u: _unit_best(u, table, t)), lambda s: s.isNotNull())
    found = norm.select("doc_id", F.when(flat(F.col("norm")).rlike(pattern), best).alias("found"))
    top = F.array_max("found")
    return found.select("doc_id", top["id"].alias("license"), F.round(top["dice"], 6).alias("dice"), F.coalesce(F.size("found"), F.lit(0)).cast("long").alias("n_matches"))


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v + "'" for v in values) + "]"


#: Every unit against every template, without bounds or anchors.
ORACLE = f"""
with t as (select * from (values {", ".join(f"({n}, '{i}', {_sql_list(bigrams_of(x))})" for n, (i, x) in enumerate(sorted(TEMPLATES)))}) as v(rank, id, grams)),
d as (select doc_id, regexp_replace(lower(coalesce(text, '')), '[^a-z0-9\\n]+', ' ', 'g') as norm from documents),
u as (select doc_id, unnest(string_split(norm, chr(10))) as unit from d
      union all select doc_id, unnest(regexp_split_to_array(norm, '\\n ?\\n[ \\n]*')) from d where regexp_matches(norm, '\\n ?\\n')
      union all select doc_id, norm from d where contains(norm, chr(10))),
w as (select doc_id, list_filter(string_split(replace(unit, chr(10), ' '), ' '), lambda x: x <> '') as words from u),
g as (select doc_id, list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) as grams from w where len(words) > 1),
s as (select doc_id, id, rank, 2.0::double * len(list_intersect(g.grams, t.grams)) / (len(g.grams) + len(t.grams)) as dice, g.grams as unit_grams from g, t),
b as (select doc_id, max(dice) as dice, arg_max(id, (dice, -rank)) as id, min(-rank) as r from s where dice >= {THRESHOLD} group by doc_id, unit_grams),
m as (select doc_id, arg_max(id, (dice, r)) as license, max(dice) as dice from b group by doc_id),
k as (select g.doc_id, count(*)::bigint as n_matches from g where exists (select 1 from b where b.doc_id = g.doc_id)
      and (select max(2.0::double * len(list_intersect(g.grams, t.grams)) / (len(g.grams) + len(t.grams))) from t) >= {THRESHOLD} group by g.doc_id)
select documents.doc_id, m.license, round(m.dice, 6) as dice, coalesce(k.n_matches, 0)::bigint as n_matches
from documents left join m on m.doc_id = documents.doc_id left join k on k.doc_id = documents.doc_id"""
