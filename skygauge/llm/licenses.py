"""Licence scan: units of text compared with licence templates by Dice over word bigrams.

A text is normalised (lower case, everything but letters and digits as one blank) and looked at
in four kinds of units: sentences, paragraphs, the whole, and runs of words of the whole, whatever
sentences, lines and paragraphs they cover. A run begins where a template would begin if an anchor of it (see
below) stood at its place in the template, and has one of RUN_SHARES of the template's length; of runs that
overlap and are alike in size, the best is given. The coefficient is
2 * common / (unit's bigrams + template's bigrams), over distinct bigrams. A unit of n bigrams can
only reach the threshold t against templates of n * t / (2 - t) to n * (2 - t) / t bigrams, so
sizes prune the templates a unit is compared with. Before that, a document is skipped if it has
none of the anchors of any template: a template's anchors are so many of its bigrams that a
unit without them cannot reach the threshold (exact, no candidate is lost).

All expressions are the engine's own, and no row is shuffled.

Defined results: null and empty texts and texts of one word have no bigrams and match nothing; a
repeated row has its own matches; of templates with the same score, the first name wins for a
unit; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from math import ceil, floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST = 0.8
#: Lengths of runs, in parts of a template's: from one end of the size bounds at 0.8 to the other.
RUN_SHARES = (0.7, 0.85, 1.0, 1.2, 1.45)

_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
    "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
    "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
    "distribution. {} THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED "
    "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR "
    "PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, "
    "INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
    "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
    "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF "
    "THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the {0} as published by "
    "the Free Software Foundation, either {1} of the License, or (at your option) any later version. This program is "
    "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
    "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {0} for more details."
)
#: Texts of public licences and of the usual notices.
TEMPLATES = {
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "MIT-line": "Released under the MIT License.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all "
        "copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY "
        "KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A "
        "PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
        "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF "
        "OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE "
        "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR "
        "ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, "
        "DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
        "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be "
        "held liable for any damages arising from the use of this software. Permission is granted to anyone to use "
        "this software for any purpose, including commercial applications, and to alter it and redistribute it freely, "
        "subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must "
        "not claim that you wrote the original software. If you use this software in a product, an acknowledgment in "
        "the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly "
        "marked as such, and must not be misrepresented as being the original software. 3. This notice may not be "
        "removed or altered from any source distribution."
    ),
    "Apache-2.0-notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the "
        "specific language governing permissions and limitations under the License."
    ),
    "GPL-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU "
        "General Public License for more details."
    ),
    "MPL-2.0-notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "BSD-2-Clause": _BSD.format(""),
    "BSD-3-Clause": _BSD.format(
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission."
    ),
    "BSL-1.0": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and "
        "accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, "
        "execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties "
        "to whom the Software is furnished to do so, all subject to the following:"
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, "
        "use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
        "purpose, commercial or non-commercial, and by any means."
    ),
    "GPL-2.0-notice": _GNU.format("GNU General Public License", "version 2"),
    "LGPL-2.1-notice": _GNU.format("GNU Lesser General Public License", "version 2.1"),
    "LGPL-3.0-notice": _GNU.format("GNU Lesser General Public License", "version 3"),
    "AGPL-3.0-notice": _GNU.format("GNU Affero General Public License", "version 3"),
}

NOT_WORD = r"[^\p{L}\p{N}]+"
SENTENCE_END = r"\n+|(?<=[.!?])\s+"
PARAGRAPH_END = r"\n[ \t]*\n+"


def template_pairs(text: str) -> list[str]:
    """Bigrams of a template in order, in the form of the scan."""
    words = re.sub(r"[\W_]+", " ", text.lower()).split()
    return [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def template_bigrams(text: str) -> list[str]:
    """Distinct bigrams of a template."""
    return list(dict.fromkeys(template_pairs(text)))


def anchors(bigrams: list[str], least: float) -> list[str]:
    """The longest bigrams, as many as no matching unit can be without.

    A match shares at least n * least / (2 - least) of the template's n bigrams.
    """
    must = ceil(len(bigrams) * least / (2 - least) - 1e-9)
    return sorted(bigrams, key=lambda b: (-len(b), b))[: len(bigrams) - must + 1]


def any_of(phrases: list[str]) -> str:
    """A pattern that finds any phrase, with common beginnings written once."""
    by: dict[str, list[str]] = {}
    for phrase in phrases:
        by.setdefault(phrase[:1], []).append(phrase[1:])
    if set(by) == {""}:
        return ""
    branches = [
        "(?= |$)" if first == "" else re.escape(first) + any_of(rest) for first, rest in sorted(by.items(), reverse=True)
    ]
    return branches[0] if len(branches) == 1 else f"(?:{'|'.join(branches)})"


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), NOT_WORD, " "))


def pairs_of(unit: Column) -> Column:
    """Bigrams of a unit in order."""
    words = F.split(normalised(unit), " ")
    return F.zip_with(
        F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))),
        F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))),
        lambda a, b: F.concat(a, F.lit(" "), b),
    )


def bigrams(unit: Column) -> Column:
    """Distinct bigrams of a unit."""
    return F.array_distinct(pairs_of(unit))


def runs_of(name: str, text: str, least: float) -> Column:
    """Runs that match one template, from ``_pairs`` (bigrams in order) and ``_hits`` (anchors in them)."""
    pairs, known = template_pairs(text), template_bigrams(text)
    own = anchors(known, least)
    # An anchor that stands in the template more than once gives a start for each place.
    places = [(b, k) for k, b in enumerate(pairs) if b in set(own)]
    table = F.array(*[F.struct(F.lit(b).alias("b"), F.lit(k).alias("k")) for b, k in places])
    lengths = sorted({max(1, round(share * len(pairs))) for share in RUN_SHARES})

    def begins(hit: Column) -> Column:
        return F.transform(F.filter(table, lambda p: p["b"] == hit["b"]), lambda p: F.greatest(hit["i"] - p["k"], F.lit(0)))

    def run(start: Column, length: int) -> Column:
        cut = F.array_distinct(F.slice("_pairs", start + 1, F.lit(length)))
        common = F.size(F.array_intersect(cut, F.array(*map(F.lit, known))))
        return F.struct(
            (2.0 * common / (F.size(cut) + len(known))).alias("dice"), F.lit(name).alias("license"),
            start.alias("position"), F.size(cut).alias("bigrams"), F.lit(length).alias("length"),
        )

    hits = F.filter("_hits", lambda h: h["b"].isin(own))
    starts = F.array_distinct(F.flatten(F.transform(hits, begins)))
    found = F.flatten(F.transform(starts, lambda s: F.array(*[run(s, n) for n in lengths])))
    return F.filter(found, lambda x: x["dice"] >= least - 1e-12)


def runs(docs: DataFrame, templates: dict[str, str], least: float) -> DataFrame:
    """Matching runs of words of ``docs``, which have anchors: the columns of ``scan``; position counts words."""
    made = [runs_of(name, text, least) for name, text in sorted(templates.items())]
    all_anchors = {a for text in templates.values() for a in anchors(template_bigrams(text), least)}
    better_first = F.array_sort(
        F.flatten(F.array(*made)),
        lambda a, b: F.when(a["dice"] != b["dice"], F.when(a["dice"] > b["dice"], -1).otherwise(1))
        .when(a["license"] != b["license"], F.when(a["license"] < b["license"], -1).otherwise(1))
        .otherwise(F.signum(a["position"] - b["position"]).cast("int")),
    )
    alike = lambda x, y: (
        (x["position"] < y["position"] + y["length"]) & (y["position"] < x["position"] + x["length"])
        & (3 * x["length"] >= 2 * y["length"]) & (3 * y["length"] >= 2 * x["length"])
    )
    kept = F.aggregate(
        "_found",
        F.slice("_found", F.lit(1), F.lit(0)),
        lambda kept, x: F.when(F.exists(kept, lambda y: alike(x, y)), kept).otherwise(F.concat(kept, F.array(x))),
    )
    hits = F.filter(
        F.transform("_pairs", lambda b, i: F.struct(b.alias("b"), i.alias("i"))), lambda h: h["b"].isin(sorted(all_anchors))
    )
    return (
        docs.withColumn("_pairs", pairs_of(F.col("text")))
        .withColumn("_hits", hits)
        .withColumn("_found", better_first)
        .select("doc_id", F.explode(kept).alias("r"))
        .select("doc_id", F.lit("run").alias("unit"), "r.position", "r.license", "r.dice", "r.bigrams")
    )


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """Matching units: doc_id, unit (sentence, paragraph, text or run), position, license, dice, bigrams."""
    known = {name: template_bigrams(text) for name, text in sorted(templates.items())}
    phrases = sorted({a for b in known.values() for a in anchors(b, least)})
    anchor = f"(?:^| ){any_of(phrases)}"
    longest = floor(max(map(len, known.values())) * (2 - least) / least + 1e-9)

    def units(kind: str, parts: Column) -> Column:
        return F.transform(
            parts, lambda p, i: F.struct(F.lit(kind).alias("unit"), i.alias("position"), bigrams(p).alias("own"))
        )

    text = F.col("text")
    anchored = docs.select("doc_id", "text").filter(normalised(text).rlike(anchor))
    found = (
        anchored.select(
            "doc_id",
            F.explode(
                F.concat(
                    units("sentence", F.split(text, SENTENCE_END)),
                    units("paragraph", F.split(text, PARAGRAPH_END)),
                    units("text", F.array(text)),
                )
            ).alias("u"),
        )
        .select("doc_id", "u.*", F.size("u.own").alias("bigrams"))
        .filter((F.col("bigrams") > 0) & (F.col("bigrams") <= longest))
    )

    def score(name: str, of: list[str]) -> Column:
        low, high = len(of) * least / (2 - least), len(of) * (2 - least) / least
        common = F.size(F.array_intersect("own", F.array(*map(F.lit, of))))
        dice = F.when(
            F.col("bigrams").between(F.lit(low - 1e-9), F.lit(high + 1e-9)), 2.0 * common / (F.col("bigrams") + len(of))
        )
        return F.struct(F.coalesce(dice, F.lit(0.0)).alias("dice"), F.lit(name).alias("license"))

    scores = F.array(*[score(n, b) for n, b in known.items()])
    best = F.aggregate(
        scores,
        F.struct(F.lit(0.0).alias("dice"), F.lit("").alias("license")),
        lambda a, b: F.when(b["dice"] > a["dice"], b).otherwise(a),
    )
    matching = (
        found.withColumn("best", best)
        .filter(F.col("best.dice") >= least - 1e-12)
        .select("doc_id", "unit", "position", F.col("best.license").alias("license"), F.col("best.dice").alias("dice"), "bigrams")
    )
    return matching.unionByName(runs(anchored, templates, least))
