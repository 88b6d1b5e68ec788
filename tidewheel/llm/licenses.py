"""License scans in DataFrame operations only: TF-IDF cosine to templates, then inheritance from the nearest licence file above.

Passages are the lines of every whole text, the licence lines of a file taken
together, and windows of a template's length that run over line ends, so what
else stands in a notice's line does not count. Windows start at every term for
templates of up to 31 terms and at every 16th part of the length for longer
ones. A passage is a sparse vector over all its terms; a term's weight is its
count times its inverse document frequency in the files scanned, where a term
that no template has weighs like one that no file holds, so prose around a
licence's name lengthens the vector and lowers the cosine. By the
Cauchy-Schwarz inequality a passage whose cosine to a template reaches the
threshold must hold terms with at least the threshold's square of the
template's squared norm, so one of its rarest terms, those without which the
rest stays below; only files, lines and windows with such terms are scored,
and none that could match is left out.

A licence has several templates: its one-sentence notice, its full text or
opening, its publisher's header and its SPDX line. An SPDX line must be there
with all its terms, as it differs from others by the identifier alone; in an
expression of several the first counts.

A file without a licence of its own takes that of the nearest ancestor
directory that has a licence file. Directories, not files, are joined with
their ancestors, so a directory with very many files costs one row.

What is broadcast are the templates' terms and, if few, the licensed
directories.

Defined cases: null text has no lines, a null path is the root's file "";
repeated rows are each reported; of equal cosines the earliest line, then the
earliest term, then the first template by name, wins, and the licence lines
together come after all lines; of several licence files in a directory the
first by path, then by a hash of the text; texts of any length are scanned
whole, cut into blocks of ``BLOCK`` window starts; empty tables give an empty
result; further columns are ignored.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.llm import common

# Notices as the licences themselves or their publishers word them (fixed values).
TEMPLATES = {
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": "Licensed under the BSD 2-Clause Simplified License.",
    "BSD-3-Clause": "Licensed under the BSD 3-Clause New or Revised License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright under CC0 1.0 Universal.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Released under the ISC License.",
    "LGPL-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR
PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR
TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
POSSIBILITY OF SUCH DAMAGE."""
_BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions
and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of
conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission."""


def _gnu(kind: str, version: str, what: str = "program") -> str:
    return f"""This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} License as
published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. This
{what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} License for more details. You should have received a
copy of the GNU {kind} License along with this {what}."""


def _fsf(head: str, years: str) -> str:
    return f"{head} Copyright (C) {years} Free Software Foundation, Inc."


# Licence texts in full (MIT, ISC, BSD, Unlicense) or their opening, and the headers their publishers ask for.
TEXTS = {
    "AGPL-3.0": (_gnu("Affero General Public", "3"), _fsf("GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007", "2007")),
    "Apache-2.0": (
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or
agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and
limitations under the License.""",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    ),
    "BSD-2-Clause": (f"{_BSD_2} {_DISCLAIMER}", f"{_BSD_2} {_DISCLAIMER[:72]}"),  # with the disclaimer's start, as the conditions alone open BSD-3-Clause too
    "BSD-3-Clause": (f"{_BSD_2} {_BSD_3} {_DISCLAIMER}", f"{_BSD_2} {_BSD_3}"),
    "CC-BY-4.0": ("Creative Commons Attribution 4.0 International Public License",),
    "CC-BY-NC-4.0": ("Creative Commons Attribution-NonCommercial 4.0 International Public License",),
    "CC-BY-SA-4.0": ("Creative Commons Attribution-ShareAlike 4.0 International Public License",),
    "CC0-1.0": ("Creative Commons Legal Code CC0 1.0 Universal CREATIVE COMMONS CORPORATION IS NOT A LAW FIRM AND DOES NOT PROVIDE LEGAL SERVICES.",),
    "GPL-2.0": (_gnu("General Public", "2"), _fsf("GNU GENERAL PUBLIC LICENSE Version 2, June 1991", "1989, 1991")),
    "GPL-3.0": (_gnu("General Public", "3"), _fsf("GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "2007")),
    "ISC": (
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND
THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION,
ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    "LGPL-2.1": (_gnu("Lesser General Public", "2.1", "library"), _fsf("GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999", "1991, 1999")),
    "MIT": (
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to
use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall
be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY
KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER
IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
DEALINGS IN THE SOFTWARE.""",
    ),
    "MPL-2.0": (
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
        """Mozilla Public License Version 2.0 1. Definitions 1.1. "Contributor" means each individual or legal entity that creates,
contributes to the creation of, or owns Covered Software.""",
    ),
    "Unlicense": (
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
non-commercial, and by any means.""",
    ),
}
#: Lines that differ by the identifier alone, so all of their terms must be there.
SPDX = "SPDX-License-Identifier: "
ALL_TEMPLATES = {name: (notice, *TEXTS[name], SPDX + name) for name, notice in TEMPLATES.items()}
THRESHOLD = 0.7
MAX_TERMS = 20_000
BROADCAST_ROWS = 300_000
_TERM = "[a-z0-9]+"
#: A template's windows start at every such part of its length; a text is cut into blocks of so many starts.
STEPS = 16
BLOCK = 512


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(common.ascii_lower(text), F.lit(f"({_TERM})"), 1)


def template_counts(templates: dict[str, str | tuple[str, ...]]) -> list[tuple[str, bool, Counter]]:
    """(licence, whether all terms must be there, counts of terms) of each template, in the licences' order."""
    listed = [(name, text) for name, texts in templates.items() for text in ((texts,) if isinstance(texts, str) else texts)]
    found = [(name, text.startswith(SPDX), Counter(re.findall(_TERM, text.translate(str.maketrans(common.UPPER, common.LOWER))))) for name, text in listed]
    return [t for t in found if t[2]]


def _held(terms: list[str], text: Column) -> Column:
    """Those of the terms that a text holds."""
    return F.array_intersect(_strings(terms), F.split(common.ascii_lower(text), "[^a-z0-9]+"))


def _strings(terms: list[str]) -> Column:
    return F.split(F.lit(" ".join(terms)), " ") if terms else F.array().cast("array<string>")


def document_frequencies(files: DataFrame, terms: list[str]) -> tuple[int, dict[str, int]]:
    """Files in all, and those that hold each of the templates' terms."""
    held = files.select(F.explode(F.concat(F.array(F.lit("")), _held(terms, F.col("text")))).alias("term"))
    got = {r.term: r.n for r in held.groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()}
    return got.pop("", 0), got


def anchors(weights: dict[str, float], df: dict[str, int], threshold: float) -> list[str]:
    """A template's rarest terms, until the rest of its norm is below the threshold."""
    out = []
    left = whole = sum(x * x for x in weights.values())
    for term, x in sorted(weights.items(), key=lambda p: (df.get(p[0], 0), -p[1], p[0])):
        if left < threshold**2 * whole * (1 - 1e-9):
            break
        out.append(term)
        left -= x * x
    return sorted(out)


def windows(hot: DataFrame, kinds: DataFrame, longest: int) -> DataFrame:
    """(path, mark, k, start, line, at, term): the terms of all windows of a hot template's length that hold one of its anchors.

    start is the window's first term in the text; line and at are that term's line and its place in it.
    """
    placed = F.flatten(F.transform(F.split(common.ascii_lower(F.col("text")), "\n"), lambda line, i: F.transform(F.regexp_extract_all(line, F.lit(f"({_TERM})"), 1), lambda t, j: F.struct(t.alias("term"), i.alias("line"), j.alias("at")))))
    blocks = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 1, F.lit(BLOCK)), lambda c: F.struct(c.alias("first"), F.slice(w, c + 1, BLOCK + longest).alias("w")))
    texts = hot.select("path", "mark", "hot", F.explode(F.array(placed)).alias("w")).where(F.size("w") > 0)
    parts = texts.select("path", "mark", "hot", F.explode(blocks(F.col("w"))).alias("block"))
    parts = parts.select("path", "mark", "block.first", "block.w", F.explode("hot").alias("k")).join(F.broadcast(kinds), "k")
    # Starts are multiples of the step in the text and lie in the block.
    near = F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.array_contains("anchors", F.col("w")[i]["term"]))
    up = lambda x: F.ceil(x / F.col("step")).cast("int") * F.col("step")
    low, high = (lambda i: up(F.greatest(F.lit(0), i + F.col("first") - F.col("length") + 1, F.col("first")))), (lambda i: F.least(i + F.col("first"), F.col("first") + (BLOCK - 1)))
    reach = lambda i: F.when(low(i) <= high(i), F.sequence(low(i), high(i), F.col("step"))).otherwise(F.array().cast("array<int>"))
    starts = parts.select("path", "mark", "k", "first", "w", "length", F.explode(F.array_distinct(F.flatten(F.transform(near, reach)))).alias("start"))
    held = F.slice("w", F.col("start") - F.col("first") + 1, F.col("length"))
    cut = starts.select("path", "mark", "k", "start", F.explode(F.array(held)).alias("held"))
    return cut.select("path", "mark", "k", "start", F.col("held")[0]["line"].alias("line"), F.col("held")[0]["at"].alias("at"), F.explode("held.term").alias("term"))


def own_licences(files: DataFrame, templates: dict[str, str | tuple[str, ...]], threshold: float) -> DataFrame:
    """(path, mark, licence, cosine, line, at): the best passage of each file that has one; mark tells texts of one path apart.

    line is the passage's line from 0, or -1 for the licence lines together; at
    is the line's term at which its first passage with that licence begins.
    """
    spark = files.sparkSession
    counts = template_counts(templates)
    terms = sorted({t for _, _, c in counts for t in c})
    if len(terms) > MAX_TERMS:
        raise ValueError(f"the templates have more than {MAX_TERMS} terms")
    n, df = document_frequencies(files, terms)
    idf = {t: math.log((1 + n) / (1 + df.get(t, 0))) + 1 for t in terms}
    weights = [(name, {t: k * idf[t] for t, k in c.items()}) for name, _, c in counts]
    norms = [math.sqrt(sum(x * x for x in w.values())) for _, w in weights]
    near = [anchors(w, df, threshold) for _, w in weights]
    lengths = [sum(c.values()) for _, _, c in counts]
    unseen = math.log(1 + n) + 1
    one = F.broadcast(common.local_table(spark, term=("string", list(idf)), idf=("double", list(idf.values()))))
    each = [(t, k, x / norms[k]) for k, (_, w) in enumerate(weights) for t, x in w.items()]
    many = F.broadcast(common.local_table(spark, term=("string", [e[0] for e in each]), k=("int", [e[1] for e in each]), weight=("double", [e[2] for e in each])))
    numbers = list(range(len(weights)))
    kinds = common.local_table(spark, k=("int", numbers), length=("int", lengths), step=("int", [max(1, x // STEPS) for x in lengths]), anchors=("array<string>", near))
    names = F.broadcast(common.local_table(spark, k=("int", numbers), licence=("string", [c[0] for c in counts]), least=("double", [1.0 if c[1] else threshold for c in counts])))

    def weighed(rows: DataFrame, key: list[str]) -> DataFrame:
        """The rows' terms by passage, with count and idf."""
        terms = rows.join(one, "term", "left").withColumn("idf", F.coalesce("idf", F.lit(unseen)))
        return terms.groupBy(*key, "term").agg(F.count(F.lit(1)).alias("tf"), F.first("idf").alias("idf"))

    # Files that can match: those with an anchor, then for each template those with enough of its norm.
    anchor = _strings(sorted({t for a in near for t in a}))
    some = files.where(F.arrays_overlap(anchor, F.split(common.ascii_lower(F.col("text")), "[^a-z0-9]+")))
    some = common.materialize(some.withColumn("held", _held(terms, F.col("text"))), "licence-candidates")
    shares = F.from_json(F.lit(json.dumps([{"k": k, "terms": [{"t": t, "x": (x / norms[k]) ** 2} for t, x in w.items()]} for k, (_, w) in enumerate(weights)])), "array<struct<k int, terms array<struct<t string, x double>>>>")
    share = lambda s: F.aggregate(s["terms"], F.lit(0.0), lambda a, y: a + F.when(F.array_contains("held", y["t"]), y["x"]).otherwise(0.0))
    hot = some.withColumn("hot", F.transform(F.filter(shares, lambda s: share(s) >= threshold**2 * (1 - 1e-9)), lambda s: s["k"])).where(F.size("hot") > 0)
    hot = common.materialize(hot.select("path", "mark", "hot", "text"), "licence-hot")

    lines = hot.select("path", "mark", F.posexplode(F.split("text", "\n")).alias("line", "passage"))
    lines = lines.where(F.arrays_overlap(anchor, F.split(common.ascii_lower(F.col("passage")), "[^a-z0-9]+")))
    single = weighed(lines.select("path", "mark", "line", F.explode(_terms(F.col("passage"))).alias("term")), ["path", "mark", "line"])
    whole = single.groupBy("path", "mark", F.lit(-1).alias("line"), "term").agg(F.sum("tf").alias("tf"), F.first("idf").alias("idf"))
    vectors = single.unionByName(whole).withColumn("x", F.col("tf") * F.col("idf"))
    # One row for each passage: its terms, and from them norm and products.
    key = ["path", "mark", "line"]
    norm = vectors.groupBy(*key).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    product = vectors.join(many, "term").groupBy(*key, "k").agg(F.sum(F.col("x") * F.col("weight")).alias("dot"))
    scored = product.join(norm, key).withColumn("at", F.lit(0))

    key = ["path", "mark", "k", "start", "line", "at"]
    cut = weighed(windows(hot, kinds, max(lengths, default=0)), key)
    cut = cut.join(many, ["k", "term"], "left").withColumn("x", F.col("tf") * F.col("idf"))
    inside = cut.groupBy(*key).agg(F.sum(F.col("x") * F.coalesce("weight", F.lit(0.0))).alias("dot"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))

    scored = scored.unionByName(inside.select(*scored.columns)).withColumn("cosine", F.round(F.col("dot") / F.col("norm"), 6))
    scored = scored.join(names, "k").where(F.col("cosine") >= F.col("least")).groupBy("path", "mark", "licence", "line").agg(F.max("cosine").alias("cosine"), F.min("at").alias("at"))
    order = F.struct(-F.col("cosine"), F.when(F.col("line") < 0, F.lit(2**31 - 1)).otherwise(F.col("line")), "at", "licence")
    return scored.groupBy("path", "mark").agg(F.min_by(F.struct("licence", "cosine", "line", "at"), order).alias("best")).select("path", "mark", "best.*")


def ancestors(directory: Column) -> Column:
    """The directory itself and all above it, the root "" last."""
    parts = F.split(directory, "/")
    up = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, F.size(parts) - k), "/"))
    return F.array_distinct(F.concat(up, F.array(F.lit(""))))


def licence_scan(files: DataFrame, path: Column, text: Column, is_licence_file: Column | None = None, templates: dict[str, str | tuple[str, ...]] | None = None, threshold: float = THRESHOLD, keep: list[str] | None = None) -> DataFrame:
    """The kept columns, path, own_licence, cosine, line, licence (own or inherited) and inherited_from, a directory.

    is_licence_file: a condition on path, line and at (see own_licences); without one, files named LICENSE, LICENCE, COPYING or NOTICE.
    """
    rows = files.select(*(keep or []), F.coalesce(path, F.lit("")).alias("path"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("mark", F.xxhash64("text"))
    with common.storage(files.sparkSession, "licences"):
        distinct = rows.select("path", "mark", "text")
        own = common.materialize(own_licences(distinct, templates or ALL_TEMPLATES, threshold), "licences")
    named = F.lower(F.element_at(F.split("path", "/"), -1)).rlike(r"^(licen[cs]e|copying|notice)(\.|$)")
    directory = lambda c: F.when(F.instr(c, "/") > 0, F.regexp_replace(c, "/[^/]*$", "")).otherwise("")
    above = own.where(named if is_licence_file is None else is_licence_file).groupBy(directory(F.col("path")).alias("above")).agg(F.min_by("licence", F.struct("path", "mark")).alias("given"))

    directories = rows.select(directory(F.col("path")).alias("directory")).distinct()
    climbed = directories.select("directory", F.posexplode(ancestors(F.col("directory"))).alias("far", "above"))
    inherited = climbed.join(above, "above").groupBy("directory").agg(F.min_by(F.struct("given", "above"), "far").alias("from"))
    inherited = common.materialize(inherited, "licence-directories")
    small = common.is_small(inherited, BROADCAST_ROWS)
    out = rows.drop("text").withColumn("directory", directory(F.col("path"))).join(F.broadcast(inherited) if small else inherited, "directory", "left")
    out = out.join(own.drop("at"), ["path", "mark"], "left")
    return out.select(
        *(keep or []), "path", F.col("licence").alias("own_licence"), "cosine", "line",
        F.coalesce("licence", "from.given").alias("licence"), F.when(F.col("licence").isNull(), F.col("from.above")).alias("inherited_from"),
    )


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents have no files, so source, language and hundreds of ids stand for directories; a document that opens with a notice is its directory's licence file."""
    docs = common.table(spark, sf_dir, "documents")
    part = lambda c: F.coalesce(F.regexp_replace(c, "/", "_"), F.lit("none"))
    path = F.concat_ws("/", part("source"), part("lang"), F.coalesce((F.col("doc_id").cast("bigint") / 100).cast("bigint").cast("string"), F.lit("none")), F.coalesce(F.col("doc_id").cast("string"), F.lit("none")))
    return licence_scan(docs, path, F.col("text"), is_licence_file=(F.col("line") == 0) & (F.col("at") == 0), keep=["doc_id"])
