"""Licence notices by the Dice coefficient of word bigrams, by DataFrame functions only.

Whole texts are normalised to ASCII words, so line breaks, comment marks and what stands around a notice don't matter.
Of a text's bigrams only those of templates are looked at further: wherever one stands, the windows from it that are as
long as the template, and a fifth longer, are compared with the template, up to the last bigram that they share. Size
bounds prune first: a coefficient of T allows sizes within (2 - T) / T of each other, so a text must hold so many
of a template's bigrams, and a window must be so long. Before that, only texts with one of the templates' anchor words
are taken apart; so many bigrams of a template hold an anchor that a text without any can't reach the threshold.
"""

from __future__ import annotations

import re
from fractions import Fraction
from math import ceil, floor

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage, texts_of

THRESHOLD = 0.8
_WARRANTY = "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
_BSD_TWO = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
#: Public licence notices.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "MIT": (
        "Released under the MIT License.", "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        f"The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_WARRANTY} IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", _GNU.format("General Public License")),
    "GPL-2.0": ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",),
    "LGPL-3.0": ("This library is licensed under the GNU Lesser General Public License, version 3.", _GNU.format("Lesser General Public License")),
    "AGPL-3.0": ("This work is licensed under the GNU Affero General Public License, version 3.", _GNU.format("Affero General Public License")),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    "EPL-2.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0",),
    "BSD-2-Clause": ("Released under the BSD 2-Clause License.",),
    "BSD-3-Clause": (_BSD, "Released under the BSD 3-Clause License.", f"{_BSD}{_BSD_TWO} Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "Zlib": ("This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",),
    "BSL-1.0": ("Distributed under the Boost Software License, Version 1.0.", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software"),
    "Unlicense": ("This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
}


def words_of(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def bigrams(text: str) -> set[str]:
    w = words_of(text)
    return {f"{a} {b}" for a, b in zip(w, w[1:])}


def _templates() -> list[tuple[int, str, set[str]]]:
    return [(i, name, bigrams(t)) for i, (name, t) in enumerate((n, t) for n, ts in TEMPLATES.items() for t in ts)]


def anchors() -> list[str]:
    """Words so chosen, longest first, that more of each template's bigrams hold one than a match may lack."""
    chosen: set[str] = set()
    for _, _, own in _templates():
        may_lack = len(own) - THRESHOLD / (2 - THRESHOLD) * len(own)
        for w in sorted({w for b in own for w in b.split()}, key=lambda w: (-(w in chosen), -len(w), w)):
            if sum(any(x in chosen for x in b.split()) for b in own) > may_lack:
                break
            chosen.add(w)
    return sorted(chosen)


def bounds(n: int) -> tuple[int, int]:
    """Sizes of bigram sets that can reach the threshold with a template of n bigrams."""
    t = Fraction(str(THRESHOLD))
    return ceil(n * t / (2 - t)), floor(n * (2 - t) / t)


def _rows() -> list[tuple]:
    """(gram, template, licence, n_t, low, high) for each bigram of each template."""
    return [(b, i, name, len(own), *bounds(len(own))) for i, name, own in _templates() for b in sorted(own)]


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, licences, n_matches, best): a row for each row of docs.

    ``licences`` are the names found, in order, comma-joined; ``n_matches`` counts the templates found; ``best`` is the
    largest coefficient, to six places. A template is compared with every window that begins and ends with one of its
    bigrams and has a size within its bounds; it stands for its best window, the first of equal ones, and gives way to
    another whose best window overlaps that one and is better, so a notice isn't told as its near relations too. A
    window's size is the number of its bigrams, repeated ones included. Null and empty texts, and texts without notices,
    have '', 0 and 0. Repeated rows give repeated results; ids may be null.
    """
    docs = texts_of(docs)
    rows = _rows()
    grams = F.broadcast(docs.sparkSession.createDataFrame(rows, "gram string, template int, licence string, n_t int, low int, high int"))  # as many as TEMPLATES holds
    known = sorted({r[0] for r in rows})
    low = F.lower("text")
    words = F.split(F.trim(F.regexp_replace(low, "[^a-z0-9]+", " ")), " ")
    begins = sorted({g.split(" ")[0] for g in known})
    places = F.filter(F.sequence(F.lit(0), F.size("w") - 2), lambda i: F.get("w", i).isin(*begins))
    pairs = F.transform(places, lambda i: F.struct(i.alias("pos"), F.concat_ws(" ", F.get("w", i), F.get("w", i + 1)).alias("gram")))
    hits = F.when(F.size("w") > 1, F.filter(pairs, lambda x: x["gram"].isin(*known)))
    none = F.array().cast("array<struct<pos:int,gram:string>>")
    # numbers that the written table holds, so they are the same whenever it is read; texts stay behind
    w = F.when(low.rlike("(" + "|".join(anchors()) + ")"), words)
    seen = stage(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", w.alias("w")).select("row", "doc_id", F.coalesce(hits, none).alias("hits")), "bigrams")
    held = seen.where(F.size("hits") >= min(r[4] for r in rows)).select("row", F.explode("hits").alias("hit")).select("row", "hit.*").join(grams, "gram")
    # where the same bigram stood before, in the partitioning that the groups need anyway
    w = Window.partitionBy("row", "template").orderBy("gram", "pos")
    held = held.withColumn("prev", F.when(F.lag("gram").over(w) == F.col("gram"), F.lag("pos").over(w)))
    of = held.groupBy("row", "template").agg(*(F.first(c).alias(c) for c in ("licence", "n_t", "low", "high")), F.array_sort(F.collect_list(F.struct("pos", "prev"))).alias("hits"), F.count_if(F.col("prev").isNull()).alias("distinct"))
    of = of.where(F.col("distinct") >= F.col("low")).drop("distinct")
    kind = "struct<dice:double,before:int,n_b:int>"

    def longer(first):  # one hit more: a bigram that is new since the first hit counts, and a window may end here
        def step(seen, x):
            both = seen["both"] + F.when(x["prev"] >= first, 0).otherwise(1)
            n_b = x["pos"] - first + 1
            now = F.struct((2 * both / (n_b + F.col("n_t"))).alias("dice"), (-first).alias("before"), n_b.alias("n_b")).cast(kind)
            return F.struct(both.alias("both"), F.when(n_b >= F.col("low"), F.greatest(seen["best"], now)).otherwise(seen["best"]).alias("best"))

        return step

    def window(i):  # the hits are ordered by place, so no more than ``high`` of them are near enough
        first = F.get("hits", i)["pos"]
        near = F.filter(F.slice("hits", i + 1, F.col("high")), lambda x: x["pos"] < first + F.col("high"))
        none = F.struct(F.lit(0).alias("both"), F.lit(None).cast(kind).alias("best"))
        return F.when(F.size(near) >= F.col("low"), F.aggregate(near, none, longer(first))["best"])

    best = of.select("row", "template", "licence", F.array_max(F.transform(F.sequence(F.lit(0), F.size("hits") - 1), window)).alias("m"))
    dice = best.where(F.col("m.dice") >= THRESHOLD).select("row", "licence", "m.dice", (-F.col("m.before")).alias("pos"), (F.col("m.n_b") - F.col("m.before") - 1).alias("stop"))
    dice = stage(dice, "notices")  # no more than a row for each text and template
    other = dice.toDF("other_row", "other", "other_dice", "other_pos", "other_stop")
    dice = dice.join(other, (F.col("row") == F.col("other_row")) & (F.col("other_dice") > F.col("dice")) & (F.col("other_pos") <= F.col("stop")) & (F.col("pos") <= F.col("other_stop")), "left_anti")
    found = dice.groupBy("row").agg(F.concat_ws(",", F.array_sort(F.collect_set("licence"))).alias("licences"), F.count("*").alias("n_matches"), F.round(F.max("dice"), 6).alias("best"))
    out = seen.select("row", "doc_id").join(found, "row", "left")
    return out.select("doc_id", F.coalesce("licences", F.lit("")).alias("licences"), F.coalesce("n_matches", F.lit(0)).cast("long").alias("n_matches"), F.coalesce("best", F.lit(0.0)).alias("best"))


def oracle_sql() -> str:
    """The same windows by a join of each text's hits with one another, without anchors."""
    rows = ", ".join(f"('{b}', {i}, '{name}', {n_t}, {low}, {high})" for b, i, name, n_t, low, high in _rows())
    return rf"""
WITH t(gram, template, licence, n_t, low, high) AS (VALUES {rows}),
d AS (SELECT doc_id, coalesce(text, '') AS x, row_number() OVER () AS own FROM documents),
w AS (SELECT own, string_split(trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM d),
g AS (SELECT own, unnest(range(1, len(w))) AS pos, unnest([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) AS gram FROM w WHERE len(w) > 1),
h AS MATERIALIZED (SELECT *, lag(pos) OVER (PARTITION BY own, template, gram ORDER BY pos) AS prev FROM g JOIN t USING (gram)),
s AS (SELECT a.own, a.template, a.licence, a.n_t, a.low, a.high, a.pos, b.pos - a.pos + 1 AS n_b, count(*) FILTER (b.prev IS NULL OR b.prev < a.pos) OVER (PARTITION BY a.own, a.template, a.pos ORDER BY b.pos) AS n_both
  FROM h AS a JOIN h AS b ON a.own = b.own AND a.template = b.template AND b.pos >= a.pos AND b.pos < a.pos + a.high),
x AS (SELECT own, template, licence, pos, pos + n_b - 1 AS stop, n_b, 2.0 * n_both / (n_b + n_t) AS dice FROM s WHERE n_b BETWEEN low AND high),
m AS (SELECT * FROM x WHERE dice >= {THRESHOLD} QUALIFY row_number() OVER (PARTITION BY own, template ORDER BY dice DESC, pos, n_b DESC) = 1),
o AS (SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM m AS b WHERE b.own = m.own AND b.dice > m.dice AND b.pos <= m.stop AND m.pos <= b.stop)),
f AS (SELECT own, string_agg(DISTINCT licence, ',' ORDER BY licence) AS licences, count(*) AS n_matches, round(max(dice), 6) AS best FROM o GROUP BY own)
SELECT d.doc_id, coalesce(licences, '') AS licences, coalesce(n_matches, 0) AS n_matches, CAST(coalesce(best, 0) AS DOUBLE) AS best FROM d LEFT JOIN f USING (own)"""
