"""Licence detection by Dice coefficient over word bigrams.

Texts and templates are normalised to lower-case ASCII words. A template matches a text by
its best window: a run of words anywhere in the whole text, over lines and amid other words,
whose set of bigrams has the greatest Dice coefficient with the template's, if that reaches
the threshold t. As 2 min(a, b) / (a + b) bounds the coefficient, a template with b bigrams
is passed over unless the text has t b / (2 - t) of them, and windows end where they have
over (2 - t) b / t different ones. A best window starts and ends with a bigram of the
template, doesn't repeat its first one, and has no new one of the template before it; all such
windows are compared, in texts of any length, word by word from their start: as a window ends
at the next bigram equal to its first, that is b times the text's words at most. From the same bound follow words of which any match must contain one; texts without
them are passed over, which loses no match.

Licences with similar wording match the same words: where windows of two licences overlap,
the one with the greater coefficient stays, of equal ones the name that sorts first.

Defined results: one row for each row of documents. Null, empty and short texts
match nothing: ``licences`` is '' and ``best_dice`` 0. Of equal windows the first counts.
Ties for the best licence go to the name that sorts first. Repeated rows give repeated
rows; an empty table gives none.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

THRESHOLD = 0.7

#: SPDX identifiers and common notices of public licences.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."),
]


#: Words too common to be worth looking for.
COMMON = set("a and any at be by for in is it may of or that the this to under with you".split())


def _words(text: str) -> list[str]:
    return "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()


def _bigrams(text: str) -> list[str]:
    w = _words(text)
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:])})


def needed_words(templates: list[tuple[str, str]], threshold: float) -> list[str]:
    """Words of which every match contains one. A match of a template with b bigrams
    shares at least t b / (2 - t) of them; so once the bigrams free of the chosen
    words are fewer, a match must touch a chosen word. Long and frequent words first."""
    sets = [set(_bigrams(text)) for _, text in templates]
    spread = Counter(w for s in sets for w in {x for b in s for x in b.split()})
    chosen: list[str] = []
    for s in sets:
        order = sorted({x for b in s for x in b.split()}, key=lambda w: (w in COMMON, w not in chosen, -min(len(w), 8), -spread[w], w))
        own: set[str] = set()
        for w in order:
            if sum(not own & {*b.split()} for b in s) < threshold / (2 - threshold) * len(s):
                break
            own.add(w)
        chosen += [w for w in sorted(own) if w not in chosen]
    return chosen


def _windows(whole: Column, after: Column, before: Column, sets: list[tuple[str, list[str]]], threshold: float) -> Column:
    """(dice, first, last, name) of the best window over ``whole``, a text's bigrams in
    order, for each template that reaches the threshold. ``after`` and ``before`` are the
    places of the next and the last equal bigram of each: one is new in a window if the last
    equal one lies before its start."""
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    each = F.array(*[F.struct(F.lit(n).alias("name"), F.array(*map(F.lit, b)).alias("b")) for n, b in sets if b])
    n = F.size(whole)
    held = F.filter(each, lambda t: F.size(F.array_intersect(t["b"], whole)) >= low * F.size(t["b"]))
    # Each transform binds what the next one's lambdas use more than once.
    held = F.transform(held, lambda t: F.struct(t["name"].alias("name"), F.size(t["b"]).alias("b"), F.transform(whole, lambda g: F.array_contains(t["b"], g)).alias("own")))

    def stop(i: Column, b: Column) -> Column:
        """Behind the last end of windows from ``i``: at the next equal bigram, or where
        they are known to have too many different ones."""
        most, reach = F.ceil(high * b).cast("int"), n
        for k in (256, 64, 16, 4, 2):
            new = F.size(F.filter(F.slice(before, i + 1, most * k), lambda p: p < i))
            reach = F.when(new > high * b, F.least(n, i + most * k)).otherwise(reach)
        again = F.get(after, i)
        return F.when(again - i <= 2 * most, again).otherwise(F.least(reach, again))

    starts = lambda t: F.transform(F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.get(t["own"], i)), lambda i: F.struct(i.alias("i"), stop(i, t["b"]).alias("stop")))
    held = F.transform(held, lambda t: F.struct(t["name"].alias("name"), t["b"].alias("b"), t["own"].alias("own"), F.transform(t["own"], lambda x, i: F.when(x, F.get(before, i)).otherwise(n)).alias("own_before"), starts(t).alias("starts")))

    def worth(s: Column, own: Column) -> Column:
        """A window gains by a new bigram of the template before it, so it starts behind
        another bigram or holds that one again."""
        return ~F.coalesce(F.get(own, s["i"] - 1), F.lit(False)) | (F.get(after, s["i"] - 1) < s["stop"])

    def scored(s: Column, b: Column, own: Column, own_before: Column) -> Column:
        def step(x: Column, p: Column) -> Column:
            new = F.get(before, p) < s["i"]
            hit = new & F.get(own, p)
            d, c = x["d"] + new.cast("int"), x["c"] + hit.cast("int")
            dice = 2.0 * c / (d + b)
            more = hit & (dice > x["dice"])
            return F.struct(d.alias("d"), c.alias("c"), F.when(more, dice).otherwise(x["dice"]).alias("dice"), F.when(more, p).otherwise(x["last"]).alias("last"))

        none = F.struct(F.lit(0).alias("d"), F.lit(0).alias("c"), F.lit(0.0).alias("dice"), F.lit(-1).alias("last"))
        every = F.aggregate(F.sequence(s["i"], s["stop"] - 1), none, step, lambda x: F.struct(x["dice"].alias("dice"), (-s["i"]).alias("first"), (-x["last"]).alias("last")))

        def only(j: Column) -> Column:
            size = j - s["i"] + 1
            d = F.size(F.filter(F.slice(before, s["i"] + 1, size), lambda p: p < s["i"]))
            c = F.size(F.filter(F.slice(own_before, s["i"] + 1, size), lambda p: p < s["i"]))
            return F.struct((2.0 * c / (d + b)).alias("dice"), (-s["i"]).alias("first"), (-j).alias("last"))

        # Behind a bigram of the template windows must reach its next place; where that
        # leaves one end, as in notices that follow each other, it is counted directly.
        end = s["stop"] - 1
        return F.when(F.coalesce(F.get(own, s["i"] - 1), F.lit(False)) & (F.get(after, s["i"] - 1) == end), only(end)).otherwise(every)

    best = F.transform(held, lambda t: F.struct(F.array_max(F.transform(F.filter(t["starts"], lambda s: worth(s, t["own"])), lambda s: scored(s, t["b"], t["own"], t["own_before"]))).alias("w"), t["name"].alias("name")))
    flat = F.transform(best, lambda x: F.struct(x["w"]["dice"].alias("dice"), (-x["w"]["first"]).alias("first"), (-x["w"]["last"]).alias("last"), x["name"].alias("name")))
    return F.filter(flat, lambda x: x["dice"] >= threshold)


def _alone(found: Column) -> Column:
    """The matches that no better one of another licence overlaps."""
    better = lambda x, y: (y["name"] != x["name"]) & (x["first"] <= y["last"]) & (y["first"] <= x["last"]) & ((y["dice"] > x["dice"]) | (y["dice"] == x["dice"]) & (y["name"] < x["name"]))
    return F.filter(found, lambda x: ~F.exists(found, lambda y: better(x, y)))


def scan_licences(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, licences (names, sorted, comma-joined), best_licence, best_dice (six
    decimals), n_matches (templates that match)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.lower(text).alias("low"))
    sets = [(name, _bigrams(t)) for name, t in templates]
    none = F.array().cast("array<string>")
    needed = reduce(lambda a, b: a | b, [F.col("low").contains(w) for w in needed_words(templates, threshold)])
    text_words = F.array_remove(F.split(F.col("low"), "[^a-z0-9]+"), "")
    # One-element explodes bind what the next step reads more than once.
    rows = rows.select("doc_id", F.explode(F.array(F.when(needed, text_words).otherwise(none))).alias("word"))
    whole = F.zip_with(F.slice("word", 1, F.size("word") - 1), F.slice("word", 2, F.size("word")), lambda a, b: F.concat_ws(" ", a, b))
    rows = rows.select("doc_id", F.explode(F.array(F.when(F.size("word") >= 2, whole).otherwise(none))).alias("whole"))
    # Equal bigrams are neighbours in order of bigram and place; then back in order of place.
    by_gram = F.array_sort(F.transform("whole", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    rows = rows.select("doc_id", "whole", F.explode(F.array(by_gram)).alias("by_gram"))
    beside = lambda x, k: F.when(F.get("by_gram", k)["g"] == x["g"], F.get("by_gram", k)["i"])
    links = F.array_sort(F.transform("by_gram", lambda x, k: F.struct(x["i"].alias("i"), beside(x, k + 1).alias("after"), F.coalesce(beside(x, k - 1), F.lit(-1)).alias("before"))))
    rows = rows.select("doc_id", "whole", F.explode(F.array(links)).alias("links"))
    rows = rows.select("doc_id", "whole", F.transform("links", lambda x: x["after"]).alias("after"), F.transform("links", lambda x: x["before"]).alias("before"))
    rows = rows.select("doc_id", F.explode(F.array(F.struct("whole", "after", "before"))).alias("t")).select("doc_id", "t.*")
    found = F.when(F.size("whole") > 0, _windows(F.col("whole"), F.col("after"), F.col("before"), sets, threshold)).otherwise(F.array().cast("array<struct<dice:double,first:int,last:int,name:string>>"))
    rows = rows.select("doc_id", F.explode(F.array(found)).alias("found"))
    rows = rows.select("doc_id", F.explode(F.array(_alone(F.col("found")))).alias("every"))
    every = F.col("every")
    best = F.array_max(F.transform(every, lambda x: x["dice"]))
    return rows.select(
        "doc_id",
        F.array_join(F.array_sort(F.array_distinct(F.transform(every, lambda x: x["name"]))), ",").alias("licences"),
        F.coalesce(F.array_min(F.transform(F.filter(every, lambda x: x["dice"] == best), lambda x: x["name"])), F.lit("")).alias("best_licence"),
        F.coalesce(F.round(best, 6), F.lit(0.0)).alias("best_dice"),
        F.size(every).cast("long").alias("n_matches"),
    )


def op6_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(table(spark, sf_dir, "documents"))


def _sql() -> str:
    """Every window between two bigrams of a template, counted by brute force."""
    quoted = ", ".join("(%d, '%s', '%s')" % (k, n, t.replace("'", "''")) for k, (n, t) in enumerate(TEMPLATES))
    words = "list_filter(string_split_regex(lower({}), '[^a-z0-9]+'), lambda x: x <> '')"
    low = THRESHOLD / (2 - THRESHOLD)
    return f"""
WITH v(k, name, body) AS (VALUES {quoted}),
t AS (SELECT k, name, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b FROM (SELECT k, name, {words.format('body')} AS w FROM v)),
d AS (SELECT row_number() OVER () AS r, doc_id, {words.format("coalesce(text, '')")} AS w FROM documents),
g AS (SELECT r, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS g FROM d WHERE len(w) > 1),
c AS (SELECT r, k, name, g, b FROM g JOIN t ON len(list_intersect(list_distinct(g), b)) >= {low} * len(b)),
p AS (SELECT r, k, i FROM (SELECT r, k, g, b, unnest(range(1, len(g) + 1)) AS i FROM c) WHERE list_contains(b, g[i])),
a AS (SELECT p.r, p.k, i, coalesce(lead(i) OVER (PARTITION BY p.r, p.k, g[i] ORDER BY i), 1000000000000) AS again FROM p JOIN c ON c.r = p.r AND c.k = p.k),
x AS (SELECT a.r, a.k, a.i, p.i AS j FROM a JOIN p ON a.r = p.r AND a.k = p.k AND p.i >= a.i AND p.i < a.again),
s AS (SELECT x.r, x.k, name, i, j, 2.0::DOUBLE * len(list_intersect(list_distinct(g[i:j]), b)) / (len(list_distinct(g[i:j])) + len(b)) AS dice FROM x JOIN c ON c.r = x.r AND c.k = x.k),
m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY r, k ORDER BY dice DESC, i, j) AS place FROM s WHERE dice >= {THRESHOLD}) WHERE place = 1),
o AS (SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM m y WHERE y.r = m.r AND y.name <> m.name AND m.i <= y.j AND y.i <= m.j AND (y.dice > m.dice OR y.dice = m.dice AND y.name < m.name))),
n AS (SELECT r, count(*) AS n, list_sort(list_distinct(list(name))) AS names, max(dice) AS best, arg_min(name, (-dice, name)) AS top FROM o GROUP BY r)
SELECT doc_id, coalesce(array_to_string(names, ','), '') AS licences, coalesce(top, '') AS best_licence,
       coalesce(round(best, 6), 0.0::DOUBLE) AS best_dice, coalesce(n, 0)::BIGINT AS n_matches
FROM d LEFT JOIN n USING (r)
"""


SQL = _sql()
