"""Licence notices by Dice coefficient over word bigrams (operator 3), in DataFrame functions alone.

The whole text is normalised (lower case, everything but letters a-z and digits
becomes one space, newlines too).  A passage is a window of its words, wherever
lines begin or end, and is compared to each template as a set of word bigrams (a
template of one word as that word).  A set of ``a`` bigrams can reach Dice
coefficient ``t`` with one of ``b`` only if ``b t / (2 - t) <= a <= b (2 - t) / t``,
and must share ``b t / (2 - t)`` of them: these bounds prune templates by the
bigrams of the whole text, places by the number of shared bigrams ahead, windows by
the count of shared bigrams up to their ends.

To widen a window by a bigram of the template never lowers its coefficient, so
windows begin and end with whole *runs* of consecutive template bigrams (a run
longer than the largest window is cut into pieces of that length).  Of windows that
share a word the one with the higher coefficient is reported (then: smaller name,
longer, earlier).  Windows are taken in text order; those that wait for the best of
their neighbourhood are few, so the work grows with the text.

Templates are the short notices of TEMPLATES, the other wordings, file headers,
short licence texts and openings of long ones in WORDINGS, and the tags of SPDX,
which count only word by word.  All work is inside one row: no shuffle, no Python.

Defined results: a null or empty text has no passages and no licence; ties go to
the smaller template name; repeated rows are reported each; an empty table gives
no rows; other columns are carried along, the result is suffixed if it clashes.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.llm.common import table

THRESHOLD = 0.8

#: Short notices by which texts name their licence (fixed values, normalised).
TEMPLATES = {
    "Apache-2.0": "licensed under the apache license version 2 0",
    "BSD-3-Clause": "released under the 3 clause bsd license",
    "CC-BY-4.0": "licensed under cc by 4 0",
    "CC-BY-NC-4.0": "licensed under cc by nc 4 0",
    "CC-BY-SA-4.0": "licensed under cc by sa 4 0",
    "CC0-1.0": "released into the public domain under cc0 1 0",
    "GPL-2.0": "this work is licensed under the gnu general public license version 2",
    "GPL-3.0": "this work is licensed under the gnu general public license version 3",
    "LGPL-3.0": "this work is licensed under the gnu lesser general public license version 3",
    "MIT": "released under the mit license",
    "MPL-2.0": "licensed under the mozilla public license version 2 0",
    "Proprietary": "all rights reserved",
}

#: Other usual wordings, file headers and whole licence texts (fixed values, normalised).
WORDINGS = [
    ("Apache-2.0", "distributed under the apache license version 2 0"),
    ("Apache-2.0", "licensed under the apache license 2 0"),
    ("Apache-2.0",
     "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the "
     "license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable "
     "law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties "
     "or conditions of any kind either express or implied see the license for the specific language governing permissions "
     "and limitations under the license"),
    ("AGPL-3.0",
     "is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as "
     "published by the free software foundation either version 3 of the license or at your option any later version"),
    ("BSD-2-Clause",
     "redistribution and use in source and binary forms with or without modification are permitted provided that the "
     "following conditions are met 1 redistributions of source code must retain the above copyright notice this list of "
     "conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice "
     "this list of conditions and the following disclaimer in the documentation and or other materials provided with the "
     "distribution this software is provided by the copyright holders and contributors as is and any express or implied "
     "warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose "
     "are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental "
     "special exemplary or consequential damages including but not limited to procurement of substitute goods or services "
     "loss of use data or profits or business interruption however caused and on any theory of liability whether in contract "
     "strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if "
     "advised of the possibility of such damage"),
    ("BSD-3-Clause", "licensed under the bsd 3 clause license"),
    ("BSD-3-Clause",
     "redistribution and use in source and binary forms with or without modification are permitted provided that the "
     "following conditions are met 1 redistributions of source code must retain the above copyright notice this list of "
     "conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice "
     "this list of conditions and the following disclaimer in the documentation and or other materials provided with the "
     "distribution 3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
     "promote products derived from this software without specific prior written permission this software is provided by the "
     "copyright holders and contributors as is and any express or implied warranties including but not limited to the "
     "implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the "
     "copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential "
     "damages including but not limited to procurement of substitute goods or services loss of use data or profits or "
     "business interruption however caused and on any theory of liability whether in contract strict liability or tort "
     "including negligence or otherwise arising in any way out of the use of this software even if advised of the "
     "possibility of such damage"),
    ("CC-BY-4.0", "licensed under a creative commons attribution 4 0 international license"),
    ("CC-BY-NC-4.0", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("CC-BY-SA-4.0", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("GPL-2.0",
     "is free software you can redistribute it and or modify it under the terms of the gnu general public license as "
     "published by the free software foundation either version 2 of the license or at your option any later version"),
    ("GPL-3.0",
     "is free software you can redistribute it and or modify it under the terms of the gnu general public license as "
     "published by the free software foundation either version 3 of the license or at your option any later version"),
    ("ISC",
     "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted "
     "provided that the above copyright notice and this permission notice appear in all copies the software is provided as "
     "is and the author disclaims all warranties with regard to this software including all implied warranties of "
     "merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential "
     "damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract "
     "negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("LGPL-3.0",
     "is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as "
     "published by the free software foundation either version 3 of the license or at your option any later version"),
    ("MIT", "licensed under the mit license"),
    ("MIT", "distributed under the mit license"),
    ("MIT",
     "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
     "documentation files the software to deal in the software without restriction including without limitation the rights "
     "to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to "
     "whom the software is furnished to do so subject to the following conditions the above copyright notice and this "
     "permission notice shall be included in all copies or substantial portions of the software the software is provided as "
     "is without warranty of any kind express or implied including but not limited to the warranties of merchantability "
     "fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for "
     "any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in "
     "connection with the software or the use or other dealings in the software"),
    ("MPL-2.0",
     "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not "
     "distributed with this file you can obtain one at http mozilla org mpl 2 0"),
    ("Apache-2.0",
     "apache license version 2 0 january 2004 http www apache org licenses terms and conditions for use reproduction and "
     "distribution 1 definitions license shall mean the terms and conditions for use reproduction and distribution as defined "
     "by sections 1 through 9 of this document"),
    ("AGPL-3.0",
     "gnu affero general public license version 3 19 november 2007 copyright c 2007 free software foundation inc https fsf org "
     "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("GPL-2.0",
     "gnu general public license version 2 june 1991 copyright c 1989 1991 free software foundation inc 51 franklin street "
     "fifth floor boston ma 02110 1301 usa everyone is permitted to copy and distribute verbatim copies of this license "
     "document but changing it is not allowed"),
    ("GPL-3.0",
     "gnu general public license version 3 29 june 2007 copyright c 2007 free software foundation inc https fsf org everyone "
     "is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("LGPL-3.0",
     "gnu lesser general public license version 3 29 june 2007 copyright c 2007 free software foundation inc https fsf org "
     "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("MPL-2.0",
     "mozilla public license version 2 0 1 definitions 1 1 contributor means each individual or legal entity that creates "
     "contributes to the creation of or owns covered software"),
]

#: Identifiers that may follow the words of an SPDX tag (fixed values).
SPDX = {
    "AGPL-3.0": ["AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later"],
    "Apache-2.0": ["Apache-2.0"],
    "BSD-2-Clause": ["BSD-2-Clause"],
    "BSD-3-Clause": ["BSD-3-Clause"],
    "CC-BY-4.0": ["CC-BY-4.0"],
    "CC-BY-NC-4.0": ["CC-BY-NC-4.0"],
    "CC-BY-SA-4.0": ["CC-BY-SA-4.0"],
    "CC0-1.0": ["CC0-1.0"],
    "GPL-2.0": ["GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later"],
    "GPL-3.0": ["GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later"],
    "ISC": ["ISC"],
    "LGPL-3.0": ["LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later"],
    "MIT": ["MIT"],
    "MPL-2.0": ["MPL-2.0"],
}
TAG = "SPDX-License-Identifier: "


def _bigrams(words: list[str]) -> list[str]:
    pairs = [f"{a} {b}" for a, b in zip(words, words[1:])] or words
    return list(dict.fromkeys(pairs))


def _bounds(b: int, t: float) -> tuple[float, float]:
    return b * t / (2 - t), b * (2 - t) / t


def _anchors(own: list[str], need: int) -> list[str]:
    """Words, longest first, one of which every set of ``need`` of these bigrams holds."""
    out: list[str] = []
    for w in sorted({w for x in own for w in x.split()}, key=lambda w: (-len(w), w)):
        if sum(not set(x.split()) & set(out) for x in own) < need:
            break
        out.append(w)
    return out


def _known(templates: dict[str, str] | None, threshold: float) -> list[tuple[str, list[str], float, int, int]]:
    """(licence, bigrams, least coefficient, least number shared, largest window) of every template."""
    if templates is None:
        texts = [(n, t, threshold) for n, t in [*TEMPLATES.items(), *WORDINGS]]
        texts += [(n, TAG + x, 1.0) for n, ids in SPDX.items() for x in ids]
    else:
        texts = [(n, t, threshold) for n, t in templates.items()]
    out = []
    for name, t, least in texts:
        words = re.sub("[^a-z0-9]+", " ", t.lower()).split()
        own = _bigrams(words)
        low, high = _bounds(len(own), least)
        out.append((name, own, least, math.ceil(low - 1e-9), max(math.floor(high + 1e-9), len(words) - 1)))
    return out


def _let(value: Column, f) -> Column:
    """``f`` of a value that is computed once."""
    return F.transform(F.array(value), f)[0]


def _part(values: Column, first: Column, last: Column) -> Column:
    """Elements from place ``first`` to ``last``; unlike ``slice`` it does not touch the others."""
    return F.transform(F.sequence(first, last), lambda i: F.get(values, i))


def _windows(t: Column, bigrams: Column, shared: Column) -> Column:
    """All windows of runs that reach the coefficient of template ``t``; ``shared`` are the bigrams of any template."""
    def pieces(h: Column) -> Column:
        first = F.filter(F.transform(h, lambda at, i: F.struct(at.alias("s"), i.alias("c"))),
                         lambda r: (r["c"] == 0) | (F.get(h, r["c"] - 1) != r["s"] - 1))
        runs = _let(first, lambda f: F.transform(f, lambda r, i: F.struct(
            r["s"].alias("s"), r["c"].alias("c"), F.get(h, F.coalesce(F.get(f, i + 1)["c"], F.size(h)) - 1).alias("e"))))
        return F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(r["s"], r["e"], t["most"]), lambda s: F.struct(
            s.alias("s"), (r["c"] + s - r["s"]).alias("c"), F.least(s + t["most"] - 1, r["e"]).alias("e")))))

    def window(s: Column, e: Column) -> Column:
        dice = _let(_part(bigrams, s, e), lambda part: 2 * F.size(F.array_intersect(part, t["own"])) / (
            F.size(F.array_distinct(part)) + F.size(t["own"])))
        return _window(dice, t["licence"], s, e)

    def of(h: Column, r: Column) -> Column:
        ahead = F.filter(F.transform(r, lambda a, i: F.struct(a["s"].alias("s"), a["c"].alias("c"), i.alias("i"))),
                         lambda a: F.get(h, a["c"] + t["need"] - 1) - a["s"] < t["most"])
        return F.flatten(F.transform(ahead, lambda a: F.filter(F.transform(F.filter(
            _part(r, a["i"], F.least(a["i"] + t["most"], F.size(r)) - 1),
            lambda b: (b["e"] - a["s"] < t["most"]) & (b["c"] + b["e"] - b["s"] + 1 - a["c"] >= t["need"])),
            lambda b: window(a["s"], b["e"])), lambda w: -w["minus"] >= t["least"])))

    hits = F.transform(F.filter(shared, lambda r: F.array_contains(t["own"], r["x"])), lambda r: r["at"])
    return _let(hits, lambda h: _let(pieces(h), lambda r: of(h, r)))


def _best_first(waiting: Column) -> Column:
    return F.aggregate(F.sort_array(waiting), _none(), lambda acc, s: F.when(
        F.exists(acc, lambda o: (s["at"] <= o["to"] + 1) & (o["at"] <= s["to"] + 1)), acc).otherwise(F.concat(acc, F.array(s))))


def _apart(found: Column) -> Column:
    """The windows left when, best first, those that share a word with a taken one go.

    In text order: a window waits with the ones before it as long as it touches the
    best of them; the first that does not settles them, since what any of them still
    touches beyond that best one goes with it.  Settled windows are gathered in parts,
    so that no long array is copied for each.
    """
    ordered = F.transform(F.sort_array(F.transform(found, lambda s: F.struct(s["at"].alias("at"), s["to"].alias("to"), s.alias("s")))),
                          lambda r: r["s"])
    start = F.struct(F.array().cast(f"array<{_SOME}>").alias("done"), _none().alias("part"), _none().alias("wait"))

    def step(acc: Column, s: Column) -> Column:
        full = F.size(acc["part"]) >= 256
        settled = F.struct(F.when(full, F.concat(acc["done"], F.array(acc["part"]))).otherwise(acc["done"]).alias("done"),
                           F.concat(F.when(full, _none()).otherwise(acc["part"]), _best_first(acc["wait"])).alias("part"),
                           F.array(s).alias("wait"))
        return F.when(F.coalesce(s["at"] <= F.array_min(acc["wait"])["to"] + 1, F.lit(False)), F.struct(
            acc["done"].alias("done"), acc["part"].alias("part"), F.concat(acc["wait"], F.array(s)).alias("wait"))).otherwise(settled)

    return F.aggregate(ordered, start, step, lambda acc: F.flatten(F.concat(acc["done"], F.array(acc["part"], _best_first(acc["wait"])))))


def scan(docs: DataFrame, text: str = "text", templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``found``: an array of (line, licence, dice) of the passages that reach the threshold, in text order.

    ``line`` is the line of the passage's first word.
    """
    known = _known(templates, threshold)
    singles = sorted((own[0], name) for name, own, *_ in known if own and " " not in own[0])
    cases = [c for c in known if c[1] and " " in c[1][0]]
    anchors = sorted({w for _, own, _, need, _ in cases for w in _anchors(own, need)} | {w for w, _ in singles})
    every = sorted({x for _, own, *_ in cases for x in own})
    plain = lambda x: F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "))
    result = "found"
    while result in docs.columns:
        result += "_"
    df = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    df = df.withColumn("_w", F.split(plain("_text"), " ", -1))
    # a text without any anchor word can hold no notice
    df = df.withColumn("_p", F.when(F.arrays_overlap("_w", F.array(*map(F.lit, anchors)).cast("array<string>")), F.transform(
        F.slice("_w", 1, F.size("_w") - 1), lambda x, i: F.concat_ws(" ", x, F.col("_w")[i + 1]))))
    df = df.withColumn("_h", F.filter(F.transform("_p", lambda x, i: F.struct(i.alias("at"), x.alias("x"))), lambda r: r["x"].isin(every)))
    if cases:
        table_of = F.array(*(F.struct(F.lit(name).alias("licence"), F.array(*map(F.lit, own)).alias("own"), F.lit(least).alias("least"),
                                      F.lit(need).alias("need"), F.lit(most).alias("most")) for name, own, least, need, most in cases))
        df = df.withColumn("_d", F.array_distinct(F.transform("_h", lambda r: r["x"])))
        near = F.filter(table_of, lambda t: F.size(F.array_intersect(t["own"], F.col("_d"))) >= t["need"])
        found = _let(F.col("_p"), lambda p: _let(F.col("_h"), lambda h: F.flatten(F.transform(near, lambda t: _windows(t, p, h)))))
    else:
        found = _none()
    if singles:  # a window of one word ends before it begins
        words = F.filter(F.transform("_w", lambda x, i: F.struct(i.alias("at"), x.alias("x"))), lambda r: r["x"].isin([w for w, _ in singles]))
        names = F.create_map(*(F.lit(v) for w, name in reversed(list({w: (w, n) for w, n in reversed(singles)}.values())) for v in (w, name)))
        found = F.concat(F.coalesce(found, _none()), F.transform(words, lambda r: _window(F.lit(1.0), names[r["x"]], r["at"], r["at"] - 1)))
    df = df.withColumn("_c", F.coalesce(found, _none()))
    df = df.withColumn("_t", F.when(F.size("_c") > 0, F.array_sort(F.transform(_apart(F.col("_c")), lambda s: F.struct(
        s["at"].alias("at"), s["licence"].alias("licence"), (-s["minus"]).alias("dice"))))))
    # line of each word
    lines = F.flatten(F.transform(F.split("_text", "\n", -1), lambda x, i: F.when(plain(x) == "", F.array().cast("array<int>")).otherwise(
        F.array_repeat(i, F.size(F.split(plain(x), " ", -1))))))
    found = F.when(F.col("_t").isNotNull(), _let(lines, lambda n: F.transform("_t", lambda s: F.struct(
        F.get(n, s["at"]).alias("line"), s["licence"].alias("licence"), s["dice"].alias("dice")))))
    df = df.select("row", F.coalesce(found, F.array().cast("array<struct<line:int,licence:string,dice:double>>")).alias("_f"))
    return df.select(*(F.col("row").getField(c).alias(c) for c in docs.columns), F.col("_f").alias(result))


_SOME = "array<struct<minus:double,licence:string,less:int,at:int,to:int>>"


def _none() -> Column:
    return F.array().cast(_SOME)


def _window(dice: Column, licence: Column, at: Column, to: Column) -> Column:
    """Sorted, the best come first: by coefficient, name, length, place."""
    return F.struct((-dice).alias("minus"), licence.alias("licence"), (at - to).alias("less"), at.alias("at"), to.alias("to"))


def _digest(df: DataFrame) -> DataFrame:
    """doc_id, number of notices, and the best one (ties: smaller name)."""
    best = F.aggregate("found", F.struct(F.lit(-1.0).alias("dice"), F.lit("").alias("licence")), lambda acc, s: F.when(
        (s["dice"] > acc["dice"]) | ((s["dice"] == acc["dice"]) & (s["licence"] < acc["licence"])),
        F.struct(s["dice"].alias("dice"), s["licence"].alias("licence"))).otherwise(acc))
    some = F.size("found") > 0
    return df.withColumn("best", best).select(
        "doc_id", F.size("found").cast("long").alias("n_notices"), F.when(some, F.col("best.licence")).alias("licence"),
        F.when(some, F.round("best.dice", 6)).alias("dice"))


def op3_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices of every whole document: number, and the best one."""
    return _digest(scan(table(spark, sf_dir, "documents").select("doc_id", "text")))


def _oracle() -> str:
    known = ", ".join(f"({i}, '{n}', {own!r}, {least}, {need}, {most})" for i, (n, own, least, need, most) in enumerate(_known(None, THRESHOLD)))
    return f"""
WITH RECURSIVE t(id, licence, own, least, need, most) AS (VALUES {known}),
texts AS (SELECT row_number() OVER () AS rid, doc_id,
                 string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM documents),
grams AS (SELECT rid, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS p FROM texts),
places AS (SELECT rid, unnest(p) AS x, unnest(range(0, len(p))) AS pos FROM grams),
hits AS (SELECT rid, id, most, pos, row_number() OVER (PARTITION BY rid, id ORDER BY pos) AS c
         FROM places JOIN (SELECT id, most, unnest(own) AS x FROM t) USING (x)),
runs AS (SELECT rid, id, most, min(pos) AS s, max(pos) AS e, min(c) AS c FROM hits GROUP BY rid, id, most, pos - c),
cut AS (SELECT rid, id, most, s AS s0, e, c, unnest(range(s, e + 1, most)) AS s FROM runs),
pieces AS (SELECT rid, id, s, least(s + most - 1, e) AS e, c + s - s0 AS c FROM cut),
pairs AS (SELECT a.rid, a.id, a.s, b.e, t.licence, t.own, t.least FROM pieces a JOIN t USING (id) JOIN pieces b
          ON a.rid = b.rid AND a.id = b.id AND b.s >= a.s AND b.e - a.s < t.most AND b.c + b.e - b.s + 1 - a.c >= t.need),
parts AS (SELECT rid, s, e, licence, own, least, p[s + 1:e + 1] AS part FROM pairs JOIN grams USING (rid)),
scored AS (SELECT rid, s, e, licence, least, 2.0::DOUBLE * len(list_intersect(part, own)) / (len(list_distinct(part)) + len(own)) AS dice
           FROM parts),
ranked AS (SELECT rid, s, e, licence, dice, row_number() OVER (PARTITION BY rid ORDER BY dice DESC, licence, s - e, s) AS k
           FROM scored WHERE dice >= least),
taken(rid, k, spans) AS (
  SELECT rid, k, [{{'s': s, 'e': e, 'licence': licence, 'dice': dice}}] FROM ranked WHERE k = 1
  UNION ALL
  SELECT n.rid, n.k, CASE WHEN len(list_filter(t.spans, lambda o: n.s <= o.e + 1 AND o.s <= n.e + 1)) > 0 THEN t.spans
                     ELSE list_append(t.spans, {{'s': n.s, 'e': n.e, 'licence': n.licence, 'dice': n.dice}}) END
  FROM taken t JOIN ranked n ON n.rid = t.rid AND n.k = t.k + 1),
last AS (SELECT rid, arg_max(spans, k) AS spans FROM taken GROUP BY rid)
SELECT doc_id, coalesce(len(spans), 0)::BIGINT AS n_notices, spans[1].licence AS licence, round(spans[1].dice, 6)::DOUBLE AS dice
FROM texts LEFT JOIN last USING (rid)"""


ORACLE = _oracle()
