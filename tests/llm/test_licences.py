"""Licence windows against a plain-Python version; long texts, whole bodies, tags, odd rows."""

import math
import random
import re
import time

import duckdb
import pytest

from wayline.llm import licences

SCHEMA = "doc_id long, text string, _w int, found int, _t int, _p int, row int"


def _scan(spark, texts, **kw):
    df = licences.scan(spark.createDataFrame([(i, t, 1, 2, 3, 4, 5) for i, t in enumerate(texts)], SCHEMA), **kw)
    return {r.doc_id: r for r in df.collect()}


def _words(text):
    return re.sub("[^a-z0-9]+", " ", text.lower()).split()


def brute_force(text, templates, t):
    """(line, licence, dice): windows of whole runs of template bigrams, best first, none sharing a word."""
    w = [(x, i) for i, line in enumerate(text.split("\n")) for x in _words(line)]
    p = [f"{a} {b}" for (a, _), (b, _) in zip(w, w[1:])]
    found = []
    for name, other in templates.items():
        own = set(licences._bigrams(_words(other)))
        most = max(math.floor(len(own) * (2 - t) / t + 1e-9), len(_words(other)) - 1)
        runs = []
        for i, x in enumerate(p):
            if x in own:
                if runs and runs[-1][1] == i - 1 and i - runs[-1][0] < most:
                    runs[-1][1] = i
                else:
                    runs.append([i, i])
        for i, (s, _) in enumerate(runs):
            for _, e in runs[i:]:
                part = set(p[s:e + 1])
                dice = 2 * len(part & own) / (len(part) + len(own))
                if e - s < most and dice >= t:
                    found.append((-dice, name, s - e, s, e))
    out = []
    for x in sorted(found):
        if all(x[3] > o[4] + 1 or o[3] > x[4] + 1 for o in out):
            out.append(x)
    return [(w[s][1], name, round(-d, 9)) for s, name, d in sorted((x[3], x[1], x[0]) for x in out)]


@pytest.mark.parametrize("threshold", [0.6, 0.8, 1.0])
def test_windows_are_brute_force(spark, threshold):
    r = random.Random(3)
    templates = {"A": "a b c d e f", "B": "b c d x e", "C": "a a a", "D": "c d c d e a b"}
    texts = ["".join(r.choice("abcdex") + r.choice("   \n") for _ in range(r.choice([3, 30, 200]))) for _ in range(120)]
    got = _scan(spark, texts, templates=templates, threshold=threshold)
    assert sum(len(r.found_) for r in got.values()) > 20
    for i, text in enumerate(texts):
        assert [(x.line, x.licence, round(x.dice, 9)) for x in got[i].found_] == brute_force(text, templates, threshold)


def test_bodies_wrapped_notices_and_tags(spark):
    body = {n: t for n, t in licences.WORDINGS}
    texts = [
        "\n\n".join(["x " + body["BSD-3-Clause"]] * 3),
        "a\nreleased under\nthe MIT\nlicense",
        "// SPDX-License-Identifier: MIT\n# spdx-license-identifier: GPL-2.0-or-later\nSPDX-License-Identifier: none",
        "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\nCopyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\n"
        "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.\nPreamble",
        body["LGPL-3.0"], None, "", "\n \t", "released", "All rights reserved.", "All rights reserved.",
    ]
    got = {i: [(x.line, x.licence) for x in r.found_] for i, r in _scan(spark, texts).items()}
    three = [(0, "BSD-3-Clause"), (2, "BSD-3-Clause"), (4, "BSD-3-Clause")]
    assert got == {0: three, 1: [(1, "MIT")], 2: [(0, "MIT"), (1, "GPL-2.0")], 3: [(0, "GPL-3.0")], 4: [(0, "LGPL-3.0")],
                   5: [], 6: [], 7: [], 8: [], 9: [(0, "Proprietary")], 10: [(0, "Proprietary")]}


def test_ties_and_overlaps(spark):
    templates = {"B": "x y z", "A": "x y z", "Long": "q x y z w"}
    got = _scan(spark, ["x y z", "q x y z w", "x y z x y z"], templates=templates)
    assert [[(x.licence, x.dice) for x in got[i].found_] for i in range(3)] == [[("A", 1.0)], [("A", 1.0)], [("A", 1.0)] * 2]  # equal: smaller name


def test_columns_keep_their_values_and_empty_table(spark):
    r = _scan(spark, ["released under the mit license"])[0]
    assert (r._w, r.found, r._t, r._p, r.row, len(r.found_)) == (1, 2, 3, 4, 5, 1)
    assert _scan(spark, []) == {}


def test_work_grows_with_the_text(spark):
    body = [t for n, t in licences.WORDINGS if n == "BSD-3-Clause"][-1]
    _scan(spark, ["released under the mit license"])
    start = time.time()
    got = _scan(spark, ["\n".join([f"x{i} released under the MIT license" for i in range(3000)]), "\n".join([body] * 8)])
    assert [len(got[i].found_) for i in range(2)] == [3000, 8]
    assert time.time() - start < 20  # quadratic forms took over a minute


def test_sql_has_the_same_rule(spark):
    texts = [(i, t) for i, (_, t) in enumerate(licences.WORDINGS)]
    texts += [(100, "\n".join(t for _, t in licences.WORDINGS)), (101, None), (102, ""), (103, "x " * 200 + licences.WORDINGS[0][1]),
              (104, "SPDX-License-Identifier: MIT"), (104, "SPDX-License-Identifier: MIT")]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", texts)
    want = con.execute(f"SELECT doc_id, n_notices, licence, dice FROM ({licences.ORACLE})").fetchall()
    got = [tuple(r) for r in licences._digest(licences.scan(spark.createDataFrame(texts, "doc_id long, text string"))).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
