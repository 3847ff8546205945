"""Operators 11 to 13 against brute force, round trips and odd rows."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayline.llm import jaccardjoin, middle, neardup, vectorcodes
from wayline.llm.queries import QUERIES

DOCS = "doc_id long, text string, n string, form string, component_id string, output string, _gone string"


def _docs(spark, rows):
    """Documents with extra columns whose names clash with result columns."""
    return spark.createDataFrame([(i, t, "x", "y", "z", "o", "g") for i, t in rows], DOCS)


def _sorted(rows):
    return sorted((tuple(r) for r in rows), key=str)


def test_new_operators_are_registered():
    assert {"op11_fill_in_middle", "op12_jaccard_join", "op13_vector_codes"} <= set(QUERIES)


# operator 11 -------------------------------------------------------------------

def _middle(doc_id, text):
    """(n, form, prefix_chars, middle_chars, output) by plain Python."""
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i:8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(units), "plain", None, None, text
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    form = "spm" if h4 % 100 < 20 else "psm"
    return len(units), form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


@pytest.fixture(scope="module")
def texts():
    r = random.Random(3)
    parts = ["ab", "Zeile", " ", "\n", "\r\n", "é", "ß", "😀", "<", "<P", "S>", "M>", "$1", "\\2", "1", "\t", "\x00", "{3}", "日本"]
    rows = [(i, "".join(r.choice(parts) for _ in range(r.randrange(1, 400)))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, "a"), (203, "😀"), (204, "x<P>y"), (205, "<S>"), (206, "..<M>"), (None, "null id here"),
             (207, "a b " * 64), (208, "w " * 32), (209, "w " * 33), (7, rows[7][1]), (7, rows[7][1]), (210, "a" * 200_000),
             (211, "a1" * 150_000 + "b" * 200_000), (212, "é" * 300_000)]
    return rows


def test_fill_in_middle_is_plain_python_and_restores(spark, texts):
    out = middle.fill_in_middle(_docs(spark, texts))
    got = out.withColumn("back", middle.restore(F.col("output"), F.col("form"))).collect()
    assert _sorted([(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got]) == _sorted(
        [(i, *_middle(i, t)) for i, t in texts])
    assert _sorted([(r.doc_id, r.back) for r in got]) == _sorted([(i, t or "") for i, t in texts])
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_fill_in_middle_shares_and_empty(spark):
    docs = _docs(spark, [(i, "some words here") for i in range(400)])
    assert middle.fill_in_middle(docs, plain_percent=100).where("form <> 'plain'").count() == 0
    assert middle.fill_in_middle(docs, plain_percent=0, spm_percent=100).where("form <> 'spm'").count() == 0
    assert middle.fill_in_middle(_docs(spark, [])).count() == 0


def test_fill_in_middle_has_no_shuffle_and_no_python(spark, sf):
    plan = middle.op11_fill_in_middle(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


# operator 12 -------------------------------------------------------------------

@pytest.fixture(scope="module")
def alike():
    """Chains of near copies, exact copies, short and odd texts."""
    r = random.Random(11)
    words = [f"w{i}" for i in range(300)]
    rows, n = [], 0
    for size in (8, 12, 40, 60, 90, 200, 700):
        base = [r.choice(words) for _ in range(size)]
        for step in range(8):
            rows.append((n, " ".join(base)))
            n += 1
            base = list(base)
            for _ in range(max(1, size // 120)):
                base[r.randrange(len(base))] = r.choice(words)
            if step % 3 == 2:
                base = base[:-1]
    rows += [(500, rows[3][1]), (501, rows[3][1].upper()), (502, None), (503, ""), (504, " \n\t"), (505, "one"), (506, "ONE"), (507, "one two"),
             (508, "One  two"), (509, "a " * 4000), (510, "x" * 30000), (511, "a a a"), (3, rows[3][1])]
    return rows


def _brute(rows, k=3, percent=90):
    found = {d: (n, c) for d, n, c, _ in neardup.brute_force(sorted(set(rows), key=str), k, percent)}
    return _sorted([(d, *found[d]) for d, _ in rows])


@pytest.mark.parametrize("percent", [90, 60])
def test_jaccard_join_is_brute_force(spark, alike, percent):
    got = jaccardjoin.similar_documents(_docs(spark, alike), percent=percent).select("doc_id", "n_shingles", "component_id")
    assert _sorted(got.collect()) == _brute(alike, percent=percent)


def test_jaccard_join_in_small_blocks_loses_no_link(spark, monkeypatch):
    """One large group of near copies whose least id is linked with few of them."""
    r = random.Random(2)
    words = [f"w{i}" for i in range(500)]
    base = [r.choice(words) for _ in range(70)]
    rows = []
    for i in range(160):
        t = list(base)
        for _ in range(r.randrange(0, 5)):
            t[r.randrange(70)] = r.choice(words)
        rows.append((i, " ".join(t)))
    monkeypatch.setattr(jaccardjoin, "BLOCK_ROWS", 16)
    got = jaccardjoin.similar_documents(_docs(spark, rows)).select("doc_id", "n_shingles", "component_id")
    want = _brute(rows)
    assert _sorted(got.collect()) == want and 1 < len({w[2] for w in want}) < 160


def test_jaccard_join_null_ids_and_empty(spark):
    got = {r.doc_id: r for r in jaccardjoin.similar_documents(_docs(spark, [(None, "a b c d"), (3, "a b c d"), (2, "a b c d")])).collect()}
    assert got[None].component_id is None and got[3].component_id == 2 and got[2].component_id == 2
    assert jaccardjoin.similar_documents(_docs(spark, [])).count() == 0


def test_linked_sets_share_a_tile_and_pass_the_bitmaps():
    r = np.random.default_rng(5)
    for percent in (90, 80, 50):
        for _ in range(300):
            n = int(r.integers(1, 400))
            x = np.unique(r.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
            gone = r.integers(0, len(x), int(r.integers(0, 1 + len(x) // 8)))
            y = np.unique(np.concatenate([np.delete(x, gone), r.integers(0, 2**63, int(r.integers(0, 1 + n // 20))).astype(np.uint64)]))
            c = len(np.intersect1d(x, y))
            assert jaccardjoin.common(x, y) == c
            if not len(y) or 100 * c < percent * (len(x) + len(y) - c):
                continue
            assert len(np.intersect1d(jaccardjoin.tile_keys(x, percent), jaccardjoin.tile_keys(y, percent)))
            low = min(w := [jaccardjoin.width_of(len(s), percent) for s in (x, y)])
            bits = [jaccardjoin.folded(np.frombuffer(jaccardjoin.bitmap(s, v), dtype=np.uint8)[None, :], low) for s, v in zip((x, y), w)]
            assert jaccardjoin.may_link(*bits, np.array([len(x)]), np.array([len(y)]), percent).all()


# operator 13 -------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<double>, label string, code string, error string, _label string"


def _vectors(spark, rows):
    return spark.createDataFrame([(i, v, lab, "c", "e", "l") for i, lab, v in rows], VECTORS)


@pytest.fixture(scope="module")
def vectors():
    r = random.Random(8)
    rows = [(i, r.choice(["a", "b", None]), [r.choice([r.uniform(-1, 1), 0.5, -0.001, 0.0]) for _ in range(10)]) for i in range(420)]
    rows += [(9, "a", rows[9][2]), (9, "a", rows[10][2]), (None, "b", rows[5][2]), (600, None, [0.0] * 10)]
    return rows


BAD = [(1000, "a", None), (1001, "a", [None] * 10), (1002, "b", [float("nan")] * 10), (1003, "b", [float("inf")] * 10), (1004, None, [])]


@pytest.mark.parametrize("block", [1 << 19, 300])
def test_vector_codes_are_brute_force(spark, vectors, monkeypatch, block):
    monkeypatch.setattr(vectorcodes, "BLOCK_VALUES", block)  # many blocks with dictionaries of their own
    coded, books = vectorcodes.compress(_vectors(spark, vectors + BAD))
    want, want_books = vectorcodes.brute_force(vectors)
    assert [b.tolist() for b in books] == want_books
    assert _sorted([(r.vec_id, r.label, bytes(r.code).hex(), r.error) for r in coded.collect()]) == _sorted(want)


def test_vector_codes_with_few_vectors_other_lengths_and_large_components(spark):
    rows = [(4, "a", [1.0, -1.0, 0.25, 0.0]), (2, "a", [1.0, 2.0, 3.0, 4.0])]
    odd = [(7, "b", [1.0, 2.0]), (1, "b", [1e300, 0.0, 0.0, 0.0])]
    coded, books = vectorcodes.compress(_vectors(spark, rows + odd + BAD))
    got = {r.vec_id: r for r in coded.collect()}
    assert sorted(got) == [1, 2, 4, 7] and got[7].code is None and got[1].error is None and got[2].error == 0
    assert bytes(got[4].code).hex() == "00010101" and [len(b) for b in books] == [2] * 4


def test_vector_codes_of_empty_tables(spark):
    for rows in ([], BAD):
        coded, _ = vectorcodes.compress(_vectors(spark, rows))
        assert coded.count() == 0


def test_label_errors_and_digest(spark, sf):
    from wayline.llm.common import table
    rows = [(r.vec_id, r.label, list(r.embedding)) for r in table(spark, sf, "embeddings").collect()][:300]
    want, books = vectorcodes.brute_force(rows, rounds=1)
    coded, got = vectorcodes.compress(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"), rounds=1)
    assert vectorcodes.books_digest(got) == hashlib.sha256(",".join(str(c) for p in books for e in p for c in e).encode()).hexdigest()
    assert _sorted([(r.vec_id, r.label, bytes(r.code).hex(), r.error) for r in coded.collect()]) == _sorted(want)


# operator 2: long texts in segments ----------------------------------------------

def _plain_counts(start, move, emit, text):
    """(log10 likelihood, expected moves) of one text of classes, state by state in plain Python."""
    k = len(start)
    a = [[start[i] * emit[i][text[0]] for i in range(k)]]
    for x in text[1:]:
        a.append([sum(a[-1][i] * move[i][j] for i in range(k)) * emit[j][x] for j in range(k)])
    b = [[1.0] * k]
    for x in text[:0:-1]:
        b.insert(0, [sum(move[i][j] * emit[j][x] * b[0][j] for j in range(k)) for i in range(k)])
    total = sum(a[-1])
    moves = [[sum(a[t][i] * move[i][j] * emit[j][text[t + 1]] * b[t + 1][j] for t in range(len(text) - 1)) / total
              for j in range(k)] for i in range(k)]
    return np.log10(total), np.array(moves)


def test_segments_give_the_plain_recursion():
    from wayline.llm import lmscore
    r = np.random.default_rng(1)
    hmm = lmscore.Hmm(np.full(9, 1 / 9), states=3)
    hmm.start, hmm.move = r.dirichlet(np.ones(3)), r.dirichlet(np.ones(3), 3)
    n = np.array([0, 4, 1, 23, 8, 7, 0, 12])
    code = r.integers(0, 8, n.sum()).astype(np.int32)
    want = [_plain_counts(hmm.start, hmm.move, hmm.emit, [*(code[a:a + m] + 1), 0]) for a, m in zip(np.cumsum(n) - n, n)]
    for size in (1, 4, 8, 1000):
        s = lmscore.Segments(code, n, np.arange(1, 9), size)
        assert np.allclose(s.score(hmm), [w[0] for w in want], atol=1e-10)
        start, move, emit = s.expected(hmm, 9)
        assert np.allclose(move, sum(w[1] for w in want), atol=1e-10)
        assert abs(start.sum() - len(n)) < 1e-9 and np.allclose(emit.sum(axis=0), np.bincount(code + 1, minlength=9) + [len(n), *[0] * 8])


def test_lm_scores_do_not_depend_on_segments(spark):
    from wayline.llm import lmscore
    r = random.Random(2)
    rows = [(i, " ".join(r.choice(["the", "cat", "sat", "on", "a", "mat", f"w{i % 7}"]) for _ in range(r.randrange(0, 60)))) for i in range(30)]
    rows += [(31, None), (32, ""), (None, "the cat"), (5, rows[5][1]), (5, rows[5][1]), (33, "mat " * 3000)]
    whole, cut = ({(x.doc_id, x.n_tokens, round(x.base_score, 6)): x.score for x in lmscore.score(
        _docs(spark, rows), F.col("doc_id") % 5 == 2, rounds=2, segment=size).collect()} for size in (1 << 20, 16))
    assert whole.keys() == cut.keys() and len(whole) == 34
    assert all(abs(whole[k] - cut[k]) < 1e-8 * max(1, abs(whole[k])) for k in whole)


def test_redaction_keeps_columns_with_any_name(spark):
    from wayline.llm import pii
    names = ["base", "spans", "cand", "more", "_t", "row", "found", "kind"]
    text = "write to jane.doe@example.org now"
    df = spark.createDataFrame([(1, text, *names), (2, None, *names)], "doc_id long, text string, " + ", ".join(f"{c} string" for c in names))
    got = {r.doc_id: r for r in pii.redact(df).collect()}
    assert pii.redact(df).columns == df.columns and all(got[i][c] == c for i in (1, 2) for c in names)
    assert got[1].text == "write to <email> now" and got[2].text is None
