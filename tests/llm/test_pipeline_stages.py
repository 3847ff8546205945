"""Pipeline stages on planted rows, each against a brute-force version."""

import random

import pytest

import corpus_pipeline as P
from wayline.llm import decontam, neardup
from wayline.llm.common import table


@pytest.fixture(scope="module")
def planted(spark, sf):
    """Copies, near copies, benchmark passages and odd rows, with columns named like work columns."""
    r = random.Random(9)
    words = [f"word{i}" for i in range(300)]
    texts = [" ".join(r.choice(words) for _ in range(80)) for _ in range(12)]
    rows = list(texts)
    for t in texts[:4]:
        near = t.split()
        near[-1] = "changed"
        rows += [t, t, " ".join(near)]
    items = [x.text for x in table(spark, sf, "benchmark").select("text").limit(3).collect()]
    rows += [f"{texts[5]} {t} {texts[6]}" for t in items] + [None, "", "short", "short"]
    docs = [(i, t, "en", "web", len(t or ""), "x", "y") for i, t in enumerate(rows)]
    return docs, spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, base string, kept string")


def test_near_dedup_keeps_one_of_each_component(spark, sf, planted):
    docs, df = planted
    got = P.near_dedup(spark, df, sf)
    want = {x[0] for x in neardup.brute_force([d[:2] for d in docs], k=5) if x[3]}
    assert got.columns == df.columns and sorted(x.doc_id for x in got.collect()) == sorted(want)


def test_decontamination_keeps_the_clean(spark, sf, planted):
    docs, df = planted
    got = P.decontaminate(spark, df, sf)
    items = [tuple(x) for x in table(spark, sf, "benchmark").select("item_id", "text").collect()]
    want = {x[0] for x in decontam.brute_force([d[:2] for d in docs], items) if not x[5]}
    assert 0 < len(want) < len(docs)
    assert got.columns == df.columns and sorted(x.doc_id for x in got.collect()) == sorted(want)


def test_private_data_keeps_every_row(spark, sf, planted):
    docs, df = planted
    got = {x.doc_id: x for x in P.private_data(spark, df, sf).collect()}
    assert len(got) == len(docs)
    assert all(got[d[0]].text == d[1] and got[d[0]].n_chars == (len(d[1]) if d[1] is not None else None) for d in docs if "@" not in (d[1] or "") and "+" not in (d[1] or ""))
