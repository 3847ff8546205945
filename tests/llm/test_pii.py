"""Personal data: base spans against Python's re and redaction against plain Python, on random texts."""

import hashlib
import random

import pytest

from wayline.llm import pii

SCHEMA = "doc_id long, text string"


def _spans(df):
    return df.select("doc_id", pii._text_of("base").alias("b"), pii._text_of("spans").alias("s")).collect()


def _plain_redaction(text, spans):
    """Spans in order; those that begin inside an earlier one go with it."""
    out, at = [], 0
    for s, kind, e in sorted((int(s), pii.KINDS.index(k), int(e)) for k, s, e in (x.split(":") for x in spans.split(",") if x)):
        if s >= at:
            out += [text[at:s], f"<{pii.KINDS[kind]}>"]
        at = max(at, e)
    return "".join(out) + text[at:]


@pytest.fixture(scope="module")
def noise():
    r = random.Random(11)
    bits = ["1", "22", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 234 567 8901", "10.0.0.1", "300.1.1.1", "me@x.org", "a%b@c", ".", "-", " ", "  ",
            "@", "+", "(", "_x@y.z", "\U0001F600", "é", "kim (at) example (dot) org", "call 415-555-2671 ", "5" * 19, "5" * 20, "0" * 12, "\n"]
    return [(i, "".join(r.choice(bits) for _ in range(r.randint(0, 40)))) for i in range(400)] + [(400, None), (401, ""), (7, "me@x.org")]


def test_base_spans_and_redaction_of_noise(spark, noise):
    df = spark.createDataFrame(noise, SCHEMA).repartition(4)
    got = _spans(pii.find_spans(df))
    want = {(x[0], x[5]) for x in pii.brute_force(noise)}
    assert len(got) == len(noise) and {(r.doc_id, hashlib.sha256(r.b.encode()).hexdigest()) for r in got} == want
    spans = {(r.doc_id, r.b): r.s for r in got}
    assert all(set(filter(None, b.split(","))) <= set(s.split(",")) for (_, b), s in spans.items())
    by_id = {r.doc_id: r.s for r in got if r.doc_id != 7}
    clean = {r.doc_id: r.text for r in pii.redact(df).collect() if r.doc_id != 7}
    texts = dict(noise)
    assert clean[400] is None
    assert all(clean[i] == _plain_redaction(texts[i], s) for i, s in by_id.items() if i != 400)


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert pii.find_spans(df).count() == 0 and pii.redact(df).count() == 0
