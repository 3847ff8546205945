"""Each dealt operator against its brute-force version or a property, on small fixtures with odd rows."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayline.llm import decontam, langid, licences, lmscore, neardup, neighbours, packing, pii, quality, substring
from wayline.llm.common import components, table
from wayline.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long, items string, kept string"


def _docs(spark, rows):
    """Documents with extra columns whose names clash with result columns."""
    return spark.createDataFrame([(i, t, "en", None, None, "x", "y") for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def odd():
    r = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    base = [r.choice(words) for _ in range(120)]
    near = [list(base) for _ in range(6)]
    for i, n in enumerate(near):
        for _ in range(2 * i):
            n[r.randrange(len(n))] = r.choice(words)
    rows = [(i, " ".join(n)) for i, n in enumerate(near)]
    rows += [(20 + i, " ".join(base)) for i in range(5)]  # copies
    rows += [(30, None), (31, ""), (32, " \n\t "), (33, "one"), (34, "One"), (35, "ONE two"), (36, "a " * 5000), (37, "é ü ñ"),
             (38, "x" * 30000), (39, " ".join(base[:40] + ["q"] + base[40:])), (40, "The quick brown fox"), (41, "the quick brown fox")]
    return rows


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def _sorted(rows):
    return sorted(rows, key=str)


def test_first_ten_are_registered():
    assert [k.split("_")[0] for k in QUERIES][:10] == [f"op{i}" for i in range(1, 11)]


def test_decontamination_is_brute_force(spark, odd):
    items = [(1, "w1 w2"), (2, None), (3, ""), (4, "THE QUICK brown fox"), (None, "one"), (5, odd[0][1][:200]), (5, odd[0][1][:200]), (6, "fox")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {x[0]: x for x in decontam.brute_force(odd, items)}
    for chars in (1 << 20, 50):  # one block of test strings, and several passes
        got = decontam.find_leaks(_docs(spark, odd), bench, block_chars=chars)
        for r in got.collect():
            w = want[r.doc_id]
            assert (r.n_words, len(r.hit_words), r.contaminated) == (w[1], w[2], w[5])
            assert hashlib.sha256(",".join(r.items_).encode()).hexdigest() == w[4]  # items is taken by the input


def test_decontamination_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.contaminated for r in decontam.find_leaks(_docs(spark, [(1, "a b")]), none).collect()] == [False]
    assert decontam.find_leaks(_docs(spark, []), none).count() == 0


def test_near_duplicates_are_brute_force(spark, odd):
    assert _rows(neardup.near_duplicates(_docs(spark, odd), k=2)) == _sorted(neardup.brute_force(odd))


def test_near_duplicates_null_ids_and_empty(spark):
    got = {r.doc_id: r for r in neardup.near_duplicates(_docs(spark, [(None, "a b c"), (3, "a b c"), (2, "a b c")]), k=2).collect()}
    assert got[None].component_id is None and got[None].kept and got[3].component_id == 2 and not got[3].kept
    assert neardup.near_duplicates(_docs(spark, []), k=2).count() == 0


def test_contested_groups_lose_no_link(spark):
    """A chain of neighbours: most members fail against any one pivot."""
    words = [f"t{i}" for i in range(100)]
    rows, cur = [], list(words)
    for i in range(25):
        rows.append((i, " ".join(cur)))
        cur = cur[:]
        cur[4 * i % 100] = f"n{i}"
    assert _rows(neardup.near_duplicates(_docs(spark, rows), k=2)) == _sorted(neardup.brute_force(rows))


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (100, 100)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


def test_repeats_are_brute_force(spark, odd):
    got = substring.remove_repeats(_docs(spark, odd))
    got = got.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256))
    assert _rows(got) == _sorted(substring.brute_force(odd))
    assert substring.remove_repeats(_docs(spark, [])).count() == 0


def test_pii_base_is_brute_force(spark, odd):
    rows = odd + [(50, "a@b.c@d.e +1 234 567 8901 1.2.3.4.5 4111 1111 1111 1111 0255.1.2.3 256.1.1.1 \U0001F600 me@x.org"), (51, "+1" * 50 + "9" * 3000)]
    got = pii.find_spans(_docs(spark, rows))
    got = got.select("doc_id", pii._text_of("base").alias("b"), pii._text_of("spans").alias("s")).collect()
    want = {x[0]: x for x in pii.brute_force(rows)}
    for r in got:
        assert hashlib.sha256(r.b.encode()).hexdigest() == want[r.doc_id][5]
        assert set(filter(None, r.b.split(","))) <= set(r.s.split(","))


def test_pii_redaction(spark):
    got = pii.redact(_docs(spark, [(1, "Mail me@x.org now"), (2, None), (3, "clean")])).select("doc_id", "text").collect()
    assert dict(map(tuple, got)) == {1: "Mail <email> now", 2: None, 3: "clean"}


def test_em_finds_the_unreliable_labeler():
    right = [(0, 1, 1, -1, 400.0), (0, 1, 1, 1, 400.0), (0, -1, -1, 1, 400.0), (0, -1, -1, -1, 400.0), (0, 1, -1, 1, 40.0)]
    acc = pii.reliabilities(right)["accuracy"]
    assert acc[0, 0] > 0.8 > 0.7 > acc[0, 2]


def test_packing_round_trip(spark, odd):
    import public_tokenizers as P
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = packing.pack(_docs(spark, odd), size=256).collect()
    by, seqs = defaultdict(list), defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
        seqs[r.sequence_id].append((r.offset, r.length))
    for i, t in odd:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        own = sorted(by[i], key=lambda r: r.piece)
        assert [r.length for r in own[1:]] == [256] * (len(own) - 1)
        at = 0
        for k, r in enumerate(own):
            assert (r.piece, r.start, r.ids_crc32) == (k, at, zlib.crc32(ids[at:at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    for places in seqs.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= 256
    total = sum(r.length for r in got)
    assert len(seqs) <= -(-total // 256) + 3


def test_plan_is_close_to_the_bound():
    r = np.random.default_rng(1)
    lengths = np.minimum(2047, r.lognormal(6.3, 1, 20000).astype(int) + 1)
    hist = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True))))
    placed = defaultdict(int)
    for x, lo, hi, first, _ in packing.plan(hist):
        for k in range(hi - lo + 1):
            placed[first + k] += x
    assert sum(placed.values()) == lengths.sum() and max(placed.values()) <= 2048
    assert len(placed) <= 1.02 * lengths.sum() / 2048


def test_licences(spark):
    rows = [(1, "Text.\nReleased under the MIT License."), (2, None), (3, ""), (4, "mit"), (5, "LICENSED under the Apache License, Version 2.0!")]
    got = {r.doc_id: [(x.line, x.licence, x.dice) for x in r.found] for r in licences.scan(_docs(spark, rows)).collect()}
    assert got == {1: [(1, "MIT", 1.0)], 2: [], 3: [], 4: [], 5: [(0, "Apache-2.0", 1.0)]}


def test_licences_against_sql(spark, sf):
    import duckdb
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(f"SELECT doc_id, n_notices, licence, dice FROM ({licences.ORACLE})").fetchall()
    assert _rows(licences.op3_licence_scan(spark, sf)) == _sorted(want)


def test_neighbours_are_exact(spark):
    r = np.random.default_rng(3)
    x = r.standard_normal((400, 8)).astype(np.float32)
    x[50:60] = x[7]  # ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(500, None), (501, [0.0] * 8), (502, [1.0, None] * 4), (600, [float("nan")] * 8),
                                                          (503, [1.0]), (None, [1.0] * 8), (700, [])]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 100 == 0).collect()
    assert {g.query_id for g in got} == {0, 100, 200, 300}
    for q in (0, 100, 200, 300):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(axis=1))
        want = sorted((d[i], i) for i in range(400) if i != q)[:10]
        own = sorted((g for g in got if g.query_id == q), key=lambda g: g.rank)
        assert [g.vec_id for g in own] == [i for _, i in want] and np.allclose([g.score for g in own], [a for a, _ in want])


def test_language_gradients_and_accuracy(spark, sf):
    net = langid.BiGru(["a", "b"], hidden=3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, on = langid.matrix([b"abcde", b"xy", b"q"])
    y = np.array([0, 1, 0])
    _, g = net.gradients(x, on, y)
    for k in net.p:
        i = tuple(np.unravel_index(np.abs(g[k]).argmax(), g[k].shape))
        old = net.p[k][i]
        net.p[k][i] = old + 1e-3
        up, _ = net.gradients(x, on, y)
        net.p[k][i] = old - 1e-3
        down, _ = net.gradients(x, on, y)
        net.p[k][i] = old
        assert g[k][i] == pytest.approx((up - down) / 2e-3, rel=0.02, abs=1e-4)
    got = langid.op1_language_id(spark, sf).join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.where("lang = lang_pred").count() >= 0.95 * got.count()


def test_language_of_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, "123 !!"), (4, "hello")]
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(_docs(spark, rows), F.lit(False)).collect()}
    assert got == {i: ("und", 0.0) for i in range(1, 5)}
    got = {r.doc_id: r.lang_pred for r in langid.identify(_docs(spark, rows), F.lit(True)).collect()}
    assert got == {1: "und", 2: "und", 3: "und", 4: "en"}


def test_hmm_likelihood_is_exact_and_beats_the_base(spark, sf):
    r = np.random.default_rng(2)
    hmm = lmscore.Hmm(np.array([.2, .3, .5]), states=2)
    x = r.integers(0, 3, 5)
    want = 0.0
    for path in np.ndindex(*[2] * 5):  # sum over all state paths
        p = hmm.start[path[0]] * hmm.emit[path[0], x[0]]
        for t in range(1, 5):
            p *= hmm.move[path[t - 1], path[t]] * hmm.emit[path[t], x[t]]
        want += p
    _, scale, _ = hmm.forward(x[:, None], np.ones((5, 1), dtype=bool))
    assert np.log(scale).sum() == pytest.approx(np.log(want))
    start, move, post = hmm.expected(x[:, None], np.ones((5, 1), dtype=bool))
    assert start.sum() == pytest.approx(1) and move.sum() == pytest.approx(4) and np.allclose(post.sum(axis=2), 1)
    held = lmscore.op2_lm_scoring(spark, sf).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert held[0] > held[1]


def test_lm_counts(spark):
    rows = [(1, "a b A"), (2, None), (3, "zz a")]
    got = {r.doc_id: r for r in lmscore.score(_docs(spark, rows), F.col("doc_id") == 3, rounds=1).collect()}
    assert [(got[i].n_tokens, got[i].n_known, got[i].train_tokens) for i in (1, 2, 3)] == [(4, 4, 5), (1, 1, 5), (3, 2, 5)]
    assert got[2].base_score == pytest.approx(np.log10(3 / (5 + 1 * (3 + 1))))
    assert lmscore.score(_docs(spark, []), F.lit(False)).count() == 0


def test_quality(spark, sf):
    docs, labels = (table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))  # enough trusted texts
    got = quality.judge(docs, labels).join(labels.select(F.col("doc_id").alias("i"), "quality"), F.col("doc_id") == F.col("i"))
    good, bad = got.where("quality = 1"), got.where("quality = 0")
    assert good.where("kept").count() >= 0.85 * good.count()
    assert bad.where("not kept").count() >= 0.5 * bad.count()
    odd = _docs(spark, [(1, None), (2, ""), (3, "x")])
    assert {r.doc_id: r.kept_ for r in quality.judge(odd, labels.where("false")).collect()} == {1: True, 2: True, 3: True}
    assert {r.doc_id: r.perplexity for r in quality.judge(odd, labels).collect() if r.doc_id < 3} == {1: None, 2: None}


def test_kneser_ney_sums_to_one():
    buf = np.frombuffer(b"abracadabra abracadabra cab", dtype=np.uint8)
    offs = np.array([0, 12, len(buf)])
    code, n = np.unique(quality.grams(buf, offs, np.zeros(2, dtype=np.int64)), return_counts=True)
    model = quality.KneserNey(code, n)
    for ctx in (b"\0\0\0\0", b"abra", b"zzzz", b"bra "):
        c = int.from_bytes(ctx, "big") << 8
        assert np.exp(model.log_p(np.arange(256) + c)).sum() == pytest.approx(1, abs=1e-9)


def test_pipeline(spark, sf):
    import corpus_pipeline as P
    docs = table(spark, sf, "documents")
    names = [n for n, _ in P.STAGES]
    assert names == ["quality", "near_dedup", "decontaminate", "pii", "packing"]
    got = P.run(spark, sf)
    assert set(got.columns) >= {"doc_id", "piece", "sequence_id", "offset"}
    ids = {r.doc_id for r in got.select("doc_id").distinct().collect()}
    leaked = {x[0] for x in decontam.brute_force([tuple(r) for r in docs.select("doc_id", "text").collect()],
                                                 [tuple(r) for r in table(spark, sf, "benchmark").select("item_id", "text").collect()]) if x[5]}
    assert ids and not ids & leaked


def test_packing_split_is_the_vocabularys_own():
    import public_tokenizers
    import pyarrow as pa
    import regex

    from wayline.llm.textcode import buffer_of

    r = random.Random(1)
    letters = ["'", "'", *"strevmlda1S!_", "é", "²", "½", " ", " ", "\n", "\t", " ", " ", "\x1c", "\x00", "”", "日", "😀"]
    for _ in range(2000):
        texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 12))) for _ in range(r.randint(1, 4))]
        buf, offs = buffer_of(pa.array(texts))
        start = packing.split(buf, offs[:-1][np.diff(offs) > 0]).tolist()
        got = [buf[a:b].tobytes().decode() for a, b in zip(start, [*start[1:], len(buf)])]
        assert got == [w for t in texts for w in regex.findall(public_tokenizers.PATTERN, t)]


def test_packing_ids_are_the_tokenizers_own():
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    texts = ["a <|endoftext|> b", "<|endoftext|><|endoftext|>x", "<|endoftext|> 's 'll", "", None, "x" * 5000, " \n \n  a'REa're ", "été 日本 don't  stop"]
    for _ in range(2):  # new words, then known ones
        got = packing.encoder(path).encode(pa.array(texts))
        assert [g.tolist() for g in got] == [tok.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_lm_packed_numbers():
    for x in (np.zeros(0, dtype="<i4"), np.array([0, 1, -1, 2**31 - 1], dtype="<i4"), np.arange(-300, 300, dtype="<i2")):
        assert lmscore.unpacked(lmscore.packed(x), len(x), x.dtype.str).tolist() == x.tolist()
