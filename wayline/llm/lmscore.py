"""Text likelihood by a hidden Markov model of words (operator 2).

Words fall into a bounded number of classes: each of the ``TOP`` most frequent
training words is a class of its own, all others share classes by a hash of their
last bytes, and the end token is one.  A state emits a class, the class a word:

    P(word | state) = b[state, class] * P(word | class),
    P(word | class) = (c + 1) / (C + V + 1) inside a shared class

with c, C, V counted over the whole training part of the corpus (one further
word of each shared class stands for all unknown ones), so probabilities sum to 1.

1. Documents are coded in blocks: a block's different words once, its texts as
   indices; the blocks are written once and read by every later step.
2. Word counts are summed over all blocks by an aggregation that grows with the
   corpus, and come back to each block through a join on the word.
3. Baum-Welch: tasks run the scaled forward-backward recursion over their blocks
   and return expected counts (states x classes, states x states); Spark sums
   them; the driver, which only sees these bounded tables, re-estimates.
4. The scaled forward recursion gives the exact log10 likelihood of each text.

Long texts are cut into segments of ``SEGMENT`` words that run side by side: the
product of a segment's step matrices says how it maps the states before it to those
after it, a short chain over a text's segments gives each its first and last state
vectors, and the recursion then starts from these.  The result is the same; the
number of steps, and the memory of a task, don't grow with the longest text.

Defined results: a null text is empty (its end token alone); without training
rows every word is unknown and emissions are uniform; repeated rows are each
scored; an empty table gives no rows; a null id is in training, and returned as it
is; other columns play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.llm.common import drop_written, fold_part, table, written
from wayline.llm.textcode import SPACE_WORDS, Words, chunks, hash_spans

STATES, ROUNDS = 6, 4
TOP, SHARED, TAIL = 4096, 4096, 3
#: Bytes of text in one block, words that one matrix recursion holds, and words of a segment.
BLOCK_BYTES, MATRIX, SEGMENT = 6 << 20, 1 << 18, 512

BLOCK = "block long, ids array<long>, held array<boolean>, n array<int>, code binary, words array<binary>, counts array<long>"


def packed(x: np.ndarray) -> bytes:
    """Numbers as compressed byte planes: small numbers leave the upper planes zero."""
    return pa.compress(x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes(), codec="zstd", asbytes=True) if len(x) else b""


def unpacked(data: bytes, n: int, kind: str) -> np.ndarray:
    """The ``n`` numbers of :func:`packed`."""
    kind = np.dtype(kind)
    if not n:
        return np.zeros(0, dtype=kind)
    planes = np.frombuffer(pa.decompress(data, n * kind.itemsize, codec="zstd"), dtype=np.uint8).reshape(kind.itemsize, n)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def encode(docs: DataFrame) -> DataFrame:
    """Blocks of (id, held, text) rows: words once, texts as indices of words."""
    def run(batches):
        seq = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in chunks(batch, "text", BLOCK_BYTES):
                w = Words(part.column(2), SPACE_WORDS, True)
                h = w.hashes()
                _, first, code, often = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
                order = np.argsort(-often, kind="stable")  # frequent words get small numbers, which pack well
                rank = np.empty(len(order), dtype=np.int64)
                rank[order] = np.arange(len(order))
                first, code = first[order], rank[code]
                held = part.column(1).to_numpy(zero_copy_only=False).astype(bool)
                counts = np.bincount(code[~held[w.doc]], minlength=len(first)) if len(code) else np.zeros(0, dtype=np.int64)
                size = w.length[first]
                ends = np.concatenate([[0], np.cumsum(size)])
                data = w.buf[np.repeat(w.start[first] - ends[:-1], size) + np.arange(ends[-1])]
                words = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends.astype("<i4")), pa.py_buffer(data)])
                one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], type=pa.int32()), a)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([seq]), one(part.column(0).cast(pa.int64())), one(pa.array(held)), one(pa.array(w.counts.astype(np.int32))),
                     pa.array([packed(code.astype("<i4"))], type=pa.binary()), one(words), one(pa.array(counts))],
                    names=["block", "ids", "held", "n", "code", "words", "counts"])
                seq += 1
    return docs.mapInArrow(run, BLOCK)


class Classes:
    """Classes of words: 0 is the end, then the frequent words, then the shared classes."""

    def __init__(self, top: list[bytes]):
        self.own = {w: i + 1 for i, w in enumerate(top)}
        self.shared = len(top) + 1
        self.n = self.shared + SHARED

    def of(self, words: list[bytes]) -> np.ndarray:
        if not words:
            return np.zeros(0, dtype=np.int32)
        size = np.array([len(w) for w in words])
        end = np.cumsum(size)
        tail = np.minimum(size, TAIL)
        out = (hash_spans(np.frombuffer(b"".join(words), dtype=np.uint8), end - tail, tail) % np.uint64(SHARED)).astype(np.int32) + self.shared
        own = self.own
        for i, w in enumerate(words):
            c = own.get(w)
            if c is not None:
                out[i] = c
        return out


class Hmm:
    """start (K), move (K x K), emit (K x G)."""

    def __init__(self, unigram: np.ndarray, states: int = STATES, seed: int = 3):
        r = np.random.default_rng(seed)
        self.unigram = unigram
        self.start = np.full(states, 1 / states)
        self.move = np.full((states, states), 0.1 / max(1, states - 1))
        np.fill_diagonal(self.move, 0.9 if states > 1 else 1.0)
        e = unigram * np.exp(r.standard_normal((states, len(unigram))))
        self.emit = e / e.sum(axis=1, keepdims=True)

    def forward(self, x: np.ndarray, on: np.ndarray, before: np.ndarray | None = None,
                first: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scaled forward variables (T, B, K), scales (T, B) and emissions of classes x (T, B).

        Columns stand by falling length, so those still running at a step are the first
        ones.  A column that isn't the ``first`` of its text goes on from the states ``before``.
        """
        e = np.take(np.ascontiguousarray(self.emit.T), x, axis=0)
        a = np.zeros_like(e)
        scale = np.ones(x.shape)
        begin = self.start if before is None else np.where(first[:, None], self.start, before @ self.move)
        for t, m in enumerate(on.sum(axis=1).tolist()):
            p = (begin if t == 0 else a[t - 1, :m] @ self.move) * e[t, :m]
            s = p.sum(axis=1)
            scale[t, :m] = s
            np.divide(p, s[:, None], out=a[t, :m])
        return a, scale, e

    def expected(self, x: np.ndarray, on: np.ndarray, before: np.ndarray | None = None, first: np.ndarray | None = None,
                 after: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected counts (start, move, posteriors) of one matrix of texts or segments.

        ``after`` is, up to a factor, the probability of what follows a column from each state.
        """
        a, scale, e = self.forward(x, on, before, first)
        k = len(self.start)
        b = np.ones((x.shape[1], k))
        running = on.sum(axis=1).tolist()
        if after is not None:
            b[:] = after / (a[on.sum(axis=0) - 1, np.arange(x.shape[1])] * after).sum(axis=1, keepdims=True)
        move = np.zeros((k, k))
        post = np.zeros_like(a)
        back = self.move.T
        e /= scale[:, :, None]
        for t in range(len(x) - 1, -1, -1):
            m = running[t]
            np.multiply(a[t, :m], b[:m], out=post[t, :m])
            if t:
                nb = e[t, :m] * b[:m]
                move += a[t - 1, :m].T @ nb
                b[:m] = nb @ back
        if before is None:
            return post[0].sum(axis=0), move * self.move, post
        nb = e[0] * b
        move += before[~first].T @ nb[~first]
        return post[0][first].sum(axis=0), move * self.move, post

    def product(self, x: np.ndarray, on: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Per column (B, K, K): states before to states after the column, up to a factor."""
        k, n = len(self.start), x.shape[1]
        e = np.take(np.ascontiguousarray(self.emit.T), x, axis=0)
        a = np.broadcast_to(np.eye(k), (n, k, k)).copy()
        a[~first] = self.move
        for t, m in enumerate(on.sum(axis=1).tolist()):
            p = (a[:m] if t == 0 else (a[:m].reshape(-1, k) @ self.move).reshape(m, k, k)) * e[t, :m, None, :]
            np.divide(p, p.sum(axis=(1, 2), keepdims=True), out=a[:m])
        return a

    def update(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> None:
        """M step; emissions lean on the class unigram by 50 words, so no probability is 0."""
        self.start = (start + 0.1) / (start + 0.1).sum()
        self.move = (move + 0.1) / (move + 0.1).sum(axis=1, keepdims=True)
        self.emit = (emit + 50 * self.unigram) / (emit.sum(axis=1, keepdims=True) + 50)


class Segments:
    """The texts of one block, each with its end, cut into segments of at most ``size`` words."""

    def __init__(self, code: np.ndarray, n: np.ndarray, cls: np.ndarray, size: int = SEGMENT):
        self.code, self.n, self.cls = code, n, cls
        parts = n // size + 1  # a text has its end besides its n words
        self.text = np.repeat(np.arange(len(n)), parts)
        self.number = np.arange(len(self.text)) - np.repeat(np.cumsum(parts) - parts, parts)
        self.first = self.number == 0
        self.several = np.flatnonzero(parts[self.text] > 1)
        self.at = (np.cumsum(n) - n)[self.text] + self.number * size
        self.words = np.minimum(n[self.text] - self.number * size, size)  # 0 where the end stands alone
        self.length = self.words + (self.number == parts[self.text] - 1)

    def matrices(self, which: np.ndarray):
        """(segments, classes (T, B), where they are) of the segments ``which``, by falling length."""
        order = which[np.argsort(-self.length[which], kind="stable")]
        at = 0
        while at < len(order):
            t = int(self.length[order[at]])
            own = order[at:at + max(1, MATRIX // t)]
            place = np.arange(t)[:, None]
            inside = place < self.words[own][None, :]
            x = np.zeros((t, len(own)), dtype=np.int32)
            x[inside] = self.cls[self.code[(self.at[own][None, :] + place)[inside]]]
            yield own, x, place < self.length[own][None, :]
            at += len(own)

    def ends(self, hmm: Hmm) -> tuple[np.ndarray, np.ndarray]:
        """(states before, weights after) of every segment."""
        k = len(hmm.start)
        before, after = np.zeros((len(self.text), k)), np.ones((len(self.text), k))
        if not len(self.several):
            return before, after
        step = np.zeros((len(self.text), k, k))
        for own, x, on in self.matrices(self.several):
            step[own] = hmm.product(x, on, self.first[own])
        by_number = self.several[np.argsort(self.number[self.several], kind="stable")]
        cut = np.searchsorted(self.number[by_number], np.arange(1, self.number.max() + 1))
        for own in np.split(by_number, cut)[1:]:
            v = np.where(self.first[own - 1, None], hmm.start, before[own - 1])
            v = np.einsum("bi,bij->bj", v, step[own - 1])
            before[own] = v / v.sum(axis=1, keepdims=True)
        for own in np.split(by_number, cut)[:0:-1]:
            v = np.einsum("bij,bj->bi", step[own], after[own])
            after[own - 1] = v / v.sum(axis=1, keepdims=True)
        return before, after

    def score(self, hmm: Hmm) -> np.ndarray:
        """log10 likelihood of the classes of each text."""
        before, _ = self.ends(hmm)
        out = np.zeros(len(self.n))
        for own, x, on in self.matrices(np.arange(len(self.text))):
            _, scale, _ = hmm.forward(x, on, before[own], self.first[own])
            out += np.bincount(self.text[own], weights=np.log10(scale).sum(axis=0), minlength=len(out))
        return out

    def expected(self, hmm: Hmm, kinds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected counts (start, move, emissions) of the block."""
        k = len(hmm.start)
        start, move, emit = np.zeros(k), np.zeros((k, k)), np.zeros((k, kinds))
        before, after = self.ends(hmm)
        for own, x, on in self.matrices(np.arange(len(self.text))):
            s, m, post = hmm.expected(x, on, before[own], self.first[own], after[own])
            start += s
            move += m
            at, weight = x[on], post[on]
            for j in range(k):
                emit[j] += np.bincount(at, weights=weight[:, j], minlength=kinds)
        return start, move, emit


def _block(batch: pa.RecordBatch, i: int):
    get = lambda c: batch.column(batch.schema.get_field_index(c))[i]
    n = np.array(get("n").as_py(), dtype=np.int64)
    return unpacked(get("code").as_py(), int(n.sum()), "<i4"), n, np.array(get("held").as_py(), dtype=bool), get("words").as_py()


def _classed(blocks: DataFrame, classes) -> DataFrame:
    """The training texts of each block as class numbers: what the rounds read."""
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                code, n, held, words = _block(batch, i)
                cls = classes.value.of(words)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([n[~held].tolist()], type=pa.list_(pa.int32())),
                     pa.array([packed(cls[code[np.repeat(~held, n)]].astype("<i2"))], type=pa.binary())], names=["n", "cls"])

    return written(blocks.select("n", "held", "code", "words").mapInArrow(run, "n array<int>, cls binary"), "classed")


def _gather(classed: DataFrame, model, kinds: int, segment: int) -> DataFrame:
    """Expected counts of one round, summed over all tasks: rows (slot, v)."""
    def run(batches):
        hmm = model.value
        k = len(hmm.start)
        start, move, emit = np.zeros(k), np.zeros((k, k)), np.zeros((k, kinds))
        for batch in batches:
            for i in range(batch.num_rows):
                n = np.array(batch.column(0)[i].as_py(), dtype=np.int64)
                code = unpacked(batch.column(1)[i].as_py(), int(n.sum()), "<i2")
                for total, got in zip((start, move, emit), Segments(code, n, np.arange(kinds), segment).expected(hmm, kinds)):
                    total += got
        flat = np.concatenate([start, move.ravel(), emit.ravel()])
        slot = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(flat[slot])], names=["slot", "v"])

    return classed.mapInArrow(run, "slot int, v double").groupBy("slot").agg(F.sum("v").alias("v"))


def score(docs: DataFrame, held: Column, id_col: str = "doc_id", text: str = "text", states: int = STATES, rounds: int = ROUNDS,
          segment: int = SEGMENT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    spark = docs.sparkSession
    coded = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(held, F.lit(False)).alias("held"),
                        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    blocks = written(encode(coded), "blocks")
    ends = blocks.select(F.sum(F.size(F.filter("held", lambda x: ~x)))).first()[0] or 0
    listed = blocks.select("block", F.posexplode(F.arrays_zip("words", "counts")).alias("pos", "w"))
    vocab = written(listed.where("w.counts > 0").groupBy(F.col("w.words").alias("word")).agg(F.sum("w.counts").alias("c")), "vocab")
    total, kinds = vocab.agg(F.sum("c"), F.count("*")).first()
    tokens, different = (total or 0) + ends, kinds + (1 if ends else 0)
    frequent = [(bytes(r.word), r.c) for r in vocab.orderBy(F.desc("c"), "word").limit(TOP).collect()]
    classes = spark.sparkContext.broadcast(Classes([w for w, _ in frequent]))

    def class_counts(batches):
        cl = classes.value
        c, v = np.zeros(cl.n, dtype=np.int64), np.zeros(cl.n, dtype=np.int64)
        for batch in batches:
            own = cl.of(batch.column(0).to_pylist())
            c += np.bincount(own, weights=batch.column(1).to_numpy(), minlength=cl.n).astype(np.int64)
            v += np.bincount(own, minlength=cl.n)
        at = np.flatnonzero(v)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(c[at]), pa.array(v[at])], names=["g", "c", "v"])

    size = np.zeros((2, classes.value.n))
    for r in vocab.select("word", "c").mapInArrow(class_counts, "g int, c long, v long").groupBy("g").agg(F.sum("c"), F.sum("v")).collect():
        size[:, r[0]] = r[1], r[2]  # one row for each class
    size[0, 0] = ends
    hmm = Hmm((size[0] + 0.5) / (size[0] + 0.5).sum(), states)
    k, g = states, classes.value.n
    classed = _classed(blocks, classes)
    for _ in range(rounds if tokens else 0):
        model = spark.sparkContext.broadcast(hmm)
        got = _gather(classed, model, g, segment).toArrow()  # at most k + k * k + k * g rows
        flat = np.zeros(k + k * k + k * g)
        flat[got.column("slot").to_numpy()] = got.column("v").to_numpy()
        hmm.update(flat[:k], flat[k:k + k * k].reshape(k, k), flat[k + k * k:].reshape(k, g))
    drop_written(classed)
    # the counts of the frequent words (TOP at most) travel with the model, those of all others through a join
    final = spark.sparkContext.broadcast((hmm, np.log10(size[0] + size[1] + 1), np.array([0] + [c for _, c in frequent], dtype=np.int64)))
    own = spark.createDataFrame([(bytearray(w),) for w, _ in frequent], "word binary")
    # the counts of a block's words, in one row: as many as the block has words
    known = (listed.select("block", "pos", F.col("w.words").alias("word")).join(F.broadcast(own), "word", "left_anti")
             .join(vocab, "word").groupBy("block")
             .agg(F.collect_list(F.struct(F.col("pos").alias("pos"), F.col("c").alias("c"))).alias("known")))
    per_end = np.log10(ends + 1.0)
    norm = np.log10(float(tokens + 1 * (different + 1)))

    def run(batches):
        hmm, class_norm, often = final.value
        cl = classes.value
        for batch in batches:
            for i in range(batch.num_rows):
                code, n, held, words = _block(batch, i)
                c = np.zeros(len(words), dtype=np.int64)
                got = batch.column(batch.schema.get_field_index("known"))[i]
                if got.is_valid:
                    v = got.values
                    c[v.field("pos").to_numpy()] = v.field("c").to_numpy()
                cls = cl.of(words)
                c = np.where(cls < cl.shared, often[np.minimum(cls, len(often) - 1)], c)
                log_c = np.log10(c + 1.0)
                inner = np.where(cls >= cl.shared, log_c - class_norm[cls], 0.0) if len(words) else np.zeros(0)
                offs = np.concatenate([[0], np.cumsum(n)])
                by_doc = lambda x: (lambda run: run[offs[1:]] - run[offs[:-1]])(np.concatenate([[0.0], np.cumsum(x[code])]))
                base = by_doc(log_c - norm) + per_end - norm
                exact = by_doc(inner) + Segments(code, n, cls, segment).score(hmm)
                m = len(n)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(batch.schema.get_field_index("ids"))[i].values, pa.array(held), pa.array(n + 1),
                     pa.array((by_doc((c > 0).astype(float)) + (ends > 0)).round().astype(np.int64)), pa.array(np.full(m, tokens, dtype=np.int64)),
                     pa.array(base), pa.array(exact)],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    out = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return blocks.join(known, "block", "left").select("ids", "n", "held", "code", "words", "known").mapInArrow(run, out)


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram base and hidden Markov likelihood of every whole document."""
    return score(table(spark, sf_dir, "documents").select("doc_id", "text"), fold_part("doc_id", 7) == 2)
