"""Language identification by a bidirectional gated recurrent network over bytes (operator 1).

The network reads segments of ``SEGMENT`` bytes in both directions; its input
weights are a table over bytes, its output labels every byte with a language.
It is trained in numpy by backpropagation through time (Adam) on a bounded
sample of segments of labelled documents.  A document's probabilities are the
mean over all bytes of its whole text, so cost is linear and memory bounded.

Defined results: ``und`` with score 0 for a text that is null or has no letter,
and for every text if nothing could be learned; rows without language, null texts
and rows outside the training fold are not learned from; repeated rows are each
labelled; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from wayline.llm.common import fold_part, table
from wayline.llm.textcode import buffer_of, chunks

HIDDEN, SEGMENT = 8, 128
#: Documents of each language, and segments of each document, in the training sample.
PER_LANG, PER_DOC = 400, 6
STEPS, BATCH, RATE = 250, 256, 0.02
_LETTER = re.compile("[A-Za-z]")


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


class BiGru:
    """Parameters: for each direction a byte table (256 x 3H) and recurrent weights (H x 3H); output (2H x L) and bias."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 7):
        r = np.random.default_rng(seed)
        self.languages, self.h = languages, hidden
        f = lambda *s, k: (r.standard_normal(s) * k).astype(np.float32)
        self.p = {"tf": f(256, 3 * hidden, k=.3), "uf": f(hidden, 3 * hidden, k=.3), "tb": f(256, 3 * hidden, k=.3),
                  "ub": f(hidden, 3 * hidden, k=.3), "v": f(2 * hidden, len(languages), k=.3), "c": f(len(languages), k=0)}

    def _run(self, x: np.ndarray, on: np.ndarray, t: np.ndarray, u: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Hidden states (T, B, H) of bytes x (T, B); the state is 0 where ``on`` (T, B, 1) is."""
        h = np.zeros((x.shape[1], self.h), dtype=np.float32)
        out = np.empty((*x.shape, self.h), dtype=np.float32)
        H = self.h
        for i in range(len(x)):
            a, g = t[x[i]], h @ u
            rz = _sigmoid(a[:, :2 * H] + g[:, :2 * H])
            n = np.tanh(a[:, 2 * H:] + rz[:, :H] * g[:, 2 * H:])
            new = (n + rz[:, H:] * (h - n)) * on[i]
            if keep is not None:
                keep.append((h, rz, n, g[:, 2 * H:]))
            h = out[i] = new
        return out

    def positions(self, x: np.ndarray, on: np.ndarray) -> np.ndarray:
        """Probabilities (T, B, L) of each byte."""
        p = self.p
        hf = self._run(x, on, p["tf"], p["uf"])
        hb = self._run(x[::-1], on[::-1], p["tb"], p["ub"])[::-1]
        return self._softmax(hf @ p["v"][:self.h] + hb @ p["v"][self.h:] + p["c"])

    @staticmethod
    def _softmax(z):
        z = np.exp(z - z.max(axis=-1, keepdims=True))
        return z / z.sum(axis=-1, keepdims=True)

    def _back(self, x, on, kept, dout, t, u):
        """Gradients of the byte table and the recurrent weights, backwards through time."""
        H, dt, du = self.h, np.zeros_like(t), np.zeros_like(u)
        dh = np.zeros_like(dout[0])
        for i in range(len(x) - 1, -1, -1):
            h, rz, n, gn = kept[i]
            r, z = rz[:, :H], rz[:, H:]
            d = (dout[i] + dh) * on[i]
            dn = d * (1 - z) * (1 - n * n)
            dz = d * (h - n) * z * (1 - z)
            dr = dn * gn * r * (1 - r)
            da = np.concatenate([dr, dz, dn], axis=1)
            dg = np.concatenate([dr, dz, dn * r], axis=1)
            np.add.at(dt, x[i], da)
            du += h.T @ dg
            dh = dg @ u.T + d * z
        return dt, du

    def gradients(self, x: np.ndarray, on: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        p, H = self.p, self.h
        kf, kb = [], []
        hf = self._run(x, on, p["tf"], p["uf"], kf)
        hb = self._run(x[::-1], on[::-1], p["tb"], p["ub"], kb)[::-1]
        q = self._softmax(hf @ p["v"][:H] + hb @ p["v"][H:] + p["c"])
        total = max(1.0, float(on.sum()))
        d = q.copy()
        d[:, np.arange(x.shape[1]), y] -= 1
        d *= on / total
        loss = float((-np.log(q[:, np.arange(x.shape[1]), y] + 1e-9) * on[:, :, 0]).sum() / total)
        g = {"v": np.concatenate([np.einsum("tbh,tbl->hl", hf, d), np.einsum("tbh,tbl->hl", hb, d)]), "c": d.sum(axis=(0, 1))}
        g["tf"], g["uf"] = self._back(x, on, kf, d @ p["v"][:H].T, p["tf"], p["uf"])
        g["tb"], g["ub"] = self._back(x[::-1], on[::-1], kb, (d @ p["v"][H:].T)[::-1], p["tb"], p["ub"])
        return loss, g

    def fit(self, segments: list[bytes], y: np.ndarray, steps: int = STEPS, batch: int = BATCH, rate: float = RATE, seed: int = 7) -> list[float]:
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        by = [np.flatnonzero(y == i) for i in range(len(self.languages))]
        losses = []
        for step in range(1, steps + 1):
            pick = np.array([r.choice(by[i]) for i in r.integers(0, len(by), batch)])  # languages weigh alike
            x, on = matrix([segments[i] for i in pick])
            loss, g = self.gradients(x, on, y[pick])
            losses.append(loss)
            lr = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for k, v in g.items():
                v = np.clip(v, -1, 1)
                m[k] = .9 * m[k] + .1 * v
                s[k] = .99 * s[k] + .01 * v * v
                self.p[k] = (self.p[k] - lr * (m[k] / (1 - .9 ** step)) / (np.sqrt(s[k] / (1 - .99 ** step)) + 1e-8)).astype(np.float32)
        return losses

    def documents(self, buf: np.ndarray, offs: np.ndarray, lanes: int = 2048) -> np.ndarray:
        """Pooled probabilities (documents, L): the mean over all bytes."""
        size = np.diff(offs)
        count = -(-size // SEGMENT)
        doc = np.repeat(np.arange(len(size)), count)
        start = np.repeat(offs[:-1], count) + (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * SEGMENT
        length = np.minimum(SEGMENT, offs[1:][doc] - start)
        out = np.zeros((len(size), len(self.languages)))
        padded = np.concatenate([buf, np.zeros(SEGMENT, dtype=np.uint8)])
        order = np.argsort(-length, kind="stable")
        for at in range(0, len(order), lanes):
            own = order[at:at + lanes]
            t = int(length[own[0]])
            x = padded[start[own][None, :] + np.arange(t)[:, None]]
            on = (np.arange(t)[:, None] < length[own][None, :]).astype(np.float32)[:, :, None]
            np.add.at(out, doc[own], (self.positions(x, on) * on).sum(axis=0))
        return out / np.maximum(size, 1)[:, None]


def matrix(segments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes (T, B) of segments and where they are (T, B, 1)."""
    size = np.array([len(s) for s in segments])
    x = np.zeros((len(segments), max(1, size.max())), dtype=np.uint8)
    for i, s in enumerate(segments):
        x[i, :len(s)] = np.frombuffer(s, dtype=np.uint8)
    return x.T, (np.arange(x.shape[1])[:, None] < size[None, :]).astype(np.float32)[:, :, None]


def train(rows: DataFrame, per_lang: int = PER_LANG, per_doc: int = PER_DOC) -> BiGru | None:
    """A network from rows (text, lang, h), a bounded sample of them by least h."""
    order = W.partitionBy("lang").orderBy("h")  # limited before the shuffle as well
    ids = rows.select("lang", "h").distinct().withColumn("r", F.row_number().over(order)).where(F.col("r") <= per_lang)
    sample = rows.join(F.broadcast(ids.select("lang", "h")), ["lang", "h"])  # at most per_lang rows for each language

    def cut(batches):
        for batch in batches:
            lang, out = batch.column(1).to_pylist(), []
            buf, offs = buffer_of(batch.column(0))
            for d in range(batch.num_rows):
                n = int(offs[d + 1] - offs[d])
                for at in np.unique(np.linspace(0, max(0, n - SEGMENT), per_doc).astype(int)):
                    a = int(offs[d]) + int(at)
                    out.append((lang[d], buf[a:min(a + SEGMENT, int(offs[d + 1]))].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], type=pa.string()), pa.array([b for _, b in out], type=pa.binary())],
                                             names=["lang", "segment"])

    got = sample.select("text", "lang").mapInArrow(cut, "lang string, segment binary").orderBy("lang", "segment").collect()
    if not got:
        return None
    languages = sorted({r.lang for r in got})
    net = BiGru(languages)
    net.fit([bytes(r.segment) for r in got], np.array([languages.index(r.lang) for r in got]))
    return net


def identify(docs: DataFrame, learn: Column, text: str = "text", lang: str = "lang", id_col: str = "doc_id",
             carry: tuple[str, ...] = ()) -> DataFrame:
    """id, carried columns, lang_pred and score of every row, learned from the rows for which ``learn`` holds."""
    t = F.col(text).cast("string")
    rows = docs.where(learn & F.col(lang).isNotNull() & (F.length(t) > 0)).select(
        t.alias("text"), F.col(lang).cast("string").alias("lang"), F.xxhash64(F.col(id_col), t).alias("h"))
    net = train(rows)
    shared = docs.sparkSession.sparkContext.broadcast(net)
    kept = docs.select(F.col(id_col), *carry, t.alias("_text"))

    def run(batches):
        net = shared.value
        for batch in batches:
            for part in chunks(batch, "_text", 1 << 20):
                texts = part.column(part.num_columns - 1)
                letters = np.array([x is not None and bool(_LETTER.search(x) or any(map(str.isalpha, x))) for x in texts.to_pylist()], dtype=bool)
                if net is None:
                    pred, score = ["und"] * part.num_rows, np.zeros(part.num_rows)
                else:
                    p = net.documents(*buffer_of(texts))
                    best = p.argmax(axis=1)
                    pred = [net.languages[b] if ok else "und" for b, ok in zip(best, letters)]
                    score = np.where(letters, np.clip(p.max(axis=1), 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(pred, type=pa.string()), pa.array(score, type=pa.float64())],
                                                 names=[*part.schema.names[:-1], "lang_pred", "score"])

    from pyspark.sql import types as T
    schema = T.StructType([*kept.schema.fields[:-1], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return kept.mapInArrow(run, schema)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole document, learned from three of four folds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn(
        "held_out", F.coalesce(fold_part("doc_id", 4) == 2, F.lit(False)))
    return identify(docs, ~F.col("held_out"), carry=("held_out",))
