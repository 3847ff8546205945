"""Removal of repeated passages by compacted token k-mer paths (operator 4).

The edges of a De Bruijn graph over words are the windows of ``window``
consecutive words.  A window occurs again if its edge is met in more than one
place; what is covered by later occurrences is removed.

1. Runs of neighbouring edges are compacted to paths: neighbours that share the
   same minimiser (least hash of ``k`` consecutive words inside the window) form
   one path, identified by the minimiser and the hash of its whole content, with
   its source coordinates (document, first window, number of windows).  Equal
   windows have equal minimisers, so paths of other minimisers never meet.
2. A join on minimisers met in more than one document keeps the repeated paths.
3. Paths of equal content form a class; all but those of its smallest document
   are repeats as a whole.
4. Where a minimiser has several classes (the graph branches), the windows of the
   first paths are compared one by one.
5. Repeats within one document are found where the document is processed.
6. The source coordinates lead back to the documents; covered words are removed.

Every comparison is an equi-join or a ``min`` with map-side combining, so a
passage that a third of the documents share is pre-aggregated and its join can be
split.  Equality of windows rests on two independent 64-bit hashes together.

Defined results: a null text has no words; texts under ``window`` words lose
nothing; rows that repeat an id are each judged alone against smaller ids (they
hold the same place in the order); rows with a null id lose only what repeats
within them; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.llm.common import drop_written, table, written
from wayline.llm.textcode import SPACE_WORDS, Words, chunks, mix, ngrams

WINDOW = 20
#: Words of a minimiser; the span of window - k + 1 candidates is a power of two for 20 and 5.
MINIMISER = 5


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each ``w`` neighbours."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    have = 1
    while have < w:
        step = min(have, w - have)
        x = np.minimum(x[:len(x) - step], x[step:])
        have += step
    return x[:n]


def _window_hashes(w: Words, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first words of the windows, minimisers, content hashes)."""
    h = w.hashes()
    at = w.room(window)
    if not len(at):
        return at, h[:0], h[:0]
    return at, _sliding_min(ngrams(h, k), window - k + 1)[at], ngrams(h, window)[at]


def paths(docs: DataFrame, window: int, k: int) -> DataFrame:
    """(mh, sh, doc, s, n): compacted paths of every document."""
    def run(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                w = Words(part.column(1), SPACE_WORDS, False)
                at, low, content = _window_hashes(w, window, k)
                if not len(at):
                    continue
                doc = w.doc[at]
                new = np.ones(len(at), dtype=bool)
                new[1:] = (low[1:] != low[:-1]) | (doc[1:] != doc[:-1])
                first = np.flatnonzero(new)
                n = np.diff(np.append(first, len(at)))
                # content of a path: its windows' hashes, folded in order
                place = np.arange(len(at)) - np.repeat(first, n)
                with np.errstate(over="ignore"):
                    sh = np.add.reduceat(mix(content + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), first)
                ids = part.column(0).to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(low[first].view(np.int64)), pa.array(mix(sh).view(np.int64)), pa.array(ids[doc[first]]),
                     pa.array((at[first] - w.offs[doc[first]]).astype(np.int32)), pa.array(n.astype(np.int32))],
                    names=["mh", "sh", "doc", "s", "n"])

    return docs.mapInArrow(run, "mh long, sh long, doc long, s int, n int")


def _branch_windows(texts: DataFrame, window: int, k: int) -> DataFrame:
    """(mh, hw, doc, s): windows of the listed paths (column runs) of each document."""
    def run(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                w = Words(part.column(1), SPACE_WORDS, False)
                at, low, content = _window_hashes(w, window, k)
                room = np.concatenate([[0], np.cumsum(np.maximum(w.counts - window + 1, 0))])
                pick = [np.zeros(0, dtype=np.int64)]
                for d, runs in enumerate(part.column(2)):
                    v = runs.values
                    for s, n in zip(v.field("s").to_pylist(), v.field("n").to_pylist()):
                        pick.append(np.arange(room[d] + s, min(room[d] + s + n, room[d + 1])))
                pick = np.concatenate(pick).astype(np.int64)
                doc = w.doc[at[pick]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(low[pick].view(np.int64)), pa.array(content[pick].view(np.int64)),
                     pa.array(part.column(0).to_numpy()[doc]), pa.array((at[pick] - w.offs[doc]).astype(np.int32))],
                    names=["mh", "hw", "doc", "s"])

    return texts.select("doc_id", "text", "runs").mapInArrow(run, "mh long, hw long, doc long, s int")


def repeated_runs(docs: DataFrame, window: int = WINDOW, k: int = MINIMISER) -> DataFrame:
    """(doc, s, n): n windows from the s-th on whose words also start in a smaller document."""
    named = docs.where("doc_id is not null")
    found = paths(named, window, k)
    again = found.groupBy("mh").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select("mh")
    kept = written(found.join(again, "mh"), "paths")
    first = written(kept.groupBy("mh", "sh").agg(F.min("doc").alias("fd")), "classes")
    whole = kept.join(first, ["mh", "sh"])
    repeats = whole.where("doc > fd").select("doc", "s", "n")
    branching = first.groupBy("mh").agg(F.count("*").alias("c")).where("c > 1").select("mh")
    heads = whole.where("doc = fd").groupBy("mh", "sh", "doc").agg(F.min(F.struct("s", "n")).alias("r"))
    runs = (heads.join(branching, "mh", "left_semi").groupBy(F.col("doc").alias("doc_id"))
            .agg(F.collect_list("r").alias("runs")))  # paths of one document: bounded by its text
    windows = written(_branch_windows(named.join(runs, "doc_id"), window, k), "windows")
    least = windows.groupBy("mh", "hw").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi")
    single = windows.join(least, ["mh", "hw"]).where("doc > lo").select("doc", "s", F.lit(1).alias("n"))
    out = written(repeats.union(single), "repeats")
    for x in (kept, first, windows):
        drop_written(x)
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW,
                   k: int = MINIMISER) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by one space), for every row."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    marked = repeated_runs(docs, window, k).groupBy(F.col("doc").alias("doc_id")).agg(
        F.collect_list(F.struct("s", "n")).alias("runs"))  # of one document: bounded by its text

    def run(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                yield _cut(part, window)

    return docs.join(marked, "doc_id", "left").select("doc_id", "text", "runs").mapInArrow(
        run, "doc_id long, n_words long, n_removed long, kept string")


def _cut(part: pa.RecordBatch, window: int) -> pa.RecordBatch:
    w = Words(part.column(1), SPACE_WORDS, False)
    h = w.hashes()
    content = ngrams(h, window)
    removed, kept = [], []
    runs = part.column(2).to_pylist()
    for d, (lo, hi) in enumerate(zip(w.offs[:-1].tolist(), w.offs[1:].tolist())):
        n = hi - lo
        cover = np.zeros(n + 1, dtype=np.int64)
        if n >= window:
            own = content[lo:hi - window + 1]
            _, at = np.unique(own, return_index=True)
            later = np.ones(len(own), dtype=bool)  # windows met earlier in this document
            later[at] = False
            np.add.at(cover, np.flatnonzero(later), 1)
            np.add.at(cover, np.flatnonzero(later) + window, -1)
        for r in runs[d] or ():
            if r["s"] + r["n"] + window - 1 <= n:
                cover[r["s"]] += 1
                cover[r["s"] + r["n"] + window - 1] -= 1
        gone = np.cumsum(cover)[:n] > 0
        removed.append(int(gone.sum()))
        start, length = w.start[lo:hi], w.length[lo:hi]
        kept.append(b" ".join(w.buf[s:s + x].tobytes() for s, x in zip(start[~gone].tolist(), length[~gone].tolist())))
    return pa.RecordBatch.from_arrays(
        [part.column(0), pa.array(w.counts, type=pa.int64()), pa.array(removed, type=pa.int64()),
         pa.array(kept, type=pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words removed from every whole document as repeats of 20 words."""
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def brute_force(docs: list[tuple], window: int = WINDOW) -> list[tuple]:
    """The contract by plain loops (for tests)."""
    words = {d: (t or "").encode().split() for d, t in docs}
    seen, out = set(), []
    for d in sorted(words):
        w = words[d]
        gone = set()
        for i in range(len(w) - window + 1):
            if (x := tuple(w[i:i + window])) in seen:
                gone.update(range(i, i + window))
            seen.add(x)
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out
