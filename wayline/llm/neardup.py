"""Near-duplicate documents by HyperMinHash (operator 9).

1. A document's set holds its distinct shingles of ``k`` words (64-bit hashes).
   Documents with equal sets (128-bit fingerprint) form a class, kept by its
   smallest id; all later work is on classes, so exact copies cost nothing.
2. Each of ``bands * rows`` buckets has a hash function of its own; the bucket's
   register is the least hash value stored as leading-zero count (6 bits) and
   leading mantissa bits (10 bits), two bytes in all.
3. Compressed registers are banded.  Within each band and key the members are
   tied to one pivot, a different one in each band: a star, never all pairs.
4. The share of equal registers, corrected for accidental register collisions,
   estimates the similarity; pairs five standard errors below the threshold go.
5. What is left is verified on the full sets of the two texts.
6. Members of a key that are still in different components after that are
   compared across components on their full sets, in blocks of bounded size: no
   pair that shares a band is lost because its pivot failed.

A link of similarity 0.8 shares no band with probability (1 - 0.8^5)^40 < 2e-7
and fails the estimate with probability below 3e-7.

Defined results: a null or blank text has an empty set and is linked with
nothing; rows that repeat an id count as one document; a row with a null id is
linked with nothing, has a null component and is kept; an empty table gives no
rows; other columns of the input play no part.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.llm.common import components, drop_written, table, written
from wayline.llm.textcode import SPACE_WORDS, Words, chunks, mix, ngrams

BANDS, ROWS = 40, 5
MANTISSA = 10
#: Members of a key that one task compares at a time in step 6.
BLOCK = 512


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    x = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return x[:n] | np.uint64(1), x[n:]


def registers(sets: np.ndarray, offs: np.ndarray, n: int) -> np.ndarray:
    """``n`` registers of each (non-empty) set of hashes."""
    a, b = _coefficients(n)
    least = np.empty((n, len(offs)), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(n):
            least[j] = np.minimum.reduceat(sets * a[j] + b[j], offs)
    least = np.maximum(least.T, np.uint64(1))
    exp = np.frexp(least.astype(np.float64))[1].astype(np.int64)  # position of the leading one, 1 to 65
    zeros = np.clip(64 - exp, 0, 63)
    mantissa = (least << (zeros + 1).clip(max=63).astype(np.uint64)) >> np.uint64(64 - MANTISSA)
    return ((zeros << MANTISSA).astype(np.uint64) | mantissa).astype("<u2")


def shingle_sets(col: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; the whole sequence where it has fewer than ``k`` words."""
    w = Words(col, SPACE_WORDS, True)
    h = w.hashes()
    g = ngrams(h, k)
    out = []
    for lo, hi in zip(w.offs[:-1].tolist(), w.offs[1:].tolist()):
        if hi - lo >= k:
            out.append(np.unique(g[lo:hi - k + 1]))
        elif hi > lo:
            out.append(mix(ngrams(h[lo:hi], hi - lo) + np.uint64(hi - lo)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def sketch(docs: DataFrame, id_col: str, text: str, k: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, fp (binary, null if empty), sig (registers, null if empty)."""
    def run(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                sets = shingle_sets(part.column(1), k)
                size = np.array([len(s) for s in sets], dtype=np.int64)
                full = np.flatnonzero(size)
                fp, sig = [None] * len(sets), [None] * len(sets)
                if len(full):
                    offs = np.concatenate([[0], np.cumsum(size[full])[:-1]])
                    regs = registers(np.concatenate([sets[i] for i in full]), offs, bands * rows)
                    for i, r in zip(full.tolist(), regs):
                        fp[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest()
                        sig[i] = r.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(pa.int64()), pa.array(size), pa.array(fp, type=pa.binary()), pa.array(sig, type=pa.binary())],
                    names=["doc_id", "n_shingles", "fp", "sig"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, "doc_id long, n_shingles long, fp binary, sig binary")


def band_keys(classes: DataFrame, bands: int, rows: int) -> DataFrame:
    """(key, band, doc): one row for each band of each class; key depends on the band."""
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                n = part.num_rows
                regs = np.frombuffer(b"".join(part.column(1).to_pylist()), dtype="<u2").reshape(n, bands, rows)
                key = np.repeat(np.arange(1, bands + 1, dtype=np.uint64)[None, :], n, axis=0)
                for r in range(rows):
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + regs[:, :, r].astype(np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.ravel().view(np.int64)), pa.array(np.tile(np.arange(bands, dtype=np.int16), n)),
                     pa.array(np.repeat(part.column(0).to_numpy(), bands))], names=["key", "band", "doc"])

    return classes.select("doc", "sig").mapInArrow(run, "key long, band short, doc long")


def accidental(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Probability that registers of two different least values agree, for sets of n and m elements."""
    i = np.arange(64)[:, None]
    p = lambda c: (1 - 2.0 ** -(i + 1)) ** c - (1 - 2.0 ** -i) ** c  # noqa: E731  least value has i leading zeros
    return (p(n) * p(m)).sum(axis=0) / 2 ** MANTISSA


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard similarity from two register arrays, corrected for accidental collisions."""
    c, g = (a == b).mean(axis=-1), accidental(n, m)
    return (c - g) / (1 - g)


def _lowest(threshold: float, n: int) -> float:
    return threshold - 5 * np.sqrt(threshold * (1 - threshold) / n)


def likely(pairs: DataFrame, classes: DataFrame, threshold: float, n: int) -> DataFrame:
    """Pairs (a, b) whose estimated similarity isn't clearly under the threshold."""
    side = lambda x: classes.select(F.col("doc").alias(x), F.col("sig").alias(f"s{x}"), F.col("n").alias(f"n{x}"))
    both = pairs.hint("merge").join(side("a"), "a").hint("merge").join(side("b"), "b").select("a", "b", "sa", "sb", "na", "nb")
    low = _lowest(threshold, n)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                s = [np.frombuffer(b"".join(part.column(i).to_pylist()), dtype="<u2").reshape(-1, n) for i in (2, 3)]
                na, nb = part.column(4).to_numpy(), part.column(5).to_numpy()
                # similarity is at most the ratio of the set sizes
                ok = (estimate(s[0], s[1], na, nb) >= low) & (np.minimum(na, nb) >= threshold * np.maximum(na, nb) - 1e-9)
                yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(ok)), part.column(1).filter(pa.array(ok))],
                                                 names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def _word_set(text: str | None, k: int) -> frozenset:
    w = (text or "").encode().lower().split()
    return frozenset(zip(*(w[i:] for i in range(k)))) if len(w) >= k else frozenset([tuple(w)] if w else [])


def verified(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs whose full sets satisfy 100 * intersection >= percent * union."""
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct()
    # always a sorted join: the plan is the same at every size
    texts = written(docs.join(ids.hint("merge"), "doc_id", "left_semi"), "texts")
    both = (pairs.hint("merge").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b").hint("merge")
            .join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")
            .select("a", "b", "ta", "tb"))

    def run(batches):
        last, held = None, frozenset()
        for batch in batches:
            keep = []
            for i in range(batch.num_rows):
                a = batch.column(0)[i].as_py(), batch.column(2)[i].as_py()
                if a != last:
                    last, held = a, _word_set(a[1], k)
                other = _word_set(batch.column(3)[i].as_py(), k)
                common = len(held & other)
                keep.append(100 * common >= percent * (len(held) + len(other) - common) and common > 0)
            ok = pa.array(keep, type=pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], names=["a", "b"])

    return written(both.mapInArrow(run, "a long, b long"), "links")


def _contested(members: DataFrame, comp: DataFrame, classes: DataFrame, docs: DataFrame, k: int, percent: int,
               bands: int, rows: int) -> DataFrame:
    """Links between members of one key that are still in different components.

    The members of a key are dealt into blocks of at most about ``BLOCK``; those
    outside the key's largest component meet every block.  First the registers
    alone tell which members have a likely partner elsewhere, then only these
    are compared on their full sets.  A pair is compared in the first band it
    shares; a block returns one link for each member and foreign component.
    """
    n, threshold = bands * rows, percent / 100
    low = _lowest(threshold, n)
    named = members.join(comp.withColumnRenamed("node", "doc"), "doc", "left").select(
        "key", "band", "doc", F.coalesce("component", "doc").alias("comp"))
    per = named.groupBy("key", "comp").agg(F.count("*").alias("c"))
    keys = per.groupBy("key").agg(F.sum("c").alias("n"), F.count("*").alias("comps"),
                                  F.max(F.struct("c", "comp")).alias("top")).where("comps > 1")
    all_rows = named.join(keys, "key").select(
        "key", "band", "doc", "comp", (F.col("comp") != F.col("top.comp")).alias("minor"),
        F.ceil(F.col("n") / BLOCK).cast("int").alias("nl"), F.ceil((F.col("n") - F.col("top.c")) / BLOCK).cast("int").alias("nr"))
    part = lambda c: F.pmod(F.xxhash64("doc"), F.col(c)).cast("int")
    left = all_rows.select("key", "band", "doc", "comp", F.lit(False).alias("right"), part("nl").alias("c"),
                           F.explode(F.sequence(F.lit(0), F.col("nr") - 1)).alias("d"))
    right = all_rows.where("minor").select("key", "band", "doc", "comp", F.lit(True).alias("right"),
                                           F.explode(F.sequence(F.lit(0), F.col("nl") - 1)).alias("c"), part("nr").alias("d"))
    blocks = left.union(right).hint("merge").join(classes.select("doc", "sig", F.col("n").alias("size")), "doc")

    def partners(t: pa.Table):
        """(row of the right side, rows of the left side that may be linked with it)."""
        is_right = t.column("right").to_numpy(zero_copy_only=False)
        doc, group, size, band = (t.column(c).to_numpy() for c in ("doc", "comp", "size", "band"))
        regs = np.frombuffer(b"".join(t.column("sig").to_pylist()), dtype="<u2").reshape(-1, n)
        lhs = np.flatnonzero(~is_right)
        for r in np.flatnonzero(is_right):
            x = lhs[(group[lhs] != group[r]) & (np.minimum(size[lhs], size[r]) >= threshold * np.maximum(size[lhs], size[r]) - 1e-9)]
            if len(x):
                same = regs[x] == regs[r]
                c, g = same.mean(axis=1), accidental(size[x], np.full(len(x), size[r]))
                first = same.reshape(-1, bands, rows).all(axis=2).argmax(axis=1) == band[r]
                x = x[((c - g) / (1 - g) >= low) & first]
                if len(x):
                    yield r, x, doc, group

    def involved(t: pa.Table) -> pa.Table:
        keep = np.zeros(t.num_rows, dtype=bool)
        for r, x, _, _ in partners(t):
            keep[r] = True
            keep[x] = True
        return t.filter(pa.array(keep))

    likely_rows = written(blocks.groupBy("key", "c", "d").applyInArrow(involved, blocks.schema), "involved")
    texts = docs.join(likely_rows.select(F.col("doc").alias("doc_id")).distinct().hint("merge"), "doc_id", "left_semi")
    full = texts.mapInArrow(_sets_of(k), "doc long, full binary").dropDuplicates(["doc"])

    def confirm(t: pa.Table) -> pa.Table:
        full = [np.frombuffer(x, dtype=np.uint64) for x in t.column("full").to_pylist()]
        out = []
        for r, x, doc, group in partners(t):
            own, many = full[r], np.concatenate([full[i] for i in x])
            sizes = np.array([len(full[i]) for i in x])
            at = np.minimum(np.searchsorted(own, many), len(own) - 1)
            common = np.add.reduceat(own[at] == many, np.concatenate([[0], np.cumsum(sizes)[:-1]]))
            ok = x[100 * common >= percent * (sizes + len(own) - common)]
            _, one = np.unique(group[ok], return_index=True)
            out += [(int(doc[i]), int(doc[r])) for i in ok[one]]
        return pa.table({"a": pa.array([a for a, _ in out], type=pa.int64()), "b": pa.array([b for _, b in out], type=pa.int64())})

    links = written(likely_rows.join(full, "doc").groupBy("key", "c", "d").applyInArrow(confirm, "a long, b long"), "links")
    drop_written(likely_rows)
    return links


def _sets_of(k: int):
    def run(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                sets = shingle_sets(part.column(part.schema.get_field_index("text")), k)
                yield pa.RecordBatch.from_arrays(
                    [part.column(part.schema.get_field_index("doc_id")), pa.array([s.tobytes() for s in sets], type=pa.binary())],
                    names=["doc", "full"])
    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80,
                    bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable), kept, for every row of ``docs``."""
    n, threshold = bands * rows, percent / 100
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    sketches = written(sketch(docs, "doc_id", "text", k, bands, rows), "sketches")
    # sig depends on fp alone, so any row of a class will do
    reps = sketches.where("fp is not null and doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("doc"))
    classes = written(
        sketches.where("fp is not null").join(reps.withColumnRenamed("doc", "doc_id"), ["fp", "doc_id"]).dropDuplicates(["fp"])
        .select("fp", F.col("doc_id").alias("doc"), F.col("n_shingles").alias("n"), "sig"), "classes")
    keys = band_keys(classes, bands, rows)
    order = F.struct(F.xxhash64("key", "doc").alias("h"), F.col("doc").alias("doc"))
    shared = keys.groupBy("key").agg(F.min(order).alias("p"), F.count("*").alias("c")).where("c > 1")
    members = written(keys.join(shared, "key").select("key", "band", "doc", F.col("p.doc").alias("pivot")), "members")
    star = members.where("doc <> pivot").select(F.least("doc", "pivot").alias("a"), F.greatest("doc", "pivot").alias("b")).distinct()
    done = written(likely(star, classes, threshold, n), "likely")
    links = verified(done, docs, k, percent)
    comp = components(links)
    more = _contested(members, comp, classes, docs, k, percent, bands, rows)
    if not more.isEmpty():
        comp = components(links.union(more))
    for x in (members, done):
        drop_written(x)
    of_class = classes.select("fp", F.col("doc").alias("node")).join(comp, "node", "left").select(
        "fp", F.coalesce("component", "node").alias("component"))
    out = sketches.select("doc_id", "n_shingles", "fp").join(of_class, "fp", "left")
    return out.select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op9_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components over two-word shingles of every whole document."""
    return near_duplicates(table(spark, sf_dir, "documents"), k=2)


def brute_force(docs: list[tuple], k: int = 2, percent: int = 80) -> list[tuple]:
    """The contract by all pairs (for tests)."""
    sets = {d: _word_set(t, k) for d, t in docs}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            if sets[a] and sets[b] and 100 * (c := len(sets[a] & sets[b])) >= percent * len(sets[a] | sets[b]) and c:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return [(d, len(sets[d]), root(d), root(d) == d) for d in ids]
