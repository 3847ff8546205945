"""N-gram Jaccard join by size-banded tiles and hashed bitmap signatures (operator 12).

Two sets of sizes a <= b with similarity of at least ``percent`` / 100 have
100 * a >= percent * b and a symmetric difference of at most
D = (a + b) * (100 - percent) / (100 + percent).

1. A document's set holds its distinct shingles of ``k`` words (64-bit hashes, which
   two of a billion shingles share with probability below 3%, and then a count is off
   by one).  Documents with equal sets form a class, kept by its smallest id.
2. Sizes are cut into bands such that linked sets lie in one band or in adjacent ones.
   The hash range is cut into D + 1 parts (D of the band): two linked sets differ in at
   most D of them, so at least one part is the same in both.  The content of a part is
   the key of a tile; a set enters the tiles of its own band and of the next lower one.
   No frequent shingle makes a tile large: only near copies share whole parts.
3. Each set has a bitmap of hashed bits, as wide as its band asks.  Every bit in which
   two bitmaps differ is a different shingle, so bit counts bound the overlap from
   above.  Bitmaps of different widths are folded to the narrower one.
4. In each tile the members are first compared with the tile's smallest id (a star), by
   bitmaps, then by exact intersection of the sorted arrays.
5. Members of a tile that are still in different components are compared with each
   other, in blocks of bounded bytes, by bitmaps and sorted arrays in turn.  A block gives
   at most one link for a member and foreign component; no pair of a tile is left out.

Defined results: a null or blank text has an empty set and is linked with nothing;
rows that repeat an id count as one document; a row with a null id is linked with
nothing and has a null component; an empty table gives no rows; other columns of the
input play no part.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.llm.common import components, drop_written, table, written
from wayline.llm.neardup import shingle_sets
from wayline.llm.textcode import chunks, mix

#: Members of a tile that one task compares with as many others, and shingles they may hold together.
BLOCK_ROWS, BLOCK_SHINGLES = 512, 1 << 21
#: Bits of a bitmap for each shingle of the largest set of its band.
BITS = 4


def most_different(size: int, percent: int) -> int:
    """Largest symmetric difference of a linked pair whose lesser set has at most ``size`` elements."""
    return (size + size * 100 // percent) * (100 - percent) // (100 + percent)


@lru_cache(maxsize=None)
def _bands(percent: int, upto: int) -> np.ndarray:
    """First size of each band, up to the one that holds ``upto``."""
    edges = [1]
    while edges[-1] <= upto:
        edges.append(edges[-1] * 100 // percent + 1)
    return np.array(edges, dtype=np.int64)


def band_of(size: int, percent: int) -> tuple[int, int, int]:
    """(band, its largest size, largest size of the band below) of a set of ``size`` elements."""
    edges = _bands(percent, 1 << max(size, 1).bit_length())
    i = int(np.searchsorted(edges, size, side="right")) - 1
    return i, int(edges[i + 1]) - 1, int(edges[i]) - 1


def width_of(size: int, percent: int) -> int:
    """Bits of the bitmap of a set of ``size`` elements: a power of two, 64 at least."""
    return max(64, 1 << (BITS * band_of(size, percent)[1] - 1).bit_length())


def bitmap(shingles: np.ndarray, width: int) -> bytes:
    """Bitmap of a set: the bit of a shingle is its hash modulo ``width``."""
    bits = np.zeros(width, dtype=np.uint8)
    bits[(shingles & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def folded(bits: np.ndarray, width: int) -> np.ndarray:
    """Bitmaps (rows of bytes) as they would be with only ``width`` bits."""
    while bits.shape[1] * 8 > width:
        half = bits.shape[1] // 2
        bits = bits[:, :half] | bits[:, half:]
    return bits


def may_link(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Whether bitmaps and sizes leave room for a link."""
    differ = np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64)
    return ((n + m - differ) * (100 + percent) >= 2 * percent * (n + m)) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))


@lru_cache(maxsize=4096)
def _cuts(parts: int) -> np.ndarray:
    """Lower ends of the parts of the hash range but the first."""
    return np.array([(j << 64) // parts for j in range(1, parts)], dtype=np.uint64)


def tile_keys(shingles: np.ndarray, percent: int) -> np.ndarray:
    """Keys of all tiles of a sorted set: one for each part, in its own band and in the one below where that holds partners."""
    size = len(shingles)
    band, high, below = band_of(size, percent)
    with np.errstate(over="ignore"):
        running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(shingles + np.uint64(0x632BE59BD9B4E019)), dtype=np.uint64)])
        out = []
        for b, top in ((band, high), (band - 1, below)):
            if top < 1 or percent * size > 100 * top:
                continue
            parts = most_different(top, percent) + 1
            ends = np.concatenate([[0], np.searchsorted(shingles, _cuts(parts)), [size]])
            content = running[ends[1:]] - running[ends[:-1]] + np.diff(ends).astype(np.uint64)
            out.append(mix(content ^ mix((np.arange(parts, dtype=np.uint64) << np.uint64(20)) + np.uint64(b + 1))))
    return np.concatenate(out)


def sketch(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, n_shingles and, of non-empty sets, fp, tiles (keys) and bits."""
    def run(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                sets = shingle_sets(part.column(1), k)
                full = [s if len(s) else None for s in sets]
                each = lambda f: pa.array([f(s) if s is not None else None for s in full], type=pa.binary())  # noqa: B023,E731
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(s) for s in sets], type=pa.int64()),
                     each(lambda s: hashlib.blake2b(s.tobytes(), digest_size=16).digest()),
                     each(lambda s: tile_keys(s, percent).tobytes()), each(lambda s: bitmap(s, width_of(len(s), percent)))],
                    names=["doc_id", "n_shingles", "fp", "tiles", "bits"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, fp binary, tiles binary, bits binary")


def _tiles(classes: DataFrame) -> DataFrame:
    """(key, doc): one row for each tile that a class enters."""
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                keys = [np.frombuffer(x, dtype=np.int64) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys)), pa.array(np.repeat(part.column(0).to_numpy(), [len(x) for x in keys]))],
                    names=["key", "doc"])

    return classes.select("doc", "tiles").mapInArrow(run, "key long, doc long")


def _rows_of(col, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(col), dtype=np.uint8).reshape(len(col), width // 8)


def likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that the bitmaps leave room for."""
    side = lambda x: classes.select(F.col("doc").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"s{x}"))
    both = pairs.hint("merge").join(side("a"), "a").hint("merge").join(side("b"), "b").select("a", "b", "na", "nb", "sa", "sb")

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                n, m = part.column(2).to_numpy(), part.column(3).to_numpy()
                x, y = part.column(4).to_pylist(), part.column(5).to_pylist()
                wide = np.array([[len(s), len(t)] for s, t in zip(x, y)]) * 8
                ok = np.zeros(len(n), dtype=bool)
                for wx, wy in np.unique(wide, axis=0).tolist():
                    own = np.flatnonzero((wide == (wx, wy)).all(axis=1))
                    low = min(wx, wy)
                    ok[own] = may_link(folded(_rows_of([x[i] for i in own], wx), low), folded(_rows_of([y[i] for i in own], wy), low),
                                       n[own], m[own], percent)
                yield pa.RecordBatch.from_arrays([part.column(i).filter(pa.array(ok)) for i in (0, 1)], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def sets_of(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(doc, full): the sorted set of each document named in ``ids`` (column doc)."""
    def run(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([s.tobytes() for s in shingle_sets(part.column(1), k)], type=pa.binary())], names=["doc", "full"])

    named = docs.join(ids.select(F.col("doc").alias("doc_id")).distinct().hint("merge"), "doc_id", "left_semi").select("doc_id", "text")
    return named.mapInArrow(run, "doc long, full binary").dropDuplicates(["doc"])


def common(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays."""
    if len(x) > len(y):
        x, y = y, x
    return int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())


def confirmed(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs whose sets satisfy 100 * intersection >= percent * union."""
    ids = pairs.select(F.col("a").alias("doc")).union(pairs.select("b"))
    sets = written(sets_of(docs, ids, k), "sets")
    both = (pairs.hint("merge").join(sets.select(F.col("doc").alias("b"), F.col("full").alias("y")), "b")
            .hint("merge").join(sets.select(F.col("doc").alias("a"), F.col("full").alias("x")), "a").select("a", "b", "x", "y"))

    def run(batches):
        for batch in batches:
            keep = []
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[i].as_py(), dtype=np.uint64) for c in (2, 3))
                c = common(x, y)
                keep.append(100 * c >= percent * (len(x) + len(y) - c))
            ok = pa.array(keep, type=pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(ok) for c in (0, 1)], names=["a", "b"])

    links = written(both.mapInArrow(run, "a long, b long"), "links")
    drop_written(sets)
    return links


def within_tiles(members: DataFrame, comp: DataFrame, classes: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Links between members of one tile that are still in different components.

    A tile's members are dealt into blocks; those outside its largest component meet
    every block.  The bitmaps tell which members may have a partner in another
    component, and these are compared on their sorted sets.
    """
    named = members.join(comp.withColumnRenamed("node", "doc"), "doc", "left").select(
        "key", "doc", F.coalesce("component", "doc").alias("comp"))
    tiles = (named.groupBy("key", "comp").agg(F.count("*").alias("c")).groupBy("key")
             .agg(F.sum("c").alias("c"), F.count("*").alias("comps"), F.max(F.struct("c", "comp")).alias("top")).where("comps > 1"))
    open_rows = written(named.join(tiles, "key").join(classes.select("doc", "n", "bits").hint("merge"), "doc").select(
        "key", "doc", "comp", "n", "bits", (F.col("comp") != F.col("top.comp")).alias("minor"), F.col("c").alias("rows"),
        (F.col("c") - F.col("top.c")).alias("minors")), "open")
    # sets of a tile differ by two bands at most: its members' sizes are alike, any row's n bounds the block
    per = F.greatest(F.lit(1), F.least(F.lit(BLOCK_ROWS), (F.lit(BLOCK_SHINGLES) / F.col("most")).cast("long")))
    size = open_rows.groupBy("key").agg(F.max("n").alias("most")).select("key", per.alias("per"))
    dealt = open_rows.join(size, "key").select(
        "key", "doc", "comp", "n", "bits", "minor", F.ceil(F.col("rows") / F.col("per")).cast("int").alias("nl"),
        F.ceil(F.col("minors") / F.col("per")).cast("int").alias("nr"))
    part = lambda c: F.pmod(F.xxhash64("doc"), F.col(c)).cast("int")
    own = ["key", "doc", "comp", "n", "bits"]
    left = dealt.select(*own, F.lit(False).alias("right"), part("nl").alias("c"), F.explode(F.sequence(F.lit(0), F.col("nr") - 1)).alias("d"))
    right = dealt.where("minor").select(*own, F.lit(True).alias("right"), F.explode(F.sequence(F.lit(0), F.col("nl") - 1)).alias("c"),
                                        part("nr").alias("d"))
    blocks = left.union(right)

    def partners(t: pa.Table):
        """(row of the right side, rows of the left side that may be linked with it)."""
        is_right = t.column("right").to_numpy(zero_copy_only=False)
        comp_, n = t.column("comp").to_numpy(), t.column("n").to_numpy()
        bits = t.column("bits").to_pylist()
        low = min(map(len, bits)) * 8
        folds = np.concatenate([folded(np.frombuffer(b, dtype=np.uint8)[None, :], low) for b in bits])
        folds = folds.view(np.uint64)
        lhs = np.flatnonzero(~is_right)
        for r in np.flatnonzero(is_right):
            x = lhs[comp_[lhs] != comp_[r]]
            x = x[may_link(folds[x], folds[r], n[x], n[r], percent)]
            if len(x):
                yield r, x, comp_

    def involved(t: pa.Table) -> pa.Table:
        keep = np.zeros(t.num_rows, dtype=bool)
        for r, x, _ in partners(t):
            keep[r] = True
            keep[x] = True
        return t.filter(pa.array(keep))

    def confirm(t: pa.Table) -> pa.Table:
        doc, sets = t.column("doc").to_numpy(), [np.frombuffer(x, dtype=np.uint64) for x in t.column("full").to_pylist()]
        out = []
        for r, x, comp_ in partners(t):
            seen = set()
            for i in x.tolist():
                if comp_[i] not in seen:
                    c = common(sets[r], sets[i])
                    if 100 * c >= percent * (len(sets[r]) + len(sets[i]) - c):
                        seen.add(comp_[i])
                        out.append((int(doc[i]), int(doc[r])))
        return pa.table({"a": pa.array([a for a, _ in out], type=pa.int64()), "b": pa.array([b for _, b in out], type=pa.int64())})

    rows = written(blocks.groupBy("key", "c", "d").applyInArrow(involved, blocks.schema), "involved")
    drop_written(open_rows)
    links = written(rows.join(sets_of(docs, rows, k).hint("merge"), "doc").groupBy("key", "c", "d").applyInArrow(
        confirm, "a long, b long"), "links")
    drop_written(rows)
    return links


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, class_id (smallest id with an equal set), component_id (smallest id reachable) for every row of ``docs``."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    sketches = written(sketch(docs, k, percent), "sketches")
    full = sketches.where("fp is not null and doc_id is not null")
    reps = full.groupBy("fp").agg(F.min("doc_id").alias("doc_id"))
    classes = written(full.join(reps, ["fp", "doc_id"]).dropDuplicates(["fp"]).select(
        "fp", F.col("doc_id").alias("doc"), F.col("n_shingles").alias("n"), "tiles", "bits"), "classes")
    tiles = _tiles(classes)
    shared = tiles.groupBy("key").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last")
    members = written(tiles.join(shared, "key").select("key", "doc", "first"), "members")
    star = members.where("doc <> first").select(F.col("first").alias("a"), F.col("doc").alias("b")).distinct()
    near = written(likely(star, classes, percent), "likely")
    links = confirmed(near, docs, k, percent)
    comp = components(links)
    more = within_tiles(members.select("key", "doc"), comp, classes, docs, k, percent)
    if not more.isEmpty():
        comp = components(links.union(more))
    for x in (members, near):
        drop_written(x)
    of_class = classes.select("fp", F.col("doc").alias("node")).join(comp, "node", "left").select(
        "fp", F.col("node").alias("class"), F.coalesce("component", "node").alias("component"))
    named = F.col("doc_id").isNotNull()
    return sketches.select("doc_id", "n_shingles", "fp").join(of_class, "fp", "left").select(
        "doc_id", "n_shingles", F.when(named, F.coalesce("class", "doc_id")).alias("class_id"),
        F.when(named, F.coalesce("component", "doc_id")).alias("component_id"))


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of three-word shingles have a similarity of 0.9 or more."""
    return similar_documents(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


#: Plain SQL: every pair that shares a shingle is counted, then links are followed until nothing changes.
ORACLE = r"""
WITH RECURSIVE w AS MATERIALIZED (
    SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                  '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS MATERIALIZED (
    SELECT doc_id, list_sort(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END) AS g FROM w),
c AS MATERIALIZED (SELECT g, min(doc_id) AS doc, len(g) AS n FROM g WHERE len(g) > 0 GROUP BY g),
s AS MATERIALIZED (SELECT doc, n, unnest(g) AS s FROM c),
l AS MATERIALIZED (
    SELECT a, b FROM (SELECT x.doc AS a, y.doc AS b, x.n AS na, y.n AS nb, count(*) AS o FROM s x JOIN s y ON x.s = y.s
          AND x.doc < y.doc AND 100 * least(x.n, y.n) >= 90 * greatest(x.n, y.n) GROUP BY ALL) t
    WHERE 100 * o >= 90 * (na + nb - o)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc, doc AS root FROM c UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc),
m AS (SELECT doc, min(root) AS root FROM r GROUP BY doc)
SELECT g.doc_id, len(g.g)::BIGINT AS n_shingles, coalesce(m.root, g.doc_id) AS component_id
FROM g LEFT JOIN c ON g.g = c.g AND len(g.g) > 0 LEFT JOIN m ON c.doc = m.doc"""
