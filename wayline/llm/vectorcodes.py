"""Vector code compression by per-dimension value dictionaries (operator 13).

Components become integers; a vector is cut into ``PARTS`` consecutive parts, and
each part is replaced by the number of the nearest entry of its codebook.

1. Vectors are packed once into blocks of bounded size, written to the shared
   folder.  A block holds, for each dimension, the dictionary of its distinct
   integers and one two-byte dictionary code for each vector.
2. To assign a block, the squared differences of every distinct integer to the
   component of all codebook entries are tabulated for each dimension; the
   distances of a part are then gathers from these tables and adds.
3. Each round sums the members of every entry inside each task, adds the sums up in
   Spark and replaces the codebooks.  The driver holds codebooks alone: at most
   ``ENTRIES`` x dimension integers, whatever the number of vectors.

Defined results: a row whose vector is null, empty or holds null or non-finite
components is dropped.  All codes are of one length, that of the vector with the
smallest id (of the longer ones, if ids repeat, the shortest); rows of other
lengths, and rows with a component so large that squared distances don't fit in 64
bits, are returned with null code and error and take no part.  Rows that repeat an
id count each, the initial entries in the order of (id, components); rows with a
null id come last there.  With fewer than ``ENTRIES`` vectors the codebooks are as
short.  A length that isn't a multiple of ``PARTS`` is cut at floor(part * length /
PARTS).  An empty table gives no rows; other columns of the input play no part.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType, IntegerType, BinaryType, BooleanType

from wayline.llm.common import drop_written, table, written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Components of a block (its vectors times their length) and, at most, vectors.
BLOCK_VALUES, BLOCK_ROWS = 1 << 19, 8192
#: Vectors whose distances to all entries are held at a time.
GATHER_ROWS = 256


def largest(dim: int) -> int:
    """Components up to this magnitude have squared distances below 2**62."""
    return math.isqrt((1 << 60) // max(dim, 1))


def cuts(dim: int) -> list[int]:
    """First position of each part, and the end."""
    return [dim * p // PARTS for p in range(PARTS + 1)]


def _encode(x: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """(sizes of the dictionaries, dictionaries, codes by dimension) of an integer matrix."""
    values, codes = [], np.empty(x.shape[::-1], dtype="<u2")
    for d in range(x.shape[1]):
        v, codes[d] = np.unique(x[:, d], return_inverse=True)
        values.append(v.astype("<i8"))
    return np.array([len(v) for v in values], dtype="<i4").tobytes(), np.concatenate(values).tobytes(), codes.tobytes()


def _block_schema(ids, labels) -> StructType:
    return StructType([StructField("dim", IntegerType()), StructField("fits", BooleanType()),
                       StructField("ids", ArrayType(ids)), StructField("labels", ArrayType(labels)),
                       StructField("sizes", BinaryType()), StructField("dicts", BinaryType()), StructField("codes", BinaryType())])


def blocks_of(rows: DataFrame) -> DataFrame:
    """Rows (id, label, v array<double>) packed into blocks of one length."""
    schema = _block_schema(rows.schema["id"].dataType, rows.schema["label"].dataType)

    def listed(a: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array([0, len(a)], type=pa.int32()), a)

    def pack(dim: int, fits: bool, ids: pa.Array, labels: pa.Array, x: np.ndarray) -> pa.RecordBatch:
        coded = _encode(x) if fits else (b"", b"", b"")
        return pa.RecordBatch.from_arrays(
            [pa.array([dim], type=pa.int32()), pa.array([fits]), listed(ids), listed(labels), *[pa.array([c], type=pa.binary()) for c in coded]],
            names=schema.fieldNames())

    def run(batches):
        held: dict[tuple[int, bool], list] = {}
        for batch in batches:
            col = batch.column(2)
            offs = col.offsets.to_numpy().astype(np.int64)
            values = col.values.slice(offs[0], offs[-1] - offs[0])
            flat = values.to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become nan
            offs = offs - offs[0]
            with np.errstate(invalid="ignore", over="ignore"):
                scaled = np.floor(flat * SCALE)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
            dims = np.diff(offs)
            ok = (dims > 0) & (bad[offs[1:]] == bad[offs[:-1]]) & np.asarray(col.is_valid())
            for dim in np.unique(dims[ok]).tolist():
                at = np.flatnonzero(ok & (dims == dim))
                x = scaled[offs[at][:, None] + np.arange(dim)[None, :]]
                fit = (np.abs(x) <= largest(dim)).all(axis=1)
                for fits, own in ((True, fit), (False, ~fit)):
                    if not own.any():
                        continue
                    take = pa.array(at[own])
                    part = (batch.column(0).take(take), batch.column(1).take(take), x[own].astype(np.int64) if fits else x[own][:, :0])
                    most = max(1, min(BLOCK_ROWS, BLOCK_VALUES // dim))
                    parts = held.setdefault((dim, fits), [])
                    parts.append(part)
                    while sum(len(p[0]) for p in parts) >= most:
                        whole = _joined(parts)
                        yield pack(dim, fits, *[c[:most] for c in whole])
                        parts[:] = [tuple(c[most:] for c in whole)] if len(whole[0]) > most else []
        for (dim, fits), parts in held.items():
            if parts:
                yield pack(dim, fits, *_joined(parts))

    return rows.select("id", "label", "v").mapInArrow(run, schema)


def _joined(parts: list) -> tuple:
    if len(parts) == 1:
        return parts[0]
    return pa.concat_arrays([p[0] for p in parts]), pa.concat_arrays([p[1] for p in parts]), np.concatenate([p[2] for p in parts])


class Block:
    """Dictionaries and codes of one block."""

    def __init__(self, dim: int, sizes: bytes, dicts: bytes, codes: bytes):
        ends = np.cumsum(np.frombuffer(sizes, dtype="<i4"))
        self.values = np.split(np.frombuffer(dicts, dtype="<i8"), ends[:-1])
        self.codes = np.frombuffer(codes, dtype="<u2").reshape(dim, -1)

    def matrix(self) -> np.ndarray:
        return np.stack([v[c] for v, c in zip(self.values, self.codes)], axis=1)

    def assign(self, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(entry of each part, squared distance summed over the parts) of each vector."""
        n, at = self.codes.shape[1], cuts(len(self.codes))
        entry, error = np.zeros((PARTS, n), dtype=np.int64), np.zeros(n, dtype=np.int64)
        for p, book in enumerate(books):
            dims = range(at[p], at[p + 1])
            if not len(dims):
                continue
            wide = max(int(max(np.abs(self.values[d]).max(), np.abs(book[:, d - at[p]]).max())) for d in dims)
            kind = np.int32 if len(dims) * (2 * wide) ** 2 < 2**31 else np.int64
            tables = [((self.values[d][:, None] - book[None, :, d - at[p]]) ** 2).astype(kind) for d in dims]
            for lo in range(0, n, GATHER_ROWS):
                hi = min(n, lo + GATHER_ROWS)
                far = tables[0][self.codes[at[p], lo:hi]]
                for t, d in zip(tables[1:], dims[1:]):
                    far += t[self.codes[d, lo:hi]]
                entry[p, lo:hi] = best = far.argmin(axis=1)  # the first of equal ones
                error[lo:hi] += far[np.arange(hi - lo), best]
        return entry, error


def _each(batch: pa.RecordBatch, dim: int):
    """(row number, Block or None) of the blocks of a batch."""
    names = batch.schema.names
    col = {c: batch.column(names.index(c)) for c in ("dim", "fits", "sizes", "dicts", "codes")}
    for i in range(batch.num_rows):
        same = col["dim"][i].as_py() == dim and col["fits"][i].as_py()
        yield i, Block(dim, col["sizes"][i].as_py(), col["dicts"][i].as_py(), col["codes"][i].as_py()) if same else None


def first_entries(blocks: DataFrame, dim: int) -> list[np.ndarray]:
    """Codebooks made of the vectors with the smallest ids."""
    id_type = blocks.schema["ids"].dataType.elementType
    schema = StructType([StructField("id", id_type), StructField("v", ArrayType(LongType()))])

    def smallest(batches):
        for batch in batches:
            ids = batch.column(batch.schema.names.index("ids"))
            for i, block in _each(batch, dim):
                if block is None:
                    continue
                x, own = block.matrix(), ids[i].values
                order = np.lexsort([*x.T[::-1], _rank(own)])[:ENTRIES]
                yield pa.RecordBatch.from_arrays(
                    [own.take(pa.array(order)), pa.array(x[order].tolist(), type=pa.list_(pa.int64()))], names=["id", "v"])

    top = blocks.select("dim", "fits", "ids", "sizes", "dicts", "codes").mapInArrow(smallest, schema).orderBy(
        F.col("id").asc_nulls_last(), "v").limit(ENTRIES).collect()  # ENTRIES vectors at most
    x, at = np.array([r.v for r in top], dtype=np.int64).reshape(-1, dim), cuts(dim)
    return [x[:, at[p]:at[p + 1]] for p in range(PARTS)]


def _rank(ids: pa.Array) -> np.ndarray:
    """Order of the ids, equal ids alike and nulls last."""
    import pyarrow.compute as pc
    return pc.rank(ids, sort_keys="ascending", null_placement="at_end", tiebreaker="dense").to_numpy()


def refined(blocks: DataFrame, dim: int, books: list[np.ndarray]) -> list[np.ndarray]:
    """Codebooks after one round: every entry is the floored mean of its members, unused ones stay."""
    at = cuts(dim)

    def sums(batches):
        total = [np.zeros((len(b), b.shape[1] + 1), dtype=object) for b in books]
        for batch in batches:
            for _, block in _each(batch, dim):
                if block is None:
                    continue
                entry, _ = block.assign(books)
                x = np.concatenate([block.matrix(), np.ones((entry.shape[1], 1), dtype=np.int64)], axis=1)
                for p, book in enumerate(books):
                    order = np.argsort(entry[p], kind="stable")
                    who, first = np.unique(entry[p][order], return_index=True)
                    own = np.concatenate([x[:, at[p]:at[p + 1]], x[:, -1:]], axis=1)
                    total[p][who] += np.add.reduceat(own[order], first)
        for p, t in enumerate(total):
            who, pos = np.nonzero(np.broadcast_to(t[:, -1:] != 0, t.shape))
            if len(who):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(who), p, dtype=np.int32)), pa.array(who.astype(np.int32)), pa.array(pos.astype(np.int32)),
                     pa.array([int(v) for v in t[who, pos]], type=pa.decimal128(38, 0))], names=["part", "entry", "pos", "total"])

    # ENTRIES x (dim + PARTS) rows reach the driver; decimals, so no sum overflows
    rows = (blocks.select("dim", "fits", "sizes", "dicts", "codes").mapInArrow(sums, "part int, entry int, pos int, total decimal(38,0)")
            .groupBy("part", "entry", "pos").agg(F.sum("total").alias("total")).collect())
    total = [np.zeros((len(b), b.shape[1] + 1), dtype=object) for b in books]
    for r in rows:
        total[r.part][r.entry, r.pos] = int(r.total)
    out = []
    for t, b in zip(total, books):
        used = t[:, -1] != 0
        new = b.copy()
        new[used] = (t[used, :-1] // t[used, -1:]).astype(np.int64)
        out.append(new)
    return out


def books_digest(books: list[np.ndarray]) -> str:
    """Hex sha256 of all entries' decimal components by part, entry and position."""
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


def compress(vectors: DataFrame, id_col: str = "vec_id", vec: str = "embedding", label: str = "label",
             rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """(id, label, code, error of every kept vector, the codebooks of the parts)."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label).alias("label"), F.col(vec).cast("array<double>").alias("v"))
    blocks = written(blocks_of(rows.where(F.col("v").isNotNull())), "vector-blocks")
    first = blocks.where("fits").agg(F.min(F.struct(F.array_min("ids").isNull(), F.array_min("ids"), "dim")).alias("m")).first()["m"]
    dim = first["dim"] if first else 0
    books = first_entries(blocks, dim) if first else [np.zeros((0, 0), dtype=np.int64)] * PARTS
    for _ in range(rounds if first else 0):
        books = refined(blocks, dim, books)
    schema = StructType([StructField("vec_id", rows.schema["id"].dataType), StructField("label", rows.schema["label"].dataType),
                         StructField("code", BinaryType()), StructField("error", LongType())])

    def code(batches):
        for batch in batches:
            ids, labels = (batch.column(batch.schema.names.index(c)) for c in ("ids", "labels"))
            for i, block in _each(batch, dim):
                n = len(ids[i].values)
                if block is None:
                    out = [pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64())]
                else:
                    entry, error = block.assign(books)
                    packed = np.ascontiguousarray(entry.T.astype(np.uint8))
                    out = [pa.array([r.tobytes() for r in packed], type=pa.binary()), pa.array(error)]
                yield pa.RecordBatch.from_arrays([ids[i].values, labels[i].values, *out], names=schema.fieldNames())

    coded = written(blocks.mapInArrow(code, schema), "vector-codes")
    drop_written(blocks)
    return coded, books


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes and errors of all embeddings, the errors summed by label, and a digest of the codebooks."""
    coded, books = compress(table(spark, sf_dir, "embeddings"))
    per = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label")
    return coded.join(per, F.col("label").eqNullSafe(F.col("_label")), "left").select(
        "vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def brute_force(rows: list[tuple], rounds: int = ROUNDS) -> tuple[list[tuple], list]:
    """The contract row by row in plain Python (for tests): rows are (id, label, vector of one length)."""
    kept = [(i, lab, [math.floor(SCALE * c) for c in v]) for i, lab, v in rows
            if v and all(c is not None and math.isfinite(c) for c in v)]
    if not kept:
        return [], []
    at = cuts(len(kept[0][2]))
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:ENTRIES]
    books = [[r[2][at[p]:at[p + 1]] for r in first] for p in range(PARTS)]

    def nearest(v, p):
        x = v[at[p]:at[p + 1]]
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        new = []
        for p in range(PARTS):
            members: dict[int, list] = {}
            for _, _, v in kept:
                members.setdefault(nearest(v, p)[1], []).append(v[at[p]:at[p + 1]])
            new.append([[sum(c) // len(members[k]) for c in zip(*members[k])] if k in members else e for k, e in enumerate(books[p])])
        books = new
    out = []
    for i, lab, v in kept:
        best = [nearest(v, p) for p in range(PARTS)]
        out.append((i, lab, "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best)))
    return out, books


def _oracle() -> str:
    """The whole contract as SQL: one pair of expressions (assignment, means) a round."""
    out = ["""
x AS MATERIALIZED (
    SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda c: floor(1024 * c)::BIGINT) AS v, row_number() OVER (ORDER BY vec_id) AS rn
    FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
n AS MATERIALIZED (SELECT len(v) // 4 AS w FROM x WHERE rn = 1),
c AS MATERIALIZED (SELECT rn, p::INTEGER AS p, i::INTEGER AS i, v[p * w + i + 1] AS c
                   FROM x, n, range(4) t(p), range(w) u(i)),
b0 AS MATERIALIZED (SELECT p, (rn - 1)::INTEGER AS e, i, c FROM c WHERE rn <= 256)"""]
    for r in range(ROUNDS + 1):
        out.append(f"""
a{r} AS MATERIALIZED (
    SELECT rn, p, arg_min(e, (d, e)) AS e, min(d) AS d
    FROM (SELECT c.rn, c.p, b.e, sum((c.c - b.c) * (c.c - b.c)) AS d FROM c JOIN b{r} b ON c.p = b.p AND c.i = b.i GROUP BY ALL) t
    GROUP BY rn, p)""")
        if r < ROUNDS:
            out.append(f"""
b{r + 1} AS MATERIALIZED (
    SELECT b.p, b.e, b.i, coalesce(m.c, b.c) AS c
    FROM b{r} b LEFT JOIN (SELECT c.p, a.e, c.i, floor(sum(c.c)::DOUBLE / count(*))::BIGINT AS c
                           FROM c JOIN a{r} a ON c.rn = a.rn AND c.p = a.p GROUP BY ALL) m ON b.p = m.p AND b.e = m.e AND b.i = m.i)""")
    out.append(f"""
s AS (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM b{ROUNDS}),
f AS (SELECT rn, string_agg(format('{{:02x}}', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS} GROUP BY rn)
SELECT x.vec_id, f.code, f.error, (sum(f.error) OVER (PARTITION BY x.label))::BIGINT AS label_error, s.codebooks_sha256
FROM x JOIN f ON x.rn = f.rn, s""")
    return "WITH " + ",".join(out[:-1]) + "," + out[-1]


ORACLE = _oracle()
