"""Vocabularies and categorical encodings as lookup joins.

A vocabulary is a DataFrame ``(field, token, id)``.  Lookups are equi-joins
on ``(field, token)``: Catalyst/AQE broadcast the vocabulary when its
measured size is small and fall back to a sort-merge join (with skew
splitting) when it is not, so nothing assumes a vocabulary fits in memory.
"""

from __future__ import annotations

from typing import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayline.operators.ordered import numbered

# Fixed values
MISS_TOKEN = "Non"   # reserved token for unknown values; id 0 stays free for padding


def _as_array(df: DataFrame, c: str, keep_null: bool = False) -> Column:
    """Scalar -> one-element array; a null scalar -> ``[null]`` (kept) or ``[]``."""
    t = df.schema[c].dataType.typeName()
    col = F.col(c)
    if t == "array":
        return F.coalesce(col, F.array().cast(df.schema[c].dataType))
    if keep_null:
        return F.array(col)
    return F.when(col.isNull(), F.array().cast(f"array<{df.schema[c].dataType.simpleString()}>")).otherwise(F.array(col))


def _tagger(field: str):
    """``token -> struct(field, token)`` (a one-argument lambda for ``transform``)."""
    return lambda t: F.struct(F.lit(field).alias("field"), t.cast("string").alias("token"))


def _pos_tagger(out: str, field: str, rest: Column):
    """``(token, index) -> struct(out, field, pos, token, rest)``."""
    return lambda t, i: F.struct(F.lit(out).alias("out"), F.lit(field).alias("field"),
                                 i.alias("pos"), t.cast("string").alias("token"), rest.alias("rest"))


def token_pairs(df: DataFrame, fields: Mapping[str, str]) -> DataFrame:
    """One row per ``(field, token)`` occurrence, from scalar or array columns, in one pass."""
    parts = [F.transform(_as_array(df, c), _tagger(f)) for f, c in fields.items()]
    return df.select(F.inline(F.concat(*parts)))


def dense_ids(df: DataFrame, key: str, order: str, out: str = "id", first: str | None = None) -> DataFrame:
    """Dense 1-based ids by ``order`` within ``key`` (values of ``order`` distinct).

    Rows are numbered over range partitions, so no task sees a whole key.
    ``first`` (a value of ``order``) is put before all others.
    """
    if first is None:
        return numbered(df, [order], [key], out)
    return numbered(df.withColumn("_rest", F.col(order) != F.lit(first)), ["_rest", order], [key], out).drop("_rest")


def build_vocab(df: DataFrame, fields: Mapping[str, str], require: str | None = None,
                miss_token: str = MISS_TOKEN) -> DataFrame:
    """Distinct tokens of each field plus the miss token; ids dense from 1.

    The miss token has id 1 in every field (so lookups need no second pass
    over the vocabulary to find it); the other tokens follow in token order.
    ``fields`` maps a field name to a scalar or array column.  Rows whose
    ``require`` column is null do not contribute.
    """
    src = df.where(F.col(require).isNotNull()) if require else df
    pairs = token_pairs(src, fields).where(F.col("token").isNotNull())
    spark = df.sparkSession
    miss = spark.createDataFrame([(f, miss_token) for f in fields], "field string, token string")
    distinct = pairs.union(miss).distinct()
    return dense_ids(distinct, "field", "token", first=miss_token).select(
        "field", "token", F.col("id").cast("int").alias("id"))


def miss_ids(vocab: DataFrame, miss_token: str = MISS_TOKEN) -> DataFrame:
    """``(field, miss_id)``: one row per field, a bounded table."""
    return vocab.where(F.col("token") == miss_token).select("field", F.col("id").alias("miss_id"))


def encode_tokens(df: DataFrame, vocab: DataFrame, spec: Mapping[str, tuple[str, str]],
                  key: str, miss_token: str = MISS_TOKEN, miss_id: int | None = None) -> DataFrame:
    """Replace tokens by ids; unknown tokens get the miss id; order is kept.

    ``spec`` maps an output column to ``(field, input column)``; the input may
    be a scalar or an array.  All columns go through one explode, one join with
    the vocabulary and one regroup by ``key`` (the row's unique key).  The other
    columns travel on one row of the exploded form, so ``df`` is read once: select
    the ones to keep before.
    ``miss_id`` (1 for vocabularies from ``build_vocab``) saves looking the
    miss token up in the vocabulary.
    """
    others = [c for c in df.columns if c != key and c not in spec]
    rest = F.struct(F.lit(True).alias("_row"), *others)
    none = F.lit(None).cast(df.select(rest.alias("r")).schema["r"].dataType)
    own = F.array(F.struct(F.lit(None).cast("string").alias("out"), F.lit(None).cast("string").alias("field"),
                           F.lit(-1).alias("pos"), F.lit(None).cast("string").alias("token"), rest.alias("rest")))
    tokens = [F.transform(_as_array(df, c, keep_null=True), _pos_tagger(out, f, none)) for out, (f, c) in spec.items()]
    long = df.select(key, F.inline(F.concat(own, *tokens)))
    j = long.join(vocab.select("field", "token", "id"), ["field", "token"], "left")
    if miss_id is None:
        j = j.join(F.broadcast(miss_ids(vocab, miss_token)), "field", "left")   # one row per field
    else:
        j = j.withColumn("miss_id", F.lit(miss_id))
    j = j.select(key, "out", "pos", "rest", F.coalesce("id", "miss_id").alias("id"))
    g = j.groupBy(key).agg(F.first("rest", ignorenulls=True).alias("_rest"), *[
        F.array_sort(F.collect_list(F.when(F.col("out") == out, F.struct("pos", "id")))).alias("_" + out)
        for out in spec])
    scalars = {out for out, (f, c) in spec.items() if df.schema[c].dataType.typeName() != "array"}
    ids = {out: F.transform(F.col("_" + out), lambda s: s["id"]) for out in spec}
    new = [(F.try_element_at(ids[o], F.lit(1)) if o in scalars else ids[o]).alias(o) for o in spec if o not in df.columns]
    same = {o: (F.try_element_at(ids[o], F.lit(1)) if o in scalars else ids[o]).alias(o) for o in spec if o in df.columns}
    return g.select(*[F.col(key) if c == key else same[c] if c in same else F.col("_rest")[c].alias(c) for c in df.columns], *new)


def md5_bucket(token: Column, n: int) -> Column:
    """Fixed fingerprint bucket: first 32 bits of md5(token) mod n."""
    return F.pmod(F.conv(F.substring(F.md5(token.cast("string")), 1, 8), 16, 10).cast("bigint"), F.lit(n))


def list_vocab(spark, tokens, field: str) -> DataFrame:
    """A list vocabulary (file order) as ``(field, token, id)`` with ids from 0."""
    return spark.createDataFrame([(field, str(t), i) for i, t in enumerate(tokens)],
                                 "field string, token string, id int")


def encode_oov_buckets(df: DataFrame, vocab: DataFrame, col: str, field: str, n_oov: int,
                       out: str | None = None) -> DataFrame:
    """Token -> id of a list vocabulary (ids from 0); unknown -> ``V + md5 mod n_oov``.

    ``V``, the vocabulary size, is a scalar subquery.  A null token takes the
    bucket of the empty text.  For scalar columns; ``encode_oov_lists`` takes lists.
    """
    out = out or col + "_id"
    if isinstance(df.schema[col].dataType, T.ArrayType):
        raise TypeError(f"{col} is a list: use encode_oov_lists")
    v = vocab.where(F.col("field") == field)
    size = v.agg(F.count("*")).scalar()
    j = df.join(v.select(F.col("token").alias("_tok"), F.col("id").alias("_id")),
                F.col(col).cast("string") == F.col("_tok"), "left")
    return j.select(*df.columns,
                    F.coalesce(F.col("_id").cast("bigint"), size + md5_bucket(
                        F.coalesce(F.col(col).cast("string"), F.lit("")), n_oov)).alias(out))


def encode_oov_lists(df: DataFrame, vocab: DataFrame, col: str, field: str, n_oov: int, key: str,
                     out: str | None = None) -> DataFrame:
    """``encode_oov_buckets`` for each element of a list column; order and length are kept.

    ``key`` is the rows' unique key.  An empty list stays empty and a null list
    null; a null element takes the bucket of the empty text.
    """
    out = out or col + "_ids"
    long = df.select(key, F.posexplode(col).alias("_pos", "_token"))
    ids = encode_oov_buckets(long, vocab, "_token", field, n_oov, "_id")
    lists = ids.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_pos", "_id"))).alias("_ids"))
    empty = F.when(F.col(col).isNotNull(), F.array().cast("array<bigint>"))
    return df.join(lists, key, "left").select(
        *[df[c] for c in df.columns], F.coalesce(F.col("_ids")["_id"], empty).alias(out))


def vocab_miss_report(df: DataFrame, vocab: DataFrame, fields: Mapping[str, str], key: str) -> DataFrame:
    """Per field: rows with at least one unknown token, and total unknown tokens.

    A null scalar counts as unknown.  Unknowns are found by a left anti join
    of the exploded tokens against the vocabulary.
    """
    long = df.select(key, F.inline(F.concat(*[
        F.transform(_as_array(df, c, keep_null=True), _tagger(f))
        for f, c in fields.items()])))
    miss = long.join(vocab.select("field", "token"), ["field", "token"], "left_anti")
    per_row = miss.groupBy("field", key).agg(F.count(F.lit(1)).alias("n"))
    rep = per_row.groupBy("field").agg(F.count(F.lit(1)).alias("rows_with_miss"),
                                       F.sum("n").alias("missing_tokens"))
    spark = df.sparkSession
    allf = spark.createDataFrame([(f,) for f in fields], "field string")
    return (F.broadcast(allf).join(rep, "field", "left")
            .select("field", F.coalesce("rows_with_miss", F.lit(0)).alias("rows_with_miss"),
                    F.coalesce("missing_tokens", F.lit(0)).alias("missing_tokens")))


def split_by_coverage(df: DataFrame, vocab: DataFrame, fields: Mapping[str, str], key: str) -> DataFrame:
    """Add ``part``: 0 when every token of every field is known, else 1."""
    long = df.select(key, F.inline(F.concat(*[
        F.transform(_as_array(df, c, keep_null=True), _tagger(f))
        for f, c in fields.items()])))
    bad = long.join(vocab.select("field", "token"), ["field", "token"], "left_anti").select(key).distinct()
    return (df.join(bad.withColumn("_bad", F.lit(1)), key, "left")
              .withColumn("part", F.coalesce(F.col("_bad"), F.lit(0))).drop("_bad"))


def value_counts(df: DataFrame, col: str, token: str = "token") -> DataFrame:
    """Frequency of tokens in an array (or scalar) column: explode + count."""
    t = df.schema[col].dataType.typeName()
    x = df.select(F.explode(col).alias(token)) if t == "array" else df.select(F.col(col).alias(token))
    return x.groupBy(token).agg(F.count(F.lit(1)).alias("n"))
