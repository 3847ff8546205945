"""Row shaping: flattening nested rows, value extraction, guards, row views, pages."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flatten_pair(df: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """``((a, b), c)`` -> ``(a, b, c)``; a non-struct key passes unchanged."""
    if not isinstance(df.schema[key].dataType, T.StructType):
        return df
    others = [c for c in df.columns if c not in (key, value)]
    return df.select(f"{key}.*", value, *others)


def flatten_struct(df: DataFrame, keep: Sequence[str] = (), sep: str = "_") -> DataFrame:
    """Recursive flatten of nested structs, depth first; structs named in ``keep``
    stay whole.  A leaf keeps its own name unless two leaves share it, then
    the path joined by ``sep`` is used."""
    leaves: list[tuple[list[str], T.DataType]] = []

    def rec(path, dt):
        if isinstance(dt, T.StructType) and path[-1] not in keep:
            for f in dt.fields:
                rec(path + [f.name], f.dataType)
        else:
            leaves.append((path, dt))
    for f in df.schema.fields:
        rec([f.name], f.dataType)
    names = [p[-1] for p, _ in leaves]
    cols = []
    for p, _ in leaves:
        name = p[-1] if names.count(p[-1]) == 1 else sep.join(p)
        c = F.col(p[0])
        for part in p[1:]:
            c = c[part]
        cols.append(c.alias(name))
    return df.select(*cols)


def take_value(df: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """The value of a ``(key, value)`` pair frame; any other shape raises."""
    if sorted(df.columns) != sorted([key, value]):
        raise ValueError(f"not a (key, value) pair frame: {df.columns}")
    v = df.schema[value].dataType
    return df.select(f"{value}.*") if isinstance(v, T.StructType) else df.select(value)


def guard(df: DataFrame, predicate: Column, message: str) -> DataFrame:
    """Fail the job when a row breaks ``predicate`` (checked inside the projection)."""
    chk = F.assert_true(predicate, F.lit(message))
    return df.where(chk.isNull())


def view_row(df: DataFrame, key: str) -> DataFrame:
    """One line per field of each row: ``(key, name, value, type)``."""
    fields = [f for f in df.schema.fields if f.name != key]
    entries = F.array(*[F.struct(F.lit(f.name).alias("name"), F.col(f.name).cast("string").alias("value"),
                                 F.lit(f.dataType.simpleString()).alias("type")) for f in fields])
    return df.select(key, F.inline(entries))


def page(df: DataFrame, order: Sequence, i: int, step: int = 10, columns: Sequence[str] | None = None,
         transposed: bool = False) -> DataFrame:
    """Rows ``i .. i + step - 1`` by ``order``, optional column subset, optionally transposed
    (one row per field with a column per row: ``row_0 .. row_{step-1}``)."""
    cols = list(columns) if columns else df.columns
    p = df.orderBy(*order).offset(i).limit(step).select(*cols)
    if not transposed:
        return p
    # after the limit the page is one small partition, so ids are 0 .. step - 1 in order
    r = p.withColumn("_row", F.monotonically_increasing_id())
    long = r.select("_row", F.inline(F.array(*[F.struct(F.lit(c).alias("field"),
                                                        F.col(c).cast("string").alias("value")) for c in cols])))
    w = long.groupBy("field").pivot("_row").agg(F.first("value"))
    return w
