"""Templated SQL, batches of queries and the UDF / SQL-function surface.

Templates use ``{name}`` placeholders.  A value is bound as a named
parameter (``:name``) so it is never spliced into the text; a value wrapped
in ``Ident`` is a table or column name and becomes ``IDENTIFIER(:name)``.
Catalyst then sees typed literals: constant folding, partition pruning and
predicate pushdown all apply.
"""

from __future__ import annotations

import re
import string
from dataclasses import dataclass
import functools
from typing import Any, Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_FORMATTER = string.Formatter()


@dataclass(frozen=True)
class Ident:
    """A table, view or column name given to a template."""
    name: str


def _fields(template: str) -> list[str]:
    return [f for _, f, _, _ in _FORMATTER.parse(template) if f]


def render(template: str, params: Mapping[str, Any]) -> tuple[str, dict]:
    """Turn a ``{name}`` template into Spark SQL text with parameter markers."""
    missing = [f for f in _fields(template) if f not in params]
    if missing:
        raise KeyError(f"template parameters without a value: {missing}")
    args: dict = {}
    subs: dict = {}
    for f in _fields(template):
        v = params[f]
        if isinstance(v, Ident):
            subs[f] = f"IDENTIFIER(:{f})"
            args[f] = v.name
        else:
            subs[f] = f":{f}"
            args[f] = v
    text = template.format(**subs)
    return text, args


def sql_template(spark: SparkSession, template: str, params: Mapping[str, Any] | None = None,
                 debug: bool = False) -> DataFrame:
    """Fill ``{name}`` placeholders from ``params`` and return the lazy DataFrame."""
    text, args = render(template, params or {})
    if debug:
        print(text, args)
    return spark.sql(text, args=args) if args else spark.sql(text)


def zip_batch(batch: Mapping[str, list], params: Mapping[str, Any] | None = None) -> list[dict]:
    """One parameter dict per position of the batch's lists, as far as the shortest goes;
    fixed ``params`` win over a batch name they share."""
    if not batch:
        raise ValueError("sql_batch needs a non-empty batch")
    bad = [n for n in batch if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", n)]
    if bad:
        raise ValueError(f"bad parameter names {bad!r}")
    tuples = []
    for at in range(min(len(values) for values in batch.values())):
        one = {name: values[at] for name, values in batch.items()}
        one.update(params or {})
        tuples.append(one)
    return tuples


def sql_batch(spark: SparkSession, template: str, batch: Mapping[str, list],
              params: Mapping[str, Any] | None = None, debug: bool = False) -> DataFrame:
    """One query per batch tuple, results concatenated by position (duplicates kept)."""
    out = None
    for one in zip_batch(batch, params):
        part = sql_template(spark, template, one, debug)
        out = part if out is None else out.union(part)
    if out is None:
        raise ValueError("the batch produced no parameter tuple")
    return out


def batch_param_view(spark: SparkSession, batch: Mapping[str, list],
                     params: Mapping[str, Any] | None = None, view: str = "batch_params") -> DataFrame:
    """The zipped batch as a small table (one row per tuple plus ``batch_ix``).

    For wide batches the query is written once against this view and joins
    it, so the big table is scanned once instead of once per tuple.  Its size
    is the user's batch, a literal list, so broadcasting it is safe.
    """
    rows = zip_batch(batch, params)
    for i, r in enumerate(rows):
        r["batch_ix"] = i
    df = spark.createDataFrame(rows)
    df.createOrReplaceTempView(view)
    return df


# ---- UDF surface -----------------------------------------------------------

def register_udf(spark: SparkSession, name: str, f: Callable, return_type=T.DoubleType()):
    """Drop any temporary function of that name, then register ``f`` for SQL use.

    ``f`` may be a plain Python function or a ``pandas_udf``; pandas UDFs are
    the preferred form (Arrow batches, not rows).
    """
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name):
        raise ValueError(f"bad function name {name!r}")
    spark.sql(f"DROP TEMPORARY FUNCTION IF EXISTS {name}")
    if getattr(f, "evalType", None) is not None:
        return spark.udf.register(name, f)
    return spark.udf.register(name, f, return_type)


def udf(spark: SparkSession, return_type=T.DoubleType(), name: str | None = None):
    """Decorator: register for SQL under the function's name; the function stays callable."""
    def deco(f):
        register_udf(spark, name or f.__name__, f, return_type)
        return f
    return deco


def renamed(name: str, f: Callable) -> Callable:
    """A function that does what ``f`` does under another name; ``f`` keeps its own."""
    @functools.wraps(f)
    def alias(*args, **kwargs):
        return f(*args, **kwargs)
    alias.__name__ = name
    return alias


# ---- SQL functions with SQL bodies (stay in Catalyst; no Python) -----------

SQL_FUNCTIONS = {
    "json_array": (
        "CREATE OR REPLACE TEMPORARY FUNCTION json_array(s STRING) "
        "RETURNS ARRAY<STRING> RETURN from_json(s, 'array<string>')"),
    "json_array_text": (
        "CREATE OR REPLACE TEMPORARY FUNCTION json_array_text(a ARRAY<STRING>) "
        "RETURNS STRING RETURN to_json(a)"),
    # Web-Mercator metres -> pointy-top axial hex by cube rounding -> "size:q:r"
    "proj_hex": """
CREATE OR REPLACE TEMPORARY FUNCTION proj_hex(lng DOUBLE, lat DOUBLE, size DOUBLE)
RETURNS STRING RETURN (
  SELECT concat_ws(':', CAST(CAST(size AS BIGINT) AS STRING),
           CAST(CAST(CASE WHEN dq > dr AND dq > ds THEN -rr - rs ELSE rq END AS BIGINT) AS STRING),
           CAST(CAST(CASE WHEN dq > dr AND dq > ds THEN rr WHEN dr > ds THEN -rq - rs ELSE rr END
                AS BIGINT) AS STRING))
  FROM (SELECT rq, rr, rs, abs(rq - qf) AS dq, abs(rr - rf) AS dr, abs(rs - (-qf - rf)) AS ds
        FROM (SELECT qf, rf, round(qf) AS rq, round(rf) AS rr, round(-qf - rf) AS rs
              FROM (SELECT (sqrt(3) / 3 * x - y / 3) / size AS qf, (2 * y / 3) / size AS rf
                    FROM (SELECT 6378137D * radians(lng) AS x,
                                 6378137D * ln(tan(pi() / 4 + radians(lat) / 2)) AS y))))
)""",
}


def register_sql_functions(spark: SparkSession, names=None) -> None:
    """Register the library's SQL-bodied temporary functions."""
    for n, ddl in SQL_FUNCTIONS.items():
        if names is None or n in names:
            spark.sql(ddl)
