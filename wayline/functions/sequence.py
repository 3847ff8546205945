"""Sequence shaping as array expressions (one row at a time, no shuffle)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def keep_last(c, T: int) -> Column:
    """The last ``T`` elements (pre-truncation)."""
    c = _c(c)
    return F.when(F.size(c) > T, F.slice(c, F.size(c) - T + 1, T)).otherwise(c)


def pad_sequence(c, T: int = 59, value=0) -> Column:
    """Append ``value`` up to length ``T``; longer sequences keep the last ``T``."""
    k = keep_last(c, T)
    return F.concat(k, F.array_repeat(F.lit(value).cast(_elem_type_hint(value)),
                                      F.greatest(F.lit(T) - F.size(k), F.lit(0))))


def _elem_type_hint(v) -> str:
    return "double" if isinstance(v, float) else "int"


def pad_int_sequence(c, T: int = 59) -> Column:
    """Pad after casting elements to int (truncation toward zero, as the padding helper's int type)."""
    return pad_sequence(F.transform(_c(c), lambda x: x.cast("int")), T, 0)


def one_hot_positions(c, T: int) -> Column:
    """T x T 0/1 matrix of a position sequence; padding rows are all zero; a label of T or more raises."""
    k = F.coalesce(keep_last(c, T), F.array())
    none = F.array_repeat(F.lit(0), T)

    def row(y: Column) -> Column:   # runs of zeros around the one, not an element at a time
        at = y.cast("int")
        return F.when((at == y) & (at >= 0) & (at < T), F.concat(
            F.array_repeat(F.lit(0), at), F.array(F.lit(1)), F.array_repeat(F.lit(0), F.lit(T - 1) - at))).otherwise(none)

    hot = F.concat(F.transform(k, row), F.array_repeat(none, F.lit(T) - F.size(k)))
    return F.when(F.array_max(k) >= T, F.raise_error(F.format_string(
        "label %s does not fit in %d positions", F.array_max(k).cast("string"), F.lit(T))).cast("array<array<int>>")).otherwise(hot)


def log1p_sequence(c, T: int) -> Column:
    """Pad as int (truncating), then ``ln(1 + p)`` element-wise."""
    return F.transform(pad_int_sequence(c, T), lambda x: F.log1p(x.cast("double")))


def pad_matrix(c, T: int) -> Column:
    """Grow an L x (L+1) matrix to T x (T+1) with zeros; L > T raises."""
    m = _c(c)
    L = F.size(m)
    grown = F.concat(
        F.transform(m, lambda r: F.concat(r, F.array_repeat(F.lit(0.0), F.lit(T + 1) - F.size(r)))),
        F.array_repeat(F.array_repeat(F.lit(0.0), T + 1), F.greatest(F.lit(T) - L, F.lit(0))))
    return F.when(L > T, F.raise_error(F.format_string(
        "matrix of %d rows does not fit in %d", L, F.lit(T))).cast("array<array<double>>")).otherwise(grown)


def drop_empty_tokens(c) -> Column:
    """Remove empty strings from a padded token list."""
    return F.filter(_c(c), lambda x: x != "")
