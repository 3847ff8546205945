"""Scalar column functions: missing values, clipping, formatting, labels."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values
ZERO_AS_MISSING = 1e-20   # |v| within this (open below, closed above) counts as missing


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def default_for_zero(c, d, k: float = ZERO_AS_MISSING) -> Column:
    """``-k < v <= k`` -> ``d``, else ``v``."""
    c = _c(c)
    return F.when((c > F.lit(-k)) & (c <= F.lit(k)), F.lit(d)).otherwise(c)


def clip(c, v: float) -> Column:
    """Limit to ``[-v, v]``."""
    return F.least(F.greatest(_c(c), F.lit(-v)), F.lit(v))


def sigmoid(c) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(c)))


def format_float(c) -> Column:
    """Thousands separators and five decimals."""
    return F.format_number(_c(c), 5)


def format_text(template: str, cols: Sequence) -> Column:
    """Positional ``{0}``, ``{1}`` ... filled from columns (as text)."""
    import re
    order = [int(m) for m in re.findall(r"\{(\d+)\}", template)]
    fmt = re.sub(r"\{(\d+)\}", "%s", template.replace("%", "%%"))
    return F.format_string(fmt, *[_c(cols[i]).cast("string") for i in order])


def join_fields(cols: Sequence, sep: str = ",") -> Column:
    """Info line (``,``), tooltip (``</br>``) or extra fields (``|``) joined."""
    return F.concat_ws(sep, *[_c(c).cast("string") for c in cols])


def label_vector(cols: Sequence[str] = ("assignd", "canceld", "timeoutd")) -> Column:
    """One-hot outcome columns as one array."""
    return F.array(*[_c(c).cast("double") for c in cols])


def null_indicator(c) -> Column:
    return F.when(_c(c).isNull(), F.lit(1)).otherwise(F.lit(0)).cast("bigint")


def epoch_micros(c) -> Column:
    """Microseconds since 1970-01-01 of a wall-clock (``timestamp_ntz``) value,
    independent of the session time zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"),
                            _c(c).cast("timestamp_ntz"))


def from_epoch_micros(c) -> Column:
    """Inverse of ``epoch_micros``: a ``timestamp_ntz``."""
    return F.timestamp_add("MICROSECOND", _c(c), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
