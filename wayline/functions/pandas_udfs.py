"""Vectorised (Arrow batch) UDFs used as examples of user functions.

No ``from __future__ import annotations`` here: pandas UDF type hints must be
real types for Spark to read the signature.
"""

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.DoubleType())
def clip_udf(x: pd.Series, v: pd.Series) -> pd.Series:
    """Limit ``x`` to ``[-v, v]`` (a user-style vectorised function)."""
    return x.clip(-v, v)
