"""wayline: mobility analytics operators expressed as Spark DataFrame jobs.

Every public operator takes DataFrames (or Columns) and returns DataFrames
(or Columns).  Nothing is collected to the driver except where an operator's
documented purpose is a small report.
"""

from wayline.session import get_spark, checkpoint_dir  # noqa: F401

__all__ = ["get_spark", "checkpoint_dir"]
