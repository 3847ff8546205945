"""Literal model fixture F5: three trees on (quantity, discount, tax, line number)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NODE_SCHEMA = ("tree_index int, node_id int, split_feature int, decision_type string, threshold string, "
               "default_left boolean, left_child int, right_child int, internal_value double, "
               "leaf_index int, leaf_value double, shrinkage double")

# F5 trees.  Internal nodes: (tree, node, feature, type, threshold,
# default_left, left, right, internal_value); leaves: (tree, node, leaf_index, leaf_value).
INTERNAL = [
    (0, 0, 0, "<=", "25.5", True, 1, 2, 0.0),
    (0, 1, 1, "<=", "0.045", False, 3, 4, -0.2),
    (0, 2, 3, "==", "1||3||5", False, 5, 6, 0.3),
    (1, 0, 2, "<=", "0.04", True, 1, 2, 0.05),
    (1, 2, 0, "<=", "40", True, 3, 4, 0.1),
    (2, 0, 3, "==", "2||4", True, 1, 2, -0.1),
    (2, 2, 1, "<=", "0.08", False, 3, 4, 0.05),
]
LEAVES = [
    (0, 3, 0, -0.05), (0, 4, 1, -0.01), (0, 5, 2, 0.04), (0, 6, 3, 0.02),
    (1, 1, 0, 0.015), (1, 3, 1, -0.005), (1, 4, 2, 0.025),
    (2, 1, 0, -0.03), (2, 3, 1, 0.01), (2, 4, 2, 0.06),
]
SHRINKAGE = 0.1


def tree_nodes(spark: SparkSession) -> DataFrame:
    rows = [(t, n, f, d, th, dl, lc, rc, iv, None, None, SHRINKAGE)
            for t, n, f, d, th, dl, lc, rc, iv in INTERNAL]
    rows += [(t, n, None, None, None, None, None, None, None, li, lv, SHRINKAGE)
             for t, n, li, lv in LEAVES]
    return spark.createDataFrame(rows, NODE_SCHEMA)
