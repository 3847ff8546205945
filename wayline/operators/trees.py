"""Tree-ensemble scoring and per-feature attribution.

A model is a table of nodes, laid out as flat arrays: one entry for each node
of each tree, leaves pointing at themselves.  The arrays travel with the task and
whole Arrow batches walk a tree one level at a time, so the plan does not grow with
the model, and there is no join and no shuffle.  A score adds up the leaf values; an
attribution adds the value change of each edge to the feature tested there.

Values: missing is below ``MISSING_BELOW`` and goes to the node's default side; a
null value goes right; a category is the value cut to an integer.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values
MISSING_BELOW = -1e-35     # a feature value below this is missing


@dataclass
class Model:
    """Nodes of all trees end to end; a leaf is its own left and right child."""

    trees: list[int]              # tree index of each root
    roots: np.ndarray
    feature: np.ndarray           # -1 at leaves
    threshold: np.ndarray
    categories: list[str]         # "|1|3|" where the test is membership, else ""
    default_left: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray             # leaf value (score)
    level: np.ndarray             # node value before shrinkage (attribution)
    depth: int


def read_model(nodes: DataFrame) -> Model:
    """The node table as flat arrays (one pass over the model, which its trainer sized)."""
    t = nodes.toArrow().to_pandas().sort_values(["tree_index", "node_id"], ignore_index=True)
    place = {k: i for i, k in enumerate(zip(t.tree_index.astype(int), t.node_id.astype(int)))}
    n = len(t)
    inner = t.split_feature.notna().to_numpy()
    unknown = set(t.decision_type[inner]) - {"<=", "=="}
    if unknown:
        raise ValueError(f"unknown decision_type {sorted(map(str, unknown))}")
    member = inner & (t.decision_type == "==").to_numpy()
    own = np.arange(n)

    def child(c: str) -> np.ndarray:
        return np.array([place[int(k), int(x)] if i else o for k, x, i, o in zip(t.tree_index, t[c].fillna(-1), inner, own)],
                        dtype=np.int64)

    left, right = child("left_child"), child("right_child")
    is_child = np.zeros(n, dtype=bool)
    is_child[left[inner]] = is_child[right[inner]] = True
    roots = np.flatnonzero(~is_child)
    trees = t.tree_index.to_numpy()[roots].astype(int).tolist()
    if trees != sorted(set(t.tree_index.astype(int))):
        raise ValueError("a tree must have exactly one root")
    depth, front = 0, roots[inner[roots]]
    while len(front):
        depth += 1
        if depth > n:
            raise ValueError("a tree must not have cycles")
        front = np.concatenate([left[front], right[front]])
        front = front[inner[front]]
    number = lambda c: t[c].astype(float).fillna(0.0).to_numpy()
    return Model(
        trees, roots, np.where(inner, t.split_feature.fillna(-1), -1).astype(np.int64),
        np.array([float(x) if i and not m else 0.0 for x, i, m in zip(t.threshold, inner, member)]),
        ["|" + "|".join(str(int(c)) for c in str(x).split("||")) + "|" if m else "" for x, m in zip(t.threshold, member)],
        t.default_left.eq(True).to_numpy(), left, right, number("leaf_value"),
        np.where(inner, number("internal_value"), number("leaf_value") / np.where(inner, 1.0, number("shrinkage"))), depth)


def _walk(model: Model):
    """(rows of values, root) -> steps of (live rows, feature, node, next node), one level of the tree at a time for all rows."""
    keys = np.array(sorted((i << 33) + int(c) for i, x in enumerate(model.categories) for c in x.split("|") if c), dtype=np.int64)
    member = np.array([bool(c) for c in model.categories], dtype=bool)

    def steps(x: np.ndarray, root: int):
        rows, at = np.arange(len(x)), np.full(len(x), root)
        for _ in range(model.depth):
            f = model.feature[at]
            live = f >= 0   # leaves point at themselves
            if not live.any():
                break
            f = np.maximum(f, 0)
            v = x[rows, f]
            go_left = v <= model.threshold[at]   # false for null
            m = np.flatnonzero(member[at] & live)
            if len(m):
                cut = np.trunc(v[m])
                fits = np.abs(cut) < 2**31  # false for null
                key = (at[m].astype(np.int64) << 33) + np.where(fits, cut, 0).astype(np.int64)
                go_left[m] = fits & np.isin(key, keys)
            go_left = np.where(v < MISSING_BELOW, model.default_left[at], go_left)
            to = np.where(go_left, model.left[at], model.right[at])
            yield live, f, at, to
            at = to
    return steps


def _with_values(df: DataFrame, features: Sequence[str], names: Sequence[str], values) -> DataFrame:
    """``df`` with columns ``names``, computed by ``values`` from whole batches of the features (nulls as nan)."""
    n, width = len(df.columns), len(features)
    schema = T.StructType(df.schema.fields + [T.StructField(c, T.DoubleType()) for c in names])

    def run(batches):
        for batch in batches:
            x = np.column_stack([batch.column(n + i).to_numpy(zero_copy_only=False).astype(float) for i in range(width)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(n)] + [pa.array(c) for c in values(x)], names=schema.names)

    return df.select("*", *[F.col(c).cast("double").alias(f"_value{i}") for i, c in enumerate(features)]).mapInArrow(run, schema)


def tree_score(df: DataFrame, model: Model, features: Sequence[str], num_class: int = 1,
               prefix: str = "score_") -> DataFrame:
    """Class score = sum of the leaf values of trees with ``tree_index mod num_class``."""
    steps = _walk(model)

    def scores(x: np.ndarray):
        out = [np.zeros(len(x)) for _ in range(num_class)]
        for tree, root in zip(model.trees, model.roots):
            at = np.full(len(x), root)
            for _, _, _, at in steps(x, root):
                pass
            out[tree % num_class] += model.value[at]
        return out

    return _with_values(df, features, [f"{prefix}{k}" for k in range(num_class)], scores)


def tree_attribution(df: DataFrame, model: Model, features: Sequence[str],
                     prefix: str = "contrib_") -> DataFrame:
    """Per row and feature: the sum over trees of the value changes along the row's path."""
    steps = _walk(model)

    def contributions(x: np.ndarray):
        out, rows = np.zeros((len(x), len(features))), np.arange(len(x))
        for root in model.roots:
            for live, f, at, to in steps(x, root):
                out[rows, f] += np.where(live, model.level[to] - model.level[at], 0.0)
        return [*out.T, out.sum(axis=1)]

    return _with_values(df, features, [prefix + f for f in features] + [prefix + "total"], contributions)
