"""The registered query set: name -> (callable(spark, sf_dir), oracle SQL or None)."""

from __future__ import annotations

import importlib

_MODULES = [
    "wayline.plans.q_trajectory",
    "wayline.plans.q_sql",
    "wayline.plans.q_vocab",
    "wayline.plans.q_stats",
    "wayline.plans.q_features",
    "wayline.plans.q_scoring",
    "wayline.plans.q_linalg",
    "wayline.plans.q_geo",
    "wayline.plans.q_shape",
    "wayline.plans.q_sources",
]


def registry() -> dict:
    out: dict = {}
    for m in _MODULES:
        mod = importlib.import_module(m)
        for k, v in mod.QUERIES.items():
            if k in out:
                raise ValueError(f"duplicate query name {k}")
            out[k] = v
    return out
