"""All registered queries: (spark, sf_dir) -> DataFrame, and the SQL text of each."""

from __future__ import annotations

import importlib

PLANS = ["archive", "decoding", "facts", "lanes", "explore", "live", "evaluation", "datasets", "measurement"]


def _plans():
    for name in PLANS:
        yield importlib.import_module(f"{__package__}.{name}_queries")


def queries():
    out = {}
    for plan in _plans():
        out.update(plan.QUERIES)
    return out


def oracle_sql():
    out = {}
    for plan in _plans():
        out.update(plan.ORACLE)
    return out
