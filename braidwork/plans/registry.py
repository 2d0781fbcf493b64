"""Collects the queries of all plan modules."""

from __future__ import annotations

from . import composed_plans, recommend_plans, relational_plans, similarity_plans, text_plans, tree_plans

MODULES = (similarity_plans, relational_plans, recommend_plans, tree_plans, text_plans, composed_plans)


def queries():
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql():
    return {k: s for m in MODULES for k, s in m.SQL.items()}
