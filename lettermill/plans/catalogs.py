"""All query catalogues of the core."""

from __future__ import annotations

from lettermill.plans import core_plans, name_plans, run_plans, step_plans, text_plans, text_sql

CATALOGS = [(text_plans.QUERIES, text_sql.SQL), (core_plans.QUERIES, core_plans.SQL), (step_plans.QUERIES, step_plans.SQL), (run_plans.QUERIES, run_plans.SQL), (name_plans.QUERIES, name_plans.SQL)]


def queries() -> dict:
    return {k: v for qs, _ in CATALOGS for k, v in qs.items()}


def sql() -> dict:
    return {k: v for _, sq in CATALOGS for k, v in sq.items()}
