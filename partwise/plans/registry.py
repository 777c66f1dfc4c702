"""Registered queries of the compositional operators, and their SQL."""

from __future__ import annotations

from . import effects, models, networks, prepare

MODULES = (prepare, effects, networks, models)


def flagship(spark, sf_dir):
    return effects.j6_contrast(spark, sf_dir)


def queries():
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql():
    return {k: t for m in MODULES for k, t in m.SQL.items()}
