"""Every operator as a query over the given tables, with SQL to check it where there is any."""

from __future__ import annotations


def _registered():
    from . import curation, metrics, models, routing, views  # noqa: F401

    return views


def queries():
    return dict(_registered().QUERIES)


def oracles():
    return dict(_registered().ORACLES)
