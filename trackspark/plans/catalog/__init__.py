"""Registered queries: each one names its Spark plan and, where SQL can say it, the same result in SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame

from trackspark.plans.views import Views, with_views

REGISTRY: dict[str, tuple[Callable[[Views], DataFrame], str | None]] = {}
AREAS = ("scans", "contracts", "geometry", "joins", "aggregates", "windows", "identity", "evaluation", "review", "labels", "jobs")


def query(name: str, views: str = "", sql: str | None = None):
    """Register ``fn(views)`` under ``name`` with its comparison SQL."""

    def register(fn):
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = (fn, None if sql is None else with_views(views, sql))
        return fn

    return register


def load() -> dict[str, tuple[Callable[[Views], DataFrame], str | None]]:
    for area in AREAS:
        importlib.import_module(f"{__name__}.{area}")
    return REGISTRY


def iou_sql(left: str, right: str, suffix_left: str = "", suffix_right: str = "") -> str:
    """IoU of two aliased boxes in SQL."""
    l = lambda c: f"{left}.{c}{suffix_left}"
    r = lambda c: f"{right}.{c}{suffix_right}"
    shared = (
        f"greatest(0.0E0, least({l('x2')},{r('x2')})-greatest({l('x1')},{r('x1')}))"
        f"*greatest(0.0E0, least({l('y2')},{r('y2')})-greatest({l('y1')},{r('y1')}))"
    )
    area = lambda c: f"greatest(0.0E0,{c('x2')}-{c('x1')})*greatest(0.0E0,{c('y2')}-{c('y1')})"
    return f"(({shared})/(({area(l)})+({area(r)})-({shared})))"
