"""Registered queries: each is a Spark plan over one scale-factor directory
plus, where SQL can say the same thing, its DuckDB oracle text.

Queries run over whole tables. ``as_of`` follows the fixture convention (the
last production day in the data) so windows are non-empty on old data.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..session import ship_package
from ..sources.fixtures import Fixtures
from .oracle_views import with_views


@dataclass
class Registered:
    name: str
    build: Callable[[Fixtures], DataFrame]
    oracle: str | None


REGISTRY: dict[str, Registered] = {}


def query(name: str, oracle_body: str | None = None, views: tuple[str, ...] = ()):
    """Register ``fn(fixtures) -> DataFrame`` under ``name``."""
    def deco(fn: Callable[[Fixtures], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        sql = with_views(oracle_body, *views) if oracle_body is not None else None
        REGISTRY[name] = Registered(name, fn, sql)
        return fn
    return deco


def runner(name: str) -> Callable[[SparkSession, str], DataFrame]:
    reg = REGISTRY[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return reg.build(Fixtures(spark, sf_dir))
    run.__name__ = name
    return run


def load_all() -> dict[str, Registered]:
    """Import every module that registers queries."""
    from . import queries_core, queries_models, queries_rows, queries_text, queries_writes  # noqa: F401
    return REGISTRY
