"""Registry of runnable queries: name -> (spark, sf_dir) -> DataFrame, with optional SQL."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidepanel.core.frames import rnd
from tidepanel.core.session import ship, spread
from tidepanel.plans.oracle import oracle

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, digits: int = 6, **special: int):
    """Register a query. Doubles are rounded on the way out; SQL marks them with R(...)."""
    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            spread(spark, [f"{sf_dir}/{t}.parquet" for t in ("lineitem", "orders", "events")])
            return rnd(fn(spark, sf_dir), digits, **special)
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = oracle(sql, digits)
        return fn
    return wrap


def load() -> None:
    """Import every catalogue module once."""
    import importlib
    for mod in CATALOGUE:
        importlib.import_module(f"tidepanel.plans.{mod}")


CATALOGUE = ["cat_sources", "cat_cleaning", "cat_joins", "cat_aggregates", "cat_windows", "cat_cross",
             "cat_sets", "cat_quality", "cat_regimes", "cat_models", "cat_risk", "cat_streaming"]
