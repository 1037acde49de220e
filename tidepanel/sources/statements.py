"""Nested statements to long lines, and macro series of mixed frequency to one date table."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def statement_lines(nested: DataFrame, column: str = "statements") -> DataFrame:
    """Map<line, Map<timestamp, double>> per symbol to (symbol, metric_name, fiscal_date, metric_value)."""
    return (nested.select("symbol", F.explode(column).alias("metric_name", "m"))
            .select("symbol", "metric_name", F.explode("m").alias("fiscal_date", "metric_value")))


def nest_statements(wide: DataFrame, lines: list[str], time="fiscal_date") -> DataFrame:
    """The nested form of wide statements, one row per symbol (periods per symbol are calendar-bounded)."""
    maps = [F.map_from_entries(F.collect_list(F.struct(F.col(time), F.col(l)))).alias(l) for l in lines]
    return wide.groupBy("symbol").agg(*maps).select(
        "symbol", F.create_map(*[x for l in lines for x in (F.lit(l), F.col(l))]).alias("statements"))


def macro_by_date(long: DataFrame, indicators: list[str], time="date") -> DataFrame:
    """One column per indicator; series of different frequency meet on the date."""
    return long.groupBy(time).pivot("indicator", indicators).agg(F.first("value", ignorenulls=True))


# fixed values: indicator groups
MACRO_GROUPS = ["interest_rates", "inflation", "employment", "gdp_growth", "consumer_sentiment", "market_indicators",
                "monetary", "international", "commodities", "indices"]
