"""Readers for price bars."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidepanel.core.frames import moment
from tidepanel.sources import schemas


def read_bars(spark: SparkSession, path: str, symbols=None, start=None, end=None, fmt: str = "parquet") -> DataFrame:
    """Load bars for a symbol list and date range; both filters reach the scan."""
    reader = spark.read.schema(schemas.BARS)
    if fmt == "csv":
        reader = reader.option("header", True)
    return select_bars(reader.format(fmt).load(path), symbols, start, end)


def select_bars(df: DataFrame, symbols=None, start=None, end=None, key="symbol", time="date") -> DataFrame:
    if symbols is not None:
        df = df.where(F.col(key).isin(list(symbols)))
    if start is not None:
        df = df.where(F.col(time) >= F.lit(start).cast("timestamp"))
    if end is not None:
        df = df.where(F.col(time) <= F.lit(end).cast("timestamp"))
    return df


def bars_from_trades(trades: DataFrame, unit: str, tie: Column | None = None, key="symbol", time="ts",
                     price="price", quantity="quantity", last: dict[str, Column] | None = None) -> DataFrame:
    """OHLCV bars per key and calendar unit; ``last`` adds closing values of further columns.

    First and last follow (time, ``tie``) as one number, so a raw trade is reduced to its bar before the only shuffle, whatever the
    resolution of its timestamp; no raw trade is sorted.
    """
    more = last or {}
    t = trades.select(F.col(key).alias("symbol"), F.date_trunc(unit, time).alias("date"), moment(time, tie).alias("_at"), F.col(price).alias("_p"), F.col(quantity).alias("_q"),
                      *[e.alias(n) for n, e in more.items()])
    return t.groupBy("symbol", "date").agg(F.min_by("_p", "_at").alias("open"), F.max("_p").alias("high"), F.min("_p").alias("low"), F.max_by("_p", "_at").alias("close"),
                                           F.sum("_q").alias("volume"), *[F.max_by(n, "_at").alias(n) for n in more])


def index_and_sector_sets(df: DataFrame, mapping: DataFrame) -> DataFrame:
    """Keep the symbols named in a (name, symbol) mapping and tag them."""
    return df.join(mapping, "symbol")


def nearest_expiry(chain: DataFrame) -> DataFrame:
    """Rows of the earliest expiry per symbol: one partial aggregate and an equi-join,
    so a symbol with a very long chain is never gathered in one task."""
    first = chain.groupBy("symbol").agg(F.min("expiry").alias("expiry"))
    return chain.join(first, ["symbol", "expiry"])
