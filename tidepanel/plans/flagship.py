"""Flagship query: the latest momentum and volatility ranking of every symbol."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidepanel.core.frames import rnd
from tidepanel.core.ordering import grouped_rank
from tidepanel.operators import technical as t
from tidepanel.sources import domain


def ranking(bars: DataFrame) -> DataFrame:
    df = t.returns(bars.select("symbol", "date", "close"))
    df = t.hist_vol(t.momentum(df, (20,)), (20,))
    last = df.groupBy("symbol").agg(F.max_by(F.struct("date", "momentum_20", "volatility_20"), "date").alias("r"))
    last = last.select("symbol", "r.*").withColumn("all", F.lit(1))
    last = grouped_rank(last, ["all"], "momentum_20", "momentum_rank", "min")
    last = grouped_rank(last, ["all"], "volatility_20", "volatility_rank", "min")
    return last.drop("all")


def latest_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rnd(ranking(domain.bars(spark, sf_dir)))
