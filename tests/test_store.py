import pytest
from pyspark.sql import functions as F

from tests.conftest import walk
from tidepanel.sources import bars as b, store


def test_filters_reach_the_scan(spark, tmp_path):
    sdf, _ = walk(spark, 400)
    path = str(tmp_path / "md")
    store.store_market_data(sdf, path)
    df = store.read_market_data(spark, path, ["A"], "2020-06-01", "2020-08-01").select("symbol", "date", "close")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(symbol" in plan or "EqualTo(symbol,A)" in plan
    assert "PartitionFilters: [isnotnull(year" in plan and "volume" not in plan.split("ReadSchema")[1].split("\n")[0]
    assert df.count() == 62


def test_per_symbol_overwrite_keeps_other_symbols(spark, tmp_path):
    sdf, _ = walk(spark, 10)
    path = str(tmp_path / "ps")
    store.store_per_symbol(sdf, path)
    store.store_per_symbol(sdf.where("symbol = 'A'").limit(3), path)
    assert {r["symbol"]: r["count"] for r in spark.read.parquet(path).groupBy("symbol").count().collect()} == {"A": 3, "B": 10}


def test_prediction_columns_are_checked(spark):
    with pytest.raises(ValueError, match="target_date"):
        store.prediction_rows(spark.range(1).select(F.lit("A").alias("symbol"), F.lit(1).alias("prediction_date"), F.lit(1.0).alias("prediction_value")), 1)


def test_jdbc_options():
    o = store.jdbc_options("jdbc:postgresql://db/x", "bars", user="u", driver="org.postgresql.Driver", partition=("id", 0, 100, 8))
    assert o["numPartitions"] == "8" and o["dbtable"] == "bars" and "password" not in o


def test_csv_reader(spark, tmp_path):
    sdf, _ = walk(spark, 5)
    path = str(tmp_path / "csv")
    sdf.select("symbol", "date", "open", "high", "low", "close", "volume", F.col("close").alias("adj_close")).write.option("header", True).csv(path)
    assert b.read_bars(spark, path, ["B"], fmt="csv").count() == 5
