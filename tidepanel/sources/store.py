"""Sinks and readers of the analytics tables (Parquet layout, JDBC optional)."""
from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from tidepanel.core.frames import div, ordered
from tidepanel.sources import schemas
from tidepanel.sources.bars import select_bars


def _write(df: DataFrame, path: str, mode: str, by: list[str]) -> None:
    # rebalance keeps files well sized and lets AQE split a partition value that holds most rows
    if by:
        df = df.hint("rebalance", *by)
    w = df.write.mode(mode)
    (w.partitionBy(*by) if by else w).parquet(path)


def market_data(bars: DataFrame) -> DataFrame:
    """Persisted bar layout: adjusted close renamed, returns attached, split by year."""
    prev = F.lag("close").over(ordered())
    return bars.withColumns({"returns": div("close", prev) - 1, "log_returns": F.log(div("close", prev)),
                             "year": F.year("date")}).withColumnRenamed("adj_close", "adjusted_close")


def store_market_data(bars: DataFrame, path: str) -> None:
    _write(market_data(bars), path, "append", ["year"])


def store_per_symbol(df: DataFrame, path: str) -> None:
    """Replace only the symbols present in ``df``."""
    df = df.hint("rebalance", "symbol")
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("symbol").parquet(path))


def to_eav(df: DataFrame, ids: list[str], columns: list[str], name="feature_name", value="feature_value",
           rules: dict[str, str] | None = None, default="other", category="feature_category") -> DataFrame:
    """Wide to long, nulls dropped; the category is the first rule whose text occurs in the name."""
    long = df.select(*ids, *[F.col(c).cast("double") for c in columns]).unpivot(ids, columns, name, value)
    long = long.where(F.col(value).isNotNull())
    if rules:
        e = None
        for text, label in rules.items():
            hit = F.col(name).contains(text)
            e = F.when(hit, label) if e is None else e.when(hit, label)
        long = long.withColumn(category, e.otherwise(default))
    return long


def store_eav(long: DataFrame, path: str, category="feature_category") -> None:
    _write(long, path, "append", [category] if category in long.columns else [])


INDICATOR_COLUMNS = ("sma_5 sma_10 sma_20 sma_50 ema_12 ema_26 rsi_14 macd macd_signal macd_histogram bb_upper bb_middle "
                     "bb_lower bb_width bb_position atr_14 stoch_k stoch_d williams_r obv volume_ratio momentum_5 momentum_10 "
                     "momentum_20 volatility_10 volatility_20").split()


def indicator_table(df: DataFrame) -> DataFrame:
    """Fixed-schema projection; a missing indicator is a null column."""
    return df.select("symbol", "date", *[(F.col(c) if c in df.columns else F.lit(None)).cast("double").alias(c)
                                         for c in INDICATOR_COLUMNS])


def store_indicators(df: DataFrame, path: str) -> None:
    _write(indicator_table(df), path, "append", [])


def regime_rows(df: DataFrame, version: str = "v1.0") -> DataFrame:
    """Probability arrays to one row per regime with the row maximum as confidence."""
    keep = [c for c in ("series", "date") if c in df.columns]
    out = df.select(*keep, F.array_max("probs").alias("confidence_score"), F.posexplode("probs").alias("regime_id", "regime_probability"))
    return out.select(*keep, "regime_id", "regime_probability", F.concat(F.lit("regime_"), F.col("regime_id")).alias("regime_name"),
                      F.lit(version).alias("model_version"), "confidence_score")


def store_regimes(df: DataFrame, path: str, version: str = "v1.0") -> None:
    _write(regime_rows(df, version), path, "append", ["model_version"])


REQUIRED_PREDICTION = ["symbol", "prediction_date", "target_date", "prediction_value"]


def prediction_rows(df: DataFrame, model_id: int) -> DataFrame:
    missing = [c for c in REQUIRED_PREDICTION if c not in df.columns]
    if missing:
        raise ValueError(f"predictions lack columns {missing}")
    return df.withColumn("model_id", F.lit(model_id))


def store_predictions(df: DataFrame, model_id: int, path: str) -> None:
    _write(prediction_rows(df, model_id), path, "append", ["model_id"])


def read_market_data(spark: SparkSession, path: str, symbols=None, start=None, end=None) -> DataFrame:
    """Symbol and date filters are pushed to the scan; the year filter prunes partitions."""
    df = spark.read.parquet(path)
    if "year" in df.columns:
        if start is not None:
            df = df.where(F.col("year") >= F.year(F.lit(start).cast("timestamp")))
        if end is not None:
            df = df.where(F.col("year") <= F.year(F.lit(end).cast("timestamp")))
    return select_bars(df, symbols, start, end).orderBy("symbol", "date")


def read_features(long: DataFrame, names: list[str], symbols=None, start=None, end=None, categories=None) -> DataFrame:
    """Filter the long feature table, then pivot the named features."""
    if categories is not None:
        long = long.where(F.col("feature_category").isin(list(categories)))
    long = select_bars(long, symbols, start, end).where(F.col("feature_name").isin(names))
    return long.groupBy("symbol", "date").pivot("feature_name", names).agg(F.first("feature_value", ignorenulls=True))


def read_regimes(long: DataFrame, n_regimes: int, start=None, end=None, version=None) -> DataFrame:
    if version is not None:
        long = long.where(F.col("model_version") == version)
    long = select_bars(long, None, start, end)
    keys = [c for c in ("series", "date") if c in long.columns]
    wide = long.groupBy(*keys).pivot("regime_id", list(range(n_regimes))).agg(F.first("regime_probability", ignorenulls=True))
    return wide.select(*keys, *[F.col(f"`{i}`").alias(f"regime_{i}") for i in range(n_regimes)])


def table_summary(tables: dict[str, tuple[DataFrame, str | None]]) -> DataFrame:
    """Row count, column count and date range per table, one scan each."""
    out = None
    for name, (df, time) in tables.items():
        t = F.col(time) if time else F.lit(None)
        row = df.agg(F.count(F.lit(1)).alias("rows"), F.min(t).cast("timestamp").alias("first_date"),
                     F.max(t).cast("timestamp").alias("last_date"))
        row = row.select(F.lit(name).alias("table_name"), "rows", F.lit(len(df.columns)).alias("n_columns"), "first_date", "last_date")
        out = row if out is None else out.unionByName(row)
    return out


def write_with_lineage(df: DataFrame, path: str, log_path: str, table: str, mode: str = "append") -> None:
    """Write and append (table, row count, time) counted during the same pass."""
    seen = Observation(f"lineage_{table}")
    df.observe(seen, F.count(F.lit(1)).alias("record_count")).write.mode(mode).parquet(path)
    spark = df.sparkSession
    row = spark.range(1).select(F.lit(table).alias("table_name"), F.lit(int(seen.get["record_count"])).alias("record_count"),
                                F.current_timestamp().alias("updated_at"))
    row.write.mode("append").parquet(log_path)


def retention(df: DataFrame, days: int, time="date", asof=None) -> DataFrame:
    """Rows not older than ``days`` before ``asof`` (default: now)."""
    ref = F.lit(asof).cast("timestamp") if asof is not None else F.current_timestamp()
    return df.where(F.col(time) >= ref - F.make_dt_interval(F.lit(days)))


def retention_delete(spark: SparkSession, path: str, out_path: str, days: int, time="date", asof=None, by=("year",)) -> None:
    """Plain Parquet has no DELETE: kept rows are written to a new table version; partition pruning skips old files."""
    df = retention(spark.read.parquet(path), days, time, asof)
    if "year" in df.columns:  # the partition column bounds the files that are read
        ref = F.lit(asof).cast("timestamp") if asof is not None else F.current_timestamp()
        df = df.where(F.col("year") >= F.year(ref - F.make_dt_interval(F.lit(days))))
    _write(df, out_path, "overwrite", [b for b in by if b in df.columns])


def jdbc_options(url: str, table: str, user=None, password=None, driver=None, partition=None) -> dict[str, str]:
    """Reader/writer options; ``partition`` = (column, lower, upper, parts) splits the scan."""
    opts = {"url": url, "dbtable": table, "batchsize": "1000"}
    opts |= {k: v for k, v in (("user", user), ("password", password), ("driver", driver)) if v}
    if partition:
        col, lo, hi, parts = partition
        opts |= {"partitionColumn": col, "lowerBound": str(lo), "upperBound": str(hi), "numPartitions": str(parts)}
    return opts


def read_jdbc(spark: SparkSession, **kw) -> DataFrame:
    return spark.read.format("jdbc").options(**jdbc_options(**kw)).load()


def write_jdbc(df: DataFrame, mode="append", **kw) -> None:
    df.write.format("jdbc").mode(mode).options(**jdbc_options(**kw)).save()


def model_record(df: DataFrame, parameters: list[str], metrics: list[str]) -> DataFrame:
    """Pack parameter and metric columns into JSON text columns."""
    rest = [c for c in df.columns if c not in parameters + metrics]
    return df.select(*rest, F.to_json(F.struct(*parameters)).alias("parameters"), F.to_json(F.struct(*metrics)).alias("performance_metrics"))


def parse_model_record(df: DataFrame, parameters: str, metrics: str) -> DataFrame:
    return df.withColumns({"p": F.from_json("parameters", parameters), "m": F.from_json("performance_metrics", metrics)}) \
        .drop("parameters", "performance_metrics").select("*", "p.*", "m.*").drop("p", "m")


__all__ = [n for n in dir() if not n.startswith("_")] + ["schemas"]
