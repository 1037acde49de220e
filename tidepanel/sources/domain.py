"""Domain tables derived from the star-schema and event tables.

bars          one row per (symbol, trading day), built from single trades
index         one price series per sector and day
fundamentals  statement lines per (symbol, quarter)
macro         monthly indicator values
points        hourly observations per event stream
Raw rows are always reduced by partial aggregation before any window, so the
length of a symbol's history is bounded by the calendar, however many trades a
single symbol has.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidepanel.core.frames import div, moment, ordered
from tidepanel.sources.bars import bars_from_trades


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    # zone-less timestamps are read in the session zone (UTC)
    ntz = [f.name for f in df.schema.fields if f.dataType.simpleString() == "timestamp_ntz"]
    return df.withColumns({n: F.col(n).cast("timestamp") for n in ntz})


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_suppkey").alias("symbol"), F.col("l_shipdate").alias("ts"),
        div("l_extendedprice", "l_quantity").alias("price"), F.col("l_quantity").alias("quantity"),
        F.col("l_discount").alias("discount"),
        F.col("l_orderkey").alias("seq1"), F.col("l_linenumber").alias("seq2"))


def line_order(order: str, line: str):
    """One long that sorts like (order, line); orders have fewer than 2**16 lines."""
    return F.shiftleft(F.col(order).cast("long"), 16) + F.col(line)


def bars(spark: SparkSession, sf_dir: str, start=None, end=None) -> DataFrame:
    """Daily bars; a date range is applied to the raw trades, so that it reaches their scan."""
    t = trades(spark, sf_dir)
    if start is not None:
        t = t.where(F.col("ts") >= F.lit(start).cast("timestamp"))
    if end is not None:
        t = t.where(F.col("ts") < F.lit(end).cast("timestamp") + F.expr("INTERVAL 1 DAY"))
    return bars_from_trades(t, "day", line_order("seq1", "seq2"), last={"adj_close": F.col("price") * (1 - F.col("discount"))})


def weekly(daily: DataFrame) -> DataFrame:
    """Weekly bars from daily bars, dated on Monday."""
    return (daily.groupBy("symbol", F.date_trunc("week", "date").alias("week"))
            .agg(F.min_by("open", "date").alias("open"), F.max("high").alias("high"),
                 F.min("low").alias("low"), F.max_by("close", "date").alias("close"),
                 F.sum("volume").alias("volume"))
            .withColumnRenamed("week", "date"))


def bars_w(spark, sf_dir) -> DataFrame:
    return weekly(bars(spark, sf_dir))


def with_returns(df: DataFrame, key="symbol") -> DataFrame:
    prev = F.lag("close").over(ordered(key))
    return df.withColumns({"ret": div("close", prev) - 1, "log_ret": F.log(div("close", prev))})


def rets(spark, sf_dir) -> DataFrame:
    return with_returns(bars(spark, sf_dir))


def calendar_bars(spark, sf_dir) -> DataFrame:
    """Bars on every weekday of the table's range, with null rows where a symbol did not trade."""
    from tidepanel.operators.cleaning import align_calendar
    return align_calendar(bars(spark, sf_dir).drop("adj_close"))


def parent_orders(spark, sf_dir) -> DataFrame:
    """One row per (order, symbol) with the order time and total quantity."""
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("order_id"), F.col("l_suppkey").alias("symbol")).agg(
        F.sum("l_quantity").alias("quantity"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_orderdate").alias("order_time"))
    return li.join(o, "order_id")


def sectors(spark, sf_dir) -> DataFrame:
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    return (s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
            .select(F.col("s_suppkey").alias("symbol"), F.col("r_name").alias("sector"), F.col("n_name").alias("industry")))


def index(spark, sf_dir) -> DataFrame:
    """Volume-weighted price index per sector: (series, date, close, volume, ret, log_ret)."""
    t = trades(spark, sf_dir).groupBy("symbol", F.col("ts").alias("date")).agg(
        F.sum(F.col("price") * F.col("quantity")).alias("v"), F.sum("quantity").alias("q"))
    d = (t.join(sectors(spark, sf_dir), "symbol").groupBy(F.col("sector").alias("series"), "date")
         .agg(div(F.sum("v"), F.sum("q")).alias("close"), F.sum("q").alias("volume")))
    return with_returns(d, "series")


def market(spark, sf_dir) -> DataFrame:
    """Market-wide price index: (date, close, volume, ret, log_ret)."""
    t = trades(spark, sf_dir).groupBy(F.col("ts").alias("date")).agg(
        div(F.sum(F.col("price") * F.col("quantity")), F.sum("quantity")).alias("close"),
        F.sum("quantity").alias("volume"))
    return with_returns(t.withColumn("series", F.lit("ALL")), "series")


def fundamentals(spark, sf_dir, period: str = "quarter") -> DataFrame:
    """Statement lines per symbol and period; fiscal_date is the last day of the period."""
    li = table(spark, sf_dir, "lineitem")
    e, d, t, q = F.col("l_extendedprice"), F.col("l_discount"), F.col("l_tax"), F.col("l_quantity")
    months = {"quarter": 3, "year": 12}[period]
    start = F.date_trunc(period, "l_shipdate")
    li = li.withColumn("_at", moment("l_shipdate", line_order("l_orderkey", "l_linenumber")))
    out = li.groupBy(F.col("l_suppkey").alias("symbol"), start.alias("start")).agg(
        F.sum(e).alias("revenue"), F.sum(e * (1 - d)).alias("gross_profit"),
        F.sum(e * (0.06 - d)).alias("operating_income"),
        F.sum(e * (0.05 - d) * (1 - t)).alias("net_income"),
        F.sum(e * (0.09 - d)).alias("ebitda"), F.sum(e * t * 0.1).alias("dividends"),
        F.sum(e * (1 + t) * 2).alias("total_assets"), F.sum(e * (0.5 + d)).alias("total_equity"),
        F.sum(e * (0.4 + t)).alias("current_assets"), F.sum(e * (0.2 + d)).alias("current_liabilities"),
        F.sum(e * t).alias("inventory"), F.sum(e * d * 0.5).alias("cash"),
        F.sum(e * (0.3 + t - d)).alias("total_debt"), F.sum(e * (0.05 - d + t)).alias("operating_cash_flow"),
        F.sum(q).alias("shares"), F.max_by(div(e, q), "_at").alias("price"))
    end = F.last_day(F.add_months(F.col("start"), months - 1)).cast("timestamp")
    return out.withColumn("fiscal_date", end).drop("start")


def macro(spark, sf_dir) -> DataFrame:
    """Monthly order value per priority in millions: (date, indicator, value)."""
    o = table(spark, sf_dir, "orders")
    return (o.groupBy(F.date_trunc("month", "o_orderdate").alias("date"), F.col("o_orderpriority").alias("indicator"))
            .agg((F.sum("o_totalprice") / 1e6).alias("value")))


INDICATORS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def macro_wide(spark, sf_dir) -> DataFrame:
    """One row per month with columns urgent, high, medium, unspecified, low."""
    names = ["urgent", "high", "medium", "unspecified", "low"]
    m = macro(spark, sf_dir).groupBy("date").pivot("indicator", INDICATORS).agg(F.first("value"))
    return m.select("date", *[F.col(f"`{i}`").alias(n) for i, n in zip(INDICATORS, names)])


def ticks(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("symbol"), "ts", F.col("value").alias("price"),
                    F.lit(1.0).alias("quantity"), "event_id", "user_id")


def points(spark, sf_dir) -> DataFrame:
    """Hourly observations: (symbol, date, price, volume)."""
    return (ticks(spark, sf_dir).groupBy("symbol", F.date_trunc("hour", "ts").alias("date"))
            .agg(F.avg("price").alias("price"), F.sum("quantity").alias("volume")))


def momentum_sides(daily: DataFrame) -> DataFrame:
    """(symbol, date, side) at month ends: 1 for winners, -1 for losers of the month, from daily bars."""
    m = daily.groupBy("symbol", F.date_trunc("month", "date").alias("month")).agg(F.max_by("close", "date").alias("close"))
    m = m.withColumn("mom", div("close", F.lag("close").over(ordered("symbol", "month"))) - 1).where("mom is not null")
    side = F.when(F.col("mom") > 0, 1).otherwise(-1)
    return m.select("symbol", F.last_day("month").cast("timestamp").alias("date"), side.alias("side"))


def book(sides: DataFrame) -> DataFrame:
    """(symbol, date, weight): long 1.3 over winners, short 0.3 over losers of each date."""
    n = sides.groupBy("date", "side").agg(F.count(F.lit(1)).alias("n"))
    w = F.when(F.col("side") > 0, 1.3 / F.col("n")).otherwise(-0.3 / F.col("n"))
    return sides.join(n, ["date", "side"]).select("symbol", "date", w.alias("weight"))


def weights(spark, sf_dir) -> DataFrame:
    """Month-end momentum book: long 1.3 over winners, short 0.3 over losers."""
    return book(momentum_sides(bars(spark, sf_dir)))


def regimes(spark, sf_dir) -> DataFrame:
    """Volatility regimes of each sector index: index columns plus vol, probs, regime."""
    from tidepanel.operators.regimes import threshold
    return threshold(index(spark, sf_dir))


def market_regimes(spark, sf_dir) -> DataFrame:
    """Regimes of the market index: (date, close, volume, ret, vol, probs, regime)."""
    from tidepanel.operators.regimes import threshold
    return threshold(market(spark, sf_dir)).drop("series")
