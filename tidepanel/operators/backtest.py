"""Rebalancing, walk-forward evaluation, portfolio returns, trading costs, bootstrap."""
from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from tidepanel.core.frames import ANNUAL, attach, div, expanding, log_growth, no_inf, ordered
from tidepanel.operators.joins import asof

# fixed values: commission, spread and slippage in basis points
COST_BPS = 10.0 + 5.0 + 1.0


def rebalance_dates(dates: DataFrame, frequency: str = "monthly", strict: bool = False, time="date") -> DataFrame:
    """Last trading day per period; ``strict`` keeps only period ends that are trading days themselves."""
    d = dates.select(time).distinct()
    if frequency == "daily":
        return d
    unit = {"weekly": "week", "monthly": "month", "quarterly": "quarter"}[frequency]
    if strict:
        if frequency == "weekly":
            return d.where(F.weekday(time) == 4)
        end = F.last_day(F.add_months(F.date_trunc(unit, time), {"month": 0, "quarter": 2}[unit]))
        # business period end: step back from a weekend
        end = F.date_sub(end, F.greatest(F.weekday(end) - 4, F.lit(0)))
        return d.where(F.col(time).cast("date") == end)
    return d.groupBy(F.date_trunc(unit, time).alias("_p")).agg(F.max(time).alias(time)).select(time)


def walk_forward(df: DataFrame, key="series", x="ret", y="y", time="date", months: int | None = 12, least=50) -> DataFrame:
    """Univariate regression per (key, rebalance month) on the preceding months and its error in the month itself.

    Rows are reduced to monthly sums first; every fold is a window over those sums, so all
    folds cost one pass and no row is copied per fold. ``months=None`` is the expanding form.
    """
    m = df.where(f"{x} is not null and {y} is not null").groupBy(key, F.date_trunc("month", time).alias("month")).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(F.col(x) * F.col(x)).alias("sxx"),
        F.sum(F.col(x) * F.col(y)).alias("sxy"), F.sum(F.col(y) * F.col(y)).alias("syy"))
    idx = F.year("month") * 12 + F.month("month")
    w = Window.partitionBy(key).orderBy("_i").rangeBetween(-months if months else Window.unboundedPreceding, -1)
    m = m.withColumn("_i", idx)
    m = m.withColumns({f"t{c}": F.sum(c).over(w) for c in ("n", "sx", "sy", "sxx", "sxy")}).where(F.col("tn") >= least)
    c = F.col
    slope = div(c("tn") * c("tsxy") - c("tsx") * c("tsy"), c("tn") * c("tsxx") - c("tsx") * c("tsx"))
    m = m.withColumn("slope", slope).withColumn("intercept", (c("tsy") - c("slope") * c("tsx")) / c("tn"))
    a, b = c("intercept"), c("slope")
    sse = c("syy") + a * a * c("n") + b * b * c("sxx") - 2 * a * c("sy") - 2 * b * c("sxy") + 2 * a * b * c("sx")
    return m.select(key, c("month").alias("rebalance_date"), c("tn").cast("long").alias("n_train"), c("n").cast("long").alias("n_test"), "slope", "intercept", (sse / c("n")).alias("test_mse"))


def portfolio_returns(weights: DataFrame, rets: DataFrame, time="date") -> DataFrame:
    """Latest earlier book times the day's returns. Dates are matched to books once, rows join by key."""
    books = weights.select(F.col(time).alias("rebalance")).distinct().withColumn("_k", F.lit(0))
    # a book is effective from the day after its date
    books = books.withColumn("effective", F.col("rebalance") + F.expr("INTERVAL 1 DAY"))
    days = asof(rets.select(time, F.lit(0).alias("_k")).distinct(), books, ["_k"], time, "effective", ["rebalance"]).drop("_k").where("rebalance is not null")
    w = weights.select("symbol", F.col(time).alias("rebalance"), "weight")
    j = rets.where("ret is not null").select("symbol", time, "ret").join(days, time).join(w, ["symbol", "rebalance"])
    return j.groupBy(time).agg(F.sum(F.col("weight") * F.col("ret")).alias("ret"), F.sum("weight").alias("invested"), F.count(F.lit(1)).alias("positions"))


def trades_costs(weights: DataFrame, growth: DataFrame, bps: float = COST_BPS, min_trade: float = 1e-6) -> DataFrame:
    """Trades against drifted weights, cost per rebalance and cumulative log wealth net of cost.

    ``growth`` is (symbol, date, growth): gross growth from the book of ``date`` to the next one. What the weights of a
    book leave of 1 is cash and does not grow, so long and short positions drift together and a growth of 0 or less
    ends all wealth: ``ruined`` from there on, without a log.
    """
    g = weights.join(growth, ["symbol", "date"], "left").withColumn("growth", F.coalesce("growth", F.lit(1.0)))
    port = g.groupBy("date").agg((1 + F.sum(F.col("weight") * (F.col("growth") - 1))).alias("pg"))
    dates = weights.select("date").distinct().withColumn("_k", F.lit(0)).select("date", F.lead("date").over(Window.partitionBy("_k").orderBy("date")).alias("next"))
    drift = (g.join(port, "date").join(dates, "date").where("next is not null")
             .select("symbol", F.col("next").alias("date"), (-F.coalesce(div(F.col("weight") * F.col("growth"), "pg"), F.lit(0.0))).alias("weight")))
    t = weights.select("symbol", "date", "weight").unionByName(drift).groupBy("symbol", "date").agg(F.sum("weight").alias("trade"))
    t = t.where(F.abs("trade") > min_trade).groupBy("date").agg(F.count(F.lit(1)).alias("trades"), F.sum(F.abs("trade")).alias("turnover"))
    d = port.join(t, "date", "left").withColumns({"cost": F.coalesce("turnover", F.lit(0.0)) * bps / 1e4, "_k": F.lit(0)})
    step = log_growth(F.col("pg") - 1) + log_growth(-F.col("cost"))
    d = d.withColumn("_s", step)
    return d.select("date", "trades", "turnover", "cost", F.col("pg").alias("gross_growth"),
                    no_inf(F.sum("_s").over(expanding("_k"))).alias("log_wealth"), (F.sum("_s").over(expanding("_k")) == float("-inf")).alias("ruined"))


def benchmark(rets: DataFrame) -> DataFrame:
    return rets.where("ret is not null").groupBy("date").agg(F.avg("ret").alias("ret"), F.count(F.lit(1)).alias("assets"))


def bootstrap_ci(df: DataFrame, n_sim: int = 200, levels=(0.05, 0.95), key="series", value="ret", time="date", seed: int = 42) -> DataFrame:
    """Quantiles of annual return, volatility, Sharpe and drawdown over seeded resamples with replacement.

    Each (key, simulation, position) draws a source position from a text hash, so the resample
    is an equi-join and any engine can repeat it. The number of simulations is a parameter.
    """
    s = df.where(F.col(value).isNotNull()).select(key, F.col(value).alias("r"), (F.row_number().over(ordered(key, time)) - 1).alias("pos"))
    n = s.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    sims = n.select(key, "n", F.explode(F.sequence(F.lit(1), F.lit(n_sim))).alias("sim"))
    draw = sims.select(key, "n", "sim", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i"))
    h = F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(seed), "sim", "i")), 1, 8), 16, 10).cast("long")
    draw = draw.withColumn("pos", F.pmod(h, F.col("n")))
    x = draw.join(s, [key, "pos"])
    w = Window.partitionBy(key, "sim").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("_l", F.sum(log_growth("r")).over(w)).withColumn("_d", F.exp(F.col("_l") - F.greatest(F.max("_l").over(w), F.lit(-1e300))) - 1)
    m = x.groupBy(key, "sim").agg((F.exp(F.sum(log_growth("r")) * float(ANNUAL) / F.count(F.lit(1))) - 1).alias("annual_return"),
                                  (F.stddev_samp("r") * math.sqrt(ANNUAL)).alias("volatility"), F.min("_d").alias("max_drawdown"))
    m = m.withColumn("sharpe", div("annual_return", "volatility"))
    long = m.unpivot([key, "sim"], ["annual_return", "volatility", "max_drawdown", "sharpe"], "metric", "value")
    g = long.groupBy(key, "metric").agg(F.avg("value").alias("mean"), F.percentile("value", F.array(*[F.lit(p) for p in levels])).alias("_q"))
    return g.select(key, "metric", "mean", *[F.col("_q")[i].alias(f"q{int(round(p * 100)):02d}") for i, p in enumerate(levels)])


def expected_returns(rets: DataFrame, current: DataFrame, looks=(63, 126, 252), least=50) -> DataFrame:
    """Regime-weighted mean of the last 63 / 126 / 252 rows per symbol; ``current`` is one row of probabilities."""
    r = F.row_number().over(Window.partitionBy("symbol").orderBy(F.col("date").desc()))
    d = rets.where("ret is not null").select("symbol", "ret", r.alias("_r")).where(F.col("_r") <= max(looks))
    g = d.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.when(F.col("_r") <= k, F.col("ret"))).alias(f"m_{k}") for k in looks]).where(F.col("n") >= least)
    p = current.select(F.col("probs").alias("_p"))
    e = sum((F.col("_p")[i] * F.col(f"m_{k}") for i, k in enumerate(looks[1:], 1)), F.col("_p")[0] * F.col(f"m_{looks[0]}"))
    return attach(g, p).select("symbol", "n", e.alias("expected_return"))


def signal_returns(signals: DataFrame, current: DataFrame) -> DataFrame:
    """Signal scaled by sum p * (1 + 0.1 * regime)."""
    k = F.aggregate(F.transform("_p", lambda p, i: p * (1 + 0.1 * i)), F.lit(0.0), lambda a, v: a + v)
    return attach(signals, current.select(F.col("probs").alias("_p"))).withColumn("expected_return", F.col("signal") * k).drop("_p")


def equal_weight(universe: DataFrame, time="date") -> DataFrame:
    n = universe.groupBy(time).agg(F.count(F.lit(1)).alias("_n"))
    return universe.join(n, time).withColumn("weight", 1.0 / F.col("_n")).drop("_n")
