"""Grouped summaries: markets, regimes, performance, factors, portfolios."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidepanel.core.frames import ANNUAL, corr, div, expanding, full, log_growth, ordered, roll, trailing, whole
from tidepanel.core.ordering import grouped_quantiles, grouped_rank
from tidepanel.core.scratch import materialise
from tidepanel.functions.moments import f_tail_df2, kurt_g2, skew_g1
from tidepanel.operators.sets import top_per_group
from tidepanel.operators.technical import drawdown

YEAR = float(ANNUAL)


def market_summary(rets: DataFrame, key="symbol", time="date") -> DataFrame:
    """Range, returns, volatility, Sharpe, drawdown and last values per symbol."""
    d = rets.withColumn("_p", F.max("close").over(expanding(key, time))).withColumn("_dd", div("close", "_p") - 1)
    g = d.groupBy(key).agg(F.min(time).alias("start_date"), F.max(time).alias("end_date"), F.min_by("close", time).alias("_f"),
                           F.max_by("close", time).alias("last_price"), F.max_by("volume", time).alias("last_volume"),
                           F.count(F.lit(1)).alias("n"), F.stddev_samp("ret").alias("_s"), F.min("_dd").alias("max_drawdown"))
    total = div("last_price", "_f") - 1
    g = g.withColumn("total_return", total)
    g = g.withColumns({"annual_return": F.pow(1 + F.col("total_return"), YEAR / F.col("n")) - 1, "volatility": F.col("_s") * math.sqrt(YEAR)})
    return g.withColumn("sharpe", div("annual_return", "volatility")).drop("_f", "_s")


def feature_stats(df: DataFrame, cols: list[str]) -> DataFrame:
    """Count, mean, std, min, max, median, skew, kurtosis and missing share per column."""
    long = df.select(*[F.col(c).cast("double") for c in cols]).unpivot([], cols, "feature", "value")
    long = materialise(long, "long")
    g = long.groupBy("feature").agg(F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
                                    F.min("value").alias("min"), F.max("value").alias("max"), skew_g1("value").alias("skewness"),
                                    kurt_g2("value").alias("kurtosis"), F.avg(F.col("value").isNull().cast("int")).alias("missing"))
    return g.join(grouped_quantiles(long, ["feature"], "value", {"median": 0.5}, stage=False).drop("n"), "feature")


def regime_drawdown(df: DataFrame, keys: list[str], value="ret", time="date") -> DataFrame:
    d = drawdown(df.where(F.col(value).isNotNull()), keys, time, value)
    return d.groupBy(*keys).agg(F.min("drawdown").alias("max_drawdown"))


def regime_stats(df: DataFrame, key="series", value="ret", time="date") -> DataFrame:
    """Frequency, days, annual mean and volatility, Sharpe, moments, drawdown, mean episode length."""
    from tidepanel.operators.regimes import episodes
    n = F.count(F.lit(1)).over(whole(key))
    d = df.withColumn("_n", n)
    g = d.groupBy(key, "regime").agg(F.count(F.lit(1)).alias("days"), (F.count(F.lit(1)) / F.max("_n")).alias("frequency"),
                                     (F.avg(value) * YEAR).alias("mean"), (F.stddev_samp(value) * math.sqrt(YEAR)).alias("volatility"),
                                     skew_g1(value).alias("skewness"), kurt_g2(value).alias("kurtosis"))
    e = episodes(df, key, time).groupBy(key, "regime").agg(F.avg("length").alias("episode_length"))
    g = g.join(regime_drawdown(df, [key, "regime"], value, time), [key, "regime"]).join(e, [key, "regime"])
    return g.withColumn("sharpe", div("mean", "volatility"))


def regime_characterise(df: DataFrame, key="series", value="ret", least=5) -> DataFrame:
    """Median, hit rate and value at risk per regime; regimes with few rows are left out."""
    d = df.where(F.col(value).isNotNull())
    g = d.groupBy(key, "regime").agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
                                     F.percentile(value, F.array(F.lit(0.05), F.lit(0.01), F.lit(0.5))).alias("_q"),
                                     F.avg((F.col(value) > 0).cast("int")).alias("hit_rate"), skew_g1(value).alias("skewness"))
    return g.where(F.col("n") > least).select(key, "regime", "n", "mean", "std", "hit_rate", "skewness", F.col("_q")[0].alias("var_95"),
                                              F.col("_q")[1].alias("var_99"), F.col("_q")[2].alias("median"))


def regime_asset_vol(df: DataFrame, key="symbol", value="ret") -> DataFrame:
    a = df.groupBy("regime", key).agg((F.stddev_pop(value) * math.sqrt(YEAR)).alias("vol")).where("vol is not null")
    a = materialise(a, "vol")
    g = a.groupBy("regime").agg(F.avg("vol").alias("mean_vol"), F.stddev_pop("vol").alias("std_vol"), F.min("vol").alias("min_vol"), F.max("vol").alias("max_vol"))
    return g.join(grouped_quantiles(a, ["regime"], "vol", {"median_vol": 0.5}, stage=False).drop("n"), "regime")


def regime_beta(df: DataFrame, key="symbol", value="ret", market="market", least=10) -> DataFrame:
    """Beta per asset and regime with a high/low label."""
    g = df.groupBy("regime", key).agg(F.regr_slope(value, market).alias("beta"), F.regr_count(value, market).alias("n"))
    return g.where((F.col("n") > least) & F.col("beta").isNotNull()).withColumn(
        "label", F.when(F.col("beta") > 1.2, "high").when(F.col("beta") < 0.8, "low").otherwise("neutral"))


def regime_beta_summary(betas: DataFrame) -> DataFrame:
    return betas.groupBy("regime").agg(F.count(F.lit(1)).alias("assets"), F.avg("beta").alias("mean_beta"), F.stddev_pop("beta").alias("dispersion"),
                                       F.sum((F.col("label") == "high").cast("long")).alias("high_beta"), F.sum((F.col("label") == "low").cast("long")).alias("low_beta"))


def regime_momentum(df: DataFrame, key="symbol", price="close", time="date", strong=0.1) -> DataFrame:
    a = df.groupBy("regime", key).agg((div(F.max_by(price, time), F.min_by(price, time)) - 1).alias("m"))
    return a.groupBy("regime").agg(F.count("m").alias("assets"), F.avg("m").alias("mean_momentum"), F.avg((F.col("m") > 0).cast("int")).alias("share_positive"),
                                   F.sum((F.col("m") > strong).cast("long")).alias("strong"))


def regime_reversion(df: DataFrame, key="symbol", value="ret", time="date", least=10) -> DataFrame:
    """Lag-1 autocorrelation inside the regime-filtered sequence of each asset."""
    d = df.where(F.col(value).isNotNull())
    d = d.withColumn("_l", F.lag(value).over(ordered(["regime", key], time)))
    a = d.groupBy("regime", key).agg(corr(value, "_l").alias("ac"), F.count("_l").alias("n")).where((F.col("n") > least) & F.col("ac").isNotNull())
    return a.groupBy("regime").agg(F.count(F.lit(1)).alias("assets"), F.avg("ac").alias("mean_autocorr"), F.avg((F.col("ac") < 0).cast("int")).alias("share_reverting"))


def regime_macro(df: DataFrame, time="date") -> DataFrame:
    """Per regime and indicator: mean, median, std, range and trend (calendar-bounded rows)."""
    return df.groupBy("regime", "indicator").agg(
        F.avg("value").alias("mean"), F.percentile("value", F.lit(0.5)).alias("median"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"),
        F.max("value").alias("max"), F.when(F.max_by("value", time) > F.min_by("value", time), "increasing").otherwise("decreasing").alias("trend"))


def cross_regime(df: DataFrame, key="series", value="ret") -> DataFrame:
    """One-way analysis of variance across regimes from grouped sums, with the volatility ratio."""
    g = df.where(F.col(value).isNotNull()).groupBy(key, "regime").agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v"))
    t = g.groupBy(key).agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("gm"),
                           F.sum(F.col("n") * F.col("m") * F.col("m")).alias("nm2"), F.sum((F.col("n") - 1) * F.col("v")).alias("within"),
                           F.max(F.sqrt("v")).alias("_hi"), F.min(F.sqrt("v")).alias("_lo"))
    between = F.col("nm2") - F.col("n") * F.col("gm") * F.col("gm")
    d1, d2 = F.col("k") - 1, F.col("n") - F.col("k")
    f = div(between / d1, F.col("within") / d2)
    # closed-form tail exists for three regimes (two numerator degrees of freedom)
    return t.select(key, "k", "n", f.alias("f_stat"), F.when(d1 == 2, f_tail_df2(F.greatest(f, F.lit(0.0)), d2)).alias("p_value"), div("_hi", "_lo").alias("vol_ratio"))


def performance(df: DataFrame, keys: list[str], value="ret", bench="bench", rf=0.02, time="date") -> DataFrame:
    """Sixteen performance measures per key against a benchmark column."""
    d = drawdown(df.where(F.col(value).isNotNull() & F.col(bench).isNotNull()), keys, time, value).withColumn("_e", F.col(value) - F.col(bench))
    x, ann = F.col(value), math.sqrt(YEAR)
    g = d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(log_growth(x)).alias("_l"), (F.stddev_samp(x) * ann).alias("annualized_volatility"),
        (F.stddev_samp(F.when(x < 0, x)) * ann).alias("_dv"), F.min("drawdown").alias("max_drawdown"), F.avg("_e").alias("_em"),
        (F.stddev_samp("_e") * ann).alias("tracking_error"), F.regr_slope(value, bench).alias("_b"), F.regr_intercept(value, bench).alias("_a"),
        F.avg((x > 0).cast("int")).alias("win_rate"), F.max(x).alias("best_day"), F.min(x).alias("worst_day"),
        skew_g1(x).alias("skewness"), kurt_g2(x).alias("kurtosis"))
    g = g.withColumns({"total_return": F.exp("_l") - 1, "annualized_return": F.exp(F.col("_l") * YEAR / F.col("n")) - 1})
    r = F.col("annualized_return")
    return g.withColumns({
        "sharpe_ratio": div(r - rf, "annualized_volatility"), "sortino_ratio": F.coalesce(div(r - rf, "_dv"), F.lit(0.0)),
        "calmar_ratio": F.coalesce(div(r, F.abs("max_drawdown")), F.lit(0.0)),
        "information_ratio": F.coalesce(div(F.col("_em") * ann, "tracking_error"), F.lit(0.0)),
        "beta": F.when(F.col("n") > 20, F.col("_b")).otherwise(1.0), "alpha": F.when(F.col("n") > 20, F.col("_a") * YEAR).otherwise(0.0),
    }).drop("_l", "_dv", "_em", "_a", "_b")


def risk_metrics(df: DataFrame, key="series", value="ret", time="date") -> DataFrame:
    """VaR/CVaR 95 and 99, volatility of volatility, downside deviation, extremes."""
    d = df.where(F.col(value).isNotNull())
    d = d.withColumn("_v", roll(F.stddev_samp, value, 21, key, time) * math.sqrt(YEAR))
    q = F.percentile(value, F.array(F.lit(0.05), F.lit(0.01))).over(whole(key))
    d = d.withColumn("_q", q)
    x = F.col(value)
    return d.groupBy(key).agg(F.max(F.col("_q")[0]).alias("var_95"), F.max(F.col("_q")[1]).alias("var_99"), F.avg(F.when(x <= F.col("_q")[0], x)).alias("cvar_95"),
                              F.avg(F.when(x <= F.col("_q")[1], x)).alias("cvar_99"), F.stddev_samp("_v").alias("volatility_of_volatility"),
                              (F.stddev_samp(F.when(x < 0, x)) * math.sqrt(YEAR)).alias("downside_deviation"), F.min(x).alias("max_daily_loss"), F.max(x).alias("max_daily_gain"))


def regime_attribution(df: DataFrame, keys=("series",), value="ret") -> DataFrame:
    long = df.where(F.col(value).isNotNull()).select(*keys, value, F.posexplode("probs").alias("regime", "p"))
    pr = F.col("p") * F.col(value)
    return long.groupBy(*keys, "regime").agg(F.sum(pr).alias("contribution"), div(F.sum(pr), F.sum("p")).alias("mean_return"),
                                             (F.stddev_samp(pr) * math.sqrt(YEAR)).alias("volatility"), F.avg("p").alias("mean_weight"))


def weighted_stats(df: DataFrame, keys=("series",), value="ret") -> DataFrame:
    """Probability-weighted mean and variance, variance from a second pass around the mean."""
    long = df.where(F.col(value).isNotNull()).select(*keys, value, F.posexplode("probs").alias("regime", "p"))
    w = whole([*keys, "regime"])
    long = long.withColumn("_m", div(F.sum(F.col("p") * F.col(value)).over(w), F.sum("p").over(w)))
    dev = F.col(value) - F.col("_m")
    return long.groupBy(*keys, "regime").agg(F.max("_m").alias("mean"), div(F.sum(F.col("p") * dev * dev), F.sum("p")).alias("variance"))


def factor_series(rets: DataFrame) -> DataFrame:
    """Equal-weight market and proxy factors per date from per-symbol rolling statistics."""
    d = rets.withColumn("_p", F.lag("ret").over(ordered()))
    d = d.withColumns({"_m21": roll(F.avg, "ret", 21), "_m63": roll(F.avg, "ret", 63), "_m252": roll(F.avg, "ret", 252),
                       "_s21": roll(F.stddev_samp, "ret", 21), "_s63": roll(F.stddev_samp, "ret", 63),
                       "_ac": full(21, "ret", corr("ret", "_p", trailing(20)))})
    g = d.groupBy("date").agg(F.avg("ret").alias("market"), F.stddev_samp("ret").alias("_sd"), *[F.avg(f"_{k}").alias(k) for k in ("m21", "m63", "m252", "s21", "s63", "ac")])
    g = g.where("market is not null").withColumn("_k", F.lit(0))
    return g.select("date", "market", (-F.col("_sd")).alias("smb"), (F.col("m252") - F.col("m21")).alias("hml"), F.col("m21").alias("momentum_1m"),
                    F.col("m63").alias("momentum_3m"), F.col("m252").alias("momentum_12m"), (F.col("m252") - F.col("m21")).alias("momentum"),
                    (-F.col("s63")).alias("profitability"), (-F.col("ac")).alias("investment_quality"), F.col("s21").alias("volatility"),
                    (-F.col("s21")).alias("low_volatility"), (F.col("s21") - roll(F.avg, "s21", 252, "_k")).alias("volatility_risk_premium"))


def resample_last(df: DataFrame, unit="month", key="indicator", value="value", time="date") -> DataFrame:
    """Last value per period, labelled with the period's last day."""
    months = {"month": 1, "quarter": 3}[unit]
    g = df.groupBy(key, F.date_trunc(unit, time).alias("_p")).agg(F.max_by(value, time).alias(value))
    return g.select(key, F.last_day(F.add_months("_p", months - 1)).cast("timestamp").alias(time), value)


def information_coefficient(df: DataFrame, features: list[str], target: str, method="spearman") -> DataFrame:
    """Correlation of each feature with the target; ranks are split-range, so no group sits in one task."""
    long = df.select(target, *features).unpivot([target], features, "feature", "value").where(f"value is not null and {target} is not null")
    x, y = "value", target
    if method == "spearman":
        # both ranks are taken from one stored table, so neither waits for a stored copy with the other
        base = materialise(long, "rank")
        long = grouped_rank(grouped_rank(base, ["feature"], "value", "_x", base=base), ["feature"], target, "_y", base=base)
        x, y = "_x", "_y"
    return long.groupBy("feature").agg(F.coalesce(corr(x, y), F.lit(0.0)).alias("ic"), F.count(F.lit(1)).alias("n"))


def portfolio_metrics(weights: DataFrame, keys=("date",)) -> DataFrame:
    """Exposures, position count, largest and top-five weight, concentration."""
    w = F.col("weight")
    keys = list(keys)
    g = weights.groupBy(*keys).agg(F.sum(F.abs(w)).alias("gross"), F.sum(w).alias("net"), F.sum(F.greatest(w, F.lit(0.0))).alias("long"),
                                   F.sum(F.least(w, F.lit(0.0))).alias("short"), F.sum((F.abs(w) > 1e-6).cast("long")).alias("positions"),
                                   F.max(F.abs(w)).alias("max_weight"), F.sum(w * w).alias("hhi"))
    t = top_per_group(weights, keys, 5, [F.abs("weight").desc(), F.col("symbol")]).groupBy(*keys).agg(F.sum(F.abs(w)).alias("top5"))
    return g.join(t, keys)


def turnover(weights: DataFrame, bps=10.0) -> DataFrame:
    """Trades between consecutive books: each book enters its own date positively and the next date negatively,
    so one aggregate per (symbol, date) gives the change without a full outer join."""
    dates = weights.select("date").distinct().withColumn("_k", F.lit(0))
    dates = dates.select("date", F.lead("date").over(Window.partitionBy("_k").orderBy("date")).alias("next"))
    prev = weights.join(dates, "date").where("next is not null").select("symbol", F.col("next").alias("date"), (-F.col("weight")).alias("weight"))
    dw = weights.select("symbol", "date", "weight").unionByName(prev).groupBy("symbol", "date").agg(F.sum("weight").alias("dw"))
    x = F.col("dw")
    return dw.groupBy("date").agg(F.sum(F.abs(x)).alias("turnover"), (F.sum(F.abs(x)) * bps).alias("cost_bps"), F.sum((F.abs(x) > 1e-6).cast("long")).alias("trades"),
                                  F.sum((x > 1e-6).cast("long")).alias("buys"), F.sum((x < -1e-6).cast("long")).alias("sells"))
