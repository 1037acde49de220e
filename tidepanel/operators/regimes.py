"""Market-regime labels and tests; every operator is keyed by series."""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidepanel.core.frames import corr, div, expanding, ordered, roll, whole
from tidepanel.functions.moments import argmax, array_sum, chi2_tail_even, entropy, f_tail_df2, kolmogorov_tail, normalised
from tidepanel.functions.smoothing import ewm_mean

KEY, TIME = "series", "date"


def prepare(df: DataFrame, features: list[str], target: str, key=KEY) -> DataFrame:
    """Drop incomplete rows and standardise all but the target (population deviation)."""
    df = df.na.drop(subset=[*features, target])
    w = whole(key)
    return df.withColumns({f: div(F.col(f) - F.avg(f).over(w), F.stddev_pop(f).over(w)) for f in features})


def one_hot(state: Column, n: int) -> Column:
    return F.array(*[F.when(state == i, 1.0).otherwise(0.0) for i in range(n)])


def smooth_centered(df: DataFrame, probs: str = "probs", n: int = 3, half: int = 2, keys=(KEY,), time=TIME) -> DataFrame:
    """Centred rolling mean of each probability (shorter at the ends), renormalised."""
    w = Window.partitionBy(*keys).orderBy(time).rowsBetween(-half, half)
    avg = F.array(*[F.avg(F.col(probs)[i]).over(w) for i in range(n)])
    return df.withColumn(probs, avg).withColumn(probs, normalised(F.col(probs)))


def smooth_ewm(df: DataFrame, probs: str = "probs", n: int = 3, alpha: float = 0.1, key=KEY, time=TIME) -> DataFrame:
    df = df.withColumns({f"_p{i}": F.col(probs)[i] for i in range(n)})
    df = ewm_mean(df, {f"_s{i}": (f"_p{i}", alpha) for i in range(n)}, key, time, by_alpha=True)
    return (df.withColumn(probs, normalised(F.array(*[F.col(f"_s{i}") for i in range(n)])))
            .drop(*[f"_{a}{i}" for a in "ps" for i in range(n)]))


def threshold(df: DataFrame, value: str = "ret", n: int = 3, window: int = 20, key=KEY, time=TIME) -> DataFrame:
    """Volatility-quantile regimes: adds vol, probs and regime. Rows before the first full window are regime 0."""
    df = df.withColumn("vol", roll(F.stddev_samp, value, window, key, time))
    cuts = F.percentile("vol", F.array(*[F.lit(i / n) for i in range(1, n)])).over(whole(key))
    df = df.withColumn("_q", cuts)
    state = F.lit(0)
    for j in range(n - 1):
        state = F.when(F.col("vol") > F.col("_q")[j], j + 1).otherwise(state)
    df = df.withColumns({"_known": F.col("vol").isNotNull(), "probs": one_hot(state, n)})
    df = smooth_centered(df, "probs", n, 2, (key, "_known"), time)
    return df.withColumn("regime", argmax(F.col("probs"))).drop("_q", "_known")


def threshold_stats(df: DataFrame, n: int = 3, key=KEY) -> DataFrame:
    """Thresholds and regime frequencies per series."""
    return df.groupBy(key).agg(F.percentile("vol", F.array(*[F.lit(i / n) for i in range(1, n)])).alias("thresholds"),
                               *[F.avg(F.when(F.col("regime") == i, 1.0).otherwise(0.0)).alias(f"freq_{i}") for i in range(n)])


def regime_scores(methods: DataFrame, values: DataFrame, value="ret", n: int = 3, key=KEY, time=TIME) -> DataFrame:
    """(key, method, bic): how well each method's most likely regimes explain a value, as a normal distribution per regime.

    Counted are ``n`` means, ``n`` variances and n - 1 regime shares; two grouped aggregates, no row leaves its partition unreduced.
    """
    labelled = methods.select(key, time, "method", argmax(F.col("probs")).alias("regime")).join(values.where(F.col(value).isNotNull()).select(key, time, value), [key, time])
    parts = labelled.groupBy(key, "method", "regime").agg(F.count(F.lit(1)).alias("n"), F.greatest(F.var_pop(value), F.lit(1e-12)).alias("v"))
    fit = F.sum(F.col("n") * (F.log(2 * math.pi * F.col("v")) + 1))
    return parts.groupBy(key, "method").agg((fit + (3 * n - 1) * F.log(F.sum("n"))).alias("bic"))


def ensemble(methods: DataFrame, scores: DataFrame, n: int = 3, key=KEY, time=TIME) -> DataFrame:
    """Weighted average of (method, key, time, probs); weight exp(-(bic - min bic)/1000), 1 without a bic."""
    w = Window.partitionBy(key)
    s = scores.withColumn("_w", F.coalesce(F.exp(-(F.col("bic") - F.min("bic").over(w)) / 1000), F.lit(1.0)))
    s = s.select(key, "method", (F.col("_w") / F.sum("_w").over(w)).alias("weight"))
    j = methods.join(s, [key, "method"])
    g = j.groupBy(key, time).agg(*[F.sum(F.col("probs")[i] * F.col("weight")).alias(f"p{i}") for i in range(n)])
    g = g.withColumn("probs", F.array(*[F.col(f"p{i}") for i in range(n)])).drop(*[f"p{i}" for i in range(n)])
    return g.withColumn("regime", argmax(F.col("probs")))


def ensemble_stats(df: DataFrame, key=KEY) -> DataFrame:
    return df.groupBy(key).agg(F.avg(entropy(F.col("probs"))).alias("mean_entropy"),
                               F.avg(1 - F.array_max("probs")).alias("mean_uncertainty"))


def transitions(df: DataFrame, key=KEY, time=TIME) -> DataFrame:
    """Counts and row-normalised probabilities of regime-to-regime moves."""
    nxt = F.lead("regime").over(ordered(key, time))
    t = df.select(key, F.col("regime").alias("from_regime"), nxt.alias("to_regime")).where(F.col("to_regime").isNotNull())
    t = t.groupBy(key, "from_regime", "to_regime").agg(F.count(F.lit(1)).alias("n"))
    return t.withColumn("prob", F.col("n") / F.sum("n").over(Window.partitionBy(key, "from_regime")))


def persistence(df: DataFrame, key=KEY, time=TIME) -> DataFrame:
    """Share of a regime's rows whose predecessor row has the same regime (first row of a regime excluded)."""
    prev = F.lag("regime").over(ordered(key, time))
    d = df.withColumn("_same", F.when(prev == F.col("regime"), 1.0).otherwise(0.0))
    return d.groupBy(key, "regime").agg(F.count(F.lit(1)).alias("rows"),
                                        div(F.sum("_same"), F.count(F.lit(1)) - 1.0).alias("persistence"))


def transition_returns(df: DataFrame, value="ret", big=0.02, key=KEY, time=TIME) -> DataFrame:
    """Return statistics on the rows right before a regime switch."""
    nxt = F.lead("regime").over(ordered(key, time))
    d = df.withColumn("_n", nxt).where(F.col("_n") != F.col("regime"))
    return d.groupBy(key).agg(F.count(F.lit(1)).alias("switches"), F.avg(value).alias("mean_ret"), F.stddev_pop(value).alias("std_ret"),
                              F.avg(F.when(F.abs(value) > big, 1.0).otherwise(0.0)).alias("share_large"))


def episodes(df: DataFrame, key=KEY, time=TIME) -> DataFrame:
    """Runs of equal regime: (key, episode, regime, start, end, length)."""
    prev = F.lag("regime").over(ordered(key, time))
    d = df.withColumn("_s", F.when(prev.isNull() | (prev != F.col("regime")), 1).otherwise(0))
    d = d.withColumn("episode", F.sum("_s").over(expanding(key, time)))
    return d.groupBy(key, "episode", "regime").agg(F.min(time).alias("start"), F.max(time).alias("end"),
                                                   F.count(F.lit(1)).alias("length"))


def durations(df: DataFrame, key=KEY, time=TIME) -> DataFrame:
    e = episodes(df, key, time)
    return e.groupBy(key, "regime").agg(F.count(F.lit(1)).alias("episodes"), F.avg("length").alias("mean"),
                                        F.percentile("length", F.lit(0.5)).alias("median"),
                                        F.min("length").alias("shortest"), F.max("length").alias("longest"))


def step(probs: DataFrame, trans: DataFrame, key=KEY) -> DataFrame:
    """(key, regime, p) moved one period by the transition table; both sides have at most n^2 rows per key."""
    t = trans.select(key, F.col("from_regime").alias("regime"), "to_regime", "prob")
    return (probs.join(t, [key, "regime"]).groupBy(key, F.col("to_regime").alias("regime"))
            .agg(F.sum(F.col("p") * F.col("prob")).alias("p")))


def matrix(trans: DataFrame, n: int = 3, key=KEY) -> DataFrame:
    """One row per key with the transition table as array<array<double>>; an unseen regime stays put."""
    cell = lambda i, j: F.coalesce(F.sum(F.when((F.col("from_regime") == i) & (F.col("to_regime") == j), F.col("prob"))),
                                   F.lit(0.0)).alias(f"a{i}{j}")
    m = trans.groupBy(key).agg(*[cell(i, j) for i in range(n) for j in range(n)])
    rows = []
    for i in range(n):
        total = sum((F.col(f"a{i}{j}") for j in range(1, n)), F.col(f"a{i}0"))
        rows.append(F.array(*[F.when(total > 0, F.col(f"a{i}{j}")).otherwise(1.0 if i == j else 0.0) for j in range(n)]))
    return m.select(key, F.array(*rows).alias("a"))


def _times(p: Column, a: Column, n: int) -> Column:
    return F.array(*[sum((p[i] * a[i][j] for i in range(1, n)), p[0] * a[0][j]) for j in range(n)])


def forecast(current: DataFrame, trans: DataFrame, horizon: int = 5, n: int = 3, key=KEY) -> DataFrame:
    """h-step probabilities for h = 1..horizon from each key's current probabilities."""
    df = current.select(key, "probs").join(matrix(trans, n, key), key)
    for h in range(1, horizon + 1):
        df = df.withColumn("probs", _times(F.col("probs"), F.col("a"), n)).withColumn(f"h{h}", F.col("probs"))
    steps = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"h{h}").alias("probs")) for h in range(1, horizon + 1)])
    return df.select(key, F.explode(steps).alias("s")).select(key, "s.*")


def steady_state(trans: DataFrame, n: int = 3, squarings: int = 10, key=KEY) -> DataFrame:
    """Stationary distribution by repeated squaring of the transition table (2^squarings steps)."""
    def squared(a):
        return F.array(*[F.array(*[sum((a[i][k] * a[k][j] for k in range(1, n)), a[i][0] * a[0][j])
                                   for j in range(n)]) for i in range(n)])

    df = matrix(trans, n, key)
    df = df.withColumn("a", F.aggregate(F.sequence(F.lit(1), F.lit(squarings)), F.col("a"), lambda a, _: squared(a)))
    start = F.array(*[F.lit(1.0 / n) for _ in range(n)])
    return df.select(key, _times(start, F.col("a"), n).alias("probs"))


def current(df: DataFrame, confident: float = 0.7, key=KEY, time=TIME) -> DataFrame:
    last = df.groupBy(key).agg(F.max_by(F.struct(time, "regime", "probs"), time).alias("r")).select(key, "r.*")
    return last.withColumns({"probability": F.array_max("probs"), "confident": F.array_max("probs") >= confident})


def triggers(df: DataFrame, value="ret", look=20, key=KEY, time=TIME) -> DataFrame:
    """Mean and deviation of the rows before each switch, summarised per (from, to) with 95% levels."""
    w = ordered(key, time).rowsBetween(-look, -1)
    prev = F.lag("regime").over(ordered(key, time))
    pos = F.row_number().over(ordered(key, time))
    d = df.select(key, time, "regime", prev.alias("from_regime"), F.avg(value).over(w).alias("m"),
                  F.stddev_samp(value).over(w).alias("s"), pos.alias("pos"))
    d = d.where((F.col("from_regime") != F.col("regime")) & (F.col("pos") > look))
    return d.groupBy(key, "from_regime", F.col("regime").alias("to_regime")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("m").alias("mean_before"), F.avg("s").alias("vol_before"),
        F.percentile("s", F.lit(0.95)).alias("vol_95"), F.percentile("m", F.lit(0.95)).alias("mean_95"),
        F.min(time).alias("first_switch"), F.max(time).alias("last_switch"))


def macro_trend(df: DataFrame, value: str, look=20, key=KEY, time=TIME) -> DataFrame:
    """(last - first)/rows of a macro value over the rows before each switch."""
    w = ordered(key, time).rowsBetween(-look, -1)
    prev = F.lag("regime").over(ordered(key, time))
    d = df.select(key, time, "regime", prev.alias("from_regime"),
                  div(F.last(value).over(w) - F.first(value).over(w), F.count(value).over(w).cast("double")).alias("trend"))
    return d.where(F.col("from_regime") != F.col("regime"))


def stability(df: DataFrame, n: int = 3, key=KEY, time=TIME) -> DataFrame:
    """Mean, deviation, share above one half, lag-1 autocorrelation and score per regime probability."""
    long = df.select(key, time, F.posexplode("probs").alias("regime", "p"))
    long = long.withColumn("_l", F.lag("p").over(ordered([key, "regime"], time)))
    g = long.groupBy(key, "regime").agg(F.avg("p").alias("mean_p"), F.stddev_pop("p").alias("std_p"),
                                        F.avg(F.when(F.col("p") > 0.5, 1.0).otherwise(0.0)).alias("persistence"),
                                        F.coalesce(corr("p", "_l"), F.lit(0.0)).alias("autocorrelation"))
    return g.withColumn("score", F.col("mean_p") * F.col("autocorrelation") / (F.col("std_p") + 1e-8))


def switching(df: DataFrame, level=0.7, key=KEY, time=TIME) -> DataFrame:
    """Switch count and frequency, mean duration, share of rows with a dominant regime."""
    prev = F.lag("regime").over(ordered(key, time))
    d = df.withColumn("_s", F.when(prev != F.col("regime"), 1).otherwise(0))
    g = d.groupBy(key).agg(F.sum("_s").alias("switches"), F.count(F.lit(1)).alias("rows"),
                           F.avg(F.when(F.array_max("probs") > level, 1.0).otherwise(0.0)).alias("stable_share"))
    return g.withColumns({"frequency": F.col("switches") / F.col("rows"), "mean_duration": F.col("rows") / (F.col("switches") + 1.0)})


def arch_test(df: DataFrame, value="ret", lags=10, key=KEY, time=TIME) -> DataFrame:
    """Correlation of squared values with their lag and the Ljung-Box statistic over ``lags`` lags."""
    d = df.where(F.col(value).isNotNull()).withColumn("_q", F.col(value) * F.col(value))
    d = d.withColumn("_d", F.col("_q") - F.avg("_q").over(whole(key)))
    w = ordered(key, time)
    d = d.withColumns({f"_l{k}": F.lag("_d", k).over(w) for k in range(1, lags + 1)})
    d = d.groupBy(key).agg(corr("_d", "_l1").alias("corr"), F.count(F.lit(1)).alias("n"), F.sum(F.col("_d") * F.col("_d")).alias("c0"),
                           *[F.sum(F.col("_d") * F.col(f"_l{k}")).alias(f"c{k}") for k in range(1, lags + 1)])
    n = F.col("n").cast("double")
    q = sum((F.pow(div(f"c{k}", "c0"), 2) / (n - k) for k in range(2, lags + 1)), F.pow(div("c1", "c0"), 2) / (n - 1))
    lb = n * (n + 2) * q
    return d.select(key, "n", "corr", lb.alias("ljung_box"), chi2_tail_even(lb, lags).alias("p_value"))


def cusum(df: DataFrame, value="close", level=0.5, key=KEY, time=TIME) -> DataFrame:
    """Cumulated AR(1) residuals scaled by the root of their sum of squares; flags |path| > level."""
    d = df.withColumn("_l", F.lag(value).over(ordered(key, time))).where(F.col("_l").isNotNull() & F.col(value).isNotNull())
    w = whole(key)
    d = d.withColumn("_r", F.col(value) - F.regr_intercept(value, "_l").over(w) - F.regr_slope(value, "_l").over(w) * F.col("_l"))
    path = F.sum("_r").over(expanding(key, time)) / F.sqrt(F.sum(F.col("_r") * F.col("_r")).over(w))
    d = d.withColumn("cusum", path)
    return d.withColumn("candidate", F.abs("cusum") > level).drop("_l", "_r")


def cusum_summary(path: DataFrame, key=KEY) -> DataFrame:
    """Largest scaled deviation with its Kolmogorov p-value and the number of candidates."""
    g = path.groupBy(key).agg(F.max(F.abs("cusum")).alias("statistic"), F.sum(F.col("candidate").cast("long")).alias("candidates"))
    g = g.withColumn("p_value", kolmogorov_tail(F.col("statistic")))
    return g.withColumn("significant", (F.col("candidates") > 0) & (F.col("p_value") < 0.05))


def _rss(y2: Column, n: Column, sy: Column, sty: Column, st: Column, stt: Column) -> Column:
    stc, syc = stt - st * st / n, y2 - sy * sy / n
    cross = sty - st * sy / n
    return syc - cross * cross / stc


def chow(df: DataFrame, value="close", lo=0.2, hi=0.8, key=KEY, time=TIME) -> DataFrame:
    """Chow F for every split between lo and hi on a time trend, from running sums."""
    w = whole(key)
    d = df.where(F.col(value).isNotNull()).withColumns({
        "_t": (F.row_number().over(ordered(key, time)) - 1).cast("double"), "_n": F.count(F.lit(1)).over(w).cast("double"),
        "_y": F.col(value) - F.avg(value).over(w)})
    d = d.withColumn("_t", F.col("_t") - (F.col("_n") - 1) / 2)
    part = ordered(key, time).rowsBetween(Window.unboundedPreceding, -1)
    y, t = F.col("_y"), F.col("_t")
    sums = {"y2": y * y, "y": y, "ty": t * y, "t": t, "tt": t * t}
    d = d.withColumns({**{f"_a{k}": F.coalesce(F.sum(e).over(part), F.lit(0.0)) for k, e in sums.items()},
                       **{f"_z{k}": F.sum(e).over(w) for k, e in sums.items()}, "split": F.row_number().over(ordered(key, time)) - 1})
    m, n = F.col("split").cast("double"), F.col("_n")
    a, z = {k: F.col(f"_a{k}") for k in sums}, {k: F.col(f"_z{k}") for k in sums}
    full_rss = _rss(z["y2"], n, z["y"], z["ty"], z["t"], z["tt"])
    left = _rss(a["y2"], m, a["y"], a["ty"], a["t"], a["tt"])
    right = _rss(z["y2"] - a["y2"], n - m, z["y"] - a["y"], z["ty"] - a["ty"], z["t"] - a["t"], z["tt"] - a["tt"])
    d = d.where((m >= F.floor(lo * n)) & (m < F.floor(hi * n)) & (m > 5) & (n - m > 5))
    f = ((full_rss - left - right) / 2) / ((left + right) / (n - 4))
    d = d.withColumn("f_stat", f)
    return d.select(key, time, "split", "f_stat", f_tail_df2(F.greatest(F.col("f_stat"), F.lit(0.0)), n - 4).alias("p_value"))


def recursive_residuals(df: DataFrame, value="close", start=20, level=2.0, key=KEY, time=TIME) -> DataFrame:
    """One-step prediction errors of an expanding trend; flags those beyond ``level`` deviations."""
    d = df.where(F.col(value).isNotNull()).withColumn("_t", (F.row_number().over(ordered(key, time)) - 1).cast("double"))
    past = ordered(key, time).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("residual", F.col(value) - F.regr_intercept(value, "_t").over(past) - F.regr_slope(value, "_t").over(past) * F.col("_t"))
    d = d.where(F.col("_t") >= start)
    d = d.withColumn("standardised", div("residual", F.stddev_pop("residual").over(whole(key))))
    return d.withColumn("candidate", F.abs("standardised") > level).drop("_t")
