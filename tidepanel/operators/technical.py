"""Per-symbol price, momentum, volatility, volume and pattern features.

Every function adds columns to a panel with symbol, date and the bar columns. All
frames share one (symbol, date) ordering, so chained features reuse one exchange
and one sort.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tidepanel.core.sliding import median_and_deviation
from tidepanel.core.frames import ANNUAL, change, corr, div, expanding, full, log_growth, ordered, roll, trailing
from tidepanel.functions.moments import window_moments
from tidepanel.core.series import centred, full_windows, per_series, placed
from tidepanel.functions import smoothing
from tidepanel.functions.smoothing import ewm_mean, ewm_recursive, ewm_std

LOOKBACKS = (5, 10, 20, 50, 100, 252)


def _keep_where(arr, test, bound):
    """Array filter against another column (a two-argument lambda would receive the index)."""
    return F.filter(arr, lambda v: test(v, bound))


def returns(df: DataFrame, pad: bool = False) -> DataFrame:
    """Simple and log returns; ``pad`` compares with the last known price."""
    if pad:
        df = df.withColumn("_p", F.last("close", ignorenulls=True).over(expanding()))
        prev = F.lag("_p").over(ordered())
        return df.withColumns({"ret": div("_p", prev) - 1, "log_ret": F.log(div("_p", prev))}).drop("_p")
    prev = F.lag("close").over(ordered())
    return df.withColumns({"ret": div("close", prev) - 1, "log_ret": F.log(div("close", prev))})


def price_ratios(df: DataFrame) -> DataFrame:
    return df.withColumns({"high_low_ratio": div("high", "low"), "close_open_ratio": div("close", "open"),
                           "high_close_ratio": div("high", "close"), "low_close_ratio": div("low", "close")})


def sma(df: DataFrame, periods=LOOKBACKS) -> DataFrame:
    return df.withColumns({f"sma_{n}": roll(F.avg, "close", n) for n in periods})


def ema(df: DataFrame, periods=LOOKBACKS, adjust: bool = True) -> DataFrame:
    f = ewm_mean if adjust else ewm_recursive
    return f(df, {f"ema_{n}": ("close", n) for n in periods})


def price_to_ma(df: DataFrame, periods=LOOKBACKS, use_ema: bool = True) -> DataFrame:
    df = sma(df, periods)
    out = {}
    for n in periods:
        out[f"price_to_sma_{n}"] = div("close", f"sma_{n}")
        out[f"sma_slope_{n}"] = change(f"sma_{n}", 5)
    df = df.withColumns(out)
    if use_ema:
        df = ema(df, periods).withColumns({f"price_to_ema_{n}": div("close", f"ema_{n}") for n in periods})
    return df


def bollinger(df: DataFrame, periods=(20,), width: float = 2.0, ddof: int = 1) -> DataFrame:
    sd = F.stddev_samp if ddof else F.stddev_pop
    df = df.withColumns({k: v for n in periods for k, v in
                         ((f"bb_mid_{n}", roll(F.avg, "close", n)), (f"_sd_{n}", roll(sd, "close", n)))})
    out = {}
    for n in periods:
        mid, s = F.col(f"bb_mid_{n}"), F.col(f"_sd_{n}")
        out[f"bb_upper_{n}"], out[f"bb_lower_{n}"] = mid + width * s, mid - width * s
        out[f"bb_width_{n}"] = div(2 * width * s, mid)
        out[f"bb_position_{n}"] = div(F.col("close") - (mid - width * s), 2 * width * s)
    return df.withColumns(out).drop(*[f"_sd_{n}" for n in periods])


def _extremes(df: DataFrame, periods) -> DataFrame:
    """Rolling high and low as columns, so formulas that use them twice do not evaluate them twice."""
    return df.withColumns({k: e for n in periods for k, e in ((f"_hi{n}", roll(F.max, "high", n)), (f"_lo{n}", roll(F.min, "low", n)))})


def _drop_extremes(df: DataFrame, periods) -> DataFrame:
    return df.drop(*[f"_{k}{n}" for n in periods for k in ("hi", "lo")])


def channel(df: DataFrame, periods=(20, 50)) -> DataFrame:
    """Position of the close inside the rolling high-low channel."""
    df = _extremes(df, periods).withColumns({
        f"channel_position_{n}": div(F.col("close") - F.col(f"_lo{n}"), F.col(f"_hi{n}") - F.col(f"_lo{n}")) for n in periods})
    return _drop_extremes(df, periods)


def support_resistance(df: DataFrame, periods=(20, 50)) -> DataFrame:
    df, out = _extremes(df, periods), {}
    for n in periods:
        hi, lo = F.col(f"_hi{n}"), F.col(f"_lo{n}")
        out |= {f"high_{n}": hi, f"low_{n}": lo, f"high_distance_{n}": div(F.col("close") - hi, hi),
                f"low_distance_{n}": div(F.col("close") - lo, lo)}
    return _drop_extremes(df.withColumns(out), periods)


def rsi(df: DataFrame, periods=(14, 30)) -> DataFrame:
    """Simple-mean RSI; the first row has no change and counts as zero gain and loss."""
    delta = F.col("close") - F.lag("close").over(ordered())
    df = df.withColumn("_d", F.coalesce(delta, F.lit(0.0)))
    df = df.withColumns({"_gain": F.greatest(F.col("_d"), F.lit(0.0)), "_loss": F.greatest(-F.col("_d"), F.lit(0.0))})
    means = {f"{k}{n}": roll(F.avg, k, n) for k in ("_gain", "_loss") for n in periods}
    df, out = df.withColumns(means), {}
    for n in periods:
        g, l = F.col(f"_gain{n}"), F.col(f"_loss{n}")
        # no losses: RSI 100; no movement at all: undefined
        out[f"rsi_{n}"] = F.when((l == 0) & (g > 0), 100.0).otherwise(100 - 100 / (1 + div(g, l)))
    return df.withColumns(out).drop("_d", "_gain", "_loss", *means)


def rsi_wilder(df: DataFrame, periods=(14, 30)) -> DataFrame:
    """RSI with Wilder smoothing, alpha = 1/n (recursive mean, seeded with the first change)."""
    delta = F.coalesce(F.col("close") - F.lag("close").over(ordered()), F.lit(0.0))
    df = df.withColumn("_d", delta)
    df = df.withColumns({"_gain": F.greatest(F.col("_d"), F.lit(0.0)), "_loss": F.greatest(-F.col("_d"), F.lit(0.0))})
    jobs = {f"_{k}{n}": (f"_{k}", 2 * n - 1) for k in ("gain", "loss") for n in periods}
    df = ewm_recursive(df.withColumn("_rows", F.row_number().over(ordered())), jobs)
    rows = F.col("_rows")
    out = {}
    for n in periods:
        g, l = F.col(f"_gain{n}"), F.col(f"_loss{n}")
        out[f"rsi_wilder_{n}"] = F.when(rows >= n, F.when((l == 0) & (g > 0), 100.0).otherwise(100 - 100 / (1 + div(g, l))))
    return df.withColumns(out).drop("_d", "_gain", "_loss", "_rows")


def macd(df: DataFrame, fast=12, slow=26, signal=9) -> DataFrame:
    def lines(close: np.ndarray) -> list[np.ndarray]:
        line = smoothing.mean(close, fast) - smoothing.mean(close, slow)
        return [line, smoothing.mean(line, signal)]

    df = per_series(df, ["close"], ["macd_line", "macd_signal"], lines)
    return df.withColumn("macd_histogram", F.col("macd_line") - F.col("macd_signal"))


def momentum(df: DataFrame, periods=(5, 10, 20)) -> DataFrame:
    out = {}
    for n in periods:
        m = change("close", n)
        out |= {f"momentum_{n}": m, f"roc_{n}": 100 * m}
    return df.withColumns(out)


def williams_r(df: DataFrame, periods=(14, 28)) -> DataFrame:
    df = _extremes(df, periods).withColumns({
        f"williams_r_{n}": -100 * div(F.col(f"_hi{n}") - F.col("close"), F.col(f"_hi{n}") - F.col(f"_lo{n}")) for n in periods})
    return _drop_extremes(df, periods)


def stochastic(df: DataFrame, periods=(14, 21), smooth=3) -> DataFrame:
    df = _extremes(df, periods).withColumns({
        f"stoch_k_{n}": 100 * div(F.col("close") - F.col(f"_lo{n}"), F.col(f"_hi{n}") - F.col(f"_lo{n}")) for n in periods})
    return _drop_extremes(df, periods).withColumns({f"stoch_d_{n}": roll(F.avg, f"stoch_k_{n}", smooth) for n in periods})


def hist_vol(df: DataFrame, periods=(5, 10, 20, 50)) -> DataFrame:
    """Annualised rolling deviation of ``ret`` and its ratio to its own 2n mean."""
    df = df.withColumns({f"volatility_{n}": roll(F.stddev_samp, "ret", n) * math.sqrt(ANNUAL) for n in periods})
    return df.withColumns({f"volatility_ratio_{n}": div(f"volatility_{n}", roll(F.avg, f"volatility_{n}", 2 * n))
                           for n in periods})


def parkinson(df: DataFrame, periods=(5, 10, 20), as_coded: bool = False) -> DataFrame:
    """Range-based volatility; ``as_coded`` averages ln(H/L) without squaring."""
    hl = F.log(div("high", "low"))
    df = df.withColumn("_hl", hl if as_coded else hl * hl)
    scale = ANNUAL / (4 * math.log(2))
    return df.withColumns({f"parkinson_{n}": F.sqrt(roll(F.avg, "_hl", n) * scale) for n in periods}).drop("_hl")


def garch_like(df: DataFrame, n=20, keep=0.94) -> DataFrame:
    return df.withColumn("volatility_garch", F.sqrt(
        keep * roll(F.var_samp, "ret", n) + (1 - keep) * F.col("ret") * F.col("ret")))


def true_range_atr(df: DataFrame, periods=(14, 21)) -> DataFrame:
    """True range is undefined on the first bar."""
    prev = F.lag("close").over(ordered())
    tr = F.when(prev.isNotNull(), F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev),
                                             F.abs(F.col("low") - prev)))
    df = df.withColumn("true_range", tr)
    df = df.withColumns({f"atr_{n}": roll(F.avg, "true_range", n) for n in periods})
    return df.withColumns({f"atr_ratio_{n}": div(f"atr_{n}", "close") for n in periods})


def vol_clustering(df: DataFrame, n=20) -> DataFrame:
    df = df.withColumn("_r2", F.col("ret") * F.col("ret"))
    df = df.withColumn("_l2", F.lag("_r2").over(ordered()))
    return df.withColumn("volatility_clustering", full(
        n, "_l2", corr("_r2", "_l2", trailing(n)))).drop("_r2", "_l2")


def ewm_vol(df: DataFrame, periods=(10, 20, 50)) -> DataFrame:
    df = ewm_std(df, {f"ewm_vol_{n}": ("ret", n) for n in periods})
    return df.withColumns({f"ewm_vol_{n}": F.col(f"ewm_vol_{n}") * math.sqrt(ANNUAL) for n in periods})


def vol_of_vol(df: DataFrame, periods=(10, 20, 50)) -> DataFrame:
    df = df.withColumns({f"_v_{n}": roll(F.stddev_samp, "ret", n) for n in periods})
    df = df.withColumns({f"vol_of_vol_{n}": roll(F.stddev_samp, f"_v_{n}", n) for n in periods})
    return df.drop(*[f"_v_{n}" for n in periods])


def downside_vol(df: DataFrame, periods=(10, 20, 50)) -> DataFrame:
    """Deviation of the last n negative returns, given on the days that had one."""
    df = df.withColumn("_neg", F.coalesce(F.col("ret") < 0, F.lit(False)))
    key = ["symbol", "_neg"]
    return df.withColumns({f"downside_vol_{n}": F.when(F.col("_neg"), F.sqrt(
        roll(F.var_samp, "ret", n, key) * ANNUAL)) for n in periods}).drop("_neg")


def volume_ma(df: DataFrame, periods=(10, 20, 50)) -> DataFrame:
    df = df.withColumns({f"volume_ma_{n}": roll(F.avg, "volume", n) for n in periods})
    return df.withColumns({f"volume_ratio_{n}": div("volume", f"volume_ma_{n}") for n in periods})


def obv(df: DataFrame, n=20) -> DataFrame:
    df = df.withColumn("_s", F.coalesce(
        F.signum(F.col("close") - F.lag("close").over(ordered())) * F.col("volume"), F.lit(0.0)))
    df = df.withColumn("obv", F.sum("_s").over(expanding())).drop("_s")
    return df.withColumn("obv_ma", roll(F.avg, "obv", n))


def vpt(df: DataFrame) -> DataFrame:
    return df.withColumn("vpt", F.sum(F.col("ret") * F.col("volume")).over(expanding()))


def ad_line(df: DataFrame) -> DataFrame:
    clv = div(2 * F.col("close") - F.col("low") - F.col("high"), F.col("high") - F.col("low"))
    return df.withColumn("ad_line", F.sum(F.coalesce(clv, F.lit(0.0)) * F.col("volume")).over(expanding()))


def vwap(df: DataFrame, n=20, typical=14) -> DataFrame:
    """Rolling volume-weighted close and typical price."""
    tp = (F.col("high") + F.col("low") + F.col("close")) / 3
    df = df.withColumns({"_pv": F.col("close") * F.col("volume"), "_tv": tp * F.col("volume")})
    return df.withColumns({
        f"vwap_{n}": div(roll(F.sum, "_pv", n), roll(F.sum, "volume", n)),
        f"vwap_typical_{typical}": div(roll(F.sum, "_tv", typical), roll(F.sum, "volume", typical)),
    }).drop("_pv", "_tv")


def ease_of_movement(df: DataFrame, n=14) -> DataFrame:
    w = ordered()
    mid = (F.col("high") + F.col("low")) / 2 - (F.lag("high").over(w) + F.lag("low").over(w)) / 2
    df = df.withColumn("eom", div(mid * (F.col("high") - F.col("low")), "volume") * 1e8)
    return df.withColumn(f"eom_sma_{n}", roll(F.avg, "eom", n))


def candles(df: DataFrame) -> DataFrame:
    o, h, l, cl = (F.col(k) for k in ("open", "high", "low", "close"))
    rng, body = h - l, F.abs(cl - o)
    up, down = h - F.greatest(o, cl), F.least(o, cl) - l
    return df.withColumns({
        "body_size": div(body, rng), "upper_shadow_ratio": div(up, rng), "lower_shadow_ratio": div(down, rng),
        "doji": F.coalesce(div(body, rng) < 0.1, F.lit(False)).cast("int"),
        "hammer": ((down > 2 * body) & (up < 0.1 * rng)).cast("int")})


def engulfing_gaps(df: DataFrame) -> DataFrame:
    w = ordered()
    o, h, l, cl = (F.col(k) for k in ("open", "high", "low", "close"))
    po, ph, pl, pc = (F.lag(k).over(w) for k in ("open", "high", "low", "close"))
    flag = lambda e: F.coalesce(e, F.lit(False)).cast("int")
    return df.withColumns({
        "bullish_engulfing": flag((cl > o) & (pc < po) & (cl > po) & (o < pc)),
        "bearish_engulfing": flag((cl < o) & (pc > po) & (cl < po) & (o > pc)),
        "gap_up": flag(o > ph), "gap_down": flag(o < pl)})


def higher_moments(df: DataFrame, periods=(10, 20, 50), value="ret") -> DataFrame:
    df = window_moments(df, value, {f"_hm{n}": trailing(n) for n in periods})
    out = {}
    for n in periods:
        out |= {f"skewness_{n}": full(n, value, F.col(f"_hm{n}_skew")), f"kurtosis_{n}": full(n, value, F.col(f"_hm{n}_kurt"))}
    return df.withColumns(out).drop(*[f"_hm{n}_{k}" for n in periods for k in ("skew", "kurt")])


def _quantile(ranked: np.ndarray, p: float) -> np.ndarray:
    """Linearly interpolated quantile of each ascending row."""
    place = p * (ranked.shape[1] - 1)
    a, b = ranked[:, math.floor(place)], ranked[:, math.ceil(place)]
    return np.where(a == b, a, (math.floor(place) + 1 - place) * a + (place - math.floor(place)) * b)


def _tails(df: DataFrame, periods, levels, means: bool) -> DataFrame:
    tags = [f"{int(round(p * 100))}_{n}" for n in periods for p in levels]

    def tails(x: np.ndarray) -> list[np.ndarray]:
        quantiles, beyond = [], []
        for n in periods:
            at, w = full_windows(x, n)
            w = np.sort(w, axis=1)
            for p in levels:
                q = _quantile(w, p)
                quantiles.append(placed(len(x), at, q))
                if means:
                    tail = w <= q[:, None]
                    beyond.append(placed(len(x), at, np.where(tail, w, 0.0).sum(axis=1) / np.maximum(tail.sum(axis=1), 1)))
        return quantiles + beyond

    return per_series(df, ["ret"], [f"var_{t}" for t in tags] + ([f"cvar_{t}" for t in tags] if means else []), tails)


def var_quantile(df: DataFrame, periods=(20, 50), levels=(0.05, 0.01)) -> DataFrame:
    return _tails(df, periods, levels, False)


def cvar(df: DataFrame, periods=(20, 50), levels=(0.05, 0.01)) -> DataFrame:
    """Mean of the window values at or below the window quantile."""
    return _tails(df, periods, levels, True)


def autocorr(df: DataFrame, n=50, lags=(1, 5, 10), value="ret") -> DataFrame:
    """Autocorrelation of the pairs that lie inside the last n rows."""
    def one(x: np.ndarray) -> list[np.ndarray]:
        at, w = full_windows(x, n)
        out = []
        for k in lags:
            a, b = centred(w[:, k:]), centred(w[:, :n - k])
            scale = np.sqrt((a * a).mean(axis=1)) * np.sqrt((b * b).mean(axis=1))
            out.append(placed(len(x), at, (a * b).mean(axis=1) / np.where(scale > 0, scale, np.nan)))
        return out

    return per_series(df, [value], [f"autocorr_lag_{k}" for k in lags], one)


def hurst(df: DataFrame, n=100, max_lag=20, value="ret") -> DataFrame:
    """Simplified Hurst exponent: slope of log sqrt(std(x[i+l]-x[i])) on log l, doubled."""
    lags = list(range(2, max_lag))
    lx = [math.log(k) for k in lags]
    mx = sum(lx) / len(lx)
    sxx = sum((v - mx) ** 2 for v in lx)

    def one(x: np.ndarray) -> list[np.ndarray]:
        at, w = full_windows(x, n)
        slope = np.zeros(len(at))
        for k, lag in zip(lags, lx):
            d = centred(w[:, k:] - w[:, :n - k])
            spread = np.sqrt((d * d).mean(axis=1))
            slope += np.log(np.where(spread > 0, spread, np.nan)) / 2 * ((lag - mx) / sxx)
        return [placed(len(x), at, 2.0 * slope)]

    return per_series(df, [value], ["hurst"], one)


def hl_spread(df: DataFrame, n=20) -> DataFrame:
    df = df.withColumn("hl_spread", div(F.col("high") - F.col("low"), "close"))
    return df.withColumn("hl_spread_ma", roll(F.avg, "hl_spread", n))


def amihud(df: DataFrame, n=20) -> DataFrame:
    df = df.withColumn("amihud", div(F.abs("ret"), F.col("volume") * F.col("close")))
    return df.withColumns({"amihud_ma": roll(F.avg, "amihud", n),
                           "price_impact": F.col("ret") / (F.col("volume") + 1e-8),
                           "volume_cv": div(roll(F.stddev_samp, "volume", n), roll(F.avg, "volume", n))})


def roll_spread(df: DataFrame, n=20) -> DataFrame:
    """Published effective-spread estimator 2*sqrt(-cov(r_t, r_{t-1}))."""
    df = df.withColumn("_p", F.lag("ret").over(ordered()))
    cov = full(n, "_p", F.covar_samp("ret", "_p").over(trailing(n)))
    return df.withColumn("roll_spread", 2 * F.sqrt(-F.least(cov, F.lit(0.0)) + 0.0 * cov)).drop("_p")


def close_position(df: DataFrame) -> DataFrame:
    return df.withColumns({"close_position": div(F.col("close") - F.col("low"), F.col("high") - F.col("low")),
                           "high_low_ratio": div("high", "low")})


def _frame(window: int | None):
    return trailing(window) if window else expanding()


def zscore_roll(df: DataFrame, value="ret", window: int | None = None, least=10, out="zscore") -> DataFrame:
    w = _frame(window)
    return df.withColumn(out, F.when(F.count(value).over(w) >= least, div(
        F.col(value) - F.avg(value).over(w), F.stddev_samp(value).over(w))))


def minmax_roll(df: DataFrame, value="ret", window: int | None = None, least=10, out="minmax") -> DataFrame:
    w = _frame(window)
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    return df.withColumn(out, F.when(F.count(value).over(w) >= least, div(F.col(value) - lo, hi - lo)))


def robust_roll(df: DataFrame, value="ret", window: int | None = None, least=10, out="robust") -> DataFrame:
    """(x - median) / median absolute deviation over a trailing or expanding frame; null below ``least`` values.

    A symbol's calendar is one task's group; its windows share one index of order statistics (n log n), so no row carries its window.
    """
    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by([("date", "ascending")])
        column = table.column(value).combine_chunks().cast(pa.float64())
        known = ~np.asarray(column.is_null())
        x = column.drop_null().to_numpy()
        count = np.concatenate([[0], np.cumsum(known)])
        i = np.flatnonzero(known)
        lo, hi = count[np.maximum(0, i + 1 - window) if window else np.zeros_like(i)], count[i + 1]
        enough = hi - lo >= least
        result = np.full(len(known), np.nan)
        if enough.any():
            m, spread = median_and_deviation(x, lo[enough], hi[enough])
            result[i[enough]] = np.where(spread > 0, (x[enough] - m) / np.where(spread > 0, spread, 1), np.nan)
        return table.append_column(out, pa.array(result, mask=np.isnan(result)))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.groupBy("symbol").applyInArrow(one, f"{fields}, `{out}` double")


def mean_reversion(df: DataFrame, periods=(5, 10)) -> DataFrame:
    return df.withColumns({f"mean_reversion_{n}": -div(F.col("ret") - roll(F.avg, "ret", n), roll(F.stddev_samp, "ret", n))
                           for n in periods})


def rolling_rank(df: DataFrame, periods=(10, 20)) -> DataFrame:
    """Average percentile rank of a rolling mean inside its own trailing window."""
    df = df.withColumns({f"_m_{n}": roll(F.avg, "ret", n) for n in periods})
    df = df.withColumns({f"_l_{n}": F.collect_list(f"_m_{n}").over(trailing(n)) for n in periods})
    out = {}
    for n in periods:
        m, l = F.col(f"_m_{n}"), F.col(f"_l_{n}")
        below = F.size(_keep_where(l, lambda v, m: v < m, m))
        ties = F.size(_keep_where(l, lambda v, m: v == m, m))
        out[f"percentile_rank_{n}"] = F.when(F.size(l) == n, (below + (ties + 1) / 2.0) / F.size(l))
    return df.withColumns(out).drop(*[f"_{k}_{n}" for k in "ml" for n in periods])


def drawdown(df: DataFrame, key="symbol", time="date", value="ret") -> DataFrame:
    """Cumulative wealth, running peak and drawdown; a missing return counts as zero, a total loss ends in wealth 0 for good."""
    w = expanding(key, time)
    df = df.withColumn("wealth", F.exp(F.sum(log_growth(F.coalesce(F.col(value), F.lit(0.0)))).over(w)))
    df = df.withColumn("peak", F.max("wealth").over(w))
    return df.withColumn("drawdown", F.coalesce(div("wealth", "peak"), F.lit(0.0)) - 1)


def drawdown_periods(df: DataFrame, key="symbol", time="date", value="ret") -> DataFrame:
    """One row per drawdown: start, end, depth and length. Gaps-and-islands on the sign."""
    dd = drawdown(df, key, time, value)
    under = F.col("drawdown") < -1e-12
    dd = dd.withColumn("_u", under)
    start = F.when(F.col("_u") & ~F.coalesce(F.lag("_u").over(ordered(key, time)), F.lit(False)), 1).otherwise(0)
    dd = dd.withColumn("_s", start)
    dd = dd.withColumn("island", F.sum("_s").over(expanding(key, time)))
    return (dd.where("_u").groupBy(key, "island").agg(
        F.min(time).alias("start"), F.max(time).alias("end"), F.min("drawdown").alias("depth"),
        F.count(F.lit(1)).alias("rows"))
        .withColumn("days", F.date_diff("end", "start")))


def forward_return(df: DataFrame, k=1) -> DataFrame:
    return df.withColumn(f"fwd_ret_{k}", F.lead("ret", k).over(ordered()))


def history_rank(df: DataFrame, value: str, out: str) -> DataFrame:
    """Average percentile rank of a value within its own symbol's whole history, later rows included (calendar-bounded)."""
    w = Window.partitionBy("symbol")
    r = F.rank().over(w.orderBy(value))
    ties = F.count(value).over(Window.partitionBy("symbol", value))
    n = F.count(value).over(w)
    nulls = F.count(F.lit(1)).over(w) - n
    # ascending order puts nulls first
    return df.withColumn(out, F.when(F.col(value).isNotNull(), (r - nulls + (ties - 1) / 2.0) / n))
