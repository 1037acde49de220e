"""Regime labels that need a fit: Gaussian mixtures, threshold autoregression, sliding break tests."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from tidepanel.core.frames import div, ordered, whole
from tidepanel.functions.moments import argmax, kolmogorov_tail
from tidepanel.models import mixtures
from tidepanel.operators.regimes import smooth_centered

KEY, TIME = "series", "date"


def gmm(df: DataFrame, features: list[str], k: int = 3, rounds: int = mixtures.ROUNDS, key=KEY, time=TIME, fitted: DataFrame | None = None) -> DataFrame:
    """Mixture probabilities, one mixture per key (components ordered by variance), smoothed, with the most likely regime."""
    fitted = mixtures.fit(df, features, k, rounds, key) if fitted is None else fitted
    out = smooth_centered(mixtures.probabilities(df, fitted, features, k, key, (time,)), "probs", k, 2, (key,), time)
    return out.withColumn("regime", argmax(F.col("probs")))


def gmm_criteria(df: DataFrame, features: list[str], k: int = 3, rounds: int = mixtures.ROUNDS, key=KEY, fitted: DataFrame | None = None) -> DataFrame:
    """Parameter count, AIC, BIC and per-component weight, mean and covariance of each key's mixture."""
    fitted = mixtures.fit(df, features, k, rounds, key) if fitted is None else fitted
    return mixtures.criteria(df, fitted, features, k, key)


def break_statistics(breaks: DataFrame, rows: DataFrame, key=KEY) -> DataFrame:
    """(key, n_breaks, regime_lengths): rows of each stretch between the breaks of a key, keys without breaks included."""
    n = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    at = breaks.groupBy(key).agg(F.array_sort(F.collect_list("position")).alias("at"))
    j = n.join(at, key, "left").withColumn("at", F.coalesce("at", F.array().cast("array<bigint>")))
    ends, starts = F.concat("at", F.array("n")), F.concat(F.array(F.lit(0).cast("long")), "at")
    return j.select(key, F.size("at").alias("n_breaks"), F.zip_with(ends, starts, lambda a, b: a - b).alias("regime_lengths"))


def tvar_grid(df: DataFrame, value="ret", by="vol", points=20, key=KEY, time=TIME) -> DataFrame:
    """Two-regime AR(2): mean AIC of both sides for each grid threshold, one pass of grouped sums."""
    w = ordered(key, time)
    d = df.withColumns({"_x1": F.lag(value, 1).over(w), "_x2": F.lag(value, 2).over(w)})
    d = d.where(" and ".join(f"{c} is not null" for c in (value, by, "_x1", "_x2")))
    at = [float(v) / 100 for v in np.linspace(10, 90, points)]
    grid = F.percentile(by, F.array(*[F.lit(p) for p in at])).over(whole(key))
    # a fixed fan-out of `points` rows per input row, reduced by the partial aggregate right after
    d = d.withColumn("_g", grid).select(key, F.col(value).alias("y"), "_x1", "_x2", F.col(by).alias("_v"), F.posexplode("_g").alias("point", "threshold"))
    d = d.groupBy(key, "point", "threshold", (F.col("_v") > F.col("threshold")).alias("high")).agg(
        F.count(F.lit(1)).alias("n"), F.var_pop("y").alias("yy"), F.var_pop("_x1").alias("aa"), F.var_pop("_x2").alias("bb"),
        F.covar_pop("_x1", "_x2").alias("ab"), F.covar_pop("y", "_x1").alias("ya"), F.covar_pop("y", "_x2").alias("yb"))
    c = F.col
    det = c("aa") * c("bb") - c("ab") * c("ab")
    explained = div(c("ya") * c("ya") * c("bb") - 2 * c("ya") * c("yb") * c("ab") + c("yb") * c("yb") * c("aa"), det)
    d = d.where(c("n") > 12).withColumn("aic", F.log(c("yy") - explained) + 2 * 3.0 / c("n"))
    return d.groupBy(key, "point", "threshold").agg(F.avg("aic").alias("aic"), F.count(F.lit(1)).alias("sides"),
                                                    F.sum(F.when(~c("high"), c("n"))).alias("n_low"), F.sum(F.when(c("high"), c("n"))).alias("n_high"))


def tvar_best(grid: DataFrame, key=KEY) -> DataFrame:
    return grid.groupBy(key).agg(F.min_by(F.struct("threshold", "aic", "n_low", "n_high"), F.struct("aic", "point")).alias("r")).select(key, "r.*")


def break_windows(df: DataFrame, value="close", half: int | None = None, key=KEY, time=TIME) -> DataFrame:
    """Trend-CUSUM statistic of the 2*half rows (default: max(50, n // 10)) around every position of each series.

    A series is calendar-bounded; windows are processed as strided blocks inside its task.
    """
    kind = df.schema[key].dataType.simpleString()

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(time)
        y = pdf[value].to_numpy(float)
        h = half or max(50, len(y) // 10)
        size = 2 * h
        t = np.arange(size) - (size - 1) / 2.0
        out = []
        centres = np.arange(h, len(y) - h)
        for a in range(0, len(centres), 1024):
            c = centres[a:a + 1024]
            win = np.lib.stride_tricks.sliding_window_view(y, size)[c - h]
            win = win - win.mean(axis=1, keepdims=True)
            resid = win - np.outer(win @ t / (t @ t), t)
            path = np.cumsum(resid, axis=1) / np.sqrt(np.sum(resid ** 2, axis=1, keepdims=True))
            out.append(pd.DataFrame({key: pdf[key].iloc[0], time: pdf[time].to_numpy()[c], "position": c,
                                     "statistic": np.abs(path).max(axis=1)}))
        return pd.concat(out) if out else pd.DataFrame({key: [], time: [], "position": [], "statistic": []})

    out = df.select(key, time, value).where(F.col(value).isNotNull()).groupBy(key).applyInPandas(
        one, f"{key} {kind}, {time} timestamp, position long, statistic double")
    return out.withColumn("p_value", kolmogorov_tail(F.col("statistic")))


def spaced_breaks(windows: DataFrame, level=0.05, gap=20, key=KEY, time=TIME) -> DataFrame:
    """Significant positions thinned so that kept ones lie more than ``gap`` rows apart, first come first kept."""
    sig = windows.where(F.col("p_value") < level).groupBy(key).agg(F.array_sort(F.collect_list("position")).alias("c"))
    keep = F.aggregate("c", F.array().cast("array<bigint>"),
                       lambda acc, v: F.when((F.size(acc) == 0) | (v - F.element_at(acc, -1) > gap), F.concat(acc, F.array(v))).otherwise(acc))
    kept = sig.select(key, F.explode(keep).alias("position"))
    return kept.join(windows.select(key, "position", time, "statistic"), [key, "position"])


def break_states(df: DataFrame, breaks: DataFrame, n: int = 3, key=KEY, time=TIME) -> DataFrame:
    """Regime = number of breaks so far, at most n-1; a break belongs to the stretch it opens."""
    flag = breaks.select(key, time, F.lit(1).alias("_b"))
    d = df.join(flag, [key, time], "left")
    total = F.sum(F.coalesce("_b", F.lit(0))).over(ordered(key, time).rowsBetween(Window.unboundedPreceding, 0))
    return d.withColumn("regime", F.least(total, F.lit(n - 1)).cast("int")).drop("_b")
