"""Per-date features across symbols.

Ranks go through the split-range rank, so a date with very many symbols is
never sorted in one task; means and deviations are partial aggregates joined back. A caller that
knows that no date has more than ``most`` rows passes that: up to the limit of the ranks all of them are windows of
one exchange by date.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from tidepanel.core.frames import div, full, roll
from tidepanel.core.ordering import LIMIT, grouped_rank


def cs_rank(df: DataFrame, value: str, out: str | None = None, time="date", base: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """Percentile rank per date, lowest rank for ties; null stays null."""
    return grouped_rank(df, [time], value, out or f"{value}_cs_rank", "min", base=base, most=most)


def sector_rank(df: DataFrame, value: str, sector="sector", out: str | None = None, time="date", base: DataFrame | None = None,
                most: int | None = None) -> DataFrame:
    return grouped_rank(df, [sector, time], value, out or f"{value}_sector_rank", "average", base=base, most=most)


def cs_zscore(df: DataFrame, value: str, out: str | None = None, time="date", base: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """(x - mean) / sd per date, 0 where the spread is zero or undefined."""
    out = out or f"{value}_cs_zscore"
    z = F.when(F.col("_s") > 0, (F.col(value) - F.col("_m")) / F.col("_s")).otherwise(0.0)
    mean, spread = F.avg(value), F.stddev_samp(value)
    if most is not None and most <= LIMIT:
        w = Window.partitionBy(time)
        return df.withColumns({"_m": mean.over(w), "_s": spread.over(w)}).withColumn(out, z).drop("_m", "_s")
    stat = (base if base is not None else df).groupBy(time).agg(mean.alias("_m"), spread.alias("_s"))
    return df.join(stat, time).withColumn(out, z).drop("_m", "_s")


def relative_strength(df: DataFrame, periods=(10, 20, 50)) -> DataFrame:
    """Rolling mean return of a symbol minus the rolling mean of the universe's daily mean."""
    daily = df.groupBy("date").agg(F.avg("ret").alias("_u")).withColumn("_k", F.lit(0))
    daily = daily.withColumns({f"_u_{n}": roll(F.avg, "_u", n, "_k") for n in periods}).drop("_u", "_k")
    df = df.withColumns({f"_a_{n}": roll(F.avg, "ret", n) for n in periods})
    out = df.join(daily, "date").withColumns({
        f"relative_strength_{n}": F.col(f"_a_{n}") - F.col(f"_u_{n}") for n in periods})
    return out.drop(*[f"_{k}_{n}" for k in "ua" for n in periods])


def rolling_ic(df: DataFrame, features: list[str], target: str, key="series", time="date", lookback=252,
               min_ic=0.02, min_obs=10) -> DataFrame:
    """Mean, deviation and stability of the rolling rank correlation of each feature with ``target``.

    Ranks differ per window, so each (key, feature) history - calendar-bounded - is one
    grouped-map task working on sliding windows in blocks.
    """
    long = df.select(key, time, target, *features).unpivot([key, time, target], features, "feature", "value")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(time)
        x, y = pdf["value"].to_numpy(float), pdf[target].to_numpy(float)
        bad = np.isnan(x) | np.isnan(y)
        x, y = np.where(bad, np.nan, x), np.where(bad, np.nan, y)
        total = max(len(x) - lookback, 0)
        ics = []
        for a in range(0, total, 1024):
            b = min(a + 1024, total)
            wx = np.lib.stride_tricks.sliding_window_view(x, lookback)[a:b]
            wy = np.lib.stride_tricks.sliding_window_view(y, lookback)[a:b]
            rx = pd.DataFrame(wx).rank(axis=1).to_numpy()
            ry = pd.DataFrame(wy).rank(axis=1).to_numpy()
            n = (~np.isnan(rx)).sum(axis=1)
            dx = rx - np.nansum(rx, axis=1, keepdims=True) / np.maximum(n, 1)[:, None]
            dy = ry - np.nansum(ry, axis=1, keepdims=True) / np.maximum(n, 1)[:, None]
            den = np.sqrt(np.nansum(dx * dx, axis=1) * np.nansum(dy * dy, axis=1))
            ok = (n > min_obs) & (den > 0)
            ics.append(np.nansum(dx * dy, axis=1)[ok] / den[ok])
        ic = np.concatenate(ics) if ics else np.array([])
        head = {key: pdf[key].iloc[0], "feature": pdf["feature"].iloc[0], "windows": len(ic)}
        if not len(ic):
            return pd.DataFrame([head | {"ic_mean": None, "ic_std": None, "stability": None, "selected": False}])
        m, s = ic.mean(), ic.std()
        stab = abs(m) / (s + 1e-8)
        return pd.DataFrame([head | {"ic_mean": m, "ic_std": s, "stability": stab,
                                     "selected": bool(abs(m) >= min_ic and stab > 1.0)}])

    kind = df.schema[key].dataType.simpleString()
    return long.groupBy(key, "feature").applyInPandas(
        one, f"{key} {kind}, feature string, windows bigint, ic_mean double, ic_std double, stability double, selected boolean")
