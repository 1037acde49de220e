"""Macro-series transforms. Series are monthly or quarterly, so windows are tiny and keyed by indicator."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidepanel.core.frames import attach, change, div, expanding, ordered, roll


def derived(long: DataFrame) -> DataFrame:
    """Period, quarterly and yearly changes, first difference and 20-period volatility per indicator."""
    k = "indicator"
    df = long.withColumns({"mom": change("value", 1, k), "qoq": change("value", 4, k), "yoy": change("value", 12, k),
                           "diff": F.col("value") - F.lag("value").over(ordered(k))})
    return df.withColumn("vol_20", roll(F.stddev_samp, "mom", 20, k))


def spreads(wide: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Differences of columns, e.g. long minus short rates or small minus large caps."""
    return wide.withColumns({n: F.col(a) - F.col(b) for n, (a, b) in pairs.items()})


def gap(wide: DataFrame, actual: str, potential: str, out="output_gap") -> DataFrame:
    return wide.withColumn(out, 100 * div(F.col(actual) - F.col(potential), potential))


def features(wide: DataFrame, growth: str, long_rate: str, short_rate: str, inflation: str,
             conditions: list[str], momentum: list[str], time="date", full_sample: bool = False) -> DataFrame:
    """Growth trend and cycle, curve slope, inflation trend and volatility, conditions index, momentum.

    The conditions index averages z-scores by the moments known at each date; ``full_sample`` uses those of the
    whole history, later dates included.
    """
    df = wide.withColumn("_k", F.lit(0))
    df = df.withColumns({"growth_trend": roll(F.avg, growth, 4, "_k", time),
                         "curve_slope": F.col(long_rate) - F.col(short_rate),
                         "inflation_trend": roll(F.avg, inflation, 6, "_k", time),
                         "inflation_volatility": roll(F.stddev_samp, inflation, 12, "_k", time),
                         **{f"_c_{c}": F.last(c, ignorenulls=True).over(expanding("_k", time)) for c in conditions},
                         **{f"{c}_momentum_{n}": change(c, n, "_k", time) for c in momentum for n in (3, 6)}})
    df = df.withColumn("growth_cycle", F.col(growth) - F.col("growth_trend"))
    names = [f"_c_{c}" for c in conditions]
    if full_sample:
        stat = df.groupBy("_k").agg(*[f(n).alias(f"{n}{t}") for n in names for f, t in ((F.avg, "m"), (F.stddev_samp, "s"))])
        df = attach(df, stat.drop("_k"))
    else:
        w = expanding("_k", time)
        df = df.withColumns({f"{n}{t}": f(n).over(w) for n in names for f, t in ((F.avg, "m"), (F.stddev_samp, "s"))})
    z = [div(F.col(n) - F.col(f"{n}m"), f"{n}s") for n in names]
    count = sum((F.when(e.isNotNull(), 1.0).otherwise(0.0) for e in z[1:]), F.when(z[0].isNotNull(), 1.0).otherwise(0.0))
    total = sum((F.coalesce(e, F.lit(0.0)) for e in z[1:]), F.coalesce(z[0], F.lit(0.0)))
    df = df.withColumn("financial_conditions_index", div(total, count))
    return df.drop("_k", *names, *[f"{n}{t}" for n in names for t in "ms"])


def regime_indicators(wide: DataFrame, slope: str, vol: str, level: float = 0.75) -> DataFrame:
    """Recession flag (negative slope) and high-volatility flag (above the quantile)."""
    df = attach(wide, wide.agg(F.percentile(vol, F.lit(level)).alias("_q")))
    return df.withColumns({"recession_signal": F.coalesce(F.col(slope) < 0, F.lit(False)).cast("int"),
                           "high_volatility_regime": F.coalesce(F.col(vol) > F.col("_q"), F.lit(False)).cast("int")}).drop("_q")
