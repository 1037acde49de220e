"""Measures over the history of regime probabilities, as plain windows."""
from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from tidepanel.core.frames import corr, div, full, ordered, roll, trailing
from tidepanel.functions.moments import argmax, entropy, window_moments


def buffer_features(points: DataFrame, n=252, least=10, key="symbol", time="date") -> DataFrame:
    """Feature vector of the last n returns and volumes, once ``least`` returns exist."""
    d = points.withColumn("ret", div("price", F.lag("price").over(ordered(key, time))) - 1)
    d = d.withColumn("_v", F.when(F.col("ret").isNotNull(), F.col("volume")))
    w = trailing(n, key, time)
    ok = lambda e: F.when(F.count("ret").over(w) >= least, e)
    d = window_moments(d, "ret", {"_b": w})
    return d.withColumns({"f_mean": ok(F.avg("ret").over(w)), "f_std": ok(F.stddev_samp("ret").over(w)), "f_skew": ok(F.col("_b_skew")),
                          "f_kurt": ok(F.col("_b_kurt")), "f_volume": ok(F.avg("_v").over(w)), "f_volatility": ok(F.avg(F.abs("ret")).over(w))}).drop("_v", "_b_skew", "_b_kurt")


def transition_alerts(history: DataFrame, level=0.8, key="series", time="date") -> DataFrame:
    """Rows whose largest probability change exceeds the level, with the regimes left and entered."""
    w = ordered(key, time)
    d = history.withColumns({"_p": F.lag("probs").over(w)}).where("_p is not null")
    change = F.array_max(F.zip_with("probs", "_p", lambda a, b: F.abs(a - b)))
    d = d.select(key, time, argmax(F.col("_p")).alias("from_regime"), argmax(F.col("probs")).alias("to_regime"), change.alias("change"))
    return d.where(F.col("change") > level)


def stability(history: DataFrame, n=3, window=20, key="series", time="date") -> DataFrame:
    """Consistency, probability deviation and entropy over the last ``window`` rows."""
    d = history.withColumns({"_m": argmax(F.col("probs")), "_h": entropy(F.col("probs"))})
    d = d.withColumn("_c", F.when(F.col("_m") != F.lag("_m").over(ordered(key, time)), 1.0).otherwise(0.0))
    w, w1 = trailing(window, key, time), trailing(window - 1, key, time)
    ok = lambda e: F.when(F.count(F.lit(1)).over(w) == window, e)
    vols = [F.stddev_pop(F.col("probs")[i]).over(w) for i in range(n)]
    return d.select(key, time, ok(1 - F.sum("_c").over(w1) / (window - 1.0)).alias("consistency"), ok(sum(vols[1:], vols[0]) / n).alias("avg_probability_volatility"),
                    ok(F.avg("_h").over(w)).alias("avg_entropy"), ok(F.stddev_pop("_h").over(w)).alias("entropy_volatility"))


# fixed values: alert thresholds of the four stress indicators
STRESS = {"probability_volatility": 0.3, "uncertainty": 0.8, "transition_frequency": 0.5, "feature_drift": 2.0}


def stress(history: DataFrame, features: list[str], n=3, window=10, key="series", time="date") -> DataFrame:
    """Four stress levels and their alert flags over the last ``window`` rows."""
    d = history.withColumns({"_m": argmax(F.col("probs")), "_h": entropy(F.col("probs"))})
    d = d.withColumn("_c", F.when(F.col("_m") != F.lag("_m").over(ordered(key, time)), 1.0).otherwise(0.0))
    w, w1 = trailing(window, key, time), trailing(window - 1, key, time)
    half = window // 2
    new, old = ordered(key, time).rowsBetween(-(half - 1), 0), ordered(key, time).rowsBetween(-(window - 1), -half)
    sq = [F.pow(F.avg(f).over(new) - F.avg(f).over(old), 2) for f in features]
    level = {"probability_volatility": F.greatest(*[F.stddev_pop(F.col("probs")[i]).over(w) for i in range(n)]),
             "uncertainty": F.avg("_h").over(w) / math.log(n), "transition_frequency": F.sum("_c").over(w1) / (window - 1.0),
             "feature_drift": F.sqrt(sum(sq[1:], sq[0]))}
    d = d.withColumns({k: F.when(F.count(F.lit(1)).over(w) == window, e) for k, e in level.items()})
    return d.select(key, time, *level, *[F.coalesce(F.col(k) > t, F.lit(False)).alias(f"{k}_alert") for k, t in STRESS.items()])


def trend_warnings(history: DataFrame, n=3, window=5, key="series", time="date") -> DataFrame:
    """Strong upward probability trends: slope > 0.1, r > 0.7, p < 0.1 (|t| > 2.3534 with three degrees of freedom)."""
    d = history.withColumn("_i", F.row_number().over(ordered(key, time)).cast("double"))
    long = d.select(key, time, "_i", F.posexplode("probs").alias("regime", "p"))
    w = trailing(window, [key, "regime"], time)
    long = long.withColumns({"slope": full(window, "p", F.regr_slope("p", "_i").over(w), [key, "regime"], time), "r": full(window, "p", corr("p", "_i", w), [key, "regime"], time)})
    r2 = F.col("r") * F.col("r")
    t_ok = F.when(r2 >= 1 - 1e-12, True).otherwise(F.abs("r") * F.sqrt(F.lit(window - 2.0)) > 2.3534 * F.sqrt(F.greatest(1 - r2, F.lit(0.0))))
    return long.where((F.col("slope") > 0.1) & (F.col("r") > 0.7) & t_ok).select(key, time, "regime", "slope", r2.alias("r_squared"))


def early_warnings(history: DataFrame, features: list[str], n=3, key="series", time="date") -> DataFrame:
    """Stress alerts and trend warnings as (key, time, indicator, level, severity) rows."""
    s = stress(history, features, n, key=key, time=time)
    rows = F.array(*[F.struct(F.lit(k).alias("indicator"), F.col(k).alias("level"), F.col(f"{k}_alert").alias("alert")) for k in STRESS])
    a = s.select(key, time, F.explode(rows).alias("e")).where("e.alert").select(key, time, "e.indicator", "e.level", F.when(F.col("e.level") > 0.8, "high").otherwise("medium").alias("severity"))
    t = trend_warnings(history, n, key=key, time=time).select(key, time, F.concat(F.lit("trend_"), "regime").alias("indicator"), F.col("slope").alias("level"), F.lit("medium").alias("severity"))
    return a.unionByName(t)


def status(history: DataFrame, alerts: DataFrame, warnings: DataFrame, key="series", time="date") -> DataFrame:
    """Latest regime and confidence with alert and warning counts per key."""
    h = history.groupBy(key).agg(F.count(F.lit(1)).alias("updates"), F.max(time).alias("last_update"), F.max_by(F.col("probs"), time).alias("_p"))
    h = h.withColumns({"current_regime": argmax(F.col("_p")), "confidence": F.array_max("_p")}).drop("_p")
    count = lambda d, n: d.groupBy(key).agg(F.count(F.lit(1)).alias(n))
    return h.join(count(alerts, "alerts"), key, "left").join(count(warnings, "warnings"), key, "left").na.fill(0, ["alerts", "warnings"])
