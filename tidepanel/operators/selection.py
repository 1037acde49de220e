"""Feature selection and scaling over whole tables."""
from __future__ import annotations

import numpy as np
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidepanel.core.frames import attach, corr, div
from tidepanel.core.ordering import grouped_quantiles, positions
from tidepanel.operators.sets import top


def univariate(df: DataFrame, features: list[str], target: str, k: int) -> DataFrame:
    """k best features by the F statistic of a simple regression: r^2 / (1 - r^2) * (n - 2), one pass."""
    aggs = [corr(f, target).alias(f) for f in features]
    row = df.agg(F.count(target).alias("_n"), *aggs)
    r = F.col("e.r")
    long = row.select("_n", F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("r")) for f in features])).alias("e"))
    long = long.select(F.col("e.feature").alias("feature"), (div(r * r, 1 - r * r) * (F.col("_n") - 2)).alias("f_stat"))
    return top(long, k, F.col("f_stat").desc(), F.col("feature"))


def _bin(col: str, cuts: list[float]) -> Column:
    return F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda b: b < F.col(col)))


def mutual_information(df: DataFrame, features: list[str], target: str, bins: int = 8) -> DataFrame:
    """Mutual information of quantile bins (nats): one count per (feature, bin pair)."""
    names = [f"q{i}" for i in range(1, bins)]
    cut = lambda c: list(grouped_quantiles(df, [], c, {n: (i + 1) / bins for i, n in enumerate(names)}).select(*names).first())
    y = _bin(target, cut(target))
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), _bin(f, cut(f)).alias("x")) for f in features])
    n = df.select(y.alias("y"), F.explode(cells).alias("c")).groupBy("c.feature", "c.x", "y").agg(F.count(F.lit(1)).cast("double").alias("n"))
    tot = lambda *k: F.sum("n").over(Window.partitionBy("feature", *k))
    n = n.withColumns({"nx": tot("x"), "ny": tot("y"), "t": tot()})
    return n.groupBy("feature").agg(F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("nx") * F.col("ny")))).alias("mi"))


def pca_ranking(df: DataFrame, features: list[str], k: int) -> DataFrame:
    """Features by mean absolute loading on the first k principal components."""
    v = VectorAssembler(inputCols=features, outputCol="raw").transform(df.na.drop(subset=features))
    x = StandardScaler(inputCol="raw", outputCol="x", withMean=True).fit(v).transform(v)
    load = np.abs(np.asarray(PCA(k=k, inputCol="x", outputCol="pc").fit(x).pc.toArray())).mean(axis=1)
    rows = [(f, float(s)) for f, s in zip(features, load)]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double").orderBy(F.col("importance").desc(), "feature")


def standard(df: DataFrame, cols: list[str]) -> DataFrame:
    """(x - mean) / population deviation over the whole table (statistics are one row)."""
    s = df.agg(*[f(c).alias(f"_{t}_{c}") for c in cols for f, t in ((F.avg, "m"), (F.stddev_pop, "s"))])
    return attach(df, s).withColumns({f"{c}_standard": div(F.col(c) - F.col(f"_m_{c}"), f"_s_{c}") for c in cols}).drop(*s.columns)


def robust(df: DataFrame, cols: list[str], base: DataFrame | None = None) -> DataFrame:
    """(x - median) / interquartile range with exact split-range quantiles; ``base`` is a stored table of the same values."""
    for c in cols:
        q = grouped_quantiles(df if base is None else base, [], c, {"_a": 0.25, "_m": 0.5, "_b": 0.75}, stage=base is None).drop("n")
        df = attach(df, q).withColumn(f"{c}_robust", div(F.col(c) - F.col("_m"), F.col("_b") - F.col("_a"))).drop("_a", "_m", "_b")
    return df


def quantile_uniform(df: DataFrame, col: str, base: DataFrame | None = None) -> DataFrame:
    """Average rank mapped to [0, 1]; ``base`` is a stored table of the same values."""
    p = positions(df if base is None else base, [], col)
    u = (F.col("below") + (F.col("cnt") - 1) / 2.0) / F.nullif(F.col("n") - 1, F.lit(0))
    return df.join(p.select(col, u.alias(f"{col}_uniform")), col, "left")


# fixed values: Wichura, algorithm AS 241 (1988), rational approximations of the normal quantile, highest power first;
# the centre in 0.180625 - (p - 0.5)^2, the sides in sqrt(-ln(min(p, 1 - p))) - 1.6
CENTRE = ([2509.0809287301226727, 33430.575583588128105, 67265.770927008700853, 45921.953931549871457, 13731.693765509461125, 1971.5909503065514427, 133.14166789178437745, 3.387132872796366608],
          [5226.495278852854561, 28729.085735721942674, 39307.89580009271061, 21213.794301586595867, 5394.1960214247511077, 687.1870074920579083, 42.313330701600911252, 1.0])
SIDES = ([7.7454501427834140764e-4, 0.0227238449892691845833, 0.24178072517745061177, 1.27045825245236838258, 3.64784832476320460504, 5.7694972214606914055, 4.6303378461565452959, 1.42343711074968357734],
         [1.05075007164441684324e-9, 5.475938084995344946e-4, 0.0151986665636164571966, 0.14810397642748007459, 0.68976733498510000455, 1.6763848301838038494, 2.05319162663775882187, 1.0])


def _polynomial(x: Column, coefficients: list[float]) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def normal_score(p: Column, edge: float = 1e-7) -> Column:
    """Inverse normal of a probability, kept ``edge`` away from 0 and 1; exact to 1e-14 relative."""
    p = F.least(F.greatest(p, F.lit(edge)), F.lit(1 - edge))
    q = p - 0.5
    r = 0.180625 - q * q
    s = F.sqrt(-F.log(F.least(p, 1 - p))) - 1.6
    side = _polynomial(s, SIDES[0]) / _polynomial(s, SIDES[1])
    return F.when(F.abs(q) <= 0.425, q * _polynomial(r, CENTRE[0]) / _polynomial(r, CENTRE[1])).when(q < 0, -side).otherwise(side)
