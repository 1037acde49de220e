"""Price cleaning, gap filling, corporate actions, calendars and history filters."""
from __future__ import annotations

from pyspark.ml.feature import Imputer
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidepanel.core.frames import ahead, attach, div, expanding, no_inf, ordered, whole

PRICES = ("open", "high", "low", "close")


def clean_prices(df: DataFrame, cols=PRICES, limit=0.5) -> DataFrame:
    """Drop all-null rows, null out negative prices, flag moves beyond ``limit``."""
    df = df.na.drop("all", subset=list(cols))
    df = df.withColumns({c: F.when(F.col(c) >= 0, F.col(c)) for c in cols})
    move = div("close", F.lag("close").over(ordered())) - 1
    return df.withColumn("extreme_move", F.coalesce(F.abs(move) > limit, F.lit(False)))


def ffill(df: DataFrame, cols, max_gap: int | None = None, key="symbol", time="date") -> DataFrame:
    """Last known value forward; beyond ``max_gap`` missing rows the cell stays null."""
    w = expanding(key, time)
    pos = F.row_number().over(ordered(key, time))
    if max_gap is None:
        return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in cols})
    df = df.withColumn("_i", pos)
    out = {}
    for c in cols:
        seen = F.max(F.when(F.col(c).isNotNull(), F.col("_i"))).over(w)
        out[c] = F.when(F.col("_i") - seen <= max_gap, F.last(c, ignorenulls=True).over(w))
    return df.withColumns(out).drop("_i")


def bfill(df: DataFrame, cols, key="symbol", time="date") -> DataFrame:
    w = ahead(key, time)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in cols})


def interpolate(df: DataFrame, cols, limit: int = 10, key="symbol", time="date") -> DataFrame:
    """Linear by row position between the known neighbours, at most ``limit`` rows from either one."""
    df = df.withColumn("_i", F.row_number().over(ordered(key, time)))
    back, fwd = expanding(key, time), ahead(key, time)
    out = {}
    for c in cols:
        known = F.when(F.col(c).isNotNull(), F.col("_i"))
        i0, i1 = F.max(known).over(back), F.min(known).over(fwd)
        v0, v1 = F.last(c, ignorenulls=True).over(back), F.last(c, ignorenulls=True).over(fwd)
        i = F.col("_i")
        near = (i - i0 <= limit) | (i1 - i <= limit)
        out[c] = F.when(F.col(c).isNotNull(), F.col(c)).when(near & i0.isNotNull() & i1.isNotNull(),
                                                            v0 + (v1 - v0) * (i - i0) / (i1 - i0))
    return df.withColumns(out).drop("_i")


def impute_hybrid(df: DataFrame, price_cols=PRICES, other_cols=("volume",), max_gap=5) -> DataFrame:
    """Forward fill for prices, interpolation for the rest."""
    return interpolate(ffill(df, price_cols, max_gap), other_cols)


def impute_median(df: DataFrame, cols) -> DataFrame:
    """Approximate-median imputation over the whole table (mergeable sketch)."""
    return Imputer(strategy="median", inputCols=list(cols), outputCols=list(cols)).fit(df).transform(df)


def inf_to_null(df: DataFrame, cols) -> DataFrame:
    return df.withColumns({c: no_inf(c) for c in cols})


def adjust_splits(df: DataFrame, splits: DataFrame) -> DataFrame:
    """Before each split date multiply prices and divide volume by the ratio.

    Actions per symbol are few; the factor of a date is the product over later splits,
    taken from a reverse running product of the union, not from a range join.
    """
    return _adjust(df, splits, "ratio")


def adjust_dividends(df: DataFrame, dividends: DataFrame) -> DataFrame:
    """Before each ex-date subtract the dividend from prices."""
    return _adjust(df, dividends, "dividend")


def _adjust(df: DataFrame, actions: DataFrame, kind: str) -> DataFrame:
    a = actions.groupBy("symbol", "date").agg((F.product("value") if kind == "ratio" else F.sum("value")).alias("_v"))
    d = df.withColumn("_bar", F.lit(True)).join(a, ["symbol", "date"], "full_outer")
    later = Window.partitionBy("symbol").orderBy(F.col("date").desc()).rowsBetween(Window.unboundedPreceding, -1)
    if kind == "ratio":
        f = F.coalesce(F.product(F.coalesce("_v", F.lit(1.0))).over(later), F.lit(1.0))
        d = d.withColumn("_f", f).withColumns({c: F.col(c) * F.col("_f") for c in PRICES} | {"volume": div("volume", "_f")})
    else:
        f = F.coalesce(F.sum(F.coalesce("_v", F.lit(0.0))).over(later), F.lit(0.0))
        d = d.withColumn("_f", f).withColumns({c: F.col(c) - F.col("_f") for c in PRICES})
    return d.where("_bar").drop("_v", "_f", "_bar")


def adjust_actions(df: DataFrame, actions: DataFrame) -> DataFrame:
    """All splits first, then all dividends."""
    df = adjust_splits(df, actions.where(F.col("action") == "split"))
    return adjust_dividends(df, actions.where(F.col("action") == "dividend"))


def adjust_close_ratio(df: DataFrame) -> DataFrame:
    """Scale open, high and low by adjusted/close and take the adjusted close."""
    f = div("adj_close", "close")
    return df.withColumns({"open": F.col("open") * f, "high": F.col("high") * f, "low": F.col("low") * f,
                           "close": F.col("adj_close")})


def survivorship_filter(df: DataFrame, start, min_days: int = 500) -> DataFrame:
    """Symbols with enough valid days that already traded at the universe start."""
    # windows over the symbol's own rows: what makes the rows runs once, not once more for a list of symbols
    w = whole()
    d = df.withColumns({"_n": F.count("close").over(w), "_first": F.min("date").over(w)})
    return d.where((F.col("_n") >= min_days) & (F.col("_first") <= F.lit(start).cast("timestamp")) & F.col("symbol").isNotNull()).drop("_n", "_first")


def business_calendar(spark: SparkSession, start, end) -> DataFrame:
    days = F.explode(F.sequence(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"), F.expr("INTERVAL 1 DAY")))
    return spark.range(1).select(days.alias("date")).where(F.weekday("date") < 5)


def align_calendar(df: DataFrame, start=None, end=None) -> DataFrame:
    """Every symbol on every weekday of the range; missing bars are null rows.

    Each symbol row explodes the same literal day sequence, so no date-by-symbol join is
    needed; the default range is the table's own first and last day.
    """
    if start is None or end is None:
        lo, hi = df.agg(F.min("date"), F.max("date")).first()
        start, end = start or lo, end or hi
    days = F.sequence(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"), F.expr("INTERVAL 1 DAY"))
    grid = df.select("symbol").distinct().select("symbol", F.explode(days).alias("date")).where(F.weekday("date") < 5)
    return grid.join(df, ["symbol", "date"], "left")


def drop_sparse_columns(df: DataFrame, cols, max_missing=0.5) -> DataFrame:
    """One aggregate pass over all columns, then a projection of the kept ones."""
    row = df.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in cols]).first()
    return df.drop(*[c for c in cols if row[c] is None or row[c] >= max_missing])


def min_history(df: DataFrame, value="ret", least: int = 252, share: float = 0.25) -> DataFrame:
    """Symbols with at least max(least, share of all dates) observations; missing values become 0."""
    dates = df.select("date").distinct().agg(F.count(F.lit(1)).alias("d"))
    n = df.groupBy("symbol").agg(F.count(value).alias("n"))
    ok = attach(n, dates).where(F.col("n") >= F.greatest(F.lit(least), F.floor(F.col("d") * share))).select("symbol")
    return df.join(ok, "symbol", "left_semi").withColumn(value, F.coalesce(value, F.lit(0.0)))
