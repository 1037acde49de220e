"""Data-quality rules as aggregate rows, and outlier flags and treatment."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidepanel.core.frames import attach, div, ordered, roll, trailing, whole
from tidepanel.core.ordering import grouped_quantiles
from tidepanel.core.scratch import materialise

PASS, WARN, FAIL = "PASS", "WARNING", "FAIL"


def missing(df: DataFrame, cols, limit=0.05) -> DataFrame:
    """Missing cells per column and in total, from one pass."""
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in cols])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("missing")) for c in cols],
                    F.struct(F.lit("*").alias("column"), sum((F.col(c) for c in cols[1:]), F.col(cols[0])).alias("missing")))
    out = row.select("n", F.explode(cells).alias("e")).select(
        "e.column", "e.missing", div(F.col("e.missing").cast("double"), F.col("n") * F.when(F.col("e.column") == "*", float(len(cols))).otherwise(1.0)).alias("share"))
    return out.withColumn("status", F.when(F.col("share") > limit, WARN).otherwise(PASS))


def outlier_counts(df: DataFrame, value: str, limit=0.05) -> DataFrame:
    """Outliers of a column by z-score, interquartile range and modified z-score; the largest share decides.

    Quartiles and the median absolute deviation come from the split-range quantiles, so the
    whole table is never gathered in one task. The statistics are single rows.
    """
    x = materialise(df.select(F.col(value).alias("x")).where("x is not null"), "column")
    q = materialise(grouped_quantiles(x, [], "x", {"q1": 0.25, "med": 0.5, "q3": 0.75}, stage=False), "quartiles")
    m = x.agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    base = attach(attach(x, m), q)
    mad = grouped_quantiles(base.select(F.abs(F.col("x") - F.col("med")).alias("dev")), [], "dev", {"mad": 0.5}).select("mad")
    base = attach(base, mad)
    z = F.abs(div(F.col("x") - F.col("m"), "s")) > 3
    iqr = F.col("q3") - F.col("q1")
    i = (F.col("x") < F.col("q1") - 1.5 * iqr) | (F.col("x") > F.col("q3") + 1.5 * iqr)
    mz = F.abs(div(0.6745 * (F.col("x") - F.col("med")), "mad")) > 3.5
    g = base.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.coalesce(e, F.lit(False)).cast("long")).alias(k)
                                                for k, e in (("zscore", z), ("iqr", i), ("modified_zscore", mz))])
    worst = F.greatest("zscore", "iqr", "modified_zscore")
    return g.select(F.lit(value).alias("column"), "n", "zscore", "iqr", "modified_zscore",
                    div(worst.cast("double"), F.col("n").cast("double")).alias("share")).withColumn(
        "status", F.when(F.col("share") > limit, WARN).otherwise(PASS))


def price_anomalies(df: DataFrame, price="close", key="symbol", time="date") -> DataFrame:
    """Per symbol: moves over 50%, non-positive prices, ratios above 2 or below one half."""
    d = df.where(F.col(price).isNotNull())
    ratio = div(price, F.lag(price).over(ordered(key, time)))
    d = d.withColumn("_r", ratio)
    n = lambda e: F.sum(F.coalesce(e, F.lit(False)).cast("long"))
    return d.groupBy(key).agg(n(F.abs(F.col("_r") - 1) > 0.5).alias("extreme_moves"), n(F.col(price) <= 0).alias("non_positive"),
                              n((F.col("_r") > 2) | (F.col("_r") < 0.5)).alias("ratio_breaks"))


def volume_anomalies(df: DataFrame, volume="volume", key="symbol", time="date") -> DataFrame:
    d = df.withColumn("_m", roll(F.avg, volume, 20, key, time))
    n = lambda e: F.sum(F.coalesce(e, F.lit(False)).cast("long"))
    return d.groupBy(key).agg(n(F.col(volume) == 0).alias("zero"), n(F.col(volume) < 0).alias("negative"),
                              n(F.col(volume) > 10 * F.col("_m")).alias("spikes"))


def business_days(lo: Column, hi: Column) -> Column:
    """Weekdays in [lo, hi] by arithmetic: full weeks plus the remainder."""
    days = F.date_diff(hi, lo) + 1
    first = F.weekday(lo)
    rest = days % 7
    # weekdays among `rest` days starting at weekday `first`
    extra = F.aggregate(F.sequence(F.lit(0), F.lit(6)), F.lit(0),
                        lambda a, k: a + F.when((k < rest) & ((first + k) % 7 < 5), 1).otherwise(0))
    return F.floor(days / 7) * 5 + extra


def continuity(df: DataFrame, key="symbol", time="date", max_gap=7) -> DataFrame:
    """Missing weekdays, gaps over ``max_gap`` days and the largest gap per symbol."""
    gap = F.date_diff(F.col(time), F.lag(time).over(ordered(key, time)))
    d = df.select(key, time, gap.alias("_g"))
    g = d.groupBy(key).agg(F.min(time).alias("_lo"), F.max(time).alias("_hi"),
                           F.sum((F.weekday(time) < 5).cast("long")).alias("_have"),
                           F.sum(F.coalesce(F.col("_g") > max_gap, F.lit(False)).cast("long")).alias("gaps"), F.max("_g").alias("largest_gap"))
    return g.select(key, (business_days(F.col("_lo"), F.col("_hi")) - F.col("_have")).cast("long").alias("missing_days"), "gaps", "largest_gap")


def duplicates(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Rows beyond the first per key, and per identical row; nulls equal nulls in the same column only."""
    by_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("c")).agg(F.sum(F.col("c") - 1).alias("duplicate_keys"))
    by_row = df.groupBy(*keys, *cols).agg(F.count(F.lit(1)).alias("c")).agg(F.sum(F.col("c") - 1).alias("duplicate_rows"))
    return attach(by_key, by_row)


def dates(df: DataFrame, time="date", seq="seq", key="symbol", now=None, span: int = 1_000_000) -> DataFrame:
    """Out-of-order rows by (numeric) ingest sequence, future dates and dates before 1900.

    Raw rows of a key may be very many, so they are compared inside sequence ranges; the last
    row before a range comes from a per-range summary.
    """
    ref = F.lit(now).cast("timestamp") if now is not None else F.current_timestamp()
    d = df.select(key, F.col(time).alias("_t"), F.col(seq).alias("_q"), F.floor(F.col(seq) / span).alias("_b"))
    ends = d.groupBy(key, "_b").agg(F.max_by("_t", "_q").alias("_e"))
    ends = ends.select(key, "_b", F.lag("_e").over(Window.partitionBy(key).orderBy("_b")).alias("_carry"))
    w = Window.partitionBy(key, "_b").orderBy("_q")
    d = d.withColumns({"_p": F.lag("_t").over(w), "_first": F.row_number().over(w) == 1}).join(ends, [key, "_b"])
    d = d.withColumn("_p", F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_p")))
    n = lambda e: F.sum(F.coalesce(e, F.lit(False)).cast("long"))
    return d.groupBy(key).agg(n(F.col("_t") < F.col("_p")).alias("unsorted"), n(F.col("_t") > ref).alias("future"),
                              n(F.year("_t") < 1900).alias("ancient"))


def business_rules(df: DataFrame, kind: str) -> DataFrame:
    """Logical violations by data type: market, fundamental (ratios) or macro (rates)."""
    n = lambda e: F.sum(F.coalesce(e, F.lit(False)).cast("long"))
    if kind == "market":
        o, h, l, c = (F.col(k) for k in ("open", "high", "low", "close"))
        return df.agg(n(h < l).alias("high_below_low"), n((c > h) | (c < l)).alias("close_outside"), n((o > h) | (o < l)).alias("open_outside"))
    if kind == "fundamental":
        return df.agg(*[n(F.abs(c) > 10).alias(f"{c}_outside") for c in df.columns if "ratio" in c or "margin" in c])
    return df.agg(*[n((F.col(c) < -10) | (F.col(c) > 50)).alias(f"{c}_outside") for c in df.columns if c != "date"])


SEVERITY = {PASS: 0, WARN: 1, FAIL: 2}


def rule_row(df: DataFrame, dataset: str, rule: str, status: Column, metric: Column) -> DataFrame:
    return df.select(F.lit(dataset).alias("dataset"), F.lit(rule).alias("rule"), status.alias("status"), metric.cast("double").alias("metric"))


def summary(rules: DataFrame) -> DataFrame:
    """Rules per status and the overall status: any FAIL fails, any WARNING warns."""
    sev = F.when(F.col("status") == FAIL, 2).when(F.col("status") == WARN, 1).otherwise(0)
    g = rules.groupBy("dataset").agg(F.count(F.lit(1)).alias("rules"), *[F.sum((F.col("status") == s).cast("long")).alias(s.lower()) for s in SEVERITY],
                                     F.max(sev).alias("_s"))
    return g.withColumn("overall", F.when(F.col("_s") == 2, FAIL).when(F.col("_s") == 1, WARN).otherwise(PASS)).drop("_s")


def profile(df: DataFrame, cols, key="symbol", time="date") -> DataFrame:
    """Rows, missing, infinite, negative, zero volume, duplicate dates and range per symbol."""
    # one sum of all columns per figure: a day of a symbol is a group, so a column of its own for each would be most of a task's memory
    total = lambda test: F.sum(sum((test(F.col(c)).cast("long") for c in cols[1:]), test(F.col(cols[0])).cast("long")))
    per = df.groupBy(key, time).agg(F.count(F.lit(1)).alias("r"), total(lambda c: c.isNull()).alias("m"),
                                    total(lambda c: F.coalesce(F.abs(c) == F.lit(float("inf")), F.lit(False))).alias("i"),
                                    total(lambda c: F.coalesce(c < 0, F.lit(False))).alias("n"),
                                    F.sum(F.coalesce(F.col("volume") == 0, F.lit(False)).cast("long")).alias("z"))
    return per.groupBy(key).agg(F.sum("r").alias("rows"), F.sum("m").alias("missing"), F.sum("i").alias("infinite"), F.sum("n").alias("negative"),
                                F.sum("z").alias("zero_volume"), F.sum(F.col("r") - 1).alias("duplicate_dates"),
                                F.min(time).alias("first_date"), F.max(time).alias("last_date"))


def flag(df: DataFrame, cols, method: str, key="symbol") -> DataFrame:
    """Boolean <col>_outlier per symbol history: zscore > 3, 1.5 IQR or modified z > 3.5."""
    w = whole(key)
    for c in cols:
        x = F.col(c)
        if method == "zscore":
            e = F.abs(div(x - F.avg(c).over(w), F.stddev_pop(c).over(w))) > 3
            df = df.withColumn(f"{c}_outlier", F.coalesce(e, F.lit(False)))
            continue
        df = df.withColumn("_q", F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).over(w))
        if method == "iqr":
            iqr = F.col("_q")[2] - F.col("_q")[0]
            e = (x < F.col("_q")[0] - 1.5 * iqr) | (x > F.col("_q")[2] + 1.5 * iqr)
        elif method == "modified_zscore":
            df = df.withColumn("_d", F.abs(x - F.col("_q")[1])).withColumn("_mad", F.percentile("_d", F.lit(0.5)).over(w))
            e = F.abs(div(0.6745 * (x - F.col("_q")[1]), "_mad")) > 3.5
        else:
            raise ValueError(f"unknown outlier method {method!r}")
        df = df.withColumn(f"{c}_outlier", F.coalesce(e, F.lit(False))).drop("_q", "_d", "_mad")
    return df


def treat(df: DataFrame, cols, method: str = "winsorize", key="symbol") -> DataFrame:
    """Flagged values only: clip to the 1%/99% quantiles, cap at 3 deviations, or set null."""
    w = whole(key)
    for c in cols:
        x, f = F.col(c), F.col(f"{c}_outlier")
        if method == "winsorize":
            df = df.withColumn("_q", F.percentile(c, F.array(F.lit(0.01), F.lit(0.99))).over(w))
            new = F.greatest(F.col("_q")[0], F.least(F.col("_q")[1], x))
        elif method == "cap":
            m, s = F.avg(c).over(w), F.stddev_samp(c).over(w)
            df = df.withColumns({"_lo": m - 3 * s, "_hi": m + 3 * s})
            new = F.greatest(F.col("_lo"), F.least(F.col("_hi"), x))
        elif method == "remove":
            new = F.lit(None).cast("double")
        else:
            raise ValueError(f"unknown treatment {method!r}")
        df = df.withColumn(c, F.when(f, new).otherwise(x)).drop("_q", "_lo", "_hi")
    return df


def cross_dataset(frames: dict[str, DataFrame], key="symbol", time="date", max_days=30) -> DataFrame:
    """Spread of first and last dates between datasets and the share of symbols they have in common."""
    rows, names = None, None
    for n, f in frames.items():
        r = f.agg(F.min(time).alias("lo"), F.max(time).alias("hi"))
        s = f.select(key).distinct()
        rows = r if rows is None else rows.unionByName(r)
        names = s if names is None else names.unionByName(s)
    g = rows.agg(F.date_diff(F.max("lo"), F.min("lo")).alias("start_spread"), F.date_diff(F.max("hi"), F.min("hi")).alias("end_spread"))
    k = names.groupBy(key).agg(F.count(F.lit(1)).alias("c")).agg(F.count(F.lit(1)).alias("symbols"), F.sum((F.col("c") == len(frames)).cast("long")).alias("common"))
    return attach(g, k).withColumns({"overlap": div(F.col("common").cast("double"), F.col("symbols").cast("double")),
                                  "status": F.when((F.col("start_spread") > max_days) | (F.col("end_spread") > max_days), WARN).otherwise(PASS)})
