"""Point-in-time, nearest, range and alignment joins."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidepanel.core.scratch import materialise


def asof(left: DataFrame, right: DataFrame, key: list[str], lt: str, rt: str, values: list[str], prefix: str = "",
         bucket: str | None = None, forward: bool = False, keep_time: bool = False) -> DataFrame:
    """Latest right row at or before (``forward``: earliest at or after) each left row.

    Both sides are stacked and the newest right struct is carried along the time order;
    on equal times the right row comes first, so the match is inclusive. With ``bucket``
    (a date_trunc unit) each (key, period) is its own window and the last right row of
    earlier periods is carried over from a per-period summary, so a key holding most of
    the left rows never lands in one task.
    """
    side = F.lit(0)
    payload = F.struct(F.col(rt).alias("_t"), *[F.col(v).alias(v) for v in values])
    lcols = left.columns
    packed = F.struct(*lcols)
    l = left.select(*key, F.col(lt).alias("_ts"), F.lit(1).alias("_side"), packed.alias("_l"))
    r = right.where(F.col(rt).isNotNull()).select(*key, F.col(rt).alias("_ts"), side.alias("_side"), payload.alias("_r"))
    u = l.unionByName(r, allowMissingColumns=True)
    order = [F.col("_ts").desc() if forward else F.col("_ts"), F.col("_side")]
    if bucket is None:
        w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        u = u.withColumn("_m", F.last("_r", ignorenulls=True).over(w))
    else:
        u = u.withColumn("_b", F.date_trunc(bucket, "_ts"))
        pick = F.min_by if forward else F.max_by
        ends = u.groupBy(*key, "_b").agg(pick("_r", F.when(F.col("_r").isNotNull(), F.col("_ts"))).alias("_e"))
        border = F.col("_b").desc() if forward else F.col("_b")
        wb = Window.partitionBy(*key).orderBy(border).rowsBetween(Window.unboundedPreceding, -1)
        ends = ends.select(*key, "_b", F.last("_e", ignorenulls=True).over(wb).alias("_carry"))
        w = Window.partitionBy(*key, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        u = u.withColumn("_m", F.last("_r", ignorenulls=True).over(w))
        u = u.join(ends, [*key, "_b"]).withColumn("_m", F.coalesce("_m", "_carry"))
    out = u.where(F.col("_side") == 1).select("_l.*", *[F.col(f"_m.{v}").alias(prefix + v) for v in values],
                                               *([F.col("_m._t").alias(prefix + rt)] if keep_time else []))
    return out


def asof_lag(prices: DataFrame, fundamentals: DataFrame, values: list[str], lag_days: int = 45, fiscal="fiscal_date") -> DataFrame:
    """Fundamentals become visible ``lag_days`` after the fiscal date."""
    f = fundamentals.withColumn("available", F.col(fiscal) + F.make_dt_interval(F.lit(lag_days)))
    return asof(prices, f, ["symbol"], "date", "available", values)


#: Times that one task's call looks at, of any number of keys and periods.
TIMES = 50_000


def _around(table: pa.Table) -> pa.Table:
    """Last price at or before and first at or after each asked time, from rows (symbol, _ts in microseconds, _price, _asks, _b) of any keys and periods _b."""
    asks, at, price = (table.column(c).to_numpy() for c in ("_asks", "_ts", "_price"))
    codes = [pc.fill_null(table.column(c).combine_chunks().dictionary_encode().indices, -1).to_numpy().astype(np.int64) for c in ("symbol", "_b")]
    code, rows = codes[0] * (codes[1].max() + 2) + codes[1], np.arange(len(asks))

    def met(first: np.ndarray, later: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Price, its time and whether there is one, for the nearest price row on one side of every row in the order of (key, time, ``first``)."""
        order = np.lexsort((first, at, code))
        place = np.where(asks[order], len(rows) if later else -1, rows)
        place = np.minimum.accumulate(place[::-1])[::-1] if later else np.maximum.accumulate(place)
        there = (place >= 0) & (place < len(rows))
        found = order[np.where(there, place, 0)]
        there &= code[found] == code[order]
        back = np.empty(len(rows), np.int64)
        back[order] = rows
        return price[found][back][asks], at[found][back][asks], there[back][asks]

    (low, low_t, has_before), (high, high_t, has_after), t = met(asks, False), met(~asks, True), at[asks]
    earlier = has_before & (~has_after | (t - low_t <= high_t - t))
    market, none = np.where(earlier, low, high), ~(has_before | has_after)
    return pa.table({"symbol": table.column("symbol").filter(pa.array(asks)), "_ts": pa.array(t), "market_price": pa.array(market, mask=none), "next_price": pa.array(high, mask=~has_after)})


def nearest_price(orders: DataFrame, prices: DataFrame, order_time="order_time", time="date", price="close",
                  bucket="year", keep_next: bool = False) -> DataFrame:
    """Price at the timestamp closest to each order; a tie takes the earlier one.

    Both directions are settled in one pass: the distinct (symbol, time) pairs of the orders meet the prices of their period, and a
    per-period summary adds the nearest price before and after the period. The orders themselves come back by an equi-join. Choose ``bucket`` so
    that a symbol has few distinct order times per period: a year for daily stamps, a day for intraday ones.
    """
    orders = materialise(orders, "orders")
    slots = orders.where(F.col(order_time).isNotNull()).select("symbol", order_time).distinct()
    p = prices.where(F.col(time).isNotNull() & F.col(price).isNotNull())
    row = lambda df, t, value, asks: df.select("symbol", F.unix_micros(F.col(t).cast("timestamp")).alias("_ts"), value.cast("double").alias("_price"), F.lit(asks).alias("_asks"),
                                               F.date_trunc(bucket, t).alias("_b"))
    met = materialise(row(slots, order_time, F.lit(None), True).unionByName(row(p, time, F.col(price), False)), "times")
    ends = met.groupBy("symbol", "_b").agg(*[f(F.when(~F.col("_asks"), F.col("_ts"))).alias(f"_{n}_t") for n, f in (("lo", F.min), ("hi", F.max))],
                                           *[f("_price", F.when(~F.col("_asks"), F.col("_ts"))).alias(f"_{n}_p") for n, f in (("lo", F.min_by), ("hi", F.max_by))])
    w = Window.partitionBy("symbol")
    carry = lambda c, border: F.last(c, ignorenulls=True).over(w.orderBy(border).rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.select("symbol", "_b", *[carry(c, F.col("_b")).alias(f"{c}_c") for c in ("_hi_t", "_hi_p")], *[carry(c, F.col("_b").desc()).alias(f"{c}_c") for c in ("_lo_t", "_lo_p")])
    edges = F.explode(F.array(*[F.struct(F.col(f"_{n}_t_c").alias("_ts"), F.col(f"_{n}_p_c").alias("_price")) for n in ("hi", "lo")]))
    edges = ends.select("symbol", "_b", edges.alias("e")).where("e._ts is not null").select("symbol", "e._ts", "e._price", F.lit(False).alias("_asks"), "_b")
    kind = met.schema["symbol"].dataType.simpleString()
    groups = max(int(orders.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-met.count() // TIMES))
    found = met.unionByName(edges).groupBy(F.pmod(F.xxhash64("symbol", "_b"), F.lit(groups))).applyInArrow(_around, f"symbol {kind}, _ts long, market_price double, next_price double")
    found = found.select("symbol", F.timestamp_micros("_ts").alias(order_time), "market_price", *(["next_price"] if keep_next else []))
    return orders.join(found, ["symbol", order_time], "left")


def latest_regime(dates: DataFrame, regimes: DataFrame, key: list[str], n: int = 3, time="date") -> DataFrame:
    """Latest probabilities at or before each date, uniform where none exist yet."""
    out = asof(dates, regimes, key, time, time, ["probs"])
    return out.withColumn("probs", F.coalesce("probs", F.array(*[F.lit(1.0 / n) for _ in range(n)])))


def macro_daily(panel: DataFrame, macro_wide: DataFrame, cols: list[str], time="date") -> DataFrame:
    """Macro columns resampled to days with forward fill, joined on the date and prefixed.

    The daily table has one row per calendar day between the first and last macro date, a
    bound given by the calendar; whether it is broadcast is left to the size threshold.
    """
    lo, hi = macro_wide.agg(F.min(time), F.max(time)).first()
    spark = macro_wide.sparkSession
    days = spark.range(1).select(F.explode(F.sequence(F.lit(lo), F.lit(hi), F.expr("INTERVAL 1 DAY"))).alias(time), F.lit(0).alias("_k"))
    d = days.join(macro_wide, time, "left")
    w = Window.partitionBy("_k").orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    d = d.select(time, *[F.last(c, ignorenulls=True).over(w).alias(f"macro_{c}") for c in cols])
    return panel.join(d, time, "left")


def macro_reindex(dates: DataFrame, macro_wide: DataFrame, cols: list[str], time="date") -> DataFrame:
    """Macro columns on trading dates with forward fill; each date once, however many rows a panel has for it."""
    k = F.lit(0).alias("_k")
    m = macro_wide.select(time, *cols, k)
    w = Window.partitionBy("_k").orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    # each column carries its own last value: series of different frequency share the table
    m = m.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in cols})
    out = asof(dates.select(time).distinct().select(time, k), m, ["_k"], time, time, cols)
    return out.drop("_k")


def outer_merge(tables: dict[str, DataFrame], time="date") -> DataFrame:
    """Full outer merge of category tables with category-prefixed columns, in one shuffle via the long form."""
    long, names = None, []
    for cat, df in tables.items():
        cols = [c for c in df.columns if c != time]
        names += [f"{cat}_{c}" for c in cols]
        part = df.select(time, *[F.col(c).cast("double").alias(f"{cat}_{c}") for c in cols]).unpivot(time, [f"{cat}_{c}" for c in cols], "name", "value")
        long = part if long is None else long.unionByName(part)
    return long.groupBy(time).pivot("name", names).agg(F.first("value", ignorenulls=True))


def align_inner(frames: list[DataFrame], on: list[str]) -> DataFrame:
    """Rows whose keys occur in every frame."""
    out = frames[0]
    for f in frames[1:]:
        out = out.join(f, on)
    return out


def training_windows(rows: DataFrame, rebalances: DataFrame, days: int | None, time="date", out="rebalance_date") -> DataFrame:
    """Rows with rebalance - days <= date < rebalance (``days=None``: expanding window).

    Each rebalance explodes the months its window touches, so rows meet it by an equi-join
    on the month and the exact range is a residual filter.
    """
    rb = F.col(out)
    r = rebalances.select(rb)
    start = rb - F.make_dt_interval(F.lit(days)) if days is not None else None
    if start is None:
        lo = rows.agg(F.min(time)).first()[0]
        start = F.lit(lo)
    r = r.withColumn("_from", start)
    r = r.withColumn("_m", F.explode(F.sequence(F.date_trunc("month", "_from"), F.date_trunc("month", rb), F.expr("INTERVAL 1 MONTH"))))
    j = rows.withColumn("_m", F.date_trunc("month", time)).join(r, "_m")
    return j.where((F.col(time) >= F.col("_from")) & (F.col(time) < rb)).drop("_m", "_from")


def universe_positions(signals: DataFrame, positions: DataFrame, value="signal") -> DataFrame:
    """Symbols with a non-null signal and their current weight, 0 when absent."""
    u = signals.where(F.col(value).isNotNull())
    return u.join(positions.select("symbol", "weight"), "symbol", "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
