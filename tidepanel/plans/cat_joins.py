"""Queries for point-in-time, nearest, range and alignment joins."""
from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.operators import joins as j
from tidepanel.plans.registry import query
from tidepanel.sources import domain as d


@query("join_asof_lag", """WITH f AS (SELECT symbol, fiscal_date+INTERVAL 45 DAY AS av, revenue, net_income FROM fund)
 SELECT b.symbol, b.date, R(close) AS close, R2(revenue) AS revenue, R2(net_income) AS net_income FROM bars b ASOF LEFT JOIN f ON b.symbol=f.symbol AND b.date>=f.av""", revenue=2, net_income=2)
def join_asof_lag(sp, sf):
    return j.asof_lag(d.bars(sp, sf).select("symbol", "date", "close"), d.fundamentals(sp, sf), ["revenue", "net_income"])


@query("join_nearest", """WITH p AS (SELECT o.*, b.date AS pd, b.close AS pc FROM pord o ASOF LEFT JOIN bars b ON o.symbol=b.symbol AND o.order_time>=b.date),
 n AS (SELECT p.*, b.date AS nd, b.close AS nc FROM p ASOF LEFT JOIN bars b ON p.symbol=b.symbol AND p.order_time<=b.date)
 SELECT order_id, symbol, order_time, R(quantity) AS quantity, R(CASE WHEN pd IS NULL THEN nc WHEN nd IS NULL THEN pc WHEN order_time-pd<=nd-order_time THEN pc ELSE nc END) AS market_price FROM n""")
def join_nearest(sp, sf):
    return j.nearest_price(d.parent_orders(sp, sf), d.bars(sp, sf))


@query("join_latest_regime", """WITH l AS (SELECT DISTINCT series, date_trunc('month',date)::TIMESTAMP AS date FROM idx)
 SELECT l.series, l.date, R(coalesce(p0,1.0::DOUBLE/3)) AS p0, R(coalesce(p1,1.0::DOUBLE/3)) AS p1, R(coalesce(p2,1.0::DOUBLE/3)) AS p2 FROM l ASOF LEFT JOIN reg r ON l.series=r.series AND l.date>=r.date""")
def join_latest_regime(sp, sf):
    left = d.index(sp, sf).select("series", F.date_trunc("month", "date").alias("date")).distinct()
    out = j.latest_regime(left, d.regimes(sp, sf), ["series"])
    return out.select("series", "date", *[F.col("probs")[i].alias(f"p{i}") for i in range(3)])


MACRO = ["urgent", "high", "medium", "unspecified", "low"]


@query("join_macro_daily", """WITH g AS (SELECT unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS date FROM macro_wide),
 m AS (SELECT g.date, last_value(urgent IGNORE NULLS) OVER w AS m_urgent, last_value(high IGNORE NULLS) OVER w AS m_high, last_value(medium IGNORE NULLS) OVER w AS m_medium, last_value(unspecified IGNORE NULLS) OVER w AS m_unspecified, last_value(low IGNORE NULLS) OVER w AS m_low FROM g LEFT JOIN macro_wide x ON g.date=x.date WINDOW w AS (ORDER BY g.date ROWS UNBOUNDED PRECEDING))
 SELECT b.symbol, b.date, R(close) AS close, R(m_urgent) AS macro_urgent, R(m_high) AS macro_high, R(m_medium) AS macro_medium, R(m_unspecified) AS macro_unspecified, R(m_low) AS macro_low FROM bars b LEFT JOIN m ON b.date=m.date""")
def join_macro_daily(sp, sf):
    return j.macro_daily(d.bars(sp, sf).select("symbol", "date", "close"), d.macro_wide(sp, sf), MACRO)


@query("join_macro_reindex", "SELECT a.date, R(urgent) AS urgent, R(high) AS high, R(medium) AS medium, R(unspecified) AS unspecified, R(low) AS low FROM mkt a ASOF LEFT JOIN macro_fill m ON a.date>=m.date")
def join_macro_reindex(sp, sf):
    return j.macro_reindex(d.market(sp, sf).select("date"), d.macro_wide(sp, sf), MACRO)


@query("join_outer_merge", """WITH a AS (SELECT date_trunc('month',date)::TIMESTAMP AS date, last(close ORDER BY date) AS close FROM (SELECT date AS date, close FROM mkt) GROUP BY 1)
 SELECT coalesce(a.date, m.date) AS date, R(urgent) AS macro_urgent, R(low) AS macro_low, R(close) AS market_close FROM a FULL JOIN macro_wide m ON a.date=m.date""")
def join_outer_merge(sp, sf):
    m = d.market(sp, sf).groupBy(F.date_trunc("month", "date").alias("month")).agg(F.max_by("close", "date").alias("close")).withColumnRenamed("month", "date")
    return j.outer_merge({"macro": d.macro_wide(sp, sf).select("date", "urgent", "low"), "market": m})


@query("join_align_inner", """WITH f AS (SELECT date, avg(ret) AS factor FROM rets WHERE ret IS NOT NULL GROUP BY date), x AS (SELECT date, regime FROM mreg WHERE vol IS NOT NULL)
 SELECT r.symbol, r.date, R(r.ret) AS ret, R(factor) AS factor, regime FROM rets r JOIN f USING (date) JOIN x USING (date) WHERE r.ret IS NOT NULL""")
def join_align_inner(sp, sf):
    r = d.rets(sp, sf).where("ret is not null").select("symbol", "date", "ret")
    f = r.groupBy("date").agg(F.avg("ret").alias("factor"))
    return j.align_inner([r, f, d.market_regimes(sp, sf).where("vol is not null").select("date", "regime")], ["date"])


@query("join_range_filter", """WITH q AS (SELECT DISTINCT date_trunc('quarter',date)::TIMESTAMP AS rb FROM idx)
 SELECT series, rb AS rebalance_date, count(*) AS rows, R(avg(ret)) AS mean_ret, min(date) AS first_date, max(date) AS last_date FROM idx JOIN q ON date>=rb-INTERVAL 252 DAY AND date<rb GROUP BY series, rb""")
def join_range_filter(sp, sf):
    x = d.index(sp, sf).select("series", "date", "ret")
    q = x.select(F.date_trunc("quarter", "date").alias("rebalance_date")).distinct()
    return j.training_windows(x, q, 252).groupBy("series", "rebalance_date").agg(
        F.count(F.lit(1)).alias("rows"), F.avg("ret").alias("mean_ret"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


@query("join_semi_universe", """WITH s AS (SELECT symbol, arg_max(coalesce(m,-1e300), date) AS signal FROM (SELECT symbol, date, close/lag(close,20) OVER (PARTITION BY symbol ORDER BY date)-1 AS m FROM bars) GROUP BY symbol),
 l AS (SELECT symbol, weight FROM weights WHERE date=(SELECT max(date) FROM weights))
 SELECT s.symbol, R(nullif(signal,-1e300)) AS signal, R(coalesce(weight,0)) AS weight FROM s LEFT JOIN l USING (symbol) WHERE signal>-1e300""")
def join_semi_universe(sp, sf):
    from tidepanel.core.frames import change
    s = d.bars(sp, sf).withColumn("m", change("close", 20)).groupBy("symbol").agg(F.max_by("m", "date").alias("signal"))
    w = d.weights(sp, sf)
    last = w.agg(F.max("date").alias("date"))
    return j.universe_positions(s, w.join(last, "date")).select("symbol", "signal", "weight")
