"""Queries for cleaning, gap filling, corporate actions and calendars."""
from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.core.frames import change, div
from tidepanel.operators import cleaning as c, neighbours
from tidepanel.plans.registry import query
from tidepanel.sources import domain as d

P = ("open", "high", "low", "close")


@query("clean_prices", """WITH a AS (SELECT symbol, date, open, high, low, CASE WHEN close>=100 THEN close-100 END AS close FROM bars)
 SELECT symbol, date, R(open) AS open, R(high) AS high, R(low) AS low, R(close) AS close, coalesce(abs(close/nullif(lag(close) OVER (PARTITION BY symbol ORDER BY date),0)-1)>0.5,false) AS extreme_move FROM a""")
def clean_prices(sp, sf):
    # shifting the close makes some prices negative
    df = d.bars(sp, sf).withColumn("close", F.col("close") - 100)
    return c.clean_prices(df).select("symbol", "date", *P, "extreme_move")


_X = "PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING"
_Y = "PARTITION BY symbol ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING"
_FF = f"""n AS (SELECT symbol, date, close, volume, row_number() OVER (PARTITION BY symbol ORDER BY date) AS i FROM cal),
 g AS (SELECT symbol, date, close, volume, i, max(CASE WHEN close IS NOT NULL THEN i END) OVER ({_X}) AS i0, min(CASE WHEN close IS NOT NULL THEN i END) OVER ({_Y}) AS i1,
  last_value(close IGNORE NULLS) OVER ({_X}) AS v0, first_value(close IGNORE NULLS) OVER ({_Y}) AS v1,
  last_value(volume IGNORE NULLS) OVER ({_X}) AS u0, first_value(volume IGNORE NULLS) OVER ({_Y}) AS u1 FROM n)"""
_LIN = "CASE WHEN {x} IS NOT NULL THEN {x} WHEN (i-i0<=10 OR i1-i<=10) AND i0 IS NOT NULL AND i1 IS NOT NULL THEN {a}+({b}-{a})*(i-i0)/(i1-i0) END"


@query("ffill_limit", f"WITH {_FF} SELECT symbol, date, R(CASE WHEN i-i0<=5 THEN v0 END) AS close FROM g")
def ffill_limit(sp, sf):
    return c.ffill(d.calendar_bars(sp, sf).select("symbol", "date", "close"), ["close"], 5)


@query("bfill", f"WITH {_FF} SELECT symbol, date, R(v1) AS close FROM g")
def bfill(sp, sf):
    return c.bfill(d.calendar_bars(sp, sf).select("symbol", "date", "close"), ["close"])


@query("interpolate", f"WITH {_FF} SELECT symbol, date, R({_LIN.format(x='close', a='v0', b='v1')}) AS close FROM g")
def interpolate(sp, sf):
    return c.interpolate(d.calendar_bars(sp, sf).select("symbol", "date", "close"), ["close"])


@query("impute_hybrid", f"WITH {_FF} SELECT symbol, date, R(CASE WHEN i-i0<=5 THEN v0 END) AS close, R({_LIN.format(x='volume', a='u0', b='u1')}) AS volume FROM g")
def impute_hybrid(sp, sf):
    return c.impute_hybrid(d.calendar_bars(sp, sf).select("symbol", "date", "close", "volume"), ["close"], ["volume"])


@query("impute_knn", """WITH a AS (SELECT symbol, date, ret, volume, ln(close) AS lc, high/low-1 AS width FROM rets), k AS (SELECT avg(volume) AS m0, stddev_pop(volume) AS s0, avg(lc) AS m1, stddev_pop(lc) AS s1, avg(width) AS m2, stddev_pop(width) AS s2, avg(ret) AS mr FROM a),
 z AS (SELECT a.*, (volume-m0)/s0 AS z0, (lc-m1)/s1 AS z1, (width-m2)/s2 AS z2 FROM a, k),
 n AS (SELECT q.symbol, q.date, c.ret AS y, row_number() OVER (PARTITION BY q.symbol, q.date ORDER BY power(q.z0-c.z0,2)+power(q.z1-c.z1,2)+power(q.z2-c.z2,2), c.symbol, c.date) AS rn FROM z q JOIN z c ON q.ret IS NULL AND c.ret IS NOT NULL),
 m AS (SELECT symbol, date, avg(y) AS m FROM n WHERE rn<=5 GROUP BY ALL)
 SELECT symbol, date, R(coalesce(ret, m, mr)) AS ret FROM z LEFT JOIN m USING (symbol, date), k""")
def impute_knn(sp, sf):
    df = d.rets(sp, sf).select("symbol", "date", "ret", "volume", F.log("close").alias("lc"), (F.col("high") / F.col("low") - 1).alias("width"))
    return neighbours.impute(df, "ret", ["volume", "lc", "width"]).select("symbol", "date", "ret")


@query("inf_to_null", "SELECT symbol, date, R(CASE WHEN high-low<>0 THEN (close-low)/(high-low) END) AS position FROM bars_w")
def inf_to_null(sp, sf):
    rng = F.col("high") - F.col("low")
    raw = F.when(rng == 0, F.when(F.col("close") == F.col("low"), F.lit(float("nan"))).otherwise(F.lit(float("inf")))).otherwise((F.col("close") - F.col("low")) / F.nullif(rng, F.lit(0.0)))
    return c.inf_to_null(d.bars_w(sp, sf).select("symbol", "date", raw.alias("position")), ["position"])


_ACT = """splits AS (SELECT s_suppkey AS symbol, TIMESTAMP '1997-06-02' AS date, 0.5::DOUBLE AS value FROM supplier UNION ALL
  SELECT s_suppkey, TIMESTAMP '1999-03-01', 1.0::DOUBLE/(2+s_nationkey%3) FROM supplier),
 divs AS (SELECT symbol, fiscal_date AS date, price*0.001::DOUBLE AS value FROM fund_y)"""


def _splits(sp, sf):
    s = d.table(sp, sf, "supplier")
    a = F.array(F.struct(F.lit("1997-06-02").cast("timestamp").alias("date"), F.lit(0.5).alias("value")),
                F.struct(F.lit("1999-03-01").cast("timestamp").alias("date"), (1.0 / (2 + F.col("s_nationkey") % 3)).alias("value")))
    return s.select(F.col("s_suppkey").alias("symbol"), F.explode(a).alias("a")).select("symbol", "a.*")


def _dividends(sp, sf):
    return d.fundamentals(sp, sf, "year").select("symbol", F.col("fiscal_date").alias("date"), (F.col("price") * 0.001).alias("value"))


_SF = "coalesce((SELECT product(value) FROM splits s WHERE s.symbol=b.symbol AND s.date>b.date),1)"


@query("adjust_splits", f"""WITH {_ACT}, k AS (SELECT b.*, {_SF} AS f FROM bars b) SELECT symbol, date, R(open*f) AS open, R(high*f) AS high, R(low*f) AS low, R(close*f) AS close, R(volume/nullif(f,0)) AS volume FROM k""")
def adjust_splits(sp, sf):
    return c.adjust_splits(d.bars(sp, sf), _splits(sp, sf)).select("symbol", "date", *P, "volume")


@query("adjust_dividends", f"""WITH {_ACT}, s AS (SELECT b.symbol, b.date, sum(v.value) AS f FROM bars b JOIN divs v ON v.symbol=b.symbol AND v.date>b.date GROUP BY ALL)
 SELECT b.symbol, b.date, R(open-coalesce(f,0)) AS open, R(high-coalesce(f,0)) AS high, R(low-coalesce(f,0)) AS low, R(close-coalesce(f,0)) AS close FROM bars b LEFT JOIN s ON b.symbol=s.symbol AND b.date=s.date""")
def adjust_dividends(sp, sf):
    return c.adjust_dividends(d.bars(sp, sf), _dividends(sp, sf)).select("symbol", "date", *P)


@query("adjust_close_ratio", "SELECT symbol, date, R(open*(adj_close/close)) AS open, R(high*(adj_close/close)) AS high, R(low*(adj_close/close)) AS low, R(adj_close) AS close FROM bars")
def adjust_close_ratio(sp, sf):
    return c.adjust_close_ratio(d.bars(sp, sf)).select("symbol", "date", *P)


@query("survivorship_filter", """WITH k AS (SELECT symbol FROM bars GROUP BY symbol HAVING count(close)>=500 AND min(date)<=TIMESTAMP '1995-02-01') SELECT symbol, date, R(close) AS close FROM bars WHERE symbol IN (SELECT symbol FROM k)""")
def survivorship_filter(sp, sf):
    return c.survivorship_filter(d.bars(sp, sf).select("symbol", "date", "close"), "1995-02-01")


@query("business_calendar", "SELECT date FROM (SELECT unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS date FROM bars) WHERE isodow(date)<6")
def business_calendar(sp, sf):
    lo, hi = d.trades(sp, sf).agg(F.min("ts"), F.max("ts")).first()
    return c.business_calendar(sp, lo, hi)


@query("align_calendar", "SELECT symbol, date, R(close) AS close, R(volume) AS volume FROM cal")
def align_calendar(sp, sf):
    return d.calendar_bars(sp, sf).select("symbol", "date", "close", "volume")


@query("drop_sparse_columns", "SELECT symbol, date, R(close/nullif(lag(close,20) OVER s,0)-1) AS m20 FROM bars WINDOW s AS (PARTITION BY symbol ORDER BY date)")
def drop_sparse_columns(sp, sf):
    df = d.bars(sp, sf).select("symbol", "date", change("close", 20).alias("m20"), change("close", 400).alias("m400"))
    return c.drop_sparse_columns(df, ["m20", "m400"])


@query("min_history_assets", """WITH n AS (SELECT symbol, count(ret) AS n FROM rets GROUP BY symbol), dd AS (SELECT count(DISTINCT date) AS d FROM rets)
 SELECT symbol, date, R(coalesce(ret,0)) AS ret FROM rets WHERE symbol IN (SELECT symbol FROM n, dd WHERE n>=greatest(252, floor(d*0.21)))""")
def min_history_assets(sp, sf):
    return c.min_history(d.rets(sp, sf).select("symbol", "date", "ret"), share=0.21)


@query("pipeline_clean", f"""WITH {_ACT}, k AS (SELECT b.*, {_SF} AS f FROM bars b WHERE symbol IN (SELECT symbol FROM bars GROUP BY symbol HAVING count(close)>=400 AND min(date)<=TIMESTAMP '1995-03-01')),
 a AS (SELECT symbol, date, close*f AS close, volume/f AS volume FROM k),
 g AS (SELECT symbol, date FROM (SELECT DISTINCT symbol FROM a), (SELECT unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS date FROM bars) WHERE isodow(date)<6),
 j AS (SELECT g.symbol, g.date, close, volume, row_number() OVER (PARTITION BY g.symbol ORDER BY g.date) AS i FROM g LEFT JOIN a ON a.symbol=g.symbol AND a.date=g.date),
 h AS (SELECT *, max(CASE WHEN close IS NOT NULL THEN i END) OVER ({_X}) AS i0, min(CASE WHEN close IS NOT NULL THEN i END) OVER ({_Y}) AS i1, last_value(close IGNORE NULLS) OVER ({_X}) AS v0,
   last_value(volume IGNORE NULLS) OVER ({_X}) AS u0, first_value(volume IGNORE NULLS) OVER ({_Y}) AS u1 FROM j),
 z AS (SELECT symbol, date, CASE WHEN i-i0<=5 THEN v0 END AS close, {_LIN.format(x='volume', a='u0', b='u1')} AS volume FROM h),
 q AS (SELECT symbol, avg(close) AS m, stddev_pop(close) AS sd, quantile_cont(close,0.01) AS lo, quantile_cont(close,0.99) AS hi FROM z GROUP BY symbol)
 SELECT z.symbol, z.date, R(CASE WHEN abs(close-m)/nullif(sd,0)>3 THEN greatest(lo,least(hi,close)) ELSE close END) AS close, R(volume) AS volume FROM z JOIN q USING (symbol)""", 4)
def pipeline_clean(sp, sf):
    from tidepanel.plans.pipelines import clean
    lo, hi = d.trades(sp, sf).agg(F.min("ts"), F.max("ts")).first()
    acts = _splits(sp, sf).withColumn("action", F.lit("split"))
    return clean(d.bars(sp, sf).drop("adj_close"), acts, lo, hi, universe_start="1995-03-01", min_days=400).select("symbol", "date", "close", "volume")
