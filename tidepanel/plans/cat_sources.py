"""Queries for readers and sinks; sinks are checked by writing and reading back."""
from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.core.frames import div
from tidepanel.core.scratch import new_path
from tidepanel.operators import technical as t
from tidepanel.plans.registry import query
from tidepanel.sources import bars as b, domain as d, statements as st, store

BAR = "open high low close volume".split()
RB = ", ".join(f"R({c}) AS {c}" for c in BAR)


@query("src_bars", f"SELECT symbol, date, {RB} FROM bars WHERE date BETWEEN TIMESTAMP '1996-03-01' AND TIMESTAMP '1997-08-31'")
def src_bars(sp, sf):
    return b.select_bars(d.bars(sp, sf, "1996-03-01", "1997-08-31"), None, "1996-03-01", "1997-08-31").select("symbol", "date", *BAR)


@query("src_bars_from_trades", f"SELECT symbol, date, {RB}, R(adj_close) AS adj_close FROM bars")
def src_bars_from_trades(sp, sf):
    return d.bars(sp, sf)


@query("src_fundamentals", """SELECT symbol, metric_name, fiscal_date, R(metric_value) AS metric_value FROM
 (UNPIVOT (SELECT symbol, fiscal_date, revenue, net_income, total_assets FROM fund) ON revenue, net_income, total_assets INTO NAME metric_name VALUE metric_value)""", 2)
def src_fundamentals(sp, sf):
    lines = ["revenue", "net_income", "total_assets"]
    return st.statement_lines(st.nest_statements(d.fundamentals(sp, sf), lines))


@query("src_macro", "SELECT date, R(urgent) AS urgent, R(high) AS high, R(medium) AS medium, R(unspecified) AS unspecified, R(low) AS low FROM macro_wide")
def src_macro(sp, sf):
    w = st.macro_by_date(d.macro(sp, sf), d.INDICATORS)
    return w.select("date", *[F.col(f"`{i}`").alias(n) for i, n in zip(d.INDICATORS, ("urgent", "high", "medium", "unspecified", "low"))])


@query("src_options_chain", """WITH c AS (SELECT symbol, date_trunc('month', ts)::TIMESTAMP AS expiry, price AS strike, quantity FROM trades)
 SELECT symbol, expiry, R(strike) AS strike, R(quantity) AS quantity FROM c QUALIFY expiry=min(expiry) OVER (PARTITION BY symbol)""")
def src_options_chain(sp, sf):
    c = d.trades(sp, sf).select("symbol", F.date_trunc("month", "ts").alias("expiry"), F.col("price").alias("strike"), "quantity")
    return b.nearest_expiry(c).select("symbol", "expiry", "strike", "quantity")


@query("src_index_sector_sets", "SELECT symbol, sector AS name, date, R(close) AS close FROM bars JOIN sectors USING (symbol)")
def src_index_sector_sets(sp, sf):
    m = d.sectors(sp, sf).select("symbol", F.col("sector").alias("name"))
    return b.index_and_sector_sets(d.bars(sp, sf).select("symbol", "date", "close"), m)


@query("sink_market_data", """SELECT symbol, date, R(close) AS close, R(adj_close) AS adjusted_close, R(ret) AS returns, R(log_ret) AS log_returns, year(date)::INT AS year FROM rets""")
def sink_market_data(sp, sf):
    p = new_path(sp, "market_data")
    store.store_market_data(d.bars(sp, sf), p)
    return sp.read.parquet(p).select("symbol", "date", "close", "adjusted_close", "returns", "log_returns", "year")


@query("sink_per_symbol", "SELECT symbol, fiscal_date, R(revenue) AS revenue, R(net_income) AS net_income FROM fund", 2)
def sink_per_symbol(sp, sf):
    p = new_path(sp, "per_symbol")
    df = d.fundamentals(sp, sf).select("symbol", "fiscal_date", "revenue", "net_income")
    store.store_per_symbol(df, p)
    return sp.read.parquet(p).withColumn("symbol", F.col("symbol").cast("bigint"))


_EAV = """WITH w AS (SELECT symbol, date, ret AS "return", CASE WHEN count(close) OVER w=20 THEN avg(close) OVER w END AS sma_20, volume AS volume_raw FROM rets
  WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING)),
 l AS (UNPIVOT w ON "return", sma_20, volume_raw INTO NAME feature_name VALUE feature_value),
 e AS (SELECT symbol, date, feature_name, feature_value, CASE WHEN contains(feature_name,'sma') THEN 'trend' WHEN contains(feature_name,'volume') THEN 'volume' ELSE 'other' END AS feature_category FROM l WHERE feature_value IS NOT NULL)"""


def _features(sp, sf):
    df = t.sma(d.rets(sp, sf), (20,)).select("symbol", "date", F.col("ret").alias("return"), "sma_20", F.col("volume").alias("volume_raw"))
    return store.to_eav(df, ["symbol", "date"], ["return", "sma_20", "volume_raw"], rules={"sma": "trend", "volume": "volume"})


@query("sink_eav", _EAV + " SELECT symbol, date, feature_name, R(feature_value) AS feature_value, feature_category FROM e", 5)
def sink_eav(sp, sf):
    p = new_path(sp, "features")
    store.store_eav(_features(sp, sf), p)
    return sp.read.parquet(p)


@query("sink_indicators", """SELECT symbol, date, R(close/nullif(lag(close,5) OVER s,0)-1) AS momentum_5, R(close/nullif(lag(close,10) OVER s,0)-1) AS momentum_10, R(close/nullif(lag(close,20) OVER s,0)-1) AS momentum_20,
 R(CASE WHEN count(close) OVER w5=5 THEN avg(close) OVER w5 END) AS sma_5, NULL::DOUBLE AS stoch_k FROM bars WINDOW s AS (PARTITION BY symbol ORDER BY date), w5 AS (PARTITION BY symbol ORDER BY date ROWS 4 PRECEDING)""", 5)
def sink_indicators(sp, sf):
    p = new_path(sp, "indicators")
    store.store_indicators(t.sma(t.momentum(d.bars(sp, sf)), (5,)), p)
    return sp.read.parquet(p).select("symbol", "date", "momentum_5", "momentum_10", "momentum_20", "sma_5", "stoch_k")


_RR = """WITH l AS (SELECT series, date, unnest([0,1,2])::INT AS regime_id, unnest([p0,p1,p2]) AS p, greatest(p0,p1,p2) AS c FROM reg)"""


@query("sink_regimes", _RR + " SELECT series, date, regime_id, R(p) AS regime_probability, 'regime_'||regime_id AS regime_name, 'v1.0' AS model_version, R(c) AS confidence_score FROM l")
def sink_regimes(sp, sf):
    p = new_path(sp, "regimes")
    store.store_regimes(d.regimes(sp, sf), p)
    return sp.read.parquet(p)


@query("sink_predictions", "SELECT symbol, date AS prediction_date, date+INTERVAL 1 DAY AS target_date, R(ret) AS prediction_value, 7::INT AS model_id FROM rets WHERE ret IS NOT NULL")
def sink_predictions(sp, sf):
    p = new_path(sp, "predictions")
    df = d.rets(sp, sf).where("ret is not null").select("symbol", F.col("date").alias("prediction_date"),
                                                        (F.col("date") + F.expr("INTERVAL 1 DAY")).alias("target_date"), F.col("ret").alias("prediction_value"))
    store.store_predictions(df, 7, p)
    return sp.read.parquet(p)


@query("read_market_data", f"SELECT symbol, date, {RB} FROM bars WHERE date>=TIMESTAMP '1995-01-01'")
def read_market_data(sp, sf):
    p = new_path(sp, "market_data")
    store.store_market_data(d.bars(sp, sf), p)
    return store.read_market_data(sp, p, None, "1995-01-01").select("symbol", "date", *BAR)


@query("read_features_wide", _EAV + """ SELECT symbol, date, R(max(feature_value) FILTER (feature_name='return')) AS "return", R(max(feature_value) FILTER (feature_name='sma_20')) AS sma_20 FROM e
 WHERE feature_name IN ('return','sma_20') GROUP BY symbol, date""", 5)
def read_features_wide(sp, sf):
    return store.read_features(_features(sp, sf), ["return", "sma_20"])


@query("read_regimes_wide", "SELECT series, date, R(p0) AS regime_0, R(p1) AS regime_1, R(p2) AS regime_2 FROM reg")
def read_regimes_wide(sp, sf):
    return store.read_regimes(store.regime_rows(d.regimes(sp, sf)), 3, version="v1.0")


_TS = [("lineitem", "l_shipdate", 11), ("orders", "o_orderdate", 6), ("events", "ts", 6), ("supplier", None, 4)]


@query("table_summary", " UNION ALL ".join(
    f"SELECT '{n}' AS table_name, count(*) AS rows, {k}::INT AS n_columns, {f'min({c})' if c else 'NULL::TIMESTAMP'} AS first_date, {f'max({c})' if c else 'NULL::TIMESTAMP'} AS last_date FROM {n}" for n, c, k in _TS))
def table_summary(sp, sf):
    return store.table_summary({n: (d.table(sp, sf, n), c) for n, c, _ in _TS})


@query("lineage_log", "SELECT 'bars' AS table_name, count(*) AS record_count FROM bars")
def lineage_log(sp, sf):
    p, log = new_path(sp, "bars"), new_path(sp, "lineage")
    store.write_with_lineage(d.bars(sp, sf), p, log, "bars")
    return sp.read.parquet(log).select("table_name", "record_count")


@query("retention_delete", "SELECT symbol, date, R(close) AS close FROM bars WHERE date>=TIMESTAMP '2001-12-31'-INTERVAL 365 DAY")
def retention_delete(sp, sf):
    p, kept = new_path(sp, "market_data"), new_path(sp, "market_data_kept")
    store.store_market_data(d.bars(sp, sf), p)
    store.retention_delete(sp, p, kept, 365, asof="2001-12-31")
    return sp.read.parquet(kept).select("symbol", "date", "close")


@query("json_columns", """SELECT symbol, round(avg(close),4) AS mean_close, count(*)::BIGINT AS n FROM bars GROUP BY symbol""", 4)
def json_columns(sp, sf):
    df = d.bars(sp, sf).groupBy("symbol").agg(F.round(F.avg("close"), 4).alias("mean_close"), F.count(F.lit(1)).alias("n"))
    packed = store.model_record(df, ["n"], ["mean_close"])
    return store.parse_model_record(packed, "n bigint", "mean_close double")
