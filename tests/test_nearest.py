"""Nearest prices across periods against plain search."""
import numpy as np
import pandas as pd

from tidepanel.operators.joins import nearest_price


def test_nearest_price_across_periods_ties_and_gaps(spark):
    rng = np.random.default_rng(12)
    days = pd.date_range("2019-06-01", "2022-06-01", freq="D")
    prices = pd.concat([pd.DataFrame({"symbol": s, "date": np.sort(rng.choice(days, n, False)), "close": rng.random(n)}) for s, n in (("a", 150), ("b", 6))])
    prices.loc[prices.index % 29 == 4, "close"] = np.nan
    orders = pd.DataFrame({"order_id": range(400), "symbol": rng.choice(["a", "a", "b", "none"], 400), "order_time": rng.choice(days, 400) + pd.to_timedelta(rng.choice([0, 12], 400), unit="h")})
    known = prices.dropna()
    got = nearest_price(spark.createDataFrame(orders), spark.createDataFrame(prices.astype(object).where(prices.notna(), None), "symbol string, date timestamp, close double"), keep_next=True)
    rows = {r["order_id"]: (r["market_price"], r["next_price"]) for r in got.collect()}
    assert len(rows) == len(orders)
    for o in orders.itertuples():
        p = known[known.symbol == o.symbol]
        low, high = p[p.date <= o.order_time].tail(1), p[p.date >= o.order_time].head(1)
        both = len(low) and len(high)
        first = low if (both and o.order_time - low.date.iloc[0] <= high.date.iloc[0] - o.order_time) or not len(high) else high
        assert rows[o.order_id] == (first.close.iloc[0] if len(first) else None, high.close.iloc[0] if len(high) else None)
    plan = nearest_price(spark.createDataFrame(orders), spark.createDataFrame(known), "order_time")
    assert plan.columns[:2] == ["symbol", "order_time"] and "next_price" not in plan.columns


def test_many_keys_and_periods_are_settled_at_once():
    import pyarrow as pa
    from tidepanel.operators.joins import _around
    rows = [("a", 5, 1.0, False, 0), ("b", 6, 2.0, False, 0), ("a", 6, None, True, 0), ("b", 4, None, True, 0), ("a", 7, 3.0, False, 1), ("a", 9, 4.0, False, 0), ("a", 9, None, True, 0), ("c", 1, None, True, 0)]
    got = _around(pa.Table.from_pylist([dict(zip(("symbol", "_ts", "_price", "_asks", "_b"), r)) for r in rows])).to_pylist()
    assert [tuple(r.values()) for r in got] == [("a", 6, 1.0, 4.0), ("b", 4, 2.0, 2.0), ("a", 9, 4.0, 4.0), ("c", 1, None, None)]
