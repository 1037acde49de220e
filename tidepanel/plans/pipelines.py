"""End-to-end compositions: cleaning and feature building."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidepanel.core.frames import no_inf
from tidepanel.core.ordering import LIMIT, largest
from tidepanel.core.scratch import materialise
from tidepanel.operators import cleaning as c, cross_section as cs, quality as q, technical as t


def clean(bars: DataFrame, actions: DataFrame, start, end, universe_start, min_days: int = 500, max_gap: int = 5) -> DataFrame:
    """Clean, adjust, filter survivors, align to weekdays, fill gaps, winsorise flagged outliers."""
    df = c.clean_prices(bars).drop("extreme_move")
    df = c.adjust_splits(df, actions.where(F.col("action") == "split"))
    df = c.survivorship_filter(df, universe_start, min_days)
    df = c.align_calendar(df, start, end)
    df = c.impute_hybrid(df, max_gap=max_gap)
    return q.treat(q.flag(df, ["close"], "zscore"), ["close"], "winsorize")


def across(df: DataFrame, value: str, by_sector: bool, **known) -> DataFrame:
    """Rank, z-score and sector rank of a value among the symbols of its date."""
    df = cs.cs_zscore(cs.cs_rank(df, value, **known), value, **known)
    return cs.sector_rank(df, value, **known) if by_sector else df


def engineer(bars: DataFrame, sectors: DataFrame | None = None, max_missing: float | None = None) -> DataFrame:
    """Per-symbol features first (one exchange on symbol), then cross-sectional ones (one exchange on date).

    The largest date is counted on the bars: beyond the limit of the ranks the features are stored and dates are spread over tasks.
    """
    df = t.returns(bars)
    for step in (t.price_ratios, lambda x: t.sma(x, (5, 20, 50)), lambda x: t.momentum(x, (5, 20)), t.rsi,
                 lambda x: t.hist_vol(x, (20,)), t.volume_ma, t.obv, t.candles):
        df = df.transform(step)
    most = largest(bars, ["date"])
    if sectors is not None:
        sectors = sectors.select("symbol", "sector")
        most *= largest(sectors, ["symbol"])
    if most <= LIMIT:
        # nothing is stored: all figures of a date are windows of one exchange, and features that nobody reads are not made
        if sectors is not None:
            df = df.join(sectors, "symbol")
        df = across(df, "momentum_20", sectors is not None, most=most)
    else:
        df = materialise(df, "features")
        # ranks work on a narrow view of the stored table and come back in one join
        x = df.select("symbol", "date", "momentum_20")
        if sectors is not None:
            x = x.join(sectors, "symbol")
        df = df.join(across(x, "momentum_20", sectors is not None, base=x).drop("momentum_20"), ["symbol", "date"])
    keys = {"symbol", "date", "sector"}
    numeric = [f.name for f in df.schema.fields if f.dataType.simpleString() == "double" and f.name not in keys]
    df = df.withColumns({n: no_inf(n) for n in numeric})
    # finding the sparse columns reads the table once more
    return c.drop_sparse_columns(materialise(df, "features"), numeric, max_missing) if max_missing is not None else df
