"""Statement-based ratios, growth, quality and scores, one row per symbol or period."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidepanel.core.frames import attach, change, div, ordered
from tidepanel.operators.technical import history_rank

GROWTH_LINES = ("revenue", "gross_profit", "operating_income", "net_income", "ebitda", "total_assets", "total_equity")


def latest(statements: DataFrame, time="fiscal_date") -> DataFrame:
    cols = [c for c in statements.columns if c != "symbol"]
    return statements.groupBy("symbol").agg(*[F.max_by(c, time).alias(c) for c in cols])


def ratio_columns() -> dict[str, Column]:
    c = F.col
    cap = c("price") * c("shares")
    ev = cap + c("total_debt") - c("cash")
    income_growth = F.when(c("prior_income") > 0, div("net_income", "prior_income") - 1)
    return {
        "gross_margin": div("gross_profit", "revenue"), "operating_margin": div("operating_income", "revenue"),
        "net_margin": div("net_income", "revenue"), "roa": div("net_income", "total_assets"),
        "roe": div("net_income", "total_equity"), "current_ratio": div("current_assets", "current_liabilities"),
        "quick_ratio": div(c("current_assets") - c("inventory"), "current_liabilities"),
        "cash_ratio": div("cash", "current_liabilities"), "debt_to_assets": div("total_debt", "total_assets"),
        "debt_to_equity": div("total_debt", "total_equity"), "asset_turnover": div("revenue", "total_assets"),
        "inventory_turnover": div(c("revenue") - c("gross_profit"), "inventory"),
        "pe_ratio": div(cap, "net_income"), "pb_ratio": div(cap, "total_equity"), "ps_ratio": div(cap, "revenue"),
        "ev_revenue": div(ev, "revenue"), "ev_operating": div(ev, "operating_income"),
        "ebitda_margin": div("ebitda", "revenue"), "ev_ebitda": div(ev, "ebitda"),
        "forward_pe": div(cap, c("net_income") * (1 + income_growth)),
        "peg_ratio": div(div(cap, "net_income"), 100 * income_growth),
        "dividend_yield": div("dividends", cap), "payout_ratio": div("dividends", "net_income")}


def ratios(statements: DataFrame) -> DataFrame:
    """Profitability, liquidity, leverage, efficiency, market and dividend ratios of the latest statement.

    Forward earnings carry the last growth of net income on; the two ratios built on it are null where the income before was not positive.
    """
    prior = F.lag("net_income").over(ordered("symbol", "fiscal_date"))
    df = latest(statements.withColumn("prior_income", prior))
    r = ratio_columns()
    return df.select("symbol", *[e.alias(n) for n, e in r.items()])


def growth(statements: DataFrame, lines=GROWTH_LINES, time="fiscal_date") -> DataFrame:
    """Latest growth, 3- and 5-period averages and deviation of period growth rates per line."""
    df = statements.withColumns({f"_g_{l}": change(l, 1, "symbol", time) for l in lines})
    # newest first among periods that have a rate
    w = Window.partitionBy("symbol").orderBy(F.col(time).desc())
    df = df.withColumns({f"_i_{l}": F.count(f"_g_{l}").over(w) for l in lines})
    aggs = []
    for l in lines:
        g, i = F.col(f"_g_{l}"), F.col(f"_i_{l}")
        n = F.count(g)
        aggs += [F.max(F.when(i == 1, g)).alias(f"{l}_growth_1y"),
                 F.when(n >= 3, F.avg(F.when(i <= 3, g))).alias(f"{l}_growth_3y_avg"),
                 F.when(n >= 5, F.avg(g)).alias(f"{l}_growth_5y_avg"),
                 F.when(n > 1, F.stddev_pop(g)).alias(f"{l}_growth_volatility")]
    return df.groupBy("symbol").agg(*aggs)


def valuation(statements: DataFrame) -> DataFrame:
    df = latest(statements)
    cap = F.col("price") * F.col("shares")
    ev = cap + F.col("total_debt") - F.col("cash")
    return df.select("symbol", cap.alias("market_cap"), ev.alias("enterprise_value"),
                     div(cap, "total_equity").alias("price_to_book"), div(cap, "revenue").alias("price_to_sales"),
                     div(ev, "operating_income").alias("ev_to_operating"), div(ev, "revenue").alias("ev_to_revenue"),
                     div("price", div("total_equity", "shares")).alias("price_to_book_calculated"))


def quality(statements: DataFrame, time="fiscal_date") -> DataFrame:
    """Profitability, financial strength and earnings quality; the overall score averages the weighted parts."""
    df = statements.withColumn("_roe", div("net_income", "total_equity"))
    last = F.struct(*[F.col(c) for c in ("total_debt", "total_assets", "current_assets", "current_liabilities",
                                         "operating_cash_flow", "net_income")])
    g = df.groupBy("symbol").agg(
        F.avg(F.when(F.col("net_income") > 0, 1.0).otherwise(0.0)).alias("_pos"),
        F.stddev_samp("_roe").alias("_vol"), F.max_by(last, time).alias("l"))
    one = F.lit(1.0)
    prof = (F.col("_pos") + F.coalesce(1 / (1 + F.col("_vol")), F.lit(0.0))) / 2
    debt, cur = div("l.total_debt", "l.total_assets"), div("l.current_assets", "l.current_liabilities")
    strength = (F.when(debt.isNotNull(), 1 - F.least(debt, one)).otherwise(0.0)
                + F.when(cur.isNotNull(), F.least(cur / 2, one)).otherwise(0.0)) / 2
    cf = div("l.operating_cash_flow", "l.net_income")
    earn = F.when(F.col("l.net_income") > 0, F.least(cf, F.lit(2.0)) / 2).otherwise(0.0)
    g = g.select("symbol", prof.alias("profitability_quality"), strength.alias("financial_strength"), earn.alias("earnings_quality"))
    return g.withColumn("overall_quality", (F.col("profitability_quality") * 0.4 + F.col("financial_strength") * 0.4
                                            + F.col("earnings_quality") * 0.2) / 3)


def matrix(quarterly: DataFrame, yearly: DataFrame, sectors: DataFrame) -> DataFrame:
    """One row per symbol: sector, value, ratios, growth and quality."""
    r = ratios(quarterly).select("symbol", "pe_ratio", "pb_ratio", "ps_ratio", "roe", "roa", "debt_to_equity", "current_ratio",
                                 "gross_margin", "operating_margin", "net_margin")
    g = growth(yearly, ("revenue", "net_income")).select("symbol", "revenue_growth_1y", "revenue_growth_3y_avg",
                                                         "net_income_growth_1y", "net_income_growth_3y_avg")
    q = quality(quarterly).select("symbol", "profitability_quality", "financial_strength", "overall_quality")
    v = valuation(quarterly).select("symbol", "market_cap")
    return sectors.join(v, "symbol").join(r, "symbol").join(g, "symbol").join(q, "symbol")


SCORES = ["roe", "roa", "gross_margin", "operating_margin", "net_margin", "current_ratio", "revenue_growth_1y",
          "net_income_growth_1y", "profitability_quality", "financial_strength", "overall_quality"]
INVERSE = ["pe_ratio", "pb_ratio", "ps_ratio", "debt_to_equity"]
GROUPS = {"profitability": ["roe", "roa", "gross_margin", "operating_margin", "net_margin", "profitability_quality"],
          "valuation": ["pe_ratio", "pb_ratio", "ps_ratio"],
          "growth": ["revenue_growth_1y", "net_income_growth_1y"],
          "quality": ["profitability_quality", "financial_strength", "overall_quality", "current_ratio"]}


def row_mean(cols: list[Column]) -> Column:
    known = F.filter(F.array(*cols), lambda v: v.isNotNull())
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, v: a + v) / F.size(known))


def scores(m: DataFrame) -> DataFrame:
    """Min-max scores (inverted where low is good), group composites and the overall score."""
    stat = m.groupBy().agg(*[f(c).alias(f"_{t}_{c}") for c in SCORES + INVERSE for f, t in ((F.min, "lo"), (F.max, "hi"))])
    df = attach(m, stat)
    s = {}
    for c in SCORES + INVERSE:
        z = div(F.col(c) - F.col(f"_lo_{c}"), F.col(f"_hi_{c}") - F.col(f"_lo_{c}"))
        s[f"{c}_score"] = 1 - z if c in INVERSE else z
    df = df.select("symbol", "sector", *[e.alias(n) for n, e in s.items()])
    df = df.withColumns({f"{g}_composite": row_mean([F.col(f"{c}_score") for c in cs]) for g, cs in GROUPS.items()})
    return df.withColumn("overall_score", row_mean([F.col(f"{g}_composite") for g in GROUPS]))


def ratio_features(statements: DataFrame, cols=("net_margin", "roe", "roa"), time="fiscal_date") -> DataFrame:
    """Ratio, its period change and its rank in the symbol's own history."""
    r = ratio_columns()
    df = statements.select("symbol", F.col(time), *[r[c].alias(f"fundamental_{c}") for c in cols])
    for c in cols:
        df = df.withColumn(f"fundamental_{c}_trend", change(f"fundamental_{c}", 1, "symbol", time))
        df = history_rank(df, f"fundamental_{c}", f"fundamental_{c}_rank")
    return df


def signals(statements: DataFrame, overview: DataFrame, numeric: list[str], time="fiscal_date") -> DataFrame:
    """Overview fields coerced to numbers (bad text becomes null) and latest revenue and earnings growth."""
    prev = ordered("symbol", time)
    g = statements.withColumns({
        "revenue_growth": div(F.col("revenue") - F.lag("revenue").over(prev), F.lag("revenue").over(prev)),
        "earnings_growth": div(F.col("net_income") - F.lag("net_income").over(prev), F.abs(F.lag("net_income").over(prev)))})
    g = g.groupBy("symbol").agg(F.max_by("revenue_growth", time).alias("revenue_growth"),
                                F.max_by("earnings_growth", time).alias("earnings_growth"))
    o = overview.select("symbol", *[F.col(c).try_cast("double").alias(c) for c in numeric])
    return g.join(o, "symbol", "left")
