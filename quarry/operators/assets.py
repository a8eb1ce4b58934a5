"""Asset-series summaries.

Input is a price history ``(asset, date, price, market_cap)``. Snapshots use a
grouped ``max_by`` (partial aggregate); per-asset series operators use windows
partitioned by asset over an already aggregated series (one row per asset and
period, so a group is bounded by the number of periods, not by raw rows).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DIGITS = 6
# Volatility bands of the risk tiers (std of period returns).
RISK_BANDS = (("conservative", 0.05), ("moderate", 0.15))


def _r(c):
    return F.round(c, DIGITS)


def as_of_snapshot(prices: DataFrame, as_of: str) -> DataFrame:
    """M1: latest price row per asset on or before ``as_of``."""
    p = prices.where(F.col("date") <= F.to_date(F.lit(as_of)))
    last = p.groupBy("asset").agg(F.max_by(F.struct("date", "price", "market_cap"), "date").alias("s"))
    return last.select("asset", "s.date", _r(F.col("s.price")).alias("price"), "s.market_cap")


def market_cap_range(snapshot: DataFrame, min_cap: float | None = None, max_cap: float | None = None) -> DataFrame:
    """M2: assets whose market cap lies in [min_cap, max_cap] (either bound optional)."""
    cond = F.lit(True)
    if min_cap is not None:
        cond = cond & (F.col("market_cap") >= min_cap)
    if max_cap is not None:
        cond = cond & (F.col("market_cap") <= max_cap)
    return snapshot.where(cond)


def portfolio_performance(prices: DataFrame, holdings: DataFrame) -> DataFrame:
    """M3: portfolio value per date (sum of quantity x price) and the period return."""
    v = prices.join(holdings, "asset").groupBy("date").agg(F.sum(F.col("quantity") * F.col("price")).alias("value"))
    w = Window.orderBy("date")  # one row per period
    return v.select("date", _r("value").alias("value"),
                    _r(F.col("value") / F.nullif(F.lag("value").over(w), F.lit(0.0)) - 1.0).alias("period_return")) \
        .orderBy("date")


def baseline_forecasts(prices: DataFrame, window: int = 3) -> DataFrame:
    """M4: naive (previous price) and moving-average (previous ``window`` prices) forecasts with MAPE per asset."""
    w = Window.partitionBy("asset").orderBy("date")
    prev = w.rowsBetween(-window, -1)
    x = prices.select("asset", "date", "price",
                      F.lag("price").over(w).alias("naive"),
                      F.when(F.count("price").over(prev) == window, F.avg("price").over(prev)).alias("moving_avg"))

    def ape(f):
        return F.abs(F.col("price") - F.col(f)) / F.nullif(F.abs(F.col("price")), F.lit(0.0))

    return x.groupBy("asset").agg(F.count("naive").alias("naive_points"),
                                  _r(F.avg(ape("naive")) * 100).alias("naive_mape"),
                                  F.count("moving_avg").alias("moving_avg_points"),
                                  _r(F.avg(ape("moving_avg")) * 100).alias("moving_avg_mape")).orderBy("asset")


def risk_tiers(prices: DataFrame) -> DataFrame:
    """M5: volatility (sample std of period returns) per asset and its risk tier."""
    w = Window.partitionBy("asset").orderBy("date")
    r = prices.select("asset", (F.col("price") / F.nullif(F.lag("price").over(w), F.lit(0.0)) - 1.0).alias("ret"))
    vol = r.groupBy("asset").agg(F.stddev_samp("ret").alias("volatility"))
    tier = F.lit("aggressive")
    for name, limit in reversed(RISK_BANDS):
        tier = F.when(F.col("volatility") < limit, name).otherwise(tier)
    return vol.select("asset", _r("volatility").alias("volatility"),
                      F.when(F.col("volatility").isNull(), None).otherwise(tier).alias("risk_tier")).orderBy("asset")
