"""Scenario (multi-run) summaries.

The reference re-simulates a ledger per seed in a Python loop; here any ledger
with a ``run_id`` column is summarised in one distributed pass - every run is
just another grouping key of the same aggregates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.aggs import MONEY_TYPE, exact_sum, money_div
from quarry.operators.retention import STILL_ACTIVE_WINDOWS, still_active_by_segment

SEGMENTS = ("sharp", "regular", "casual", "promo_hunter")
DIGITS = 6
# Target still-active shares per segment used to score a configuration (I-V3).
RETENTION_TARGETS = {
    "sharp": {"7d": 0.72, "30d": 0.58, "60d": 0.42, "90d": 0.28},
    "regular": {"7d": 0.40, "30d": 0.20, "60d": 0.08, "90d": 0.03},
    "casual": {"7d": 0.18, "30d": 0.06, "60d": 0.01, "90d": 0.00},
    "promo_hunter": {"7d": 0.14, "30d": 0.03, "60d": 0.00, "90d": 0.00},
}


def _ratio(a, b):
    return F.round(a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0)), DIGITS)


def run_kpis(bets: DataFrame, costs: DataFrame, customers: DataFrame, run_col: str = "run_id") -> DataFrame:
    """I-V1: handle, hold, net margin, promo rate and 16 still-active cells per run."""
    c = costs.select("bet_id", "promo_cost", "payment_fee", "tax")
    x = bets.join(c, "bet_id")
    gross = F.col("stake_amount") - F.col("gross_payout")
    net = gross - F.col("promo_cost") - F.col("payment_fee") - F.col("tax")
    money = x.groupBy(run_col).agg(exact_sum("stake_amount").alias("h"), exact_sum(gross).alias("g"),
                                   exact_sum(net).alias("n"), exact_sum("promo_cost").alias("p"))
    money = money.select(run_col, F.round("h", 2).cast("double").alias("handle"),
                         _ratio(F.col("g"), F.col("h")).alias("hold"), _ratio(F.col("n"), F.col("h")).alias("net_margin"),
                         _ratio(F.col("p"), F.col("h")).alias("promo_rate"))
    ret = still_active_by_segment(bets, customers, group_cols=[run_col])
    cells = [F.coalesce(F.max(F.when(F.col("segment") == s, F.col(f"still_active_{k}"))), F.lit(0.0))
             .alias(f"{s}_still_active_{k}") for s in SEGMENTS for k in STILL_ACTIVE_WINDOWS]
    wide = ret.groupBy(run_col).agg(*cells)
    return money.join(wide, run_col, "left").orderBy(run_col)


def sensitivity_bands(runs: DataFrame, metrics: Sequence[str], quantiles: Sequence[float] = (0.1, 0.5, 0.9)) -> DataFrame:
    """I-V2: mean and interpolated quantiles per metric across runs, NULLs dropped."""
    long = runs.unpivot([], list(metrics), "metric", "value").where(F.col("value").isNotNull())
    q = F.percentile("value", F.array(*[F.lit(v) for v in quantiles]))
    agg = long.groupBy("metric").agg(money_div(F.sum(F.col("value").cast(MONEY_TYPE)), F.count("value"), DIGITS).alias("mean"), q.alias("__q"))
    return agg.select("metric", "mean", *[F.round(F.col("__q")[i], DIGITS).alias(f"p{int(v * 100)}")
                                          for i, v in enumerate(quantiles)]).orderBy("metric")


def calibration_fit(runs: DataFrame, run_col: str = "run_id",
                    targets: dict[str, dict[str, float]] = RETENTION_TARGETS) -> DataFrame:
    """I-V3: sum of squared differences to the target shares per run (configuration) and the best run."""
    sq = None
    for seg, cells in targets.items():
        for k, t in cells.items():
            term = F.pow(F.col(f"{seg}_still_active_{k}") - F.lit(t), 2)
            sq = term if sq is None else sq + term
    scored = runs.select(run_col, F.round(sq, DIGITS).alias("fit_score"))
    best = scored.agg(F.min_by(run_col, F.struct("fit_score", run_col))).scalar()
    return scored.select(run_col, "fit_score", (F.col(run_col) == best).alias("is_best")).orderBy("fit_score", run_col)
