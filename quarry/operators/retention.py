"""Customer retention and survival.

Plan notes. The reference evaluates one correlated ``EXISTS`` per window and
customer, and a 13x cross join for weekly survival. Here:

* bets are first reduced to one row per (customer, day) - a partial
  aggregate, so even a customer holding a third of all bets becomes at most
  one row per calendar day before anything is shuffled by customer;
* the anchor (first day) per customer is a grouped ``min`` over those days;
* days ⨝ anchors is one equi-join on ``customer_id`` (per-customer rows are
  bounded by the number of days, so it cannot skew badly; AQE splits what
  remains); ``dd = datediff(day, anchor)`` is computed once;
* every window is an integer test on ``dd`` inside ONE conditional aggregate
  (``max(when(a < dd <= b, 1))``) - no EXISTS per window, no range join;
* weekly survival buckets ``ceil(dd / 7)`` instead of crossing with weeks and
  fills empty weeks from a 13-week grid generated per segment (no join).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.aggs import exact_sum, money_div, rate

SEGMENT_ORDER = ("sharp", "regular", "casual")  # anything else sorts 4th (F2)
STILL_ACTIVE_WINDOWS = {"7d": (0, 7), "30d": (23, 30), "60d": (53, 60), "90d": (83, 90)}
CUMULATIVE_WINDOWS = {"7d": (0, 7), "30d": (0, 30), "90d": (0, 90)}


def segment_rank(col: str = "segment"):
    expr = None
    for i, s in enumerate(SEGMENT_ORDER, start=1):
        expr = F.when(F.col(col) == s, i) if expr is None else expr.when(F.col(col) == s, i)
    return expr.otherwise(len(SEGMENT_ORDER) + 1)


def daily_activity(bets: DataFrame, costs: DataFrame | None = None) -> DataFrame:
    """One row per (customer, day) with exact money sums; the pre-aggregate every cohort operator uses."""
    x = bets.select("bet_id", "customer_id", F.to_date("bet_datetime").alias("bet_date"), "stake_amount",
                    "gross_payout")
    if costs is None:
        return x.groupBy("customer_id", "bet_date").agg(F.count(F.lit(1)).alias("bets"),
                                                        exact_sum("stake_amount").alias("handle"))
    c = costs.select("bet_id", "promo_cost", "payment_fee", "tax")
    j = x.join(c, "bet_id")
    net = F.col("stake_amount") - F.col("gross_payout") - F.col("promo_cost") - F.col("payment_fee") - F.col("tax")
    before_promo = F.col("stake_amount") - F.col("gross_payout") - F.col("payment_fee") - F.col("tax")
    has_promo = F.col("promo_cost") > 0
    return j.groupBy("customer_id", "bet_date").agg(
        F.count(F.lit(1)).alias("bets"),
        exact_sum("stake_amount").alias("handle"),
        exact_sum(net).alias("net_profit"),
        exact_sum("promo_cost").alias("promo_cost"),
        F.max(has_promo).alias("has_promo"),
        exact_sum(F.when(has_promo, net).otherwise(F.lit(0.0))).alias("promo_net"),
        exact_sum(F.when(has_promo, before_promo - F.col("promo_cost")).otherwise(F.lit(0.0)))
        .alias("promo_net_after_cost"),
    )


def first_days(days: DataFrame) -> DataFrame:
    """Anchor per customer: first active day and first day with a promo bet (when present)."""
    aggs = [F.min("bet_date").alias("first_bet_date"), F.max("bet_date").alias("last_bet_date")]
    if "has_promo" in days.columns:
        aggs.append(F.min(F.when(F.col("has_promo"), F.col("bet_date"))).alias("first_promo_date"))
    return days.groupBy("customer_id").agg(*aggs)


def days_since_anchor(days: DataFrame, anchors: DataFrame, anchor_col: str) -> DataFrame:
    """days ⨝ anchors with ``dd = bet_date - anchor`` in whole days."""
    return days.join(anchors, "customer_id").withColumn("dd", F.datediff("bet_date", anchor_col))


def _window_flags(windows: dict[str, tuple[int, int]], prefix: str):
    return [F.max(F.when((F.col("dd") > lo) & (F.col("dd") <= hi), 1).otherwise(0)).alias(f"{prefix}_{k}")
            for k, (lo, hi) in windows.items()]


def _by_segment(bets: DataFrame, customers: DataFrame, windows, prefix: str,
                group_cols: Sequence[str] = ()) -> DataFrame:
    """Window flags per customer, averaged per segment (and per ``group_cols`` of the customer's bets)."""
    keys = ["customer_id", *group_cols]
    days = daily_activity(bets.withColumn("customer_id", F.struct(*[F.col(k) for k in keys]))) \
        if group_cols else daily_activity(bets)
    anchors = first_days(days).select("customer_id", "first_bet_date")
    per_customer = (days_since_anchor(days, anchors, "first_bet_date")
                    .groupBy("customer_id").agg(*_window_flags(windows, prefix)))
    users = anchors.join(per_customer, "customer_id")
    if group_cols:
        users = users.select(*[F.col(f"customer_id.{k}").alias(k) for k in keys],
                             *[c for c in users.columns if c != "customer_id"])
    users = users.join(customers.select("customer_id", "segment"), "customer_id")
    return (users.groupBy(*group_cols, "segment")
            .agg(F.count(F.lit(1)).alias("users"), *[rate(f"{prefix}_{k}").alias(f"{prefix}_{k}") for k in windows])
            .orderBy(*group_cols, segment_rank()))


def still_active_by_segment(bets: DataFrame, customers: DataFrame,
                            windows: dict[str, tuple[int, int]] = STILL_ACTIVE_WINDOWS,
                            group_cols: Sequence[str] = ()) -> DataFrame:
    """I-R1: share of each segment active in ``(lo, hi]`` days after the first bet."""
    return _by_segment(bets, customers, windows, "still_active", group_cols)


def cumulative_retention_by_segment(bets: DataFrame, customers: DataFrame,
                                    windows: dict[str, tuple[int, int]] = CUMULATIVE_WINDOWS) -> DataFrame:
    """I-R2: share of each segment with any bet in ``(0, n]`` days after the first bet."""
    return _by_segment(bets, customers, windows, "retention")


def weekly_survival(spark: SparkSession, bets: DataFrame, customers: DataFrame, weeks: int = 13) -> DataFrame:
    """I-R3: per segment and week ``w``, users active in ``(7(w-1), 7w]``; zero-filled grid."""
    days = daily_activity(bets)
    anchors = first_days(days).select("customer_id", "first_bet_date")
    seg = customers.select("customer_id", "segment")
    cohort = anchors.join(seg, "customer_id")
    active = (days_since_anchor(days, anchors, "first_bet_date")
              .where((F.col("dd") > 0) & (F.col("dd") <= 7 * weeks))
              .select("customer_id", F.ceil(F.col("dd") / 7).cast("int").alias("week_num"))
              .distinct()
              .join(seg, "customer_id")
              .groupBy("segment", "week_num").agg(F.count(F.lit(1)).alias("active_users")))
    base = cohort.groupBy("segment").agg(F.count(F.lit(1)).alias("cohort_users"))
    grid = base.withColumn("week_num", F.explode(F.sequence(F.lit(1), F.lit(weeks))))  # 13 rows per segment
    out = grid.join(active, ["segment", "week_num"], "left").select(
        "segment", "week_num", "cohort_users",
        F.coalesce("active_users", F.lit(0)).cast("long").alias("active_users"),
        F.round(F.coalesce("active_users", F.lit(0)).cast("double")
                / F.nullif(F.col("cohort_users").cast("double"), F.lit(0.0)), 6).alias("retention_rate"))
    return out.orderBy(segment_rank(), "week_num")


def promo_cohort_retention(bets: DataFrame, costs: DataFrame,
                           flag_days: Sequence[int] = (7, 30, 60, 90),
                           value_days: Sequence[int] = (30, 60)) -> DataFrame:
    """I-R4: cohorts by first promo day (promo) or first bet day (control), rolled up per cohort date/type."""
    days = daily_activity(bets, costs)
    a = first_days(days)
    anchors = a.select(
        "customer_id",
        F.coalesce("first_promo_date", "first_bet_date").alias("cohort_date"),
        F.when(F.col("first_promo_date").isNotNull(), "promo").otherwise("control").alias("cohort_type"))
    x = days_since_anchor(days, anchors, "cohort_date")
    within = {n: (F.col("dd") > 0) & (F.col("dd") <= n) for n in set(flag_days) | set(value_days)}
    zero = F.lit(0).cast("decimal(24,6)")
    per_customer = x.groupBy("customer_id", "cohort_date", "cohort_type").agg(
        *[F.max(F.when(within[n], 1).otherwise(0)).alias(f"retained_{n}d") for n in flag_days],
        *[F.sum(F.when(within[n], F.col("handle")).otherwise(zero)).alias(f"future_handle_{n}d") for n in value_days],
        *[F.sum(F.when(within[n], F.col("net_profit")).otherwise(zero)).alias(f"future_net_profit_{n}d")
          for n in value_days],
        F.sum("handle").alias("lifetime_handle"),
        F.sum("net_profit").alias("lifetime_net_profit"),
    )

    def avg_money(c):
        return money_div(F.sum(c), F.count(F.lit(1)))

    return (per_customer.groupBy("cohort_date", "cohort_type").agg(
        F.count(F.lit(1)).alias("users"),
        *[F.sum(f"retained_{n}d").cast("long").alias(f"retained_{n}d") for n in flag_days],
        *[rate(f"retained_{n}d").alias(f"retention_{n}d") for n in flag_days],
        *[avg_money(f"future_handle_{n}d").alias(f"avg_future_handle_{n}d") for n in value_days],
        *[avg_money(f"future_net_profit_{n}d").alias(f"avg_future_net_profit_{n}d") for n in value_days],
        avg_money("lifetime_handle").alias("avg_lifetime_handle"),
        avg_money("lifetime_net_profit").alias("avg_lifetime_net_profit"),
    ).orderBy("cohort_date", "cohort_type"))
