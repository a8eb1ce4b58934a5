"""Promotion economics.

Plan notes. Everything starts from ``retention.daily_activity`` (one row per
customer and day, exact money sums), so the customer-keyed join below sees at
most one row per customer-day. The event windows of the reference - pre 4
weeks, post 4/13/26 weeks - become conditional sums over ``dd`` in ONE
aggregate (C15). The ROI bounds (max bet day) are a scalar subquery, not a join. The payback series has at most 26 weekly rows, so its
running total is a small global window (E5); the first crossing (E13) and the
first sustained run (E14, gaps-and-islands over row order) read that series.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.aggs import MONEY_TYPE, money_div
from quarry.operators.retention import daily_activity, first_days

SERVICING_OVERHEAD_PER_USER = 5.0  # fixed value: $ per promo user
POST_WINDOWS = {"4w": 28, "13w": 91, "26w": 182}
PRE_DAYS = 28


def _zero():
    return F.lit(0).cast(MONEY_TYPE)


def _money(c):
    return F.round(c, 2).cast("double")


def uplift_anchors(days: DataFrame) -> DataFrame:
    """Anchor per customer: first promo day (promo); for control first+28 if span >= 56, midpoint if span > 0, else first."""
    a = first_days(days)
    span = F.datediff("last_bet_date", "first_bet_date")
    control_anchor = (F.when(span >= 56, F.date_add("first_bet_date", 28))
                      .when(span > 0, F.date_add("first_bet_date", F.floor(span / 2.0).cast("int")))
                      .otherwise(F.col("first_bet_date")))
    is_promo = F.col("first_promo_date").isNotNull()
    return a.select("customer_id",
                    F.when(is_promo, "promo").otherwise("control").alias("cohort_type"),
                    F.when(is_promo, F.col("first_promo_date")).otherwise(control_anchor).alias("anchor_date"))


def user_uplift_exact(bets: DataFrame, costs: DataFrame, customers: DataFrame) -> DataFrame:
    """I-U1 with exact DECIMAL amounts (the input of I-U2, I-U3 and I-U7)."""
    days = daily_activity(bets, costs)
    anchors = uplift_anchors(days).join(customers.select("customer_id", "segment"), "customer_id")
    x = days.join(anchors, "customer_id").withColumn("dd", F.datediff("bet_date", "anchor_date"))
    pre = (F.col("dd") >= -PRE_DAYS) & (F.col("dd") < 0)
    post = {k: (F.col("dd") > 0) & (F.col("dd") <= n) for k, n in POST_WINDOWS.items()}

    def csum(cond, col):
        return F.sum(F.when(cond, F.col(col)).otherwise(_zero()))

    agg = x.groupBy("customer_id", "segment", "cohort_type", "anchor_date").agg(
        csum(pre, "handle").alias("handle_pre"),
        csum(post["4w"], "handle").alias("handle_post"),
        csum(pre, "net_profit").alias("net_profit_pre_4w"),
        *[csum(post[k], "net_profit").alias(f"net_profit_post_{k}") for k in POST_WINDOWS],
        *[csum(post[k], "promo_net").alias(f"direct_promo_net_post_{k}") for k in POST_WINDOWS],
        *[csum(post[k], "promo_cost").alias(f"promo_cost_post_{k}") for k in POST_WINDOWS],
        F.sum("handle").alias("lifetime_handle"),
        F.sum("net_profit").alias("lifetime_net_profit"),
    )
    four = F.lit(4).cast("decimal(2,0)")
    return agg.withColumns({
        "avg_weekly_handle_pre_4w": F.col("handle_pre") / four,
        "avg_weekly_handle_post_4w": F.col("handle_post") / four,
        "handle_delta_4w": (F.col("handle_post") - F.col("handle_pre")) / four,
    }).drop("handle_pre", "handle_post")


UPLIFT_MONEY_COLUMNS = (
    ["avg_weekly_handle_pre_4w", "avg_weekly_handle_post_4w", "handle_delta_4w", "net_profit_pre_4w"]
    + [f"net_profit_post_{k}" for k in POST_WINDOWS]
    + [f"direct_promo_net_post_{k}" for k in POST_WINDOWS]
    + [f"promo_cost_post_{k}" for k in POST_WINDOWS]
    + ["lifetime_handle", "lifetime_net_profit"])


def user_uplift(bets: DataFrame, costs: DataFrame, customers: DataFrame) -> DataFrame:
    """I-U1: one row per customer; amounts rounded to cents, four reserved NULL columns."""
    ex = user_uplift_exact(bets, costs, customers)
    null = F.lit(None).cast("double")
    return ex.select(
        "customer_id", "segment", "cohort_type", "anchor_date",
        *[_money(c).alias(c) for c in UPLIFT_MONEY_COLUMNS],
        null.alias("incremental_net_profit_4w"), null.alias("incremental_net_profit_13w"),
        null.alias("incremental_net_profit_26w"), null.alias("incremental_roi_4w"),
    )


def uplift_summary(uplift_exact: DataFrame) -> DataFrame:
    """I-U2: promo vs control averages of pre/post/delta handle and the post gap (G6, one aggregate)."""
    def total(cohort, col):
        return F.sum(F.when(F.col("cohort_type") == cohort, F.col(col)))

    def users(cohort):
        return F.count_if(F.col("cohort_type") == cohort)

    cols = (("avg_weekly_handle_pre_4w", "pre_handle"), ("avg_weekly_handle_post_4w", "post_handle"),
            ("handle_delta_4w", "delta_handle"))
    r = uplift_exact.agg(
        *[money_div(total(c, col), users(c), 4).alias(f"{c}_{name}") for c in ("promo", "control") for col, name in cols])
    return r.withColumn("post_handle_gap", F.round(F.col("promo_post_handle") - F.col("control_post_handle"), 4))


def max_bet_day(bets: DataFrame):
    """Last bet day as a scalar subquery column (no join)."""
    return bets.agg(F.max(F.to_date("bet_datetime")).alias("max_bet_date")).scalar()


def roi_scorecard(uplift_exact: DataFrame, bets: DataFrame, overhead: float = SERVICING_OVERHEAD_PER_USER) -> DataFrame:
    """I-U3: ROI at 4/13/26 weeks over promo users whose window is fully observed."""
    p = uplift_exact.where(F.col("cohort_type") == "promo")
    last = max_bet_day(bets)
    observed = {k: F.col("anchor_date") <= F.date_sub(last, n) for k, n in POST_WINDOWS.items()}

    def csum(k, col):
        return F.sum(F.when(observed[k], F.col(col)).otherwise(_zero()))

    base = p.agg(
        *[F.count_if(observed[k]).alias(f"promo_users_{k}") for k in POST_WINDOWS],
        *[csum(k, f"net_profit_post_{k}").alias(f"net_profit_total_{k}") for k in POST_WINDOWS],
        *[csum(k, f"direct_promo_net_post_{k}").alias(f"direct_promo_net_total_{k}") for k in POST_WINDOWS],
        *[csum(k, f"promo_cost_post_{k}").alias(f"promo_cost_total_{k}") for k in POST_WINDOWS],
    )
    oh = F.lit(overhead).cast(MONEY_TYPE)
    cols = [F.col(f"promo_users_{k}") for k in POST_WINDOWS]

    def ratio(num, den):
        return F.round(num.cast("double") / F.nullif(den.cast("double"), F.lit(0.0)), 6)

    out = []
    for k in POST_WINDOWS:
        users = F.col(f"promo_users_{k}")
        net = F.col(f"net_profit_total_{k}")
        direct = F.col(f"direct_promo_net_total_{k}")
        cost = F.col(f"promo_cost_total_{k}")
        after = net - users * oh
        out += [
            money_div(after, users).alias(f"net_profit_per_user_{k}"),
            _money(net).alias(f"net_profit_total_{k}"),
            _money(cost).alias(f"promo_cost_total_{k}"),
            _money(after).alias(f"net_after_promo_total_{k}"),
            _money(direct).alias(f"direct_promo_net_total_{k}"),
            _money(net + cost - users * oh).alias(f"operating_profit_before_promo_{k}"),
            ratio(direct - users * oh, cost).alias(f"roi_{k}"),
            ratio(direct, cost).alias(f"direct_promo_roi_{k}"),
            ratio(net + cost - users * oh, cost).alias(f"operating_roi_{k}"),
        ]
    return base.select(*cols, *out)


def payback_series(bets: DataFrame, costs: DataFrame, horizon_days: int = 180) -> DataFrame:
    """I-U4: weekly promo-tagged net after cost since each promo anchor, summed over users, cumulated."""
    days = daily_activity(bets, costs)
    anchors = (first_days(days).where(F.col("first_promo_date").isNotNull())
               .select("customer_id", F.col("first_promo_date").alias("anchor_date")))
    last = days.agg(F.max("bet_date")).scalar()
    eligible = anchors.where(F.col("anchor_date") <= F.date_sub(last, horizon_days))
    x = days.join(eligible, "customer_id").withColumn("dd", F.datediff("bet_date", "anchor_date")) \
        .where((F.col("dd") > 0) & (F.col("dd") <= horizon_days))
    weekly = x.groupBy((F.floor(F.col("dd") / 7) + 1).cast("long").alias("wk")) \
        .agg(F.sum("promo_net_after_cost").alias("net_after_promo"))
    w = Window.orderBy("wk").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # <= horizon/7+1 rows
    return weekly.select("wk", _money(F.sum("net_after_promo").over(w)).alias("cum_net_after_promo")).orderBy("wk")


def first_payback_week(series: DataFrame) -> DataFrame:
    """I-U5: first week whose cumulative value is >= 0 (NULL if never)."""
    return series.agg(F.min(F.when(F.col("cum_net_after_promo") >= 0, F.col("wk"))).alias("payback_week"))


def sustained_payback_week(series: DataFrame, run: int = 4) -> DataFrame:
    """I-U6: first week that starts ``run`` consecutive rows with cumulative >= 0 (rows, not weeks: Q10)."""
    w = Window.orderBy("wk")
    ok = F.col("cum_net_after_promo") >= 0
    x = series.select("wk", ok.alias("ok"), F.row_number().over(w).alias("rn"))
    x = x.withColumn("island", F.col("rn") - F.row_number().over(Window.partitionBy("ok").orderBy("wk")))
    islands = x.where("ok").groupBy("island").agg(F.min("wk").alias("start_wk"), F.count(F.lit(1)).alias("n"))
    return islands.agg(F.min(F.when(F.col("n") >= run, F.col("start_wk"))).alias("sustained_payback_week"))


def net_profit_bridge(uplift_exact: DataFrame) -> DataFrame:
    """I-U7: average post-window profit before promo, promo cost and net over promo users."""
    p = uplift_exact.where(F.col("cohort_type") == "promo")
    n = F.count(F.lit(1))

    def s(c):
        return F.sum(F.col(c))

    return p.agg(
        money_div(s("net_profit_post_4w") + s("promo_cost_post_4w"), n).alias("post_profit_before_promo"),
        money_div(s("promo_cost_post_4w"), n).alias("promo_cost_post_4w"),
        money_div(s("net_profit_post_4w"), n).alias("post_net_after_promo"),
    )
