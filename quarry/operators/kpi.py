"""Ledger KPIs.

Vocabulary: handle = sum(stake); payout = sum(gross_payout); gross profit =
handle - payout; net profit = gross - promo - fee - tax; hold = gross/handle;
margin = net/handle.

Plan notes. Every KPI is one hash aggregate over ``ledger`` (bet ⨝ cost on
``bet_id``). The aggregation is partial (map-side) so a hot grouping key only
produces one partial row per task. The bet/cost join is 1:1 on a unique key,
so it cannot skew; on a cluster both facts should be written bucketed by
``bet_id`` (``write_bucketed`` in sources/files.py) to remove that shuffle.
The q3/q4 star joins through legs keep the dimension sides small and let AQE
broadcast them after measuring their real size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.aggs import exact_ratio, exact_sum, money_div, money_sum, ratio_of_sums
from quarry.functions.scalar import month_start, replicate_hash


def ledger(bets: DataFrame, costs: DataFrame) -> DataFrame:
    """bet ⨝ cost with the derived profit columns."""
    c = costs.select("bet_id", "promo_cost", "payment_fee", "tax")
    return bets.join(c, "bet_id").withColumns({
        "gross_profit": F.col("stake_amount") - F.col("gross_payout"),
        "net_profit": F.col("stake_amount") - F.col("gross_payout") - F.col("promo_cost")
        - F.col("payment_fee") - F.col("tax"),
    })


def _profit_aggs(with_payout: bool = False, with_margin: bool = False, with_hold: bool = True):
    aggs = [money_sum("stake_amount").alias("handle")]
    if with_payout:
        aggs.append(money_sum("gross_payout").alias("payout"))
    aggs += [money_sum("gross_profit").alias("gross_profit"), money_sum("net_profit").alias("net_profit")]
    if with_hold:
        aggs.append(ratio_of_sums("gross_profit", "stake_amount").alias("hold_pct"))
    if with_margin:
        aggs.append(ratio_of_sums("net_profit", "stake_amount").alias("margin_pct"))
    return aggs


def monthly_profit(led: DataFrame) -> DataFrame:
    """I-K1: handle, payout, gross, net, hold and margin by calendar month."""
    return (led.groupBy(month_start("bet_datetime").alias("month"))
            .agg(*_profit_aggs(with_payout=True, with_margin=True))
            .orderBy("month"))


def profit_by_bet_type(led: DataFrame) -> DataFrame:
    """I-K2: bets, handle, gross, net and hold by bet type."""
    return (led.groupBy("bet_type")
            .agg(F.count(F.lit(1)).alias("bets"), *_profit_aggs())
            .orderBy(F.desc("net_profit")))


def exposure_through_legs(led: DataFrame, legs: DataFrame, events: DataFrame) -> DataFrame:
    """Ledger rows repeated once per leg with the leg's event (C12; stake counted per leg, Q2)."""
    lg = legs.select("bet_id", "event_id", "selection")
    return led.join(lg, "bet_id").join(events, "event_id")


def profit_by_week_playoff(led: DataFrame, legs: DataFrame, events: DataFrame) -> DataFrame:
    """I-K3: KPIs by (week, playoff) through legs and events."""
    ev = events.select("event_id", "week", "is_playoff").where(F.col("week").isNotNull())
    return (exposure_through_legs(led, legs, ev)
            .groupBy("week", "is_playoff").agg(*_profit_aggs())
            .orderBy("week", "is_playoff"))


def selected_team(selection, home_team_id, away_team_id):
    """The team a leg backs: home id for 'home', away id for 'away', else NULL.

    This is the equi-join key that replaces the reference's
    ``(sel='home' AND home=team) OR (sel='away' AND away=team)`` theta join (C6),
    which Spark would otherwise plan as a broadcast nested-loop join.
    """
    sel = F.col(selection) if isinstance(selection, str) else selection
    return (F.when(sel == "home", F.col(home_team_id))
            .when(sel == "away", F.col(away_team_id)))


def profit_by_team(led: DataFrame, legs: DataFrame, events: DataFrame, teams: DataFrame,
                   min_handle: float = 50_000.0) -> DataFrame:
    """I-K4: KPIs by the team of the selected side, groups with handle > ``min_handle``."""
    ev = events.select("event_id", "home_team_id", "away_team_id")
    x = exposure_through_legs(led, legs, ev).withColumn(
        "team_id", selected_team("selection", "home_team_id", "away_team_id"))
    # Legs are reduced to one row a team (map-side first) before the team's name is looked up.
    sums = ["stake_amount", "gross_profit", "net_profit"]
    by_team = x.where(F.col("team_id").isNotNull()).groupBy("team_id").agg(*[exact_sum(c).alias(c) for c in sums])
    total = {c: F.sum(c) for c in sums}
    return (by_team.join(teams.select("team_id", "team_name"), "team_id")
            .groupBy("team_name").agg(*[F.round(total[c], 2).cast("double").alias(a) for c, a in zip(sums, ("handle", "gross_profit", "net_profit"), strict=True)],
                                      exact_ratio(total["gross_profit"], total["stake_amount"]).alias("hold_pct"))
            .where(F.col("handle") > min_handle)
            .orderBy(F.desc("net_profit")))


def promo_profitability(led: DataFrame) -> DataFrame:
    """I-K5: promo-applied vs no-promo bets."""
    flag = F.when(F.col("promo_cost") > 0, "promo_applied").otherwise("no_promo")
    return (led.groupBy(flag.alias("promo_flag"))
            .agg(F.count(F.lit(1)).alias("bets"),
                 money_sum("stake_amount").alias("handle"),
                 money_sum("promo_cost").alias("promo_spend"),
                 money_sum("gross_profit").alias("gross_profit"),
                 money_sum("net_profit").alias("net_profit"),
                 ratio_of_sums("net_profit", "stake_amount").alias("margin_pct"))
            .orderBy("promo_flag"))


def customer_group_differences(led: DataFrame, customers: DataFrame) -> DataFrame:
    """I-K6: by segment, with distinct customers (D4) and average stake."""
    # Bets are reduced to one row a customer first, so each customer is counted once without a distinct over bets.
    sums = ["stake_amount", "gross_profit", "net_profit"]
    by_customer = led.groupBy("customer_id").agg(F.count(F.lit(1)).alias("bets"), F.count("stake_amount").alias("staked"),
                                                 *[exact_sum(c).alias(c) for c in sums])
    x = by_customer.join(customers.select("customer_id", "segment"), "customer_id")
    total = {c: F.sum(c) for c in sums}
    return (x.groupBy("segment")
            .agg(F.sum("bets").alias("bets"),
                 F.countDistinct("customer_id").alias("customers"),
                 F.round(total["stake_amount"], 2).cast("double").alias("handle"),
                 money_div(total["stake_amount"], F.sum("staked")).alias("avg_stake"),
                 F.round(total["gross_profit"], 2).cast("double").alias("gross_profit"),
                 F.round(total["net_profit"], 2).cast("double").alias("net_profit"),
                 exact_ratio(total["gross_profit"], total["stake_amount"]).alias("hold_pct"))
            .orderBy(F.desc("net_profit")))


def topline_economics(led: DataFrame) -> DataFrame:
    """I-K7: one row of handle, gross, promo, fee, tax, net."""
    return led.agg(
        *[money_sum(c).alias(a) for c, a in [
            ("stake_amount", "handle"), ("gross_profit", "gross_profit"), ("promo_cost", "promo_cost"),
            ("payment_fee", "payment_fee"), ("tax", "tax"), ("net_profit", "net_profit")]],
    )


def top_k(df: DataFrame, k: int, *order) -> DataFrame:
    """first ``k`` rows after sorting (planned as TakeOrderedAndProject: a bounded per-task top-k)."""
    return df.orderBy(*order).limit(k)


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """exactly ``n`` rows, repeatable for a seed on any engine: the ``n`` smallest integer hashes of (key, seed); ties by key."""
    return df.orderBy(replicate_hash(F.col(key).cast("long"), 0, seed), F.col(key)).limit(n)
