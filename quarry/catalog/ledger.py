"""Registered ledger KPI queries (I-K1, I-K2, I-K5, I-K6, I-K7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.aggs import money_sum
from quarry.functions.aggs import sql_exact_avg as AVG
from quarry.functions.aggs import sql_money_sum as MS
from quarry.functions.aggs import sql_ratio_of_sums as RS
from quarry.functions.scalar import HASH_PRIME, clip, fmt_money, fmt_pct, money_compact
from quarry.operators import kpi
from quarry.plans.registry import register
from quarry.sources import fixtures as fx
from quarry.sources import files
from quarry.sources.fixture_sql import with_fixtures
from quarry.sources.tables import table


def ledger(spark, sf):
    return kpi.ledger(fx.fact_bet(spark, sf), fx.fact_bet_cost(spark, sf))


LEDGER_SQL = """
ledger AS (
  SELECT b.*, c.promo_cost, c.payment_fee, c.tax,
         b.stake_amount - b.gross_payout AS gross_profit,
         b.stake_amount - b.gross_payout - c.promo_cost - c.payment_fee - c.tax AS net_profit
  FROM fact_bet b JOIN fact_bet_cost c ON b.bet_id = c.bet_id)"""


def ledger_sql(body: str, *more: str, extra: str = "") -> str:
    ctes = LEDGER_SQL + ((",\n" + extra.strip()) if extra.strip() else "")
    return with_fixtures(body, "fact_bet", "fact_bet_cost", *more, extra=ctes)


@register("ik1_monthly_profit", ledger_sql(f"""
SELECT CAST(date_trunc('month', bet_datetime) AS DATE) AS month,
       {MS('stake_amount')} AS handle, {MS('gross_payout')} AS payout,
       {MS('gross_profit')} AS gross_profit, {MS('net_profit')} AS net_profit,
       {RS('gross_profit', 'stake_amount')} AS hold_pct,
       {RS('net_profit', 'stake_amount')} AS margin_pct
FROM ledger GROUP BY 1 ORDER BY 1"""))
def ik1_monthly_profit(spark, sf):
    return kpi.monthly_profit(ledger(spark, sf))


@register("ik2_profit_by_bet_type", ledger_sql(f"""
SELECT bet_type, count(*) AS bets, {MS('stake_amount')} AS handle,
       {MS('gross_profit')} AS gross_profit, {MS('net_profit')} AS net_profit,
       {RS('gross_profit', 'stake_amount')} AS hold_pct
FROM ledger GROUP BY 1 ORDER BY net_profit DESC"""))
def ik2_profit_by_bet_type(spark, sf):
    return kpi.profit_by_bet_type(ledger(spark, sf))


@register("ik5_promo_profitability", ledger_sql(f"""
SELECT CASE WHEN promo_cost > 0 THEN 'promo_applied' ELSE 'no_promo' END AS promo_flag,
       count(*) AS bets, {MS('stake_amount')} AS handle, {MS('promo_cost')} AS promo_spend,
       {MS('gross_profit')} AS gross_profit, {MS('net_profit')} AS net_profit,
       {RS('net_profit', 'stake_amount')} AS margin_pct
FROM ledger GROUP BY 1 ORDER BY 1"""))
def ik5_promo_profitability(spark, sf):
    return kpi.promo_profitability(ledger(spark, sf))


@register("ik6_customer_group_differences", ledger_sql(f"""
SELECT d.segment, count(*) AS bets, count(DISTINCT l.customer_id) AS customers,
       {MS('stake_amount')} AS handle, {AVG('stake_amount')} AS avg_stake,
       {MS('gross_profit')} AS gross_profit, {MS('net_profit')} AS net_profit,
       {RS('gross_profit', 'stake_amount')} AS hold_pct
FROM ledger l JOIN dim_customer d ON l.customer_id = d.customer_id
GROUP BY 1 ORDER BY net_profit DESC""", "dim_customer"))
def ik6_customer_group_differences(spark, sf):
    return kpi.customer_group_differences(ledger(spark, sf), fx.dim_customer(spark, sf))


@register("ik7_topline_economics", ledger_sql(f"""
SELECT {MS('stake_amount')} AS handle, {MS('gross_profit')} AS gross_profit,
       {MS('promo_cost')} AS promo_cost, {MS('payment_fee')} AS payment_fee,
       {MS('tax')} AS tax, {MS('net_profit')} AS net_profit
FROM ledger"""))
def ik7_topline_economics(spark, sf):
    return kpi.topline_economics(ledger(spark, sf))


@register("f3_top15_teams_by_net_profit")
def f3_top15_teams_by_net_profit(spark, sf):
    """Head of the by-team table (the reference charts its first 15 rows)."""
    from quarry.catalog.warehouse import dim_team

    by_team = kpi.profit_by_team(ledger(spark, sf), fx.fact_bet_leg(spark, sf, numbered=False), fx.dim_event(spark, sf),
                                 dim_team(spark, sf))
    return kpi.top_k(by_team, 15, F.desc("net_profit"), "team_name")


def _draw_sql(key: str, seed: int) -> str:
    x = f"(({key}) % {HASH_PRIME} * 1103 + {seed}) % {HASH_PRIME}"
    x = f"(({x}) * ({x}) + 12345 * ({x}) + 1) % {HASH_PRIME}"
    return f"(({x}) * ({x}) + 54321 * ({x}) + 7) % {HASH_PRIME}"


@register("f5_seeded_customer_sample", with_fixtures(
    f"SELECT * FROM dim_customer ORDER BY {_draw_sql('CAST(customer_id AS BIGINT)', 7)}, customer_id LIMIT 1000", "dim_customer"))
def f5_seeded_customer_sample(spark, sf):
    """1000 customers, exact and repeatable for the seed (calibration sample)."""
    return kpi.seeded_sample(fx.dim_customer(spark, sf), "customer_id", 1000, seed=7)


@register("h9_clip_exp_log", """
SELECT p_partkey, least(greatest(p_retailprice, 950.0), 1400.0) AS clipped, round(exp(0.0 - p_retailprice / 1000.0), 9) AS decayed,
       round(ln(p_retailprice), 9) AS logged FROM part""")
def h9_clip_exp_log(spark, sf):
    """Prices held within bounds, as an exponential decay and as a logarithm."""
    p = F.col("p_retailprice")
    return table(spark, sf, "part", "p_partkey", "p_retailprice").select(
        "p_partkey", clip(p, 950.0, 1400.0).alias("clipped"), F.round(F.exp(0.0 - p / 1000.0), 9).alias("decayed"), F.round(F.ln(p), 9).alias("logged"))


@register("h11_money_and_percent_texts", """
SELECT c_custkey, format('{:,.2f}', c_acctbal / 10000.0 * 100) || '%' AS share,
       CASE WHEN c_acctbal < 0 THEN '-$' ELSE '$' END || format('{:,.0f}', abs(c_acctbal)) AS amount,
       '$' || CASE WHEN abs(c_acctbal * 400) >= 1000000 THEN format('{:.1f}', c_acctbal * 400 / 1000000.0) || 'M'
                   WHEN abs(c_acctbal * 400) >= 1000 THEN format('{:.1f}', c_acctbal * 400 / 1000.0) || 'K' ELSE format('{:.0f}', c_acctbal * 400) END AS compact
FROM customer""")
def h11_money_and_percent_texts(spark, sf):
    """Balances as percentages, whole amounts and compact amounts."""
    b = F.col("c_acctbal")
    return table(spark, sf, "customer", "c_custkey", "c_acctbal").select(
        "c_custkey", fmt_pct(b / 10000.0).alias("share"), fmt_money(b).alias("amount"), money_compact(b * 400).alias("compact"))


@register("a6_stored_view", ledger_sql(f"""
SELECT bet_type, count(*) AS bets, {MS('stake_amount')} AS handle FROM ledger GROUP BY bet_type"""))
def a6_stored_view(spark, sf):
    """The ledger stored as an external table, a view over it stored in the catalog, and a query of the view by name."""
    path = files.scratch_path(spark, "ledger")
    files.materialize(ledger(spark, sf).select("bet_id", "bet_type", "stake_amount"), path)
    name = "quarry_" + path.rsplit("-", 1)[1]
    spark.sql(f"CREATE TABLE {name}_ledger USING parquet LOCATION '{path}'")
    spark.sql(f"CREATE OR REPLACE VIEW {name}_stakes AS SELECT bet_type, bet_id, stake_amount FROM {name}_ledger")
    return spark.table(f"{name}_stakes").groupBy("bet_type").agg(F.count(F.lit(1)).alias("bets"), money_sum("stake_amount").alias("handle"))
