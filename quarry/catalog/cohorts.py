"""Registered retention and promotion queries (I-R1..I-R4, I-U1..I-U7).

The oracle statements work from one row per customer and day: the day's distance
to the anchor is taken once, windows are rows of a VALUES list joined by range, and
the sums are pivoted at the end.
"""

from __future__ import annotations

from quarry.functions.aggs import sql_money_div as MDIV
from quarry.operators import promo, retention
from quarry.plans.registry import register
from quarry.sources import fixtures as fx
from quarry.sources.fixture_sql import with_fixtures


def _bets(spark, sf):
    return fx.fact_bet(spark, sf)


def _costs(spark, sf):
    return fx.fact_bet_cost(spark, sf)


SEGMENT_ORDER_SQL = "CASE segment WHEN 'sharp' THEN 1 WHEN 'regular' THEN 2 WHEN 'casual' THEN 3 ELSE 4 END"


# Days from a customer's first bet to each of the days with a bet, and the customers of each segment.
SINCE_FIRST_SQL = """
bet_days AS (
  SELECT DISTINCT customer_id, segment, CAST(bet_datetime AS DATE) AS day FROM fact_bet JOIN dim_customer USING (customer_id)),
since_first AS (
  SELECT customer_id, segment, date_diff('day', min(day) OVER (PARTITION BY customer_id), day) AS dd FROM bet_days),
segment_users AS (SELECT segment, count(DISTINCT customer_id) AS users FROM since_first GROUP BY segment)"""


def _values(windows: dict) -> str:
    return ", ".join(f"('{name}', {low}, {high})" for name, (low, high) in windows.items())


def _segment_windows_sql(windows: dict, prefix: str) -> str:
    cols = ", ".join(f"round(coalesce(max(n) FILTER (WHERE span = '{k}'), 0) / CAST(users AS DOUBLE), 6) AS {prefix}_{k}"
                     for k in windows)
    return with_fixtures(f"""
SELECT u.segment, users, {cols}
FROM segment_users u LEFT JOIN returned r ON u.segment IS NOT DISTINCT FROM r.segment
GROUP BY u.segment, users ORDER BY {SEGMENT_ORDER_SQL.replace('segment', 'u.segment')}""", "fact_bet", "dim_customer",
                         extra=SINCE_FIRST_SQL + f""",
spans(span, after, upto) AS (VALUES {_values(windows)}),
returned AS (
  SELECT segment, span, count(DISTINCT customer_id) AS n FROM since_first JOIN spans ON dd > after AND dd <= upto GROUP BY ALL)""")


@register("ir1_still_active_retention", _segment_windows_sql(retention.STILL_ACTIVE_WINDOWS, "still_active"))
def ir1_still_active_retention(spark, sf):
    return retention.still_active_by_segment(_bets(spark, sf), fx.dim_customer(spark, sf))


@register("ir2_cumulative_retention", _segment_windows_sql(retention.CUMULATIVE_WINDOWS, "retention"))
def ir2_cumulative_retention(spark, sf):
    return retention.cumulative_retention_by_segment(_bets(spark, sf), fx.dim_customer(spark, sf))


@register("ir3_weekly_survival", with_fixtures(f"""
SELECT segment, week_num, users AS cohort_users, coalesce(n, 0) AS active_users,
       round(coalesce(n, 0) / CAST(users AS DOUBLE), 6) AS retention_rate
FROM (SELECT segment, users, CAST(unnest(range(1, 14)) AS INTEGER) AS week_num FROM segment_users) grid
LEFT JOIN (SELECT segment, CAST(ceil(dd / 7.0) AS INTEGER) AS week_num, count(DISTINCT customer_id) AS n
           FROM since_first WHERE dd > 0 GROUP BY ALL) active USING (segment, week_num)
ORDER BY {SEGMENT_ORDER_SQL}, week_num""", "fact_bet", "dim_customer", extra=SINCE_FIRST_SQL))
def ir3_weekly_survival(spark, sf):
    return retention.weekly_survival(spark, _bets(spark, sf), fx.dim_customer(spark, sf))


# One row per customer and day with exact money, shared by the promo oracles.
LEDGER_DAYS_SQL = """
ledger_days AS (
  SELECT customer_id, CAST(bet_datetime AS DATE) AS day, bool_or(promo_cost > 0) AS has_promo,
         sum(CAST(stake_amount AS DECIMAL(24,6))) AS handle, sum(CAST(promo_cost AS DECIMAL(24,6))) AS promo,
         sum(CAST(stake_amount - gross_payout - promo_cost - payment_fee - tax AS DECIMAL(24,6))) AS net,
         sum(CAST(stake_amount - gross_payout - promo_cost - payment_fee - tax AS DECIMAL(24,6)))
           FILTER (WHERE promo_cost > 0) AS promo_net,
         sum(CAST((stake_amount - gross_payout - payment_fee - tax) - promo_cost AS DECIMAL(24,6)))
           FILTER (WHERE promo_cost > 0) AS promo_net_after
  FROM fact_bet JOIN fact_bet_cost USING (bet_id) GROUP BY ALL)"""

# Days from the first promo bet (else the first bet) of a customer.
COHORT_DAYS_SQL = LEDGER_DAYS_SQL + """,
cohorts AS (
  SELECT customer_id, coalesce(min(day) FILTER (WHERE has_promo), min(day)) AS cohort_date,
         CASE WHEN bool_or(has_promo) THEN 'promo' ELSE 'control' END AS cohort_type
  FROM ledger_days GROUP BY customer_id),
cohort_days AS (
  SELECT c.*, date_diff('day', cohort_date, day) AS dd, handle, net, promo_net_after FROM cohorts c JOIN ledger_days USING (customer_id))"""


def _within(col: str, days: int) -> str:
    return f"coalesce(max({col}) FILTER (WHERE days = {days}), 0)"


_HORIZONS = (7, 30, 60, 90)


@register("ir4_promo_cohort_retention", with_fixtures(f"""
SELECT cohort_date, cohort_type, users,
       {", ".join(f"{_within('retained', d)} AS retained_{d}d" for d in _HORIZONS)},
       {", ".join(f"round({_within('retained', d)} / CAST(users AS DOUBLE), 6) AS retention_{d}d" for d in _HORIZONS)},
       {", ".join(f"{MDIV(_within('handle', d), 'users')} AS avg_future_handle_{d}d" for d in (30, 60))},
       {", ".join(f"{MDIV(_within('net', d), 'users')} AS avg_future_net_profit_{d}d" for d in (30, 60))},
       {MDIV('lifetime_handle', 'users')} AS avg_lifetime_handle, {MDIV('lifetime_net', 'users')} AS avg_lifetime_net_profit
FROM sizes LEFT JOIN reached USING (cohort_date, cohort_type)
GROUP BY cohort_date, cohort_type, users, lifetime_handle, lifetime_net ORDER BY 1, 2""", "fact_bet", "fact_bet_cost",
                                                      extra=COHORT_DAYS_SQL + f""",
horizons(days) AS (VALUES {", ".join(f"({d})" for d in _HORIZONS)}),
sizes AS (
  SELECT cohort_date, cohort_type, count(DISTINCT customer_id) AS users, sum(handle) AS lifetime_handle, sum(net) AS lifetime_net
  FROM cohort_days GROUP BY ALL),
reached AS (
  SELECT cohort_date, cohort_type, days, count(DISTINCT customer_id) AS retained, sum(handle) AS handle, sum(net) AS net
  FROM cohort_days JOIN horizons ON dd BETWEEN 1 AND days GROUP BY ALL)"""))
def ir4_promo_cohort_retention(spark, sf):
    return retention.promo_cohort_retention(_bets(spark, sf), _costs(spark, sf))


# Days around the anchor, first and last one included.
_SPANS = {"pre": (-28, -1), **{k: (1, n) for k, n in promo.POST_WINDOWS.items()}, "ever": (-1_000_000, 1_000_000)}


def _span(col: str, span: str) -> str:
    return f"coalesce(max({col}) FILTER (WHERE span = '{span}'), 0)"


UPLIFT_SUMS_SQL = LEDGER_DAYS_SQL + f""",
spans(span, first, last) AS (VALUES {_values(_SPANS)}),
lives AS (
  SELECT customer_id, segment, min(day) AS opened, max(day) - min(day) AS length, min(day) FILTER (WHERE has_promo) AS promo_day
  FROM ledger_days JOIN dim_customer USING (customer_id) GROUP BY ALL),
members AS (
  SELECT customer_id, segment, if(promo_day IS NULL, 'control', 'promo') AS cohort_type,
         coalesce(promo_day, opened + CAST(if(length >= 56, 28, length // 2) AS INTEGER)) AS anchor_date
  FROM lives),
span_sums AS (
  SELECT customer_id, span, sum(handle) AS handle, sum(net) AS net, sum(promo_net) AS promo_net, sum(promo) AS promo
  FROM members JOIN ledger_days USING (customer_id) JOIN spans ON date_diff('day', anchor_date, day) BETWEEN first AND last
  GROUP BY ALL)"""

PROMO_UPLIFT_EXACT_SQL = UPLIFT_SUMS_SQL + f""",
uplift_exact AS (
  SELECT customer_id, segment, cohort_type, anchor_date,
         {_span('handle', 'pre')} AS handle_pre, {_span('handle', '4w')} AS handle_post, {_span('net', 'pre')} AS net_profit_pre_4w,
         {", ".join(f"{_span(c, k)} AS {name}_post_{k}" for c, name in (("net", "net_profit"), ("promo_net", "direct_promo_net"),
                                                                         ("promo", "promo_cost")) for k in promo.POST_WINDOWS)},
         {_span('handle', 'ever')} AS lifetime_handle, {_span('net', 'ever')} AS lifetime_net_profit
  FROM members JOIN span_sums USING (customer_id) GROUP BY ALL)"""

UPLIFT_FIXTURES = ("fact_bet", "fact_bet_cost", "dim_customer")


def _m(x: str) -> str:
    return f"CAST(round({x}, 2) AS DOUBLE)"


_UPLIFT_COLS = ["net_profit_pre_4w", "net_profit_post_4w", "net_profit_post_13w", "net_profit_post_26w",
                "direct_promo_net_post_4w", "direct_promo_net_post_13w", "direct_promo_net_post_26w",
                "promo_cost_post_4w", "promo_cost_post_13w", "promo_cost_post_26w", "lifetime_handle",
                "lifetime_net_profit"]


@register("iu1_user_uplift", with_fixtures(f"""
SELECT customer_id, segment, cohort_type, anchor_date,
       {MDIV('handle_pre', '4')} AS avg_weekly_handle_pre_4w,
       {MDIV('handle_post', '4')} AS avg_weekly_handle_post_4w,
       {MDIV('handle_post - handle_pre', '4')} AS handle_delta_4w,
       {", ".join(f"{_m(c)} AS {c}" for c in _UPLIFT_COLS)},
       NULL::DOUBLE AS incremental_net_profit_4w, NULL::DOUBLE AS incremental_net_profit_13w,
       NULL::DOUBLE AS incremental_net_profit_26w, NULL::DOUBLE AS incremental_roi_4w
FROM uplift_exact""", *UPLIFT_FIXTURES, extra=PROMO_UPLIFT_EXACT_SQL))
def iu1_user_uplift(spark, sf):
    return promo.user_uplift(_bets(spark, sf), _costs(spark, sf), fx.dim_customer(spark, sf))


def _uplift_exact(spark, sf):
    return promo.user_uplift_exact(_bets(spark, sf), _costs(spark, sf), fx.dim_customer(spark, sf))


def _cohort_avg(cohort: str, num: str) -> str:
    return MDIV(f"sum(CASE WHEN cohort_type = '{cohort}' THEN {num} END)",
                f"count(*) FILTER (WHERE cohort_type = '{cohort}')", 4)


@register("iu2_uplift_summary", with_fixtures(f"""
SELECT *, round(promo_post_handle - control_post_handle, 4) AS post_handle_gap FROM (
SELECT {_cohort_avg('promo', 'handle_pre / 4')} AS promo_pre_handle,
       {_cohort_avg('promo', 'handle_post / 4')} AS promo_post_handle,
       {_cohort_avg('promo', '(handle_post - handle_pre) / 4')} AS promo_delta_handle,
       {_cohort_avg('control', 'handle_pre / 4')} AS control_pre_handle,
       {_cohort_avg('control', 'handle_post / 4')} AS control_post_handle,
       {_cohort_avg('control', '(handle_post - handle_pre) / 4')} AS control_delta_handle
FROM uplift_exact) t""", *UPLIFT_FIXTURES, extra=PROMO_UPLIFT_EXACT_SQL))
def iu2_uplift_summary(spark, sf):
    return promo.uplift_summary(_uplift_exact(spark, sf))


def _roi_sql() -> str:
    credit = "users * CAST(5.0 AS DECIMAL(24,6))"
    ratio = lambda x: f"round(CAST({x} AS DOUBLE) / nullif(CAST(promo AS DOUBLE), 0.0), 6)"
    measures = {"promo_users_{}": "users", "net_profit_per_user_{}": MDIV(f"(net - {credit})", "users"),
                "net_profit_total_{}": _m("net"), "promo_cost_total_{}": _m("promo"),
                "net_after_promo_total_{}": _m(f"(net - {credit})"), "direct_promo_net_total_{}": _m("promo_net"),
                "operating_profit_before_promo_{}": _m(f"(net + promo - {credit})"),
                "roi_{}": ratio(f"(promo_net - {credit})"), "direct_promo_roi_{}": ratio("promo_net"),
                "operating_roi_{}": ratio(f"(net + promo - {credit})")}
    cols = ", ".join(f"max({x}) FILTER (WHERE span = '{k}') AS {name.format(k)}"
                     for k in promo.POST_WINDOWS for name, x in measures.items())
    return with_fixtures(f"SELECT {cols} FROM roi", *UPLIFT_FIXTURES, extra=UPLIFT_SUMS_SQL + """,
mature AS (
  SELECT span, customer_id FROM members JOIN spans ON cohort_type = 'promo' AND first = 1
  WHERE anchor_date + last <= (SELECT max(day) FROM ledger_days)),
roi AS (
  SELECT span, count(m.customer_id) AS users, coalesce(sum(net), 0) AS net, coalesce(sum(promo_net), 0) AS promo_net,
         coalesce(sum(promo), 0) AS promo
  FROM spans LEFT JOIN mature m USING (span) LEFT JOIN span_sums USING (customer_id, span) GROUP BY span)""")


@register("iu3_roi_scorecard", _roi_sql())
def iu3_roi_scorecard(spark, sf):
    return promo.roi_scorecard(_uplift_exact(spark, sf), _bets(spark, sf))


PAYBACK_SERIES_SQL = COHORT_DAYS_SQL + """,
week_sums AS (
  SELECT dd // 7 + 1 AS wk, coalesce(sum(promo_net_after), 0) AS gain FROM cohort_days
  WHERE cohort_type = 'promo' AND dd BETWEEN 1 AND 180 AND cohort_date + 180 <= (SELECT max(day) FROM ledger_days)
  GROUP BY ALL),
week_running AS (SELECT wk, sum(gain) OVER (ORDER BY wk) AS cum_net_after_promo FROM week_sums)"""


@register("iu4_payback_series", with_fixtures("""
SELECT wk, CAST(round(cum_net_after_promo, 2) AS DOUBLE) AS cum_net_after_promo FROM week_running ORDER BY 1""",
                                              "fact_bet", "fact_bet_cost", extra=PAYBACK_SERIES_SQL))
def iu4_payback_series(spark, sf):
    return promo.payback_series(_bets(spark, sf), _costs(spark, sf))


@register("iu5_first_payback_week", with_fixtures("""
SELECT min(CASE WHEN round(cum_net_after_promo, 2) >= 0 THEN wk END) AS payback_week FROM week_running""",
                                                  "fact_bet", "fact_bet_cost", extra=PAYBACK_SERIES_SQL))
def iu5_first_payback_week(spark, sf):
    return promo.first_payback_week(promo.payback_series(_bets(spark, sf), _costs(spark, sf)))


@register("iu6_sustained_payback_week", with_fixtures("""
SELECT min(CASE WHEN n >= 4 THEN start_wk END) AS sustained_payback_week FROM (
  SELECT island, min(wk) AS start_wk, count(*) AS n FROM (
    SELECT wk, ok, row_number() OVER (ORDER BY wk) - row_number() OVER (PARTITION BY ok ORDER BY wk) AS island
    FROM (SELECT wk, round(cum_net_after_promo, 2) >= 0 AS ok FROM week_running) a) b
  WHERE ok GROUP BY island) c""", "fact_bet", "fact_bet_cost", extra=PAYBACK_SERIES_SQL))
def iu6_sustained_payback_week(spark, sf):
    return promo.sustained_payback_week(promo.payback_series(_bets(spark, sf), _costs(spark, sf)))


@register("iu7_net_profit_bridge", with_fixtures(f"""
SELECT {MDIV('sum(net_profit_post_4w) + sum(promo_cost_post_4w)', 'count(*)')} AS post_profit_before_promo,
       {MDIV('sum(promo_cost_post_4w)', 'count(*)')} AS promo_cost_post_4w,
       {MDIV('sum(net_profit_post_4w)', 'count(*)')} AS post_net_after_promo
FROM uplift_exact WHERE cohort_type = 'promo'""", *UPLIFT_FIXTURES, extra=PROMO_UPLIFT_EXACT_SQL))
def iu7_net_profit_bridge(spark, sf):
    return promo.net_profit_bridge(_uplift_exact(spark, sf))
