"""Registered scenario (I-V*), asset (M*), profiling/correlation (D13-D16, G5, G8, G9, H14, K13-K15) queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.aggs import sql_money_div
from quarry.operators import assets, profile, scenario
from quarry.operators.retention import STILL_ACTIVE_WINDOWS
from quarry.plans.registry import register
from quarry.sources import fixtures as fx
from quarry.sources.fixture_sql import with_fixtures

SEGMENTS = scenario.SEGMENTS
CELLS = [f"{s}_still_active_{k}" for s in SEGMENTS for k in STILL_ACTIVE_WINDOWS]


def _runs(spark, sf):
    return scenario.run_kpis(fx.run_bets(spark, sf), fx.fact_bet_cost(spark, sf), fx.dim_customer(spark, sf))


def _cell_sql() -> str:
    out = []
    for s in SEGMENTS:
        for k, (lo, hi) in STILL_ACTIVE_WINDOWS.items():
            out.append(f"coalesce(max(CASE WHEN segment = '{s}' THEN round(avg_{k}, 6) END), 0.0) AS {s}_still_active_{k}")
    return ",\n       ".join(out)


def _flags_sql() -> str:
    return ",\n         ".join(f"max(CASE WHEN dd > {lo} AND dd <= {hi} THEN 1 ELSE 0 END) AS f_{k}"
                               for k, (lo, hi) in STILL_ACTIVE_WINDOWS.items())


RUN_KPIS_SQL = f"""
days AS (SELECT DISTINCT run_id, customer_id, CAST(bet_datetime AS DATE) AS d FROM run_bets),
anchors AS (SELECT run_id, customer_id, min(d) AS a FROM days GROUP BY 1, 2),
flags AS (
  SELECT x.run_id, x.customer_id,
         {_flags_sql()}
  FROM (SELECT y.run_id, y.customer_id, date_diff('day', a.a, y.d) AS dd FROM days y
        JOIN anchors a ON y.run_id = a.run_id AND y.customer_id = a.customer_id) x
  GROUP BY 1, 2),
seg_rates AS (
  SELECT f.run_id, c.segment, {", ".join(f"avg(CAST(f_{k} AS DOUBLE)) AS avg_{k}" for k in STILL_ACTIVE_WINDOWS)}
  FROM flags f JOIN dim_customer c ON f.customer_id = c.customer_id GROUP BY 1, 2),
wide AS (SELECT run_id, {_cell_sql()} FROM seg_rates GROUP BY run_id),
money AS (
  SELECT b.run_id, CAST(round(sum(CAST(b.stake_amount AS DECIMAL(24,6))), 2) AS DOUBLE) AS handle,
         round(CAST(sum(CAST(b.stake_amount - b.gross_payout AS DECIMAL(24,6))) AS DOUBLE)
               / nullif(CAST(sum(CAST(b.stake_amount AS DECIMAL(24,6))) AS DOUBLE), 0.0), 6) AS hold,
         round(CAST(sum(CAST(b.stake_amount - b.gross_payout - c.promo_cost - c.payment_fee - c.tax AS DECIMAL(24,6))) AS DOUBLE)
               / nullif(CAST(sum(CAST(b.stake_amount AS DECIMAL(24,6))) AS DOUBLE), 0.0), 6) AS net_margin,
         round(CAST(sum(CAST(c.promo_cost AS DECIMAL(24,6))) AS DOUBLE)
               / nullif(CAST(sum(CAST(b.stake_amount AS DECIMAL(24,6))) AS DOUBLE), 0.0), 6) AS promo_rate
  FROM run_bets b JOIN fact_bet_cost c ON b.bet_id = c.bet_id GROUP BY 1),
runs AS (SELECT m.*, {", ".join(f"w.{c}" for c in CELLS)} FROM money m LEFT JOIN wide w ON m.run_id = w.run_id)"""

RUN_FIXTURES = ("run_bets", "fact_bet_cost", "dim_customer")


@register("iv1_run_kpis", with_fixtures("SELECT * FROM runs ORDER BY run_id", *RUN_FIXTURES, extra=RUN_KPIS_SQL))
def iv1_run_kpis(spark, sf):
    return _runs(spark, sf)


BAND_METRICS = ["handle", "hold", "net_margin", "promo_rate"] + CELLS


def _bands_sql() -> str:
    parts = [f"SELECT '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM runs" for m in BAND_METRICS]
    return with_fixtures(f"""
SELECT metric, {sql_money_div('sum(CAST(value AS DECIMAL(24,6)))', 'count(value)', 6)} AS mean, round(quantile_cont(value, 0.1), 6) AS p10,
       round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90
FROM ({" UNION ALL ".join(parts)}) l WHERE value IS NOT NULL GROUP BY metric ORDER BY metric""",
                         *RUN_FIXTURES, extra=RUN_KPIS_SQL)


@register("iv2_sensitivity_bands", _bands_sql())
def iv2_sensitivity_bands(spark, sf):
    return scenario.sensitivity_bands(_runs(spark, sf), BAND_METRICS)


def _fit_sql() -> str:
    terms = " + ".join(f"pow({s}_still_active_{k} - {t}, 2)" for s, cells in scenario.RETENTION_TARGETS.items()
                       for k, t in cells.items())
    return with_fixtures(f"""
SELECT run_id, fit_score, row_number() OVER (ORDER BY fit_score, run_id) = 1 AS is_best
FROM (SELECT run_id, round({terms}, 6) AS fit_score FROM runs) s ORDER BY fit_score, run_id""",
                         *RUN_FIXTURES, extra=RUN_KPIS_SQL)


@register("iv3_calibration_fit", _fit_sql())
def iv3_calibration_fit(spark, sf):
    return scenario.calibration_fit(_runs(spark, sf))


# ------------------------------------------------------------------ assets
AS_OF = "1998-06-30"


@register("m1_as_of_snapshot", with_fixtures(f"""
SELECT asset, arg_max(date, date) AS date, round(arg_max(price, date), 6) AS price, arg_max(market_cap, date) AS market_cap
FROM asset_prices WHERE date <= DATE '{AS_OF}' GROUP BY asset""", "asset_prices"))
def m1_as_of_snapshot(spark, sf):
    return assets.as_of_snapshot(fx.asset_prices(spark, sf), AS_OF)


@register("m2_market_cap_range", with_fixtures(f"""
SELECT asset, date, price, market_cap FROM (
  SELECT *, avg(CAST(market_cap AS DECIMAL(28, 6))) OVER () AS mean_cap FROM (
    SELECT asset, arg_max(date, date) AS date, round(arg_max(price, date), 6) AS price, arg_max(market_cap, date) AS market_cap
    FROM asset_prices WHERE date <= DATE '{AS_OF}' GROUP BY asset) s) m
WHERE market_cap >= mean_cap * 0.5 AND market_cap <= mean_cap * 1.5""", "asset_prices"))
def m2_market_cap_range(spark, sf):
    """Assets within half of the mean market cap on either side: bounds that follow the data at every size."""
    snapshot = assets.as_of_snapshot(fx.asset_prices(spark, sf), AS_OF)
    mean = snapshot.agg(F.avg(F.col("market_cap").cast("decimal(28,6)")).cast("double")).scalar()
    return assets.market_cap_range(snapshot, mean * 0.5, mean * 1.5)


@register("m3_portfolio_performance", with_fixtures("""
SELECT date, round(value, 6) AS value, round(value / nullif(lag(value) OVER (ORDER BY date), 0.0) - 1.0, 6) AS period_return
FROM (SELECT p.date, sum(h.quantity * p.price) AS value FROM asset_prices p JOIN holdings h ON p.asset = h.asset
      GROUP BY p.date) v ORDER BY date""", "asset_prices", "holdings"))
def m3_portfolio_performance(spark, sf):
    return assets.portfolio_performance(fx.asset_prices(spark, sf), fx.holdings(spark, sf))


@register("m4_baseline_forecasts", with_fixtures("""
SELECT asset, count(naive) AS naive_points,
       round(avg(abs(price - naive) / nullif(abs(price), 0.0)) * 100, 6) AS naive_mape,
       count(moving_avg) AS moving_avg_points,
       round(avg(abs(price - moving_avg) / nullif(abs(price), 0.0)) * 100, 6) AS moving_avg_mape
FROM (
  SELECT asset, date, price, lag(price) OVER (PARTITION BY asset ORDER BY date) AS naive,
         CASE WHEN count(price) OVER (PARTITION BY asset ORDER BY date ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) = 3
              THEN avg(price) OVER (PARTITION BY asset ORDER BY date ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) END AS moving_avg
  FROM asset_prices) x GROUP BY asset ORDER BY asset""", "asset_prices"))
def m4_baseline_forecasts(spark, sf):
    return assets.baseline_forecasts(fx.asset_prices(spark, sf))


@register("m5_risk_tiers", with_fixtures("""
SELECT asset, round(vol, 6) AS volatility,
       CASE WHEN vol IS NULL THEN NULL WHEN vol < 0.05 THEN 'conservative' WHEN vol < 0.15 THEN 'moderate'
            ELSE 'aggressive' END AS risk_tier
FROM (SELECT asset, stddev_samp(ret) AS vol FROM (
        SELECT asset, price / nullif(lag(price) OVER (PARTITION BY asset ORDER BY date), 0.0) - 1.0 AS ret
        FROM asset_prices) r GROUP BY asset) v ORDER BY asset""", "asset_prices"))
def m5_risk_tiers(spark, sf):
    return assets.risk_tiers(fx.asset_prices(spark, sf))


# ------------------------------------------------------------------ profiling and correlation
MOVIE_NUMERIC = ["budget", "gross", "votes", "runtime", "score"]


def _describe_sql() -> str:
    parts = [f"""SELECT '{c}' AS column_name, count({c}) AS count, round(avg({c}), 6) AS mean,
       round(stddev_samp({c}), 6) AS std, min({c}) AS min, max({c}) AS max
FROM movies""" for c in MOVIE_NUMERIC]
    return with_fixtures("\nUNION ALL\n".join(parts), "movies")


@register("d13_describe", _describe_sql())
def d13_describe(spark, sf):
    """Moments and extremes (exact, oracle-checked)."""
    return profile.describe(fx.movies(spark, sf), MOVIE_NUMERIC).drop("p25", "p50", "p75")


@register("d13_describe_quartiles", with_fixtures("\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, " + ", ".join(f"round(quantile_cont(CAST({c} AS DOUBLE), {q}), 6) AS {n}" for q, n in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75")))
    + " FROM movies" for c in MOVIE_NUMERIC), "movies"))
def d13_describe_quartiles(spark, sf):
    """Exact quartiles by distributed selection."""
    return profile.describe(fx.movies(spark, sf), MOVIE_NUMERIC).select("column_name", "p25", "p50", "p75")


def _nulls_sql() -> str:
    cols = ["name", "company", "genre", "released"] + MOVIE_NUMERIC
    parts = [f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS null_count FROM movies" for c in cols]
    return with_fixtures("\nUNION ALL\n".join(parts), "movies")


@register("d14_null_counts", _nulls_sql())
def d14_null_counts(spark, sf):
    return profile.null_counts(fx.movies(spark, sf))


def _corr_sql(table: str, cols: list[str], where: str = "", threshold: float | None = None) -> str:
    parts = []
    for a in cols:
        for b in cols:
            xa = f"CASE WHEN {b} IS NOT NULL THEN CAST({a} AS DOUBLE) END"
            xb = f"CASE WHEN {a} IS NOT NULL THEN CAST({b} AS DOUBLE) END"
            parts.append(f"SELECT '{a}' AS x, '{b}' AS y, round(covar_pop({xa}, {xb}) / "
                         f"nullif(stddev_pop({xa}) * stddev_pop({xb}), 0.0), 6) AS corr FROM {table}")
    body = "\nUNION ALL\n".join(parts)
    if threshold is not None:
        body = f"SELECT * FROM ({body}) c WHERE corr > {threshold} ORDER BY corr DESC, x, y"
    return body


@register("d16_correlation_matrix", with_fixtures(_corr_sql("movies", MOVIE_NUMERIC), "movies"))
def d16_correlation_matrix(spark, sf):
    return profile.correlation_matrix(fx.movies(spark, sf), MOVIE_NUMERIC)


KILL_FEATURES = ["t1_towerKills", "t1_inhibitorKills", "t1_baronKills", "t1_dragonKills", "t1_riftHeraldKills",
                 "t2_towerKills", "t2_inhibitorKills", "t2_baronKills", "t2_dragonKills", "t2_riftHeraldKills"]


@register("k14_kill_correlation", with_fixtures(_corr_sql("matches", ["winner"] + KILL_FEATURES), "matches"))
def k14_kill_correlation(spark, sf):
    return profile.correlation_matrix(fx.matches(spark, sf), ["winner"] + KILL_FEATURES)


ENCODED = ["name", "company", "genre", "released"]

CODES_SQL = ",\n".join(
    f"""codes_{c} AS (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER) AS code
  FROM (SELECT DISTINCT CAST({c} AS VARCHAR) AS v FROM movies WHERE {c} IS NOT NULL) d)""" for c in ENCODED) + """,
encoded AS (
  SELECT """ + ", ".join(f"coalesce(k_{c}.code, -1) AS {c}" for c in ENCODED) + ", " + ", ".join(
    f"m.{c}" for c in MOVIE_NUMERIC) + """
  FROM movies m """ + " ".join(f"LEFT JOIN codes_{c} k_{c} ON CAST(m.{c} AS VARCHAR) = k_{c}.v" for c in ENCODED) + ")"


@register("h14_category_codes", with_fixtures("SELECT name, company, genre, released, budget FROM encoded", "movies",
                                              extra=CODES_SQL))
def h14_category_codes(spark, sf):
    df = profile.category_codes(fx.movies(spark, sf), ENCODED)
    return df.select("name", "company", "genre", "released", "budget")


@register("k15_g5_strong_pairs", with_fixtures(_corr_sql("encoded", ENCODED + MOVIE_NUMERIC, threshold=0.5),
                                               "movies", extra=CODES_SQL))
def k15_g5_strong_pairs(spark, sf):
    df = profile.category_codes(fx.movies(spark, sf), ENCODED)
    return profile.strong_pairs(profile.correlation_matrix(df, ENCODED + MOVIE_NUMERIC), 0.5)


FIRSTS = ["firstBlood", "firstTower", "firstInhibitor", "firstBaron", "firstDragon", "firstRiftHerald"]


def _cond_sql() -> str:
    parts = [f"SELECT '{f}' AS feature, CAST({f} AS VARCHAR) AS value, winner FROM matches" for f in FIRSTS]
    return with_fixtures(f"""
SELECT feature, value, count(*) AS n, round(avg(CASE WHEN winner = 1 THEN 1.0 ELSE 0.0 END) * 100, 6) AS win_pct
FROM ({" UNION ALL ".join(parts)}) l GROUP BY 1, 2 ORDER BY 1, 2""", "matches")


@register("k13_conditional_win_rate", _cond_sql())
def k13_conditional_win_rate(spark, sf):
    return profile.conditional_rates(fx.matches(spark, sf), FIRSTS, "winner", 1)


@register("k6_d12_class_balance", with_fixtures("""
SELECT winner, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS pct FROM matches GROUP BY winner""",
                                                "matches"))
def k6_d12_class_balance(spark, sf):
    return profile.value_shares(fx.matches(spark, sf), "winner")


@register("d12_shares_within_group", with_fixtures("""
SELECT firstBlood, winner, count(*) AS n,
       round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY firstBlood), 6) AS pct
FROM matches GROUP BY firstBlood, winner""", "matches"))
def d12_shares_within_group(spark, sf):
    return profile.value_shares(fx.matches(spark, sf), "winner", by="firstBlood")


@register("g8_g9_champion_list", with_fixtures("""
SELECT DISTINCT id, name FROM (
  SELECT key, arg_max(id, priority) AS id, arg_max(name, priority) AS name FROM champion_entries GROUP BY key) m
WHERE id > 0""", "champion_entries"))
def g8_g9_champion_list(spark, sf):
    return profile.champion_list(fx.champion_docs(spark, sf))


@register("h4_release_year", with_fixtures("""
SELECT name, substr(string_split(released, ', ')[-1], 1, 4) AS year FROM movies""", "movies"))
def h4_release_year(spark, sf):
    from quarry.functions.scalar import year_from_release

    return fx.movies(spark, sf).select("name", year_from_release("released").alias("year"))


@register("b7_drop_incomplete_rows", with_fixtures("""
SELECT count(*) AS rows_kept FROM movies WHERE budget IS NOT NULL AND score IS NOT NULL""", "movies"))
def b7_drop_incomplete_rows(spark, sf):
    return fx.movies(spark, sf).dropna(how="any").agg(F.count(F.lit(1)).alias("rows_kept"))
