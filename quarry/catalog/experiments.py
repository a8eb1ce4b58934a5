"""Registered experiment-statistics queries (J1..J10)."""

from __future__ import annotations

from quarry.operators import experiment as ex
from quarry.plans.registry import register
from quarry.sources import fixtures as fx
from quarry.sources.fixture_sql import with_fixtures

Z = ex.Z_95


def _players(spark, sf):
    return fx.ab_players(spark, sf)


@register("j1_retention_by_variant", with_fixtures("""
SELECT version, 'itt' AS population, count(*) AS users,
       round(avg(CAST(retention_1 AS DOUBLE)) * 100, 6) AS retention_1, round(avg(CAST(retention_7 AS DOUBLE)) * 100, 6) AS retention_7
FROM ab_players GROUP BY version
UNION ALL
SELECT version, 'active', count(*), round(avg(CAST(retention_1 AS DOUBLE)) * 100, 6), round(avg(CAST(retention_7 AS DOUBLE)) * 100, 6)
FROM ab_players WHERE sum_gamerounds > 0 GROUP BY version""", "ab_players"))
def j1_retention_by_variant(spark, sf):
    return ex.retention_by_variant(_players(spark, sf))


def _wilson(s: str, n: str, bound: str) -> str:
    p = f"(CAST({s} AS DOUBLE) / {n})"
    denom = f"(1.0 + {Z} * {Z} / {n})"
    center = f"(({p} + {Z} * {Z} / (2.0 * {n})) / {denom})"
    half = f"({Z} * sqrt({p} * (1.0 - {p}) / {n} + {Z} * {Z} / (4.0 * {n} * {n})) / {denom})"
    return f"round(({center} {'-' if bound == 'low' else '+'} {half}) * 100, 6)"


SUMMARY_SQL = with_fixtures(f"""
SELECT metric, n_c, n_t, round(p_c * 100, 6) AS control_rate, round(p_t * 100, 6) AS treatment_rate,
       round((p_t - p_c) * 100, 6) AS diff_pp,
       round((p_c - p_t) / nullif(sqrt(pooled * (1.0 - pooled) * (1.0 / n_c + 1.0 / n_t)), 0.0), 6) AS z,
       {_wilson('s_c', 'CAST(n_c AS DOUBLE)', 'low')} AS control_ci_low,
       {_wilson('s_c', 'CAST(n_c AS DOUBLE)', 'high')} AS control_ci_high,
       {_wilson('s_t', 'CAST(n_t AS DOUBLE)', 'low')} AS treatment_ci_low,
       {_wilson('s_t', 'CAST(n_t AS DOUBLE)', 'high')} AS treatment_ci_high,
       round(((p_t - p_c) - {Z} * sqrt(p_t * (1.0 - p_t) / n_t + p_c * (1.0 - p_c) / n_c)) * 100, 6) AS diff_ci_low,
       round(((p_t - p_c) + {Z} * sqrt(p_t * (1.0 - p_t) / n_t + p_c * (1.0 - p_c) / n_c)) * 100, 6) AS diff_ci_high,
       round(2.0 * (asin(sqrt(p_c)) - asin(sqrt(p_t))), 6) AS cohens_h
FROM (
  SELECT metric, s_c, n_c, s_t, n_t, CAST(s_c AS DOUBLE) / n_c AS p_c, CAST(s_t AS DOUBLE) / n_t AS p_t,
         CAST(s_c + s_t AS DOUBLE) / (n_c + n_t) AS pooled
  FROM (
    SELECT metric, sum(CASE WHEN version = 'gate_30' THEN y END) AS s_c, count(CASE WHEN version = 'gate_30' THEN 1 END) AS n_c,
           sum(CASE WHEN version = 'gate_40' THEN y END) AS s_t, count(CASE WHEN version = 'gate_40' THEN 1 END) AS n_t
    FROM (SELECT version, 'retention_1' AS metric, CAST(retention_1 AS BIGINT) AS y FROM ab_players WHERE sum_gamerounds > 0
          UNION ALL
          SELECT version, 'retention_7', CAST(retention_7 AS BIGINT) FROM ab_players WHERE sum_gamerounds > 0) l
    GROUP BY metric) c) r ORDER BY metric""", "ab_players")


@register("j2_j6_proportion_summary", SUMMARY_SQL)
def j2_j6_proportion_summary(spark, sf):
    return ex.proportion_summary(_players(spark, sf), with_p=False)


# The tail integral of the normal density by Simpson's rule over 20 standard deviations, as another way to the p-value.
@register("j2_p_values", f"""
WITH s AS ({SUMMARY_SQL.replace('AS z,', "AS z, (p_c - p_t) / nullif(sqrt(pooled * (1.0 - pooled) * (1.0 / n_c + 1.0 / n_t)), 0.0) AS exact_z,")})
SELECT metric, any_value(z) AS z,
       round(sum(2.0 / sqrt(2.0 * pi()) * exp(-pow(abs(exact_z) + i / 500.0, 2) / 2.0) * CASE WHEN i IN (0, 10000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END / 1500.0), 6) AS p
FROM s, range(10001) t(i) GROUP BY metric""")
def j2_p_values(spark, sf):
    """Same summary with the two-sided p-value."""
    return ex.proportion_summary(_players(spark, sf), with_p=True).select("metric", "z", "p")


def _hash_sql(seed: int = 42) -> str:
    p = ex.HASH_PRIME
    step = lambda x, a, b: f"(({x}) * ({x}) + {a} * ({x}) + {b}) % {p}"
    return f"""h0 AS (SELECT version, retention_1, retention_7, b, (userid % {p} * 1103 + b * 7919 + {seed}) % {p} AS h FROM ab_players, range(200) t(b)),
h1 AS (SELECT * REPLACE ({step('h', 12345, 1)} AS h) FROM h0), h2 AS (SELECT * REPLACE ({step('h', 54321, 7)} AS h) FROM h1),
w AS (SELECT *, {' + '.join(f"CAST(h >= {c} AS INTEGER)" for c in ex.poisson_cuts())} AS w FROM h2)"""


@register("j7_bootstrap_ci", with_fixtures("""
SELECT version, day, mean, round(quantile_cont(m, 0.025), 6) AS ci_low, round(quantile_cont(m, 0.975), 6) AS ci_high
FROM (SELECT version, day, b, CAST(sum(w * y) AS DOUBLE) / sum(w) AS m, any_value(mean) AS mean
      FROM (SELECT *, round(avg(CAST(y AS DOUBLE)) OVER (PARTITION BY version, day), 6) AS mean
            FROM (SELECT version, 'Day 1' AS day, b, w, CAST(retention_1 AS INTEGER) AS y FROM w
                  UNION ALL SELECT version, 'Day 7', b, w, CAST(retention_7 AS INTEGER) FROM w))
      GROUP BY version, day, b) GROUP BY version, day, mean""", "ab_players", extra=_hash_sql()))
def j7_bootstrap_ci(spark, sf):
    """Poisson bootstrap; the replicate weights come from an integer hash that both engines compute."""
    return ex.bootstrap_mean_ci(_players(spark, sf))


@register("j8_cuped", with_fixtures("""
SELECT round(theta, 6) AS theta, round(mc, 6) AS control_mean, round(mt, 6) AS treatment_mean,
       round(mt - mc, 6) AS lift, round(mat - mac, 6) AS lift_cuped, round(vc, 6) AS control_var,
       round(vac, 6) AS control_var_cuped, round(vt, 6) AS treatment_var, round(vat, 6) AS treatment_var_cuped,
       round(1.0 - (vac + vat) / nullif(vc + vt, 0.0), 6) AS variance_reduction
FROM (
  SELECT any_value(theta) AS theta,
         avg(CASE WHEN version = 'gate_30' THEN y END) AS mc, avg(CASE WHEN version = 'gate_40' THEN y END) AS mt,
         avg(CASE WHEN version = 'gate_30' THEN y_adj END) AS mac, avg(CASE WHEN version = 'gate_40' THEN y_adj END) AS mat,
         var_samp(CASE WHEN version = 'gate_30' THEN y END) AS vc, var_samp(CASE WHEN version = 'gate_40' THEN y END) AS vt,
         var_samp(CASE WHEN version = 'gate_30' THEN y_adj END) AS vac, var_samp(CASE WHEN version = 'gate_40' THEN y_adj END) AS vat
  FROM (
    SELECT version, y, theta, y - coalesce(theta, 0.0) * (x - x_bar) AS y_adj
    FROM (SELECT version, CAST(retention_7 AS DOUBLE) AS y, CAST(events_first_day AS DOUBLE) AS x FROM ab_players) p
    CROSS JOIN (SELECT covar_samp(CAST(retention_7 AS DOUBLE), CAST(events_first_day AS DOUBLE))
                       / nullif(var_samp(CAST(events_first_day AS DOUBLE)), 0.0) AS theta,
                       avg(CAST(events_first_day AS DOUBLE)) AS x_bar FROM ab_players) g) a) r""", "ab_players"))
def j8_cuped(spark, sf):
    return ex.cuped(_players(spark, sf))


@register("j9_sequential_monitoring", with_fixtures(f"""
SELECT install_date, cum_n_c, cum_s_c, cum_n_t, cum_s_t, round(pc, 6) AS control_rate, round(pt, 6) AS treatment_rate,
       round(z, 6) AS z, abs(z) > {Z} AS significant
FROM (
  SELECT *, (pc - pt) / nullif(sqrt(pooled * (1.0 - pooled) * (1.0 / nullif(cum_n_c, 0) + 1.0 / nullif(cum_n_t, 0))), 0.0) AS z
  FROM (
    SELECT *, CAST(cum_s_c AS DOUBLE) / nullif(cum_n_c, 0) AS pc, CAST(cum_s_t AS DOUBLE) / nullif(cum_n_t, 0) AS pt,
           CAST(cum_s_c + cum_s_t AS DOUBLE) / nullif(cum_n_c + cum_n_t, 0) AS pooled
    FROM (
      SELECT install_date,
             CAST(sum(n_c) OVER w AS BIGINT) AS cum_n_c, CAST(sum(coalesce(s_c, 0)) OVER w AS BIGINT) AS cum_s_c,
             CAST(sum(n_t) OVER w AS BIGINT) AS cum_n_t, CAST(sum(coalesce(s_t, 0)) OVER w AS BIGINT) AS cum_s_t
      FROM (SELECT install_date,
                   count(CASE WHEN version = 'gate_30' THEN 1 END) AS n_c,
                   sum(CASE WHEN version = 'gate_30' THEN CAST(retention_7 AS BIGINT) END) AS s_c,
                   count(CASE WHEN version = 'gate_40' THEN 1 END) AS n_t,
                   sum(CASE WHEN version = 'gate_40' THEN CAST(retention_7 AS BIGINT) END) AS s_t
            FROM ab_players GROUP BY install_date) d
      WINDOW w AS (ORDER BY install_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) c) p) q
ORDER BY install_date""", "ab_players"))
def j9_sequential_monitoring(spark, sf):
    return ex.sequential_monitoring(_players(spark, sf))


@register("j10_compare_to_control", with_fixtures(f"""
SELECT variant, n, n_c, round(p, 6) AS rate, round(pc, 6) AS control_rate, round(p - pc, 6) AS lift, round(z, 6) AS z,
       CASE WHEN abs(z) > {Z} THEN CASE WHEN p > pc THEN 'ship' ELSE 'rollback' END ELSE 'hold' END AS decision
FROM (
  SELECT *, (p - pc) / nullif(sqrt(pooled * (1.0 - pooled) * (1.0 / n + 1.0 / n_c)), 0.0) AS z
  FROM (
    SELECT v.variant, v.n, c.n_c, CAST(v.s AS DOUBLE) / v.n AS p, CAST(c.s_c AS DOUBLE) / c.n_c AS pc,
           CAST(v.s + c.s_c AS DOUBLE) / (v.n + c.n_c) AS pooled
    FROM (SELECT variant, count(*) AS n, sum(CAST(retention_7 AS BIGINT)) AS s FROM ab_players GROUP BY variant) v
    CROSS JOIN (SELECT count(*) AS n_c, sum(CAST(retention_7 AS BIGINT)) AS s_c FROM ab_players WHERE variant = 'v0') c
    WHERE v.variant <> 'v0') a) b ORDER BY variant""", "ab_players"))
def j10_compare_to_control(spark, sf):
    return ex.compare_to_control(_players(spark, sf))
