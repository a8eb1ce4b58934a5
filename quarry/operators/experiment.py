"""Experiment statistics.

Plan notes. Every statistic is a closed form over a handful of sums, so each
operator is ONE grouped aggregate (map-side combined: a variant holding most
users costs one partial row per task) followed by column arithmetic on the
few result rows. The normal tail probability is a column expression (``erfc``).
The bootstrap (J7) draws Poisson(1) replicate weights from an integer hash of
(user, replicate), so it is repeatable on any engine; every task sums its
replicates into arrays (NumPy over Arrow batches) before anything is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.scalar import HASH_PRIME, replicate_hash

Z_95 = 1.959963984540054   # fixed value: two-sided 95 % normal quantile
ALPHA = 0.05
DIGITS = 6
CONTROL, TREATMENT = "gate_30", "gate_40"


def _r(c):
    return F.round(c, DIGITS)


def erfc(x):
    """Complementary error function of a column, relative error below 1e-12: series below 1.5, continued fraction beyond.

    Both are folds over a fixed sequence, so the expression stays in the JVM.
    """
    a = F.abs(x)
    small, large = F.least(a, F.lit(1.5)), F.greatest(a, F.lit(1.5))
    # erf = 2/sqrt(pi) exp(-a^2) sum of 2^n a^(2n+1) / (2n+1)!!: all terms are positive
    series = F.aggregate(F.sequence(F.lit(1), F.lit(80)), F.struct(small.alias("t"), small.alias("s")),
                         lambda s, n: F.struct((s["t"] * 2.0 * small * small / (2 * n + 1)).alias("t"),
                                               (s["s"] + s["t"] * 2.0 * small * small / (2 * n + 1)).alias("s")))["s"]
    inner = 1.0 - 2.0 / math.sqrt(math.pi) * F.exp(-small * small) * series
    fraction = F.aggregate(F.sequence(F.lit(120), F.lit(1), F.lit(-1)), large, lambda s, n: large + n / 2.0 / s)
    outer = F.exp(-large * large) / (math.sqrt(math.pi) * fraction)
    upper = F.when(a < 1.5, inner).otherwise(outer)
    return F.when(x.isNotNull(), F.when(x < 0, 2.0 - upper).otherwise(upper))


def two_sided_p(z):
    """Two-sided normal p-value ``erfc(|z| / sqrt(2))``; null for a null z."""
    z = F.col(z) if isinstance(z, str) else z
    return F.when(z.isNotNull() & ~F.isnan(z), erfc(F.abs(z) / math.sqrt(2.0)))


# ------------------------------------------------------------------ J1
def retention_by_variant(players: DataFrame, metrics: Sequence[str] = ("retention_1", "retention_7"),
                         active_col: str = "sum_gamerounds") -> DataFrame:
    """Retention % per variant for all users (ITT) and active users (per-protocol), in one pass."""
    active = F.coalesce(F.col(active_col) > 0, F.lit(False))
    groups = F.explode(F.when(active, F.array(F.lit("itt"), F.lit("active"))).otherwise(F.array(F.lit("itt"))))
    return players.select("version", groups.alias("population"), *[F.col(m).cast("double").alias(m) for m in metrics]) \
        .groupBy("version", "population").agg(F.count(F.lit(1)).alias("users"), *[_r(F.avg(m) * 100).alias(m) for m in metrics]) \
        .orderBy("population", "version")


# ------------------------------------------------------------------ J2..J6
def _counts_by_metric(players: DataFrame, metrics: Sequence[str], control: str, treatment: str,
                      arm_col: str = "version") -> DataFrame:
    """G4 + one aggregate: successes and totals of both arms per metric."""
    long = players.unpivot([arm_col], list(metrics), "metric", "retained") \
        .select(arm_col, "metric", F.col("retained").cast("long").alias("y"))
    arm = F.col(arm_col)
    return long.groupBy("metric").agg(
        F.sum(F.when(arm == control, F.col("y"))).alias("s_c"),
        F.count(F.when(arm == control, F.lit(1))).alias("n_c"),
        F.sum(F.when(arm == treatment, F.col("y"))).alias("s_t"),
        F.count(F.when(arm == treatment, F.lit(1))).alias("n_t"),
    )


def wilson_interval(s, n, z: float = Z_95):
    """Wilson score interval (low, high) of s successes in n trials; NULL for n = 0."""
    n = F.nullif(n.cast("double"), F.lit(0.0))
    p = s.cast("double") / n
    denom = 1.0 + z * z / n
    center = (p + z * z / (2.0 * n)) / denom
    half = z * F.sqrt(p * (1.0 - p) / n + z * z / (4.0 * n * n)) / denom
    return center - half, center + half


def proportion_summary(players: DataFrame, metrics: Sequence[str] = ("retention_1", "retention_7"),
                       control: str = CONTROL, treatment: str = TREATMENT, active_only: bool = True,
                       with_p: bool = True) -> DataFrame:
    """Per metric rates, pp difference, pooled z, Wilson CIs, Wald CI of the difference, Cohen's h."""
    x = players.where(F.col("sum_gamerounds") > 0) if active_only else players
    c = _counts_by_metric(x, metrics, control, treatment)
    s_c, s_t = F.col("s_c"), F.col("s_t")
    n_c = F.nullif(F.col("n_c").cast("double"), F.lit(0.0))
    n_t = F.nullif(F.col("n_t").cast("double"), F.lit(0.0))
    p_c, p_t = F.try_divide(s_c.cast("double"), n_c), F.try_divide(s_t.cast("double"), n_t)
    pooled = F.try_divide((s_c + s_t).cast("double"), n_c + n_t)
    se_pooled = F.sqrt(pooled * (1.0 - pooled) * (1.0 / n_c + 1.0 / n_t))
    z = F.try_divide(p_c - p_t, F.nullif(se_pooled, F.lit(0.0)))
    se_diff = F.sqrt(p_t * (1.0 - p_t) / n_t + p_c * (1.0 - p_c) / n_c)
    diff = p_t - p_c
    c_lo, c_hi = wilson_interval(s_c, F.col("n_c"))
    t_lo, t_hi = wilson_interval(s_t, F.col("n_t"))
    out = c.select(
        "metric", "n_c", "n_t",
        _r(p_c * 100).alias("control_rate"), _r(p_t * 100).alias("treatment_rate"),
        _r(diff * 100).alias("diff_pp"), _r(z).alias("z"),
        _r(c_lo * 100).alias("control_ci_low"), _r(c_hi * 100).alias("control_ci_high"),
        _r(t_lo * 100).alias("treatment_ci_low"), _r(t_hi * 100).alias("treatment_ci_high"),
        _r((diff - Z_95 * se_diff) * 100).alias("diff_ci_low"), _r((diff + Z_95 * se_diff) * 100).alias("diff_ci_high"),
        _r(2.0 * (F.asin(F.sqrt(p_c)) - F.asin(F.sqrt(p_t)))).alias("cohens_h"),
        *([_r(two_sided_p(z)).alias("p")] if with_p else []),
    )
    return out.orderBy("metric")


# ------------------------------------------------------------------ J7
# Cumulative Poisson(1) probabilities for k = 0..12 (replicate weights).
POISSON1_CDF = [math.exp(-1.0) * sum(1.0 / math.factorial(i) for i in range(k + 1)) for k in range(13)]


def poisson_cuts() -> list[int]:
    """Hash values below the k-th cut draw a weight of k or less."""
    return [math.floor(c * HASH_PRIME) for c in POISSON1_CDF]


def _replicate_sums(metrics: Sequence[str], replicates: int, seed: int):
    """Per task: for every arm and metric the sums of the weights and of the weighted values, one array entry a replicate."""
    def run(batches):
        cuts, b = np.array(poisson_cuts(), np.int64), np.arange(replicates, dtype=np.int64)
        sums: dict = {}
        for batch in batches:
            arms = np.array(batch.column("arm").to_pylist(), object)
            users = batch.column("userid").to_numpy(zero_copy_only=False).astype(np.int64)
            w = np.searchsorted(cuts, replicate_hash(users[:, None], b[None, :], seed), "right").astype(np.float64)
            for m in metrics:
                y = batch.column(m).to_numpy(zero_copy_only=False).astype(np.float64)
                for arm in set(arms.tolist()):
                    rows = (arms == arm) & ~np.isnan(y)
                    held = sums.setdefault((arm, m), np.zeros((2, replicates)))
                    held[0] += w[rows].sum(0)
                    held[1] += w[rows].T @ y[rows]
        keys = list(sums)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()),
                                          pa.array([sums[k][0].tolist() for k in keys], pa.list_(pa.float64())),
                                          pa.array([sums[k][1].tolist() for k in keys], pa.list_(pa.float64()))], names=["arm", "metric", "w", "wy"])

    return run


def bootstrap_mean_ci(players: DataFrame, metrics: Sequence[str] = ("retention_1", "retention_7"),
                      replicates: int = 200, seed: int = 42, arm_col: str = "version") -> DataFrame:
    """Poisson-bootstrap 95 % interval of each metric's mean per arm (chart error bars).

    Every task sums all replicates of its users into arrays, so no user row is repeated and
    arms x metrics x tasks rows are shuffled. Weights are whole numbers, so sums of 0/1
    metrics are exact. Players without an id or a value take no part in the replicates.
    """
    x = players.where(F.col("userid").isNotNull()).select(F.col("userid").cast("long").alias("userid"), F.col(arm_col).cast("string").alias("arm"),
                                                          *[F.col(m).cast("double").alias(m) for m in metrics])
    partial = x.mapInArrow(_replicate_sums(metrics, replicates, seed), "arm string, metric string, w array<double>, wy array<double>")
    merged = partial.select("arm", "metric", F.posexplode(F.arrays_zip("w", "wy")).alias("b", "s")).groupBy("arm", "metric", "b") \
        .agg(F.try_divide(F.sum("s.wy"), F.sum("s.w")).alias("m"))
    ci = merged.groupBy("arm", "metric").agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    point = x.groupBy("arm").agg(*[F.avg(m).alias(m) for m in metrics]).unpivot(["arm"], list(metrics), "metric", "mean") \
        .withColumnsRenamed({"arm": "__arm", "metric": "__metric"})
    return point.join(ci, F.col("arm").eqNullSafe(F.col("__arm")) & (F.col("metric") == F.col("__metric"))).select(
        F.col("arm").alias(arm_col), F.regexp_replace("metric", "retention_", "Day ").alias("day"), _r("mean").alias("mean"),
        _r(F.col("q")[0]).alias("ci_low"), _r(F.col("q")[1]).alias("ci_high")
    ).orderBy("day", arm_col)


# ------------------------------------------------------------------ J8
def cuped(players: DataFrame, outcome: str = "retention_7", covariate: str = "events_first_day",
          control: str = CONTROL, treatment: str = TREATMENT, arm_col: str = "version") -> DataFrame:
    """CUPED - theta = cov(y, x) / var(x) over all users; y' = y - theta (x - mean x); per-arm means/variances and lifts."""
    x = players.select(arm_col, F.col(outcome).cast("double").alias("y"), F.col(covariate).cast("double").alias("x"))
    theta = x.agg(F.try_divide(F.covar_samp("y", "x"), F.nullif(F.var_samp("x"), F.lit(0.0)))).scalar()
    x_bar = x.agg(F.avg("x")).scalar()
    adj = x.withColumns({"theta": theta,
                         "y_adj": F.col("y") - F.coalesce(theta, F.lit(0.0)) * (F.col("x") - x_bar)})
    arm = F.col(arm_col)

    def m(col, a):
        return F.avg(F.when(arm == a, F.col(col)))

    def v(col, a):
        return F.var_samp(F.when(arm == a, F.col(col)))

    r = adj.agg(F.first("theta").alias("theta"),
                m("y", control).alias("mc"), m("y", treatment).alias("mt"),
                m("y_adj", control).alias("mac"), m("y_adj", treatment).alias("mat"),
                v("y", control).alias("vc"), v("y", treatment).alias("vt"),
                v("y_adj", control).alias("vac"), v("y_adj", treatment).alias("vat"))
    return r.select(
        _r("theta").alias("theta"),
        _r("mc").alias("control_mean"), _r("mt").alias("treatment_mean"),
        _r(F.col("mt") - F.col("mc")).alias("lift"),
        _r(F.col("mat") - F.col("mac")).alias("lift_cuped"),
        _r("vc").alias("control_var"), _r("vac").alias("control_var_cuped"),
        _r("vt").alias("treatment_var"), _r("vat").alias("treatment_var_cuped"),
        _r(1.0 - F.try_divide(F.col("vac") + F.col("vat"), F.nullif(F.col("vc") + F.col("vt"), F.lit(0.0))))
        .alias("variance_reduction"),
    )


# ------------------------------------------------------------------ J9
def sequential_monitoring(players: DataFrame, metric: str = "retention_7", control: str = CONTROL,
                          treatment: str = TREATMENT, date_col: str = "install_date",
                          arm_col: str = "version") -> DataFrame:
    """Cumulative users/successes per arm by install day and the pooled z of the running comparison."""
    arm = F.col(arm_col)
    y = F.col(metric).cast("long")
    daily = players.groupBy(date_col).agg(
        F.count(F.when(arm == control, F.lit(1))).alias("n_c"), F.sum(F.when(arm == control, y)).alias("s_c"),
        F.count(F.when(arm == treatment, F.lit(1))).alias("n_t"), F.sum(F.when(arm == treatment, y)).alias("s_t"))
    w = Window.orderBy(date_col).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # one row per day
    cum = daily.select(date_col, *[F.sum(F.coalesce(F.col(c), F.lit(0))).over(w).alias(f"cum_{c}")
                                   for c in ("n_c", "s_c", "n_t", "s_t")])
    nc, nt = F.col("cum_n_c").cast("double"), F.col("cum_n_t").cast("double")
    pc, pt = F.try_divide(F.col("cum_s_c").cast("double"), nc), F.try_divide(F.col("cum_s_t").cast("double"), nt)
    pooled = F.try_divide((F.col("cum_s_c") + F.col("cum_s_t")).cast("double"), nc + nt)
    se = F.sqrt(pooled * (1.0 - pooled) * (F.try_divide(F.lit(1.0), nc) + F.try_divide(F.lit(1.0), nt)))
    z = F.try_divide(pc - pt, F.nullif(se, F.lit(0.0)))
    return cum.select(date_col, "cum_n_c", "cum_s_c", "cum_n_t", "cum_s_t", _r(pc).alias("control_rate"),
                      _r(pt).alias("treatment_rate"), _r(z).alias("z"),
                      (F.abs(z) > Z_95).alias("significant")).orderBy(date_col)


# ------------------------------------------------------------------ J10
def compare_to_control(players: DataFrame, metric: str = "retention_7", arm_col: str = "variant",
                       control: str = "v0", z_crit: float = Z_95) -> DataFrame:
    """Every variant against the control arm: rate, lift, pooled z and a ship/hold/rollback decision."""
    per = players.groupBy(arm_col).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(metric).cast("long")).alias("s"))
    ctl = per.where(F.col(arm_col) == control)
    x = per.where(F.col(arm_col) != control).withColumns({  # control figures as scalar subqueries
        "n_c": F.coalesce(ctl.agg(F.max("n")).scalar(), F.lit(0)),
        "s_c": ctl.agg(F.max("s")).scalar()})
    n = F.nullif(F.col("n").cast("double"), F.lit(0.0))
    nc = F.nullif(F.col("n_c").cast("double"), F.lit(0.0))
    p, pc = F.try_divide(F.col("s").cast("double"), n), F.try_divide(F.col("s_c").cast("double"), nc)
    pooled = F.try_divide((F.col("s") + F.col("s_c")).cast("double"), n + nc)
    se = F.sqrt(pooled * (1.0 - pooled) * (1.0 / n + 1.0 / nc))
    z = F.try_divide(p - pc, F.nullif(se, F.lit(0.0)))
    decision = F.when(F.abs(z) > z_crit, F.when(p > pc, "ship").otherwise("rollback")).otherwise("hold")
    return x.select(arm_col, "n", "n_c", _r(p).alias("rate"), _r(pc).alias("control_rate"),
                    _r(p - pc).alias("lift"), _r(z).alias("z"), decision.alias("decision")).orderBy(arm_col)
