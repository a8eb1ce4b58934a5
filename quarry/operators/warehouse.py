"""Star-schema build and table profiling.

Plan notes.
* ``dim_team`` picks one row per id with ``min_by`` over an ordering struct:
  a partial aggregate, so a team id with a huge number of name variants is
  combined map-side instead of landing in one window task.
* ``dim_event`` numbers games with ``range_numbered`` (plans/prefix.py): one
  range-partitioned sort by the whole order, so neither one date nor the games
  without a date are one task. Both name lookups are left joins against ``team_name_map``,
  a dimension whose size AQE measures before it decides to broadcast.
* Settlement groups legs by ``bet_id`` with partial aggregates (product of
  odds, any/all flags), then joins the per-bet result to the bets once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.aggs import money
from quarry.functions.scalar import (
    american_to_decimal,
    blank_to_null,
    parse_date,
    signed_by_side,
    to_bool,
    week_to_number,
)
from quarry.plans.prefix import range_numbered

# ------------------------------------------------------------------ I-W1
def dim_team(raw_teams: DataFrame) -> DataFrame:
    """One canonical row per team id: a row with a division first, then the longest name."""
    t = raw_teams.where(F.col("team_id").isNotNull())
    has_div = F.col("team_division").isNotNull() & (F.col("team_division") != "")
    rank_key = F.struct((~has_div).alias("no_div"), (-F.length("team_name")).alias("neg_len"),
                        F.col("team_name").alias("name"))
    row = F.struct(F.col("team_name").alias("team_name"), F.col("team_conference").alias("conference"),
                   blank_to_null("team_division").alias("division"))
    best = t.groupBy("team_id").agg(F.min_by(row, rank_key).alias("r"))
    return best.select("team_id", "r.team_name", "r.conference", "r.division")


# ------------------------------------------------------------------ I-W2 / A11
def team_name_map(spark: SparkSession, raw_teams: DataFrame, alias_rows: Sequence[tuple[str, str]]) -> DataFrame:
    """Distinct (name, id) pairs plus literal alias rows, de-duplicated (Q1)."""
    base = raw_teams.where(F.col("team_name").isNotNull() & F.col("team_id").isNotNull()) \
        .select("team_name", "team_id")
    extra = spark.createDataFrame(list(alias_rows), "team_name string, team_id string")
    return base.unionByName(extra).distinct()


# ------------------------------------------------------------------ I-W3
def dim_event(raw_scores: DataFrame, name_map: DataFrame) -> DataFrame:
    """Parse the score sheet into ``dim_event`` with a surrogate key."""
    s = raw_scores.select(
        parse_date("schedule_date").alias("game_date"),
        F.col("schedule_season").cast("string").try_cast("int").alias("season"),
        F.col("schedule_week"),
        week_to_number("schedule_week").alias("week"),
        "team_home", "team_away",
        F.col("score_home").cast("string").try_cast("int").alias("home_score"),
        F.col("score_away").cast("string").try_cast("int").alias("away_score"),
        F.col("spread_favorite").cast("string").try_cast("double").alias("spread_favorite_raw"),
        F.col("over_under_line").cast("string").try_cast("double").alias("total_line"),
        to_bool("schedule_playoff").alias("is_playoff"),
        "team_favorite_id",
    )
    # Surrogate key over the whole sheet before the validity filter (Q3: ids keep gaps).
    numbered = range_numbered(
        s,
        order=[F.col("game_date").asc_nulls_last(), F.col("season").asc_nulls_last(),
               F.col("schedule_week").asc_nulls_last(), F.col("team_home").asc_nulls_last(),
               F.col("team_away").asc_nulls_last()], name="event_id")
    home = name_map.select(F.col("team_name").alias("team_home"), F.col("team_id").alias("home_team_id"))
    away = name_map.select(F.col("team_name").alias("team_away"), F.col("team_id").alias("away_team_id"))
    j = numbered.join(home, "team_home", "left").join(away, "team_away", "left")
    out = j.select(
        F.col("event_id").cast("long").alias("event_id"), "season", "week", "game_date",
        "home_team_id", "away_team_id", "home_score", "away_score",
        signed_by_side("team_favorite_id", "home_team_id", "away_team_id", "spread_favorite_raw").alias("spread_line"),
        "total_line", "is_playoff",
    )
    valid = (F.col("home_team_id").isNotNull() & F.col("away_team_id").isNotNull() & F.col("season").isNotNull()
             & F.col("game_date").isNotNull() & F.col("home_score").isNotNull() & F.col("away_score").isNotNull())
    return out.where(valid)


# ------------------------------------------------------------------ I-W5
def settle_legs(legs: DataFrame, events: DataFrame) -> DataFrame:
    """Settle each leg against its event's result (spread, total, moneyline)."""
    e = events.select("event_id", (F.col("home_score") - F.col("away_score")).alias("home_margin"),
                      (F.col("home_score") + F.col("away_score")).alias("total_points"))
    x = legs.join(e, "event_id")
    sel, line, m = F.col("selection"), F.col("line_value"), F.col("market_type")

    def sign_result(v):
        return F.when(v > 0, "win").when(v < 0, "lose").otherwise("push")

    spread_vs_line = F.when(sel == "home", F.col("home_margin") + line).otherwise(-F.col("home_margin") + line)
    delta = F.col("total_points") - line
    total_res = F.when(sel == "over", sign_result(delta)).otherwise(sign_result(-delta))
    home_won = F.col("home_margin") > 0
    ml_res = F.when(sel == "home", F.when(home_won, "win").otherwise("lose")) \
        .otherwise(F.when(~home_won, "win").otherwise("lose"))
    result = (F.when(m == "spread", sign_result(spread_vs_line))
              .when(m == "total", total_res)
              .otherwise(ml_res))
    return x.withColumn("computed_result", result).select(*legs.columns, "computed_result")


# ------------------------------------------------------------------ I-W6
def settle_bets(bets: DataFrame, legs: DataFrame, result_col: str = "settled_result") -> DataFrame:
    """Bet payout and status from its legs: any loss -> 0; all push -> stake; else stake x prod(odds of wins)."""
    r = F.col(result_col)
    dec = F.coalesce(F.col("decimal_odds"), american_to_decimal("american_odds"))
    per_bet = legs.groupBy("bet_id").agg(
        F.bool_or(r == "lose").alias("has_loss"),
        F.bool_and(r == "push").alias("all_push"),
        F.product(F.when(r == "win", dec).otherwise(F.lit(1.0))).alias("multiplier"),
        F.avg(dec).alias("avg_odds"),
        F.count(F.lit(1)).alias("legs"),
    )
    x = bets.select("bet_id", "stake_amount").join(per_bet, "bet_id")
    payout = F.when(F.col("has_loss"), F.lit(0.0)).otherwise(F.col("stake_amount") * F.col("multiplier"))
    status = F.when(F.col("has_loss"), "lose").when(F.col("all_push"), "push").otherwise("win")
    return x.select("bet_id", "legs", F.round("avg_odds", 6).alias("odds_decimal_avg"),
                    money(payout).alias("gross_payout"), status.alias("status"))


# ------------------------------------------------------------------ I-W7 / I-W4
FEE_RATE = 0.012
TAX_RATE = 0.03


def bet_costs(bets: DataFrame, promo_cost: DataFrame | None = None) -> DataFrame:
    """Cost row per bet: fee 1.2 % of stake, tax 3 % of positive gross profit, given promo cost."""
    x = bets.select("bet_id", "stake_amount", "gross_payout")
    if promo_cost is not None:
        x = x.join(promo_cost.select("bet_id", "promo_cost"), "bet_id", "left")
    else:
        x = x.withColumn("promo_cost", F.lit(0.0))
    promo = F.coalesce(F.col("promo_cost"), F.lit(0.0))
    fee = F.col("stake_amount") * FEE_RATE
    tax = F.greatest(F.lit(0.0), F.col("stake_amount") - F.col("gross_payout")) * TAX_RATE
    return x.select(F.col("bet_id").alias("cost_id"), "bet_id", promo.alias("promo_cost"),
                    fee.alias("payment_fee"), tax.alias("tax"), (promo + fee + tax).alias("total_cost"))


# ------------------------------------------------------------------ I-W8
def table_row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row holding ``<name>_rows`` for every table (each count a scalar subquery over its own scan)."""
    first = next(iter(tables.values()))
    return first.sparkSession.range(1).select(
        *[df.agg(F.count(F.lit(1))).scalar().alias(f"{name}_rows") for name, df in tables.items()])


# ------------------------------------------------------------------ I-P1
def profile_columns(df: DataFrame) -> DataFrame:
    """Column profile: type, null count/share, smallest and largest value, exact single-column key candidates.

    The cells are counted by (column, value) with map-side partial counts, then by
    column, so every column gets the exact test in one pass and no value of a column
    has to fit into one task. Extremes compare by the column's own type and are given
    as text. A column of an empty table is no key.
    """
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).cast("string").alias("value"))
                                          for i, c in enumerate(df.columns)])).alias("cell")).select("cell.*")
    values = cells.groupBy("i", "value").agg(F.count(F.lit(1)).alias("n"))
    found = values.groupBy("i").agg(F.sum("n").alias("rows"), F.sum(F.when(F.col("value").isNull(), F.col("n"))).alias("nulls"),
                                    F.count("value").alias("distinct"))
    ends = df.agg(*[f(c).cast("string").alias(f"{name}{i}") for i, c in enumerate(df.columns) for name, f in (("lo", F.min), ("hi", F.max))])
    names = ends.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(c).alias("column_name"), F.lit(t).alias("column_type"),
                                                     F.col(f"lo{i}").alias("min_value"), F.col(f"hi{i}").alias("max_value"))
                                            for i, (c, t) in enumerate(df.dtypes)])).alias("c")).select("c.*")
    rows, nulls = F.coalesce("rows", F.lit(0)), F.coalesce("nulls", F.lit(0))
    return names.join(found, "i", "left").select(
        "column_name", "column_type", rows.alias("row_count"), nulls.alias("null_count"),
        F.coalesce(F.try_divide(nulls.cast("double"), rows.cast("double")), F.lit(0.0)).alias("null_pct"), "min_value", "max_value",
        F.coalesce(F.col("distinct") == F.col("rows"), F.lit(False)).alias("is_key_candidate"))


def composite_key_search(df: DataFrame, candidates: Sequence[Sequence[str]]) -> DataFrame:
    """D5 for many candidate keys in one shuffle: rows with all columns non-null, distinct tuples among them, whether it is a key.

    Each row gives one (candidate, 128-bit hash of its tuple) per candidate, counted with
    map-side partial counts. A hash that occurs once is one tuple; only tuples whose hash
    occurs again are compared whole, so the counts are exact.
    """
    def entries(with_tuple: bool):
        parts = []
        for i, cols in enumerate(candidates):
            known = F.lit(True)
            for c in cols:
                known = known & F.col(c).isNotNull()
            texts = [F.col(c).cast("string") for c in cols]
            fields = [F.lit(i).alias("i"), F.xxhash64(*texts).alias("h1"), F.xxhash64(F.lit(i + 1), *reversed(texts)).alias("h2")]
            if with_tuple:
                fields.append(F.array(*texts).alias("tuple"))
            parts.append(F.when(known, F.struct(*fields)))
        return df.select(F.explode(F.filter(F.array(*parts), lambda e: e.isNotNull())).alias("e")).select("e.*")

    counts = entries(False).groupBy("i", "h1", "h2").agg(F.count(F.lit(1)).alias("n"))
    sure = counts.groupBy("i").agg(F.sum("n").alias("c_all"), F.count_if(F.col("n") == 1).alias("once"))
    again = entries(True).join(counts.where("n > 1").select("i", "h1", "h2"), ["i", "h1", "h2"], "left_semi") \
        .groupBy("i", "tuple").agg(F.count(F.lit(1)).alias("n")).groupBy("i").agg(F.count(F.lit(1)).alias("more"))
    names = df.sparkSession.range(1).select(F.posexplode(F.array(*[F.lit(",".join(c)) for c in candidates])).alias("i", "key_columns"))
    distinct = F.coalesce("once", F.lit(0)) + F.coalesce("more", F.lit(0))
    every = F.coalesce("c_all", F.lit(0))
    return names.join(sure, "i", "left").join(again, "i", "left").select(
        "key_columns", every.alias("c_all"), distinct.alias("c_distinct"), (every == distinct).alias("is_key_candidate"))
