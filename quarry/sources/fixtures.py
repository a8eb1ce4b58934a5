"""Fixture adapters: the reference's input schemas derived from /root/testdata.

The reference ships no raw data, so each input it reads (ledger facts, team
list, score sheet, A/B players, covid series, housing sales, ...) is derived
from the driver tables by a fixed rule (FIXTURES.md §2). Every adapter here is
a lazy DataFrame; the identical rule is written once more as DuckDB SQL in
``fixture_sql.py`` for the oracle.

All adapters are narrow projections (no shuffle) unless stated: the join
structure of the reference lives in the operators, not here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.scalar import american_to_decimal
from quarry.plans.prefix import keyed_running
from quarry.sources.tables import table

# Fixed values of the fixture mapping (FIXTURES.md §2).
SEGMENT_OF_MKTSEGMENT = {
    "AUTOMOBILE": "sharp",
    "BUILDING": "regular",
    "MACHINERY": "regular",
    "FURNITURE": "casual",
    "HOUSEHOLD": "promo_hunter",
}
BET_TYPE_OF_PRIORITY = {
    "1-URGENT": "moneyline",
    "2-HIGH": "spread",
    "5-LOW": "spread",
    "3-MEDIUM": "total",
    "4-NOT SPECIFIED": "parlay",
}
STATUS_OF_ORDERSTATUS = {"F": "lose", "O": "win", "P": "push"}
WIN_MULTIPLIER = 1.9
PROMO_EVERY_NTH_BET = 7
PROMO_SHARE_OF_STAKE = 0.05
ALIASED_TEAM_KEYS = (5, 11)


def _map(col, mapping: dict, default=None):
    expr = None
    for k, v in mapping.items():
        expr = (F.when(col == k, F.lit(v)) if expr is None else expr.when(col == k, F.lit(v)))
    return expr.otherwise(F.lit(default)) if default is not None else expr


# ------------------------------------------------------------------ ledger
def dim_customer(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer", "c_custkey", "c_acctbal", "c_mktsegment")
    k = F.col("c_custkey")
    return c.select(
        k.alias("customer_id"),
        _map(F.col("c_mktsegment"), SEGMENT_OF_MKTSEGMENT).alias("segment"),
        (F.abs(F.col("c_acctbal")) / 20.0).alias("avg_bet_size"),
        (F.lit(1) + k % 5).cast("double").alias("bets_per_week"),
        F.lit(0.25).alias("pref_moneyline"),
        F.lit(0.45).alias("pref_spread"),
        F.lit(0.25).alias("pref_total"),
        F.lit(0.05).alias("pref_parlay"),
        ((k % 10).cast("double") / 10.0).alias("promo_sensitivity"),
    )


def _bet_columns(o: DataFrame) -> DataFrame:
    stake = F.col("o_totalprice")
    status = _map(F.col("o_orderstatus"), STATUS_OF_ORDERSTATUS)
    payout = (
        F.when(F.col("o_orderstatus") == "O", stake * WIN_MULTIPLIER)
        .when(F.col("o_orderstatus") == "P", stake)
        .otherwise(F.lit(0.0))
    )
    return o.select(
        F.col("o_orderkey").alias("bet_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderdate").alias("bet_datetime"),
        _map(F.col("o_orderpriority"), BET_TYPE_OF_PRIORITY).alias("bet_type"),
        stake.alias("stake_amount"),
        F.lit(WIN_MULTIPLIER).alias("odds_decimal_avg"),
        payout.alias("gross_payout"),
        status.alias("status"),
    )


def fact_bet(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority",
              "o_totalprice", "o_orderstatus")
    return _bet_columns(o)


def fact_bet_cost(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders", "o_orderkey", "o_totalprice", "o_orderstatus")
    stake = F.col("o_totalprice")
    payout = (
        F.when(F.col("o_orderstatus") == "O", stake * WIN_MULTIPLIER)
        .when(F.col("o_orderstatus") == "P", stake)
        .otherwise(F.lit(0.0))
    )
    promo = F.when(F.col("o_orderkey") % PROMO_EVERY_NTH_BET == 0, stake * PROMO_SHARE_OF_STAKE).otherwise(F.lit(0.0))
    fee = stake * 0.012
    tax = F.greatest(F.lit(0.0), stake - payout) * 0.03
    return o.select(
        F.col("o_orderkey").alias("cost_id"),
        F.col("o_orderkey").alias("bet_id"),
        promo.alias("promo_cost"),
        fee.alias("payment_fee"),
        tax.alias("tax"),
        (promo + fee + tax).alias("total_cost"),
    )


def fact_bet_leg(spark: SparkSession, sf: str, numbered: bool = True) -> DataFrame:
    """Legs from lineitem; ``leg_no`` numbers the lines of one order.

    The numbering is a distributed ordered scan split by line number, so even
    an order holding a large share of all lines is not numbered in one task.
    Callers that never read ``bet_leg_id``/``leg_no`` pass ``numbered=False``
    and skip that scan (an inner join cannot be pruned away by the optimizer).
    """
    li = table(spark, sf, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
               "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
    orders = table(spark, sf, "orders", "o_orderkey")
    li = li.join(orders, li.l_orderkey == orders.o_orderkey, "left_semi")
    if numbered:
        li = keyed_running(li, ["l_orderkey"], order=["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity",
                                  "l_discount", "l_tax", "l_shipdate"], sums={}, count_name="__leg_no")
    else:
        li = li.withColumn("__leg_no", F.lit(None).cast("long"))
    market = F.when(F.col("l_returnflag") == "A", "moneyline").when(F.col("l_returnflag") == "R", "spread").otherwise("total")
    is_o = F.col("l_linestatus") == "O"
    selection = (F.when(market == "total", F.when(is_o, "over").otherwise("under"))
                 .otherwise(F.when(is_o, "home").otherwise("away")))
    q = F.col("l_quantity")
    odds = F.when(q > 25, 5 * q).otherwise(-(100 + 4 * q)).cast("int")
    pk = F.col("l_partkey")
    line = F.when(market == "spread", (pk % 15 - 7).cast("double")).when(market == "total", (35 + pk % 20).cast("double"))
    result = F.when(pk % 3 == 0, "win").when(pk % 3 == 1, "lose").otherwise("push")
    leg_no = F.col("__leg_no")
    return li.select(
        (F.col("l_orderkey") * 100 + leg_no).alias("bet_leg_id"),
        F.col("l_orderkey").alias("bet_id"),
        leg_no.cast("int").alias("leg_no"),
        F.col("l_suppkey").alias("event_id"),
        market.alias("market_type"),
        selection.alias("selection"),
        line.alias("line_value"),
        odds.alias("american_odds"),
        american_to_decimal(odds).alias("decimal_odds"),
        (result == "win").alias("is_win"),
        (result == "push").alias("is_push"),
        result.alias("settled_result"),
    )


def dim_event(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier", "s_suppkey", "s_nationkey")
    k = F.col("s_suppkey")
    season = (2010 + k % 10).cast("int")
    week = (k % 22 + 1).cast("int")
    return s.select(
        k.alias("event_id"),
        season.alias("season"),
        week.alias("week"),
        F.date_add(F.make_date(season, F.lit(9), F.lit(1)), 7 * (week - 1)).alias("game_date"),
        F.col("s_nationkey").cast("string").alias("home_team_id"),
        ((F.col("s_nationkey") + 7) % 25).cast("string").alias("away_team_id"),
        (k % 41).cast("int").alias("home_score"),
        ((7 * k) % 38).cast("int").alias("away_score"),
        (k % 15 - 7).cast("double").alias("spread_line"),
        (35 + k % 20).cast("double").alias("total_line"),
        (week >= 19).alias("is_playoff"),
    )


# ------------------------------------------------------------------ teams and score sheet
def raw_teams(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation", "n_nationkey", "n_name", "n_regionkey")
    r = table(spark, sf, "region", "r_regionkey", "r_name")
    nr = n.join(r, n.n_regionkey == r.r_regionkey)
    key = F.col("n_nationkey")

    def rows(name, division):
        return nr.select(
            name.alias("team_name"),
            F.concat(F.lit("N"), key.cast("string")).alias("team_name_short"),
            key.cast("string").alias("team_id"),
            F.concat(F.lit("n"), key.cast("string")).alias("team_id_pfr"),
            F.col("r_name").alias("team_conference"),
            division.alias("team_division"),
            F.col("r_name").alias("team_conference_pre2002"),
            F.concat(F.col("r_name"), F.lit(" "), (key % 3).cast("string")).alias("team_division_pre2002"),
        )

    main = rows(F.col("n_name"), F.when(key % 5 != 0, F.concat(F.col("r_name"), F.lit(" "), (key % 5).cast("string"))))
    alias = rows(F.concat(F.col("n_name"), F.lit(" (old)")), F.lit(None).cast("string")).where(key.isin(*ALIASED_TEAM_KEYS))
    # Every customer is a historical name variant of its nation's team (no division): the list grows with the data.
    c = table(spark, sf, "customer", "c_custkey", "c_name", "c_nationkey")
    variants = c.join(nr, c.c_nationkey == nr.n_nationkey).select(
        F.col("c_name").alias("team_name"),
        F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("team_name_short"),
        key.cast("string").alias("team_id"),
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("team_id_pfr"),
        F.col("r_name").alias("team_conference"),
        F.lit(None).cast("string").alias("team_division"),
        F.col("r_name").alias("team_conference_pre2002"),
        F.concat(F.col("r_name"), F.lit(" "), (key % 3).cast("string")).alias("team_division_pre2002"),
    )
    return main.unionByName(alias).unionByName(variants)


def raw_scores(spark: SparkSession, sf: str) -> DataFrame:
    """``dim_event`` rendered as a text score sheet (mixed date formats, week names, blanks)."""
    e = dim_event(spark, sf)
    n = table(spark, sf, "nation", "n_nationkey", "n_name")
    home = n.select(F.col("n_nationkey").cast("string").alias("home_team_id"), F.col("n_name").alias("home_name"))
    away = n.select(F.col("n_nationkey").cast("string").alias("away_team_id"), F.col("n_name").alias("away_name"))
    e = e.join(home, "home_team_id", "left").join(away, "away_team_id", "left")
    k = F.col("event_id")
    date_text = (F.when(k % 50 == 0, F.lit("TBD"))
                 .when(k % 2 == 0, F.date_format("game_date", "yyyy-MM-dd"))
                 .otherwise(F.date_format("game_date", "M/d/yyyy")))
    week_text = (F.when(F.col("week") == 19, "Wildcard").when(F.col("week") == 20, "Division")
                 .when(F.col("week") == 21, "Championship").when(F.col("week") == 22, "Superbowl")
                 .otherwise(F.col("week").cast("string")))
    home_name = F.when((k % 4 == 0) & F.col("home_team_id").isin(*[str(x) for x in ALIASED_TEAM_KEYS]),
                       F.concat(F.col("home_name"), F.lit(" (old)"))).otherwise(F.col("home_name"))
    line = F.col("spread_line")
    favorite = (F.when(line < 0, F.col("home_team_id")).when(line > 0, F.col("away_team_id")).otherwise(F.lit("PICK")))
    spread_fav = F.when(line < 0, line).when(line > 0, -line).otherwise(F.lit(0.0))
    over_under = F.when(k % 6 == 0, F.lit("")).otherwise(F.col("total_line").cast("string"))
    detail = (F.when(k % 7 == 0, "Rain").when(k % 7 == 1, "DOME").when(k % 7 == 2, "Snow | Fog"))
    return e.select(
        date_text.alias("schedule_date"),
        F.col("season").cast("long").alias("schedule_season"),
        week_text.alias("schedule_week"),
        F.col("is_playoff").alias("schedule_playoff"),
        home_name.alias("team_home"),
        F.col("home_score").cast("long").alias("score_home"),
        F.col("away_score").cast("long").alias("score_away"),
        F.col("away_name").alias("team_away"),
        favorite.alias("team_favorite_id"),
        spread_fav.alias("spread_favorite"),
        over_under.alias("over_under_line"),
        F.concat(F.lit("Stadium "), F.col("home_team_id")).alias("stadium"),
        (F.col("week") == 22).alias("stadium_neutral"),
        (30 + k % 60).alias("weather_temperature"),
        (k % 25).alias("weather_wind_mph"),
        (k % 100).alias("weather_humidity"),
        detail.alias("weather_detail"),
    )


# ------------------------------------------------------------------ housing sales (cleaning)
DUPLICATE_EVERY_NTH = 20
DUPLICATE_ID_OFFSET = 10**9


def housing(spark: SparkSession, sf: str) -> DataFrame:
    """Sales rows from orders; every 20th sale appears twice with a new UniqueID."""
    o = table(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "o_orderpriority")
    c = table(spark, sf, "customer", "c_custkey", "c_name", "c_nationkey")
    n = table(spark, sf, "nation", "n_nationkey", "n_name", "n_regionkey")
    r = table(spark, sf, "region", "r_regionkey", "r_name")
    geo = n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", "n_name", "r_name")
    x = o.join(c, o.o_custkey == c.c_custkey).join(geo, F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("o_orderkey")
    vacant = F.when(k % 4 == 0, "Y").when(k % 4 == 1, "N").when(k % 4 == 2, "Yes").otherwise("No")
    base = x.select(
        k.alias("UniqueID"),
        F.col("o_custkey").cast("string").alias("ParcelID"),
        F.when(k % 10 != 0, F.concat_ws(", ", "c_name", "n_name")).alias("PropertyAddress"),
        F.col("o_orderdate").alias("SaleDate"),
        F.col("o_totalprice").alias("SalePrice"),
        F.col("o_orderpriority").alias("LegalReference"),
        vacant.alias("SoldAsVacant"),
        F.concat_ws(", ", "c_name", "n_name", "r_name").alias("OwnerAddress"),
        F.col("r_name").alias("TaxDistrict"),
    )
    dup = base.where(F.col("UniqueID") % DUPLICATE_EVERY_NTH == 0) \
        .withColumn("UniqueID", F.col("UniqueID") + DUPLICATE_ID_OFFSET)
    return base.unionByName(dup)


# ------------------------------------------------------------------ covid-style series (exploration)
def _nation_geo(spark, sf):
    n = table(spark, sf, "nation", "n_nationkey", "n_name", "n_regionkey")
    r = table(spark, sf, "region", "r_regionkey", "r_name")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(
        "n_nationkey", F.col("n_name").alias("location"),
        F.when(F.col("n_nationkey") != 0, F.col("r_name")).alias("continent"))


def covid_deaths(spark: SparkSession, sf: str) -> DataFrame:
    """Daily orders per nation as cases (failed ones as deaths, text), running totals, population."""
    o = table(spark, sf, "orders", "o_custkey", "o_orderdate", "o_orderstatus")
    c = table(spark, sf, "customer", "c_custkey", "c_nationkey")
    daily = (o.join(c, o.o_custkey == c.c_custkey)
             .groupBy(F.col("c_nationkey").alias("n_nationkey"), F.col("o_orderdate").alias("date"))
             .agg(F.count(F.lit(1)).cast("double").alias("new_cases"),
                  F.count_if(F.col("o_orderstatus") == "F").alias("deaths")))
    pop = c.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg((F.count(F.lit(1)) * 1000).alias("population"))
    run = keyed_running(daily, ["n_nationkey"], order=["date"],
                        sums={"total_cases": F.col("new_cases"), "total_deaths_n": F.col("deaths")})
    return (run.join(_nation_geo(spark, sf), "n_nationkey").join(pop, "n_nationkey")
            .select("continent", "location", "date", F.col("population").cast("decimal(18,0)").alias("population"),
                    "total_cases", "new_cases", F.col("total_deaths_n").cast("string").alias("total_deaths"),
                    F.col("deaths").cast("string").alias("new_deaths")))


def covid_vaccinations(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem", "l_orderkey", "l_quantity")
    o = table(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    c = table(spark, sf, "customer", "c_custkey", "c_nationkey")
    daily = (li.join(o, li.l_orderkey == o.o_orderkey).join(c, F.col("o_custkey") == F.col("c_custkey"))
             .groupBy(F.col("c_nationkey").alias("n_nationkey"), F.col("o_orderdate").alias("date"))
             .agg(F.sum("l_quantity").cast("long").cast("string").alias("new_vaccinations")))
    return daily.join(_nation_geo(spark, sf), "n_nationkey").select("location", "date", "new_vaccinations")


# ------------------------------------------------------------------ games (team statistics)
def games(spark: SparkSession, sf: str) -> DataFrame:
    """One game per order: home = customer nation, away derived from the key; text-free score sheet."""
    o = table(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    c = table(spark, sf, "customer", "c_custkey", "c_nationkey")
    x = o.join(c, o.o_custkey == c.c_custkey)
    k = F.col("o_orderkey")
    home = F.col("c_nationkey")
    away = (home + 1 + k % 24) % 25
    d = F.to_date("o_orderdate")
    fav = F.when(k % 3 == 0, home.cast("string")).when(k % 3 == 1, away.cast("string")).otherwise(F.lit("PICK"))
    return x.select(
        k.alias("game_id"),
        d.alias("schedule_date"),
        F.year(d).alias("schedule_season"),
        (F.floor((F.dayofyear(d) - 1) / 7) + 1).cast("int").alias("schedule_week"),
        (F.floor((F.dayofyear(d) - 1) / 7) + 1 > 50).alias("schedule_playoff"),
        home.cast("string").alias("team_home_id"),
        away.cast("string").alias("team_away_id"),
        (F.floor("o_totalprice") % 45).cast("int").alias("score_home"),
        (F.floor(F.col("o_totalprice") / 7) % 45).cast("int").alias("score_away"),
        fav.alias("team_favorite_id"),
        F.when(k % 3 == 2, F.lit(0.0)).otherwise((-(k % 14)).cast("double") / 2.0).alias("spread_favorite"),
        ((35 + k % 20).cast("double") + F.when(k % 2 == 0, 0.5).otherwise(0.0)).alias("over_under_line"),
        (k % 50 == 0).alias("stadium_neutral"),
        F.when(k % 13 != 0, (20 + k % 70).cast("int")).alias("weather_temperature"),
        (k % 25).cast("int").alias("weather_wind_mph"),
        F.when(k % 7 == 0, "Rain").when(k % 7 == 1, "DOME").when(k % 7 == 2, "Snow | Fog")
        .when(k % 7 == 3, "rain showers").alias("weather_detail"),
        F.when(k % 5 != 0, (k % 100).cast("int")).alias("weather_humidity"),
        F.concat(F.lit("Stadium "), home.cast("string")).alias("stadium"),
        (1300 + (home * 37) % 400).cast("double").alias("team_home_elo_pre"),
        (1300 + (away * 37) % 400).cast("double").alias("team_away_elo_pre"),
    )


# ------------------------------------------------------------------ A/B players
def ab_players(spark: SparkSession, sf: str) -> DataFrame:
    """One row per user: arm by parity, day-1/day-7 return flags, rounds = clicks with value > 100,
    first-day events as the pre-period covariate.

    Events are first reduced to one row per (user, day), so a user with a huge
    share of the events is at most one row per day when joined to its anchor.
    """
    e = table(spark, sf, "events", "user_id", "ts", "event_type", "value")
    daily = e.groupBy("user_id", F.to_date("ts").alias("d")).agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if((F.col("event_type") == "click") & (F.col("value") > 100)).alias("rounds"))
    first = daily.groupBy("user_id").agg(F.min("d").alias("anchor"))
    x = daily.join(first, "user_id").withColumn("dd", F.datediff("d", "anchor"))
    u = x.groupBy("user_id").agg(
        F.max(F.col("dd") == 1).alias("retention_1"),
        F.max(F.col("dd") == 7).alias("retention_7"),
        F.sum("rounds").alias("sum_gamerounds"),
        F.sum(F.when(F.col("dd") == 0, F.col("events")).otherwise(0)).alias("events_first_day"),
        F.min("anchor").alias("install_date"),
    )
    return u.select(
        F.col("user_id").alias("userid"),
        F.when(F.col("user_id") % 2 == 0, "gate_30").otherwise("gate_40").alias("version"),
        F.concat(F.lit("v"), (F.col("user_id") % 4).cast("string")).alias("variant"),
        "install_date", "sum_gamerounds", "retention_1", "retention_7", "events_first_day")


# ------------------------------------------------------------------ scenario runs, assets, matches, movies
RUNS = 12


def run_bets(spark: SparkSession, sf: str) -> DataFrame:
    """``fact_bet`` with ``run_id = customer_id % 12`` (independent simulated runs)."""
    return fact_bet(spark, sf).withColumn("run_id", (F.col("customer_id") % RUNS).cast("int"))


def asset_prices(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly price and market cap per brand from lineitem ⨝ part."""
    li = table(spark, sf, "lineitem", "l_partkey", "l_quantity", "l_extendedprice", "l_shipdate")
    p = table(spark, sf, "part", "p_partkey", "p_brand")
    x = li.join(p, li.l_partkey == p.p_partkey)
    return x.groupBy(F.col("p_brand").alias("asset"), F.trunc(F.to_date("l_shipdate"), "month").alias("date")) \
        .agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
             F.round(F.sum("l_extendedprice"), 2).alias("market_cap"))


def holdings(spark: SparkSession, sf: str) -> DataFrame:
    """Quantity held per brand: 1 + the brand number."""
    p = table(spark, sf, "part", "p_brand")
    return p.select("p_brand").distinct().select(
        F.col("p_brand").alias("asset"),
        (1 + F.regexp_extract("p_brand", r"(\d+)$", 1).cast("int")).cast("double").alias("quantity"))


def matches(spark: SparkSession, sf: str) -> DataFrame:
    """Match rows from lineitem with a learnable winner (quantity) and 10 % label noise."""
    li = table(spark, sf, "lineitem", "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_discount",
               "l_shipdate")
    pk, q = F.col("l_partkey"), F.col("l_quantity")
    flip = (pk % 10 == 0)
    winner = F.when((q > 25) != flip, 2).otherwise(1).cast("int")
    cols = [F.col("l_orderkey").alias("gameId"), F.unix_timestamp("l_shipdate").alias("creationTime"),
            (F.year("l_shipdate") % 10).cast("int").alias("seasonId"), winner.alias("winner")]
    firsts = ["firstBlood", "firstTower", "firstInhibitor", "firstBaron", "firstDragon", "firstRiftHerald"]
    cols += [((pk + i) % 3).cast("int").alias(n) for i, n in enumerate(firsts)]
    cols += [F.floor(q / 5).cast("int").alias("t1_towerKills"), (F.col("l_linenumber") % 4).cast("int").alias("t1_inhibitorKills"),
             (F.floor(F.col("l_discount") * 100) % 3).cast("int").alias("t1_baronKills"),
             (q % 5).cast("int").alias("t1_dragonKills"), (pk % 3).cast("int").alias("t1_riftHeraldKills"),
             F.floor((51 - q) / 5).cast("int").alias("t2_towerKills"), ((pk + 1) % 4).cast("int").alias("t2_inhibitorKills"),
             ((pk + 2) % 3).cast("int").alias("t2_baronKills"), ((q + 2) % 5).cast("int").alias("t2_dragonKills"),
             ((pk + 1) % 2).cast("int").alias("t2_riftHeraldKills")]
    return li.select(*cols)


def movies(spark: SparkSession, sf: str) -> DataFrame:
    """Film-like rows from lineitem ⨝ part: numbers with nulls, strings, release text with the year last."""
    li = table(spark, sf, "lineitem", "l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount",
               "l_shipdate")
    p = table(spark, sf, "part", "p_partkey", "p_brand", "p_type", "p_size", "p_retailprice")
    x = li.join(p, li.l_partkey == p.p_partkey)
    hole = F.col("l_partkey") % 50 == 0
    return x.select(
        F.concat(F.lit("Film "), F.col("l_orderkey").cast("string")).alias("name"),
        F.col("p_brand").alias("company"), F.col("p_type").alias("genre"),
        F.concat(F.lit("Day, "), F.year("l_shipdate").cast("string"), F.lit(" x")).alias("released"),
        F.when(~hole, F.col("l_extendedprice")).alias("budget"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount")) * 3).alias("gross"),
        F.col("l_quantity").alias("votes"), F.col("p_size").cast("double").alias("runtime"),
        F.when(~hole, F.col("p_retailprice")).alias("score"))


def champion_docs(spark: SparkSession, sf: str) -> DataFrame:
    """One ``{"data": {key: {id, name}}}`` JSON document per event; odd events form the second file (wins)."""
    e = table(spark, sf, "events", "event_id", "event_type", "props")
    k = F.from_json("props", "map<string,int>")["k"]
    key = F.concat(F.col("event_type"), F.lit("_"), (k % 5).cast("string"))
    cid = k - 10
    name = F.concat(F.initcap("event_type"), F.lit(" "), k.cast("string"))
    doc = F.concat(F.lit('{"data": {"'), key, F.lit('": {"id": '), cid.cast("string"), F.lit(', "name": "'), name,
                   F.lit('"}}}'))
    return e.select(doc.alias("json"), ((F.col("event_id") % 2) * 1_000_000_000_000 + F.col("event_id")).alias("priority"))


# ------------------------------------------------------------------ product pages
def product_pages(spark: SparkSession, sf: str) -> DataFrame:
    """One product page a part: title element, price span with thousands separators; some without a price or with words for one."""
    p = table(spark, sf, "part", "p_partkey", "p_name", "p_retailprice")
    k = F.col("p_partkey")
    price = F.round(F.when(k % 3 == 0, F.col("p_retailprice")).when(k % 3 == 1, F.col("p_retailprice") % 40).otherwise(F.col("p_retailprice") * 10), 2)
    cents = F.round(price * 100).cast("long")
    whole = (cents / 100).cast("long")
    text = F.concat(F.when(whole >= 1000, F.concat((whole / 1000).cast("long").cast("string"), F.lit(","), F.lpad((whole % 1000).cast("string"), 3, "0")))
                    .otherwise(whole.cast("string")), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))
    span = F.when(k % 11 == 0, F.lit("")).when(k % 13 == 0, F.lit('<span class="a-price-whole">sold out</span>')) \
        .otherwise(F.concat(F.lit('<span class="x a-price-whole"> $'), text, F.lit(" </span>")))
    title = F.when(k % 17 == 0, F.lit("")).otherwise(F.concat(F.lit('<span id="productTitle" class="t">\n  <b>'), F.col("p_name"), F.lit("</b> </span>")))
    return p.select(k.alias("page_id"), F.concat(F.lit("https://shop.example.com/p/"), k.cast("string")).alias("url"),
                    F.concat(F.lit('<html lang="en"><body>'), title, span, F.lit("</body></html>")).alias("html"))
