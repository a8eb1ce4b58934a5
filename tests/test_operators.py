"""Unit tests on hand-made edge frames (boundary days, islands, settlement, splitting, statistics, pages)."""

import datetime as dt
import math

import pytest
from pyspark.sql import Row, Window
from pyspark.sql import functions as F

from quarry.functions.scalar import american_to_decimal, parse_date, week_to_number
from quarry.operators import cleaning, experiment, profile, promo, retention, teamstats, warehouse
from quarry.plans.prefix import as_of, keyed_running, ordered_parts, range_numbered


def d(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


@pytest.fixture(scope="module")
def boundary_bets(spark):
    days = {1: [0, 1, 7, 8, 23, 24, 30, 31, 53, 60, 83, 90, 91], 2: [0, 7], 3: [0, 8, 23, 53, 83, 91], 4: [0]}
    rows, bid = [], 0
    for cust, ds in days.items():
        for n in ds:
            bid += 1
            rows.append(Row(bet_id=bid, customer_id=cust, bet_datetime=d(n), stake_amount=10.0, gross_payout=0.0))
    bets = spark.createDataFrame(rows)
    customers = spark.createDataFrame([Row(customer_id=c, segment="sharp") for c in days])
    return bets, customers


def test_still_active_windows_are_half_open(boundary_bets):
    bets, customers = boundary_bets
    r = retention.still_active_by_segment(bets, customers).first()
    assert r.users == 4
    assert (r.still_active_7d, r.still_active_30d, r.still_active_60d, r.still_active_90d) == (0.5, 0.25, 0.25, 0.25)


def test_cumulative_retention(boundary_bets):
    bets, customers = boundary_bets
    r = retention.cumulative_retention_by_segment(bets, customers).first()
    assert (r.retention_7d, r.retention_30d, r.retention_90d) == (0.5, 0.75, 0.75)


def test_weekly_survival_grid(spark, boundary_bets):
    bets, customers = boundary_bets
    rows = {r.week_num: r.active_users for r in retention.weekly_survival(spark, bets, customers).collect()}
    assert len(rows) == 13
    assert rows[1] == 2 and rows[2] == 2 and rows[3] == 0 and rows[4] == 2 and rows[5] == 1 and rows[13] == 2


def _series(spark, values):
    return spark.createDataFrame([Row(wk=i + 1, cum_net_after_promo=float(v)) for i, v in enumerate(values)],
                                 "wk long, cum_net_after_promo double")


@pytest.mark.parametrize("values,first,sustained", [
    ([-5, -3, -1], None, None),
    ([-1, 2, -1, 3, 4, 5, 6], 2, 4),
    ([1, 1, 1, -1, 1, 1, 1, 1], 1, 5),
    ([], None, None),
])
def test_payback_weeks(spark, values, first, sustained):
    s = _series(spark, values)
    assert promo.first_payback_week(s).first().payback_week == first
    assert promo.sustained_payback_week(s).first().sustained_payback_week == sustained


def test_american_odds(spark):
    df = spark.createDataFrame([(150,), (-110,), (100,)], "o int").select(american_to_decimal("o").alias("d"))
    got = [r.d for r in df.collect()]
    assert got[0] == pytest.approx(2.5) and got[1] == pytest.approx(1 + 100 / 110) and got[2] == pytest.approx(2.0)


def test_bet_settlement(spark):
    legs = spark.createDataFrame([
        (1, "win", 2.5), (1, "lose", 1.9),       # parlay with a loss
        (2, "push", 1.9), (2, "push", 2.0),      # all push
        (3, "win", 2.5), (3, "push", 1.9),       # win + push: push counts 1
        (4, "win", 2.5),                          # single +150
    ], "bet_id long, settled_result string, decimal_odds double").withColumn("american_odds", F.lit(None).cast("int"))
    bets = spark.createDataFrame([(i, 100.0) for i in range(1, 5)], "bet_id long, stake_amount double")
    got = {r.bet_id: (r.gross_payout, r.status) for r in warehouse.settle_bets(bets, legs).collect()}
    assert got == {1: (0.0, "lose"), 2: (100.0, "push"), 3: (250.0, "win"), 4: (250.0, "win")}


def test_leg_settlement(spark):
    events = spark.createDataFrame([(1, 24, 20), (2, 20, 20)], "event_id long, home_score int, away_score int")
    legs = spark.createDataFrame([
        (1, 1, "spread", "home", -4.0),   # 24-20 = 4, -4 -> push
        (2, 1, "spread", "away", 3.5),    # -4 + 3.5 < 0 -> lose
        (3, 1, "total", "over", 43.5),    # 44 > 43.5 -> win
        (4, 1, "total", "under", 44.0),   # push
        (5, 2, "moneyline", "away", None),  # tie: home did not win -> away wins
    ], "bet_leg_id long, event_id long, market_type string, selection string, line_value double")
    got = {r.bet_leg_id: r.computed_result for r in warehouse.settle_legs(legs, events).collect()}
    assert got == {1: "push", 2: "lose", 3: "win", 4: "push", 5: "win"}


@pytest.mark.parametrize("text,addr,city", [
    ("A", "A", "A"), ("A, B", "A", " B"), ("A, B, C", "A", " B, C"), (None, None, None), ("", "", ""),
])
def test_split_first(spark, text, addr, city):
    a, c = cleaning.split_first(F.col("x"))
    r = spark.createDataFrame([(text,)], "x string").select(a.alias("a"), c.alias("c")).first()
    assert (r.a, r.c) == (addr, city)


@pytest.mark.parametrize("text,p3,p2,p1", [
    ("A, B, C", "A", " B", " C"), ("A, B", None, "A", " B"), ("A", None, None, "A"),
    ("A, B, C, D", " B", " C", " D"), ("A, B, C, D, E", None, None, None), (None, None, None, None),
])
def test_parse_name(spark, text, p3, p2, p1):
    df = spark.createDataFrame([(text,)], "x string")
    r = df.select(*[cleaning.parse_name("x", i).alias(f"p{i}") for i in (1, 2, 3)]).first()
    assert (r.p3, r.p2, r.p1) == (p3, p2, p1)


def test_fill_from_peer_and_dedup(spark):
    df = spark.createDataFrame([
        (1, "p1", None, 10.0), (2, "p1", "addr-1", 10.0), (3, "p1", "addr-0", 11.0), (4, "p2", None, 5.0),
    ], "UniqueID long, ParcelID string, PropertyAddress string, SalePrice double")
    filled = {r.UniqueID: r.PropertyAddress for r in cleaning.fill_from_peer(df, "ParcelID", "PropertyAddress", "UniqueID").collect()}
    assert filled == {1: "addr-1", 2: "addr-1", 3: "addr-0", 4: None}
    dup = spark.createDataFrame([(5, "k", 1.0, "x"), (2, "k", 1.0, "y"), (9, "j", 1.0, "z")],
                                "UniqueID long, ParcelID string, SalePrice double, other string")
    kept = {r.UniqueID: r.other for r in cleaning.drop_duplicate_rows(dup, ["ParcelID", "SalePrice"]).collect()}
    assert kept == {2: "y", 9: "z"}


@pytest.mark.parametrize("text,expected", [
    ("2020-01-05", dt.date(2020, 1, 5)), ("1/5/2020", dt.date(2020, 1, 5)), ("garbage", None), (None, None),
])
def test_parse_date(spark, text, expected):
    assert spark.createDataFrame([(text,)], "x string").select(parse_date("x").alias("d")).first().d == expected


def test_week_names(spark):
    df = spark.createDataFrame([("3",), ("Wildcard",), ("Division",), ("Conference Championship",), ("SuperBowl",),
                                ("bye",)], "w string")
    assert [r.n for r in df.select(week_to_number("w").alias("n")).collect()] == [3, 19, 20, 21, 22, None]


def test_p_value_goldens(spark):
    df = spark.createDataFrame([(1.577381520337375,), (3.013003335580102,)], "z double")
    got = [r.p for r in df.select(experiment.two_sided_p("z").alias("p")).collect()]
    assert got[0] == pytest.approx(0.11470776493185678, rel=1e-9)
    assert got[1] == pytest.approx(0.0025867607438543124, rel=1e-9)


def test_cohens_h_golden():
    h = 2 * (math.asin(math.sqrt(0.1984)) - math.asin(math.sqrt(0.1903)))
    assert round(abs(h), 2) == 0.02


def test_wilson_edges(spark):
    df = spark.createDataFrame([(0, 0), (0, 10), (10, 10)], "s long, n long")
    lo, hi = experiment.wilson_interval(F.col("s"), F.col("n"))
    rows = df.select(lo.alias("lo"), hi.alias("hi")).collect()
    assert rows[0].lo is None and rows[0].hi is None
    assert rows[1].lo == pytest.approx(0.0, abs=1e-12) and 0 < rows[1].hi < 1
    assert 0 < rows[2].lo < 1 and rows[2].hi == pytest.approx(1.0)


def test_correlation_constant_and_pairs(spark):
    df = spark.createDataFrame([(1.0, 5.0, 2.0), (2.0, 5.0, 4.0), (3.0, 5.0, None)], "a double, c double, b double")
    got = {(r.x, r.y): r.corr for r in profile.correlation_matrix(df, ["a", "b", "c"]).collect()}
    assert got[("a", "c")] is None and got[("c", "c")] is None
    assert got[("a", "b")] == pytest.approx(1.0)


def test_category_codes(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",), ("c",)], "x string")
    assert [r.x for r in profile.category_codes(df, "x").orderBy(F.col("x")).collect()] == [-1, 0, 1, 1, 2]


def test_keyed_running_matches_window(spark):
    import random

    rng = random.Random(7)
    rows = [(rng.choice("ab"), dt.date(2020, 1, 1) + dt.timedelta(days=rng.randint(0, 90)), i, float(rng.randint(0, 9)))
            for i in range(400)]
    df = spark.createDataFrame(rows, "k string, d date, id long, v double")
    ours = keyed_running(df, ["k"], order=["d", "id"], sums={"s": F.col("v")},
                         count_name="n")
    w = Window.partitionBy("k").orderBy("d", "id").rowsBetween(Window.unboundedPreceding, 0)
    ref = df.select("id", F.sum("v").over(w).alias("s"), F.count(F.lit(1)).over(w).alias("n"))
    a = {r.id: (r.s, r.n) for r in ours.collect()}
    b = {r.id: (r.s, r.n) for r in ref.collect()}
    assert a == b
    rng_ours = keyed_running(df, ["k"], order=["d"], sums={"s": F.col("v")},
                             frame="range")
    wr = Window.partitionBy("k").orderBy("d")
    ref2 = {r.id: r.s for r in df.select("id", F.sum("v").over(wr).alias("s")).collect()}
    assert {r.id: r.s for r in rng_ours.collect()} == ref2


def test_row_numbers_nulls_last(spark):
    df = spark.createDataFrame([(None, "x"), (dt.date(2020, 1, 2), "b"), (dt.date(2020, 1, 1), "z"),
                                (dt.date(2020, 1, 2), "a")], "d date, s string")
    got = range_numbered(df, [F.col("d").asc_nulls_last(), "s"])
    assert [r.s for r in got.orderBy("row_number").collect()] == ["z", "a", "b", "x"]


def test_team_form_rolling_edges(spark):
    # 17 games for team A over two seasons with a same-day pair; B is the opponent.
    rows = []
    for i in range(17):
        day = dt.date(2019, 12, 20) + dt.timedelta(days=7 * i if i != 5 else 7 * 4)
        rows.append(Row(game_id=i, season=day.year, schedule_week=i + 1, team="A", opponent="B", schedule_date=day,
                        venue="home", score=i, score_against=10, score_margin=i - 10, spread=0.0, overunder=40.0,
                        elo=1500.0, win_count=1.0 if i % 2 else 0.0, cover_count=0.5, over_count=0.0, game_count=1))
    form = {r.game_id: r for r in teamstats.team_form(spark.createDataFrame(rows), k=16).collect()}
    ordered = sorted(form.values(), key=lambda r: (r.schedule_date, r.game_id))
    assert [r.game_number for r in ordered] == list(range(1, 18))
    assert ordered[14].win_pct_roll is None and ordered[15].win_pct_roll is not None
    wins16 = sum(1.0 if r.game_id % 2 else 0.0 for r in ordered[:16])
    assert ordered[15].win_pct_roll == pytest.approx(wins16 / 16)
    assert ordered[15].score_avg_pts_for_roll_lag is None
    assert ordered[16].score_avg_pts_for_roll_lag == pytest.approx(sum(r.score for r in ordered[:16]) / 16)
    assert ordered[0].win_pct_roll_lag is None and ordered[0].days_since_last_game is None
    seasons = [(r.season, r.wins_roll_season) for r in ordered]
    first_2020 = next(i for i, (s, _) in enumerate(seasons) if s == 2020)
    assert seasons[first_2020][1] == (1 if ordered[first_2020].win_count == 1 else 0)


def test_page_extraction(spark):
    from quarry.sources.pages import extract_fields

    pages = spark.createDataFrame([
        (1, "u1", '<html><span id="productTitle" class="t">  Funko <b>Pop</b>  </span>'
                  '<span class="a-price a-price-whole">$1,234.50</span></html>'),
        (2, "u2", "<html><p>no product</p></html>"),
        (3, "u3", '<div id="productTitle">\n Mug </div><span class="a-price-whole">£13.99</span>'),
    ], "page_id long, url string, html string")
    got = {r.page_id: (r.title, r.price) for r in extract_fields(pages, "2024-01-31").collect()}
    assert got[1][0] == "Funko Pop" and float(got[1][1]) == 1234.50
    assert got[2] == (None, None)
    assert got[3][0] == "Mug" and float(got[3][1]) == 13.99


def test_no_theta_or_cartesian_joins(spark, sf_small):
    import __spark_entry__ as entry

    q = entry.queries()
    for key in ["ik4_profit_by_team", "ir1_still_active_retention", "ir2_cumulative_retention", "iu1_user_uplift"]:
        plan = q[key](spark, sf_small)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, key


def test_lagged_matches_window_lag(spark):
    from quarry.plans.prefix import lagged

    rows = [(k, i, float(i * 10 + (1 if k == "a" else 2))) for k in ("a", "b") for i in range(1, 60)]
    df = spark.createDataFrame(rows, "k string, idx long, v double")
    got = lagged(df, ["k"], "idx", {"v1": ("v", 1), "v5": ("v", 5)}, block=7)
    w = Window.partitionBy("k").orderBy("idx")
    ref = df.select("k", "idx", F.lag("v", 1).over(w).alias("v1"), F.lag("v", 5).over(w).alias("v5"))
    assert sorted(map(tuple, got.select("k", "idx", "v1", "v5").collect())) == sorted(map(tuple, ref.collect()))


def test_seeded_sample_exact_and_repeatable(spark):
    from quarry.operators.kpi import seeded_sample

    df = spark.range(5000).withColumnRenamed("id", "customer_id")
    a = [r.customer_id for r in seeded_sample(df, "customer_id", 100, seed=7).collect()]
    b = [r.customer_id for r in seeded_sample(df.repartition(13), "customer_id", 100, seed=7).collect()]
    assert len(a) == 100 and a == b


def test_formatting_helpers(spark):
    from quarry.functions.scalar import clip, fmt_money, fmt_pct, money_compact

    df = spark.createDataFrame([(1234567.0, 0.0484), (-2500.0, 0.5), (12.0, -0.01)], "v double, r double")
    got = df.select(fmt_money("v").alias("m"), money_compact("v").alias("c"), fmt_pct("r").alias("p"),
                    clip("r", 0.0, 0.1).alias("k")).collect()
    assert [g.m for g in got] == ["$1,234,567", "-$2,500", "$12"]
    assert [g.c for g in got] == ["$1.2M", "$-2.5K", "$12"]
    assert [g.p for g in got] == ["4.84%", "50.00%", "-1.00%"]
    assert [g.k for g in got] == [0.0484, 0.1, 0.0]


def test_hot_key_is_spread_over_tasks(spark):
    """One key holding every row is still windowed in several tasks (one per part), not in one."""
    rows = [("hot", dt.date(2020, 1, 1) + dt.timedelta(days=i), i, 1.0) for i in range(730)]
    df = spark.createDataFrame(rows, "k string, d date, id long, v double")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        out = keyed_running(df, ["k"], order=["d", "id"], sums={"s": F.col("v")},
                            count_name="n")
        parts = {r.p for r in out.select(F.spark_partition_id().alias("p")).collect()}
        assert len(parts) >= 4
        assert out.agg(F.max("n")).first()[0] == 730
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("rows", [
    [("hot", dt.date(2020, 1, 1) + dt.timedelta(days=i), i) for i in range(800)],   # one key
    [("hot", dt.date(2020, 1, 1 + i % 28), i) for i in range(800)],                 # one month
    [("hot", dt.date(2020, 1, 1), i) for i in range(800)],                          # one date
    [("hot", None, i) for i in range(800)],                                         # no dates
    [(None, None, i) for i in range(800)],                                          # no key, no dates
    [("a" if i < 3 else "hot" if i < 700 else f"z{i}", dt.date(2020, 1, 1), i) for i in range(800)],
], ids=["key", "month", "date", "null dates", "null key", "hot among rare keys"])
def test_running_sums_spread_over_all_parts(spark, rows):
    """Whatever the rows share, they are dealt over all parts, carries cross the parts, and the sums are those of a window."""
    df = spark.createDataFrame([(k, d, i, i % 7 if i % 5 else None) for k, d, i in rows], "k string, d date, id long, v long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        held = ordered_parts(df, ["k", "d", "id"]).groupBy("__part").count().collect()
        assert len(held) >= 15 and max(r["count"] for r in held) <= 150
        out = keyed_running(df.withColumn("m", F.col("id") % 3), ["k"], ["d", "id"], {"s": F.col("v")}, "n", reset_keys=["m"], reset_suffix="_m")
        by = Window.partitionBy("k").orderBy("m", "d", "id").rowsBetween(Window.unboundedPreceding, 0)
        per = Window.partitionBy("k", "m").orderBy("d", "id").rowsBetween(Window.unboundedPreceding, 0)
        want = df.withColumn("m", F.col("id") % 3).select("id", F.sum("v").over(by).alias("s"), F.count(F.lit(1)).over(by).alias("n"),
                                                         F.sum("v").over(per).alias("s_m"), F.count(F.lit(1)).over(per).alias("n_m"))
        assert sorted(out.select("id", "s", "n", "s_m", "n_m").collect()) == sorted(want.collect())
        peers = keyed_running(df, ["k"], ["d"], {"s": F.col("v")}, "n", frame="range")
        wide = Window.partitionBy("k").orderBy("d")
        same = df.select("id", F.sum("v").over(wide).alias("s"), F.count(F.lit(1)).over(wide).alias("n"))
        assert sorted(peers.select("id", "s", "n").collect()) == sorted(same.collect())
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("inclusive", [False, True])
def test_as_of_takes_the_last_earlier_row(spark, inclusive):
    """Against a plain search; one hot key over all parts, ties by the tie column, null keys and moments find nothing."""
    import random

    rng = random.Random(3)
    key = lambda: rng.choice(["hot"] * 8 + ["a", "b", None])
    rows = [(key(), rng.choice([None, *range(60)]), i, rng.choice([None, i])) for i in range(400)]
    asks = [(i, key(), rng.choice([None, *range(-2, 62)])) for i in range(300)] + [(900, "c", 5), (901, "a", -5)]
    left, right = spark.createDataFrame(asks, "ask long, k string, at int"), spark.createDataFrame(rows, "k string, at int, id long, v long")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = {r.ask: (r.id, r.v) for r in as_of(left, right, ["k"], "at", ["id", "v"], tie=["id"], inclusive=inclusive).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = {}
    for ask, k, at in asks:
        fit = [r for r in rows if None not in (k, at, r[1]) and r[0] == k and (r[1] < at or inclusive and r[1] == at)]
        want[ask] = max(fit, key=lambda r: (r[1], r[2]))[2:] if fit else (None, None)
    assert got == want
    assert as_of(left.where("false"), right, ["k"], "at", ["v"]).count() == 0
    assert as_of(left, right.where("false"), ["k"], "at", ["v"]).where("v IS NOT NULL").count() == 0


def test_forecast_of_teams_without_a_game(spark):
    """A team without form gets the default spread and no total; bad wind still says Under; earlier form only."""
    games = spark.createDataFrame([(1, dt.date(2020, 2, 1), "A", "B", "A", -3.0, 40.0, 60, 3), (2, dt.date(2020, 2, 1), "A", "X", "PICK", 0.0, 41.5, 20, 30),
                                   (3, dt.date(2019, 1, 1), "A", "B", "B", -1.0, 40.0, None, None)],
                                  "game_id long, schedule_date date, team_home_id string, team_away_id string, team_favorite_id string, "
                                  "spread_favorite double, over_under_line double, weather_temperature int, weather_wind_mph int") \
        .withColumns({"weather_detail": F.lit(None).cast("string"), "team_home_elo_pre": F.lit(1500.0), "team_away_elo_pre": F.lit(1555.0)})
    form = spark.createDataFrame([("A", dt.date(2020, 1, 1), 1, 1600.0, 25.0, 17.0, "strong", "strong"), ("A", dt.date(2020, 1, 1), 2, 1500.0, 20.0, 20.0, "neutral", "neutral"),
                                  ("B", dt.date(2020, 1, 9), 3, 1400.0, 10.0, 30.0, "weak", "weak"), ("B", dt.date(2020, 2, 1), 4, 1.0, 1.0, 1.0, "weak", "weak")],
                                 "team string, schedule_date date, game_id long, elo double, score_avg_pts_for_roll_lag double, "
                                 "score_avg_pts_against_roll_lag double, team_offense_type string, team_defense_type string")
    got = {r.game_id: r for r in teamstats.forecast(games, form).collect()}
    assert (got[1].elo_home, got[1].elo_away, got[1].team_winner_predicted) == (1500.0, 1400.0, "PICK")
    assert got[1].score_total_predicted == round(34.7 + 0.001934 * 1500 + 0.00454 * 1400 - 1.176916 + 1.888973) and got[1].score_predicted == 40.0
    assert got[2].elo_away is None and got[2].spread_home_predicted == -2.5 and got[2].score_total_predicted is None and got[2].over_under_pick == "Under (41.5)"
    assert got[3].elo_home is None and got[3].over_under_predicted is None and got[3].team_winner_ats == "A (+1.0)"


def test_erfc_to_twelve_digits(spark):
    import math

    xs = [i / 37 for i in range(-200, 900)]
    df = spark.createDataFrame([(x,) for x in [*xs, None]], "x double")
    got = {r.x: r.y for r in df.select("x", experiment.erfc(F.col("x")).alias("y")).collect()}
    assert got[None] is None and all(got[x] == pytest.approx(math.erfc(x), rel=1e-12, abs=1e-300) for x in xs)


def test_bootstrap_shuffles_one_row_per_task_and_arm(spark):
    """Against sums in Python; every task gives one row per arm and metric, whatever its users."""
    import numpy as np

    rows = [(i, "ab"[i % 3 == 0], i % 2 == 0, None if i % 5 == 0 else i % 7 == 0) for i in range(500)] + [(None, "a", True, True)]
    df = spark.createDataFrame(rows, "userid long, version string, retention_1 boolean, retention_7 boolean").repartition(5)
    part = df.where("userid IS NOT NULL").select("userid", F.col("version").alias("arm"), F.col("retention_1").cast("double").alias("y"))
    sums = part.mapInArrow(experiment._replicate_sums(["y"], 40, 1), "arm string, metric string, w array<double>, wy array<double>").collect()
    assert len(sums) <= 2 * 5
    cuts = experiment.poisson_cuts()
    weight = lambda u, b: sum(experiment.replicate_hash(u, b, 1) >= c for c in cuts)
    for arm in "ab":
        for b in (0, 17, 39):
            mine = [r for r in rows if r[1] == arm and r[0] is not None]
            assert sum(r.w[b] for r in sums if r.arm == arm) == sum(weight(r[0], b) for r in mine)
            assert sum(r.wy[b] for r in sums if r.arm == arm) == sum(weight(r[0], b) for r in mine if r[2])
    assert 0.9 < np.mean([weight(u, b) for u in range(200) for b in range(40)]) < 1.1
    out = experiment.bootstrap_mean_ci(df, replicates=60).collect()
    assert len(out) == 4 and all(r.ci_low <= r["mean"] + 0.05 and r["mean"] - 0.05 <= r.ci_high for r in out)


def test_quartiles_of_spread_columns(spark):
    """Exact, with ties, nulls, a column without values, and one value in most rows."""
    import numpy as np

    from quarry.operators import profile

    rows = [(float(i * 37 % 101), 5 if i % 10 else i, None, None if i % 4 else i / 3) for i in range(331)]
    df = spark.createDataFrame(rows, "a double, b int, c double, d double")
    got = {r.column_name: r for r in profile.describe(df, ["a", "b", "c", "d"]).collect()}
    for i, c in enumerate("abcd"):
        values = [r[i] for r in rows if r[i] is not None]
        want = [round(float(np.quantile(values, q)), 6) if values else None for q in (0.25, 0.5, 0.75)]
        assert [got[c].p25, got[c].p50, got[c].p75] == want and got[c]["count"] == len(values)


def test_hot_team_lags_spread_over_blocks(spark):
    """Block-halo lags split one key into blocks: every block is its own window task."""
    from quarry.plans.prefix import lagged

    df = spark.createDataFrame([("hot", i, float(i)) for i in range(1, 5001)], "k string, idx long, v double")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        out = lagged(df, ["k"], "idx", {"prev": ("v", 1), "back17": ("v", 17)}, block=500)
        parts = {r.p for r in out.select(F.spark_partition_id().alias("p")).collect()}
        assert len(parts) >= 4
        r = out.where(F.col("idx") == 501).first()
        assert (r.prev, r.back17) == (500.0, 484.0)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_scans_are_pruned(spark, sf_small):
    """The orders scan of the flagship query reads only the columns the query uses."""
    import __spark_entry__ as entry

    plan = entry.queries()["ik2_profit_by_bet_type"](spark, sf_small)._jdf.queryExecution().executedPlan().toString()
    schemas = [line for line in plan.split("\n") if "ReadSchema" in line or "FileScan parquet" in line]
    assert schemas, plan
    assert all("o_custkey" not in s_ for s_ in schemas)  # the customer key is never needed by this query


def test_division_matchup_of_all_teams(spark, monkeypatch):
    from quarry.catalog import teams as catalog

    teams = spark.createDataFrame([("a", "x1", "A", "East", "East"), ("b", "n2", "B (old)", "East", "West")],
                                  "team_id string, team_id_pfr string, team_name string, team_division string, team_division_pre2002 string")
    games = spark.createDataFrame([(1, 2005, "a", "b"), (2, 1999, "a", "b")], "game_id int, schedule_season int, team_home_id string, team_away_id string")
    monkeypatch.setattr(catalog.fx, "raw_teams", lambda *_: teams)
    monkeypatch.setattr(catalog.fx, "games", lambda *_: games)
    assert {r.game_id: r.division_matchup for r in catalog.l3_division_matchup(spark, "").collect()} == {1: True, 2: False}
