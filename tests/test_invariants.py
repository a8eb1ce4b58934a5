"""Invariants of the published results, checked on the fixture tables."""

import pytest

import __spark_entry__ as entry

Q = entry.queries()


@pytest.fixture(scope="module")
def sf():
    return "/root/testdata/sf0.01"


def test_cumulative_retention_dominates_point_in_time(spark, sf):
    cum = {r.segment: r for r in Q["ir2_cumulative_retention"](spark, sf).collect()}
    pit = {r.segment: r for r in Q["ir1_still_active_retention"](spark, sf).collect()}
    for seg, c in cum.items():
        p = pit[seg]
        assert c.retention_7d == p.still_active_7d
        assert c.retention_30d >= p.still_active_30d and c.retention_90d >= p.still_active_90d


def test_survival_week_one_is_seven_day_retention(spark, sf):
    surv = {(r.segment, r.week_num): r for r in Q["ir3_weekly_survival"](spark, sf).collect()}
    for r in Q["ir2_cumulative_retention"](spark, sf).collect():
        assert surv[(r.segment, 1)].retention_rate == pytest.approx(r.retention_7d, abs=1e-6)
        assert surv[(r.segment, 1)].cohort_users == r.users


def test_roi_identity(spark, sf):
    r = Q["iu3_roi_scorecard"](spark, sf).first()
    for k in ("4w", "13w", "26w"):
        users = getattr(r, f"promo_users_{k}")
        if users:
            expect = (getattr(r, f"net_profit_total_{k}") - 5.0 * users) / users
            assert getattr(r, f"net_profit_per_user_{k}") == pytest.approx(expect, abs=0.01)


def test_bets_add_up_across_breakdowns(spark, sf):
    by_type = sum(r.bets for r in Q["ik2_profit_by_bet_type"](spark, sf).collect())
    by_promo = sum(r.bets for r in Q["ik5_promo_profitability"](spark, sf).collect())
    by_segment = sum(r.bets for r in Q["ik6_customer_group_differences"](spark, sf).collect())
    assert by_type == by_promo == by_segment
    top = Q["ik7_topline_economics"](spark, sf).first()
    assert sum(r.handle for r in Q["ik2_profit_by_bet_type"](spark, sf).collect()) == pytest.approx(top.handle, abs=0.05)
