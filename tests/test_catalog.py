"""Registered queries against their SQL on the smallest tables; TIDEMARK_ALL=1 runs every one."""

import os

import pytest

import __spark_entry__ as entry
import check

SF = "/root/testdata/sf0.001"
FEW = """d02_derived_q4 c05_backward_asof c12_tolerance_match e05_cum_over_streak e18_episode_starts e25_hysteresis_state
e26_hedge_intervals e38_two_asset_nav f06_largest_first_fill j03_quintile_spread j05_residualise i05_market_guide_dollar
i08_guide_tiering a03_companyfacts_scan l02_alert_suppression a04_balance_facts_scan a06_dim_fact_scan a07_label_scan a08_row_label_scan
a12_html_to_lines a13_checkpoint_scan a15_membership_scan a16_listing_scan i02_guidance_patterns i02_guidance_families k14_statement_grid i03_guidance_table i04_guide_presence
i13_concentration_pct h05_period_text j22_rolling_windows e37_circular_shift l01_incremental_dedupe l03_latest_event_state""".split()
NAMES = sorted(entry.queries()) if os.environ.get("TIDEMARK_ALL") else FEW


@pytest.fixture(scope="module")
def con():
    return check.connect(SF)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    status, message, _ = check.compare(spark, con, name, entry.queries()[name], entry.oracle_sql().get(name), SF)
    assert status in ("ok", "ROWS"), message


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "ticker" and df.count() > 0
