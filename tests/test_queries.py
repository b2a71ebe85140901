"""Every registered query with SQL agrees with DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from panelforge.plans import registry

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: A spread of families; all of them run at sf0.01 by the driver.
NAMES = ["f1_returns", "f6_rsi", "f11_beta", "c1_date_rank", "c3_minus_sector_median", "l4_path_drawdown", "l7_grades", "j7_asof", "j9_interval_join", "v4_sampled_week_fri", "b1_daily_baskets", "b6_buckets", "b20_decile_spreads", "h6_terminal_outcomes", "k12_rank_changes", "d1_calendar", "p2_strip_html", "t6_themes", "x1_latest_bars"]
NAMES += ["s1_bars_csv", "s4_macro_csv", "s5_constituents", "s10_registries", "s11_feed_items", "s12_markdown", "s13_forum_posts", "s14_movers", "s15_earnings_calendar", "s17_fred_calendar", "s17_bea_calendar", "s17_fomc_calendar", "s18_company_news", "s22_saved_trees", "s24_reference_cache"]
NAMES += ["t4_links", "t10_theme_drivers", "t12_conclusions", "t14_ticker_signals", "t15_attention", "t18_release_metrics", "t25_clean_lists", "p10_calendar", "p11_feature_groups", "v3_embargo", "v9_strict_start", "h8_sector_observations", "h11_unknown_reason"]
NAMES += ["d7_readiness_record", "d9_cache_endings", "d12_schema_errors", "d13_identity", "k2_tags", "k9_scorebook", "k20_label_summary", "k22_macro_context", "m9_best_iteration", "b5_inverse_baskets", "b10_compounded", "b23_entrants", "l9_candidate_setup"]

NAMES += ["m1_score_trees", "m7_attribution", "h6_terminal_events", "h14_point_in_time", "j7_lagged_asof", "j16_identities", "b11_activation_report", "b18_paired_interval", "k6_outsiders", "k13_bottom_sectors", "s6_change_pages", "x4_snapshot_changes", "h3_no_trade_days", "h4_corrected_prices", "d11_contract", "k11_trend_summary", "k3_candidate_setups", "h17_findings", "t11_reading_list", "t10_fitted_drivers"]


def rows(records):
    def cell(v):
        if v is None or v != v:
            return ""
        return f"{v + 0.0:.5g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(cell(v) for v in r) for r in records)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")
@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    want = con.sql(registry.SQL[name])
    columns = sorted(want.columns)
    got = registry.QUERIES[name](spark, DIR)
    assert sorted(got.columns) == columns
    assert rows(got.select(*columns).collect()) == rows(con.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM want").fetchall())
