"""Queries of every kind against their SQL twins on the smallest tables; all of them run
with ``python -m tests.compare``."""

import pytest

import __spark_entry__ as entry
from tests.compare import connect, differences

ROOT = "/root/testdata/sf0.001"
NAMES = [
    "bars_scan", "quote_snapshot", "rolling_mdd", "bollinger", "log_returns", "online_sharpe",
    "macd", "mr_signals", "perf_report", "grid_search", "wf_summary", "range_after_update",
    "portfolio_totals", "alert_registry", "doc_dedup", "build_context", "stream_sessions",
    "range_minmax", "range_agg", "tfidf_vectors", "mmr_rerank_five", "post_normalize", "history_page",
    "position_checks", "compare_checks", "config_checks", "compare_rank", "stream_candles_closed",
    "positions_after_removal", "live_signals", "stream_session_signals", "stream_alerts", "mr_signals_far_exit",
    "plugin_sources", "user_metrics", "alert_commands", "analysis_sources", "recommend", "mention_join", "ingest_report",
    "union_sources", "walk_forward_rsi", "shock_recovery", "vector_topk", "citations", "stream_candles_ema", "ema", "rsi",
]


@pytest.fixture(scope="module")
def duck():
    return connect(ROOT)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, ROOT).toPandas()
    assert differences(got, duck.execute(entry.oracle_sql()[name]).df()) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
