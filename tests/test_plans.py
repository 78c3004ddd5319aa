"""Plan shapes that matter at scale."""

from conftest import SF_SMALL
from pulse.plans.catalog import QUERIES


def _plan(df):
    df.collect()   # adaptive plans are final after execution
    return df._jdf.queryExecution().executedPlan().toString()


def test_top_hashtags_partial_aggregate_and_topk(spark):
    plan = _plan(QUERIES["top_hashtags"](spark, SF_SMALL))
    assert "partial_count" in plan
    assert "TakeOrderedAndProject" in plan


def test_window_filter_reaches_scan(spark):
    df = QUERIES["last_window_posts"](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts," in plan


def test_scan_reads_only_needed_columns(spark):
    df = QUERIES["top_hashtags"](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_id:bigint,event_type:string,props:string>" in plan


def test_nation_is_broadcast_by_its_size(spark):
    plan = _plan(QUERIES["geo_totals"](spark, SF_SMALL)).split("Initial Plan")[0]
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def _scan(name, spark):
    return QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()


def test_serving_prunes_the_stored_tables(spark):
    for name in ("recent_posts", "sentiment_timeline", "sentiment_timeline_filled", "trending_latest"):
        plan = _scan(name, spark)
        assert "PartitionFilters: [isnotnull(day" in plan and "GreaterThanOrEqual(timestamp" in plan, name
    for name in ("latest_metrics", "retention_metrics", "trending_from_metrics", "sentiment_stats_from_metrics", "geo_from_metrics",
                 "sentiment_timeline_from_metrics"):
        assert "PartitionFilters: [isnotnull(bucket" in _scan(name, spark), name
    assert "EqualTo(key,#click)" in _scan("hashtag_history_from_metrics", spark)
    assert "EqualTo(user_id,user_7)" in _scan("user_detail", spark) and "EqualTo(user_id,user_7)" in _scan("user_posts", spark)
    assert "StringStartsWith(row_key,3_)" in _scan("prefix_scan", spark)


def test_recent_posts_uses_threshold_filter(spark):
    df = QUERIES["recent_posts"](spark, SF_SMALL)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "timestamp" in plan and ">=" in plan
    assert df.count() == 50
