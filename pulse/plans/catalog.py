"""The registered queries: ``name -> (spark, sf_dir) -> DataFrame``.

Every query reads the driver tables (``events``, ``nation``, ``region``,
``documents``) whole, through the posts view, or the stored tables derived from
them (:mod:`pulse.plans.stored`), as the read API does; only a top-k list, one key or a declared
time window limits rows, as the feature itself does.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulse.functions.keys import hour_bucket, parse_row_key, row_key_is_valid
from pulse.functions.tags import join_tags, split_tags
from pulse.operators import aggregates as agg
from pulse.operators.lookups import COUNTRY_COORDS, attach, coords_frame
from pulse.operators.rankings import shares_of_total
from pulse.operators.sentiment import score_sentiment
from pulse.plans import batch, search_index, serving, store, stored, tag_states
from pulse.schemas import HASHTAG_ROW, RAW_POST
from pulse.session import scratch_path
from pulse.sources import fixture
from pulse.sources.posts import normalize_posts, parse_posts, to_payload

HOUR_MS = 3_600_000
DAY_MS = 86_400_000

Query = Callable[[SparkSession, str], DataFrame]


def _tweets(spark, sf):
    return fixture.tweets(spark, sf)


def _posts(spark, sf):
    return batch.stored_posts(spark, sf)


def _as_of(spark, sf) -> int:
    return fixture.max_timestamp(spark, sf)


def _stored_as_of(spark, sf) -> int:
    return stored.as_of(spark, sf)


def _table(spark, sf):
    return stored.posts(spark, sf)


def _top10(spark, sf):
    return agg.top_hashtags(_tweets(spark, sf), 10)


def _feed(spark, sf):
    return serving.recent_posts(store.newest_days(spark, stored.posts_path(spark, sf), 50), 50)


def _all_feed(spark, sf):
    p = _posts(spark, sf)
    return p.select(F.col("row_key").alias("tweet_id"), "text", "hashtags", "likes", "retweets",
                    "location", "sentiment")


# ---- aggregates ---------------------------------------------------------------------

def q_top_hashtags(spark, sf):
    return agg.top_hashtags(_tweets(spark, sf))


def q_hashtag_counts(spark, sf):
    return agg.hashtag_counts(_tweets(spark, sf))


def q_sentiment_counts(spark, sf):
    return agg.sentiment_counts(_posts(spark, sf))


def q_geo_sentiment(spark, sf):
    return agg.geo_sentiment(_posts(spark, sf))


def q_geo_sentiment_ordered(spark, sf):
    return agg.geo_sentiment(_posts(spark, sf)).orderBy("location", F.desc("cnt"), "sentiment")


def q_geo_totals(spark, sf):
    return serving.geo_distribution(_posts(spark, sf))


def q_geo_rollup(spark, sf):
    return agg.geo_rollup(_posts(spark, sf))


def q_top_users(spark, sf):
    return agg.top_users(_posts(spark, sf))


def q_volume_total(spark, sf):
    return agg.volume_total(_posts(spark, sf))


def q_hour_bucket(spark, sf):
    return (_posts(spark, sf).groupBy(hour_bucket("timestamp").alias("bucket"))
            .agg(F.count(F.lit(1)).alias("cnt")))


def q_positivity_rate(spark, sf):
    return agg.positivity_rate(_posts(spark, sf))


def q_sentiment_stats(spark, sf):
    return serving.sentiment_stats(_posts(spark, sf))


def q_sentiment_shares(spark, sf):
    return shares_of_total(agg.sentiment_counts(_posts(spark, sf)))


def q_trending_kpis(spark, sf):
    return agg.trending_kpis(_top10(spark, sf))


def q_geo_kpis(spark, sf):
    return agg.geo_kpis(agg.geo_totals(_posts(spark, sf)))


def q_geo_points(spark, sf):
    nation = fixture.read_table(spark, sf, "nation")
    region = fixture.read_table(spark, sf, "region")
    dim = (nation.join(region, nation.n_regionkey == region.r_regionkey)
           .select(F.col("n_name").alias("location"), F.col("n_nationkey").alias("nation_key"),
                   F.col("r_name").alias("region")))
    return attach(agg.geo_totals(_posts(spark, sf)), dim, "location")


def q_country_coordinates(spark, sf):
    # the fixture's nations stand for the map's countries, in the order of their codes
    codes = sorted(COUNTRY_COORDS)
    nation = fixture.read_table(spark, sf, "nation")
    code = F.element_at(F.array(*[F.lit(c) for c in codes]), (F.col("n_nationkey") % len(codes) + 1).cast("int"))
    named = agg.geo_totals(_posts(spark, sf)).join(nation.select(F.col("n_name").alias("location"), code.alias("code")), "location")
    totals = named.groupBy(F.col("code").alias("location")).agg(F.sum("cnt").alias("cnt"))
    return attach(totals, coords_frame(spark), "location")


def q_hashtag_table(spark, sf):
    return store.hashtag_rows(_posts(spark, sf)).select(*HASHTAG_ROW.names)


# ---- sentiment ------------------------------------------------------------------------

def q_sentiment_score(spark, sf):
    return batch.enrich(_tweets(spark, sf)).select("tweet_id", "sentiment", "sentiment_score")


def q_sentiment_label(spark, sf):
    return (batch.enrich(_tweets(spark, sf)).groupBy("sentiment_score", "sentiment")
            .agg(F.count(F.lit(1)).alias("cnt")))


def q_enriched_posts(spark, sf):
    return batch.enriched_posts(spark, sf)


def q_document_sentiment(spark, sf):
    docs = fixture.read_table(spark, sf, "documents").select("doc_id", "text")
    return score_sentiment(docs, "text").select("doc_id", "sentiment", "sentiment_score")


# ---- keys, projections, store ---------------------------------------------------------------

def q_stored_posts(spark, sf):
    return _posts(spark, sf)


def q_salt_distribution(spark, sf):
    return _posts(spark, sf).groupBy("salt").agg(F.count(F.lit(1)).alias("posts"),
                                                F.count_distinct("user_id").alias("users"))


def q_parse_row_key(spark, sf):
    # every post's key, and beside it a damaged one for posts without text
    p = _posts(spark, sf)
    damaged = F.when(F.col("text").isNull(), F.concat("row_key", F.lit("x"))).when(F.col("text") == "", F.lit("x"))
    keys = p.select(F.explode(F.array("row_key", damaged)).alias("key")).filter(row_key_is_valid("key"))
    return keys.select("key", parse_row_key("key").alias("k")).select(
        "key", "k.salt", "k.user_id", "k.rev_ts")


def q_tags_roundtrip(spark, sf):
    t = _tweets(spark, sf).select("tweet_id", join_tags("hashtags").alias("tags_text"))
    return t.withColumn("tags", split_tags("tags_text"))


def q_normalize_posts(spark, sf):
    return normalize_posts(_tweets(spark, sf)).select(
        "tweet_id", "text", "likes", "retweets", "location", "hashtags")


def _messages(spark, sf):
    """A JSON message per post, and beside those of posts without text a broken one and one without a time."""
    t = _tweets(spark, sf)
    fields = [F.col(f.name) for f in RAW_POST.fields]
    untimed = [c for c, f in zip(fields, RAW_POST.fields, strict=True) if f.name != "timestamp"]
    good, beside = F.to_json(F.struct(*fields)), F.col("text").isNull()
    return t.select(F.explode(F.filter(F.array(
        good, F.when(beside, F.concat(F.lit("{not json "), F.col("tweet_id"))), F.when(beside, F.to_json(F.struct(*untimed)))),
        lambda m: m.isNotNull())).alias("value"))


def q_parse_posts(spark, sf):
    return parse_posts(_messages(spark, sf))[0]


def q_parse_rejects(spark, sf):
    # the time-less messages are reported by length: the two engines space their JSON alike, but not by contract
    rejects = parse_posts(_messages(spark, sf))[1]
    broken = F.col("value").startswith("{not json ")
    return rejects.groupBy(broken.alias("broken"), F.when(broken, F.col("value")).alias("value")).agg(F.count("*").alias("cnt"))


def q_publish_payload(spark, sf):
    return to_payload(batch.enriched_posts(spark, sf))


def q_last_window_posts(spark, sf):
    as_of = _as_of(spark, sf)
    posts = batch.stored_posts(spark, sf, since_ms=as_of - HOUR_MS)
    return store.posts_in_window(posts, as_of, HOUR_MS).select(
        "tweet_id", "user_id", "hashtags", "likes", "retweets", "location", "sentiment", "timestamp")


def q_prefix_scan(spark, sf):
    return store.prefix_scan(_table(spark, sf), "3_").select("row_key", "tweet_id", "user_id")


def q_user_posts(spark, sf):
    return store.user_posts(_table(spark, sf), "user_7").select("row_key", "tweet_id", "timestamp")


def q_bounded_scan(spark, sf):
    return store.bounded_scan(_table(spark, sf), 100).select("row_key", "tweet_id")


def q_delete_keys(spark, sf):
    p = _table(spark, sf)
    doomed = p.filter(F.col("location") == "").select("row_key")
    return store.delete_keys(p, doomed).select("row_key", "tweet_id")


def q_metric_rows(spark, sf):
    return store.metric_rows(_posts(spark, sf))


def _stored_metrics(spark, sf):
    return stored.metrics(spark, sf)


def _live_metrics(spark, sf):
    """The newest snapshot among the hours that have not expired (a filter on the partition column)."""
    return store.latest_metrics(_stored_metrics(spark, sf), _stored_as_of(spark, sf))


def _two_runs(spark, sf):
    """Two runs of the hourly job, 20 minutes apart, over the stored posts; the paths written."""
    base, as_of = scratch_path(spark, "hourly"), _stored_as_of(spark, sf)
    paths = (f"{base}/metrics", f"{base}/users")
    for now in (as_of - 20 * 60_000, as_of):
        batch.hourly_job(spark, _table(spark, sf), now, *paths)
    return paths


def q_hourly_job_metrics(spark, sf):
    return store.read_metric_rows(spark, _two_runs(spark, sf)[0])


def q_hourly_job_users(spark, sf):
    return batch.read_users(spark, _two_runs(spark, sf)[1])


def q_latest_metrics(spark, sf):
    return _live_metrics(spark, sf)


def q_latest_metrics_merged(spark, sf):
    return store.latest_metrics(_stored_metrics(spark, sf), mode="merge")


def q_retention_metrics(spark, sf):
    return store.apply_metric_retention(_stored_metrics(spark, sf), _stored_as_of(spark, sf))


def q_retention_posts(spark, sf):
    # The table as it reads 75 days after the newest post.
    as_of = _as_of(spark, sf) + 75 * DAY_MS
    return store.apply_post_retention(_posts(spark, sf), as_of).select(
        "row_key", "tweet_id", "text", "sentiment", "sentiment_score")


def q_users_upsert(spark, sf):
    split = _as_of(spark, sf) - 7 * DAY_MS
    p = _posts(spark, sf)
    old = store.user_rows(p.filter(F.col("timestamp") < split))
    new = store.user_rows(p.filter(F.col("timestamp") >= split))
    return store.upsert_users(old, new).select(
        "user_id", "total_tweets", "total_likes", "last_active", "top_hashtags")


def q_users_from_deltas(spark, sf):
    return stored.users(spark, sf)


def q_post_table_two_steps(spark, sf):
    # the second step adds the later half of every day to the table that the first step wrote
    path = scratch_path(spark, "posts-two-steps")
    early = (F.col("timestamp") % DAY_MS) < DAY_MS // 2
    store.write_post_table(_posts(spark, sf).filter(early), path)
    store.upsert_post_table(spark, _posts(spark, sf).filter(~early), path)
    return store.read_post_table(spark, path)


def q_delete_two_steps(spark, sf):
    # posts without a country go, then those of one user; read back from the table
    path = scratch_path(spark, "posts-deleted")
    store.write_post_table(_table(spark, sf), path)
    for doomed in (F.col("location") == "", F.col("user_id") == "user_7"):
        store.delete_from_table(spark, path, store.read_post_table(spark, path).filter(doomed).select("row_key"))
    return store.read_post_table(spark, path).select("row_key", "tweet_id")


def q_expire_posts(spark, sf):
    # the table 75 days after the newest post, and again a day later
    path, as_of = scratch_path(spark, "posts-expired"), _stored_as_of(spark, sf)
    store.write_post_table(_table(spark, sf), path)
    for days in (75, 76):
        store.expire_posts(spark, path, as_of + days * DAY_MS)
    return store.read_post_table(spark, path).select("row_key", "tweet_id", "text", "sentiment", "sentiment_score")


# ---- serving ----------------------------------------------------------------------------

def q_recent_posts(spark, sf):
    return _feed(spark, sf)


def q_viral_posts(spark, sf):
    return serving.viral_posts(_table(spark, sf))


def q_viral_posts_by_key(spark, sf):
    return serving.viral_posts(_table(spark, sf), order="key")


def q_viral_filter(spark, sf):
    return serving.viral_filter(_posts(spark, sf)).select("tweet_id", "text", "likes", "user_id")


def q_hashtag_search(spark, sf):
    return search_index.hashtag_search(spark, stored.tag_index(spark, sf), _table(spark, sf), "#SIGN")


def q_hashtag_search_exact(spark, sf):
    return search_index.hashtag_search(spark, stored.tag_index(spark, sf), _table(spark, sf), "#k1", exact=True)


def q_hashtag_history(spark, sf):
    return serving.hashtag_history(_posts(spark, sf), "#click", 24)


def q_hashtag_history_from_metrics(spark, sf):
    return serving.hashtag_history_from_metrics(_stored_metrics(spark, sf), "#click", 24)


def q_sentiment_timeline_from_metrics(spark, sf):
    return serving.sentiment_timeline_from_metrics(_stored_metrics(spark, sf), _stored_as_of(spark, sf), 24)


def q_trending_latest(spark, sf):
    return serving.trending_latest(_table(spark, sf), 10, _stored_as_of(spark, sf))


def q_trending_from_metrics(spark, sf):
    return serving.trending_from_metrics(_live_metrics(spark, sf), 10)


def q_sentiment_stats_from_metrics(spark, sf):
    return serving.sentiment_stats_from_metrics(_live_metrics(spark, sf))


def q_geo_from_metrics(spark, sf):
    return serving.geo_from_metrics(_live_metrics(spark, sf))


def q_negative_countries_sql(spark, sf):
    batch.register_views(spark, sf)
    return batch.negative_countries(spark)


def q_trending_ranked(spark, sf):
    return serving.trending_ranked(_top10(spark, sf))


def q_trending_filter(spark, sf):
    return serving.trending_ranked(_top10(spark, sf), "k")


def q_sentiment_timeline(spark, sf):
    return serving.sentiment_timeline(_table(spark, sf), _stored_as_of(spark, sf), 24)


def q_sentiment_timeline_filled(spark, sf):
    return serving.sentiment_timeline_filled(_table(spark, sf), _stored_as_of(spark, sf), 24)


def q_top_users_served(spark, sf):
    return serving.top_users(stored.user_totals(spark, sf), 10)


def q_user_detail(spark, sf):
    return serving.user_detail(stored.users(spark, sf), "user_7")


def q_feed_kpis(spark, sf):
    return serving.feed_kpis(_feed(spark, sf))


def q_feed_authors(spark, sf):
    return serving.feed_authors(_all_feed(spark, sf))


def q_feed_search(spark, sf):
    return serving.feed_search(_all_feed(spark, sf), "NATION_1")


def q_text_search(spark, sf):
    return search_index.text_search(spark, stored.text_index(spark, sf), _table(spark, sf), "User 77")


def q_feed_filter(spark, sf):
    return serving.feed_filter(_all_feed(spark, sf), "click", "negative")


# ---- documented metrics ---------------------------------------------------------------------

def q_volume_per_minute(spark, sf):
    as_of = _as_of(spark, sf)
    return agg.volume_per_minute(batch.stored_posts(spark, sf, since_ms=as_of - HOUR_MS),
                                 as_of - HOUR_MS)


def q_hashtag_usage(spark, sf):
    return agg.hashtag_usage(_posts(spark, sf), _as_of(spark, sf))


def q_hashtag_engagement(spark, sf):
    return agg.hashtag_engagement(_posts(spark, sf))


def q_hashtag_first_peak(spark, sf):
    return agg.hashtag_first_peak(_posts(spark, sf))


def q_hashtag_usage_from_states(spark, sf):
    return tag_states.hashtag_usage(stored.states(spark, sf), _table(spark, sf), _stored_as_of(spark, sf))


def q_hashtag_engagement_from_states(spark, sf):
    return tag_states.hashtag_engagement(stored.states(spark, sf))


def q_hashtag_first_peak_from_states(spark, sf):
    return tag_states.hashtag_first_peak(stored.states(spark, sf))


def q_hashtag_table_from_states(spark, sf):
    return tag_states.hashtag_table(stored.states(spark, sf)).select(*HASHTAG_ROW.names)


def q_user_avg_daily(spark, sf):
    return agg.user_avg_daily(_posts(spark, sf))


def q_trending_by_hour(spark, sf):
    return agg.trending_by_hour(_posts(spark, sf))


def _streaming(name):
    def run(spark, sf):
        from pulse.streaming import jobs
        return getattr(jobs, name)(spark, sf)
    run.__name__ = f"q_{name}"
    return run


QUERIES: dict[str, Query] = {
    name[2:]: fn for name, fn in sorted(globals().items())
    if name.startswith("q_") and callable(fn)
}
QUERIES.update({
    "stream_hourly_hashtags": _streaming("stream_hourly_hashtags"),
    "stream_sentiment_counts": _streaming("stream_sentiment_counts"),
    "stream_alerts": _streaming("stream_alerts"),
    "stream_json_ingest": _streaming("stream_json_ingest"),
    "stream_metric_rows": _streaming("stream_metric_rows"),
    "stream_post_table": _streaming("stream_post_table"),
    "stream_rejects": _streaming("stream_rejects"),
})

FLAGSHIP = "top_hashtags"
