"""Counting, top-k and dashboard aggregates.

All of them are hash aggregates with a map-side partial step, so a hot key
(one tag or country holding a third of the rows) is combined inside each task
before the shuffle and never lands whole in one task.  Top-k results use a
total order (count desc, key asc) so the answer is a function of the data,
and ``orderBy(...).limit(k)`` plans as TakeOrderedAndProject (per-task top-k,
then a k-row merge) instead of a global sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulse.functions.keys import hour_bucket
from pulse.functions.tags import clean_tags

# Default list sizes of the batch job.
TOP_HASHTAGS = 10
TOP_USERS = 20
LABELS = ["positive", "neutral", "negative"]


def exploded_tags(posts: DataFrame, *keep: str) -> DataFrame:
    """One row per (post, non-empty tag); a null or empty list gives no rows."""
    return posts.select(*keep, F.explode(clean_tags("hashtags")).alias("hashtag"))


def hashtag_counts(posts: DataFrame) -> DataFrame:
    """(hashtag, cnt) over all posts (A1)."""
    return exploded_tags(posts).groupBy("hashtag").agg(F.count(F.lit(1)).alias("cnt"))


def top_k(df: DataFrame, k: int, count_col: str, *keys: str) -> DataFrame:
    """Top ``k`` rows by ``count_col`` desc, ties broken by the keys ascending."""
    return df.orderBy(F.desc(count_col), *[F.asc(c) for c in keys]).limit(k)


def top_hashtags(posts: DataFrame, k: int = TOP_HASHTAGS) -> DataFrame:
    """The flagship: most used tags (A2)."""
    return top_k(hashtag_counts(posts), k, "cnt", "hashtag")


def read_label():
    """The label as it is served: a missing (expired) cell reads as neutral."""
    return F.coalesce(F.col("sentiment"), F.lit("neutral"))


def sentiment_counts(posts: DataFrame) -> DataFrame:
    """(sentiment, cnt) (A3)."""
    return posts.groupBy(read_label().alias("sentiment")).agg(F.count(F.lit(1)).alias("cnt"))


def geo_sentiment(posts: DataFrame) -> DataFrame:
    """(location, sentiment, cnt) over posts with a country (A4)."""
    return (posts.filter(F.col("location") != "")
                 .groupBy("location", read_label().alias("sentiment")).agg(F.count(F.lit(1)).alias("cnt")))


def geo_totals(posts: DataFrame) -> DataFrame:
    """(location, cnt) over posts with a country (A5 / served geo distribution)."""
    return (posts.filter(F.col("location") != "")
                 .groupBy("location").agg(F.count(F.lit(1)).alias("cnt")))


def geo_rollup(posts: DataFrame) -> DataFrame:
    """Country x label counts with per-country and grand totals in one pass."""
    return (posts.filter(F.col("location") != "")
                 .rollup("location", "sentiment").agg(F.count(F.lit(1)).alias("cnt")))


def user_activity(posts: DataFrame) -> DataFrame:
    """(user_id, tweet_count, total_likes) per user (A6 before the limit)."""
    return (posts.groupBy("user_id")
                 .agg(F.count(F.lit(1)).alias("tweet_count"),
                      F.coalesce(F.sum(F.coalesce(F.col("likes"), F.lit(0))),
                                 F.lit(0)).cast("long").alias("total_likes")))


def top_users(posts: DataFrame, k: int = TOP_USERS) -> DataFrame:
    return top_k(user_activity(posts), k, "tweet_count", "user_id")


def volume_total(posts: DataFrame) -> DataFrame:
    return posts.agg(F.count(F.lit(1)).alias("total_posts"))


def label_counts_row(posts: DataFrame) -> DataFrame:
    """One row: positive, neutral, negative, total."""
    return posts.agg(*[F.count_if(read_label() == lab).alias(lab) for lab in LABELS],
                     F.count(F.lit(1)).alias("total"))


def positivity_rate(posts: DataFrame) -> DataFrame:
    """round(100 * positive / total), 0 when there are no posts (A10)."""
    c = label_counts_row(posts)
    rate = F.coalesce(F.round(F.lit(100.0) * F.col("positive") / F.nullif(F.col("total"), F.lit(0))),
                      F.lit(0.0)).cast("long")
    return c.select("positive", "total", rate.alias("positivity_rate"))


def trending_kpis(top: DataFrame) -> DataFrame:
    """Total, max, top tag and its count, number of tags over a top list."""
    best = F.min_by(F.struct("hashtag", "cnt"), F.struct(-F.col("cnt"), F.col("hashtag")))
    return top.agg(F.coalesce(F.sum("cnt"), F.lit(0)).cast("long").alias("total_volume"),
                   F.coalesce(F.max("cnt"), F.lit(0)).cast("long").alias("max_volume"),
                   F.coalesce(best["hashtag"], F.lit("N/A")).alias("top_hashtag"),
                   F.coalesce(best["cnt"], F.lit(0)).cast("long").alias("top_hashtag_count"),
                   F.count(F.lit(1)).alias("n_hashtags"))


def geo_kpis(geo: DataFrame) -> DataFrame:
    """Total posts, top country and its count, number of countries."""
    best = F.min_by(F.struct("location", "cnt"), F.struct(-F.col("cnt"), F.col("location")))
    return geo.agg(F.coalesce(F.sum("cnt"), F.lit(0)).cast("long").alias("total_posts"),
                   F.coalesce(best["location"], F.lit("N/A")).alias("top_country"),
                   F.coalesce(best["cnt"], F.lit(0)).cast("long").alias("top_country_count"),
                   F.count(F.lit(1)).alias("n_countries"))


# ---- Documented metrics (D1-D8) -------------------------------------------------

def volume_per_minute(posts: DataFrame, since_ms: int) -> DataFrame:
    """Posts per UTC minute from ``since_ms`` on."""
    minute = F.date_format(F.timestamp_millis("timestamp"), "yyyyMMddHHmm")
    return (posts.filter(F.col("timestamp") >= F.lit(since_ms))
                 .groupBy(minute.alias("minute")).agg(F.count(F.lit(1)).alias("cnt")))


def hashtag_usage(posts: DataFrame, as_of_ms: int) -> DataFrame:
    """Uses per tag: in total, in the last hour and the last day before ``as_of_ms`` (D3)."""
    hour_ago, day_ago = as_of_ms - 3_600_000, as_of_ms - 86_400_000
    t = F.col("timestamp")
    return (exploded_tags(posts, "timestamp").groupBy("hashtag")
            .agg(F.count(F.lit(1)).alias("uses_total"),
                 F.count_if((t >= hour_ago) & (t <= as_of_ms)).alias("uses_last_hour"),
                 F.count_if((t >= day_ago) & (t <= as_of_ms)).alias("uses_last_day")))


def hashtag_engagement(posts: DataFrame) -> DataFrame:
    """Sum of likes and retweets of the posts carrying each tag."""
    return (exploded_tags(posts, "likes", "retweets").groupBy("hashtag")
            .agg(F.coalesce(F.sum("likes"), F.lit(0)).cast("long").alias("total_likes"),
                 F.coalesce(F.sum("retweets"), F.lit(0)).cast("long").alias("total_retweets")))


def hashtag_first_peak(posts: DataFrame) -> DataFrame:
    """First use of each tag and its busiest hour of day (ties -> earliest hour).

    Two aggregations, no window: counts per (tag, hour of day) are at most 24
    rows per tag, then ``min_by`` picks the peak.
    """
    tags = exploded_tags(posts, "timestamp").withColumn(
        "hour_of_day", F.hour(F.timestamp_millis("timestamp")))
    per_hour = tags.groupBy("hashtag", "hour_of_day").agg(
        F.count(F.lit(1)).alias("cnt"), F.min("timestamp").alias("first_ts"))
    return per_hour.groupBy("hashtag").agg(
        F.min("first_ts").alias("first_seen"),
        F.min_by("hour_of_day", F.struct(-F.col("cnt"), F.col("hour_of_day"))).alias("peak_hour"),
        F.max("cnt").alias("peak_hour_uses"))


def user_avg_daily(posts: DataFrame) -> DataFrame:
    """Per user and active day: average posts per day over that day and the 6 before.

    Daily counts first (bounded by days per user), then a 7-day range frame on
    the day number, so quiet days count as zero without a generated spine.
    """
    day = F.floor(F.col("timestamp") / F.lit(86_400_000)).cast("long")
    daily = posts.groupBy("user_id", day.alias("day_num")).agg(F.count(F.lit(1)).alias("posts"))
    w = Window.partitionBy("user_id").orderBy("day_num").rangeBetween(-6, 0)
    return daily.select(
        "user_id",
        F.date_format(F.timestamp_millis(F.col("day_num") * 86_400_000), "yyyy-MM-dd").alias("day"),
        "posts",
        (F.sum("posts").over(w) / F.lit(7.0)).alias("avg_posts_7d"))


def trending_by_hour(posts: DataFrame, k: int = TOP_HASHTAGS) -> DataFrame:
    """Top ``k`` tags of every hour bucket.

    Counts per (bucket, tag) first; the per-bucket rank filter lets Spark put a
    partial group limit before the window's shuffle.
    """
    counts = (exploded_tags(posts, "timestamp")
              .groupBy(hour_bucket("timestamp").alias("bucket"), "hashtag")
              .agg(F.count(F.lit(1)).alias("cnt")))
    w = Window.partitionBy("bucket").orderBy(F.desc("cnt"), F.asc("hashtag"))
    return (counts.withColumn("rank", F.row_number().over(w).cast("long"))
                  .filter(F.col("rank") <= k))
