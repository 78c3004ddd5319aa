"""Mergeable tag state: what is known of a tag's uses in an hour, added up for any span.

A row holds, for one tag and hour, the number of uses, sums of likes and retweets and the first
use.  Rows of disjoint posts merge in any order (sums and a minimum; the hour of day comes
from the hour itself), so the documented tag metrics are sums over few rows and no post is read:
engagement, first use and peak hour, the hashtags table.  Usage in windows that begin and end at any
millisecond takes whole hours from the rows and corrects both edges from the posts of the edge hours.

Rows are kept by day, as the post table is: a day is replaced as a whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulse.functions.keys import hour_bucket, reversed_ts
from pulse.functions.tags import clean_tags
from pulse.operators.aggregates import exploded_tags
from pulse.plans import store

HOUR_MS, DAY_MS = 3_600_000, 86_400_000
TAG_STATE = "hashtag string, bucket string, uses long, likes long, retweets long, first_ts long, day string"


def tag_states(posts: DataFrame) -> DataFrame:
    """One row per tag and hour; posts are combined in their task before the shuffle."""
    tags = posts.select(hour_bucket("timestamp").alias("bucket"), "day", "likes", "retweets", "timestamp",
                        F.explode(clean_tags("hashtags")).alias("hashtag"))
    return tags.groupBy("day", "bucket", "hashtag").agg(
        F.count(F.lit(1)).alias("uses"), F.coalesce(F.sum("likes"), F.lit(0)).cast("long").alias("likes"),
        F.coalesce(F.sum("retweets"), F.lit(0)).cast("long").alias("retweets"), F.min("timestamp").alias("first_ts")).select(
        *[c.split()[0] for c in TAG_STATE.split(", ")])


def merge(states: DataFrame, *by: str) -> DataFrame:
    """Add states up per tag (and ``by``): sums and the first use."""
    return states.groupBy("hashtag", *by).agg(F.sum("uses").alias("uses"), F.sum("likes").alias("likes"),
                                              F.sum("retweets").alias("retweets"), F.min("first_ts").alias("first_ts"))


def write_tag_states(states: DataFrame, path: str) -> None:
    """Replace the days that ``states`` holds; sorted by tag, so that one tag's rows are found by statistics."""
    (states.repartitionByRange("day", "hashtag", "bucket").sortWithinPartitions("day", "hashtag", "bucket")
           .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path))


def read_tag_states(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TAG_STATE).parquet(path)


def hashtag_engagement(states: DataFrame) -> DataFrame:
    """Sums of likes and retweets of the posts with each tag."""
    return merge(states).select("hashtag", F.col("likes").alias("total_likes"), F.col("retweets").alias("total_retweets"))


def hashtag_first_peak(states: DataFrame) -> DataFrame:
    """First use of each tag and its busiest hour of day, the earliest of ties (D5): at most 24 rows a tag are merged."""
    per_hour = merge(states.withColumn("hour_of_day", F.substring("bucket", 9, 2).cast("int")), "hour_of_day")
    return per_hour.groupBy("hashtag").agg(
        F.min("first_ts").alias("first_seen"),
        F.min_by("hour_of_day", F.struct(-F.col("uses"), F.col("hour_of_day"))).alias("peak_hour"), F.max("uses").alias("peak_hour_uses"))


def hashtag_table(states: DataFrame) -> DataFrame:
    """The hashtags table: uses, likes and first use, keyed by tag and reversed first use."""
    rows = merge(states).select("hashtag", F.col("uses").alias("total"), F.col("likes").alias("likes_sum"), F.col("first_ts").alias("first_seen"))
    key = F.concat_ws("_", "hashtag", F.lpad(reversed_ts("first_seen").cast("string"), 13, "0"))
    return rows.select(key.alias("row_key"), "hashtag", "total", "likes_sum", "first_seen")


def _bucket(ms: int):
    return hour_bucket(F.lit(int(ms)))


def _edges(since: int, until: int) -> tuple[int, int]:
    """The whole hours of a closed window: from the first full hour's start to the last one's end."""
    return -(-since // HOUR_MS) * HOUR_MS, (until + 1) // HOUR_MS * HOUR_MS


def hashtag_usage(states: DataFrame, posts: DataFrame, as_of_ms: int) -> DataFrame:
    """Uses per tag in total, in the hour and in the day before ``as_of`` (D3), at any millisecond.

    ``posts`` is the post table: only the posts of the windows' edge hours are read, a pushed filter on time and day.
    """
    windows = {"uses_last_hour": as_of_ms - HOUR_MS, "uses_last_day": as_of_ms - DAY_MS}
    whole, parts, hours = [], [], set()
    t = F.col("timestamp")
    for name, since in windows.items():
        first, end = _edges(since, as_of_ms)
        full = (F.col("bucket") >= _bucket(first)) & (F.col("bucket") < _bucket(end)) if first < end else F.lit(False)
        whole.append(F.sum(F.when(full, F.col("uses")).otherwise(0)).alias(name))
        inside = (t >= since) & (t <= as_of_ms)
        parts.append(F.count_if(inside & ~((t >= first) & (t < end))).alias(name))
        hours |= {since // HOUR_MS, as_of_ms // HOUR_MS}
    near = F.lit(False)
    for h in sorted(hours):
        near = near | ((t >= h * HOUR_MS) & (t < (h + 1) * HOUR_MS))
    edge = store.posts_since(posts, min(windows.values()) // HOUR_MS * HOUR_MS).filter((t <= as_of_ms) & near)
    corrected = exploded_tags(edge, "timestamp").groupBy("hashtag").agg(F.lit(0).cast("long").alias("uses_total"), *parts)
    stored = states.groupBy("hashtag").agg(F.sum("uses").alias("uses_total"), *whole)
    return stored.unionByName(corrected).groupBy("hashtag").agg(*[F.sum(c).alias(c) for c in ("uses_total", *windows)])
