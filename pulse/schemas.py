"""Declared schemas for every table and message the library reads or writes."""

from __future__ import annotations

from pyspark.sql.types import (ArrayType, DoubleType, IntegerType, LongType,
                               StringType, StructField, StructType)

# Fixed value: a raw post as it arrives on the stream (JSON message).
RAW_POST = StructType([
    StructField("tweet_id", StringType(), True),
    StructField("user_id", StringType(), True),
    StructField("text", StringType(), True),
    StructField("hashtags", ArrayType(StringType()), True),
    StructField("likes", IntegerType(), True),
    StructField("retweets", IntegerType(), True),
    StructField("timestamp", LongType(), True),
    StructField("location", StringType(), True),
])

# Raw post plus the sentiment columns (the republished message).
ENRICHED_POST = StructType(RAW_POST.fields + [
    StructField("sentiment", StringType(), True),
    StructField("sentiment_score", DoubleType(), True),
])

# A row of the post table: row key and its parts, content, meta, analysis.
STORED_POST = StructType([
    StructField("row_key", StringType(), True),
    StructField("salt", LongType(), True),
    StructField("user_id", StringType(), True),
    StructField("rev_ts", LongType(), True),
    StructField("tweet_id", StringType(), True),
    StructField("text", StringType(), True),
    StructField("hashtags", ArrayType(StringType()), True),
    StructField("likes", IntegerType(), True),
    StructField("retweets", IntegerType(), True),
    StructField("location", StringType(), True),
    StructField("sentiment", StringType(), True),
    StructField("sentiment_score", DoubleType(), True),
    StructField("timestamp", LongType(), True),
    StructField("day", StringType(), True),
])

# Long metric rows: one value per (metric, bucket, key).  Never pivoted wide.
METRIC_ROW = StructType([
    StructField("metric", StringType(), False),
    StructField("bucket", StringType(), False),
    StructField("key", StringType(), False),
    StructField("value", LongType(), True),
])

# The hashtags table: one row per tag (key: tag and reversed time of first use).
HASHTAG_ROW = StructType([
    StructField("row_key", StringType(), False),
    StructField("hashtag", StringType(), False),
    StructField("total", LongType(), True),
    StructField("likes_sum", LongType(), True),
    StructField("first_seen", LongType(), True),
])

# Column families of the post table, used by retention (time to live per family).
POST_FAMILIES = {
    "content": ["text", "hashtags"],
    "meta": ["likes", "retweets", "location"],
    "analysis": ["sentiment", "sentiment_score"],
}
