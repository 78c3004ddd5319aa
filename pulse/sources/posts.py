"""JSON posts in, JSON posts out, and the missing-value policy.

``parse_posts`` turns message text into typed columns with a declared schema
and splits off rejects (malformed JSON, or a message without post id, user or time,
which could not be keyed) instead of letting such rows flow on as neutral posts.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulse.functions.tags import clean_tags
from pulse.schemas import ENRICHED_POST, RAW_POST

# Defaults for missing cells on read.
REQUIRED = ("tweet_id", "user_id", "timestamp")
DEFAULTS = {"likes": 0, "retweets": 0, "text": "", "location": "", "sentiment": "neutral",
            "sentiment_score": 0.0}


def decode(df: DataFrame, value_col: str = "value", schema=RAW_POST,
           keep: tuple[str, ...] = ()) -> DataFrame:
    """Bytes or text -> struct -> flat columns plus ``_valid`` flag.

    ``from_json`` in PERMISSIVE mode turns a malformed message into an all-null
    struct and a field of the wrong type into a null field, keeping the rest.
    The generator around the parsed struct keeps the optimizer from parsing
    again in every filter and projection above it.
    """
    text = F.col(value_col).cast("string")
    parsed = F.from_json(text, schema, {"mode": "PERMISSIVE"})
    out = df.select(*keep, text.alias("_raw"), F.explode(F.array(parsed)).alias("_post"))
    present = [F.col(f"_post.{c}").isNotNull() for c in REQUIRED if c in schema.names]
    return out.select(*keep, "_raw", "_post.*", reduce(and_, present, F.lit(True)).alias("_valid"))


def parse_posts(df: DataFrame, value_col: str = "value", schema=RAW_POST,
                keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Return ``(posts, rejects)``; rejects keep the raw message text."""
    decoded = decode(df, value_col, schema, keep)
    posts = decoded.filter("_valid").drop("_valid", "_raw")
    rejects = decoded.filter(~F.col("_valid")).select(*keep, F.col("_raw").alias("value"))
    return posts, rejects


def normalize_posts(df: DataFrame) -> DataFrame:
    """Apply the read-side defaults and drop empty tags."""
    out = df
    for name, default in DEFAULTS.items():
        if name in df.columns:
            out = out.withColumn(name, F.coalesce(F.col(name), F.lit(default)))
    if "hashtags" in df.columns:
        out = out.withColumn("hashtags", F.coalesce(clean_tags("hashtags"),
                                                    F.array().cast("array<string>")))
    return out


def payload_struct(df: DataFrame, fields=None) -> Column:
    names = fields or [f.name for f in ENRICHED_POST.fields if f.name in df.columns]
    return F.struct(*[F.col(n) for n in names])


def to_payload(df: DataFrame, fields=None, key_col: str | None = "tweet_id") -> DataFrame:
    """One JSON message per post; nulls are written as ``null``, not dropped."""
    value = F.to_json(payload_struct(df, fields), {"ignoreNullFields": "false"})
    cols = [value.alias("value")]
    if key_col:
        cols.insert(0, F.col(key_col).cast("string").alias("key"))
    return df.select(*cols)
