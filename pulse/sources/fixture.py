"""The ``tweets`` view: deterministic posts derived from ``events`` and ``nation``.

Every column is a row-local expression of one event, except the country,
which is a lookup into ``nation``.  A time lower bound is applied to the raw ``ts``
column so that it reaches the parquet scan as a pushed filter.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NATION_COUNT = 26   # event_id % 26 picks the nation; key 25 has no nation -> blank country

# The posts view, column by column, in Spark SQL (FIXTURES.md §3, Spark form).
# The sentences by event_id % 9 (7 is empty text, 8 is null).
POST_COLUMNS_SQL = [
    "CAST(event_id AS STRING) AS tweet_id",
    "concat('user_', user_id) AS user_id",
    """CASE event_id % 9
         WHEN 0 THEN concat('great day with #', event_type)
         WHEN 1 THEN concat('just read about #', event_type)
         WHEN 2 THEN concat('#', event_type, ' is broken again')
         WHEN 3 THEN concat('not great, #', event_type)
         WHEN 4 THEN concat('I love my #', event_type, ' project')
         WHEN 5 THEN concat('#', event_type, ' at noon')
         WHEN 6 THEN concat('terrible #', event_type, ' , I hate it')
         WHEN 7 THEN ''
         ELSE NULL END AS text""",
    """CASE WHEN event_id % 7 = 0 THEN CAST(array() AS array<string>)
            WHEN event_id % 3 = 0 THEN array(concat('#', event_type))
            ELSE array(concat('#', event_type),
                       concat('#k', CAST(get_json_object(props, '$.k') AS INT) % 10)) END AS hashtags""",
    "CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(floor(value * 20) AS INT) END AS likes",
    "CAST(get_json_object(props, '$.k') AS INT) AS retweets",
    "unix_millis(CAST(ts AS TIMESTAMP)) AS `timestamp`",
    f"event_id % {NATION_COUNT} AS _nk",
    "date_format(ts, 'yyyyMMddHH') AS bucket",
]

COLUMNS = ["tweet_id", "user_id", "text", "hashtags", "likes", "retweets",
           "timestamp", "location", "bucket"]


# Declared schemas of the driver tables this library reads (no footer inference).
TABLE_SCHEMAS = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, "
              "props string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
}


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reader = spark.read
    if name in TABLE_SCHEMAS:
        reader = reader.schema(TABLE_SCHEMAS[name])
    return reader.parquet(table_path(sf_dir, name))


def _ntz_literal(ms: int):
    """Epoch millis -> timestamp_ntz literal (UTC wall clock) for pushed filters."""
    value = _dt.datetime(1970, 1, 1) + _dt.timedelta(milliseconds=int(ms))
    return F.lit(value).cast("timestamp_ntz")


def derive_posts(events: DataFrame, nation: DataFrame) -> DataFrame:
    """Map events to posts; works on batch and streaming ``events`` alike."""
    posts = events.selectExpr(*POST_COLUMNS_SQL)
    # Unique on the key by construction, so the optimizer drops this left join
    # whenever a query does not read ``location``.
    dim = (nation.selectExpr("CAST(n_nationkey AS BIGINT) AS _nk", "n_name")
           .groupBy("_nk").agg(F.max("n_name").alias("n_name")))
    return (posts.join(dim, "_nk", "left")
            .selectExpr("tweet_id", "user_id", "text", "hashtags", "likes", "retweets",
                        "`timestamp`", "coalesce(n_name, '') AS location", "bucket"))


def tweets(spark: SparkSession, sf_dir: str, since_ms: int | None = None,
           until_ms: int | None = None) -> DataFrame:
    """The posts view over the whole ``events`` table (or a time range of it)."""
    events = read_table(spark, sf_dir, "events")
    if since_ms is not None:
        events = events.filter(F.col("ts") >= _ntz_literal(since_ms))
    if until_ms is not None:
        events = events.filter(F.col("ts") < _ntz_literal(until_ms))
    return derive_posts(events, read_table(spark, sf_dir, "nation"))


def max_timestamp(spark: SparkSession, sf_dir: str) -> int:
    """Newest event time in epoch millis: one scalar, read from the ``ts`` column only."""
    row = (read_table(spark, sf_dir, "events")
           .agg(F.unix_millis(F.max(F.col("ts")).cast("timestamp")).alias("m")).first())
    return int(row["m"])
