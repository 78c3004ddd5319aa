"""The batch side: enrichment and the hourly job.

``hourly_job`` is the scheduled batch: it takes the post table, keeps the whole
hours that the window before ``as_of`` touches (partition-pruned), and writes
those hours' metric rows and user counts.  Nothing is collected to the driver; a
later run rewrites the hours it covers and leaves the others alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulse.functions.keys import hour_bucket
from pulse.operators.sentiment import score_sentiment
from pulse.plans import store, user_tiers
from pulse.schemas import ENRICHED_POST
from pulse.sources import files, fixture

HOUR_MS = 3_600_000


def enrich(posts: DataFrame, lexicon=None, method: str = "map") -> DataFrame:
    """Raw posts + ``sentiment`` label and ``sentiment_score``."""
    return score_sentiment(posts, "text", lexicon=lexicon, method=method)


def enriched_posts(spark: SparkSession, sf_dir: str, since_ms: int | None = None) -> DataFrame:
    """The enriched posts of the fixture (10 message columns)."""
    return enrich(fixture.tweets(spark, sf_dir, since_ms)).select(
        *[f.name for f in ENRICHED_POST.fields])


def stored_posts(spark: SparkSession, sf_dir: str, since_ms: int | None = None) -> DataFrame:
    """The fixture as post-table rows (keys, salt, reversed ts, day)."""
    return store.stored_posts(enrich(fixture.tweets(spark, sf_dir, since_ms)))


def hourly_job(spark: SparkSession, posts: DataFrame, as_of_ms: int, metrics_path: str,
               users_path: str, lookback_ms: int = HOUR_MS) -> None:
    """Compute and write one run of the hourly batch.

    ``posts`` is the post table (ideally read from parquet so the window
    filter prunes ``day`` partitions).  Every hour that is written is computed from all
    its posts up to ``as_of``, so runs at any minute, and reruns, agree.
    The users table is the sum of the hours' counts (:func:`read_users`).
    """
    window = store.posts_in_hours(posts, as_of_ms, lookback_ms)
    store.write_metric_rows(store.metric_rows(window), metrics_path)
    hours = window.withColumn("bucket", hour_bucket("timestamp"))
    user_tiers.write_hours(spark, store.user_counts(hours, by=("bucket",)), users_path)
    # an hour of the window that has lost all its posts has no rows to replace its old ones: its partitions go
    first = (as_of_ms - lookback_ms) // HOUR_MS
    asked = {r[0] for r in spark.range(first, as_of_ms // HOUR_MS + 1).select(hour_bucket(F.col("id") * HOUR_MS)).collect()}
    gone = asked - {r[0] for r in hours.select("bucket").distinct().collect()}          # at most the window's hours
    for b in gone.intersection(files.values(spark, metrics_path, "bucket")):
        files.delete(spark, f"{metrics_path}/bucket={b}")
    user_tiers.drop_hours(spark, users_path, sorted(gone.intersection(files.values(spark, users_path, "bucket"))))


def read_users(spark: SparkSession, users_path: str, top_tags: int | None = None) -> DataFrame:
    """The users table that the hourly runs have written: totals over all hours, each read as it is.

    :func:`pulse.plans.user_tiers.users` gives the same from folded days.
    """
    return store.users_from_counts(store.read_user_counts(spark, users_path), top_tags)


# ---- SQL forms over named views (S14) -------------------------------------------------

def register_views(spark: SparkSession, sf_dir: str, since_ms: int | None = None) -> None:
    """Register ``tweets`` (enriched posts) and ``posts`` (post-table rows) as temp views."""
    posts = stored_posts(spark, sf_dir, since_ms)
    posts.createOrReplaceTempView("posts")
    posts.select(*[f.name for f in ENRICHED_POST.fields]).createOrReplaceTempView("tweets")


NEGATIVE_COUNTRIES_SQL = """
WITH by_country AS (
  SELECT location, count(*) AS posts, count_if(sentiment = 'negative') AS negative
  FROM tweets WHERE location <> '' GROUP BY location)
SELECT c.location, c.posts, c.negative
FROM by_country c
WHERE c.negative > c.posts * (SELECT sum(negative) / sum(posts) FROM by_country)
"""


def negative_countries(spark: SparkSession) -> DataFrame:
    """Countries with more negative posts than their number of posts suggests, as SQL over the ``tweets`` view."""
    return spark.sql(NEGATIVE_COUNTRIES_SQL)
