"""The stored tables of one input: posts, metric rows and user counts, written once per version of the input.

Serving queries read these tables, as the read API does.  A version is the set
of input files with their sizes and modification times, so a table that was
rewritten in place is stored again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulse.functions.keys import hour_bucket
from pulse.plans import batch, search_index, store, tag_states, user_tiers
from pulse.session import scratch_path
from pulse.sources import files, fixture

INPUTS = ("events", "nation")
_WRITTEN: dict[tuple, str] = {}   # (application, folder, version, table) -> path


def version(spark: SparkSession, sf_dir: str) -> tuple:
    """The input files' names, sizes and modification times (a listing; no job runs)."""
    return tuple(tuple(files.data_files(spark, fixture.table_path(sf_dir, name))) for name in INPUTS)


def _path(spark: SparkSession, sf_dir: str, table: str, write) -> str:
    key = (spark.sparkContext.applicationId, sf_dir, version(spark, sf_dir), table)
    if key not in _WRITTEN:
        path = scratch_path(spark, f"stored-{table}")
        write(path)
        _WRITTEN[key] = path
    return _WRITTEN[key]


def posts_path(spark: SparkSession, sf_dir: str) -> str:
    return _path(spark, sf_dir, "posts", lambda p: store.write_post_table(batch.stored_posts(spark, sf_dir), p))


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.read_post_table(spark, posts_path(spark, sf_dir))


def as_of(spark: SparkSession, sf_dir: str) -> int:
    """Time of the newest stored post: one column of the newest day."""
    return store.newest_post_ms(spark, posts_path(spark, sf_dir))


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _path(spark, sf_dir, "metrics", lambda p: store.write_metric_rows(store.metric_rows(posts(spark, sf_dir)), p))
    return store.read_metric_rows(spark, path)


def users_path(spark: SparkSession, sf_dir: str) -> str:
    """Hour counts, folded up to the day before the newest post's: that day stays in hours, as between two folds."""
    def write(p):
        hours = posts(spark, sf_dir).withColumn("bucket", hour_bucket("timestamp"))
        early, last = hours.filter(F.col("day") < newest), hours.filter(F.col("day") >= newest)
        user_tiers.write_hours(spark, store.user_counts(early, by=("bucket",)), p)
        user_tiers.fold(spark, p, newest)
        user_tiers.write_hours(spark, store.user_counts(last, by=("bucket",)), p)
    newest = max(files.values(spark, posts_path(spark, sf_dir), "day"), default="")
    return _path(spark, sf_dir, "users", write)


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The users table, from a snapshot and the newest hours."""
    return user_tiers.users(spark, users_path(spark, sf_dir))


def user_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The users table without tags."""
    return user_tiers.totals(spark, users_path(spark, sf_dir))


def tag_index(spark: SparkSession, sf_dir: str) -> str:
    return _path(spark, sf_dir, "tag-index", lambda p: search_index.write_tag_index(posts(spark, sf_dir), p))


def text_index(spark: SparkSession, sf_dir: str) -> str:
    return _path(spark, sf_dir, "text-index", lambda p: search_index.write_text_index(posts(spark, sf_dir), p))


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tag states per hour."""
    path = _path(spark, sf_dir, "tag-states", lambda p: tag_states.write_tag_states(tag_states.tag_states(posts(spark, sf_dir)), p))
    return tag_states.read_tag_states(spark, path)
