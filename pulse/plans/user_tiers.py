"""User totals in tiers: hour counts, folded into days, folded into one snapshot.

The hourly job writes additive counts per hour (:func:`write_hours`).  :func:`fold` sums
the hours of every day that changed into that day's rows, and the days up to a high-water
mark into a snapshot.  A read (:func:`counts`) adds the snapshot, the days after it and the
hours of days that are not folded yet, so it does not grow with the history.

Hours can be written at any time, also again.  Before its rows are written, an hour leaves a
mark at its day; a fold removes the marks that it saw when its results are complete.  A marked day is
read from its hours, and a snapshot that holds a marked day is not read until the next
fold, which makes it anew from the days.  So every read equals the sum over all hours, also
after late hours, reruns, and jobs that broke off anywhere.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulse.plans import store
from pulse.sources import files

_HOURS = store.USER_COUNTS + ", bucket string"
_DAYS = store.USER_COUNTS + ", day string"


def _beside(path: str, tier: str) -> str:
    return f"{path.rstrip('/')}-{tier}"


def _day_of(bucket: str) -> str:
    return f"{bucket[:4]}-{bucket[4:6]}-{bucket[6:8]}"


def write_hours(spark: SparkSession, counts: DataFrame, path: str) -> None:
    """Write the counts of some hours (column ``bucket``), replacing those hours, and mark their days as changed."""
    for (bucket,) in counts.select(F.substring("bucket", 1, 8)).distinct().collect():      # one row per day
        _mark(spark, path, _day_of(bucket))
    store.write_user_counts(counts, path)


def drop_hours(spark: SparkSession, path: str, buckets: list[str]) -> None:
    """Remove hours that no longer have posts, and mark their days as changed."""
    for b in buckets:
        _mark(spark, path, _day_of(b))
        files.delete(spark, f"{path}/bucket={b}")


def _mark(spark: SparkSession, path: str, day: str) -> None:
    files.make_folder(spark, f"{_beside(path, 'changed')}/day={day}/mark={uuid.uuid4().hex}")


def _marks(spark: SparkSession, path: str) -> dict[str, list[str]]:
    changed = _beside(path, "changed")
    return {d: marks for d in files.values(spark, changed, "day") if (marks := files.values(spark, f"{changed}/day={d}", "mark"))}


def _snapshot(spark: SparkSession, path: str) -> str | None:
    """The day up to which the newest complete snapshot reaches."""
    whole = [v for v in files.values(spark, _beside(path, "all"), "upto") if files.exists(spark, f"{_beside(path, 'all')}/upto={v}/_SUCCESS")]
    return max(whole, default=None)


def _hour_folders(spark: SparkSession, path: str, days) -> list[str]:
    days = set(days)
    return [f"{path}/bucket={b}" for b in files.values(spark, path, "bucket") if _day_of(b) in days] if days else []


def _summed(counts: DataFrame, *by: str) -> DataFrame:
    return counts.groupBy(*by, "user_id", "hashtag").agg(
        F.sum("posts").alias("posts"), F.sum("likes").alias("likes"), F.max("last_ts").alias("last_ts"), F.sum("uses").alias("uses"))


def _write(counts: DataFrame, path: str, by: tuple[str, ...] = ()) -> None:
    """Sorted so that the rows of stats (no tag) come first, and a user's rows lie together."""
    order = [*by, F.col("hashtag").isNotNull(), "user_id"]
    writer = (counts.repartitionByRange(*order).sortWithinPartitions(*order, "hashtag").write.mode("overwrite")
              .option("partitionOverwriteMode", "dynamic"))
    (writer.partitionBy(*by) if by else writer).parquet(path)


def fold(spark: SparkSession, path: str, upto: str) -> None:
    """Fold every changed day, and all days up to ``upto`` (yyyy-MM-dd) into the snapshot."""
    marks, days, whole = _marks(spark, path), _beside(path, "days"), _beside(path, "all")
    if marks:
        hours = files.read_partitions(spark, path, _hour_folders(spark, path, marks), _HOURS)
        day = F.concat_ws("-", F.substring("bucket", 1, 4), F.substring("bucket", 5, 2), F.substring("bucket", 7, 2))
        _write(_summed(hours.withColumn("day", day), "day"), days, ("day",))
        left = {_day_of(b) for b in files.values(spark, path, "bucket")}
        for d in set(marks) - left:                # all its hours are gone
            files.delete(spark, f"{days}/day={d}")
    old = _snapshot(spark, path)
    last = max([d for d in files.values(spark, days, "day") if d <= upto], default=None)
    stale = old is not None and any(d <= old for d in marks)
    if last is not None and (stale or old is None or last > old):
        since = "" if stale or old is None else old
        parts = files.read_partitions(spark, days, [f"{days}/day={d}" for d in files.values(spark, days, "day") if since < d <= max(last, old or "")], _DAYS)
        if since:
            parts = parts.drop("day").unionByName(spark.read.schema(store.USER_COUNTS).parquet(f"{whole}/upto={old}"))
        new = max(last, old or "")
        target = f"{whole}/upto={new}" if new != old else f"{whole}/next"
        _write(_summed(parts), target)
        if new == old:                  # a snapshot made anew for the same day takes its place; while it is missing, days are read
            files.delete(spark, f"{whole}/upto={old}")
            files.move(spark, target, f"{whole}/upto={new}")
    elif stale:                             # nothing is left of what it held
        files.delete(spark, f"{whole}/upto={old}")
    for v in files.values(spark, whole, "upto"):
        if old is not None and v < old:          # keep the one before for reads under way
            files.delete(spark, f"{whole}/upto={v}")
    for d, seen in marks.items():
        for m in seen:
            files.delete(spark, f"{_beside(path, 'changed')}/day={d}/mark={m}")


def counts(spark: SparkSession, path: str) -> DataFrame:
    """User counts of all hours, from as few rows as the tiers allow; rows of one user and tag add up."""
    marks, mark = set(_marks(spark, path)), _snapshot(spark, path)
    if mark is not None and any(d <= mark for d in marks):
        mark = None
    days, whole = _beside(path, "days"), _beside(path, "all")
    folded = [f"{days}/day={d}" for d in files.values(spark, days, "day") if d not in marks and (mark is None or d > mark)]
    columns = [c.split()[0] for c in store.USER_COUNTS.split(", ")]
    parts = [files.read_partitions(spark, path, _hour_folders(spark, path, marks), _HOURS), files.read_partitions(spark, days, folded, _DAYS)]
    if mark is not None:
        parts.append(spark.read.schema(store.USER_COUNTS).parquet(f"{whole}/upto={mark}"))
    out = parts[0].select(*columns)
    for p in parts[1:]:
        out = out.unionByName(p.select(*columns))
    return out


def users(spark: SparkSession, path: str, top_tags: int | None = None) -> DataFrame:
    """The users table over all hours."""
    return store.users_from_counts(counts(spark, path), top_tags)


def totals(spark: SparkSession, path: str) -> DataFrame:
    """user_id, total_tweets, total_likes, last_active: the users table without tags; only rows of stats are read."""
    stats = counts(spark, path).filter(F.col("hashtag").isNull())
    return stats.groupBy("user_id").agg(F.sum("posts").alias("total_tweets"), F.coalesce(F.sum("likes"), F.lit(0)).alias("total_likes"),
                                        store.hour_bucket(F.max("last_ts")).alias("last_active"))
