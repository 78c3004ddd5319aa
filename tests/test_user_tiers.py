"""Tiered user totals: equal to the full fold, whatever was written, folded or broken off."""

import os
import random

from pyspark.sql import functions as F

from pulse.functions.keys import hour_bucket
from pulse.plans import batch, store, user_tiers
from pulse.sources import files

T0, HOUR = 1_704_067_200_000, 3_600_000
SCHEMA = "user_id string, likes int, timestamp long, hashtags array<string>"


def _rows(df):
    return sorted(map(str, df.collect()))


def _write(spark, path, rng, hours, n=30):
    rows = [(f"u{rng.randint(0, 9)}", rng.choice([None, 1, 5]), T0 + rng.choice(hours) * HOUR + rng.randint(0, HOUR - 1),
             rng.sample(["#a", "#b", ""], rng.randint(0, 3))) for _ in range(n)]
    posts = spark.createDataFrame(rows, SCHEMA).withColumn("bucket", hour_bucket("timestamp"))
    user_tiers.write_hours(spark, store.user_counts(posts, by=("bucket",)), path)


def _same(spark, path):
    whole = batch.read_users(spark, path)
    assert _rows(user_tiers.users(spark, path)) == _rows(whole)
    assert _rows(user_tiers.totals(spark, path)) == _rows(whole.select("user_id", "total_tweets", "total_likes", "last_active"))


def test_reads_equal_the_full_fold_after_late_hours_and_reruns(spark, tmp_dir):
    rng, path = random.Random(4), os.path.join(tmp_dir, "users")
    _write(spark, path, rng, range(0, 60))
    _same(spark, path)                                     # nothing folded yet
    user_tiers.fold(spark, path, "2024-01-02")
    _same(spark, path)
    _write(spark, path, rng, [70, 71])                     # new hours, then a late one below the mark, then an hour again
    _same(spark, path)
    _write(spark, path, rng, [5], 3)
    _same(spark, path)
    for upto in ("2024-01-02", "2024-01-02", "2024-01-09"):
        user_tiers.fold(spark, path, upto)
        _same(spark, path)
    _write(spark, path, rng, [5, 30], 2)
    user_tiers.fold(spark, path, "2024-01-09")
    _same(spark, path)


def test_a_read_touches_the_snapshot_and_new_hours_only(spark, tmp_dir):
    rng, path = random.Random(5), os.path.join(tmp_dir, "users")
    _write(spark, path, rng, range(0, 96), 200)
    user_tiers.fold(spark, path, "2024-01-04")
    _write(spark, path, rng, [100])
    read = user_tiers.counts(spark, path).inputFiles()
    assert all("-all/upto=2024-01-04/" in f or "bucket=2024010504" in f for f in read)
    # a late hour: its day from hours, the other days from their rows, the snapshot not at all
    _write(spark, path, rng, [30])
    read = user_tiers.counts(spark, path).inputFiles()
    assert not any("-all/" in f for f in read) and any("-days/day=2024-01-01" in f for f in read)
    assert not any("-days/day=2024-01-02" in f for f in read) and any("bucket=2024010206" in f for f in read)
    plan = user_tiers.users(spark, path).filter(F.col("user_id") == "u1")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("EqualTo(user_id,u1)") == plan.count("FileScan parquet")


def test_a_fold_that_broke_off_changes_no_answer(spark, tmp_dir):
    rng, path = random.Random(6), os.path.join(tmp_dir, "users")
    _write(spark, path, rng, range(0, 48))
    user_tiers.fold(spark, path, "2024-01-01")
    _write(spark, path, rng, [3, 40])
    marks = files.values(spark, f"{path}-changed/day=2024-01-01", "mark")
    user_tiers.fold(spark, path, "2024-01-02")
    for m in marks:                                        # as if it had not come to removing its marks
        files.make_folder(spark, f"{path}-changed/day=2024-01-01/mark={m}")
    _same(spark, path)
    files.delete(spark, f"{path}-all/upto=2024-01-02/_SUCCESS")
    _same(spark, path)
    user_tiers.fold(spark, path, "2024-01-02")
    _same(spark, path)


def test_no_hours_no_users(spark, tmp_dir):
    path = os.path.join(tmp_dir, "users")
    user_tiers.fold(spark, path, "2024-01-01")
    assert user_tiers.users(spark, path).collect() == [] and user_tiers.totals(spark, path).collect() == []


def test_an_hour_that_lost_its_posts_leaves_the_tables(spark, tmp_dir):
    rows = [(str(i), "u", T0 + h * HOUR + i) for i, h in enumerate((1, 1, 2, 30))]
    posts = spark.createDataFrame(rows, "tweet_id string, user_id string, timestamp long").selectExpr(
        "*", "array('#a') AS hashtags", "'X' AS location", "1 AS likes", "'neutral' AS sentiment")
    metrics, users = os.path.join(tmp_dir, "m"), os.path.join(tmp_dir, "u")
    as_of = T0 + 31 * HOUR
    batch.hourly_job(spark, posts, as_of, metrics, users, lookback_ms=31 * HOUR)
    user_tiers.fold(spark, users, "2024-01-01")
    left = posts.filter(F.col("timestamp") >= T0 + 24 * HOUR)
    batch.hourly_job(spark, left, as_of, metrics, users, lookback_ms=31 * HOUR)
    assert _rows(store.read_metric_rows(spark, metrics)) == _rows(store.metric_rows(left))
    assert _rows(user_tiers.users(spark, users)) == _rows(store.user_rows(left))
    user_tiers.fold(spark, users, "2024-01-02")
    assert _rows(user_tiers.users(spark, users)) == _rows(store.user_rows(left))
    user_tiers.drop_hours(spark, users, files.values(spark, users, "bucket"))
    assert user_tiers.users(spark, users).collect() == []
    user_tiers.fold(spark, users, "2024-01-02")
    assert user_tiers.users(spark, users).collect() == [] and user_tiers.counts(spark, users).inputFiles() == []
