"""Post table layout, pruning, hourly job idempotence, upsert snapshots."""

import os

from pyspark.sql import functions as F

from conftest import SF_SMALL
from pulse.plans import batch, store
from pulse.sources import fixture

HOUR = 3_600_000


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_post_table_roundtrip_and_pruning(spark, tmp_dir):
    posts = batch.stored_posts(spark, SF_SMALL)
    path = os.path.join(tmp_dir, "posts")
    store.write_post_table(posts, path)
    back = store.read_post_table(spark, path)
    assert back.count() == posts.count()
    as_of = fixture.max_timestamp(spark, SF_SMALL)
    window = store.read_post_table(spark, path, since_ms=as_of - 24 * HOUR)
    plan = _plan(window)
    assert "PartitionFilters: [isnotnull(day" in plan and "GreaterThanOrEqual(timestamp" in plan
    expected = posts.filter(F.col("timestamp") >= as_of - 24 * HOUR).count()
    assert window.count() == expected


def test_user_lookup_pushes_salt_and_user(spark, tmp_dir):
    path = os.path.join(tmp_dir, "posts")
    store.write_post_table(batch.stored_posts(spark, SF_SMALL), path)
    q = store.user_posts(store.read_post_table(spark, path), "user_7")
    plan = _plan(q)
    assert "EqualTo(user_id,user_7)" in plan and "EqualTo(salt," in plan
    rows = q.collect()
    assert rows and all(r.user_id == "user_7" for r in rows)
    assert [r.rev_ts for r in rows] == sorted(r.rev_ts for r in rows)


def _rows(df):
    return sorted(map(str, df.collect()))


def test_hourly_runs_at_any_minute_agree_with_the_batch_answer(spark, tmp_dir):
    posts = batch.stored_posts(spark, SF_SMALL)
    as_of = fixture.max_timestamp(spark, SF_SMALL)
    metrics, users = os.path.join(tmp_dir, "metrics"), os.path.join(tmp_dir, "users")
    for minutes in (95, 40, 20, 0):
        batch.hourly_job(spark, posts, as_of - minutes * 60_000, metrics, users)
    since = (as_of - 95 * 60_000 - HOUR) // HOUR * HOUR
    whole = posts.filter((F.col("timestamp") >= since) & (F.col("timestamp") <= as_of))
    assert _rows(store.read_metric_rows(spark, metrics)) == _rows(store.metric_rows(whole))
    assert _rows(batch.read_users(spark, users)) == _rows(store.user_rows(whole))
    # rerunning an old run neither counts later posts nor touches other hours
    batch.hourly_job(spark, posts, (as_of // HOUR) * HOUR - 1, metrics, users)
    assert _rows(store.read_metric_rows(spark, metrics)) == _rows(store.metric_rows(whole))


def test_partial_hours_are_never_stored(spark, tmp_dir):
    t0 = 1_704_114_000_000      # 13:00
    rows = [("1", "u", t0 + 5 * 60_000), ("2", "u", t0 + 30 * 60_000), ("3", "u", t0 + 70 * 60_000)]
    posts = spark.createDataFrame(rows, "tweet_id string, user_id string, timestamp long").selectExpr(
        "*", "array('#a') AS hashtags", "'X' AS location", "1 AS likes", "'neutral' AS sentiment")
    metrics, users = os.path.join(tmp_dir, "m"), os.path.join(tmp_dir, "u")
    for minute in (60, 80):
        batch.hourly_job(spark, posts, t0 + minute * 60_000, metrics, users)
    got = {r.bucket: r.value for r in store.read_metric_rows(spark, metrics).filter("metric = 'hashtag'").collect()}
    assert got == {"2024010113": 2, "2024010114": 1}
    user = batch.read_users(spark, users).collect()[0]
    assert (user.total_tweets, user.total_likes, user.last_active) == (3, 3, "2024010114")


def test_post_table_upsert_keeps_the_rest_of_the_day(spark, tmp_dir):
    posts = batch.stored_posts(spark, SF_SMALL)
    path = os.path.join(tmp_dir, "posts")
    early = F.col("timestamp") % 86_400_000 < 40_000_000
    store.write_post_table(posts.filter(early), path)
    changed = posts.filter(~early).withColumn("likes", F.lit(-1))
    store.upsert_post_table(spark, changed, path)
    store.upsert_post_table(spark, posts.filter(~early), path)      # the same keys again: replaced, not doubled
    assert _rows(store.read_post_table(spark, path)) == _rows(posts)


def test_rank_limits_come_before_the_shuffle(spark):
    posts = batch.stored_posts(spark, SF_SMALL)
    assert "WindowGroupLimit" in _plan(store.metric_rows(posts))
    assert "WindowGroupLimit" in _plan(store.user_rows(posts, top_tags=2))
    hot = spark.range(3_000).selectExpr("cast(id AS string) AS tweet_id", "'hot' AS user_id", "1 AS likes", "7L AS timestamp",
                                        "array(concat('#t', id % 1000), '#common') AS hashtags", "'X' AS location", "'neutral' AS sentiment")
    tops = store.metric_rows(hot).filter("metric = 'trending'").orderBy(F.desc("value"), "key").collect()
    assert len(tops) == 10 and (tops[0].key, tops[0].value) == ("#common", 3_000)
    assert len(store.user_rows(hot).first().top_hashtags) == 1_001
    assert store.user_rows(hot, top_tags=2).first().top_hashtags == ["#common", "#t0"]


def test_stored_tables_follow_the_input(spark, tmp_dir):
    from pulse.plans import stored
    from pulse.plans.catalog import QUERIES
    events = fixture.read_table(spark, SF_SMALL, "events").persist()
    fixture.read_table(spark, SF_SMALL, "nation").write.parquet(os.path.join(tmp_dir, "nation.parquet"))
    target = os.path.join(tmp_dir, "events.parquet")
    for n in (40, 10):
        events.limit(n).write.mode("overwrite").parquet(target)
        assert QUERIES["volume_total"](spark, tmp_dir).first()[0] == n
        assert stored.posts(spark, tmp_dir).count() == n
    events.unpersist()


def test_latest_metrics_from_table_prunes(spark, tmp_dir):
    posts = batch.stored_posts(spark, SF_SMALL)
    path = os.path.join(tmp_dir, "metrics")
    store.write_metric_rows(store.metric_rows(posts), path)
    rows = store.read_metric_rows(spark, path)
    latest = store.latest_metrics(rows)
    newest = rows.groupBy("metric").agg(F.max("bucket").alias("b")).collect()
    want = {(r.metric, r.b) for r in newest}
    got = {(r.metric, r.bucket) for r in latest.select("metric", "bucket").distinct().collect()}
    assert got == want


def test_delete_keys(spark):
    posts = batch.stored_posts(spark, SF_SMALL)
    doomed = posts.filter(F.col("likes") > 900).select("row_key")
    left = store.delete_keys(posts, doomed)
    assert left.count() == posts.count() - doomed.distinct().count()
    assert left.join(doomed, "row_key").count() == 0


def test_prefix_and_bounded_scan(spark):
    posts = batch.stored_posts(spark, SF_SMALL)
    assert store.prefix_scan(posts, "3_").filter(F.col("salt") != 3).count() == 0
    keys = [r.row_key for r in store.bounded_scan(posts, 20).collect()]
    assert keys == sorted(r.row_key for r in posts.select("row_key").collect())[:20]


def test_point_get(spark):
    posts = batch.stored_posts(spark, SF_SMALL)
    key = posts.select("row_key").orderBy("row_key").first().row_key
    assert store.point_get(posts, key).count() >= 1
    assert store.point_get(posts, "no_such_key").count() == 0


def test_latest_metrics_within_ttl_prunes_partitions(spark, tmp_dir):
    posts = batch.stored_posts(spark, SF_SMALL)
    path = os.path.join(tmp_dir, "metrics")
    store.write_metric_rows(store.metric_rows(posts), path)
    rows = store.read_metric_rows(spark, path)
    as_of = fixture.max_timestamp(spark, SF_SMALL)
    live = store.latest_metrics(rows, as_of)
    plan = live._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "(bucket#" in plan
    newest = rows.agg(F.max("bucket")).first()[0]
    got = {r.bucket for r in live.select("bucket").distinct().collect()}
    assert newest in got and all(b >= store.metric_retention_cutoff(as_of) for b in got)


def test_user_counts_add_up_over_runs(spark, tmp_dir):
    from pulse.functions.keys import hour_bucket
    posts = batch.stored_posts(spark, SF_SMALL).withColumn("bucket", hour_bucket("timestamp"))
    path = os.path.join(tmp_dir, "counts")
    late = F.col("timestamp") >= fixture.max_timestamp(spark, SF_SMALL) // 86_400_000 * 86_400_000
    for part in (posts.filter(~late), posts.filter(late), posts.filter(late)):        # the last run twice
        store.write_user_counts(store.user_counts(part, by=("bucket",)), path)
    assert _rows(batch.read_users(spark, path)) == _rows(store.user_rows(posts))


def _files_by_day(spark, path):
    from pulse.sources import files
    out = {}
    for f, *_ in files.data_files(spark, path):
        out.setdefault(f.split("day=")[1][:10], set()).add(f)
    return out


def test_delete_rewrites_only_the_days_that_hold_the_keys(spark, tmp_dir):
    path, posts = os.path.join(tmp_dir, "posts"), batch.stored_posts(spark, SF_SMALL)
    store.write_post_table(posts, path)
    before, table = _files_by_day(spark, path), store.read_post_table(spark, path)
    some = table.orderBy("row_key").select("row_key", "day").limit(3).collect()
    absent = table.filter(F.col("day") == max(before)).first().row_key[:-4] + "0000"      # of a day that is there, but no post's
    keys = spark.createDataFrame([(r.row_key,) for r in some] * 2 + [(absent,), ("no key",), (None,)], "row_key string")
    want = _rows(table.join(keys, "row_key", "left_anti"))
    assert store.delete_from_table(spark, path, keys) == sorted({r.day for r in some})
    after = _files_by_day(spark, path)
    assert {d for d in before if before[d] != after[d]} == {r.day for r in some}
    assert _rows(store.read_post_table(spark, path)) == want
    # a day that loses all its posts goes; deleting again changes nothing
    gone = min(after)
    whole = store.read_post_table(spark, path).filter(F.col("day") == gone).select("row_key")
    store.delete_from_table(spark, path, whole)
    assert gone not in _files_by_day(spark, path)
    assert store.delete_from_table(spark, path, keys) == []


def test_expired_cells_and_hours_leave_the_stored_tables(spark, tmp_dir):
    path, posts = os.path.join(tmp_dir, "posts"), batch.stored_posts(spark, SF_SMALL)
    store.write_post_table(posts, path)
    as_of = fixture.max_timestamp(spark, SF_SMALL) + 80 * 24 * HOUR
    before = _files_by_day(spark, path)
    done = store.expire_posts(spark, path, as_of)
    assert _rows(store.read_post_table(spark, path)) == _rows(store.apply_post_retention(posts, as_of))
    after = _files_by_day(spark, path)
    assert done and {d for d in before if before[d] != after[d]} == set(done)
    assert store.expire_posts(spark, path, as_of) == []
    metrics = os.path.join(tmp_dir, "metrics")
    store.write_metric_rows(store.metric_rows(posts), metrics)
    now, whole = fixture.max_timestamp(spark, SF_SMALL), store.metric_rows(posts)
    assert store.expire_metrics(spark, metrics, now)
    assert _rows(store.read_metric_rows(spark, metrics)) == _rows(store.apply_metric_retention(whole, now))
    assert store.expire_metrics(spark, metrics, now) == []


def test_newest_days_first(spark, tmp_dir):
    from pulse.plans import serving
    path, t0, day = os.path.join(tmp_dir, "posts"), 1_704_067_200_000, 86_400_000
    rows = [(str(i), f"u{i % 3}", t0 + d * day + i % 5) for i, d in enumerate([0] * 40 + [1] * 6 + [2] * 4 + [5] * 3)]
    posts = spark.createDataFrame(rows, "tweet_id string, user_id string, timestamp long").selectExpr(
        "*", "'t' AS text", "array('#a') AS hashtags", "'X' AS location", "1 AS likes", "2 AS retweets")
    store.write_post_table(store.stored_posts(batch.enrich(posts)), path)
    for n, days in ((1, 1), (3, 1), (4, 2), (7, 2), (8, 3), (13, 3), (50, 4), (200, 4)):
        found = store.newest_days(spark, path, n)
        assert len({f.split("day=")[1][:10] for f in found.inputFiles()}) == days, n
        assert _rows(serving.recent_posts(found, n)) == _rows(serving.recent_posts(store.read_post_table(spark, path), n))
    assert store.newest_post_ms(spark, path) == t0 + 5 * day + max(i % 5 for i in range(50, 53))
    assert store.newest_days(spark, os.path.join(tmp_dir, "none"), 5).collect() == []
