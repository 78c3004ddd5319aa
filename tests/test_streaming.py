"""Structured Streaming: stream == batch, late rows, dedupe, idempotent replay."""

import json
import os
import time

from pyspark.sql import functions as F

from conftest import SF_SMALL
from pulse.operators import aggregates as agg
from pulse.plans import batch, store
from pulse.schemas import RAW_POST
from pulse.sources import fixture
from pulse.streaming import jobs

HOUR = 3_600_000
DAY_MS = 86_400_000


def test_stream_equals_batch_on_finished_windows(spark):
    streamed = jobs.stream_hourly_hashtags(spark, SF_SMALL)
    posts = fixture.tweets(spark, SF_SMALL)
    max_ts = fixture.max_timestamp(spark, SF_SMALL)
    cutoff = max_ts - 10 * 60 * 1000
    hour = F.floor(F.col("timestamp") / HOUR) * HOUR
    expected = (agg.exploded_tags(posts.filter(hour + HOUR <= cutoff), "timestamp")
                .groupBy(F.date_format(F.timestamp_millis(F.floor(F.col("timestamp") / HOUR) * HOUR),
                                       "yyyyMMddHH").alias("bucket"), "hashtag")
                .agg(F.count(F.lit(1)).alias("cnt")))
    assert streamed.exceptAll(expected).count() == 0
    assert expected.exceptAll(streamed).count() == 0


def _write_lines(folder, name, rows, mtime=None):
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, name)
    with open(path, "w") as fh:
        for r in rows:
            fh.write((r if isinstance(r, str) else json.dumps(r)) + "\n")
    if mtime is not None:
        os.utime(path, (mtime, mtime))


def _post(tid, ts, likes=5, tags=("#a",)):
    return {"tweet_id": tid, "user_id": "user_1", "text": "great", "hashtags": list(tags),
            "likes": likes, "retweets": 0, "timestamp": ts, "location": "X"}


def test_late_rows_dropped_and_duplicates_counted_once(spark, tmp_dir):
    src = os.path.join(tmp_dir, "in")
    t0 = 1_704_067_200_000
    base = time.time()
    # one file per micro-batch (file order = modification time)
    _write_lines(src, "f0.json", [_post("1", t0 + 1000), _post("2", t0 + 2 * HOUR), "garbage"], base)
    _write_lines(src, "f1.json", [_post("2", t0 + 2 * HOUR),             # re-delivered post
                                  _post("5", t0 + 3 * HOUR)], base + 10)
    _write_lines(src, "f2.json", [_post("3", t0 + 5000),                 # hour 00 already final
                                  _post("4", t0 + 3 * HOUR + 20 * 60 * 1000)], base + 20)
    messages = jobs.file_messages(spark, src, max_files_per_trigger=1)
    posts, _rejects = jobs.parse_stream(messages)
    live = jobs.with_event_time(posts).dropDuplicatesWithinWatermark(["tweet_id"])
    out = os.path.join(tmp_dir, "out")
    q = jobs.start_append(jobs.hourly_hashtag_counts(live), out, os.path.join(tmp_dir, "ck"))
    q.awaitTermination()
    got = {(r.bucket, r.cnt) for r in spark.read.parquet(out).collect()}
    # hour 00: post 1 only (post 3 arrived after the hour was emitted); hour 02: post 2 once;
    # hour 03 is still open (watermark 03:10)
    assert got == {("2024010100", 1), ("2024010102", 1)}


def test_live_job_writes_idempotent_batches(spark, tmp_dir):
    src = os.path.join(tmp_dir, "in")
    t0 = 1_704_067_200_000
    _write_lines(src, "f1.json", [_post("1", t0, likes=2000), _post("2", t0 + 1, likes=1),
                                  "{broken"])
    messages = jobs.file_messages(spark, src)
    posts, _ = jobs.parse_stream(messages)
    metrics, payload = os.path.join(tmp_dir, "metrics"), os.path.join(tmp_dir, "payload")
    q = jobs.start_live_job(posts, metrics, os.path.join(tmp_dir, "ck"), payload_path=payload,
                            available_now=True)
    q.awaitTermination()
    rows = spark.read.parquet(metrics)
    n_rows = rows.count()
    viral = rows.filter("metric = 'viral'").collect()
    assert [(r.key, r.value) for r in viral] == [("1", 2000)]
    assert rows.filter("metric = 'sentiment'").agg(F.sum("value")).first()[0] == 2
    own = rows.first().query_id
    # replaying batch 0 rewrites its partition instead of appending
    static = spark.read.schema(RAW_POST).json(src).filter("tweet_id IS NOT NULL")
    enriched = batch.enrich(static)
    jobs.make_batch_writer(metrics, payload, query_id=own)(enriched, 0)
    assert spark.read.parquet(metrics).count() == n_rows
    msgs = spark.read.parquet(payload).collect()
    assert len(msgs) == 2 and all('"sentiment"' in m.value for m in msgs)
    # a query on a new checkpoint starts at batch 0 again and replaces nothing
    _write_lines(src, "f2.json", [_post("3", t0 + 60_000)])
    posts, _ = jobs.parse_stream(jobs.file_messages(spark, src))
    jobs.start_live_job(posts, metrics, os.path.join(tmp_dir, "ck2"), payload, available_now=True).awaitTermination()
    both = spark.read.parquet(metrics)
    assert both.select("query_id").distinct().count() == 2 and both.filter(F.col("query_id") == own).count() == n_rows


def test_live_job_keeps_late_posts_and_drops_redelivered_ones(spark, tmp_dir):
    src, t0, base = os.path.join(tmp_dir, "in"), 1_704_067_200_000, time.time()
    for i in range(12):
        rows = [_post(str(i), t0 + i * HOUR, likes=2000 if i == 3 else 5)] + ([_post(str(i - 1), t0 + (i - 1) * HOUR)] if i else [])
        _write_lines(src, f"f{i:02}.json", rows, base + 10 * i)
    _write_lines(src, "f99.json", [_post("late", t0 + 1000)], base + 1000)        # 11 hours behind
    posts, _ = jobs.parse_stream(jobs.file_messages(spark, src, max_files_per_trigger=1))
    metrics, payload = os.path.join(tmp_dir, "m"), os.path.join(tmp_dir, "p")
    jobs.start_live_job(posts, metrics, os.path.join(tmp_dir, "ck"), payload, available_now=True).awaitTermination()
    got = jobs.read_live_metrics(spark, metrics)
    assert sorted(r.key for r in spark.read.parquet(payload).collect()) == sorted([*map(str, range(12)), "late"])
    assert got.filter("metric = 'sentiment'").agg(F.sum("value")).first()[0] == 13
    viral = got.filter("metric = 'viral'").collect()
    assert [(r.key, r.value, r.text, r.user_id) for r in viral] == [("3", 2000, "great", "user_1")]
    # more than ten batches: the newest window is the newest in time, also as text
    newest = store.latest_metrics(got.select("metric", "bucket", "key", "value")).filter("metric = 'hashtag'").collect()
    assert [r.bucket for r in newest] == ["20240101110000"]


def test_posts_redelivered_hundreds_of_batches_later_are_dropped(spark, tmp_dir):
    t0, metrics, payload = 1_704_067_200_000, os.path.join(tmp_dir, "m"), os.path.join(tmp_dir, "p")
    write = jobs.make_batch_writer(metrics, payload)
    for batch_id, names in ((0, "ab"), (1, "c"), (500, "acd"), (100_000, "bd")):
        src = os.path.join(tmp_dir, f"in{batch_id}")
        _write_lines(src, "f.json", [_post(n, t0 + 1000 * ord(n)) for n in names])
        posts, _ = jobs.parse_stream(spark.read.text(src))
        write(jobs.live_posts(posts), batch_id)
    assert sorted(r.key for r in spark.read.parquet(payload).collect()) == list("abcd")
    assert jobs.read_live_metrics(spark, metrics).filter("metric = 'sentiment'").agg(F.sum("value")).first()[0] == 4


def test_latest_metrics_merged_keeps_older_keys(spark):
    rows = spark.createDataFrame([("geo", "2024010100", "A", 1), ("geo", "2024010100", "B", 2), ("geo", "2024010101", "A", 5)],
                                 "metric string, bucket string, key string, value long")
    assert sorted((r.key, r.value) for r in store.latest_metrics(rows, mode="merge").collect()) == [("A", 5), ("B", 2)]
    assert [(r.key, r.value) for r in store.latest_metrics(rows).collect()] == [("A", 5)]


def test_empty_batch_writes_nothing(spark, tmp_dir):
    empty = spark.createDataFrame([], RAW_POST)
    metrics = os.path.join(tmp_dir, "metrics")
    jobs.make_batch_writer(metrics, os.path.join(tmp_dir, "payload"))(batch.enrich(empty), 3)
    assert not os.path.exists(metrics)


def test_second_consumer_and_alerts(spark, tmp_dir):
    src = os.path.join(tmp_dir, "in")
    t0 = 1_704_067_200_000
    _write_lines(src, "f0.json", [_post("1", t0, likes=3000), _post("2", t0 + DAY_MS, likes=7)])
    posts, _ = jobs.parse_stream(jobs.file_messages(spark, src))
    live = jobs.live_posts(posts)
    table = os.path.join(tmp_dir, "posts")
    q1 = jobs.start_post_table_writer(live, table, os.path.join(tmp_dir, "ck1"), available_now=True)
    q1.awaitTermination()
    final = os.path.join(tmp_dir, "table")
    for _ in range(2):                       # compaction again: nothing is doubled
        jobs.store_inbox(spark, table, final)
    stored = store.read_post_table(spark, final)
    assert sorted(r.day for r in stored.select("day").collect()) == ["2024-01-01", "2024-01-02"]
    assert {r.row_key.split("_")[1] for r in stored.collect()} == {"user"}
    alerts = os.path.join(tmp_dir, "alerts")
    q2 = jobs.start_alerts(live, os.path.join(tmp_dir, "ck2"), path=alerts, available_now=True)
    q2.awaitTermination()
    assert [(r.tweet_id, r.likes) for r in spark.read.parquet(alerts).collect()] == [("1", 3000)]


def _live(spark, src, tables, checkpoint, **options):
    jobs.start_live_job(jobs.file_messages(spark, src, **options), tables[0], checkpoint, tables[1], available_now=True).awaitTermination()


def _n(spark, metrics):
    return jobs.read_live_metrics(spark, metrics).filter("metric = 'sentiment'").agg(F.sum("value")).first()[0]


def test_a_new_checkpoint_over_the_same_messages_adds_nothing(spark, tmp_dir):
    src, t0, tables = os.path.join(tmp_dir, "in"), 1_704_067_200_000, (os.path.join(tmp_dir, "m"), os.path.join(tmp_dir, "p"))
    for i in range(5):
        _write_lines(src, f"f{i}.json", [_post(f"{i}-{k}", t0 + i * HOUR + k * 60_000) for k in range(20)], time.time() + i)
    _live(spark, src, tables, os.path.join(tmp_dir, "ck"), max_files_per_trigger=1)
    assert _n(spark, tables[0]) == 100
    for n in (2, 3):
        _live(spark, src, tables, os.path.join(tmp_dir, f"ck{n}"), max_files_per_trigger=n)
        assert _n(spark, tables[0]) == 100 and spark.read.parquet(tables[1]).count() == 100
    _write_lines(src, "f9.json", [_post("new", t0), _post("0-0", t0)], time.time() + 100)
    _live(spark, src, tables, os.path.join(tmp_dir, "ck"))
    assert _n(spark, tables[0]) == 101
    log = jobs.read_batches(spark, tables[0])
    assert log.select("query_id").distinct().count() == 3
    assert log.agg(F.sum("posts"), F.sum("messages")).first()[:] == (101, 302)


def test_a_batch_reads_the_keys_of_its_own_slots_only(spark, tmp_dir):
    t0, tables = 1_704_067_200_000, (os.path.join(tmp_dir, "m"), os.path.join(tmp_dir, "p"))
    write = jobs.make_batch_writer(*tables, query_id="one")
    for i in range(12):
        posts = spark.createDataFrame([_post(f"{i}-{k}", t0 + i * HOUR + k) for k in range(3)], RAW_POST)
        write(posts, i)
    keys, log = jobs.beside(tables[1], "keys"), jobs.beside(tables[0], "batches")
    slots = ["2024010103", "2024010106"]
    found = jobs.written_keys(spark, keys, log, slots, "two", 0)
    assert sorted(r.tweet_id for r in found.collect()) == [f"{i}-{k}" for i in (3, 6) for k in range(3)]
    assert len(found.inputFiles()) == 2 and all(any(f"slot={s}/" in f for s in slots) for f in found.inputFiles())
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "slot#" in plan.split("PartitionFilters: ")[1].split("PushedFilters")[0]
    assert jobs.written_keys(spark, keys, log, ["2024030100"], "two", 0) is None
    # a batch done again is held against those before it only
    assert jobs.written_keys(spark, keys, log, ["2024010103"], "one", 3).count() == 0
    assert jobs.written_keys(spark, keys, log, ["2024010103"], "one", 4).count() == 3


def test_a_batch_that_was_never_finished_does_not_count(spark, tmp_dir):
    from pulse.sources import files
    t0, tables = 1_704_067_200_000, (os.path.join(tmp_dir, "m"), os.path.join(tmp_dir, "p"))
    posts = spark.createDataFrame([_post("a", t0), _post("b", t0 + 1)], RAW_POST)
    jobs.make_batch_writer(*tables, query_id="one")(posts, 0)
    jobs.make_batch_writer(*tables, query_id="one")(posts.limit(0).union(spark.createDataFrame([_post("c", t0 + 2)], RAW_POST)), 1)
    files.delete(spark, f"{jobs.beside(tables[0], 'batches')}/query_id=one/batch_id=1")     # as if it had broken off before its last write
    assert _n(spark, tables[0]) == 2
    again = spark.createDataFrame([_post("a", t0), _post("c", t0 + 2)], RAW_POST)
    jobs.make_batch_writer(*tables, query_id="two")(again, 0)
    assert _n(spark, tables[0]) == 3
    # the broken batch done again finds its post written by the other query
    jobs.make_batch_writer(*tables, query_id="one")(spark.createDataFrame([_post("c", t0 + 2)], RAW_POST), 1)
    assert _n(spark, tables[0]) == 3
    assert jobs.read_batches(spark, tables[0]).filter("query_id = 'one' AND batch_id = 1").first().posts == 0


def test_dead_letters_and_good_posts_are_all_messages_of_every_batch(spark, tmp_dir):
    src, t0, tables = os.path.join(tmp_dir, "in"), 1_704_067_200_000, (os.path.join(tmp_dir, "m"), os.path.join(tmp_dir, "p"))
    keyless = {k: v for k, v in _post("x", t0).items() if k != "user_id"}
    _write_lines(src, "f0.json", [_post("1", t0), "{broken", _post("2", t0), json.dumps(keyless)], time.time())
    _write_lines(src, "f1.json", ["{broken", "", "not json"], time.time() + 5)
    _write_lines(src, "f2.json", [_post("1", t0), _post("3", t0)], time.time() + 10)
    _live(spark, src, tables, os.path.join(tmp_dir, "ck"), max_files_per_trigger=1)
    log = [tuple(r) for r in jobs.read_batches(spark, tables[0]).orderBy("batch_id").select("messages", "rejects", "posts").collect()]
    assert log == [(4, 2, 2), (3, 3, 0), (2, 0, 1)]
    rejects = sorted((r.batch_id, r.value) for r in jobs.read_rejects(spark, tables[0]).collect())
    assert rejects == sorted([(0, "{broken"), (0, json.dumps(keyless)), (1, "{broken"), (1, ""), (1, "not json")])


def test_compaction_reads_new_batches_and_rewrites_their_days_only(spark, tmp_dir):
    from pulse.sources import files
    inbox, table, t0 = os.path.join(tmp_dir, "inbox"), os.path.join(tmp_dir, "table"), 1_704_067_200_000
    write = jobs.make_inbox_writer(inbox, query_id="q")
    days = spark.createDataFrame([_post(str(d), t0 + d * DAY_MS) for d in range(6)], RAW_POST)
    write(jobs.live_posts(days), 0)
    write(jobs.live_posts(days.limit(1)), 1)
    assert jobs.store_inbox(spark, inbox, table) == 2 and jobs.store_inbox(spark, inbox, table) == 0
    before = set(files.data_files(spark, table))
    write(jobs.live_posts(spark.createDataFrame([_post("new", t0 + 2 * DAY_MS + 5)], RAW_POST)), 2)
    unfinished = jobs.live_posts(spark.createDataFrame([_post("half", t0)], RAW_POST))
    write(unfinished, 3)
    files.delete(spark, f"{jobs.beside(inbox, 'batches')}/query_id=q/batch_id=3")
    assert jobs.store_inbox(spark, inbox, table) == 1
    gone = before - set(files.data_files(spark, table))
    assert gone and all("day=2024-01-03" in path for path, *_ in gone)
    assert sorted(r.tweet_id for r in store.read_post_table(spark, table).collect()) == ["0", "1", "2", "3", "4", "5", "new"]
    write(unfinished, 3)
    assert jobs.store_inbox(spark, inbox, table) == 1 and store.read_post_table(spark, table).count() == 8


def test_hourly_counts_over_many_batches_and_a_restart_equal_the_batch_answer(spark, tmp_dir):
    from pulse.session import _REQUIRED_CONF
    provider = "spark.sql.streaming.stateStore.providerClass"
    assert spark.conf.get(provider) == _REQUIRED_CONF[provider]
    src, t0, base = os.path.join(tmp_dir, "in"), 1_704_067_200_000, time.time()
    out, checkpoint = os.path.join(tmp_dir, "out"), os.path.join(tmp_dir, "ck")

    def run():
        posts, _ = jobs.parse_stream(jobs.file_messages(spark, src, max_files_per_trigger=1))
        live = jobs.with_event_time(posts).dropDuplicatesWithinWatermark(["tweet_id"])
        q = jobs.start_append(jobs.hourly_hashtag_counts(live), out, checkpoint)
        q.awaitTermination()
        return q.lastProgress

    sent = []
    for i in range(12):
        rows = [_post(f"{i}-{k}", t0 + i * HOUR // 2 + k * 60_000, tags=("#a", f"#t{k % 3}")) for k in range(20)]
        sent += rows
        _write_lines(src, f"f{i:02}.json", rows + rows[:3], base + i)
        if i == 5:
            run()
    progress = run()
    # the state is the durable provider's, and is small: closed hours have left it
    assert any("rocksdb" in name.lower() for op in progress.stateOperators for name in op.customMetrics)
    cutoff = max(r["timestamp"] for r in sent) - 10 * 60_000
    posts = spark.createDataFrame(sent, RAW_POST).filter(F.floor(F.col("timestamp") / HOUR) * HOUR + HOUR <= cutoff)
    want = agg.exploded_tags(posts, "timestamp").groupBy(F.date_format(F.timestamp_millis("timestamp"), "yyyyMMddHH").alias("bucket"), "hashtag").agg(
        F.count(F.lit(1)).alias("cnt"))
    got = spark.read.parquet(out)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0 and want.count() > 0
