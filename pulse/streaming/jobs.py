"""Structured Streaming jobs.

The live job of the reference (10-second micro-batches that score posts and
store hashtag counts, label counts and viral posts) becomes:

    source -> parse / quarantine -> enrich (row-local)
           -> foreachBatch: one persisted batch, several idempotent writes

and the hourly counts become an event-time tumbling window with a watermark,
so state stays bounded and late rows are dropped there, and only there, in append
mode: the live job stores, counts and republishes a post however late it comes.  Nothing is
collected to the driver; every sink is keyed by the query's id and ``batch_id``
(overwrite of that partition), so a retried batch rewrites, never duplicates, and
another query, or one started anew, never replaces what is there.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulse.functions.keys import HOUR_BUCKET_FORMAT, day_partition, hour_bucket
from pulse.plans import store
from pulse.operators.aggregates import exploded_tags
from pulse.operators.sentiment import score_sentiment
from pulse.plans.serving import VIRAL_LIKES_ABOVE
from pulse.schemas import ENRICHED_POST, RAW_POST, STORED_POST
from pulse.session import scratch_path
from pulse.sources import files, fixture
from pulse.sources.posts import decode, parse_posts, to_payload

# Fixed values of the live job.
TRIGGER_INTERVAL = "10 seconds"
WATERMARK_DELAY = "10 minutes"
HOURLY_WINDOW = "1 hour"
LIVE_WINDOW_MS, LIVE_BUCKET_FORMAT = 10_000, "yyyyMMddHHmmss"
RAW_TOPIC = "raw-tweets"
ENRICHED_TOPIC = "processed-tweets"
ALERT_TOPIC = "trending-alerts"


# ---- sources ------------------------------------------------------------------------------

def kafka_messages(spark: SparkSession, bootstrap: str, topic: str = RAW_TOPIC,
                   starting_offsets: str = "latest") -> DataFrame:
    """Raw messages from a topic (needs the Spark Kafka connector on the classpath)."""
    return (spark.readStream.format("kafka")
            .option("kafka.bootstrap.servers", bootstrap)
            .option("subscribe", topic)
            .option("startingOffsets", starting_offsets)
            .option("failOnDataLoss", "false")
            .load())


def file_messages(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """JSON lines from a folder, one message per line, as a ``value`` column."""
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return reader.load(path)


def event_posts_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The posts view as a stream over the ``events`` table files."""
    sf_dir = sf_dir.rstrip("/")
    schema = fixture.read_table(spark, sf_dir, "events").schema
    events = (spark.readStream.schema(schema).option("basePath", sf_dir)
              .parquet(f"{sf_dir}/events*.parquet"))
    return fixture.derive_posts(events, fixture.read_table(spark, sf_dir, "nation"))


# ---- transformations ----------------------------------------------------------------------------

def with_event_time(posts: DataFrame, delay: str = WATERMARK_DELAY) -> DataFrame:
    return (posts.withColumn("event_time", F.timestamp_millis("timestamp"))
                 .withWatermark("event_time", delay))


def live_posts(posts: DataFrame, lexicon=None) -> DataFrame:
    """Scored posts.  Redelivered ones are dropped by the writer, which looks at what it has written."""
    return score_sentiment(posts, "text", lexicon=lexicon)


def parse_stream(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Kafka/file messages -> (posts, rejects)."""
    return parse_posts(messages, "value", RAW_POST)


def hourly_hashtag_counts(posts: DataFrame) -> DataFrame:
    """Tag uses per event-time hour; emitted once the watermark passes the hour."""
    tags = exploded_tags(posts, "event_time")
    return (tags.groupBy(F.window("event_time", HOURLY_WINDOW).alias("w"), "hashtag")
                .agg(F.count(F.lit(1)).alias("cnt"))
                .select(F.date_format("w.start", HOUR_BUCKET_FORMAT).alias("bucket"), "hashtag", "cnt"))


def viral_alerts(posts: DataFrame) -> DataFrame:
    """One alert per viral post (strictly more likes than the threshold)."""
    return (posts.filter(F.col("likes") > VIRAL_LIKES_ABOVE)
                 .select("tweet_id", "user_id", "likes", "timestamp"))


# ---- the per-batch multi-sink --------------------------------------------------------------------

def batch_metric_rows(batch: DataFrame) -> DataFrame:
    """The three results of the live job per 10-second window of event time, as long metric rows.

    Viral rows also carry the text and the user of the post.
    """
    start = F.floor(F.col("timestamp") / LIVE_WINDOW_MS) * LIVE_WINDOW_MS
    bucket = F.date_format(F.timestamp_millis(start), LIVE_BUCKET_FORMAT).alias("bucket")
    none = F.lit(None).cast("string")
    tags = exploded_tags(batch, "timestamp").groupBy(bucket, F.col("hashtag").alias("key")).agg(F.count("*").alias("value"))
    labels = batch.groupBy(bucket, F.col("sentiment").alias("key")).agg(F.count("*").alias("value"))
    viral = batch.filter(F.col("likes") > VIRAL_LIKES_ABOVE)
    rows = (tags.select(F.lit("hashtag").alias("metric"), "bucket", "key", "value", none.alias("text"), none.alias("user_id"))
            .union(labels.select(F.lit("sentiment"), "bucket", "key", "value", none, none))
            .union(viral.select(F.lit("viral"), bucket, "tweet_id", F.col("likes").cast("long"),
                                F.coalesce("text", F.lit("")), "user_id")))
    return rows.withColumn("day", F.concat_ws("-", *[F.substring("bucket", at, n) for at, n in ((1, 4), (5, 2), (7, 2))]))


LIVE_ROW = ("metric string, bucket string, key string, value long, text string, user_id string, "
            "day string, query_id string, batch_id long")
KEY_ROW = "tweet_id string, day string, slot string, query_id string, batch_id long"
REJECT_ROW = "value string, query_id string, batch_id long"
BATCH_ROW = "messages long, rejects long, posts long, query_id string, batch_id long"
SLOTS_APART = 4                # hours of a day up to which their folders are read one by one
KEYS_PER_FILE = 1_000_000
SLOT_HOURS = 1                 # hours of event time in one folder of the key index: a live batch touches one or two; divides 24
LIVE_FILES = 4                 # files, and batches, of a registered run over messages


def beside(path: str, name: str) -> str:
    """The folder of a table that belongs to the table at ``path``."""
    return f"{path.rstrip('/')}-{name}"


def read_live_metrics(spark: SparkSession, path: str, since_day: str | None = None) -> DataFrame:
    """The live metric rows of all finished batches, one per (metric, bucket, key): counts of one window add up.

    A batch that its query never finished is left out: its posts come again.  ``since_day`` prunes days.
    """
    rows = spark.read.schema(LIVE_ROW).parquet(path)
    if since_day is not None:
        rows = rows.filter(F.col("day") >= since_day)
    rows = rows.join(read_batches(spark, path).select("query_id", "batch_id"), ["query_id", "batch_id"], "left_semi")
    value = F.when(F.col("metric") == "viral", F.max("value")).otherwise(F.sum("value"))
    return rows.groupBy("metric", "bucket", "key").agg(value.alias("value"), F.max("text").alias("text"), F.max("user_id").alias("user_id"))


def read_batches(spark: SparkSession, metrics_path: str) -> DataFrame:
    """The log of finished batches: messages read, of them rejected, posts that were new."""
    return spark.read.schema(BATCH_ROW).parquet(beside(metrics_path, "batches"))


def read_rejects(spark: SparkSession, metrics_path: str) -> DataFrame:
    """The dead letters of the live job: messages that are no posts, as they came."""
    path = beside(metrics_path, "rejects")
    return spark.read.schema(REJECT_ROW).parquet(path) if files.exists(spark, path) else spark.createDataFrame([], REJECT_ROW)


def event_slot(hours: int = SLOT_HOURS, ts_millis="timestamp"):
    """The hours of event time under which a post's key is kept, as their first one."""
    width = hours * 3_600_000
    return hour_bucket(F.floor(F.col(ts_millis) / width) * width)


def _day(slot: str) -> str:
    return f"{slot[:4]}-{slot[4:6]}-{slot[6:8]}"


def unfinished_batches(spark: SparkSession, log_path: str) -> list[tuple[str, int]]:
    """Batches that were begun and are not in the log: at most one a query, as a query works on one at a time."""
    begun = beside(log_path, "begun")
    last = [(q, max(map(int, files.values(spark, f"{begun}/query_id={q}", "batch_id")), default=-1)) for q in files.values(spark, begun, "query_id")]
    return [(q, b) for q, b in last if b >= 0 and not files.exists(spark, f"{log_path}/query_id={q}/batch_id={b}")]


def _begin(spark: SparkSession, log_path: str, own: str, batch_id: int) -> None:
    """Mark a batch as begun; the mark of the query's batch before is finished and goes."""
    mine = f"{beside(log_path, 'begun')}/query_id={own}"
    files.make_folder(spark, f"{mine}/batch_id={batch_id}")
    for b in files.values(spark, mine, "batch_id"):
        if int(b) < batch_id:
            files.delete(spark, f"{mine}/batch_id={b}")


def written_keys(spark: SparkSession, keys_path: str, log_path: str, slots: list[str], own: str, batch_id: int) -> DataFrame | None:
    """Keys that earlier batches of any query have written for some slots of event time.

    Only these slots' folders are listed and read (the day's folder, where a batch spreads over most of a
    day), so a live batch costs the same however many there were before.  Unfinished batches of other queries are left out, and
    this query's own from ``batch_id`` on: a batch done again is held against those before it.
    """
    by_day: dict[str, list[str]] = {}
    for slot in slots:
        by_day.setdefault(f"{keys_path}/day={_day(slot)}", []).append(slot)
    folders = [f for day, inside in by_day.items() for f in ([day] if len(inside) > SLOTS_APART else [f"{day}/slot={x}" for x in inside])]
    folders = [f for f in folders if files.exists(spark, f)]
    if not folders:
        return None
    keys = files.read_partitions(spark, keys_path, folders, KEY_ROW).filter(F.col("slot").isin(slots))
    keys = keys.filter(~((F.col("query_id") == own) & (F.col("batch_id") >= batch_id)))
    for q, b in unfinished_batches(spark, log_path):
        if q != own:
            keys = keys.filter(~((F.col("query_id") == q) & (F.col("batch_id") == b)))
    return keys


def _put(df: DataFrame, path: str, own: str, batch_id: int, by: tuple[str, ...] = (), rebalance: bool = True) -> None:
    """Replace this batch's partition of a table: files of about the advisory size, whatever the batch's partitions were."""
    ((df.hint("rebalance", *by) if rebalance else df).withColumn("query_id", F.lit(own)).withColumn("batch_id", F.lit(batch_id))
       .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by, "query_id", "batch_id").parquet(path))


def _log(spark: SparkSession, path: str, own: str, batch_id: int, messages: int, rejects: int, posts: int) -> None:
    """The batch's row in a log of finished batches, its last write."""
    _put(spark.createDataFrame([(messages, rejects, posts)], "messages long, rejects long, posts long"), path, own, batch_id)


def _clear(spark: SparkSession, own: str, batch_id: int, tables: list[str]) -> None:
    """Remove what an earlier try of a batch has left, its log row (the first of ``tables``) first; nothing, if there was none."""
    at = f"query_id={own}/batch_id={batch_id}"
    if any(files.exists(spark, f"{t}/{at}") for t in tables[:3]):
        for t in tables:
            files.delete(spark, f"{t}/{at}")


def _query_id(spark: SparkSession) -> str:
    return spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "direct"


def make_batch_writer(metrics_path: str, payload_path: str, kafka_bootstrap: str | None = None, query_id: str | None = None,
                      slot_hours: int = SLOT_HOURS):
    """``foreachBatch`` function for raw messages (a ``value`` column) or posts: metric rows, enriched payload, rejects, keys.

    The batch is decoded and scored once, persisted, and read by every write; each write replaces
    the (query id, batch id) partition, so a replayed batch is idempotent.  The query's id
    is kept in its checkpoint: a query started on a new checkpoint has another.

    Posts that any finished batch of any query has written are redeliveries and left out, however late
    they come and whatever checkpoint they come through.  Keys lie under their slot of event time (a
    post sent again has its time still), so a batch looks at its own slots only (:func:`written_keys`).
    The last write is the batch's row in the log, with the numbers of messages, rejects and new posts: without
    it the batch's rows and keys do not count.  One query writes at a time, and all that share
    tables use one ``slot_hours`` (wider for batches that span many days, as when history is loaded).
    """
    keys_path, log_path, rejects_path = beside(payload_path, "keys"), beside(metrics_path, "batches"), beside(metrics_path, "rejects")

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        own = query_id or _query_id(spark)
        if "value" in batch.columns:
            decoded = decode(batch)
        else:
            decoded = batch.select("*", F.lit(None).cast("string").alias("_raw"), F.lit(True).alias("_valid"))
        decoded = decoded.persist()
        fresh = None
        try:
            # one pass over the batch: its numbers, and its slots of event time (24 a day)
            came = decoded.groupBy("_valid", event_slot(slot_hours).alias("slot")).agg(F.count(F.lit(1)).alias("n")).collect()
            messages, rejects = sum(r.n for r in came), sum(r.n for r in came if not r["_valid"])
            slots = sorted(r.slot for r in came if r["_valid"])
            if not messages:                     # an empty micro-batch writes nothing
                return
            _clear(spark, own, batch_id, [log_path, rejects_path, payload_path, *(f"{keys_path}/day={_day(x)}/slot={x}" for x in slots),
                                          *sorted({f"{metrics_path}/day={_day(x)}" for x in slots})])
            _begin(spark, log_path, own, batch_id)
            if rejects:
                _put(decoded.filter(~F.col("_valid")).select(F.col("_raw").alias("value")), rejects_path, own, batch_id)
            posts = decoded.filter("_valid").drop("_raw", "_valid").dropDuplicates(["tweet_id"])
            earlier = written_keys(spark, keys_path, log_path, slots, own, batch_id)
            if earlier is not None:
                posts = posts.join(earlier.select("tweet_id"), "tweet_id", "left_anti")
            fresh = (posts if "sentiment" in posts.columns else live_posts(posts)).persist()
            n_posts = fresh.count() if slots else 0
            if n_posts:
                _put(to_payload(fresh), payload_path, own, batch_id)
                # A topic has no overwrite: a replayed batch republishes (at-least-once), and
                # consumers key their tables by post, so a repeat changes nothing.
                if kafka_bootstrap:
                    (to_payload(fresh).write.format("kafka").option("kafka.bootstrap.servers", kafka_bootstrap)
                        .option("topic", ENRICHED_TOPIC).save())
                _put(batch_metric_rows(fresh), metrics_path, own, batch_id, ("day",))
                # a file per slot, more for one that holds much of a large batch
                salt = F.pmod(F.xxhash64("tweet_id"), F.lit(1 + max(r.n for r in came) // KEYS_PER_FILE))
                keys = fresh.select("tweet_id", day_partition().alias("day"), event_slot(slot_hours).alias("slot"))
                _put(keys.repartition(min(len(slots), spark.sparkContext.defaultParallelism), "slot", salt), keys_path, own, batch_id,
                     ("day", "slot"), False)
            _log(spark, log_path, own, batch_id, messages, rejects, n_posts)
        finally:
            decoded.unpersist()
            if fresh is not None:
                fresh.unpersist()
    return write


def start_live_job(stream: DataFrame, metrics_path: str, checkpoint: str,
                   payload_path: str, kafka_bootstrap: str | None = None,
                   available_now: bool = False, slot_hours: int = SLOT_HOURS):
    """Start the live job on raw messages or posts; 10-second trigger, or ``availableNow`` for a bounded run."""
    writer = (stream.writeStream
              .foreachBatch(make_batch_writer(metrics_path, payload_path, kafka_bootstrap, slot_hours=slot_hours))
              .option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else \
        writer.trigger(processingTime=TRIGGER_INTERVAL)
    return writer.start()


def run_from_topics(spark: SparkSession, bootstrap: str, metrics_path: str, payload_path: str, inbox: str, checkpoint: str):
    """The deployed wiring: raw topic -> live job -> enriched topic -> post-table inbox (two queries)."""
    live = start_live_job(kafka_messages(spark, bootstrap), metrics_path, f"{checkpoint}/live", payload_path, kafka_bootstrap=bootstrap)
    return live, start_post_table_writer(kafka_messages(spark, bootstrap, ENRICHED_TOPIC), inbox, f"{checkpoint}/posts")


def make_inbox_writer(inbox: str, query_id: str | None = None):
    """``foreachBatch`` function of the second consumer: post-table rows by day, rejects beside them, a log of finished batches."""
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        own = query_id or _query_id(spark)
        decoded = decode(batch, schema=ENRICHED_POST) if "value" in batch.columns else \
            batch.select("*", F.lit(None).cast("string").alias("_raw"), F.lit(True).alias("_valid"))
        decoded = decoded.persist()
        try:
            came = dict(decoded.groupBy("_valid").agg(F.count(F.lit(1))).collect())
            good, rejects = came.get(True, 0), came.get(False, 0)
            if good:
                _put(store.stored_posts(decoded.filter("_valid")), inbox, own, batch_id)
            if rejects:
                _put(decoded.filter(~F.col("_valid")).select(F.col("_raw").alias("value")), beside(inbox, "rejects"), own, batch_id)
            if good + rejects:
                _log(spark, beside(inbox, "batches"), own, batch_id, good + rejects, rejects, good)
        finally:
            decoded.unpersist()
    return write


def start_post_table_writer(enriched: DataFrame, inbox: str, checkpoint: str,
                            available_now: bool = False):
    """Second consumer of the enriched stream (messages or posts): batches of post-table rows in the table's inbox.

    Its own checkpoint, so it progresses independently of the live job.  A batch replaces its own folder
    and is logged when it is complete; :func:`store_inbox` puts finished batches into the table.
    """
    w = (enriched.writeStream.foreachBatch(make_inbox_writer(inbox)).option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=TRIGGER_INTERVAL)
    return w.start()


def store_inbox(spark: SparkSession, inbox: str, table: str) -> int:
    """Compaction: upsert the inbox's finished batches into the post table by key; returns how many.

    Only what has come since the last run is read, and only the days of those posts are rewritten: a batch leaves the
    inbox when it is in the table.  A run that breaks off before that is done again, which changes nothing.
    """
    finished = [f"query_id={q}/batch_id={b}" for q in files.values(spark, inbox, "query_id")
                for b in files.values(spark, f"{inbox}/query_id={q}", "batch_id")
                if files.exists(spark, f"{beside(inbox, 'batches')}/query_id={q}/batch_id={b}")]
    if finished:
        rows = files.read_partitions(spark, inbox, [f"{inbox}/{f}" for f in finished], STORED_POST)
        rows = rows.select(*STORED_POST.names).dropDuplicates(["row_key", "tweet_id"])
        if files.exists(spark, table):
            store.upsert_post_table(spark, rows, table)
        else:
            store.write_post_table(rows, table)
        for f in finished:
            files.delete(spark, f"{inbox}/{f}")
    return len(finished)


def start_alerts(posts: DataFrame, checkpoint: str, kafka_bootstrap: str | None = None,
                 path: str | None = None, available_now: bool = False):
    """Viral alerts to their topic (Kafka) or to parquet files."""
    alerts = viral_alerts(posts)
    if kafka_bootstrap:
        w = (to_payload(alerts, ["tweet_id", "user_id", "likes", "timestamp"]).writeStream
             .format("kafka").option("kafka.bootstrap.servers", kafka_bootstrap)
             .option("topic", ALERT_TOPIC))
    else:
        w = alerts.writeStream.format("parquet").option("path", path)
    w = w.outputMode("append").option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=TRIGGER_INTERVAL)
    return w.start()


def start_append(df: DataFrame, path: str, checkpoint: str, available_now: bool = True):
    """Append a stream to parquet files (exactly-once file sink)."""
    w = (df.writeStream.outputMode("append").format("parquet")
         .option("path", path).option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=TRIGGER_INTERVAL)
    return w.start()


# ---- registered (bounded) runs over the driver tables ----------------------------------------------

def _run_append(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    base = scratch_path(spark, name)
    q = start_append(df, os.path.join(base, "out"), os.path.join(base, "checkpoint"))
    q.awaitTermination()
    return spark.read.parquet(os.path.join(base, "out"))


def stream_hourly_hashtags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly tag counts from the event stream, finished windows only."""
    posts = with_event_time(event_posts_stream(spark, sf_dir))
    return _run_append(spark, hourly_hashtag_counts(posts), "stream_hourly_hashtags")


def write_messages(spark: SparkSession, sf_dir: str, folder: str, n_files: int) -> None:
    """The posts view as JSON lines in ``n_files`` files by time: a message per post, and beside those of posts without text a malformed one."""
    posts = fixture.tweets(spark, sf_dir)
    good = F.to_json(F.struct(*[F.col(f.name) for f in RAW_POST.fields]))
    broken = F.when(F.col("text").isNull(), F.concat(F.lit("{broken "), F.col("tweet_id")))
    messages = posts.select("timestamp", F.explode(F.array_compact(F.array(good, broken))).alias("value"))
    messages.repartitionByRange(n_files, "timestamp").select("value").write.mode("overwrite").text(folder)


def _run_live(spark: SparkSession, sf_dir: str, again: bool = True) -> tuple[str, str, str]:
    """A bounded run of the live job over messages, in several batches; the paths of its metric rows and payload, and a folder beside them.

    ``again``: then the job is started anew on another checkpoint, to which every message comes a second time.
    """
    base = scratch_path(spark, "stream_live")
    inbox, metrics, payload = (os.path.join(base, x) for x in ("messages", "metrics", "payload"))
    write_messages(spark, sf_dir, inbox, LIVE_FILES)
    start_live_job(file_messages(spark, inbox, max_files_per_trigger=1), metrics, os.path.join(base, "checkpoint"), payload,
                   available_now=True, slot_hours=24).awaitTermination()
    if again:
        start_live_job(file_messages(spark, inbox), metrics, os.path.join(base, "checkpoint-2"), payload, available_now=True,
                       slot_hours=24).awaitTermination()
    return metrics, payload, base


def stream_sentiment_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label counts summed over the live job's metric rows."""
    rows = read_live_metrics(spark, _run_live(spark, sf_dir)[0])
    return (rows.filter(F.col("metric") == "sentiment").groupBy(F.col("key").alias("sentiment"))
                .agg(F.sum("value").cast("long").alias("cnt")))


def stream_metric_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All three families of the live job's metric rows."""
    return read_live_metrics(spark, _run_live(spark, sf_dir)[0])


def stream_post_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live job -> enriched payload -> second consumer -> inbox -> post table, read back."""
    _, payload, base = _run_live(spark, sf_dir)
    messages = spark.readStream.schema("key string, value string, query_id string, batch_id long").parquet(payload)
    inbox, table = os.path.join(base, "inbox"), os.path.join(base, "posts")
    start_post_table_writer(messages.select("value"), inbox, os.path.join(base, "checkpoint-posts"), available_now=True).awaitTermination()
    store_inbox(spark, inbox, table)
    return store.read_post_table(spark, table)


def stream_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Viral alerts from the de-duplicated event stream."""
    posts = with_event_time(event_posts_stream(spark, sf_dir)).dropDuplicatesWithinWatermark(["tweet_id"])
    return _run_append(spark, viral_alerts(posts), "stream_alerts")


def stream_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live job's dead letters."""
    rejects = read_rejects(spark, _run_live(spark, sf_dir, again=False)[0])
    return rejects.groupBy("value").agg(F.count(F.lit(1)).alias("cnt"))


def stream_json_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ingest path end to end: JSON messages -> parse -> hourly counts; malformed messages go to a folder of their own.

    The posts view is written once as JSON lines, then read back by file streams: one appends the rejects,
    one watermarks, de-duplicates and counts valid posts per event-time hour.
    """
    base = scratch_path(spark, "stream_json")
    inbox = os.path.join(base, "in")
    write_messages(spark, sf_dir, inbox, LIVE_FILES)
    parsed, rejects = parse_stream(file_messages(spark, inbox))
    dead = start_append(rejects, os.path.join(base, "rejects"), os.path.join(base, "checkpoint-rejects"))
    live = with_event_time(parsed).dropDuplicatesWithinWatermark(["tweet_id"])
    counts = _run_append(spark, hourly_hashtag_counts(live), "stream_json_counts")
    dead.awaitTermination()
    return counts
