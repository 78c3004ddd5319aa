"""The stored tables as parquet datasets: posts, metric rows and users.

Posts are partitioned by UTC ``day`` and sorted by ``row_key`` inside each
file, so a time window prunes partitions and a user lookup skips row groups by
min/max statistics.  Metric rows are long (metric, bucket, key, value) rows,
partitioned by (metric, bucket) and written with dynamic partition overwrite,
which makes a rerun of the same hour idempotent.  The users table is replaced
as a whole snapshot (old full-outer-join new), written to a new path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulse.functions.keys import REVERSED_TS_BASE, day_partition, hour_bucket, parse_row_key, reversed_ts, row_key, salt
from pulse.functions.tags import clean_tags
from pulse.operators.aggregates import TOP_HASHTAGS, exploded_tags
from pulse.schemas import METRIC_ROW, POST_FAMILIES, STORED_POST
from pulse.session import scratch_path
from pulse.sources import files

# Time to live of stored cells (seconds), per the table definitions.
ANALYSIS_TTL_S = 7_776_000     # 90 days, post sentiment cells only
METRICS_TTL_S = 172_800        # 2 days, metric rows

HOUR_MS = 3_600_000
DAY_MS = 86_400_000


# ---- posts ----------------------------------------------------------------------

def stored_posts(enriched: DataFrame) -> DataFrame:
    """Project enriched posts to the post-table layout (key build, O6-O8)."""
    return enriched.select(
        row_key("user_id", "timestamp").alias("row_key"),
        salt("user_id").alias("salt"),
        F.col("user_id"),
        reversed_ts("timestamp").alias("rev_ts"),
        *[F.col(f.name) for f in STORED_POST.fields
          if f.name not in ("row_key", "salt", "user_id", "rev_ts", "day")],
        day_partition("timestamp").alias("day"))


def write_post_table(posts: DataFrame, path: str, bloom_filter: bool = True) -> None:
    """Rewrite the days present in ``posts`` (dynamic partition overwrite).

    Range partitioning on (day, row_key) gives each writer a contiguous key
    range: a hot day or a hot user (one salt, many reversed timestamps) is cut
    into several tasks by sampled bounds, and every file covers a disjoint
    key range, so key and user lookups skip files by min/max statistics.
    """
    writer = (posts.repartitionByRange("day", "row_key").sortWithinPartitions("day", "row_key")
              .write.mode("overwrite").option("partitionOverwriteMode", "dynamic"))
    if bloom_filter:
        writer = writer.option("parquet.bloom.filter.enabled#user_id", "true")
    writer.partitionBy("day").parquet(path)


def upsert_post_table(spark: SparkSession, posts: DataFrame, path: str) -> None:
    """Write ``posts`` by key into the table: a row replaces the one with its key and id, all others of the day stay.

    Only the days that ``posts`` touches are read and rewritten.  The new days are finished in a
    folder of their own first, since a table can't be read while it is replaced.  Run over a
    streamed table without new rows for some days it also compacts those days' files.
    """
    days = posts.select("day").distinct()
    old = read_post_table(spark, path).join(F.broadcast(days), "day", "left_semi")   # one row per day
    kept = old.join(posts.select("row_key", "tweet_id"), ["row_key", "tweet_id"], "left_anti")
    staged = scratch_path(spark, "post-days")
    write_post_table(kept.unionByName(posts.select(*kept.columns)), staged, bloom_filter=False)
    write_post_table(read_post_table(spark, staged), path)


def hashtag_rows(posts: DataFrame) -> DataFrame:
    """The hashtags table: uses, likes and first use of every tag, keyed by tag and reversed first use."""
    tags = posts.select("likes", "timestamp", F.explode(clean_tags("hashtags")).alias("hashtag"))
    rows = tags.groupBy("hashtag").agg(F.count("*").alias("total"), F.coalesce(F.sum("likes"), F.lit(0)).cast("long").alias("likes_sum"),
                                       F.min("timestamp").alias("first_seen"))
    key = F.concat_ws("_", "hashtag", F.lpad(reversed_ts("first_seen").cast("string"), 13, "0"))
    return rows.withColumn("row_key", key)


def _day_literal(ms: int):
    return F.date_format(F.timestamp_millis(F.lit(int(ms))), "yyyy-MM-dd")


def read_post_table(spark: SparkSession, path: str, since_ms: int | None = None) -> DataFrame:
    df = spark.read.schema(STORED_POST).parquet(path)
    return posts_since(df, since_ms) if since_ms is not None else df


def newest_days(spark: SparkSession, path: str, n: int) -> DataFrame:
    """Posts of the newest ``day`` partitions that hold ``n`` posts together; older days are neither listed nor read.

    Days are walked from the newest; a day's posts are counted in its files' footers.
    """
    folders, found = [], 0
    for day in sorted(files.values(spark, path, "day"), reverse=True):
        if found >= n:
            break
        folders.append(f"{path}/day={day}")
        found += files.read_partitions(spark, path, folders[-1:], STORED_POST).count()
    return files.read_partitions(spark, path, folders, STORED_POST)


def newest_post_ms(spark: SparkSession, path: str) -> int | None:
    """Epoch millis of the newest post, from the ``timestamp`` column of the newest day."""
    return newest_days(spark, path, 1).agg(F.max("timestamp")).first()[0]


def posts_since(posts: DataFrame, since_ms: int) -> DataFrame:
    """Rows with ``timestamp >= since_ms``; also prunes ``day`` partitions when present."""
    out = posts.filter(F.col("timestamp") >= F.lit(int(since_ms)))
    if "day" in posts.columns:
        out = out.filter(F.col("day") >= _day_literal(since_ms))
    return out


def posts_in_window(posts: DataFrame, as_of_ms: int, lookback_ms: int = HOUR_MS) -> DataFrame:
    """The batch job's working set: posts at most ``lookback`` older than ``as_of`` (inclusive)."""
    return posts_since(posts, as_of_ms - lookback_ms)


def posts_in_hours(posts: DataFrame, as_of_ms: int, lookback_ms: int = HOUR_MS) -> DataFrame:
    """All posts of the hours that a run recomputes: from the start of the hour of ``as_of - lookback`` to ``as_of``."""
    since = (as_of_ms - lookback_ms) // HOUR_MS * HOUR_MS
    return posts_since(posts, since).filter(F.col("timestamp") <= F.lit(int(as_of_ms)))


def prefix_scan(df: DataFrame, prefix: str, key_col: str = "row_key") -> DataFrame:
    """Rows whose key starts with ``prefix`` (pushed to parquet as StringStartsWith)."""
    return df.filter(F.col(key_col).startswith(prefix))


def user_posts(posts: DataFrame, user_id: str) -> DataFrame:
    """One user's posts, newest first.  The salt predicate is a folded literal."""
    return (posts.filter((F.col("salt") == salt(F.lit(user_id))) & (F.col("user_id") == user_id))
                 .orderBy("rev_ts", "row_key"))


def point_get(df: DataFrame, key: str, key_col: str = "row_key") -> DataFrame:
    """The row with ``key`` (zero rows when missing); an equality pushed to the scan."""
    return df.filter(F.col(key_col) == F.lit(key))


def bounded_scan(df: DataFrame, n: int, key_col: str = "row_key") -> DataFrame:
    """The first ``n`` rows in key order (TakeOrderedAndProject, exact)."""
    return df.orderBy(key_col).limit(n)


def delete_keys(df: DataFrame, keys: DataFrame, key_col: str = "row_key") -> DataFrame:
    """Remove the rows whose key is in ``keys`` (left anti join)."""
    return df.join(keys.select(key_col), key_col, "left_anti")


def _rewrite_days(spark: SparkSession, path: str, days: list[str], change) -> None:
    """Rewrite some days of the post table as ``change`` makes them; a day without rows left goes, other days keep their files."""
    if not days:
        return
    old = files.read_partitions(spark, path, [f"{path}/day={d}" for d in days], STORED_POST)
    staged = scratch_path(spark, "post-days")
    write_post_table(change(old).select(*STORED_POST.names), staged, bloom_filter=False)
    left = set(files.values(spark, staged, "day"))
    if left:
        write_post_table(read_post_table(spark, staged), path)
    for d in set(days) - left:
        files.delete(spark, f"{path}/day={d}")
    files.delete(spark, staged)


def delete_from_table(spark: SparkSession, path: str, keys: DataFrame) -> list[str]:
    """Remove the posts with these row keys from the stored table; returns the days rewritten.

    A key holds its time, so it names the day that it can lie in; of those days the key column is
    read, and only the ones that hold a doomed key are rewritten.
    """
    doomed = keys.select("row_key").distinct()
    named = doomed.select(day_partition(F.lit(REVERSED_TS_BASE) - parse_row_key("row_key")["rev_ts"]).alias("day")).distinct()
    there = set(files.values(spark, path, "day"))
    folders = [f"{path}/day={r.day}" for r in named.collect() if r.day in there]            # one row per day
    held = files.read_partitions(spark, path, folders, STORED_POST).join(doomed, "row_key", "left_semi").select("day").distinct()
    days = sorted(r.day for r in held.collect())
    _rewrite_days(spark, path, days, lambda old: delete_keys(old, doomed))
    return days


def expire_posts(spark: SparkSession, path: str, as_of_ms: int, ttl_s: int = ANALYSIS_TTL_S, family: str = "analysis") -> list[str]:
    """Empty the cells of ``family`` older than the time to live in the stored table; returns the days rewritten.

    Only days that can hold expired cells are looked at, and only those that still do are rewritten.
    """
    columns = POST_FAMILIES[family]
    oldest = as_of_ms - ttl_s * 1000
    last = spark.range(1).select(_day_literal(oldest)).first()[0]
    folders = [f"{path}/day={d}" for d in files.values(spark, path, "day") if d <= last]
    held = files.read_partitions(spark, path, folders, STORED_POST).filter(
        (F.col("timestamp") < F.lit(int(oldest))) & F.coalesce(*[F.col(c).cast("string") for c in columns]).isNotNull())
    days = sorted(r.day for r in held.select("day").distinct().collect())
    _rewrite_days(spark, path, days, lambda old: apply_post_retention(old, as_of_ms, ttl_s, family))
    return days


def expire_metrics(spark: SparkSession, path: str, as_of_ms: int, ttl_s: int = METRICS_TTL_S) -> list[str]:
    """Remove the expired hours of the metric table: their partitions go, nothing is read; returns them."""
    gone = [b for b in files.values(spark, path, "bucket") if b < metric_retention_cutoff(as_of_ms, ttl_s)]
    for b in gone:
        files.delete(spark, f"{path}/bucket={b}")
    return gone


def apply_post_retention(posts: DataFrame, as_of_ms: int, ttl_s: int = ANALYSIS_TTL_S,
                         family: str = "analysis") -> DataFrame:
    """Cells of ``family`` older than the TTL read back as missing; the row stays."""
    expired = (F.lit(int(as_of_ms)) - F.col("timestamp")) > F.lit(ttl_s * 1000)
    out = posts
    for c in POST_FAMILIES[family]:
        if c in posts.columns:
            out = out.withColumn(c, F.when(expired, F.lit(None)).otherwise(F.col(c)))
    return out


# ---- metric rows ------------------------------------------------------------------

def metric_rows(posts: DataFrame, top_k: int = TOP_HASHTAGS) -> DataFrame:
    """All hourly metrics of ``posts`` as long rows (metric, bucket, key, value).

    * ``hashtag``   : uses of every tag in the hour (history source)
    * ``trending``  : the hour's top ``top_k`` tags
    * ``sentiment`` : posts per label in the hour
    * ``geo``       : posts per country in the hour
    * ``geo_{country}`` : posts per label for one country in the hour

    Each post becomes one row per tag (or one row without a tag), and a GROUPING
    SETS aggregate counts tag uses per (hour, tag) and posts per (hour, label),
    (hour, country) and (hour, country, label): one Expand feeding a partial aggregate and one
    shuffle of partial counts.  The top tags are ranked over a second, narrower pass (only the (hour, tag)
    set is expanded): a window limited to ``top_k`` ranks, so each task passes on at most that many tags of an hour.
    """
    rows = posts.select(hour_bucket("timestamp").alias("bucket"), "location", "sentiment",
                        F.posexplode_outer(clean_tags("hashtags")).alias("pos", "hashtag"))
    sets = [["bucket", "hashtag"], ["bucket", "sentiment"], ["bucket", "location"],
            ["bucket", "location", "sentiment"]]
    counted = rows.groupingSets(sets, "bucket", "location", "sentiment", "hashtag").agg(
        F.count("hashtag").alias("uses"),
        F.count_if(F.col("pos").isNull() | (F.col("pos") == 0)).alias("posts"),
        F.grouping("location").alias("g_loc"), F.grouping("sentiment").alias("g_sent"),
        F.grouping("hashtag").alias("g_tag"))
    is_tag, is_sent, is_geo = (F.col("g_tag") == 0), (F.col("g_loc") == 1), (F.col("g_sent") == 1)
    metric = (F.when(is_tag, F.lit("hashtag")).when(is_sent, F.lit("sentiment"))
              .when(is_geo, F.lit("geo")).otherwise(F.concat(F.lit("geo_"), F.col("location"))))
    key = (F.when(is_tag, F.col("hashtag")).when(is_sent, F.col("sentiment"))
           .when(is_geo, F.col("location")).otherwise(F.col("sentiment")))
    value = F.when(is_tag, F.col("uses")).otherwise(F.col("posts")).cast("long")
    keep = (value > 0) & (is_tag | is_sent | (F.coalesce(F.col("location"), F.lit("")) != ""))
    long = counted.filter(keep).select(metric.alias("metric"), "bucket", key.alias("key"),
                                       value.alias("value"))
    w = Window.partitionBy("bucket").orderBy(F.desc("value"), F.asc("key"))
    trending = (long.filter(F.col("metric") == "hashtag").withColumn("_r", F.row_number().over(w))
                .filter(F.col("_r") <= top_k)
                .select(F.lit("trending").alias("metric"), "bucket", "key", "value"))
    return long.unionByName(trending)


def write_metric_rows(rows: DataFrame, path: str) -> None:
    """Partitioned by hour ``bucket``; a rerun of an hour replaces exactly that hour.

    One partition per hour (not per metric and hour, which would make many
    tiny files).  Range partitioning on (bucket, metric, key) splits a large
    hour across writers and clusters rows by metric for statistics pruning.
    """
    (rows.repartitionByRange("bucket", "metric", "key").sortWithinPartitions("bucket", "metric", "key")
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("bucket").parquet(path))


def read_metric_rows(spark: SparkSession, path: str) -> DataFrame:
    """The stored metric rows; ``bucket`` is the partition column (read as text, not inferred)."""
    return spark.read.schema(METRIC_ROW).parquet(path).select("metric", "bucket", "key", "value")


def latest_metrics(rows: DataFrame, as_of_ms: int | None = None,
                   ttl_s: int = METRICS_TTL_S, mode: str = "replace") -> DataFrame:
    """The ``*_latest`` snapshots (O30): for every metric, the rows of its newest bucket.

    ``mode="merge"`` keeps a key that newer buckets do not have, with its last value, as a
    table does whose cells are overwritten one by one.

    The per-metric maximum is a small aggregate (partial, then final) joined
    back with a semi join; no window over a whole metric, which would put one
    metric's rows in one task.  With ``as_of_ms`` the search is limited to the
    live (not yet expired) hours: a literal ``bucket >=`` filter that prunes
    the stored table's partitions on both sides of the join.
    """
    if as_of_ms is not None:
        rows = apply_metric_retention(rows, as_of_ms, ttl_s)
    if mode == "merge":
        return rows.groupBy("metric", "key").agg(F.max("bucket").alias("bucket"), F.max_by("value", "bucket").alias("value")).select(
            "metric", "bucket", "key", "value")
    newest = rows.groupBy("metric").agg(F.max("bucket").alias("bucket"))   # one row per metric
    return rows.join(F.broadcast(newest), ["metric", "bucket"], "left_semi")


def metric_retention_cutoff(as_of_ms: int, ttl_s: int = METRICS_TTL_S) -> str:
    """Oldest hour bucket still alive at ``as_of`` (a literal, for partition pruning)."""
    import datetime as _dt
    oldest_ms = as_of_ms - ttl_s * 1000
    hour_ms = -(-oldest_ms // HOUR_MS) * HOUR_MS          # first hour start >= oldest
    when = _dt.datetime(1970, 1, 1) + _dt.timedelta(milliseconds=hour_ms)
    return when.strftime("%Y%m%d%H")


def apply_metric_retention(rows: DataFrame, as_of_ms: int, ttl_s: int = METRICS_TTL_S) -> DataFrame:
    """Keep rows whose hour started at most ``ttl_s`` before ``as_of``.

    Expressed as ``bucket >= literal`` so a stored table prunes partitions.
    """
    return rows.filter(F.col("bucket") >= F.lit(metric_retention_cutoff(as_of_ms, ttl_s)))


# ---- users --------------------------------------------------------------------------

USER_COUNTS = "user_id string, hashtag string, posts long, likes long, last_ts long, uses long"


def user_counts(posts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Additive user counts: per user one row of stats (``hashtag`` null) and one row per tag used.

    One scan: each post becomes one row per tag (or one row without a tag),
    and a GROUPING SETS aggregate yields both the per-user stats (each post
    counted once, through its first row) and the per-(user, tag) uses.  ``by``
    adds grouping keys (e.g. an hour column).  Rows of disjoint sets of posts add up.
    """
    keys = [*by, "user_id"]
    first = F.col("pos").isNull() | (F.col("pos") == 0)
    rows = posts.select(*by, "user_id", "likes", "timestamp",
                        F.posexplode_outer(clean_tags("hashtags")).alias("pos", "hashtag"))
    counted = rows.groupingSets([keys, [*keys, "hashtag"]], *keys, "hashtag").agg(
        F.count_if(first).alias("posts"),
        F.sum(F.when(first, F.coalesce(F.col("likes"), F.lit(0)))).alias("likes"),
        F.max("timestamp").alias("last_ts"),
        F.count("hashtag").alias("uses"),
        F.grouping("hashtag").alias("g_tag"))
    is_stats = F.col("g_tag") == 1
    return counted.filter(is_stats | (F.col("uses") > 0)).select(
        *keys, "hashtag", F.when(is_stats, F.col("posts")).cast("long").alias("posts"),
        F.when(is_stats, F.coalesce("likes", F.lit(0))).cast("long").alias("likes"),
        F.when(is_stats, F.col("last_ts")).alias("last_ts"),
        F.when(~is_stats, F.col("uses")).cast("long").alias("uses"))


def users_from_counts(counts: DataFrame, top_tags: int | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Users table from (summed) user counts: totals, hour last active, tags by use.

    ``top_tags`` limits the list, by a rank limit that applies before the shuffle; by
    default a user has all tags used.
    """
    keys = [*by, "user_id"]
    summed = counts.groupBy(*keys, "hashtag").agg(
        F.sum("posts").alias("posts"), F.sum("likes").alias("likes"),
        F.max("last_ts").alias("last_ts"), F.sum("uses").alias("uses"))
    if top_tags is not None:
        # the stats row comes first, then the tags by use
        w = Window.partitionBy(*keys).orderBy(F.desc(F.col("hashtag").isNull()), F.desc("uses"), F.asc("hashtag"))
        summed = summed.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= top_tags + 1)
    tag = F.when(F.col("hashtag").isNotNull(), F.struct((-F.col("uses")).alias("n"), "hashtag"))
    return summed.groupBy(*keys).agg(
        F.max("posts").alias("total_tweets"),
        F.coalesce(F.max("likes"), F.lit(0)).alias("total_likes"),
        hour_bucket(F.max("last_ts")).alias("last_active"),
        F.transform(F.array_sort(F.collect_list(tag)), lambda x: x["hashtag"]).alias("top_hashtags"))


def user_rows(posts: DataFrame, top_tags: int | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Per-user stats of a set of posts: total_tweets, total_likes, last_active, top_hashtags."""
    return users_from_counts(user_counts(posts, by), top_tags, by)


USER_VALUE_COLUMNS = ["username", "display_name", "location", "total_tweets", "total_likes",
                      "followers", "last_active", "top_hashtags"]


def upsert_users(old: DataFrame, new: DataFrame) -> DataFrame:
    """Per-cell overwrite: a cell present in ``new`` replaces the old one, others stay."""
    cols = [c for c in USER_VALUE_COLUMNS if c in old.columns or c in new.columns]
    o = old.select("user_id", *[F.col(c).alias(f"_o_{c}") if c in old.columns
                                else F.lit(None).alias(f"_o_{c}") for c in cols])
    n = new.select("user_id", *[F.col(c).alias(f"_n_{c}") if c in new.columns
                                else F.lit(None).alias(f"_n_{c}") for c in cols])
    j = o.join(n, "user_id", "full_outer")
    return j.select("user_id", *[F.coalesce(F.col(f"_n_{c}"), F.col(f"_o_{c}")).alias(c)
                                 for c in cols])


# ---- users as a log of additive counts -------------------------------------------------

def write_user_counts(counts: DataFrame, path: str) -> None:
    """Write the counts of some hours under their ``bucket``; a rerun of an hour replaces that hour only.

    Range partitioning cuts a large hour into several writers.
    """
    (counts.repartitionByRange("bucket", "user_id").sortWithinPartitions("bucket", "user_id")
           .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path))


def read_user_counts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(USER_COUNTS + ", bucket string").parquet(path)
