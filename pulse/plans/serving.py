"""The read API as DataFrame queries.

Each function takes the relevant table(s) as DataFrames plus the request
parameters and returns a DataFrame; exposing it over HTTP is the caller's
business.  Where the original read path approximated (sorting only a scanned
prefix), these are exact: top-k by a total order over the whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulse.functions.keys import HOUR_BUCKET_FORMAT, hour_bucket
from pulse.functions.tags import clean_tags, join_tags
from pulse.functions.text import contains_ci, user_handle, user_label
from pulse.operators import aggregates as agg
from pulse.operators.rankings import filter_ranked, ranked_list
from pulse.sources.posts import normalize_posts

# Request parameter defaults and bounds of the read API.
RECENT_LIMIT, RECENT_MAX = 50, 200
VIRAL_LIMIT = 10
VIRAL_LIKES_ABOVE = 1000
SEARCH_LIMIT = 50
TRENDING_LIMIT, TRENDING_MAX = 10, 50
HISTORY_HOURS = 24
TIMELINE_HOURS, TIMELINE_MIN, TIMELINE_MAX = 24, 1, 168
TOP_USERS_LIMIT, TOP_USERS_MIN, TOP_USERS_MAX = 10, 1, 50

HOUR_MS = 3_600_000


def _time_range(posts: DataFrame, lo_ms: int, hi_ms: int | None = None) -> DataFrame:
    """``lo <= timestamp < hi`` as literal filters; also prunes ``day`` partitions."""
    cond = F.col("timestamp") >= F.lit(int(lo_ms))
    if hi_ms is not None:
        cond = cond & (F.col("timestamp") < F.lit(int(hi_ms)))
    out = posts.filter(cond)
    if "day" in posts.columns:
        day = lambda ms: F.date_format(F.timestamp_millis(F.lit(int(ms))), "yyyy-MM-dd")
        out = out.filter(F.col("day") >= day(lo_ms))
        if hi_ms is not None:
            out = out.filter(F.col("day") <= day(hi_ms))
    return out


def _check(value: int, lo: int, hi: int, name: str) -> int:
    if not lo <= value <= hi:
        raise ValueError(f"{name} must be in [{lo}, {hi}], got {value}")
    return value


def newest_first_threshold(posts: DataFrame, n: int) -> int | None:
    """The n-th newest ``timestamp`` (one scalar from a one-column top-k)."""
    rows = posts.select("timestamp").orderBy(F.desc("timestamp")).limit(n).collect()
    return rows[-1]["timestamp"] if rows else None


def recent_posts(posts: DataFrame, limit: int = RECENT_LIMIT, two_phase: bool = True) -> DataFrame:
    """Newest ``limit`` posts (O21); ties by key.

    Two phases: a one-column top-k finds the ``limit``-th newest timestamp, then
    a pushed ``timestamp >=`` filter (and ``day`` pruning on the stored table)
    fetches the full rows of only the newest files and row groups.
    """
    _check(limit, 1, RECENT_MAX, "limit")
    src = posts
    if two_phase:
        t = newest_first_threshold(posts, limit)
        if t is not None:
            src = posts.filter(F.col("timestamp") >= F.lit(t))
            if "day" in posts.columns:
                src = src.filter(F.col("day") >= F.date_format(F.timestamp_millis(F.lit(t)), "yyyy-MM-dd"))
    newest = src.orderBy(F.asc("rev_ts"), F.asc("row_key"), F.asc("tweet_id")).limit(limit)
    return (normalize_posts(newest)
               .select(F.col("row_key").alias("tweet_id"), "text", "hashtags", "likes",
                       "retweets", "location", "sentiment"))


def viral_filter(posts: DataFrame, threshold: int = VIRAL_LIKES_ABOVE) -> DataFrame:
    """Strictly more likes than the threshold; null likes are not viral."""
    return posts.filter(F.col("likes") > F.lit(threshold))


def viral_posts(posts: DataFrame, limit: int = VIRAL_LIMIT, order: str = "likes") -> DataFrame:
    """Top viral posts (O22): by likes desc then id, or in stored key order (``order='key'``)."""
    key = "row_key" if "row_key" in posts.columns else "tweet_id"
    sort = [F.asc(key), F.asc("tweet_id")] if order == "key" else [F.desc("likes"), F.asc("tweet_id")]
    top = viral_filter(posts).orderBy(*sort).limit(limit)
    return normalize_posts(top).select("tweet_id", "text", "likes", "user_id")


def hashtag_search(posts: DataFrame, hashtag: str, limit: int = SEARCH_LIMIT,
                   exact: bool = False) -> DataFrame:
    """Posts whose tags match (O19/O23), in key order.

    Default: case-insensitive substring of the comma-joined tags (``#a`` finds
    ``#ab``).  ``exact=True``: one tag equal to ``hashtag`` ignoring case.
    """
    if exact:
        cond = F.exists(clean_tags("hashtags"), lambda t: F.lower(t) == hashtag.lower())
    else:
        cond = contains_ci(join_tags(clean_tags("hashtags")), hashtag)
    found = posts.filter(cond).orderBy("row_key").limit(limit)
    return (normalize_posts(found)
                 .select(F.col("row_key").alias("tweet_id"), "text", "hashtags", "likes", "location"))


def newest_timestamp(posts: DataFrame) -> int | None:
    """Epoch millis of the newest post (one scalar)."""
    row = posts.agg(F.max("timestamp").alias("m")).first()
    if row is None or row["m"] is None:
        return None
    return int(row["m"])


def trending_latest(posts: DataFrame, limit: int = TRENDING_LIMIT, as_of_ms: int | None = None) -> DataFrame:
    """Tag counts of the hour of ``as_of_ms`` (default: of the newest post), most used first (O24 over O30)."""
    _check(limit, 1, TRENDING_MAX, "limit")
    newest = newest_timestamp(posts) if as_of_ms is None else as_of_ms
    if newest is None:
        return agg.hashtag_counts(posts.limit(0))
    start = (newest // HOUR_MS) * HOUR_MS
    hour = _time_range(posts, start, start + HOUR_MS)
    return agg.top_k(agg.hashtag_counts(hour), limit, "cnt", "hashtag")


def trending_from_metrics(latest_rows: DataFrame, limit: int = TRENDING_LIMIT) -> DataFrame:
    """Same answer read from stored metric rows (``metric = 'hashtag'``, newest bucket)."""
    _check(limit, 1, TRENDING_MAX, "limit")
    t = latest_rows.filter(F.col("metric") == "hashtag").select(
        F.col("key").alias("hashtag"), F.col("value").alias("cnt"))
    return agg.top_k(t, limit, "cnt", "hashtag")


def hashtag_history(posts: DataFrame, hashtag: str, hours: int = HISTORY_HOURS) -> DataFrame:
    """Hourly uses of one tag, newest hour first, at most ``hours`` hours with uses."""
    tagged = posts.filter(F.array_contains(F.col("hashtags"), hashtag))
    uses = F.aggregate(F.col("hashtags"), F.lit(0).cast("long"),
                       lambda acc, t: acc + F.when(t == hashtag, 1).otherwise(0))
    return (tagged.groupBy(hour_bucket("timestamp").alias("hour"))
                  .agg(F.sum(uses).alias("count"))
                  .orderBy(F.desc("hour")).limit(hours))


def hashtag_history_from_metrics(metric_rows: DataFrame, hashtag: str,
                                 hours: int = HISTORY_HOURS) -> DataFrame:
    """Same answer as :func:`hashtag_history`, read from the stored metric rows.

    ``metric = 'hashtag' AND key = tag`` are pushed to the scan; rows are
    clustered by (metric, key) inside each hour file, so most row groups are
    skipped by statistics instead of scanning every post's tag list.
    """
    rows = metric_rows.filter((F.col("metric") == "hashtag") & (F.col("key") == hashtag))
    return (rows.select(F.col("bucket").alias("hour"), F.col("value").alias("count"))
                .orderBy(F.desc("hour")).limit(hours))


def sentiment_timeline_from_metrics(metric_rows: DataFrame, as_of_ms: int,
                                    hours: int = TIMELINE_HOURS) -> DataFrame:
    """Same answer as :func:`sentiment_timeline`, read from ``sentiment`` metric rows.

    The hour range is a literal filter on the partition column ``bucket``.
    """
    _check(hours, TIMELINE_MIN, TIMELINE_MAX, "hours")
    lo, hi = _timeline_range(as_of_ms, hours)
    fmt = lambda ms: F.date_format(F.timestamp_millis(F.lit(int(ms))), HOUR_BUCKET_FORMAT)
    rows = metric_rows.filter((F.col("metric") == "sentiment") & (F.col("bucket") >= fmt(lo))
                              & (F.col("bucket") < fmt(hi)))
    return (rows.groupBy(F.col("bucket").alias("hour"))
                .agg(*[F.coalesce(F.sum(F.when(F.col("key") == lab, F.col("value"))), F.lit(0))
                       .cast("long").alias(lab) for lab in agg.LABELS])
                .orderBy("hour"))


def sentiment_stats_from_metrics(latest_rows: DataFrame) -> DataFrame:
    """The three label counts of the newest ``sentiment`` snapshot; missing labels are 0."""
    rows = latest_rows.filter(F.col("metric") == "sentiment")
    return rows.agg(*[F.coalesce(F.sum(F.when(F.col("key") == lab, F.col("value"))), F.lit(0))
                      .cast("long").alias(lab) for lab in agg.LABELS])


def geo_from_metrics(latest_rows: DataFrame) -> DataFrame:
    """Posts per country of the newest ``geo`` snapshot."""
    return (latest_rows.filter(F.col("metric") == "geo")
                       .select(F.col("key").alias("location"), F.col("value").alias("cnt")))


def sentiment_stats(posts: DataFrame) -> DataFrame:
    """One row with the three label counts (O26); missing labels are 0."""
    return agg.label_counts_row(posts).select(*agg.LABELS)


def _timeline_range(as_of_ms: int, hours: int) -> tuple[int, int]:
    end = (as_of_ms // HOUR_MS + 1) * HOUR_MS
    return end - hours * HOUR_MS, end


def sentiment_timeline(posts: DataFrame, as_of_ms: int, hours: int = TIMELINE_HOURS) -> DataFrame:
    """Label counts per hour for the ``hours`` hours ending at ``as_of``'s hour.

    Ascending; hours without posts are omitted.  The range is a pushed literal filter.
    """
    _check(hours, TIMELINE_MIN, TIMELINE_MAX, "hours")
    lo, hi = _timeline_range(as_of_ms, hours)
    win = _time_range(posts, lo, hi)
    return (win.groupBy(hour_bucket("timestamp").alias("hour"))
               .agg(*[F.count_if(agg.read_label() == lab).alias(lab) for lab in agg.LABELS])
               .orderBy("hour"))


def sentiment_timeline_filled(posts: DataFrame, as_of_ms: int,
                              hours: int = TIMELINE_HOURS) -> DataFrame:
    """As :func:`sentiment_timeline` but every hour present (zeros for empty hours)."""
    spark = posts.sparkSession
    lo, _ = _timeline_range(as_of_ms, hours)
    spine = spark.range(hours).select(
        F.date_format(F.timestamp_millis(F.lit(lo) + F.col("id") * HOUR_MS),
                      HOUR_BUCKET_FORMAT).alias("hour"))
    counts = sentiment_timeline(posts, as_of_ms, hours)
    # Both sides are bounded by ``hours`` (<= 168 rows).
    return (spine.join(F.broadcast(counts), "hour", "left")
                 .select("hour", *[F.coalesce(F.col(lab), F.lit(0)).cast("long").alias(lab)
                                   for lab in agg.LABELS])
                 .orderBy("hour"))


def geo_distribution(posts: DataFrame) -> DataFrame:
    """Posts per country."""
    return agg.geo_totals(posts)


def served_users(users: DataFrame) -> DataFrame:
    """Apply the read defaults of the users table (missing cell or column -> 0 / '')."""
    cols = set(users.columns)

    def num(c):
        return (F.coalesce(F.col(c), F.lit(0)) if c in cols else F.lit(0)).cast("long").alias(c)

    last = F.coalesce(F.col("last_active"), F.lit("")) if "last_active" in cols else F.lit("")
    return users.select("user_id", num("total_tweets"), num("total_likes"), num("followers"),
                        last.alias("last_active"))


def top_users(users: DataFrame, limit: int = TOP_USERS_LIMIT) -> DataFrame:
    """Most active users over the whole users table."""
    _check(limit, TOP_USERS_MIN, TOP_USERS_MAX, "limit")
    return agg.top_k(served_users(users), limit, "total_tweets", "user_id")


def user_detail(users: DataFrame, user_id: str) -> DataFrame:
    """One user's profile, stats and top tags; zero rows when unknown."""
    u = users.filter(F.col("user_id") == user_id)
    cols = set(users.columns)

    def text(c):
        return F.coalesce(F.col(c), F.lit("")) if c in cols else F.lit("")

    def num(c):
        return F.coalesce(F.col(c), F.lit(0)).cast("long") if c in cols else F.lit(0).cast("long")

    tags = (F.coalesce(F.col("top_hashtags"), F.array().cast("array<string>"))
            if "top_hashtags" in cols else F.array().cast("array<string>"))
    return u.select("user_id", text("username").alias("username"),
                    text("display_name").alias("display_name"), text("location").alias("location"),
                    num("total_tweets").alias("total_tweets"), num("total_likes").alias("total_likes"),
                    num("followers").alias("followers"), text("last_active").alias("last_active"),
                    tags.alias("top_hashtags"))


# ---- feed / dashboard maths -----------------------------------------------------------

def feed_authors(feed: DataFrame) -> DataFrame:
    """Display name and handle from each post key."""
    return feed.select("tweet_id", user_label("tweet_id").alias("display_name"),
                       user_handle("tweet_id").alias("handle"))


def feed_search(feed: DataFrame, query: str) -> DataFrame:
    """Substring (any case) over text, author label, country or any tag."""
    q = query.lower()
    cond = (contains_ci("text", q) | contains_ci(user_label("tweet_id"), q)
            | contains_ci("location", q)
            | F.coalesce(F.exists(F.col("hashtags"), lambda h: F.lower(h).contains(q)), F.lit(False)))
    return feed.filter(cond)


def feed_filter(feed: DataFrame, query: str = "", sentiment: str = "all") -> DataFrame:
    """Sentiment tab AND search."""
    out = feed_search(feed, query) if query else feed
    return out if sentiment == "all" else out.filter(F.col("sentiment") == sentiment)


def feed_kpis(feed: DataFrame) -> DataFrame:
    """Label counts, total and positivity rate of a feed."""
    c = agg.label_counts_row(feed)
    rate = F.coalesce(F.round(F.lit(100.0) * F.col("positive") / F.nullif(F.col("total"), F.lit(0))),
                      F.lit(0.0)).cast("long")
    return c.select(*agg.LABELS, "total", rate.alias("positivity_rate"))


def trending_ranked(top: DataFrame, query: str | None = None) -> DataFrame:
    """Rank and share-of-max over a top list; optional filter keeps the overall rank."""
    ranked = ranked_list(top)
    return filter_ranked(ranked, query) if query else ranked
