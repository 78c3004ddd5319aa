"""DuckDB reference SQL for the query catalog.

Each query is written independently of the Spark code (a different engine and
a different physical form: the sentiment oracle unnests tokens and joins the
lexicon, where Spark folds over each post's tokens in place).  All of them run
over the whole driver tables, pre-registered as views.
"""

from __future__ import annotations

from pulse.operators.lookups import COUNTRY_COORDS
from pulse.operators.sentiment import LEXICON_PATH

# The posts view (FIXTURES.md §3, DuckDB form).
TWEETS = """
tweets AS (
SELECT CAST(e.event_id AS VARCHAR) AS tweet_id,
       'user_' || e.user_id AS user_id,
       CASE e.event_id % 9
         WHEN 0 THEN 'great day with #' || e.event_type
         WHEN 1 THEN 'just read about #' || e.event_type
         WHEN 2 THEN '#' || e.event_type || ' is broken again'
         WHEN 3 THEN 'not great, #' || e.event_type
         WHEN 4 THEN 'I love my #' || e.event_type || ' project'
         WHEN 5 THEN '#' || e.event_type || ' at noon'
         WHEN 6 THEN 'terrible #' || e.event_type || ' , I hate it'
         WHEN 7 THEN ''
         ELSE NULL END AS text,
       CASE WHEN e.event_id % 7 = 0 THEN CAST([] AS VARCHAR[])
            WHEN e.event_id % 3 = 0 THEN ['#' || e.event_type]
            ELSE ['#' || e.event_type, '#k' || (CAST(e.props->>'k' AS INTEGER) % 10)] END AS hashtags,
       CASE WHEN e.event_id % 11 = 0 THEN NULL ELSE CAST(floor(e.value * 20) AS INTEGER) END AS likes,
       CAST(e.props->>'k' AS INTEGER) AS retweets,
       epoch_us(e.ts) // 1000 AS "timestamp",
       COALESCE(n.n_name, '') AS location,
       strftime(e.ts, '%Y%m%d%H') AS bucket
FROM events e LEFT JOIN nation n ON n.n_nationkey = e.event_id % 26
)"""


def _score_ctes(source: str, id_col: str, text_col: str, prefix: str) -> str:
    """Lexicon score of ``source.text_col`` per ``id_col`` as CTE ``{prefix}_hits``."""
    return f"""
{prefix}_tok AS (
  SELECT {id_col} AS id,
         string_split(trim(regexp_replace(lower({text_col}), '[^\\p{{L}}'']+', ' ', 'g')), ' ') AS toks
  FROM {source}),
{prefix}_pos AS (
  SELECT id, toks, unnest(generate_series(1, len(toks))) AS i FROM {prefix}_tok),
{prefix}_hits AS (
  SELECT p.id, avg(greatest(least(l.polarity * coalesce(m.factor, 1.0), 1.0), -1.0)) AS s
  FROM {prefix}_pos p
  JOIN lexicon l ON l.term = p.toks[p.i]
  LEFT JOIN modifiers m ON p.i > 1 AND m.term = p.toks[p.i - 1]
  GROUP BY p.id)"""


LEXICON = f"""
words AS (SELECT * FROM read_csv('{LEXICON_PATH}', header = true, quote = '',
                                 columns = {{'term': 'VARCHAR', 'polarity': 'DOUBLE', 'intensity': 'DOUBLE'}})),
lexicon AS (SELECT term, polarity FROM words WHERE polarity IS NOT NULL),
modifiers AS (SELECT term, intensity AS factor FROM words WHERE intensity IS NOT NULL)"""

ENRICHED = _score_ctes("tweets", "tweet_id", "text", "tw") + """,
enriched AS (
  SELECT t.tweet_id, t.user_id, t.text, t.hashtags, t.likes, t.retweets, t."timestamp",
         t.location,
         CASE WHEN coalesce(h.s, 0.0) > 0.1 THEN 'positive'
              WHEN coalesce(h.s, 0.0) < -0.1 THEN 'negative' ELSE 'neutral' END AS sentiment,
         round(coalesce(h.s, 0.0), 3) AS sentiment_score
  FROM tweets t LEFT JOIN tw_hits h ON h.id = t.tweet_id),
stored AS (
  SELECT CAST(('0x' || substr(md5(user_id), 1, 8))::BIGINT % 10 AS BIGINT) AS salt,
         9999999999999 - "timestamp" AS rev_ts,
         strftime(make_timestamp("timestamp" * 1000), '%Y-%m-%d') AS day,
         strftime(make_timestamp("timestamp" * 1000), '%Y%m%d%H') AS hb,
         *
  FROM enriched),
posts AS (
  SELECT CAST(salt AS VARCHAR) || '_' || user_id || '_' || lpad(CAST(rev_ts AS VARCHAR), 13, '0')
           AS row_key, *
  FROM stored),
tags AS (
  SELECT * FROM (SELECT tweet_id, user_id, likes, retweets, "timestamp", hb,
                        unnest(hashtags) AS hashtag FROM posts)
  WHERE hashtag IS NOT NULL AND hashtag <> ''),
as_of_ms AS (SELECT max("timestamp") AS ms FROM tweets)"""

# Metric rows over all posts (shared by metric_rows, latest_metrics, retention_metrics).
METRICS = """,
m_tags AS (SELECT hb AS bucket, hashtag, count(*) AS value FROM tags GROUP BY 1, 2),
m_geo_detail AS (SELECT hb AS bucket, location, sentiment, count(*) AS value
                 FROM posts WHERE location <> '' GROUP BY 1, 2, 3),
metric_rows AS (
  SELECT 'hashtag' AS metric, bucket, hashtag AS key, value FROM m_tags
  UNION ALL
  SELECT 'trending', bucket, hashtag, value FROM (
    SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY value DESC, hashtag) AS r
    FROM m_tags) WHERE r <= 10
  UNION ALL
  SELECT 'sentiment', hb, sentiment, count(*) FROM posts GROUP BY 2, 3
  UNION ALL
  SELECT 'geo', bucket, location, sum(value) FROM m_geo_detail GROUP BY 2, 3
  UNION ALL
  SELECT 'geo_' || location, bucket, sentiment, value FROM m_geo_detail)"""


def _user_rows(name: str, where: str) -> str:
    """Per-user stats and tags by use of the posts matching ``where``."""
    return f""",
{name}_stats AS (
  SELECT user_id, count(*) AS total_tweets, CAST(coalesce(sum(coalesce(likes, 0)), 0) AS BIGINT) AS total_likes,
         strftime(make_timestamp(max("timestamp") * 1000), '%Y%m%d%H') AS last_active
  FROM posts WHERE {where} GROUP BY user_id),
{name}_tagcnt AS (
  SELECT user_id, hashtag, count(*) AS cnt FROM tags WHERE {where} GROUP BY 1, 2),
{name}_top AS (
  SELECT user_id, list(hashtag ORDER BY r) AS top_hashtags FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY cnt DESC, hashtag) AS r
    FROM {name}_tagcnt) GROUP BY user_id),
{name} AS (
  SELECT s.*, coalesce(t.top_hashtags, CAST([] AS VARCHAR[])) AS top_hashtags
  FROM {name}_stats s LEFT JOIN {name}_top t USING (user_id))"""


def with_ctes(body: str, *extra: str) -> str:
    return "WITH " + TWEETS + "," + LEXICON + "," + ENRICHED + "".join(extra) + "\n" + body


DOC_SCORE = "WITH " + LEXICON + "," + _score_ctes("documents", "doc_id", "text", "doc") + """
SELECT d.doc_id,
       CASE WHEN coalesce(h.s, 0.0) > 0.1 THEN 'positive'
            WHEN coalesce(h.s, 0.0) < -0.1 THEN 'negative' ELSE 'neutral' END AS sentiment,
       round(coalesce(h.s, 0.0), 3) AS sentiment_score
FROM documents d LEFT JOIN doc_hits h ON h.id = d.doc_id"""

HOUR = 3600000
DAY = 86400000
AS_OF = "(SELECT ms FROM as_of_ms)"
USERS_ALL = _user_rows("users_all", "TRUE")
# first hour that two runs of the hourly job, the first 20 minutes before as-of, recompute
FIRST_HOUR = f"strftime(make_timestamp(({AS_OF} - 1200000 - {HOUR}) // {HOUR} * {HOUR} * 1000), '%Y%m%d%H')"
_COORDS = ", ".join(f"({i}, '{code}', CAST({lat} AS DOUBLE), CAST({lng} AS DOUBLE))"
                    for i, (code, (lat, lng)) in enumerate(sorted(COUNTRY_COORDS.items())))
FEED = """
feed AS (SELECT row_key AS tweet_id, coalesce(text, '') AS text,
                list_filter(hashtags, lambda x: x IS NOT NULL AND x <> '') AS hashtags, coalesce(likes, 0) AS likes,
                coalesce(retweets, 0) AS retweets, location, sentiment
         FROM posts ORDER BY rev_ts, row_key, tweet_id LIMIT 50)"""
TOP10 = """
top10 AS (SELECT hashtag, count(*) AS cnt FROM tags GROUP BY 1 ORDER BY cnt DESC, hashtag LIMIT 10)"""


def _timeline(hours: int) -> str:
    lo = f"(({AS_OF} // {HOUR} + 1) * {HOUR} - {hours} * {HOUR})"
    hi = f"(({AS_OF} // {HOUR} + 1) * {HOUR})"
    return f"""
tl AS (SELECT hb AS hour,
              count(*) FILTER (WHERE sentiment = 'positive') AS positive,
              count(*) FILTER (WHERE sentiment = 'neutral') AS neutral,
              count(*) FILTER (WHERE sentiment = 'negative') AS negative
       FROM posts WHERE "timestamp" >= {lo} AND "timestamp" < {hi} GROUP BY 1),
spine AS (SELECT strftime(make_timestamp(({lo} + i * {HOUR}) * 1000), '%Y%m%d%H') AS hour
          FROM range({hours}) t(i))"""


ORACLE: dict[str, str] = {
    # ---- aggregates / flagship
    "top_hashtags": with_ctes("""
SELECT hashtag, count(*) AS cnt FROM tags GROUP BY hashtag ORDER BY cnt DESC, hashtag LIMIT 10"""),
    "hashtag_counts": with_ctes("SELECT hashtag, count(*) AS cnt FROM tags GROUP BY hashtag"),
    "sentiment_counts": with_ctes("SELECT sentiment, count(*) AS cnt FROM posts GROUP BY sentiment"),
    "geo_sentiment": with_ctes("""
SELECT location, sentiment, count(*) AS cnt FROM posts WHERE location <> '' GROUP BY 1, 2"""),
    "geo_sentiment_ordered": with_ctes("""
SELECT location, sentiment, count(*) AS cnt FROM posts WHERE location <> ''
GROUP BY 1, 2 ORDER BY location, cnt DESC, sentiment"""),
    "geo_totals": with_ctes("SELECT location, count(*) AS cnt FROM posts WHERE location <> '' GROUP BY 1"),
    "geo_rollup": with_ctes("""
SELECT location, sentiment, count(*) AS cnt FROM posts WHERE location <> ''
GROUP BY ROLLUP (location, sentiment)"""),
    "top_users": with_ctes("""
SELECT user_id, count(*) AS tweet_count, CAST(coalesce(sum(coalesce(likes, 0)), 0) AS BIGINT) AS total_likes
FROM posts GROUP BY user_id ORDER BY tweet_count DESC, user_id LIMIT 20"""),
    "volume_total": with_ctes("SELECT count(*) AS total_posts FROM posts"),
    "hour_bucket": with_ctes("SELECT hb AS bucket, count(*) AS cnt FROM posts GROUP BY 1"),
    "positivity_rate": with_ctes("""
SELECT count(*) FILTER (WHERE sentiment = 'positive') AS positive, count(*) AS total,
       CAST(coalesce(round(100.0 * count(*) FILTER (WHERE sentiment = 'positive') / nullif(count(*), 0)), 0) AS BIGINT)
         AS positivity_rate
FROM posts"""),
    "sentiment_stats": with_ctes("""
SELECT count(*) FILTER (WHERE sentiment = 'positive') AS positive,
       count(*) FILTER (WHERE sentiment = 'neutral') AS neutral,
       count(*) FILTER (WHERE sentiment = 'negative') AS negative FROM posts"""),
    "sentiment_shares": with_ctes("""
SELECT sentiment, cnt, 100.0 * cnt / sum(cnt) OVER () AS share
FROM (SELECT sentiment, count(*) AS cnt FROM posts GROUP BY 1)"""),
    "trending_kpis": with_ctes("""
SELECT CAST(coalesce(sum(cnt), 0) AS BIGINT) AS total_volume, CAST(coalesce(max(cnt), 0) AS BIGINT) AS max_volume,
       coalesce(arg_min(hashtag, (-cnt, hashtag)), 'N/A') AS top_hashtag,
       CAST(coalesce(arg_min(cnt, (-cnt, hashtag)), 0) AS BIGINT) AS top_hashtag_count,
       count(*) AS n_hashtags
FROM top10""", "," + TOP10),
    "geo_kpis": with_ctes("""
SELECT CAST(coalesce(sum(cnt), 0) AS BIGINT) AS total_posts,
       coalesce(arg_min(location, (-cnt, location)), 'N/A') AS top_country,
       CAST(coalesce(arg_min(cnt, (-cnt, location)), 0) AS BIGINT) AS top_country_count,
       count(*) AS n_countries
FROM (SELECT location, count(*) AS cnt FROM posts WHERE location <> '' GROUP BY 1)"""),
    "geo_points": with_ctes("""
SELECT g.location, g.cnt, n.n_nationkey AS nation_key, r.r_name AS region
FROM (SELECT location, count(*) AS cnt FROM posts WHERE location <> '' GROUP BY 1) g
JOIN nation n ON n.n_name = g.location JOIN region r ON r.r_regionkey = n.n_regionkey"""),
    # ---- sentiment
    "sentiment_score": with_ctes("SELECT tweet_id, sentiment, sentiment_score FROM enriched"),
    "sentiment_label": with_ctes("""
SELECT sentiment_score, sentiment, count(*) AS cnt FROM enriched GROUP BY 1, 2"""),
    "enriched_posts": with_ctes("""
SELECT tweet_id, user_id, text, hashtags, likes, retweets, "timestamp", location, sentiment, sentiment_score
FROM enriched"""),
    "document_sentiment": DOC_SCORE,
    # ---- keys, projections, store
    "stored_posts": with_ctes("""
SELECT row_key, salt, user_id, rev_ts, tweet_id, text, hashtags, likes, retweets, location,
       sentiment, sentiment_score, "timestamp", day FROM posts"""),
    "salt_distribution": with_ctes("""
SELECT salt, count(*) AS posts, count(DISTINCT user_id) AS users FROM posts GROUP BY salt"""),
    "parse_row_key": with_ctes("""
SELECT key, CAST(regexp_extract(key, '^([^_]+)_(.+)_([^_]+)$', 1) AS BIGINT) AS salt,
       regexp_extract(key, '^([^_]+)_(.+)_([^_]+)$', 2) AS user_id,
       TRY_CAST(regexp_extract(key, '^([^_]+)_(.+)_([^_]+)$', 3) AS BIGINT) AS rev_ts
FROM (SELECT row_key AS key FROM posts UNION ALL SELECT row_key || 'x' FROM posts WHERE text IS NULL
      UNION ALL SELECT 'x' FROM posts WHERE text = '')
WHERE regexp_extract(key, '^([^_]+)_(.+)_([^_]+)$', 2) <> ''
  AND regexp_matches(regexp_extract(key, '^([^_]+)_(.+)_([^_]+)$', 3), '^[0-9]+$')"""),
    "tags_roundtrip": with_ctes("""
SELECT tweet_id, array_to_string(hashtags, ',') AS tags_text,
       list_filter(string_split(array_to_string(hashtags, ','), ','), lambda x: x <> '') AS tags
FROM tweets"""),
    "normalize_posts": with_ctes("""
SELECT tweet_id, coalesce(text, '') AS text, coalesce(likes, 0) AS likes, coalesce(retweets, 0) AS retweets,
       coalesce(location, '') AS location,
       coalesce(list_filter(hashtags, lambda x: x IS NOT NULL AND x <> ''), CAST([] AS VARCHAR[])) AS hashtags
FROM tweets"""),
    "parse_posts": with_ctes("""
SELECT tweet_id, user_id, text, hashtags, likes, retweets, "timestamp", location FROM tweets"""),
    "parse_rejects": with_ctes("""
SELECT TRUE AS broken, '{not json ' || tweet_id AS value, count(*) AS cnt FROM tweets WHERE text IS NULL GROUP BY tweet_id
UNION ALL
SELECT FALSE, NULL, count(*) FROM tweets WHERE text IS NULL HAVING count(*) > 0"""),
    "publish_payload": with_ctes("""
SELECT tweet_id AS key,
       CAST(to_json({'tweet_id': tweet_id, 'user_id': user_id, 'text': text, 'hashtags': hashtags,
                     'likes': likes, 'retweets': retweets, 'timestamp': "timestamp", 'location': location,
                     'sentiment': sentiment, 'sentiment_score': sentiment_score}) AS VARCHAR) AS value
FROM enriched"""),
    "last_window_posts": with_ctes(f"""
SELECT tweet_id, user_id, hashtags, likes, retweets, location, sentiment, "timestamp"
FROM posts WHERE "timestamp" >= {AS_OF} - {HOUR}"""),
    "prefix_scan": with_ctes("SELECT row_key, tweet_id, user_id FROM posts WHERE starts_with(row_key, '3_')"),
    "user_posts": with_ctes("""
SELECT row_key, tweet_id, "timestamp" FROM posts WHERE user_id = 'user_7'"""),
    "bounded_scan": with_ctes("SELECT row_key, tweet_id FROM posts ORDER BY row_key LIMIT 100"),
    "delete_two_steps": with_ctes("""
SELECT row_key, tweet_id FROM posts
WHERE row_key NOT IN (SELECT row_key FROM posts WHERE location = '' OR user_id = 'user_7')"""),
    "expire_posts": with_ctes(f"""
SELECT row_key, tweet_id, text,
       CASE WHEN {AS_OF} + CAST(76 AS BIGINT) * {DAY} - "timestamp" > 7776000000 THEN NULL ELSE sentiment END AS sentiment,
       CASE WHEN {AS_OF} + CAST(76 AS BIGINT) * {DAY} - "timestamp" > 7776000000 THEN NULL ELSE sentiment_score END
         AS sentiment_score
FROM posts"""),
    "delete_keys": with_ctes("""
SELECT row_key, tweet_id FROM posts
WHERE row_key NOT IN (SELECT row_key FROM posts WHERE location = '')"""),
    "metric_rows": with_ctes("SELECT metric, bucket, key, CAST(value AS BIGINT) AS value FROM metric_rows",
                             METRICS),
    "latest_metrics": with_ctes("""
SELECT metric, bucket, key, CAST(value AS BIGINT) AS value FROM metric_rows m
WHERE bucket = (SELECT max(bucket) FROM metric_rows x WHERE x.metric = m.metric)""", METRICS),
    "latest_metrics_merged": with_ctes("""
SELECT metric, max(bucket) AS bucket, key, CAST(arg_max(value, bucket) AS BIGINT) AS value
FROM metric_rows GROUP BY metric, key""", METRICS),
    "retention_metrics": with_ctes(f"""
SELECT metric, bucket, key, CAST(value AS BIGINT) AS value FROM metric_rows
WHERE {AS_OF} - epoch_ms(strptime(bucket, '%Y%m%d%H')) <= 172800000""", METRICS),
    "retention_posts": with_ctes(f"""
SELECT row_key, tweet_id, text,
       CASE WHEN {AS_OF} + CAST(75 AS BIGINT) * {DAY} - "timestamp" > 7776000000 THEN NULL ELSE sentiment END AS sentiment,
       CASE WHEN {AS_OF} + CAST(75 AS BIGINT) * {DAY} - "timestamp" > 7776000000 THEN NULL ELSE sentiment_score END
         AS sentiment_score
FROM posts"""),
    "users_upsert": with_ctes("""
SELECT user_id,
       coalesce(n.total_tweets, o.total_tweets) AS total_tweets,
       coalesce(n.total_likes, o.total_likes) AS total_likes,
       coalesce(n.last_active, o.last_active) AS last_active,
       coalesce(n.top_hashtags, o.top_hashtags) AS top_hashtags
FROM users_old o FULL OUTER JOIN users_new n USING (user_id)""",
                              _user_rows("users_old", f'"timestamp" < {AS_OF} - 7 * {DAY}'),
                              _user_rows("users_new", f'"timestamp" >= {AS_OF} - 7 * {DAY}')),
    "users_from_deltas": with_ctes("""
SELECT user_id, total_tweets, total_likes, last_active, top_hashtags FROM users_all""", USERS_ALL),
    "hourly_job_metrics": with_ctes(f"""
SELECT metric, bucket, key, CAST(value AS BIGINT) AS value FROM metric_rows
WHERE bucket >= {FIRST_HOUR}""", METRICS),
    "hourly_job_users": with_ctes("""
SELECT user_id, total_tweets, total_likes, last_active, top_hashtags FROM users_run""",
                                  _user_rows("users_run", f"hb >= {FIRST_HOUR}".replace("hb", "strftime(make_timestamp(\"timestamp\" * 1000), '%Y%m%d%H')"))),
    "post_table_two_steps": with_ctes("""
SELECT row_key, salt, user_id, rev_ts, tweet_id, text, hashtags, likes, retweets, location,
       sentiment, sentiment_score, "timestamp", day FROM posts"""),
    "hashtag_table": with_ctes("""
SELECT hashtag || '_' || lpad(CAST(9999999999999 - min("timestamp") AS VARCHAR), 13, '0') AS row_key, hashtag,
       count(*) AS total, CAST(coalesce(sum(likes), 0) AS BIGINT) AS likes_sum, min("timestamp") AS first_seen
FROM tags GROUP BY hashtag"""),
    "country_coordinates": with_ctes(f"""
SELECT c.code AS location, CAST(sum(g.cnt) AS BIGINT) AS cnt, any_value(c.lat) AS lat, any_value(c.lng) AS lng
FROM (SELECT location, count(*) AS cnt FROM posts WHERE location <> '' GROUP BY 1) g
JOIN nation n ON n.n_name = g.location
JOIN (VALUES {_COORDS}) c(i, code, lat, lng) ON c.i = n.n_nationkey % {len(COUNTRY_COORDS)}
GROUP BY c.code"""),
    "negative_countries_sql": with_ctes("""
SELECT location, posts, negative FROM (
  SELECT location, count(*) AS posts, count(*) FILTER (WHERE sentiment = 'negative') AS negative,
         sum(count(*) FILTER (WHERE sentiment = 'negative')) OVER () AS all_negative, sum(count(*)) OVER () AS all_posts
  FROM posts WHERE location <> '' GROUP BY location)
WHERE CAST(negative AS DOUBLE) > posts * (CAST(all_negative AS DOUBLE) / all_posts)"""),
    # ---- serving
    "recent_posts": with_ctes("SELECT * FROM feed", "," + FEED),
    "viral_posts": with_ctes("""
SELECT tweet_id, coalesce(text, '') AS text, likes, user_id FROM posts WHERE likes > 1000
ORDER BY likes DESC, tweet_id LIMIT 10"""),
    "viral_posts_by_key": with_ctes("""
SELECT tweet_id, coalesce(text, '') AS text, likes, user_id FROM posts WHERE likes > 1000
ORDER BY row_key, tweet_id LIMIT 10"""),
    "viral_filter": with_ctes("SELECT tweet_id, text, likes, user_id FROM posts WHERE likes > 1000"),
    "hashtag_search": with_ctes("""
SELECT row_key AS tweet_id, coalesce(text, '') AS text,
       list_filter(hashtags, lambda x: x IS NOT NULL AND x <> '') AS hashtags, coalesce(likes, 0) AS likes, location
FROM posts
WHERE contains(lower(array_to_string(list_filter(hashtags, lambda x: x IS NOT NULL AND x <> ''), ',')), '#sign')
ORDER BY row_key LIMIT 50"""),
    "hashtag_search_exact": with_ctes("""
SELECT row_key AS tweet_id, coalesce(text, '') AS text,
       list_filter(hashtags, lambda x: x IS NOT NULL AND x <> '') AS hashtags, coalesce(likes, 0) AS likes, location
FROM posts WHERE list_contains(list_transform(hashtags, lambda x: lower(x)), '#k1')
ORDER BY row_key LIMIT 50"""),
    "hashtag_history": with_ctes("""
SELECT hb AS hour, count(*) AS "count" FROM tags WHERE hashtag = '#click'
GROUP BY 1 ORDER BY hour DESC LIMIT 24"""),
    "trending_latest": with_ctes(f"""
SELECT hashtag, count(*) AS cnt FROM tags
WHERE "timestamp" >= {AS_OF} // {HOUR} * {HOUR} AND "timestamp" < {AS_OF} // {HOUR} * {HOUR} + {HOUR}
GROUP BY 1 ORDER BY cnt DESC, hashtag LIMIT 10"""),
    "trending_from_metrics": with_ctes("""
SELECT key AS hashtag, CAST(value AS BIGINT) AS cnt FROM metric_rows
WHERE metric = 'hashtag' AND bucket = (SELECT max(bucket) FROM metric_rows WHERE metric = 'hashtag')
ORDER BY cnt DESC, hashtag LIMIT 10""", METRICS),
    "hashtag_history_from_metrics": with_ctes("""
SELECT hb AS hour, count(*) AS "count" FROM tags WHERE hashtag = '#click'
GROUP BY 1 ORDER BY hour DESC LIMIT 24"""),
    "sentiment_timeline_from_metrics": with_ctes("SELECT * FROM tl", "," + _timeline(24)),
    "sentiment_stats_from_metrics": with_ctes("""
SELECT CAST(coalesce(sum(CASE WHEN key = 'positive' THEN value END), 0) AS BIGINT) AS positive,
       CAST(coalesce(sum(CASE WHEN key = 'neutral' THEN value END), 0) AS BIGINT) AS neutral,
       CAST(coalesce(sum(CASE WHEN key = 'negative' THEN value END), 0) AS BIGINT) AS negative
FROM metric_rows
WHERE metric = 'sentiment' AND bucket = (SELECT max(bucket) FROM metric_rows WHERE metric = 'sentiment')""",
                                             METRICS),
    "geo_from_metrics": with_ctes("""
SELECT key AS location, CAST(value AS BIGINT) AS cnt FROM metric_rows
WHERE metric = 'geo' AND bucket = (SELECT max(bucket) FROM metric_rows WHERE metric = 'geo')""", METRICS),
    "trending_ranked": with_ctes("""
SELECT hashtag, cnt, row_number() OVER (ORDER BY cnt DESC, hashtag) AS rank,
       coalesce(100.0 * cnt / nullif(max(cnt) OVER (), 0), 0.0) AS share_of_max
FROM top10""", "," + TOP10),
    "trending_filter": with_ctes("""
SELECT * FROM (
  SELECT hashtag, cnt, row_number() OVER (ORDER BY cnt DESC, hashtag) AS rank,
         coalesce(100.0 * cnt / nullif(max(cnt) OVER (), 0), 0.0) AS share_of_max
  FROM top10) WHERE contains(lower(hashtag), 'k')""", "," + TOP10),
    "sentiment_timeline": with_ctes("SELECT * FROM tl", "," + _timeline(24)),
    "sentiment_timeline_filled": with_ctes("""
SELECT s.hour, CAST(coalesce(tl.positive, 0) AS BIGINT) AS positive,
       CAST(coalesce(tl.neutral, 0) AS BIGINT) AS neutral, CAST(coalesce(tl.negative, 0) AS BIGINT) AS negative
FROM spine s LEFT JOIN tl USING (hour)""", "," + _timeline(24)),
    "top_users_served": with_ctes("""
SELECT user_id, total_tweets, total_likes, CAST(0 AS BIGINT) AS followers, last_active
FROM users_all ORDER BY total_tweets DESC, user_id LIMIT 10""", USERS_ALL),
    "user_detail": with_ctes("""
SELECT user_id, '' AS username, '' AS display_name, '' AS location, total_tweets, total_likes,
       CAST(0 AS BIGINT) AS followers, last_active, top_hashtags
FROM users_all WHERE user_id = 'user_7'""", USERS_ALL),
    "feed_kpis": with_ctes("""
SELECT count(*) FILTER (WHERE sentiment = 'positive') AS positive,
       count(*) FILTER (WHERE sentiment = 'neutral') AS neutral,
       count(*) FILTER (WHERE sentiment = 'negative') AS negative, count(*) AS total,
       CAST(coalesce(round(100.0 * count(*) FILTER (WHERE sentiment = 'positive') / nullif(count(*), 0)), 0) AS BIGINT)
         AS positivity_rate
FROM feed""", "," + FEED),
    "feed_authors": with_ctes("""
SELECT row_key AS tweet_id,
       'User ' || CASE WHEN len(string_split(row_key, '_')) > 2 THEN string_split(row_key, '_')[3] ELSE '1' END
         AS display_name,
       '@user_' || CASE WHEN len(string_split(row_key, '_')) > 2 THEN string_split(row_key, '_')[3] ELSE '1' END
         AS handle
FROM posts"""),
    "feed_search": with_ctes("""
SELECT row_key AS tweet_id, text, hashtags, likes, retweets, location, sentiment FROM posts
WHERE coalesce(contains(lower(text), 'nation_1'), false)
   OR contains(lower('User ' || string_split(row_key, '_')[3]), 'nation_1')
   OR coalesce(contains(lower(location), 'nation_1'), false)
   OR coalesce(list_bool_or(list_transform(hashtags, lambda h: contains(lower(h), 'nation_1'))), false)"""),
    "text_search": with_ctes("""
SELECT row_key AS tweet_id, text, hashtags, likes, retweets, location, sentiment FROM posts
WHERE coalesce(contains(lower(text), 'user 77'), false)
   OR contains(lower('User ' || string_split(row_key, '_')[3]), 'user 77')
   OR coalesce(contains(lower(location), 'user 77'), false)
   OR coalesce(list_bool_or(list_transform(hashtags, lambda h: contains(lower(h), 'user 77'))), false)"""),
    "feed_filter": with_ctes("""
SELECT row_key AS tweet_id, text, hashtags, likes, retweets, location, sentiment FROM posts
WHERE (coalesce(contains(lower(text), 'click'), false)
   OR contains(lower('User ' || string_split(row_key, '_')[3]), 'click')
   OR coalesce(contains(lower(location), 'click'), false)
   OR coalesce(list_bool_or(list_transform(hashtags, lambda h: contains(lower(h), 'click'))), false))
  AND sentiment = 'negative'"""),
    # ---- documented metrics
    "volume_per_minute": with_ctes(f"""
SELECT strftime(make_timestamp("timestamp" * 1000), '%Y%m%d%H%M') AS minute, count(*) AS cnt
FROM posts WHERE "timestamp" >= {AS_OF} - {HOUR} GROUP BY 1"""),
    "hashtag_usage": with_ctes(f"""
SELECT hashtag, count(*) AS uses_total,
       count(*) FILTER (WHERE "timestamp" >= {AS_OF} - {HOUR} AND "timestamp" <= {AS_OF}) AS uses_last_hour,
       count(*) FILTER (WHERE "timestamp" >= {AS_OF} - {DAY} AND "timestamp" <= {AS_OF}) AS uses_last_day
FROM tags GROUP BY hashtag"""),
    "hashtag_engagement": with_ctes("""
SELECT hashtag, CAST(coalesce(sum(likes), 0) AS BIGINT) AS total_likes,
       CAST(coalesce(sum(retweets), 0) AS BIGINT) AS total_retweets
FROM tags GROUP BY hashtag"""),
    "hashtag_first_peak": with_ctes("""
SELECT hashtag, min(first_ts) AS first_seen, arg_min(hour_of_day, (-cnt, hour_of_day)) AS peak_hour,
       max(cnt) AS peak_hour_uses
FROM (SELECT hashtag, CAST(hour(make_timestamp("timestamp" * 1000)) AS INTEGER) AS hour_of_day,
             count(*) AS cnt, min("timestamp") AS first_ts
      FROM tags GROUP BY 1, 2)
GROUP BY hashtag"""),
    "user_avg_daily": with_ctes("""
SELECT user_id, strftime(make_timestamp(day_num * 86400000 * 1000), '%Y-%m-%d') AS day, posts,
       sum(posts) OVER (PARTITION BY user_id ORDER BY day_num RANGE BETWEEN 6 PRECEDING AND CURRENT ROW) / 7.0
         AS avg_posts_7d
FROM (SELECT user_id, CAST(floor("timestamp" / 86400000) AS BIGINT) AS day_num, count(*) AS posts
      FROM posts GROUP BY 1, 2)"""),
    "trending_by_hour": with_ctes("""
SELECT * FROM (
  SELECT hb AS bucket, hashtag, count(*) AS cnt,
         row_number() OVER (PARTITION BY hb ORDER BY count(*) DESC, hashtag) AS rank
  FROM tags GROUP BY 1, 2) WHERE rank <= 10"""),
    # ---- streaming (same answer as the batch form over finished windows)
    "stream_hourly_hashtags": with_ctes(f"""
SELECT strftime(make_timestamp("timestamp" // {HOUR} * {HOUR} * 1000), '%Y%m%d%H') AS bucket,
       hashtag, count(*) AS cnt
FROM tags
WHERE "timestamp" // {HOUR} * {HOUR} + {HOUR} <= (SELECT max("timestamp") FROM tweets) - 600000
GROUP BY 1, 2"""),
    "stream_json_ingest": with_ctes(f"""
SELECT strftime(make_timestamp(t."timestamp" // {HOUR} * {HOUR} * 1000), '%Y%m%d%H') AS bucket,
       t.hashtag, count(*) AS cnt
FROM tags t
WHERE t."timestamp" // {HOUR} * {HOUR} + {HOUR} <= (SELECT max("timestamp") FROM tweets) - 600000
GROUP BY 1, 2"""),
    "stream_metric_rows": with_ctes("""
SELECT 'hashtag' AS metric, strftime(make_timestamp("timestamp" // 10000 * 10000 * 1000), '%Y%m%d%H%M%S') AS bucket,
       hashtag AS key, count(*) AS value, CAST(NULL AS VARCHAR) AS text, CAST(NULL AS VARCHAR) AS user_id
FROM tags GROUP BY 2, 3
UNION ALL
SELECT 'sentiment', strftime(make_timestamp("timestamp" // 10000 * 10000 * 1000), '%Y%m%d%H%M%S'), sentiment, count(*), NULL, NULL
FROM posts GROUP BY 2, 3
UNION ALL
SELECT 'viral', strftime(make_timestamp("timestamp" // 10000 * 10000 * 1000), '%Y%m%d%H%M%S'), tweet_id,
       CAST(likes AS BIGINT), coalesce(text, ''), user_id
FROM posts WHERE likes > 1000"""),
    "stream_post_table": with_ctes("""
SELECT row_key, salt, user_id, rev_ts, tweet_id, text, hashtags, likes, retweets, location,
       sentiment, sentiment_score, "timestamp", day FROM posts"""),
    "stream_rejects": with_ctes("SELECT '{broken ' || tweet_id AS value, count(*) AS cnt FROM tweets WHERE text IS NULL GROUP BY tweet_id"),
    "stream_sentiment_counts": with_ctes("SELECT sentiment, count(*) AS cnt FROM posts GROUP BY sentiment"),
    "stream_alerts": with_ctes("""
SELECT tweet_id, user_id, likes, "timestamp" FROM posts WHERE likes > 1000"""),
}

# The same answers from stored rows.
for _name in ("hashtag_usage", "hashtag_engagement", "hashtag_first_peak", "hashtag_table"):
    ORACLE[f"{_name}_from_states"] = ORACLE[_name]
