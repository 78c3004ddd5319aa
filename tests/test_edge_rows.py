"""Hand-made edge rows (FIXTURES.md §5)."""

from pyspark.sql import Row
from pyspark.sql import functions as F

from pulse.functions.keys import parse_row_key, row_key
from pulse.functions.tags import split_tags
from pulse.operators import aggregates as agg
from pulse.operators.sentiment import label
from pulse.plans import serving, store
from pulse.schemas import RAW_POST
from pulse.sources.posts import normalize_posts, parse_posts

HOUR = 3_600_000
DAY = 86_400_000


def _posts(spark, rows):
    return spark.createDataFrame([Row(**{f.name: r.get(f.name) for f in RAW_POST.fields}) for r in rows],
                                 RAW_POST)


def test_malformed_json_goes_to_rejects(spark):
    good = '{"tweet_id": "1", "user_id": "u", "timestamp": 7, "likes": 5}'
    unkeyed = ['{"tweet_id": "2", "user_id": "u"}', '{"tweet_id": "3", "timestamp": 7}']
    msgs = spark.createDataFrame([(m,) for m in [good, "not json", "{}", *unkeyed]], "value string")
    posts, rejects = parse_posts(msgs)
    assert [r.tweet_id for r in posts.collect()] == ["1"]
    assert sorted(r.value for r in rejects.collect()) == sorted(["not json", "{}", *unkeyed])


def test_messages_are_parsed_once(spark):
    posts, _ = parse_posts(spark.range(3).selectExpr("cast(id AS string) AS value"))
    plan = posts._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1


def test_wrong_type_nulls_only_that_field(spark):
    msgs = spark.createDataFrame([('{"tweet_id": "7", "user_id": "user_1", "timestamp": 1, "likes": "oops", "retweets": 3}',)],
                                 "value string")
    posts, rejects = parse_posts(msgs)
    row = posts.collect()[0]
    assert row.tweet_id == "7" and row.user_id == "user_1" and row.likes is None and row.retweets == 3
    assert rejects.count() == 0


def test_viral_threshold_is_strict_and_null_safe(spark):
    df = _posts(spark, [dict(tweet_id="a", likes=1000), dict(tweet_id="b", likes=1001),
                        dict(tweet_id="c", likes=None)])
    assert [r.tweet_id for r in serving.viral_filter(df).collect()] == ["b"]


def test_label_bounds(spark):
    df = spark.createDataFrame([(0.1,), (-0.1,), (0.1001,), (-0.1001,), (0.0,)], "s double")
    got = [r.l for r in df.select(label("s").alias("l")).collect()]
    assert got == ["neutral", "neutral", "positive", "negative", "neutral"]


def test_row_key_parse(spark):
    df = spark.createDataFrame([("3_user_42853_9999781234567",), ("x",), ("3_user_1_abc",),
                                ("1_a_b_c_0000000000012",), ("_x_1",)], "k string")
    got = [tuple(r.p) if r.p else None for r in df.select(parse_row_key("k").alias("p")).collect()]
    assert got == [(3, "user_42853", 9999781234567), None, None, (1, "a_b_c", 12), None]


def test_row_key_build_parse_roundtrip(spark):
    df = spark.createDataFrame([("user_5", 1704067200123), ("user_x_y", 0)], "user_id string, timestamp long")
    out = df.select(parse_row_key(row_key()).alias("p"), "user_id", "timestamp").collect()
    for r in out:
        assert r.p.user_id == r.user_id
        assert r.p.rev_ts == 9_999_999_999_999 - r.timestamp
        assert 0 <= r.p.salt < 10


def test_window_cutoff_inclusive(spark):
    as_of = 1_706_000_000_000
    df = _posts(spark, [dict(tweet_id="kept", timestamp=as_of - HOUR),
                        dict(tweet_id="dropped", timestamp=as_of - HOUR - 1),
                        dict(tweet_id="future", timestamp=as_of + 5)])
    got = sorted(r.tweet_id for r in store.posts_in_window(df, as_of, HOUR).collect())
    assert got == ["future", "kept"]


def test_ties_at_the_limit_prefer_smaller_key(spark):
    df = _posts(spark, [dict(tweet_id=str(i), hashtags=[t]) for i, t in
                        enumerate(["#b", "#a", "#c", "#c"])])
    got = [(r.hashtag, r.cnt) for r in agg.top_hashtags(df, 2).collect()]
    assert got == [("#c", 2), ("#a", 1)]


def test_empty_and_null_tags_are_skipped(spark):
    df = _posts(spark, [dict(tweet_id="1", hashtags=["", "#x", None]), dict(tweet_id="2", hashtags=None),
                        dict(tweet_id="3", hashtags=[])])
    assert [(r.hashtag, r.cnt) for r in agg.hashtag_counts(df).collect()] == [("#x", 1)]
    t = spark.createDataFrame([("",), ("#a,,#b",)], "s string").select(split_tags("s").alias("t")).collect()
    assert [r.t for r in t] == [[], ["#a", "#b"]]


def test_search_is_case_insensitive_substring(spark):
    df = _posts(spark, [dict(tweet_id="1", user_id="user_1", timestamp=1, hashtags=["#Ab"]),
                        dict(tweet_id="2", user_id="user_2", timestamp=2, hashtags=["#b"])])
    posts = store.stored_posts(df.withColumn("sentiment", F.lit("neutral"))
                                 .withColumn("sentiment_score", F.lit(0.0)))
    assert serving.hashtag_search(posts, "#a").count() == 1
    assert serving.hashtag_search(posts, "#a", exact=True).count() == 0
    assert serving.hashtag_search(posts, "#AB", exact=True).count() == 1


def test_retention(spark):
    as_of = 1_706_000_000_000
    rows = spark.createDataFrame(
        [("geo", "2024010100", "X", 1)], "metric string, bucket string, key string, value long")
    start = 1_704_067_200_000    # 2024-01-01 00:00 UTC
    kept = store.apply_metric_retention(rows, start + 2 * DAY)
    gone = store.apply_metric_retention(rows, start + 2 * DAY + 1000)
    assert kept.count() == 1 and gone.count() == 0
    posts = spark.createDataFrame([("1", as_of - 90 * DAY, "positive", 0.5),
                                   ("2", as_of - 90 * DAY - 1000, "positive", 0.5)],
                                  "tweet_id string, timestamp long, sentiment string, sentiment_score double")
    out = {r.tweet_id: r for r in store.apply_post_retention(posts, as_of).collect()}
    assert out["1"].sentiment == "positive"
    assert out["2"].sentiment is None and out["2"].sentiment_score is None   # row kept, cells gone


def test_users_upsert_per_cell(spark):
    old = spark.createDataFrame([("u_old", 1, 10, "2024010100"), ("u_both", 2, 20, "2024010100")],
                                "user_id string, total_tweets long, total_likes long, last_active string")
    new = spark.createDataFrame([("u_new", 5, None, "2024010200"), ("u_both", 7, None, "2024010200")],
                                "user_id string, total_tweets long, total_likes long, last_active string")
    got = {r.user_id: r for r in store.upsert_users(old, new).collect()}
    assert got["u_old"].total_tweets == 1
    assert got["u_new"].total_tweets == 5
    assert got["u_both"].total_tweets == 7 and got["u_both"].total_likes == 20   # missing cell kept
    assert got["u_both"].last_active == "2024010200"


def test_normalize_defaults(spark):
    df = _posts(spark, [dict(tweet_id="1")])
    r = normalize_posts(df).collect()[0]
    assert (r.text, r.likes, r.retweets, r.location, r.hashtags) == ("", 0, 0, "", [])


def test_served_shapes(spark):
    users = spark.createDataFrame([("u1", 3, None)], "user_id string, total_tweets long, total_likes long")
    top = serving.top_users(users, 10).collect()[0]
    assert (top.total_tweets, top.total_likes, top.followers, top.last_active) == (3, 0, 0, "")
    assert serving.user_detail(users, "missing").count() == 0
    detail = serving.user_detail(users, "u1").collect()[0]
    assert detail.top_hashtags == [] and detail.followers == 0
