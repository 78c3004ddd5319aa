"""Cross-query properties and key round trips."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import SF_SMALL
from pulse.functions.keys import parse_row_key, row_key
from pulse.operators import aggregates as agg
from pulse.plans import batch, serving
from pulse.sources import fixture


def test_geo_sums_agree(spark):
    posts = batch.stored_posts(spark, SF_SMALL).cache()
    with_country = posts.filter(F.col("location") != "").count()
    s1 = agg.geo_sentiment(posts).agg(F.sum("cnt")).first()[0]
    s2 = agg.geo_totals(posts).agg(F.sum("cnt")).first()[0]
    grand = agg.geo_rollup(posts).filter(F.col("location").isNull()).first().cnt
    assert s1 == s2 == grand == with_country
    posts.unpersist()


def test_timeline_sums_match_window_counts(spark):
    posts = batch.stored_posts(spark, SF_SMALL)
    as_of = fixture.max_timestamp(spark, SF_SMALL)
    tl = serving.sentiment_timeline_filled(posts, as_of, 168).collect()
    assert len(tl) == 168
    total = sum(r.positive + r.neutral + r.negative for r in tl)
    lo = (as_of // 3_600_000 + 1) * 3_600_000 - 168 * 3_600_000
    assert total == posts.filter(F.col("timestamp") >= lo).count()


def test_label_counts_sum_to_total(spark):
    posts = batch.stored_posts(spark, SF_SMALL)
    r = agg.label_counts_row(posts).first()
    assert r.positive + r.neutral + r.negative == r.total == posts.count()


@settings(max_examples=25, deadline=None)
@given(users=st.lists(st.from_regex(r"[a-z0-9_]{1,12}", fullmatch=True), min_size=1, max_size=5),
       ts=st.integers(min_value=0, max_value=9_999_999_999_998))
def test_key_roundtrip_property(spark, users, ts):
    df = spark.createDataFrame([(u, ts) for u in users], "user_id string, timestamp long")
    for r in df.select("user_id", parse_row_key(row_key()).alias("p")).collect():
        assert r.p is not None and r.p.user_id == r.user_id and r.p.rev_ts == 9_999_999_999_999 - ts


_WORDS = ["great", "love", "broken", "terrible", "hate", "not", "no", "never", "day", "it's",
          "GREAT", "Hate!", "#love", "", " ", ",", "n't", "nevermind"]


@settings(max_examples=20, deadline=None)
@given(texts=st.lists(st.one_of(st.none(), st.lists(st.sampled_from(_WORDS), max_size=12)
                                .map(" ".join)), min_size=1, max_size=8))
def test_sentiment_forms_agree_property(spark, texts):
    from pulse.operators.sentiment import score_sentiment
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, text string")
    a = {r.id: (r.sentiment, r.sentiment_score) for r in score_sentiment(df, method="map").collect()}
    b = {r.id: (r.sentiment, r.sentiment_score)
         for r in score_sentiment(df, method="join").collect()}
    assert a == b
    assert all(-1.0 <= s <= 1.0 for _, s in a.values())
