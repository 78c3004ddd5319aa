"""Sentiment scorer: fixture expectations, both physical forms, hooks."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_MID
from pulse.operators.sentiment import default_lexicon, default_modifiers, lexicon_frame, score_sentiment
from pulse.plans import batch
from pulse.sources import fixture

# FIXTURES.md §4: event_id % 9 -> (score, label)
EXPECTED = {0: (0.75, "positive"), 1: (0.0, "neutral"), 2: (-0.5, "negative"), 3: (-0.375, "negative"),
            4: (0.5, "positive"), 5: (0.0, "neutral"), 6: (-0.875, "negative"), 7: (0.0, "neutral"),
            8: (0.0, "neutral")}


def test_fixture_scores(spark):
    scored = batch.enrich(fixture.tweets(spark, SF_MID))
    got = (scored.groupBy((F.col("tweet_id").cast("long") % 9).alias("m"))
           .agg(F.collect_set(F.struct("sentiment_score", "sentiment")).alias("s")).collect())
    for r in got:
        assert [tuple(x) for x in r.s] == [EXPECTED[r.m]]


def test_map_and_join_forms_agree(spark):
    t = fixture.tweets(spark, SF_MID).select("tweet_id", "text")
    a = score_sentiment(t, method="map").select("tweet_id", "sentiment", "sentiment_score")
    b = score_sentiment(t, method="join").select("tweet_id", "sentiment", "sentiment_score")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_join_form_on_long_documents(spark):
    docs = fixture.read_table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    a = score_sentiment(docs, method="map").select("doc_id", "sentiment_score")
    b = score_sentiment(docs, method="join").select("doc_id", "sentiment_score")
    assert a.exceptAll(b).count() == 0


@pytest.mark.parametrize("text,score", [
    (None, 0.0), ("", 0.0), ("nothing here", 0.0), ("Great!!! LOVE", 0.625),
    ("never terrible", 0.5), ("not not great", -0.375), ("great not", 0.75),
])
def test_scores(spark, text, score):
    df = spark.createDataFrame([(text,)], "text string")
    assert score_sentiment(df).collect()[0].sentiment_score == score


def test_custom_lexicon_and_clamp(spark):
    df = spark.createDataFrame([("very good",)], "text string")
    out = score_sentiment(df, lexicon={"good": 0.8}, modifiers={"very": 1.5}).collect()[0]
    assert out.sentiment_score == 1.0 and out.sentiment == "positive"


def test_map_form_is_row_local(spark):
    plan = score_sentiment(fixture.tweets(spark, SF_MID).select("tweet_id", "text"))._jdf \
        .queryExecution().executedPlan().toString()
    # The only exchanges come from spreading the one-split scan, none from scoring.
    assert "HashAggregate" not in plan and "SortMergeJoin" not in plan


def test_forms_agree_on_null_and_repeated_rows_and_repeated_terms(spark):
    df = spark.createDataFrame([(None, "good"), ("a", "good"), ("a", "bad"), ("a", "good"), ("b", None), ("c", "none")],
                               "id string, text string")
    lex = spark.createDataFrame([("good", 0.5), ("good", 1.0), ("bad", -0.75)], "term string, polarity double")
    rows = [sorted(map(tuple, score_sentiment(df, lexicon=lex, method=m).fillna("").collect())) for m in ("map", "join")]
    assert rows[0] == rows[1] and ("", "good", "positive", 0.75) in rows[0] and rows[0].count(("a", "good", "positive", 0.75)) == 2


def test_the_form_does_not_depend_on_the_size_of_the_lexicon(spark):
    words = {**{f"w{i}": 0.25 for i in range(2_500)}, **default_lexicon()}
    t = fixture.tweets(spark, "/root/testdata/sf0.001").select("tweet_id", "text")
    small = score_sentiment(t).select("tweet_id", "sentiment_score")
    for method in ("map", "join"):
        big = score_sentiment(t, lexicon=lexicon_frame(spark, words), method=method)
        assert ("Join" in big.select("sentiment_score")._jdf.queryExecution().optimizedPlan().toString().split("events")[0]) or method == "map"
        assert big.select("tweet_id", "sentiment_score").exceptAll(small).count() == 0
    with pytest.raises(ValueError):
        score_sentiment(t, method="auto")


def test_words_are_unicode_and_intensified(spark):
    df = spark.createDataFrame([("ähate",), ("sehr gut",), ("c'était très mauvais",), ("not awful",)], "text string")
    got = [r.sentiment_score for r in score_sentiment(df).collect()]
    assert got == [0.0, 0.65, -0.65, 0.5]
    assert len(default_lexicon()) > 200 and not set(default_lexicon()) & set(default_modifiers())


def test_documents_have_all_labels(spark):
    docs = fixture.read_table(spark, SF_MID, "documents")
    assert {r.sentiment for r in score_sentiment(docs).select("sentiment").distinct().collect()} == {"positive", "negative", "neutral"}
