"""Index searches give the rows of the scans, and read the table for what they found only."""

import os
import random

import pytest

from conftest import SF_SMALL
from pulse.plans import batch, search_index, serving, store, stored

SCHEMA = "tweet_id string, user_id string, text string, hashtags array<string>, likes int, retweets int, timestamp long, location string"


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    rng, base = random.Random(3), str(tmp_path_factory.mktemp("search"))
    words = ["Straße", "great", "NOT", "a", "", "été 😀", "aaa", "aa", "x" * 30, "User", None]
    rows = [(str(i), f"user_{rng.randint(1, 30)}", rng.choice(words) if rng.random() < 0.2 else " ".join(rng.choice(words) or "" for _ in range(3)),
             rng.choice([None, [], ["#A"], ["#ab", "#a"], ["#ÉTÉ", "", None], ["#hot"], ["#hot", "#cold", "#hot"]]), rng.choice([None, 5]), 1,
             1_704_067_200_000 + rng.randint(0, 20) * 7_200_000 + i, rng.choice(["", "NATION_1", "Österreich", None])) for i in range(300)]
    posts = store.stored_posts(batch.enrich(spark.createDataFrame(rows, SCHEMA)))
    store.write_post_table(posts, f"{base}/posts")
    posts = store.read_post_table(spark, f"{base}/posts")
    search_index.write_tag_index(posts, f"{base}/tags")
    search_index.write_text_index(posts, f"{base}/grams")
    return base, posts


def _rows(df):
    return sorted(map(str, df.collect()))


def test_tag_search_equals_the_scan(spark, table):
    base, posts = table
    for q in ("#a", "A", "#AB", "été", "hot", "o", "#none", "#hot,#cold", "t,#", ""):
        for exact in (False, True):
            got = search_index.hashtag_search(spark, f"{base}/tags", posts, q, 20, exact)
            assert _rows(got) == _rows(serving.hashtag_search(posts, q, 20, exact)), (q, exact)


def test_text_search_equals_the_scan_for_queries_of_any_length(spark, table):
    base, posts = table
    feed = posts.selectExpr("row_key AS tweet_id", "text", "hashtags", "likes", "retweets", "location", "sentiment")
    for q in ("a", "aa", "aaa", "AAA ", "not a", "straß", "user 1", "User 12 ", "nation", "öster", "été 😀 ", "xxxxxxxxxx", "#cold", "zzz", "great not"):
        got = search_index.text_search(spark, f"{base}/grams", posts, q)
        assert _rows(got) == _rows(serving.feed_search(feed, q)), q


def test_trigrams_of_a_query():
    assert search_index.query_grams("AbaBab") == ["aba", "bab"] and search_index.query_grams("ab") == []


def test_searches_read_postings_and_found_posts(spark):
    posts = stored.posts(spark, SF_SMALL)
    df = search_index.hashtag_search(spark, stored.tag_index(spark, SF_SMALL), posts, "#k1", exact=True)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "In(row_key" in plan and "day#" in plan.split("PartitionFilters: ")[1].split("PushedFilters")[0]
    places = search_index.tag_places(spark, stored.tag_index(spark, SF_SMALL), "#K", False)
    assert "hashtags" not in places._jdf.queryExecution().executedPlan().toString()
    found = search_index.candidates(spark, stored.text_index(spark, SF_SMALL), "user 77")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "In(gram" in plan and "partial_count" in plan


def test_empty_table(spark, tmp_dir):
    empty = store.stored_posts(batch.enrich(spark.createDataFrame([], SCHEMA)))
    tags, grams = os.path.join(tmp_dir, "t"), os.path.join(tmp_dir, "g")
    search_index.write_tag_index(empty, tags)
    search_index.write_text_index(empty, grams)
    assert search_index.hashtag_search(spark, tags, empty, "#a").collect() == []
    assert search_index.text_search(spark, grams, empty, "abc").collect() == []
