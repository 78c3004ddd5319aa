"""Tag states merge in any order and give the answers of the scans."""

import os
import random

import pytest
from pyspark.sql import functions as F

from pulse.operators import aggregates as agg
from pulse.plans import batch, store, tag_states
from pulse.schemas import HASHTAG_ROW

T0, HOUR = 1_704_067_200_000, 3_600_000
SCHEMA = "tweet_id string, user_id string, text string, hashtags array<string>, likes int, retweets int, timestamp long, location string"


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    rng, path = random.Random(2), str(tmp_path_factory.mktemp("states"))
    times = [T0 + h * HOUR + d for h in range(0, 60, 3) for d in (0, 1, HOUR // 2, HOUR - 1)] + [T0 + rng.randint(0, 60 * HOUR) for _ in range(400)]
    rows = [(str(i), "u", "t", rng.choice([None, [], ["#a"], ["#a", "#b"], ["#c", "", "#c"], [None]]), rng.choice([None, 3, 9]),
             rng.choice([None, 1]), t, "X") for i, t in enumerate(times)]
    store.write_post_table(store.stored_posts(batch.enrich(spark.createDataFrame(rows, SCHEMA))), f"{path}/posts")
    posts = store.read_post_table(spark, f"{path}/posts")
    tag_states.write_tag_states(tag_states.tag_states(posts), f"{path}/states")
    return posts, tag_states.read_tag_states(spark, f"{path}/states"), path


def _rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def test_metrics_from_states_equal_the_scans(table):
    posts, states, _ = table
    assert _rows(tag_states.hashtag_engagement(states)) == _rows(agg.hashtag_engagement(posts))
    assert _rows(tag_states.hashtag_first_peak(states)) == _rows(agg.hashtag_first_peak(posts))
    assert _rows(tag_states.hashtag_table(states)) == _rows(store.hashtag_rows(posts).select(*HASHTAG_ROW.names))


def test_states_of_parts_add_up_in_any_order(table):
    posts, states, _ = table
    parts = [tag_states.tag_states(posts.filter(F.pmod(F.xxhash64("tweet_id"), F.lit(3)) == k)) for k in (2, 0, 1)]
    merged = tag_states.merge(parts[0].union(parts[1]), "bucket", "day").select(*states.columns).union(parts[2])
    assert _rows(tag_states.merge(merged)) == _rows(tag_states.merge(states))


@pytest.mark.parametrize("as_of", [0, 1, HOUR - 1, 30 * HOUR, 30 * HOUR - 1, 30 * HOUR + 1, 41 * HOUR + 1_234_567, 59 * HOUR + HOUR // 2, 90 * HOUR])
def test_usage_in_windows_that_end_anywhere(table, as_of):
    posts, states, _ = table
    assert _rows(tag_states.hashtag_usage(states, posts, T0 + as_of)) == _rows(agg.hashtag_usage(posts, T0 + as_of))


def test_only_edge_hours_of_the_posts_are_read_and_a_day_is_replaced(spark, table, tmp_dir):
    posts, states, path = table
    df = tag_states.hashtag_usage(states, posts, T0 + 41 * HOUR + 5)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(timestamp" in plan and "LessThanOrEqual(timestamp" in plan and "PartitionFilters: [isnotnull(day" in plan
    copy = os.path.join(tmp_dir, "states")
    tag_states.write_tag_states(states, copy)
    tag_states.write_tag_states(tag_states.tag_states(posts.filter("day = '2024-01-02'")), copy)
    assert _rows(tag_states.read_tag_states(spark, copy)) == _rows(states)
