"""Indexes over the post table: tags (a dictionary and postings) and texts (trigrams).

A posting names a post by key, id and day, so fetching it prunes days and skips files by
key statistics.  Postings are range-partitioned and sorted by their term: a term's
postings are read by statistics, and a term that a third of all posts have is cut into several files.

* Tags: a query that is part of a tag is looked for among the distinct tags only; the postings of those that
  match, in key order, give the first posts, and just these are read from the table.
* Texts: whatever holds the query holds all its trigrams, so posts that have them all, in any searched
  field, are candidates; they are read and held against the query itself.

Queries that the indexes cannot answer scan the table, with the same result: an empty tag query (posts without
tags match it, too) or one with the separator of joined tags in it, and a text query of fewer than three characters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulse.functions.tags import TAG_SEPARATOR, clean_tags
from pulse.functions.text import user_label
from pulse.plans import serving
from pulse.sources.posts import normalize_posts

GRAM = 3
TAG_POSTING = "tag string, row_key string, tweet_id string, day string"
TAG_ROW = "tag string, posts long"
GRAM_POSTING = "gram string, row_key string, tweet_id string, day string"
PLACE = ("row_key", "tweet_id", "day")


# ---- tags ----------------------------------------------------------------------------------

def write_tag_index(posts: DataFrame, path: str) -> None:
    """Postings (a row per post and distinct tag, lower-cased) and the dictionary of distinct tags."""
    tags = posts.select(*PLACE, F.explode(F.array_distinct(F.transform(clean_tags("hashtags"), F.lower))).alias("tag"))
    (tags.select("tag", *PLACE).repartitionByRange("tag", "row_key").sortWithinPartitions("tag", "row_key")
         .write.mode("overwrite").parquet(f"{path}/postings"))
    stored = posts.sparkSession.read.schema(TAG_POSTING).parquet(f"{path}/postings")
    stored.groupBy("tag").agg(F.count(F.lit(1)).alias("posts")).write.mode("overwrite").parquet(f"{path}/tags")


def tag_places(spark: SparkSession, path: str, hashtag: str, exact: bool = False) -> DataFrame:
    """Places of the posts with a tag that holds ``hashtag`` (``exact``: that is it), in any case, each once."""
    q, tag = hashtag.lower(), F.col("tag")
    postings = spark.read.schema(TAG_POSTING).parquet(f"{path}/postings")
    if exact:
        return postings.filter(tag == q).select(*PLACE)
    matching = spark.read.schema(TAG_ROW).parquet(f"{path}/tags").filter(tag.contains(q)).select("tag")
    return postings.join(matching, "tag", "left_semi").select(*PLACE).distinct()


def hashtag_search(spark: SparkSession, path: str, posts: DataFrame, hashtag: str, limit: int = serving.SEARCH_LIMIT,
                   exact: bool = False) -> DataFrame:
    """:func:`pulse.plans.serving.hashtag_search` over the index: the table is read for the posts found only."""
    if not exact and (not hashtag or TAG_SEPARATOR in hashtag):
        return serving.hashtag_search(posts, hashtag, limit)
    first = tag_places(spark, path, hashtag, exact).orderBy("row_key", "tweet_id").limit(limit).collect()     # at most ``limit`` places
    found = posts.filter(F.col("day").isin(sorted({r.day for r in first})) & F.col("row_key").isin(sorted({r.row_key for r in first}))
                         & F.col("tweet_id").isin(sorted({r.tweet_id for r in first})))
    places = spark.createDataFrame([tuple(r) for r in first], "row_key string, tweet_id string, day string")
    found = found.join(F.broadcast(places), list(PLACE), "left_semi").orderBy("row_key")      # at most ``limit`` places
    return normalize_posts(found).select(F.col("row_key").alias("tweet_id"), "text", "hashtags", "likes", "location")


# ---- texts ---------------------------------------------------------------------------------

def _searched() -> list[Column]:
    """The fields that a text search looks at, as the search sees them."""
    return [F.lower("text"), F.lower(user_label("row_key")), F.lower("location")]


def _grams(text: Column) -> Column:
    """All substrings of three characters."""
    n = F.char_length(text)
    return F.when(n >= GRAM, F.transform(F.sequence(F.lit(1), n - GRAM + 1), lambda i: F.substring(text, i, F.lit(GRAM))))


def write_text_index(posts: DataFrame, path: str) -> None:
    """Postings per trigram of a post's text, author label, country and tags."""
    fields = F.array_compact(F.concat(F.array(*_searched()), F.coalesce(F.transform("hashtags", F.lower), F.array().cast("array<string>"))))
    grams = F.array_distinct(F.flatten(F.array_compact(F.transform(fields, _grams))))
    (posts.select(F.explode(grams).alias("gram"), *PLACE).repartitionByRange("gram", "row_key").sortWithinPartitions("gram", "row_key")
          .write.mode("overwrite").parquet(path))


def query_grams(query: str) -> list[str]:
    q = query.lower()
    return sorted({q[i:i + GRAM] for i in range(len(q) - GRAM + 1)})


def candidates(spark: SparkSession, path: str, query: str) -> DataFrame:
    """Places of the posts that have all trigrams of the query."""
    grams = query_grams(query)
    postings = spark.read.schema(GRAM_POSTING).parquet(path).filter(F.col("gram").isin(grams))
    return postings.groupBy(*PLACE).agg(F.count_distinct("gram").alias("n")).filter(F.col("n") == len(grams)).select(*PLACE)


def text_search(spark: SparkSession, path: str, posts: DataFrame, query: str) -> DataFrame:
    """Posts that hold ``query`` in any case in text, author label, country or a tag, as :func:`pulse.plans.serving.feed_search`."""
    if len(query) >= GRAM:
        posts = posts.join(candidates(spark, path, query), list(PLACE), "left_semi")
    feed = posts.select(F.col("row_key").alias("tweet_id"), "text", "hashtags", "likes", "retweets", "location", "sentiment")
    return serving.feed_search(feed, query)
