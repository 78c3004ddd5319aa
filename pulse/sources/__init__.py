"""Readers: the posts fixture derived from the driver tables, JSON posts, the post table, streams."""

from pulse.sources.fixture import read_table, tweets
from pulse.sources.posts import normalize_posts, parse_posts, to_payload

__all__ = ["read_table", "tweets", "normalize_posts", "parse_posts", "to_payload"]
