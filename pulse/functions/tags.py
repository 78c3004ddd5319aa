"""Hashtag list helpers: the list is an array everywhere, text only at the edges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TAG_SEPARATOR = ","


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def clean_tags(tags="hashtags") -> Column:
    """Drop null and empty tags; a null list stays null."""
    return F.filter(_c(tags), lambda x: x.isNotNull() & (x != ""))


def join_tags(tags="hashtags") -> Column:
    """Array -> comma text (storage form).  A null list becomes ''."""
    return F.coalesce(F.concat_ws(TAG_SEPARATOR, _c(tags)), F.lit(""))


def split_tags(text="hashtags") -> Column:
    """Comma text -> array without empty items (``''`` -> empty array)."""
    return F.filter(F.split(F.coalesce(_c(text), F.lit("")), TAG_SEPARATOR),
                    lambda x: x != "")
