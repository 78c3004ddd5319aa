"""Text predicates and display helpers used by search and the feed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def contains_ci(col, needle: str) -> Column:
    """Case-insensitive substring test (null input -> false)."""
    return F.coalesce(F.lower(_c(col)).contains(needle.lower()), F.lit(False))


def user_number(key="row_key") -> Column:
    """Third ``_`` part of a post key (the numeric user id); ``'1'`` when absent."""
    part = F.element_at(F.split(_c(key), "_"), 3)
    return F.coalesce(F.when(F.size(F.split(_c(key), "_")) > 2, part), F.lit("1"))


def user_label(key="row_key") -> Column:
    """Display name ``User N`` derived from the key."""
    return F.concat(F.lit("User "), user_number(key))


def user_handle(key="row_key") -> Column:
    """Handle ``@user_N`` derived from the key."""
    return F.concat(F.lit("@user_"), user_number(key))
