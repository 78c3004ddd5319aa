"""Ranks and shares over small, already-limited result lists.

A window without ``partitionBy`` moves every row to one task, so these are
only applied after a limit (a top list of at most a few dozen rows) or to an
aggregate whose size is bounded by its key domain (three labels).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulse.functions.text import contains_ci


def ranked_list(top: DataFrame, count_col: str = "cnt", key_col: str = "hashtag") -> DataFrame:
    """Add ``rank`` (1-based position) and ``share_of_max`` (count / max * 100, 0 if max 0)."""
    order = Window.orderBy(F.desc(count_col), F.asc(key_col))
    whole = Window.partitionBy()
    mx = F.max(count_col).over(whole)
    share = F.coalesce(F.lit(100.0) * F.col(count_col) / F.nullif(mx, F.lit(0)), F.lit(0.0))
    return top.select("*", F.row_number().over(order).cast("long").alias("rank"),
                      share.alias("share_of_max"))


def filter_ranked(ranked: DataFrame, query: str, key_col: str = "hashtag") -> DataFrame:
    """Case-insensitive substring filter that keeps each row's overall rank."""
    return ranked.filter(contains_ci(key_col, query))


def shares_of_total(counts: DataFrame, count_col: str = "cnt") -> DataFrame:
    """``share`` = count / sum(count) * 100 over a bounded aggregate."""
    total = F.sum(count_col).over(Window.partitionBy())
    return counts.select("*", (F.lit(100.0) * F.col(count_col) / total).alias("share"))
