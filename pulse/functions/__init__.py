"""Column-level helpers: every function returns a ``Column`` built from built-in expressions."""

from pulse.functions.keys import (bucket_to_hour_start, hour_bucket, parse_row_key,
                                  reversed_ts, row_key, salt)
from pulse.functions.tags import clean_tags, join_tags, split_tags
from pulse.functions.text import contains_ci, user_label

__all__ = [
    "bucket_to_hour_start", "hour_bucket", "parse_row_key", "reversed_ts", "row_key", "salt",
    "clean_tags", "join_tags", "split_tags", "contains_ci", "user_label",
]
