"""Row keys, salting, reversed timestamps and hour buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the post-table key layout.
REVERSED_TS_BASE = 9_999_999_999_999   # reversed timestamp = base - epoch millis
SALT_BUCKETS = 10                      # key prefixes 0..9
KEY_SEPARATOR = "_"
REV_TS_WIDTH = 13                      # digits of a reversed timestamp
HOUR_BUCKET_FORMAT = "yyyyMMddHH"      # UTC wall-clock hour


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def salt(user_id="user_id") -> Column:
    """Stable salt in [0, 10): first 32 bits of md5(user_id) modulo 10.

    Deterministic across processes (unlike a per-process string hash), so the
    salt of a user can be recomputed to prune a scan to one key prefix.
    """
    return (F.conv(F.substring(F.md5(_c(user_id)), 1, 8), 16, 10).cast("long")
            % F.lit(SALT_BUCKETS))


def reversed_ts(ts_millis="timestamp") -> Column:
    """Newest first in ascending key order."""
    return F.lit(REVERSED_TS_BASE) - _c(ts_millis)


def row_key(user_id="user_id", ts_millis="timestamp") -> Column:
    """``{salt}_{user_id}_{reversed_ts}``; null when any part is null."""
    return F.concat(salt(user_id).cast("string"), F.lit(KEY_SEPARATOR), _c(user_id),
                    F.lit(KEY_SEPARATOR),
                    F.lpad(reversed_ts(ts_millis).cast("string"), REV_TS_WIDTH, "0"))


_VALID_KEY = r"^[^_]+_.+_[0-9]+$"


def row_key_is_valid(key="row_key") -> Column:
    """A key parses when it has a non-empty user part between the first and last
    separator and a numeric reversed timestamp that fits in a long.

    Kept to two references of ``key`` because the optimizer copies filter
    conditions below projections.
    """
    k = _c(key)
    return k.rlike(_VALID_KEY) & F.regexp_extract(k, r"_([0-9]+)$", 1).try_cast("long").isNotNull()


def parse_row_key(key="row_key") -> Column:
    """Split a key on its first and last separator.

    Returns ``struct(salt, user_id, rev_ts)``; null for keys that do not parse
    (see :func:`row_key_is_valid`).
    """
    k = _c(key)
    parts = F.split(k, KEY_SEPARATOR)
    head = F.element_at(parts, 1)
    tail = F.element_at(parts, -1)
    user = F.substring(k, F.length(head) + F.lit(2),
                       F.length(k) - F.length(head) - F.length(tail) - F.lit(2))
    return F.when(row_key_is_valid(k), F.struct(
        head.try_cast("long").alias("salt"),
        user.alias("user_id"),
        tail.try_cast("long").alias("rev_ts"),
    ))


def hour_bucket(ts_millis="timestamp") -> Column:
    """UTC hour bucket text ``yyyyMMddHH`` of an epoch-millisecond column."""
    return F.date_format(F.timestamp_millis(_c(ts_millis)), HOUR_BUCKET_FORMAT)


def bucket_to_hour_start(bucket="bucket") -> Column:
    """Inverse of :func:`hour_bucket`: the bucket's first instant as a timestamp."""
    return F.to_timestamp(_c(bucket), HOUR_BUCKET_FORMAT)


def day_partition(ts_millis="timestamp") -> Column:
    """Partition value of the post table (UTC day)."""
    return F.date_format(F.timestamp_millis(_c(ts_millis)), "yyyy-MM-dd")
