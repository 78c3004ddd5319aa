"""Operator 6, sharding: a Feistel permutation with cycle walking over global row numbers.

Rows are numbered 0..n-1 in a total order, the number is permuted by a keyed
Feistel network, and the permuted number p gives ``shard = p mod shards`` and
``slot = p div shards``.  Shard and slot of a row therefore follow from its row
number, ``n``, the seed and the shard count alone; shard sizes differ by at most
one row (law ``rows``).  Everything is DataFrame functions.

* The numbering shuffles only narrow columns (id, size, crc), never texts.
* Row numbers need no single-task window: rows are range-partitioned, sorted
  inside the partitions and numbered from per-partition counts.
* The Feistel halves are ``a = ceil(sqrt(n))`` and ``b = ceil(n / a)``, so fewer
  than ``a`` of the ``a * b`` numbers lie outside 0..n-1 and few rows walk; no
  walk can take more than ``a * b - n`` further steps.

Null ids sort first; null texts have no bytes (size 8, crc of the empty text);
repeated rows are numbered one after the other and are interchangeable; an empty
table gives no rows.  Only ``id_col`` and ``text_col`` are read, so further
columns of any name do not matter.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulse.llm.common import partitions_for, read_table, utf8, write_shared

SHARDS = 24
SEED = 20_240_601
ROUNDS = 6                     # even, so the halves end in their own places
PRIME = 2_147_483_647          # products of two residues fit a long
HEADER_BYTES = 8
ROWS_PER_PARTITION = 1_000_000


def round_keys(seed: int, rounds: int = ROUNDS) -> list[tuple[int, int, int]]:
    """Three residues per round, drawn from the seed by a multiplicative generator."""
    keys, x = [], seed % (PRIME - 1) + 1
    for _ in range(rounds):
        key = []
        for _ in range(3):
            x = x * 48_271 % PRIME
            key.append(x)
        keys.append(tuple(key))
    return keys


def radices(n: int) -> tuple[int, int]:
    """Sizes (a, b) of the two halves: a * b >= n and a * b - n < a."""
    a = max(1, math.isqrt(max(n, 1) - 1) + 1)
    return a, max(1, -(-n // a))


def _feistel(x: str, n: int, seed: int) -> str:
    """SQL text of one pass through the network for the number ``x`` of 0..a*b-1.

    Each round maps (l, r) to (r, l + f(r)) in mixed radix; f is a keyed cubic over a prime field.
    """
    a, b = radices(n)
    keys = ", ".join(f"struct({k1}L AS k1, {k2}L AS k2, {k3}L AS k3, {(a, b)[i % 2]}L AS m)"
                     for i, (k1, k2, k3) in enumerate(round_keys(seed)))
    f = (f"(((s.r + k.k1) % {PRIME}L) * ((s.r + k.k1) % {PRIME}L) % {PRIME}L"
         f" * ((s.r + k.k2) % {PRIME}L) + k.k3) % {PRIME}L")
    return (f"aggregate(array({keys}), struct(({x}) div {b}L AS l, ({x}) % {b}L AS r), "
            f"(s, k) -> struct(s.r AS l, (s.l + {f}) % k.m AS r), s -> s.l * {b}L + s.r)")


def permuted(row_number: str, n: int, seed: int = SEED) -> Column:
    """The keyed permutation of 0..n-1 applied to the column ``row_number`` (cycle walking)."""
    a, b = radices(n)
    outside = a * b - n
    once = _feistel(row_number, n, seed)
    if outside == 0:
        return F.expr(once)
    walk = (f"aggregate(sequence(1L, {outside}L), p, "
            f"(q, i) -> CASE WHEN q >= {n}L THEN {_feistel('q', n, seed)} ELSE q END)")
    return F.expr(f"transform(array({once}), p -> CASE WHEN p < {n}L THEN p ELSE {walk} END)[0]")


def numbered(rows: DataFrame, order: list[str], n: int, name: str,
             rows_per_partition: int | None = None) -> DataFrame:
    """``rows`` with ``row_number`` 0..n-1 in ``order`` (ties: input order; such rows should be alike)."""
    keys = [F.col(c) for c in order] + [F.col("_tie")]
    ranged = (rows.withColumn("_tie", F.monotonically_increasing_id())
              .repartitionByRange(partitions_for(n, rows_per_partition or ROWS_PER_PARTITION), *keys)
              .sortWithinPartitions(*keys).drop("_tie")
              .withColumn("_at", F.monotonically_increasing_id()))
    placed = write_shared(ranged, name).withColumn("_part", F.shiftright("_at", 33))
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    # one row per range partition, n / rows_per_partition in all
    starts = counts.selectExpr("_part", "sum(_n) OVER (ORDER BY _part) - _n AS _start")
    return (placed.join(F.broadcast(starts), "_part")
            .withColumn("row_number", F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
            .drop("_part", "_at", "_start"))


def shard(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS,
          seed: int = SEED) -> DataFrame:
    """Shard and slot of every row: id, size, text_crc32, law, row_number, shard, slot, grown_shard."""
    narrow = rows.select(F.col(id_col).alias("doc_id"),
                         (F.octet_length(utf8(F.col(text_col))) + HEADER_BYTES).cast("long").alias("size"),
                         F.crc32(utf8(F.col(text_col))).alias("text_crc32"))
    n = rows.count()
    if n == 0:
        placed = narrow.withColumn("row_number", F.lit(0).cast("long")).withColumn("_p", F.lit(0).cast("long"))
    else:
        placed = (numbered(narrow, ["doc_id", "text_crc32", "size"], n, "row-numbers")
                  .withColumn("_p", permuted("row_number", n, seed)))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "row_number",
        (F.col("_p") % shards).cast("int").alias("shard"), F.expr(f"_p div {shards}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards, law ``rows``."""
    return shard(read_table(spark, sf_dir, "documents"))

