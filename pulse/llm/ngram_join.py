"""Operator 10, n-gram Jaccard self-join: rare-first prefix filtering.

A text's set holds its distinct ``width``-word shingles (ASCII-lower-cased words
between white space).  Two texts link when ``100 * |intersection| >= percent * |union|``.

1. *Profile.* One pass counts every text's shingles into a sketch of fixed size (the
   document frequency of each hash range) and digests its set (128 bits).  Texts with
   one digest are one class.
2. *Prefix rows.* Each set is ordered rare-first by that sketch; only its prefix can
   hold the first shingle shared with a text that links.  A task emits a class once.
3. *Join on prefix shingles.* Rows of one shingle, sorted by set size, stream through
   a task that keeps one leader per length window.  Every other row is paired with its
   leader if the positional filter allows.
4. *Verification.* Pairs are made distinct, sifted by the suffix filter on the parities of
   the sets' hash ranges (a lower bound of their difference that never rejects a link), and
   verified once on the whole sets (suffix filter at pivots, then exact intersection).
5. *The rest.* Rows of one shingle that are in different components are compared with
   each other (length, positional and parity filter), in blocks where a shingle has many
   rows: first each row's most similar partner is verified, then, between the
   components that are left, every pair that passes and was not verified before.  So no
   link between components is lost, while a group of near copies costs few pairs per copy.

Components join links and classes.  Rows with a null id get their set size and a null
component; null and empty texts have empty sets and link with nothing; repeated rows are
one document; an empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulse.llm.common import read_table, write_shared
from pulse.llm.components import connected_components
from pulse.llm.shingles import shingle_sets
from pulse.llm.vectors import runs

WIDTH, PERCENT = 4, 85
STAGE_WIDTH, STAGE_PERCENT = 5, 80
SKETCH_BITS = 18               # hash ranges whose document frequencies are counted: 2 MB in all
PARITY_BITS, FOLD_BITS = 2_048, 512     # parities per set, for pairs and (folded) for the rows of step 5
BROADCAST_IDS = 500_000        # ids of texts to be verified that are broadcast at most: 4 MB
MEMBERS_PER_TASK = 1_000       # members that one leader is verified against in one group
BLOCK_ROWS = 2_048             # rows of one shingle that are compared in one group of step 5


def _texts(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column("text").cast(pa.binary()).to_pylist()


def _buckets(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _digest(hashes: np.ndarray) -> tuple[int, int]:
    raw = hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


def parities(hashes: np.ndarray, bits: int) -> bytes:
    """Whether each of ``bits`` hash ranges holds an odd number of the hashes."""
    counts = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(bool)).tobytes()


def _odd(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Number of differing parities: at most the number of elements that only one of the sets has."""
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64)


def _bit_rows(column: pa.Array, bits: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, bits // 8)


def _profile(width: int):
    """doc_id, n_shingles, d1, d2, parities per text, and at the end of a task its bucket, docs counts."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()),
                        ("bits", pa.binary()), ("fold", pa.binary()), ("bucket", pa.int64()), ("docs", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            sizes, digests, bits, folds, pending, held = [], [], [], [], [], 0
            for s in shingle_sets(_texts(batch), width):
                sizes.append(len(s))
                digests.append(_digest(s))
                bits.append(parities(s, PARITY_BITS))
                folds.append(parities(s, FOLD_BITS))
                pending.append(_buckets(s))
                held += len(s)
                if held > 1_000_000:
                    counts += np.bincount(np.concatenate(pending), minlength=len(counts))
                    pending, held = [], 0
            if pending:
                counts += np.bincount(np.concatenate(pending), minlength=len(counts))
            none = pa.nulls(len(sizes), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array([d[0] for d in digests], pa.int64()),
                 pa.array([d[1] for d in digests], pa.int64()), pa.array(bits, pa.binary()), pa.array(folds, pa.binary()), none, none],
                schema=schema)
        used = np.flatnonzero(counts)
        for part in np.array_split(used, max(1, len(used) // 50_000)):
            none, no_bits = pa.nulls(len(part), pa.int64()), pa.nulls(len(part), pa.binary())
            yield pa.RecordBatch.from_arrays([none, none, none, none, no_bits, no_bits, pa.array(part), pa.array(counts[part])],
                                             schema=schema)

    return run, "doc_id long, n_shingles long, d1 long, d2 long, bits binary, fold binary, bucket long, docs long"


def prefix_length(size: int, percent: int) -> int:
    """Shingles of a set of ``size`` of which one must be shared with any set that links."""
    return size - (-(-percent * size // 100)) + 1


def least_overlap(x, y, percent: int):
    """Smallest intersection with which sets of sizes x and y link."""
    return -(-percent * (x + y) // (100 + percent))


def _prefix_rows(width: int, percent: int, sketch):
    """shingle, doc_id, size, pos, d1 for each text's prefix; a class once per task."""
    schema = pa.schema([("shingle", pa.int64()), ("doc_id", pa.int64()), ("size", pa.int32()), ("pos", pa.int32()), ("d1", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = np.frombuffer(sketch.value, np.uint32), set()

        def out(rows):
            keys = np.concatenate([r[1] for r in rows])
            lengths = np.array([len(r[1]) for r in rows])

            def each(values, kind):
                return pa.array(np.repeat(np.array(values, kind), lengths))

            pos = np.arange(len(keys), dtype=np.int32) - np.repeat(np.cumsum(lengths) - lengths, lengths).astype(np.int32)
            return pa.RecordBatch.from_arrays(
                [pa.array(keys.view(np.int64)), each([r[0] for r in rows], np.int64), each([r[2] for r in rows], np.int32),
                 pa.array(pos), each([r[3] for r in rows], np.int64)], schema=schema)

        for batch in batches:
            rows, held = [], 0
            for doc_id, s in zip(batch.column("doc_id").to_pylist(), shingle_sets(_texts(batch), width), strict=True):
                if doc_id is None or not len(s):
                    continue
                digest = _digest(s)
                if digest in seen:
                    continue
                seen.add(digest)
                order = np.argsort(counts[_buckets(s)], kind="stable")[:prefix_length(len(s), percent)]
                rows.append((doc_id, s[order], len(s), digest[0]))
                held += len(order)
                if held > 200_000:
                    yield out(rows)
                    rows, held = [], 0
            if rows:
                yield out(rows)

    return run, "shingle long, doc_id long, size int, pos int, d1 long"


_LIVE = pa.schema([("shingle", pa.int64()), ("doc_id", pa.int64()), ("size", pa.int32()), ("pos", pa.int32()),
                   ("d1", pa.int64()), ("leader", pa.int64())])


def _possible(size_x, pos_x, size_y, pos_y, percent: int):
    """Length and positional filter for texts that share the shingles at these positions of their prefixes."""
    small, large = np.minimum(size_x, size_y), np.maximum(size_x, size_y)
    most = np.minimum(pos_x, pos_y) + 1 + np.minimum(size_x - pos_x, size_y - pos_y) - 1
    return (100 * small >= percent * large) & (most >= least_overlap(size_x, size_y, percent))


def _lead(percent: int):
    """Rows sorted by shingle, size, d1: those of shingles with two classes or more, each with its leader."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None                                        # first row of the run that the last batch ended in
        shown = False                                      # whether it was put out
        last = None                                        # (size, d1) of the row before
        for batch in batches:
            key, doc, size, pos, d1 = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns)
            if not len(key):
                continue
            starts = np.r_[0, np.flatnonzero(key[1:] != key[:-1]) + 1]
            ends = np.r_[starts[1:], len(key)]
            rows: list[np.ndarray] = []                    # columns of _LIVE
            goes_on = held is not None and held[0] == key[0]
            worth = ends - starts > 1
            worth[0] |= goes_on
            worth[-1] = True
            for r in np.flatnonzero(worth):
                a, b = int(starts[r]), int(ends[r])
                if r == 0 and goes_on:
                    leader = held
                else:
                    leader, shown, last = (key[a], doc[a], size[a], pos[a], d1[a]), False, (size[a], d1[a])
                    a += 1
                same = np.r_[last[:1], size[a:b - 1]] == size[a:b] if b > a else np.empty(0, bool)
                if b > a:
                    same &= np.r_[last[1:], d1[a:b - 1]] == d1[a:b]
                    last = (size[b - 1], d1[b - 1])
                at = a + np.flatnonzero(~same)
                while len(at):
                    if not shown:
                        rows.append(np.array([[*leader, -1]], np.int64))
                        shown = True
                    near = int(np.searchsorted(size[at], 100 * leader[2] // percent, "right"))
                    now, at = at[:near], at[near:]
                    if near:
                        ok = _possible(leader[2], leader[3], size[now], pos[now], percent) & (doc[now] != leader[1])
                        rows.append(np.column_stack([key[now], doc[now], size[now], pos[now], d1[now],
                                                     np.where(ok, leader[1], -1)]))
                    if len(at):
                        i = at[0]
                        leader, at, shown = (key[i], doc[i], size[i], pos[i], d1[i]), at[1:], False
                        rows.append(np.array([[*leader, -1]], np.int64))
                        shown = True
                held = leader
            if rows:
                yield _live_batch(np.concatenate(rows))

    return run, "shingle long, doc_id long, size int, pos int, d1 long, leader long"


def _live_batch(t: np.ndarray) -> pa.RecordBatch:
    leader = np.ascontiguousarray(t[:, 5])
    return pa.RecordBatch.from_arrays(
        [pa.array(np.ascontiguousarray(t[:, 0])), pa.array(np.ascontiguousarray(t[:, 1])), pa.array(t[:, 2].astype(np.int32)),
         pa.array(t[:, 3].astype(np.int32)), pa.array(np.ascontiguousarray(t[:, 4])),
         pa.array(leader, mask=leader == -1)], schema=_LIVE)


def _cross(percent: int, nearest: bool):
    """Rows sorted by shingle, block pair and size: pairs of rows in different components that may link.

    ``nearest``: only each row's partner with the least difference in parities.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def pairs(rows: pa.Table) -> list[np.ndarray]:
        lo, hi, block, doc, size, pos, d1, comp = (
            rows[c].to_numpy().astype(np.int64) for c in ("b1", "b2", "block", "doc_id", "size", "pos", "d1", "comp"))
        bits = _bit_rows(rows["fold"].combine_chunks(), FOLD_BITS)
        upper, found = np.searchsorted(size, 100 * size // percent, "right"), []
        for i in range(len(doc)):
            j = slice(i + 1, upper[i])
            ok = (comp[j] != comp[i]) & (d1[j] != d1[i]) & ((lo[j] == hi[j]) | (block[j] != block[i]))
            at = i + 1 + np.flatnonzero(ok & _possible(size[i], pos[i], size[j], pos[j], percent))
            if not len(at):
                continue
            odd = _odd(bits[at], bits[i])
            near = odd <= size[i] + size[at] - 2 * least_overlap(size[i], size[at], percent)
            at, odd = at[near], odd[near]
            if len(at):
                other = doc[at[[np.argmin(odd)]]] if nearest else doc[at]
                found.append(np.column_stack([np.minimum(other, doc[i]), np.maximum(other, doc[i])]))
        return found

    def out(found: list[np.ndarray]) -> pa.RecordBatch:
        both = np.unique(np.concatenate(found), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(both[:, k])) for k in (0, 1)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, waiting = [], 0
        for rows in runs(batches, ["shingle", "b1", "b2"]):
            if rows.num_rows > 1:
                new = pairs(rows)
                found += new
                waiting += sum(map(len, new))
                if waiting > 200_000:
                    yield out(found)
                    found, waiting = [], 0
        if found:
            yield out(found)

    return run, "a long, b long"


def _sift(percent: int):
    """Pairs with both sets' sizes and parities: those that may link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
            odd = _odd(_bit_rows(batch.column("bits_a"), PARITY_BITS), _bit_rows(batch.column("bits_b"), PARITY_BITS))
            need = least_overlap(x, y, percent)
            yield batch.select(["a", "b"]).filter(pa.array((np.minimum(x, y) >= need) & (odd <= x + y - 2 * need)))

    return run, "a long, b long"


def hamming_at_least(x: np.ndarray, y: np.ndarray, depth: int = 3) -> int:
    """Suffix filter: a lower bound of the symmetric difference of two sorted sets, from splits at pivots of ``y``."""
    if not depth or not len(x) or not len(y):
        return abs(len(x) - len(y))
    j = len(y) // 2
    i = int(np.searchsorted(x, y[j]))
    hit = i < len(x) and x[i] == y[j]
    return (hamming_at_least(x[:i], y[:j], depth - 1) + hamming_at_least(x[i + hit:], y[j + 1:], depth - 1)
            + (0 if hit else 1))


def links(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets of hashes link, exactly."""
    need = least_overlap(len(x), len(y), percent)
    if not len(x) or not len(y) or min(len(x), len(y)) < need or hamming_at_least(x, y) > len(x) + len(y) - 2 * need:
        return False
    both = np.sort(np.concatenate([x, y]), kind="stable")
    return int((both[1:] == both[:-1]).sum()) >= need


def _check(width: int, percent: int):
    """Rows sorted by group and role: each member's set against its leader's, as the rows stream by."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, leaders = None, []
        for batch in batches:
            a, b = [], []
            for block, salt, role, doc, s in zip(*(batch.column(c).to_pylist() for c in ("block", "salt", "role", "doc_id")),
                                                 shingle_sets(_texts(batch), width), strict=True):
                if (block, salt) != group:
                    group, leaders = (block, salt), []
                if role == 0:
                    leaders.append(s)
                elif any(links(s, x, percent) for x in leaders):
                    a.append(block)
                    b.append(doc)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)

    return run, "a long, b long"


def verified(docs: DataFrame, profile: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The distinct ``pairs`` (a, b) whose whole sets link.  Each pair is compared once.

    A pair goes to the group of its ``a``; one with many partners is spread over
    several groups, each with its own copy of that text.
    """
    def side(x: str) -> DataFrame:
        return profile.select(F.col("doc_id").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}"))

    run, schema = _sift(percent)
    pairs = write_shared(pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(run, schema).distinct(), "pairs")
    groups = pairs.groupBy("a").agg(F.ceil(F.count("*") / MEMBERS_PER_TASK).cast("int").alias("n"))
    members = pairs.join(groups, "a").select(
        F.col("b").alias("doc_id"), F.col("a").alias("block"),
        F.pmod(F.xxhash64("b"), F.col("n")).cast("int").alias("salt"), F.lit(1).alias("role"))
    heads = groups.select(F.col("a").alias("doc_id"), F.col("a").alias("block"),
                          F.explode(F.expr("sequence(0, n - 1)")).alias("salt"), F.lit(0).alias("role"))
    ids = write_shared(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "pair-ids")
    texts = docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi")
    rows = texts.join(members.union(heads), "doc_id").repartition("block", "salt").sortWithinPartitions("block", "salt", "role")
    run, schema = _check(width, percent)
    return rows.select("block", "salt", "role", "doc_id", "text").mapInArrow(run, schema).distinct()


def _rest(live: DataFrame, profile: DataFrame, comps: DataFrame, percent: int, nearest: bool) -> DataFrame:
    """Pairs of rows with one shingle and different components (step 5)."""
    rows = (live.join(comps.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left")
            .withColumn("comp", F.coalesce("component", "doc_id")))
    split = (rows.groupBy("shingle").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n"))
             .filter(F.col("lo") != F.col("hi"))
             .select("shingle", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("blocks")))
    rows = rows.join(split, "shingle").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    rows = rows.join(profile.select("doc_id", "d1", "fold").dropDuplicates(["doc_id", "d1"]), ["doc_id", "d1"])
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    rows = rows.select("shingle", F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2"),
                       "block", "doc_id", "size", "pos", "d1", "comp", "fold")
    run, schema = _cross(percent, nearest)
    return (rows.repartition("shingle", "b1", "b2").sortWithinPartitions("shingle", "b1", "b2", "size", "d1", "doc_id")
            .mapInArrow(run, schema).distinct())


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs`` (ids: whole numbers)."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    run, schema = _profile(width)
    profile = write_shared(docs.mapInArrow(run, schema), "profile")
    texts = profile.filter(F.col("bucket").isNull()).drop("bucket", "docs")
    named = texts.filter(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    counted = profile.filter(F.col("bucket").isNotNull()).groupBy("bucket").agg(F.sum("docs").alias("docs")).toArrow()
    counts = np.zeros(1 << SKETCH_BITS, np.uint32)         # a sketch of fixed size, whatever the input
    counts[counted["bucket"].to_numpy()] = np.minimum(counted["docs"].to_numpy(), np.iinfo(np.uint32).max)
    sketch = spark.sparkContext.broadcast(counts.tobytes())

    run, schema = _prefix_rows(width, percent, sketch)
    rows = docs.mapInArrow(run, schema).repartition("shingle").sortWithinPartitions("shingle", "size", "d1", "doc_id")
    run, schema = _lead(percent)
    live = write_shared(rows.mapInArrow(run, schema), "prefix-rows")

    # pairs are (smaller id, larger id) throughout, so that none is verified twice
    tried = write_shared(live.filter(F.col("leader").isNotNull()).select(
        F.least("leader", "doc_id").alias("a"), F.greatest("leader", "doc_id").alias("b")).distinct(), "tried")
    # classes: texts with one set, known by their smallest id; several of one class may have prefix rows
    classes = (named.groupBy("d1", "d2").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
               .filter(F.col("n") > 1).drop("n"))
    alike = (named.join(live.select("doc_id").distinct(), "doc_id", "left_semi").join(classes, ["d1", "d2"])
             .select(F.col("doc_id").alias("a"), F.col("first").alias("b")).filter(F.col("a") != F.col("b")))
    edges = write_shared(verified(docs, named, tried, width, percent).union(alike), "links")
    for nearest in (True, False):
        comps = write_shared(connected_components(edges), "components")
        rest = write_shared(_rest(live, named, comps, percent, nearest).join(tried, ["a", "b"], "left_anti"), "rest")
        edges = write_shared(edges.union(verified(docs, named, rest, width, percent)), "links")
        tried = tried.union(rest)

    comps = write_shared(connected_components(edges), "components")
    known = (texts.select("doc_id", "n_shingles", "d1", "d2").join(classes, ["d1", "d2"], "left")
             .withColumn("node", F.coalesce("first", "doc_id")))
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.coalesce("component", "node"))
    return (known.join(comps, "node", "left")
            .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id")))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document."""
    return jaccard_components(read_table(spark, sf_dir, "documents"))


def ngram_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each component (the smallest id); rows without an id stay."""
    comps = jaccard_components(docs, width=STAGE_WIDTH, percent=STAGE_PERCENT)
    dropped = comps.filter(F.col("component_id") < F.col("doc_id")).select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)
