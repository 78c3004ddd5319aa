"""Operator 13, conversation prefix trie: ternary search trees over turn ids, one per range shard.

Turns (role and text) are dictionary-encoded: each distinct one gets a number, so that
conversations become short sequences of numbers.  Sorted sequences are cut into range
shards, of equal sequences by conversation id, so that a group of copies of any size is
spread.  A shard puts its sequences into a ternary search tree, the median first, which
keeps the search trees over a node's children balanced.  Members, smallest members,
leaves and savings are then accumulated without recursion, from the last node made to the
first: a node is always made after its parent.

Only prefixes of a shard's first or last sequence can go on in other shards.  Those
boundary nodes leave the shard with what their other children hold; all others are
final.  Boundary nodes of one prefix (a digest of its turn ids) are added up, and what lies
below them is summed along the first and last sequences, each node's share counted on one
of the sequences that hold it: grouped sums and one window, and no step per level of the tree.

State: a task holds one shard's tree, about ``TURNS_PER_SHARD`` turns or one longer
conversation; a conversation is one row of its turns' numbers (12 bytes a turn).  The
digest of the members that end at a node needs their order: inside a shard it is made
there, for boundary nodes from joined chunks, streamed.

Null roles and texts are empty; a null turn comes first, and rows of one turn are ordered
by role and then by the text's digest, all kept (repeated rows too); rows without
``conv_id`` belong to no conversation; an empty table gives no rows, not even a root;
further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulse.llm.common import partitions_for, read_table, write_shared

TURNS_PER_SHARD = 100_000
HOT_TURNS = 1000               # a turn that is more than this part of all rows is joined by broadcast; there are fewer than this many
CHUNK_IDS = 10_000             # conversation ids in one row of a boundary node's list of ends
BASES, SHARED = 100, 6         # a conversation takes up to five turns of the last one divisible by 100
NOTHING = hashlib.sha256(b"").hexdigest()


# ---- sequences of turn ids ----------------------------------------------------------------------------

def encoded_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 0), turn_id, chars: turns in order, each distinct role and text under a number of its own."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "digest")
    rows = write_shared(
        conversations.filter(F.col("conv_id").isNotNull())
        .select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"),
                digest.alias("digest"), F.char_length(text).alias("chars"))
        .select("conv_id", (F.row_number().over(order) - 1).alias("place"), "digest", "chars"), "turns")
    total = rows.count()
    terms = write_shared(rows.groupBy("digest").agg(F.count("*").alias("n")).withColumn("turn_id", F.monotonically_increasing_id()), "turn-ids")
    hot = terms.filter(F.col("n") * HOT_TURNS > total).select("digest", "turn_id")       # fewer than HOT_TURNS rows
    cold = terms.filter(F.col("n") * HOT_TURNS <= total).select("digest", "turn_id")
    known = rows.join(F.broadcast(hot), "digest", "left")
    rest = known.filter(F.col("turn_id").isNull()).drop("turn_id").join(cold, "digest")
    columns = ("conv_id", "place", "turn_id", "chars")
    return known.filter(F.col("turn_id").isNotNull()).select(*columns).union(rest.select(*columns))


def _sequence(rows: DataFrame, name: str) -> DataFrame:
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("place", "turn_id", "chars"))).alias(name))


def own_sequences(turns: DataFrame) -> DataFrame:
    """conv_id, ids, chars: each conversation as it is."""
    return _sequence(turns, "s").select("conv_id", F.col("s.turn_id").alias("ids"), F.col("s.chars").alias("chars"))


def rebuilt_sequences(turns: DataFrame) -> DataFrame:
    """conv_id, ids, chars: the first h turns of the last conversation divisible by 100, then the own turns after the first h."""
    base = F.col("conv_id") - F.col("conv_id") % BASES
    heads = _sequence(turns.filter((F.col("place") < SHARED - 1) & (F.col("conv_id") % BASES == 0)), "head").withColumnRenamed("conv_id", "base")
    h = (F.crc32(F.col("conv_id").cast("string")) % SHARED).cast("int")
    both = _sequence(turns, "s").withColumn("base", base).withColumn("h", h).join(heads, "base", "left")
    parts = both.select("conv_id", F.when(F.col("head").isNull(), F.slice("s", 1, 0)).otherwise(F.slice("head", 1, F.col("h"))).alias("head"),
                        F.when(F.col("h") >= F.size("s"), F.slice("s", 1, 0)).otherwise(F.expr("slice(s, h + 1, size(s))")).alias("s"))
    return parts.select("conv_id", F.concat("head.turn_id", "s.turn_id").alias("ids"), F.concat("head.chars", "s.chars").alias("chars"))


# ---- the tree of a shard ------------------------------------------------------------------------------

class TernaryTree:
    """Sequences of numbers; node 0 is the root, and 0 stands for no node where one could be."""

    def __init__(self):
        self.turn, self.low, self.high, self.first_child = [-1], [0], [0], [0]
        self.parent, self.depth, self.chars = [-1], [0], [0]

    def _make(self, turn: int, chars: int, parent: int) -> int:
        for column, value in ((self.turn, turn), (self.low, 0), (self.high, 0), (self.first_child, 0), (self.parent, parent),
                              (self.depth, self.depth[parent] + 1), (self.chars, chars)):
            column.append(value)
        return len(self.turn) - 1

    def insert(self, ids, chars) -> int:
        """The node of a sequence; makes what is missing."""
        turn, low, high, first_child, node = self.turn, self.low, self.high, self.first_child, 0
        for t, n in zip(ids, chars, strict=True):
            at, links, link = first_child[node], first_child, node
            while at and turn[at] != t:
                links, link = (low, at) if t < turn[at] else (high, at)
                at = links[link]
            if not at:
                at = links[link] = self._make(t, n, node)
            node = at
        return node

    def path(self, node: int) -> list[int]:
        """Nodes from the root to ``node``."""
        out = []
        while node >= 0:
            out.append(node)
            node = self.parent[node]
        return out[::-1]


def medians(n: int) -> Iterator[int]:
    """0 to n-1, the middle of each range before its halves."""
    ranges = [(0, n)]
    for a, b in ranges:
        if a < b:
            middle = (a + b) // 2
            yield middle
            ranges += [(a, middle), (middle + 1, b)]


def _keys(ids) -> list[bytes]:
    """Digests of a sequence's prefixes, the empty one first."""
    out = [b""]
    for i in ids:
        out.append(hashlib.blake2b(out[-1] + int(i).to_bytes(8, "little", signed=True), digest_size=16).digest())
    return out


_SHARD = pa.schema([("kind", pa.string()), ("key", pa.binary()), ("parent_key", pa.binary()), ("conv_id", pa.int64()), ("depth", pa.int64()),
                    ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()),
                    ("saved", pa.int64()), ("chars", pa.int64()), ("spine", pa.int64()), ("place", pa.int64()), ("ends", pa.string())])
_SHARD_DDL = ("kind string, key binary, parent_key binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
              "n_leaves long, saved long, chars long, spine long, place long, ends string")


def shard_rows(sequences: list[tuple[list[int], list[int], list[int]]], shard: int) -> Iterator[tuple]:
    """Rows of one shard: ``sequences`` are (ids, chars, conversation ids), sorted and distinct.

    ``node``: a finished node (``parent_key`` instead of ``parent_conv_id`` under a boundary node);
    ``spine``: a boundary node on the shard's first (even spine) or last sequence, with what its other children hold;
    ``ends``: a chunk of the conversations that end at a boundary node.
    """
    tree, ends = TernaryTree(), {}
    for i in medians(len(sequences)):
        ids, chars, convs = sequences[i]
        ends[tree.insert(ids, chars)] = convs
    n = len(tree.turn)
    spines = [(tree.path(tree.insert(ids, chars)), _keys(ids)) for ids, chars, _ in (sequences[0], sequences[-1])]
    key = {node: k for nodes, keys in spines for node, k in zip(nodes, keys, strict=True)}
    members, least, children, leaves, saved = [0] * n, [None] * n, [0] * n, [0] * n, [0] * n
    for node, convs in ends.items():
        members[node], least[node] = len(convs), convs[0]
    for i in range(n - 1, -1, -1):
        p = tree.parent[i]
        if i not in key:
            leaves[i] = leaves[i] or 1
            saved[i] += (members[i] - 1) * tree.chars[i]
            children[p] += 1
            leaves[p] += leaves[i]
            saved[p] += saved[i]
        if p >= 0:
            members[p] += members[i]
            least[p] = least[i] if least[p] is None else min(least[p], least[i])
    for i in range(n):
        if i not in key:
            p, convs = tree.parent[i], ends.get(i)
            digest = hashlib.sha256(",".join(map(str, convs)).encode()).hexdigest() if convs else NOTHING
            yield ("node", None, key.get(p), least[i], tree.depth[i], None if p in key else least[p], members[i], children[i], leaves[i], saved[i],
                   None, None, None, digest)
    counted = set()
    for side, (nodes, keys) in enumerate(spines):
        for d, node in enumerate(nodes):
            own = (0, 0, 0, 0) if node in counted else (members[node], children[node], leaves[node], saved[node])
            counted.add(node)
            yield ("spine", keys[d], keys[d - 1] if d else None, least[node], d, None, *own, tree.chars[node], 2 * shard + side, None, None)
    for node in counted & ends.keys():
        convs = ends[node]
        for a in range(0, len(convs), CHUNK_IDS):
            yield ("ends", key[node], None, None, None, None, None, None, None, None, None, shard, a, ",".join(map(str, convs[a:a + CHUNK_IDS])))


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shard, sequences = TaskContext.get().partitionId(), []
    for batch in batches:
        for conv, ids, chars in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if sequences and sequences[-1][0] == ids:
                sequences[-1][2].append(conv)
            else:
                sequences.append((ids, chars, [conv]))
    rows = []
    for row in shard_rows(sequences, shard) if sequences else ():
        rows.append(row)
        if len(rows) == 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SHARD, strict=True)], schema=_SHARD)
            rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SHARD, strict=True)], schema=_SHARD)


def _end_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("key", pa.binary()), ("ends_sha256", pa.string())])
    key, digest, rows = None, None, []
    for batch in batches:
        for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if digest is None or k != key:
                if digest is not None:
                    rows.append({"key": key, "ends_sha256": digest.hexdigest()})
                key, digest = k, hashlib.sha256(text.encode())
            else:
                digest.update(b"," + text.encode())
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)
            rows = []
    if digest is not None:
        yield pa.RecordBatch.from_pylist([{"key": key, "ends_sha256": digest.hexdigest()}], schema=schema)


def _boundary(rows: DataFrame) -> DataFrame:
    """One row per boundary node: the shards' parts added up, and what lies below summed along the spines."""
    spine = rows.filter(F.col("kind") == "spine")
    merged = spine.groupBy("key").agg(
        F.first("parent_key").alias("parent_key"), F.first("depth").alias("depth"), F.first("chars").alias("chars"), F.min("conv_id").alias("conv_id"),
        F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("inner"), F.sum("n_leaves").alias("inner_leaves"),
        F.sum("saved").alias("inner_saved"), F.min("spine").alias("home"))
    below = merged.filter(F.col("parent_key").isNotNull()).groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("outer"))
    whole = merged.join(below, "key", "left").withColumn("n_children", F.col("inner") + F.coalesce("outer", F.lit(0)))
    whole = write_shared(whole.select(
        "key", "parent_key", "depth", "conv_id", "n_convs", "n_children", "home",
        (F.col("inner_leaves") + (F.col("n_children") == 0).cast("long")).alias("leaves"),
        (F.col("inner_saved") + (F.col("n_convs") - 1) * F.col("chars")).alias("saved")), "trie-boundary")
    # a node's share counts once, on its home spine; every other spine that holds the node adds nothing for it
    at_home = F.col("spine") == F.col("home")
    below = Window.partitionBy("spine").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = (spine.select("key", "spine").join(whole.select("key", "depth", "home", "leaves", "saved"), "key")
            .select("key", F.sum(F.when(at_home, F.col("leaves")).otherwise(0)).over(below).alias("leaves"),
                    F.sum(F.when(at_home, F.col("saved")).otherwise(0)).over(below).alias("saved"))
            .groupBy("key").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens")))
    ends = (rows.filter(F.col("kind") == "ends").repartition("key").sortWithinPartitions("key", "spine", "place")
            .select("key", "ends").mapInArrow(_end_digests, "key binary, ends_sha256 string"))
    parents = whole.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    return (whole.select("key", "parent_key", "depth", "conv_id", "n_convs", "n_children").join(sums, "key").join(ends, "key", "left")
            .join(parents, "parent_key", "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                    F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"), "key"))


def prefix_trie(sequences: DataFrame, turns_per_shard: int = TURNS_PER_SHARD) -> DataFrame:
    """The nodes of the trie over conv_id, ids, chars (conversation ids distinct)."""
    stored = write_shared(sequences.select("conv_id", "ids", "chars"), "sequences")
    size = stored.agg(F.sum(F.size("ids") + 1)).first()[0] or 0
    shards = (stored.repartitionByRange(partitions_for(size, turns_per_shard), "ids", "conv_id").sortWithinPartitions("ids", "conv_id")
              .mapInArrow(_shards, _SHARD_DDL))
    rows = write_shared(shards, "trie-shards")
    boundary = _boundary(rows)
    columns = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    nodes = rows.filter(F.col("kind") == "node").withColumnsRenamed({"saved": "saved_tokens", "ends": "ends_sha256"})
    inside = nodes.filter(F.col("parent_key").isNull()).select(*columns)
    parents = boundary.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("_parent"))
    under = nodes.filter(F.col("parent_key").isNotNull()).drop("parent_conv_id").join(parents, "parent_key").withColumnRenamed(
        "_parent", "parent_conv_id").select(*columns)
    return inside.union(under).union(boundary.select(*columns))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie over all conversations, rebuilt with shared beginnings."""
    return prefix_trie(rebuilt_sequences(encoded_turns(read_table(spark, sf_dir, "conversations"))))
