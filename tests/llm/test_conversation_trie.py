import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from pulse.llm import conversation_trie
from pulse.llm.common import with_package
from pulse.llm.conversation_trie import TernaryTree, encoded_turns, medians, own_sequences, prefix_trie, rebuilt_sequences

SCHEMA = "conv_id long, turn long, role string, text string"


def sequences_of(rows, rebuild=True):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own.setdefault(c, []).append(((turn is not None, turn or 0), role, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), text))
    own = {c: [(role, text) for _, role, _, text in sorted(turns)] for c, turns in own.items()}
    if not rebuild:
        return own
    h = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
    return {c: own.get(c - (c % 100 if c >= 0 else -(-c % 100)), [])[:h[c]] + turns[h[c]:] for c, turns in own.items()}


def brute(sequences):
    members = {}
    for c, s in sequences.items():
        for d in range(len(s) + 1):
            members.setdefault(tuple(s[:d]), []).append(c)
    out = []
    for node, convs in members.items():
        subtree = [n for n in members if n[:len(node)] == node]
        ends = sorted(c for c in convs if len(sequences[c]) == len(node))
        childless = [n for n in subtree if not any(len(m) == len(n) + 1 and m[:len(n)] == n for m in members)]
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs),
                    sum(len(m) == len(node) + 1 for m in subtree), len(childless),
                    sum((len(members[n]) - 1) * len(n[-1][1]) for n in subtree if n), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def nodes_of(df):
    return sorted((tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                                                "ends_sha256").collect()), key=str)


def random_rows(seed, n):
    rng, rows = random.Random(seed), []
    for c in rng.sample(range(-150, 450), n):
        for turn in range(rng.choice([0, 1, 1, 2, 3, 5, 8])):
            rows.append((c, rng.choice([turn, turn, turn, None]) if rng.random() < 0.2 else turn, rng.choice(["user", "assistant", None]),
                         rng.choice(["a", "b", "é😀", "", None, "long " * 50])))
    return rows + [(7, t, "user", "the same") for t in range(40)] + rows[:3]


@pytest.mark.parametrize("shard", [5, 40, 100_000])
def test_nodes_equal_brute_force_however_the_shards_are_cut(spark, shard, monkeypatch):
    with_package(spark)
    monkeypatch.setattr(conversation_trie, "HOT_TURNS", 5)      # both ways to join the dictionary
    rows = random_rows(3, 120)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumn("depth", F.lit("x")).withColumn("key", F.lit(1))
    turns = encoded_turns(df)
    assert nodes_of(prefix_trie(rebuilt_sequences(turns), shard)) == brute(sequences_of(rows))
    assert nodes_of(prefix_trie(own_sequences(turns), shard)) == brute(sequences_of(rows, False))


def test_copies_that_fill_many_shards_are_one_path(spark, monkeypatch):
    with_package(spark)
    rows = [(100 * c, t, "user", f"turn {t}") for c in range(300) for t in range(3)] + [(5, 0, "user", "turn 0")] + [(9000 * 100, 0, "user", "other")]
    turns = encoded_turns(spark.createDataFrame(rows, SCHEMA))
    want = brute(sequences_of(rows, False))
    for chunk in (7, 10_000):
        monkeypatch.setattr(conversation_trie, "CHUNK_IDS", chunk)
        got = prefix_trie(own_sequences(turns), 60)
        assert nodes_of(got) == want and len(want) == 5


def test_edge_tables(spark):
    with_package(spark)
    empty = spark.createDataFrame([], SCHEMA)
    assert nodes_of(prefix_trie(rebuilt_sequences(encoded_turns(empty)))) == []
    nobody = spark.createDataFrame([(None, 0, "user", "x")], SCHEMA)
    assert nodes_of(prefix_trie(own_sequences(encoded_turns(nobody)))) == []
    # conversation 3 takes nothing from an absent base and loses its own beginning: only the root, where it ends
    lone = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6 > 2)
    rows = [(lone, None, None, None), (lone, 1, "user", "y" * 200_000)]
    got = nodes_of(prefix_trie(rebuilt_sequences(encoded_turns(spark.createDataFrame(rows, SCHEMA)))))
    assert got == brute(sequences_of(rows)) == [(lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())]


def test_median_first_keeps_the_search_trees_low():
    assert sorted(medians(1000)) == list(range(1000)) and list(medians(0)) == []
    tree = TernaryTree()
    for i in medians(1000):
        tree.insert([i, 7], [1, 1])
    deepest, stack = 0, [(tree.first_child[0], 1)]
    while stack:
        node, level = stack.pop()
        deepest = max(deepest, level)
        stack += [(n, level + 1) for n in (tree.low[node], tree.high[node]) if n]
    assert deepest == 10 and len(tree.turn) == 2001
