import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import types as T

from pulse.llm import sentencepieces as op
from pulse.llm.common import read_table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def model():
    return op.PieceModel()


def test_without_dropout_the_ids_are_the_models_own(spark, model):
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    encoder = op.Encoder(model, 0.0, 1, 0)
    texts = ["", " ", "a", "  two  spaces ", "Hello  world\n\tfoo", "naïve 日本 😀 ﬁ", "x" * 300, "the cat. The\ncat!"]
    texts += [r.text[:3000] for r in read_table(spark, SF, "documents").filter("text is not null").collect()]
    for t in texts:
        assert np.frombuffer(encoder.encode(t, 0), "<u4").tolist() == (sp.encode(t) if t else []), t[:80]


def test_dropout_is_seeded_varied_and_lossless(model):
    rng = random.Random(7)
    text = " ".join(rng.choices(["understanding", "of", "international", "words", "naïve", "日本"], k=60))
    a, b, other = (op.Encoder(model, 0.3, 4, seed) for seed in (1, 1, 2))
    assert [a.encode(text, v) for v in range(4)] == [b.encode(text, v) for v in range(4)]
    assert len({e.encode(text, v) for e in (a, other) for v in range(4)}) == 8
    plain = op.Encoder(model, 0.0, 1, 1).encode(text, 0)
    assert all(model.decode(x) == text for x in (a.encode(text, 0), a.encode(text, 1), plain)) and a.encode(text, 0) != plain
    everything = op.Encoder(model, 1.0, 1, 1).encode("abc", 0)
    assert len(everything) == 16                           # no merge at all: the space and three letters
    alphabet = list(" \n\tab▁é日😀.\x00\x7f") + ["the", "  ", "▁▁"]
    for _ in range(800):
        t = "".join(rng.choices(alphabet, k=rng.randint(0, 30)))
        e = a.encode(t, rng.randrange(4))
        assert (model.decode(e) if e else "") == t


def test_merges_only_take_vocabulary_pieces(model):
    for word in (" international", " xyzzyqq", " zzzz"):
        for key in range(6):
            parts = model.segment(word, 0.4, key)
            assert "".join(parts) == word and all(len(p) == 1 or p in model.ids for p in parts)


def test_documents(spark, model):
    docs = {r.doc_id: r.text or "" for r in read_table(spark, SF, "documents").collect()}
    got = op.op5_sentencepiece(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs) and all(r.lossless for r in got)
    encoder = op.Encoder(model, op.DROPOUT, op.VARIANTS, op.SEED)
    for r in got[:60]:
        ids = encoder.encode(docs[r.doc_id], encoder.variant(r.doc_id))
        assert (r.n_ids, r.ids_crc32) == (len(ids) // 4, zlib.crc32(ids))


def test_nulls_repeats_long_texts_and_clashing_names(spark, monkeypatch):
    schema = T.StructType([T.StructField(n, T.LongType() if n == "doc_id" else T.StringType()) for n in ("doc_id", "text", "ids", "n_ids")])
    rows = [(None, None, "i", "n"), (None, "same", "i", "n"), (None, "same", None, None), (1, "", "i", "n"), (2, "ab" * 50_000, "i", "n"),
            (3, "w " * 50_000, "i", "n")]
    encoded = op.encode(spark.createDataFrame(rows, schema))
    got = encoded.select("doc_id", "text", "ids", op.decode_udf()("ids").alias("back")).collect()
    assert all(r.back == (r.text or "") for r in got) and len(got) == 6
    same = [r.ids for r in got if r.text == "same"]
    assert same[0] == same[1]
    assert op.encode(spark.createDataFrame([], schema)).collect() == []


def test_every_occurrence_has_its_own_draws(model):
    encoder = op.Encoder(model, op.DROPOUT, op.VARIANTS, op.SEED)
    word = "international"
    text = " ".join([word] * 2_000)
    seen = set()
    for doc in range(3):
        key, at, parts = encoder.key(encoder.variant(doc)), 0, []
        for w in text.split(" "):
            parts.append(model.ids_of(" " + w, op.DROPOUT, key, at))
            at += len(w) + 1
        assert encoder.encode(text, encoder.variant(doc)) == b"".join(parts)
        assert len(set(parts)) > 4                         # occurrences of one document differ
        seen.add(tuple(parts))
    assert len(seen) == 3                                  # and documents do
    starts = [encoder.encode(word, encoder.variant(doc)) for doc in range(4_000)]
    assert len(set(starts)) > 4


def test_share_of_skipped_merges_and_words_of_all_lengths(model, monkeypatch):
    monkeypatch.setattr(op, "WORDS_AT_ONCE", 7)
    monkeypatch.setattr(op, "CACHED_WORDS", 5)
    encoder = op.Encoder(model, 0.1, op.VARIANTS, 3)
    n = 20_000
    merged = np.array([len(encoder.encode("a", encoder.variant(doc))) == 4 for doc in range(n)])
    assert abs(merged.mean() - 0.9) < 0.01                 # " a" is one merge
    text = "  of the " + "ab" * 300 + " international naïve  日本 the of " * 9
    key, at, parts = encoder.key(5), 0, []
    for unit in op._RUNS.findall(" " + text):
        parts.append(model.ids_of(unit, 0.1, key, at))
        at += len(unit)
    assert encoder.encode(text, 5) == b"".join(parts) and model.decode(b"".join(parts)) == text


def naive(model, text, dropout, key):
    """Ids of a text by rescanning all neighbours before every merge."""
    ids, limit = [], int(dropout * (1 << 32))
    for unit in op._RUNS.finditer(" " + text) if text else ():
        parts = [(unit.start() + i, c) for i, c in enumerate(unit.group())]
        while True:
            best = None
            for k, ((at, left), (_, right)) in enumerate(zip(parts, parts[1:], strict=False)):
                made = model.merges.get(left + right)
                if made and not op.keyed_hash(key, at, made[1]) < limit and (best is None or (made[0], at) < best[0]):
                    best = (made[0], at), k, left + right
            if best is None:
                break
            (_, at), k, made = best
            parts[k:k + 2] = [(at, made)]
        for _, s in parts:
            ids += [model.ids[s]] if s in model.ids else [model.bytes[b] for b in s.encode()]
    return np.array(ids, "<u4").tobytes()


@pytest.mark.parametrize("chars, words", [(1_000_000, 65_536), (40, 3)])
def test_a_naive_agenda_gives_the_same_ids(model, monkeypatch, chars, words):
    monkeypatch.setattr(op, "CHUNK_CHARS", chars)
    monkeypatch.setattr(op, "WORDS_AT_ONCE", words)
    rng = random.Random(5)
    alphabet = list(" \n\tabcé▁日語😀.,1\x00\x7f") + ["the", "  ", "      ", "tion", "inter", "naïve", " of", "ab" * 20, "in" * 40]
    texts = ["", " ", "a", "  ", "x" * 64, "y" * 65, "▁ ▁"] + ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(300)]
    for dropout in (0.0, 0.1, 0.6, 1.0):
        encoder = op.Encoder(model, dropout, op.VARIANTS, 3)
        variants = [encoder.variant(i) for i in range(len(texts))]
        got = encoder.encode_all(texts, variants)
        assert got == [naive(model, t, dropout, encoder.key(v)) for t, v in zip(texts, variants, strict=True)]
        assert [model.decode(ids) if ids else "" for ids in got] == texts


def test_short_words_are_merged_together_and_only_longer_ones_by_a_heap(model, monkeypatch):
    heaped = []
    monkeypatch.setattr(model, "segment", lambda unit, *more: heaped.append(unit) or list(unit))
    op.Encoder(model, 0.1, op.VARIANTS, 3).encode(" ".join(f"word{i}er international " + "w" * 63 for i in range(500)) + " " + "z" * 64, 1)
    assert heaped == [" " + "z" * 64]


def test_pairs_of_symbols_are_found_in_a_table_that_grows():
    rng = np.random.default_rng(2)
    pairs = np.unique(rng.integers(1, 60, (2_500, 2)), axis=0)
    base, owner, made = op.pair_table(pairs[:, 0], pairs[:, 1], np.arange(len(pairs)), 60)
    known = {(int(a), int(b)): i for i, (a, b) in enumerate(pairs)}
    for a in range(60):
        for b in range(60):
            at = base[a] + b
            assert (int(made[at]) if owner[at] == a else None) == known.get((a, b))
