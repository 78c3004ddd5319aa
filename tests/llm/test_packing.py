import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from pulse.llm import packing
from pulse.llm.common import read_table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def check_places(rows, window=2048):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at and length > 0
            at += length
        assert at <= window
    return sum(r.length for r in rows) / (window * len(by))


def test_cut_words_give_the_ids_of_whole_texts(plain, monkeypatch):
    monkeypatch.setattr(packing, "CACHED_WORDS", 40)
    rng = random.Random(3)
    alphabet = list("abcÉß1²½_.,'-!| \n\t 　\x1ć😀") + [" ", " ", "\n", "the", "don't", "'s", "<|endoftext|>", "  "]
    texts = ["", " ", "\n", "a  b", " a\n\nb ", "x\0y z"] + ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(600)]
    got = list(packing.WordTokenizer().encode(texts))
    for text, ids in zip(texts, got, strict=True):
        assert list(np.frombuffer(ids, "<u4")) == plain.encode(text, add_special_tokens=False).ids, repr(text)


def test_letters_contractions_and_spaces_are_cut_as_by_the_tokenizer(plain):
    rng = random.Random(11)
    alphabet = list("azAZÀÖØöøÿ×÷ªºµáβж语'’_-.,0٣½²\n\t\r\x0b\x1c\x85\xa0\u0301\u2003\u3000") + [" "] * 8
    alphabet += ["'s", "'re", "'ve", "'ll", "'S", "it's", "<|endoftext|>", "été", "naïveж"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 25))) for _ in range(4_000)]
    for text, ids in zip(texts, packing.WordTokenizer().encode(texts), strict=True):
        assert list(np.frombuffer(ids, "<u4")) == plain.encode(text, add_special_tokens=False).ids, repr(text)


def test_the_tokenizer_is_asked_for_ids_without_offsets(plain):
    class IdsOnly:
        def encode_batch_fast(self, texts, add_special_tokens):
            return plain.encode_batch_fast(texts, add_special_tokens=add_special_tokens)

    tokenizer = packing.WordTokenizer()
    tokenizer.tokenizer = IdsOnly()
    text = "It's a naïve test,\n\nwith <|endoftext|> words"
    assert list(np.frombuffer(next(tokenizer.encode([text])), "<u4")) == plain.encode(text, add_special_tokens=False).ids


def test_tree_finds_the_tightest_window():
    rng = random.Random(1)
    for _ in range(30):
        lengths = sorted((rng.randint(1, 50) for _ in range(200)), reverse=True)
        at, offsets, opened = packing.best_fit(lengths, 50, packing.OpenWindows(50), 0)
        room, expected = [], []
        for n in lengths:
            fits = [r for r in room if r >= n]
            expected.append(50 - min(fits) if fits else 0)
            if fits:
                room[room.index(min(fits))] -= n
            else:
                room.append(50 - n)
        assert offsets == expected and opened == len(room)


def test_documents(spark, plain):
    docs = {r.doc_id: r.text or "" for r in read_table(spark, SF, "documents").collect()}
    rows = packing.op1_packing(spark, SF).collect()
    assert check_places(rows) > 0.97
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert by.keys() == docs.keys()
    for i, text in docs.items():
        ids = np.array(plain.encode(text, add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for r in sorted(by[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
            at += r.length
        assert at == len(ids)


def test_sequences_hold_the_ids(spark, plain):
    docs = read_table(spark, SF, "documents").filter("doc_id < 30")
    got = sorted(t for r in packing.sequences(docs, 256).collect() for t in np.frombuffer(r.ids, "<u4").tolist())
    texts = [r.text or "" for r in docs.collect()]
    assert got == sorted(t for x in texts for t in [*plain.encode(x, add_special_tokens=False).ids, 1])


def test_nulls_repeats_long_texts_and_clashing_names(spark):
    schema = T.StructType([T.StructField(n, T.LongType() if n == "doc_id" else T.StringType())
                           for n in ("doc_id", "text", "length", "offset")])
    rows = [(None, None, "l", "o"), (1, "", "l", "o"), *[(2, "same text", "l", "o")] * 50, (3, "word " * 30_000, None, None)]
    got = packing.pack(packing.pieces(spark.createDataFrame(rows, schema)), pieces_per_partition=10).collect()
    check_places(got)
    assert sum(r.length for r in got if r.doc_id == 3) == next(r.doc_tokens for r in got if r.doc_id == 3) > 30_000
    assert [r.doc_tokens for r in got if r.doc_id is None or r.doc_id == 1] == [1, 1]
    assert sum(r.doc_id == 2 for r in got) == 50
    empty = spark.createDataFrame([], schema)
    assert packing.pack_documents(empty).collect() == []
    assert packing.pieces(empty).agg(F.count("*")).first()[0] == 0
