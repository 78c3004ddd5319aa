import hashlib
import random

import base64
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from pulse.llm import byte_bpe
from pulse.llm.byte_bpe import EncodedText, Encoder, Prefixes, decoded, digests, encoded, op12_byte_bpe
from pulse.llm.common import read_table, with_package

SF = "/root/testdata/sf0.001"
# letters, numbers and others that differ by version of Unicode, marks, wide spaces, parts of frequent tokens
ALPHABET = [*"abcÉß1²½_.,'-!| \n\t\r\x1c", "　", " ", "ć", "😀", "汉", "字", "՘", "࢏", "Ᲊ", "\U00011de0", " ", " ", "  ", "\n",
            "the", "don't", "'s", "'re", "tion", "ÃÂ", "----", "<|endoftext|>"]


@pytest.fixture(scope="module")
def plain():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return Encoder()


def ids_of(encoder, text):
    return np.frombuffer(next(encoder.encode([text])), "<u4").tolist()


def random_text(rng, n):
    return "".join(rng.choices(ALPHABET, k=rng.randint(0, n)))


def test_ids_are_the_public_encoders(encoder, plain):
    rng = random.Random(7)
    texts = ["", " ", "\n", "a  b", " a\n\nb ", "x\0y z", "a" * 5000, " " * 700, "ÃÂ" * 300, "汉" * 400] + [random_text(rng, 60) for _ in range(3000)]
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode_ordinary(text), repr(text)
        assert encoder.decode(ids) == text.encode()


def test_memory_that_overflows_changes_nothing(plain, monkeypatch):
    monkeypatch.setattr(byte_bpe, "KEPT_PIECES", 30)
    monkeypatch.setattr(byte_bpe, "KEPT_PAIRS", 50)
    monkeypatch.setattr(byte_bpe, "RUN_CHARS", 100)
    rng, small = random.Random(8), Encoder()
    texts = [random_text(rng, 40) for _ in range(300)]
    assert [np.frombuffer(x, "<u4").tolist() for x in small.encode(texts)] == [plain.encode_ordinary(t) for t in texts]


def test_every_prefix_has_one_valid_last_token(encoder):
    v = encoder.vocabulary
    for data in (b" unbelievably", "naïveté".encode(), b"aaaaaaaa", b"----------=="):
        table = Prefixes(v, data)
        for end in range(1, len(data) + 1):
            valid = [n for n in range(1, end + 1) if data[end - n:end] in v.rank and v.stand(table.last[end - n], v.rank[data[end - n:end]])]
            assert valid == [table.size[end]]
            assert [v.bytes_of[i] for i in Prefixes(v, data[:end]).ids()] == v.merged(data[:end])


def test_appends_and_edits_equal_a_fresh_encoding(encoder, plain):
    rng = random.Random(9)
    for _ in range(600):
        text = EncodedText(encoder, random_text(rng, 40))
        for _ in range(4):
            a = rng.randint(0, len(text.text))
            b = rng.randint(a, min(len(text.text), a + 5))
            new = random_text(rng, 4)
            want = text.text + new if rng.random() < 0.3 else text.text[:a] + new + text.text[b:]
            text.append(new) if want == text.text + new else text.replace(a, b, new)
            assert text.text == want and text.ids() == plain.encode_ordinary(want), repr(want)


def test_an_edit_of_a_long_text_computes_little(encoder, plain):
    for text in ("ab cd the quick " * 3000, "ab" * 20000):
        held = EncodedText(encoder, text)
        held.replace(20000, 20001, "ZZ")
        assert held.computed < 300 and held.ids() == plain.encode_ordinary(held.text)
        held.append("abab")
        assert held.computed < 300 and held.ids() == plain.encode_ordinary(held.text)


def check(rows, texts, plain):
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows)
    want = []
    for doc_id, text in texts:
        ids = plain.encode_ordinary(text or "")
        want.append((doc_id is not None, doc_id or 0, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want)


def test_query_equals_the_public_encoder(spark, plain):
    docs = read_table(spark, SF, "documents")
    check(op12_byte_bpe(with_package(spark), SF).collect(), [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], plain)


def test_edge_rows(spark, plain):
    with_package(spark)
    rows = [(1, None), (2, ""), (None, "a null id"), (3, "twice"), (3, "twice"), (4, "long wörds " * 30000), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("x")).withColumn("n_tokens", F.lit(0))
    check(digests(docs).collect(), rows, plain)
    back = decoded(encoded(docs)).collect()
    assert sorted((r.doc_id or 0, bytes(r.data).decode()) for r in back) == sorted((i or 0, t or "") for i, t in rows)
    assert digests(docs.limit(0)).collect() == [] and encoded(docs.limit(0)).collect() == []
