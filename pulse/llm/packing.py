"""Operator 1, packing: best-fit decreasing over windows of a fixed length.

Documents are tokenized (byte-level BPE, then an end token) and cut into full
windows and a rest.  The pieces of a partition arrive longest first; each goes to
the open window with the least room that still holds it, found in a segment tree
indexed by remaining capacity, or opens a new window.  No piece is cut again.

Tokenizing is one pass over the texts and leaves narrow rows (document, span,
digest); only these are shuffled, dealt by hash over partitions of about
``PIECES_PER_PARTITION`` pieces, which is enough for the padding to be small.  A
packer holds open windows only, never pieces.  ``sequences`` puts the token ids
themselves together.

A null text is the empty text: the end token alone.  Null ids and repeated rows are
packed like any others; equal lengths are taken in the order of id, start and digest;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulse.llm.common import partitions_for, read_table, write_shared

WINDOW, END_ID = 2048, 1
PIECES_PER_PARTITION = 100_000
CACHED_WORDS = 1_000_000        # pre-tokens whose ids a Python worker keeps, and those of one run of texts
CHUNK_CHARS = 1_000_000        # texts are tokenized in runs of about this many characters

# Fixed value: the vocabulary's pre-tokenizer, written with classes of Python's ``re``.  Words of Latin-1 letters alone come first, since
# plain ranges are fastest; the alternatives of letters, contractions and digits exclude each other, so their order does not matter.
_WORDS = re.compile(r" ?[a-zA-ZÀ-ÖØ-öø-ÿ]++(?!\w)|'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
# Characters that those classes take for others than the pre-tokenizer does; texts with them, or with special tokens, go whole.
_OTHER = frozenset(c for c in map(chr, range(0x110000)) if c.isnumeric() and not c.isdecimal()) | set("\x1c\x1d\x1e\x1f")


class WordTokenizer:
    """Ids of texts, by the public tokenizer of the vocabulary file, with a bounded memory of pre-tokens.

    A text is cut where the tokenizer's own pre-tokenizer cuts, so the ids are those of the whole text.
    """

    def __init__(self, vocabulary: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        if vocabulary is None:
            import public_tokenizers
            vocabulary = public_tokenizers.path("byte_bpe_50k.json")
        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.known: dict[str, bytes] = {}
        self.odd: set[str] = set()                        # of these: a text with one goes whole
        self.feed = self._ids("\n")

    def _ids(self, text: str) -> np.ndarray:
        """Ids by the tokenizer, without the offsets that ``encode`` would work out."""
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _learn(self, missing: list[str]) -> None:
        """Ids of new pre-tokens: all in one text with line feeds between, which are cut off from their neighbours."""
        words, line = [], "".join(missing)
        plain = "<|" not in line and _OTHER.isdisjoint(line)
        for w in missing:
            if not plain and ("<|" in w or not _OTHER.isdisjoint(w)):
                self.known[w] = b""
                self.odd.add(w)
            elif w.isspace():
                self.known[w] = self._ids(w).tobytes()
            else:
                words.append(w)
        if not words:
            return
        ids = self._ids("\n".join(words))
        cuts, ids = (4 * np.flatnonzero(ids == self.feed[0])).tolist(), ids.tobytes()
        for w, a, b in zip(words, [0, *(c + 4 for c in cuts)], [*cuts, len(ids)], strict=True):
            self.known[w] = ids[a:b]

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        i = 0
        while i < len(texts):
            size, j = 0, i
            while j < len(texts) and (j == i or size + len(texts[j]) <= CHUNK_CHARS):
                size += len(texts[j])
                j += 1
            words = [_WORDS.findall(t) for t in texts[i:j]]
            missing = set().union(*words).difference(self.known)
            if len(self.known) + len(missing) > CACHED_WORDS:   # forget, and learn this run's words
                self.known.clear()
                self.odd.clear()
                missing = set().union(*words)
            self._learn(sorted(missing))
            for w, text in zip(words, texts[i:j], strict=True):
                if self.odd and not self.odd.isdisjoint(w):
                    yield self._ids(text).tobytes()
                else:
                    yield b"".join(map(self.known.__getitem__, w))
            i = j


_tokenizers: dict[str | None, WordTokenizer] = {}


def tokenizer_for(vocabulary: str | None) -> WordTokenizer:
    """One tokenizer per Python worker and vocabulary."""
    if vocabulary not in _tokenizers:
        _tokenizers[vocabulary] = WordTokenizer(vocabulary)
    return _tokenizers[vocabulary]


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID,
           vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens per piece: full windows, then the rest; ``ids`` if asked for."""
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
              ("doc_tokens", pa.int64())] + ([("ids", pa.binary())] if with_ids else [])
    schema, end = pa.schema(fields), np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokenizer_for(vocabulary)
        for batch in batches:
            rows: list[tuple] = []
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), tokenizer.encode(texts), strict=True):
                ids += end
                total = len(ids) // 4
                for start in range(0, total, window):
                    part = ids[4 * start:4 * (start + window)]
                    rows.append((doc_id, start, len(part) // 4, zlib.crc32(part), total, part))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, f[1]) for c, f in zip(columns, fields, strict=False)], schema=schema)

    ddl = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + (", ids binary" if with_ids else "")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, ddl)


class OpenWindows:
    """Open windows by remaining capacity: a segment tree whose nodes count the windows below them."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.stacks: list[list] = [[] for _ in range(window + 1)]

    def _add(self, room: int, n: int) -> None:
        node = self.leaves + room
        while node:
            self.count[node] += n
            node >>= 1

    def push(self, room: int, window: int) -> None:
        self.stacks[room].append(window)
        self._add(room, 1)

    def pop(self, length: int) -> tuple[int, int] | None:
        """The tightest open window with room for ``length``: (room, window)."""
        count, node = self.count, self.leaves + length
        while not count[node]:                             # up to the first subtree on the right that holds a window
            while node & 1:
                node >>= 1
                if node <= 1:
                    return None
            node += 1
        while node < self.leaves:                          # down to its leftmost
            node = 2 * node if count[2 * node] else 2 * node + 1
        room = node - self.leaves
        self._add(room, -1)
        return room, self.stacks[room].pop()


def best_fit(lengths, window: int, open_windows: OpenWindows, opened: int):
    """Window and offset of each length, in the order given; number of windows opened so far."""
    at, offsets = [], []
    for length in lengths:
        found = open_windows.pop(length) if length < window else None
        if found is None:
            room, w = window, opened
            opened += 1
        else:
            room, w = found
        at.append(w)
        offsets.append(window - room)
        if room > length:
            open_windows.push(room - length, w)
    return at, offsets, opened


def pack(cut: DataFrame, window: int = WINDOW, pieces_per_partition: int = PIECES_PER_PARTITION) -> DataFrame:
    """``cut`` (with doc_id, start, length, ids_crc32) and each row's ``sequence_id`` and ``offset``."""
    n = cut.count()
    schema = cut.schema.add("sequence_id", "long").add("offset", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        open_windows, opened = OpenWindows(window), 0
        for batch in batches:
            at, offsets, opened = best_fit(batch.column("length").to_pylist(), window, open_windows, opened)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([base + w for w in at], pa.int64()), pa.array(offsets, pa.int64())],
                names=[*batch.schema.names, "sequence_id", "offset"])

    dealt = cut.repartition(partitions_for(n, pieces_per_partition), "doc_id", "start", "ids_crc32")
    return dealt.sortWithinPartitions(F.desc("length"), "doc_id", "start", "ids_crc32").mapInArrow(run, schema)


def pack_documents(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """The pieces of ``docs`` with their places."""
    return pack(write_shared(pieces(docs, vocabulary=vocabulary), "pieces"))


def sequences(docs: DataFrame, window: int = WINDOW, end_id: int = END_ID, vocabulary: str | None = None) -> DataFrame:
    """sequence_id and the token ids (little-endian unsigned 32-bit) of every packed sequence, without padding."""
    placed = pack(write_shared(pieces(docs, window=window, end_id=end_id, vocabulary=vocabulary, with_ids=True), "pieces"), window)
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))   # one window of pieces at most
    return placed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id", F.expr("aggregate(parts, X'', (a, p) -> concat(a, p.ids))").alias("ids"))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return pack_documents(read_table(spark, sf_dir, "documents"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: the pieces of all documents that are left."""
    return pack_documents(docs)
