"""Operator 12, byte-level BPE: prefix dynamic programming over valid token pairs.

A sequence of tokens is the encoding of its bytes exactly if each two neighbours
are: merging the bytes of both gives the two back.  So the encoding of a byte string
ends in one token only, and what is before it is the encoding of the shorter prefix.
``Prefixes`` keeps that last token for every byte prefix: appending bytes goes on from
what is there, and the ids are read off from the end.  After an edit, prefixes before it
stay, and as soon as as many prefixes in a row as the longest token has bytes agree with
the old ones, the rest is taken over (``Prefixes.replace``, and ``EncodedText`` for whole texts).

Texts are cut into pieces by the vocabulary's pattern; each piece is encoded for
itself.  The pattern's classes are those of the public encoder: a character that
Python's ``regex`` puts into another class (they know different versions of Unicode)
is cut like a character of its class there.  A worker keeps the ids of pieces that it has
met, in a bounded memory; a document's row needs nothing but its text, so any
partitioning will do and no row is shuffled.

A null text is the empty text: no ids.  Null ids and repeated rows are encoded like
others, an empty table gives no rows, long texts are encoded whole, other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import struct
import sys
from bisect import bisect_right
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from pulse.llm.common import read_table

KEPT_PIECES = 800_000          # pieces whose ids a Python worker keeps, beside those of one run of texts
RUN_CHARS = 1_000_000          # texts are cut and encoded in runs of about this many characters
KEPT_PAIRS = 1_000_000         # pairs of tokens whose validity it keeps
# Fixed value: the vocabulary's pattern, written with the classes of Python's ``re``.
_PATTERN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_SEPARATORS = re.compile("[\x1c-\x1f]")       # white space to ``re`` alone
SHORT = (2, 1)                 # token lengths to try where no longer token can end


class Vocabulary:
    """Tokens by rank, and which tokens can stand side by side."""

    def __init__(self, path: str | None = None):
        if path is None:
            import public_tokenizers
            path = public_tokenizers.path("byte_bpe_50k.tiktoken")
        with open(path, "rb") as lines:
            self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.bytes_of = {r: t for t, r in self.rank.items()}
        self.longest = max(map(len, self.rank))
        lengths: dict[bytes, set[int]] = {}
        for t in self.rank:
            lengths.setdefault(t[-3:], set()).add(len(t))
        for end, n in lengths.items():              # tokens of one or two bytes also end longer strings
            n.update(k for k in (1, 2) if k < len(end) and end[-k:] in self.rank)
        #: lengths of the tokens that can end a string with these last three bytes (or that is this short), longest first
        self.lengths = {end: sorted(n, reverse=True) for end, n in lengths.items()}
        self.pairs: dict[tuple[int, int], bool] = {}

    def merged(self, data: bytes) -> list[bytes]:
        """The merges themselves: the adjacent parts of lowest rank first, the leftmost of equal ones."""
        rank, parts = self.rank, [data[i:i + 1] for i in range(len(data))]
        while len(parts) > 1:
            ranks = [rank.get(a + b, sys.maxsize) for a, b in zip(parts, parts[1:], strict=False)]
            best = min(ranks)
            if best == sys.maxsize:
                break
            i = ranks.index(best)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def stand(self, a: int, b: int) -> bool:
        """Whether token ``b`` can follow token ``a`` (-1: the start): their bytes merge into these two."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= KEPT_PAIRS:
                self.pairs.clear()
            two = [self.bytes_of[x] for x in (a, b) if x >= 0]
            known = self.pairs[a, b] = self.merged(b"".join(two)) == two
        return known

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class Prefixes:
    """The last token of every prefix of a byte string (at 0: of the empty one, none)."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last, self.size = vocabulary, b"", [-1], [0]
        self.append(data)

    def _fill(self, start: int, stop: int) -> None:
        """The last tokens of the prefixes that end after ``start`` up to ``stop``; all shorter ones are there."""
        v, data, last, size = self.vocabulary, self.data, self.last, self.size
        rank, lengths, pairs, stand = v.rank.get, v.lengths.get, v.pairs.get, v.stand
        for end in range(start + 1, stop + 1):
            for n in lengths(data[end - 3 if end > 3 else 0:end]) or SHORT:
                if n <= end and (token := rank(data[end - n:end])) is not None:
                    before = last[end - n]
                    known = pairs((before, token))
                    if known if known is not None else stand(before, token):
                        last.append(token)
                        size.append(n)
                        break

    def keep(self, n: int) -> None:
        """Drop all but the first ``n`` bytes."""
        self.data = self.data[:n]
        del self.last[n + 1:], self.size[n + 1:]

    def append(self, more: bytes) -> None:
        start = len(self.data)
        self.data += more
        self._fill(start, len(self.data))

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Put ``new`` in place of the bytes from ``start`` to ``end``; returns the number of prefixes computed."""
        tail, old_last, old_size, longest = self.data[end:], self.last, self.size, self.vocabulary.longest
        self.data = self.data[:start] + new + tail
        self.last, self.size = old_last[:start + 1], old_size[:start + 1]
        shift, same = len(new) - (end - start), 0
        for at in range(start + 1, len(self.data) + 1):
            self._fill(at - 1, at)
            before = at - shift
            # prefixes inside the new bytes have no counterpart; a token that begins before the tail compares its bytes, too
            if at > start + len(new) and (self.last[at], self.size[at]) == (old_last[before], old_size[before]):
                same += 1
                if same >= longest:
                    self.last += old_last[before + 1:]
                    self.size += old_size[before + 1:]
                    return at - start
            else:
                same = 0
        return len(self.data) - start

    def ids(self) -> list[int]:
        out, at = [], len(self.data)
        while at:
            out.append(self.last[at])
            at -= self.size[at]
        return out[::-1]


class Pieces:
    """Cuts texts as the public encoder's pattern does.

    The usual pattern is matched by Python's ``re``, whose classes differ for more characters, but faster; another one by ``regex``.
    """

    STAND_INS = {"letter": "x", "number": "1", "other": "!"}

    def __init__(self, pattern: str | None = None):
        import public_tokenizers
        import tiktoken
        if pattern is None:
            self.pattern, own = _PATTERN, {"letter": r"[^\W\d_]", "number": r"\d", "other": r"[^\s\w]|_"}
            self.own = {name: re.compile(x) for name, x in own.items()}
        else:
            self.pattern, own = regex.compile(pattern), {"letter": r"\p{L}", "number": r"\p{N}", "other": r"[^\s\p{L}\p{N}]"}
            self.own = {name: regex.compile(x) for name, x in own.items()}
        # "a" and "1" merge with any byte that follows in the same piece, which shows a character's class
        ranks = {bytes([i]): i for i in range(256)}
        for head in (b"a", b"1"):
            for i in range(256):
                ranks[head + bytes([i])] = len(ranks)
        self.probe = tiktoken.Encoding("classes", pat_str=pattern or public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.met: set[str] = set()
        self.table: dict[int, str] = {}

    def _class(self, char: str) -> str:
        if self.probe.encode_ordinary("a" + char)[0] > 255:
            return "letter"
        return "number" if self.probe.encode_ordinary("1" + char)[0] > 255 else "other"

    def shadow(self, text: str) -> str:
        """The text with a stand-in for each character whose class differs between the two."""
        if text.isascii() and not _SEPARATORS.search(text):
            return text
        chars = set(text)
        for char in chars - self.met:
            self.met.add(char)
            if char in "\x1c\x1d\x1e\x1f" or not (char.isascii() or char.isspace()):
                there = self._class(char)
                if not self.own[there].fullmatch(char):
                    self.table[ord(char)] = self.STAND_INS[there]
        return text.translate(self.table) if any(ord(c) in self.table for c in chars) else text

    def cut(self, text: str) -> list[str]:
        shadow = self.shadow(text)
        if shadow is text:
            return self.pattern.findall(text)
        return [text[m.start():m.end()] for m in self.pattern.finditer(shadow)]

    def starts(self, text: str, at: int = 0) -> Iterator[int]:
        """Where the pieces of ``text`` from ``at`` on begin, ``at`` being such a place."""
        return (m.start() for m in self.pattern.finditer(self.shadow(text), at))


class EncodedText:
    """A text with the prefixes of its pieces: appends and edits encode again only what they reach."""

    def __init__(self, encoder: Encoder, text: str = ""):
        self.encoder, self.text, self.places, self.parts, self.computed = encoder, "", [], [], 0
        self.replace(0, 0, text)

    def append(self, more: str) -> None:
        self.replace(len(self.text), len(self.text), more)

    def replace(self, start: int, end: int, new: str) -> None:
        text = self.text[:start] + new + self.text[end:]
        shift = len(new) - (end - start)
        # The pattern looks at most one character behind a run of white space that it gives one back of: a piece is safe if it ends two before.
        first = bisect_right(self.places, start) - 1
        while first > 0 and self.places[first] + 2 > start:
            first -= 1
        first = max(first - 1, 0)
        at = self.places[first] if self.places else 0
        places, parts, old = self.places[:first], self.parts[:first], dict(zip(self.places[first:], self.parts[first:], strict=True))
        order, self.computed = self.places, 0
        cuts = list(places)
        tail = None
        for place in self.encoder.pieces.starts(text, at):
            if place - shift >= end and (place - shift) in old and place >= start + len(new):
                tail = place
                break
            cuts.append(place)
        stop = tail if tail is not None else len(text)
        for place, until in zip(cuts[first:], [*cuts[first + 1:], stop], strict=False):
            data, known = text[place:until].encode(), old.get(place) if place < start else None
            if known is None:
                part = Prefixes(self.encoder.vocabulary, data)
                self.computed += len(data)
            else:                                   # the bytes before the edit stay as they are
                part = known
                head = 0
                while head < min(len(data), len(part.data)) and data[head] == part.data[head]:
                    head += 1
                back = 0
                while back < min(len(data), len(part.data)) - head and data[-1 - back] == part.data[-1 - back]:
                    back += 1
                self.computed += part.replace(head, len(part.data) - back, data[head:len(data) - back])
            parts.append(part)
        if tail is not None:
            i = bisect_right(order, tail - shift) - 1
            cuts += [p + shift for p in order[i:]]
            parts += self.parts[i:]
        self.text, self.places, self.parts = text, cuts, parts

    def ids(self) -> list[int]:
        return [i for part in self.parts for i in part.ids()]


class Encoder:
    """Ids of texts, with a bounded memory of pieces."""

    def __init__(self, vocabulary: str | None = None, pattern: str | None = None):
        self.vocabulary, self.pieces = Vocabulary(vocabulary), Pieces(pattern)
        self.known: dict[str, bytes] = {}

    def _learn(self, pieces: Iterable[str]) -> None:
        """Ids of new pieces, in order, so that each goes on from the prefixes that it shares with the one before."""
        part, whole = Prefixes(self.vocabulary), self.vocabulary.rank
        for data in sorted(p.encode() for p in pieces):
            if data in whole:                            # as the public encoder does, without a merge
                ids = [whole[data]]
            else:
                part.keep(len(os.path.commonprefix((part.data, data))))
                part.append(data[len(part.data):])
                ids = part.ids()
            self.known[data.decode()] = struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, texts: Sequence[str]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text; texts are cut in runs of ``RUN_CHARS``, and a longer one alone."""
        i = 0
        while i < len(texts):
            size, j = len(texts[i]), i + 1
            while j < len(texts) and size + len(texts[j]) <= RUN_CHARS:
                size, j = size + len(texts[j]), j + 1
            cut = [self.pieces.cut(t) for t in texts[i:j]]
            missing = set().union(*cut).difference(self.known)
            if len(self.known) + len(missing) > KEPT_PIECES:      # forget, and learn this run's pieces
                self.known.clear()
                missing = set().union(*cut)
            self._learn(missing)
            known = self.known
            yield from (b"".join(map(known.__getitem__, c)) for c in cut)
            i = j

    def decode(self, ids: bytes) -> bytes:
        return self.vocabulary.decode(np.frombuffer(ids, "<u4").tolist())


_encoders: dict[tuple, Encoder] = {}


def encoder_for(vocabulary: str | None = None, pattern: str | None = None) -> Encoder:
    """One encoder per Python worker, vocabulary and pattern."""
    if (vocabulary, pattern) not in _encoders:
        _encoders[vocabulary, pattern] = Encoder(vocabulary, pattern)
    return _encoders[vocabulary, pattern]


def encoded(documents: DataFrame, vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, ids: the token ids of each text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(vocabulary, pattern)
        for batch in batches:
            ids = [np.frombuffer(x, "<u4").astype("int32") for x in encoder.encode([t or "" for t in batch.column(1).to_pylist()])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])
    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decoded(rows: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, data: the bytes of each row's ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = encoder_for(vocabulary).vocabulary
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v.decode(x or ()) for x in batch.column(1).to_pylist()], pa.binary())],
                                             ["doc_id", "data"])
    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")


def digests(documents: DataFrame, vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: each text encoded, its ids decoded, in one pass; ids are not kept."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(vocabulary, pattern)
        for batch in batches:
            n, ids_hex, text_hex = [], [], []
            for ids in encoder.encode([t or "" for t in batch.column(1).to_pylist()]):
                n.append(len(ids) // 4)
                ids_hex.append(hashlib.sha256(ids).hexdigest())
                text_hex.append(hashlib.sha256(encoder.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(text_hex, pa.string())],
                                             ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, encoded and decoded."""
    return digests(read_table(spark, sf_dir, "documents"))
