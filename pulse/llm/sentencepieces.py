"""Operator 5, SentencePiece encoding and decoding with seeded merge-dropout.

A text is segmented by the merges of a public BPE model.  An agenda (priority queue)
holds the candidate merges of neighbouring symbols, best score first, then
leftmost.  Each candidate that comes up is skipped with probability ``dropout``, decided by a
keyed hash of seed, document (its variant: a hash of its id), place in the text and the piece it would make, and the rest are
merged.  So every occurrence of a word has its own draws, one seed always gives one
segmentation of a document, and every one
decodes to the same text.  Without dropout the ids are the model's own.

No piece holds a space after another character, so a text is segmented space by space.
Symbols are numbers, and a table says which piece two of them make.  The agendas of many words stand
side by side, a column each, and all words take their first candidate at once, until none has one; a skipped
candidate never enters, which is the same, as its draw does not depend on when it comes up.  Each
occurrence is merged by itself; nothing is remembered between texts.  Longer words have a heap each; texts are processed whole.
Symbols outside the vocabulary become byte pieces.  The model is read from its public file, never trained.

Null and empty texts have no ids and decode to the empty text.  A null id counts as the
id "null".  Repeated rows are alike; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulse.llm.common import read_table

DROPOUT, VARIANTS, SEED = 0.1, 1 << 64, 17  # variants: keys that a document's key is one of
WORDS_AT_ONCE = 65_536                      # words that are merged at once
CACHED_WORDS = 0                            # words a worker remembers from one run of texts to the next: none
CHUNK_CHARS = 1_000_000                     # texts are merged in runs of about this many characters
WIDTHS = (2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 14, 16, 20, 24, 32, 48, 64)   # rows of the agendas; longer words have a heap

_RUNS = re.compile(r" +[^ ]*")
_M64 = (1 << 64) - 1
_PLACE, _PIECE, _MIX = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
# An agenda's entry: rank of the score, place, symbol made.
_RANK, _AT, _SYMBOL, _NONE = 43, 20, (1 << 20) - 1, (1 << 63) - 1


def keyed_hash(key: int, place: int, piece: int) -> int:
    """32 bits from a key, a place and the piece that a merge would make."""
    h = (key + place * _PLACE + piece * _PIECE) & _M64
    return ((h ^ (h >> 31)) * _MIX & _M64) >> 32


def pair_table(left: np.ndarray, right: np.ndarray, value: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base, owner, value): the pair l, r is at ``base[l] + r`` if ``owner`` there is l.  Rows of one l are shifted until they fit between the others."""
    size, rng = 1 << (4 * len(left)).bit_length(), np.random.default_rng(0)
    base, owner, values = np.zeros(symbols, np.int64), np.full(size + symbols, -1, np.int32), np.zeros(size + symbols, np.int64)
    order = np.argsort(left, kind="stable")
    rows = np.split(order, np.flatnonzero(np.diff(left[order])) + 1) if len(left) else []
    for row in sorted(rows, key=len, reverse=True):
        to = right[row]
        tries = 0
        while (owner[to + (at := int(rng.integers(size)))] >= 0).any():
            tries += 1
            if tries % 1000 == 0:                          # too full for this row
                owner, values = np.r_[owner, np.full(size, -1, np.int32)], np.r_[values, np.zeros(size, np.int64)]
                size *= 2
        base[left[row[0]]], owner[to + at], values[to + at] = at, left[row], value[row]
    return base, owner, values


class PieceModel:
    """Pieces, scores and byte pieces of a SentencePiece BPE model, spaces written as spaces."""

    def __init__(self, path: str | None = None):
        import sentencepiece
        if path is None:
            import public_tokenizers
            path = public_tokenizers.path("piece_bpe_32k.model")
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.ids, self.merges, self.bytes, self.raw = {}, {}, [0] * 256, [b""] * n
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.bytes[value], self.raw[i] = i, bytes([value])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                piece = piece.replace("▁", " ")
                self.ids[piece], self.merges[piece], self.raw[i] = i, (-model.get_score(i), i), piece.encode()
        self._number()

    def _number(self) -> None:
        """Tables by symbol: 0 is a character that no piece holds, -1 one that has been merged into the symbol before it."""
        self.symbols = {s: i + 1 for i, s in enumerate(dict.fromkeys([*self.ids, *sorted(set("".join(self.ids)))]))}
        n = len(self.symbols) + 1
        self.of_char = np.zeros(0x110000, np.int32)
        self.id_of, order, pairs = np.full(n, -1, np.int64), np.zeros(n), []
        for s, i in self.symbols.items():
            if len(s) == 1:
                self.of_char[ord(s)] = i
            if s in self.ids:
                order[i], self.id_of[i] = self.merges[s][0], self.ids[s]
                pairs += [(self.symbols[s[:k]], self.symbols[s[k:]], i) for k in range(1, len(s)) if s[:k] in self.symbols and s[k:] in self.symbols]
        self.raw_sizes = np.array([len(r) for r in self.raw], np.int64)
        self.raw_ends, self.raw_bytes = np.cumsum(self.raw_sizes), np.frombuffer(b"".join(self.raw), np.uint8)
        self.byte_ids = np.array(self.bytes, np.int64)
        self.draws = self.id_of.astype(np.uint64) * np.uint64(_PIECE)
        rank = np.unique(order, return_inverse=True)[1]
        left, right, made = np.array(pairs, np.int64).reshape(-1, 3).T
        self.base, self.owner, self.made = pair_table(left, right, rank[made] << _RANK | made, n)

    def segment(self, unit: str, dropout: float, key: int, at: int = 0) -> list[str]:
        """The symbols of a unit, whose place in the text is ``at``, after its merges."""
        return self._merge(unit, int(dropout * (1 << 32)), key, at)

    def _merge(self, unit: str, limit: int, key: int, at: int) -> list[str]:
        """The symbols of a unit, by a heap."""
        symbols: list = list(unit)
        n, find, push, pop = len(symbols), self.merges.get, heapq.heappush, heapq.heappop
        agenda = []
        following, before = list(range(1, n + 1)), list(range(-1, n - 1))
        for i in range(n - 1):
            merged = symbols[i] + symbols[i + 1]
            if (m := find(merged)) is not None:
                agenda.append((m[0], i, m[1], merged))
        heapq.heapify(agenda)
        while agenda:
            rank, i, piece, merged = pop(agenda)
            j = following[i]
            if j >= n or symbols[i] is None or symbols[i] + symbols[j] != merged:
                continue                                   # one of the two has been merged meanwhile
            if limit and keyed_hash(key, at + i, piece) < limit:
                continue
            after = following[j]
            symbols[i], symbols[j], following[i] = merged, None, after
            if after < n:
                before[after] = i
                joined = merged + symbols[after]
                if (m := find(joined)) is not None:
                    push(agenda, (m[0], i, m[1], joined))
            if (a := before[i]) >= 0:
                joined = symbols[a] + merged
                if (m := find(joined)) is not None:
                    push(agenda, (m[0], a, m[1], joined))
        return [s for s in symbols if s is not None]

    def ids_of(self, unit: str, dropout: float, key: int, at: int = 0) -> bytes:
        """Little-endian unsigned 32-bit ids of a unit."""
        ids = []
        for s in self.segment(unit, dropout, key, at):
            i = self.ids.get(s)
            if i is not None:
                ids.append(i)
            else:
                ids += [self.bytes[b] for b in s.encode()]
        return array("I", ids).tobytes()

    def merge_columns(self, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray, width: int, draws: np.ndarray, limit: int) -> None:
        """Merge the words of at most ``width`` of ``symbols`` in place; ``draws`` is each place's part of the keyed hash."""
        n, shortest = len(starts), int(lengths.min())
        cells = (width + 1) * n                            # one row more, before and after every word, stays empty
        held, place, agenda = np.zeros(cells, np.int64), np.zeros(cells if limit else 0, np.uint64), np.full(cells, _NONE)
        following, before = np.arange(n, n + cells), np.arange(-n, cells - n)
        before[:n] += cells
        for row in range(width):
            here = slice(row * n, row * n + n)
            held[here] = symbols.take(starts + row)
            if row >= shortest:
                held[here] *= lengths > row
            if limit:
                place[here] = draws.take(starts + row)

        def enter(at: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
            """The candidates of these neighbours come to stand at ``at``, if they make a piece and are not skipped."""
            slot = self.base.take(left)
            slot += right
            pairs = np.flatnonzero(self.owner.take(slot) == left)
            at, key = at.take(pairs), self.made.take(slot.take(pairs))
            if limit:
                h = self.draws.take(key & _SYMBOL)
                h += place.take(at)
                h ^= h >> np.uint64(31)
                h *= np.uint64(_MIX)
                h >>= np.uint64(32)
                key |= (h < np.uint64(limit)) * np.int64(_NONE)
            key |= at << _AT
            agenda[at] = key

        enter(np.arange(cells - 2 * n), held[:cells - 2 * n], held[n:cells - n])
        while True:
            first = agenda[:width * n].reshape(width, n).min(axis=0)
            first = first.take(np.flatnonzero(first != _NONE))
            if not len(first):
                break
            at, merged = first >> _AT & (1 << _RANK - _AT) - 1, first & _SYMBOL
            gone, a = following.take(at), before.take(at)
            after = following.take(gone)
            held[at], held[gone], following[at], before[after] = merged, -1, after, at
            agenda[at] = agenda[gone] = agenda[a] = _NONE
            enter(at, merged, held.take(after))
            enter(a, held.take(a), merged)
        for row in range(width):
            here = np.flatnonzero(lengths > row) if row >= shortest else slice(None)
            symbols[starts[here] + row] = held[row * n:row * n + n][here]

    def decode(self, ids: bytes) -> str:
        """The text of ids; the space that was put before the first word is taken off."""
        out, numbers = [], np.frombuffer(ids, "<u4")
        for i in range(0, len(numbers), CHUNK_CHARS):
            part = numbers[i:i + CHUNK_CHARS].astype(np.int64)
            sizes = self.raw_sizes.take(part)
            ends = np.cumsum(sizes)
            out.append(self.raw_bytes.take(np.repeat(self.raw_ends.take(part) - ends, sizes) + np.arange(ends[-1])).tobytes())
        return b"".join(out).decode(errors="replace")[1:]


class Encoder:
    """Encodes texts with one seed."""

    def __init__(self, model: PieceModel, dropout: float, variants: int, seed: int):
        self.model, self.dropout, self.variants, self.seed = model, dropout, variants, seed
        self.limit = int(dropout * (1 << 32))

    def variant(self, doc_id) -> int:
        name = f"{self.seed}:{'null' if doc_id is None else doc_id}"
        return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest()) % self.variants

    def key(self, variant: int) -> int:
        return int.from_bytes(hashlib.blake2b(f"{self.seed}:{variant}".encode(), digest_size=8).digest())

    def encode(self, text: str, variant: int) -> bytes:
        return self.encode_all([text], [variant])[0]

    def encode_all(self, texts: list[str], variants: list[int]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        out: list[list[bytes]] = [[] for _ in texts]
        run: list[tuple[int, int, int, str]] = []
        size = 0
        for i, (text, variant) in enumerate(zip(texts, variants, strict=True)):
            key = self.key(variant) if text else 0
            for at, part in _parts(" " + text) if text else ():
                if run and size + len(part) > CHUNK_CHARS:
                    self._encode_run(run, out)
                    run, size = [], 0
                run.append((i, key, at, part))
                size += len(part)
        if run:
            self._encode_run(run, out)
        return [b"".join(x) for x in out]

    def _encode_run(self, run: list[tuple[int, int, int, str]], out: list[list[bytes]]) -> None:
        """Ids of parts of texts (number, key, place, part), added to those of their texts."""
        model, line = self.model, "".join([part for *_, part in run])
        codes = np.frombuffer(line.encode("utf-32-le"), "<u4")
        sizes = np.array([len(part) for *_, part in run])
        begins = np.cumsum(sizes) - sizes
        new = codes == 32
        new[1:] &= ~new[:-1]
        new[begins] = True
        starts = np.flatnonzero(new)
        lengths = np.diff(starts, append=len(codes))
        symbols = np.zeros(len(codes) + WIDTHS[-1], np.int32)
        symbols[:len(codes)] = model.of_char[codes]
        draws = np.zeros(len(symbols), np.uint64)
        if self.limit:
            offsets = [(key + (at - begin) * _PLACE) & _M64 for (_, key, at, _), begin in zip(run, begins.tolist(), strict=True)]
            draws[:len(codes)] = np.repeat(np.array(offsets, np.uint64), sizes)
            draws += np.arange(len(draws), dtype=np.uint64) * np.uint64(_PLACE)
        low = 1
        for width in WIDTHS:
            words = np.flatnonzero((lengths > low) & (lengths <= width))
            for k in range(0, len(words), WORDS_AT_ONCE):
                some = words[k:k + WORDS_AT_ONCE]
                model.merge_columns(symbols, starts[some], lengths[some], width, draws, self.limit)
            low = width
        part_of = np.searchsorted(begins, starts, "right") - 1
        for w in np.flatnonzero(lengths > low).tolist():
            _, key, at, _ = run[part_of[w]]
            a, n = int(starts[w]), int(lengths[w])
            pieces = model.segment(line[a:a + n], self.dropout, key, at + a - int(begins[part_of[w]]))
            heads = a + np.cumsum([0, *map(len, pieces)])[:-1]
            symbols[a:a + n] = -1
            symbols[heads] = [model.symbols.get(p, 0) for p in pieces]
        left = np.flatnonzero(symbols[:len(codes)] >= 0)
        ids = model.id_of[symbols[left]]
        ends = np.searchsorted(left, begins[1:])
        other = np.flatnonzero(ids < 0)                    # characters to write in bytes
        if len(other):
            chars = codes[left[other]]
            times = np.ones(len(ids), np.int64)
            times[other] = 1 + (chars > 0x7F) + (chars > 0x7FF) + (chars > 0xFFFF)
            ends = np.r_[0, np.cumsum(times)][ends]
            ids = np.repeat(ids, times)
            ids[ids < 0] = model.byte_ids[np.frombuffer("".join(map(chr, chars.tolist())).encode(), np.uint8)]
        for (i, *_), part in zip(run, np.split(ids.astype("<u4"), ends), strict=True):
            out[i].append(part.tobytes())


def _parts(text: str) -> Iterator[tuple[int, str]]:
    """(place, part) of a text, cut between words where it is long."""
    at = 0
    while len(text) - at > CHUNK_CHARS:
        cut = next((u.start() for u in _RUNS.finditer(text, at + CHUNK_CHARS) if text[u.start() - 1] != " "), None)
        if cut is None:
            break
        yield at, text[at:cut]
        at = cut
    yield at, text[at:] if at else text


_encoders: dict[tuple, Encoder] = {}


def encoder_for(path: str | None, dropout: float, variants: int, seed: int) -> Encoder:
    """One encoder per Python worker and setting."""
    setting = (path, dropout, variants, seed)
    if setting not in _encoders:
        _encoders[setting] = Encoder(PieceModel(path), dropout, variants, seed)
    return _encoders[setting]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dropout: float = DROPOUT, variants: int = VARIANTS,
           seed: int = SEED, model: str | None = None) -> DataFrame:
    """doc_id, text, ids (little-endian unsigned 32-bit) of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(model, dropout, variants, seed)
        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            ids = encoder.encode_all([t or "" for t in batch.column("text").to_pylist()], [encoder.variant(i) for i in doc_ids])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text").cast(pa.string()), pa.array(ids, pa.binary())],
                                             schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, text string, ids binary")


def decode_udf(model: str | None = None):
    """Texts of a column of ids."""
    @F.arrow_udf("string")
    def run(ids: pa.Array) -> pa.Array:
        pieces = encoder_for(model, 0.0, 1, 0).model
        return pa.array([None if i is None else pieces.decode(i) if i else "" for i in ids.to_pylist()], pa.string())
    return run


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and digest of every document's ids, and whether they decode to its text."""
    encoded = encode(read_table(spark, sf_dir, "documents"))
    return encoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_ids"), F.crc32("ids").alias("ids_crc32"),
                          (decode_udf()(F.col("ids")) == F.coalesce("text", F.lit(""))).alias("lossless"))
