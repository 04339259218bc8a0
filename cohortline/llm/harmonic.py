"""Harmonic packing: documents cut to reciprocal shares of a sequence, each class in sequences of a fixed count.

A document is its token ids and one closing id (a null or empty text: the closing
id alone). A piece of length l belongs to class k when it is at most 1/k and more
than 1/(k + 1) of the capacity, and k pieces of class k fill a sequence: nothing
has to be looked for, and every worker packs what it reads by itself, so nothing is
shuffled, no key can be hot and memory does not grow with the input (a worker holds
one open sequence a class).

Harmonic packing by itself wastes what a piece is shorter than its share. As
documents may be cut, they are: whole sequences first, then the rest into as few
pieces as possible whose lengths are all *fitting*, that is, k of them leave at
most ``slack`` ids of a sequence unused (a table of the fewest pieces for each
length, ties: the longest piece first). What is still open when a worker's input
ends is laid end to end and cut into full sequences, and its rest by its binary
digits into sequences whose lengths are powers of two, which are not padded. So no
sequence is padded by more than ``slack`` ids.

A sequence: ``sequence_id``, ``ids`` (little-endian, 32 bits each, padded with
``PADDING`` to the capacity unless its length is a power of two), ``n_tokens``
(without padding), and for each piece in order ``doc_ids``, ``starts`` (the ids of
its document before it), ``offsets``, ``lengths``, ``doc_tokens`` (all ids of its
document).
``sequence_id`` and what meets in a sequence follow from how the input is split
into tasks; every id is in exactly one piece whatever the split.

Null ids stay null; repeated rows are documents of their own; very long texts are
encoded whole; other columns are not read; an empty table gives no sequences.
Ties do not arise: pieces are placed in the order they are read.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from cohortline.llm.bpe import byte_characters, split
from cohortline.llm.text import id_and_text, pieces

CAPACITY, SLACK, CLOSING, PADDING, CACHED = 4096, 16, 2, 0, 3 << 18
BATCH_BYTES = 4 << 20
SCHEMA = ("sequence_id long, ids binary, n_tokens long, doc_ids array<long>, starts array<long>, offsets array<long>, "
          "lengths array<long>, doc_tokens array<long>")
_MARKS, _BEYOND_LATIN = ".,;:!?", "\u0250"
_encoders: dict[str | None, ChunkIds] = {}


class ChunkIds:
    """Ids, as bytes, of texts; those of chunks between white space are remembered, two lots of bounded size."""

    def __init__(self, path: str | None = None):
        import public_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks run side by side already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or public_tokenizers.path("word_bpe_49k.json"))
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.characters = str.maketrans({chr(b): c for b, c in enumerate(byte_characters())})
        self.marks = dict(zip(_MARKS, self.plain(list(_MARKS))))
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def plain(self, chunks: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

    def word(self, word: str) -> bytes:
        """Ids of Latin letters, for which the vocabulary's normalizer and pattern have nothing to do but lower case."""
        lower = word.lower()
        if not lower.isascii():
            lower = lower.encode().decode("latin-1").translate(self.characters)
        return array("I", [t.id for t in self.model.tokenize(lower)]).tobytes()

    def learn(self, chunks: set[str]) -> None:
        """Make all ``chunks`` known."""
        if len(self.known) + len(chunks) > CACHED:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        new = [c for c in chunks if c not in known]
        # a mark at the end, behind a letter or digit, is a word of its own; but the lower case of a capital I with a dot
        # ends in a character that such a mark joins
        ended = [c for c in new if c[-1] in self.marks and c[-2:-1].isalnum() and c[-2] != "\u0130" and c not in older]
        new = {*new}.difference(ended)
        new.update(c for c in {c[:-1] for c in ended} if c not in known)
        known.update([(c, older[c]) for c in new if c in older])
        new = [c for c in new if c not in known]
        words = [c for c in new if c.isalpha() and max(c) < _BEYOND_LATIN and "\u0130" not in c]
        known.update(zip(words, map(self.word, words)))
        rest = [c for c in new if c not in known]
        known.update(zip(rest, self.plain(rest)))
        marks = self.marks
        known.update([(c, known[c[:-1]] + marks[c[-1]]) for c in ended])

    def encode(self, texts: list[str]) -> list[bytes]:
        parts = [split(t) for t in texts]
        self.learn(set().union(*parts))
        return [b"".join(map(self.known.__getitem__, p)) for p in parts]


def chunk_ids(path: str | None = None) -> ChunkIds:
    if path not in _encoders:
        _encoders[path] = ChunkIds(path)
    return _encoders[path]


@cache
def first_piece(capacity: int, slack: int) -> list[int]:
    """For each length up to the capacity, the first of the fewest fitting pieces it is cut into."""
    lengths = np.arange(1, capacity + 1)
    fitting = lengths[capacity // lengths * lengths >= capacity - slack]
    fewest, first = np.zeros(capacity + 1, np.int64), [0] * (capacity + 1)
    for rest in range(1, capacity + 1):
        able = fitting[:np.searchsorted(fitting, rest, side="right")][::-1]
        k = int(np.argmin(fewest[rest - able]))
        fewest[rest], first[rest] = fewest[rest - able[k]] + 1, int(able[k])
    return first


class Packer:
    """Open sequences of one worker. A piece: (document, start, length, tokens of the document, ids as bytes)."""

    def __init__(self, capacity: int, slack: int):
        if capacity < 1 or slack < 0:
            raise ValueError("capacity must be positive and slack not negative")
        self.capacity, self.first = capacity, first_piece(capacity, slack)
        self.open: dict[int, list[tuple]] = {}

    def add(self, doc_id: int | None, ids: bytes) -> Iterator[list[tuple]]:
        """Place a document; yields the sequences that it fills."""
        total = len(ids) // 4
        at = 0
        while at < total:
            length = self.capacity if total - at >= self.capacity else self.first[total - at]
            count = self.capacity // length
            members = self.open.setdefault(count, [])
            members.append((doc_id, at, length, total, ids[4 * at:4 * (at + length)]))
            if len(members) == count:
                yield self.open.pop(count)
            at += length

    def rest(self) -> Iterator[list[tuple]]:
        """What is still open, end to end, in full sequences and powers of two."""
        left = [p for count in sorted(self.open) for p in self.open[count]]
        self.open = {}
        remaining = sum(p[2] for p in left)
        members, room = [], 0
        for doc_id, start, length, total, ids in left:
            at = 0
            while at < length:
                if not room:
                    room = self.capacity if remaining >= self.capacity else 1 << remaining.bit_length() - 1
                take = min(room, length - at)
                members.append((doc_id, start + at, take, total, ids[4 * at:4 * (at + take)]))
                at, room, remaining = at + take, room - take, remaining - take
                if not room:
                    yield members
                    members = []


def sequences(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", capacity: int = CAPACITY,
              slack: int = SLACK, closing: int = CLOSING, padding: int = PADDING, tokenizer: str | None = None) -> DataFrame:
    """All documents as packed sequences."""
    whole = pa.list_(pa.int64())
    arrow = pa.schema([("sequence_id", pa.int64()), ("ids", pa.binary()), ("n_tokens", pa.int64()), ("doc_ids", whole),
                       ("starts", whole), ("offsets", whole), ("lengths", whole), ("doc_tokens", whole)])
    end, pad = np.array([closing], "<u4").tobytes(), np.array([padding], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = chunk_ids(tokenizer), Packer(capacity, slack)
        number, rows, size = TaskContext.get().partitionId() << 32, [], 0

        def filled(found: Iterator[list[tuple]]) -> Iterator[pa.RecordBatch]:
            nonlocal number, rows, size
            for members in found:
                docs_, starts, lengths, totals, ids = zip(*members)
                used = sum(lengths)
                short = 0 if used & (used - 1) == 0 else capacity - used
                offsets = [0, *accumulate(lengths[:-1])]
                rows.append((number, b"".join(ids) + pad * short, used, docs_, starts, offsets, lengths, totals))
                number, size = number + 1, size + 4 * used + 32 * len(members)
                if size >= BATCH_BYTES:
                    yield flushed()

        def flushed() -> pa.RecordBatch:
            nonlocal rows, size
            made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)
            rows, size = [], 0
            return made

        for batch in batches:
            for part in pieces(batch):
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), encoder.encode(part.column("text").to_pylist())):
                    yield from filled(packer.add(doc_id, ids + end))
        yield from filled(packer.rest())
        if rows:
            yield flushed()

    return id_and_text(docs, id_column, text_column).mapInArrow(run, SCHEMA)


def piece_checksums(packed: DataFrame) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, n_tokens, sequence_length`` of every piece."""
    return packed.select("sequence_id", "n_tokens", (F.octet_length("ids") / 4).cast("long").alias("sequence_length"), F.expr("""
        inline(transform(sequence(0, size(lengths) - 1), i -> named_struct(
            'doc_id', doc_ids[i], 'start', starts[i], 'length', lengths[i],
            'ids_crc32', crc32(substring(ids, cast(offsets[i] * 4 + 1 as int), cast(lengths[i] * 4 as int))),
            'doc_tokens', doc_tokens[i], 'offset', offsets[i])))""")).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "n_tokens", "sequence_length")
