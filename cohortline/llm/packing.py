"""Token ids packed into rows of fixed length: best-fit decreasing with a segment tree over capacities.

Each document becomes its token ids and one closing id (an empty or null text:
the closing id alone). A document longer than a row is cut into full rows and a
rest, losing nothing. Segments are placed longest first (ties: id, position, then
ids) into the fullest row that still holds them; a segment tree over remaining
capacities finds it in a logarithmic number of steps.

Documents are packed where they are read, in windows of a bounded number of
tokens, so nothing is shuffled, no key can be hot and memory does not grow with
the input. Each window gives one block of rows.

A packed row: ``block``, ``row``, ``ids`` (little-endian, ``length`` wide, padded
with the closing id), ``n_tokens``, ``doc_ids`` and ``doc_starts`` (which
document, and from which of its tokens, each segment holds), ``cu_seqlens``
(cumulative segment lengths from 0) and ``position_resets`` (where positions
start again from zero). Which documents share a block follows from how the input is
split into tasks.

Repeated rows are documents of their own; null ids stay null; other columns are not
read, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from cohortline.llm.text import id_and_text, pieces
from cohortline.session import fresh_path

LENGTH, WINDOW_TOKENS, CACHED_CHUNKS = 2048, 1 << 21, 1 << 18
SCHEMA = ("block long, row long, ids binary, n_tokens long, doc_ids array<long>, doc_starts array<long>, "
          "cu_seqlens array<int>, position_resets array<int>")
# white space other than one blank or one line break between words needs the whole text
_ODD = re.compile(r"[^\S \n]|[ \n][ \n]| \Z")
_CHUNK = re.compile(r" ?[^ \n]+|\n")
_encoders: dict[str | None, Chunks] = {}


class Chunks(dict):
    """Token ids, as bytes, of a word with the blank before it; forgets all when full."""

    def __init__(self, encoding):
        self.encoding = encoding

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= CACHED_CHUNKS:
            self.clear()
        made = self[chunk] = np.array(self.encoding.encode_ordinary(chunk), np.uint16).tobytes()
        return made

    def encode(self, text: str) -> bytes:
        if _ODD.search(text):
            return np.array(self.encoding.encode_ordinary(text), np.uint16).tobytes()
        return b"".join(map(self.__getitem__, _CHUNK.findall(text)))


def encoder(path: str | None = None) -> Chunks:
    """Encoder over a file of ranked byte sequences; its closing id is the number of ranks."""
    if path not in _encoders:
        import public_tokenizers
        import tiktoken

        with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        if len(ranks) >= 1 << 16:
            raise ValueError("ids are written as 16 bits")
        _encoders[path] = Chunks(tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                                   special_tokens={}))
    return _encoders[path]


class Capacities:
    """Open rows by remaining capacity; a segment tree counts them."""

    def __init__(self, length: int):
        self.size = 1 << length.bit_length()
        self.tree = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def add(self, capacity: int, row: int) -> None:
        self.rows[capacity].append(row)
        k = self.size + capacity
        while k:
            self.tree[k] += 1
            k >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The row with the least capacity of at least ``need``, removed; or None."""
        tree, k = self.tree, self.size + need
        if not tree[k]:
            # up to the first sibling on the right that holds a row, then down to its leftmost
            while k > 1 and (k & 1 or not tree[k + 1]):
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self.size:
                k = 2 * k if tree[2 * k] else 2 * k + 1
        capacity = k - self.size
        while k:
            tree[k] -= 1
            k >>= 1
        return capacity, self.rows[capacity].pop()


def best_fit(lengths: list[int], length: int) -> list[list[int]]:
    """Segments of each row; ``lengths`` must not increase."""
    rows: list[list[int]] = []
    open_rows = Capacities(length)
    for i, n in enumerate(lengths):
        found = open_rows.take(n) if n < length else None
        if found is None:
            found = length, len(rows)
            rows.append([])
        capacity, row = found
        rows[row].append(i)
        if capacity > n:
            open_rows.add(capacity - n, row)
    return rows


def pack_window(window: list[tuple[int | None, bytes]], length: int, closing: int) -> Iterator[dict]:
    """Packed rows of some documents, given as (id, ids as 16-bit bytes without the closing one)."""
    end = np.array([closing], np.uint16).tobytes()
    segments = []
    for doc_id, ids in window:
        ids += end
        for at in range(0, len(ids) // 2, length):
            segments.append((doc_id, at, ids[2 * at:2 * (at + length)]))
    segments.sort(key=lambda s: (-len(s[2]), s[0] is None, s[0] or 0, s[1], s[2]))
    for row, members in enumerate(best_fit([len(s[2]) // 2 for s in segments], length)):
        lengths = [len(segments[i][2]) // 2 for i in members]
        bounds = np.concatenate([[0], np.cumsum(lengths)]).tolist()
        yield {"row": row, "ids": b"".join(segments[i][2] for i in members) + end * (length - bounds[-1]),
               "n_tokens": bounds[-1], "doc_ids": [segments[i][0] for i in members],
               "doc_starts": [segments[i][1] for i in members], "cu_seqlens": bounds, "position_resets": bounds[:-1]}


def packed_rows(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", length: int = LENGTH,
                window_tokens: int = WINDOW_TOKENS, tokenizer: str | None = None) -> DataFrame:
    """All documents as packed rows."""
    if length < 1:
        raise ValueError("length must be positive")
    arrow = pa.schema([("block", pa.int64()), ("row", pa.int64()), ("ids", pa.binary()), ("n_tokens", pa.int64()),
                       ("doc_ids", pa.list_(pa.int64())), ("doc_starts", pa.list_(pa.int64())),
                       ("cu_seqlens", pa.list_(pa.int32())), ("position_resets", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        closing = encode.encoding.n_vocab
        first = TaskContext.get().partitionId() << 32
        window, tokens, blocks = [], 0, 0

        def flush():
            nonlocal window, tokens, blocks
            rows = [r | {"block": first + blocks} for r in pack_window(window, length, closing)]
            window, tokens, blocks = [], 0, blocks + 1
            for k in range(0, len(rows), 256):
                yield pa.RecordBatch.from_pylist(rows[k:k + 256], arrow)

        for batch in batches:
            for part in pieces(batch):
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    ids = encode.encode(text)
                    window.append((doc_id, ids))
                    tokens += len(ids) // 2 + 1
                    if tokens >= window_tokens:
                        yield from flush()
        if window:
            yield from flush()

    return id_and_text(docs, id_column, text_column).mapInArrow(run, SCHEMA)


def write_packed(docs: DataFrame, path: str, **options) -> None:
    """Write packed rows as parquet; a block's ``ids``, in order of ``row``, are its id matrix."""
    packed_rows(docs, **options).write.parquet(path)


def written(docs: DataFrame, **options) -> DataFrame:
    """Packed rows, written below the shared folder and read back."""
    path = fresh_path(docs.sparkSession, "packed")
    write_packed(docs, path, **options)
    return docs.sparkSession.read.schema(SCHEMA).parquet(path)


def position_ids(cu_seqlens: list[int]) -> np.ndarray:
    """Positions of a packed row, starting from 0 in each segment."""
    bounds = np.asarray(cu_seqlens)
    return np.arange(bounds[-1]) - np.repeat(bounds[:-1], np.diff(bounds))
