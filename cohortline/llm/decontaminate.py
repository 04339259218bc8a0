"""Benchmark items found in documents: word n-grams as seeds, then Smith-Waterman alignment.

Words are runs of letters and digits (ASCII punctuation separates), lower-cased.
Every four-word sequence of an item is a seed, however many documents hold it. Where
a seed occurs in a document, the item is aligned with the passage around it, word by word: 2 for equal words, -1 for unequal ones and for
each skipped word. The score is the best local alignment over the best possible
one; items of more than 64 words count as found once 64 words' worth aligns. A
score of 0.6 is a hit: about three words in four the same and in order.

An item that a common sequence names in many documents costs them little: items with
too few words anywhere in a document to reach the score are left out in one step.

Documents are searched where they are read: nothing is shuffled, so passages that
a third of all documents share are no hot keys. The benchmark comes to the tasks
in blocks of bounded size, one pass over the documents for each block.

Defined cases: a null text is empty and matches nothing; an item of fewer words
than a seed matches documents of exactly its words; repeated items and
documents each give their own rows; very long texts are searched whole; other columns
are not read, whatever their names; empty tables give no hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cohortline.llm.text import PUNCTUATION, grams, id_and_text, pieces, words

SEED_WORDS = 4
MATCH, MISMATCH, GAP = 2, -1, -1
ENOUGH_WORDS = 64
LEAST_SCORE = 0.6
BLOCK_BYTES = 16 << 20
_FILTER_BITS = 22


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """Best local alignment score of two word sequences, and how many words of the passage precede its end."""
    steps = np.arange(len(passage) + 1) * -GAP
    row = np.zeros(len(passage) + 1, np.int64)
    best, end = 0, 0
    for word in item:
        new = np.maximum(row + GAP, 0)
        np.maximum(new[1:], row[:-1] + np.where(passage == word, MATCH, MISMATCH), out=new[1:])
        # skipping words of the passage: the best of all cells to the left, less one per word between
        row = np.maximum.accumulate(new + steps) - steps
        top = int(row.argmax())
        if row[top] > best:
            best, end = int(row[top]), top
    return best, end


class Items:
    """Some benchmark items, their word sequences and where each n-gram stands in them."""

    def __init__(self, ids: list[int | None], texts: list[str | None]):
        found, self.at = words(pa.array([t or "" for t in texts], pa.string()), PUNCTUATION)
        self.words, self.ids = found, ids
        every, bounds = grams(found, self.at, SEED_WORDS)
        owner = np.repeat(np.arange(len(ids)), np.diff(bounds))
        place = np.arange(len(every)) - bounds[:-1][owner]
        order = np.lexsort((place, owner, every))
        self.owner, self.place = owner[order], place[order]
        self.seeds, first = np.unique(every[order], return_index=True)
        self.first = np.append(first, len(every))
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[self.seeds & np.uint64((1 << _FILTER_BITS) - 1)] = True
        self.vocabulary, numbers = np.unique(found, return_inverse=True)
        self.numbers = numbers.reshape(-1)

    def found(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``hashes`` that hold a seed, and the seed's number."""
        maybe = np.flatnonzero(self.filter[hashes & np.uint64((1 << _FILTER_BITS) - 1)])
        if not len(self.seeds):
            return maybe[:0], maybe[:0]
        number = np.minimum(np.searchsorted(self.seeds, hashes[maybe]), len(self.seeds) - 1)
        true = self.seeds[number] == hashes[maybe]
        return maybe[true], number[true]

    def possible(self, document: np.ndarray, items: np.ndarray) -> np.ndarray:
        """Which of ``items`` have enough words in the document, wherever they stand."""
        number = np.minimum(np.searchsorted(self.vocabulary, document), len(self.vocabulary) - 1)
        present = np.zeros(len(self.vocabulary), bool)
        present[number[self.vocabulary[number] == document]] = True
        lengths = np.diff(self.at)[items]
        ends = np.cumsum(lengths)
        at = np.repeat(self.at[items] - (ends - lengths), lengths) + np.arange(ends[-1])
        # seeds have words, so no item here is empty
        shared = np.add.reduceat(present[self.numbers[at]].astype(np.int64), ends - lengths)
        return shared >= LEAST_SCORE * np.minimum(lengths, ENOUGH_WORDS)

    def hits(self, texts: pa.Array) -> list[tuple[int, int, float, int]]:
        """Row, item number, score and last word of each item found in each text; the best place only."""
        found, at = words(texts, PUNCTUATION)
        hashes, bounds = grams(found, at, SEED_WORDS)
        places, numbers = self.found(hashes)
        if not len(places):
            return []
        rows = np.searchsorted(bounds, places, side="right") - 1
        repeats = self.first[numbers + 1] - self.first[numbers]
        spread = np.repeat(self.first[numbers] - np.concatenate([[0], np.cumsum(repeats)[:-1]]), repeats) + np.arange(repeats.sum())
        rows, items = np.repeat(rows, repeats), self.owner[spread]
        # where the item would start in the document
        starts = np.repeat(places, repeats) - bounds[rows] - self.place[spread]
        order = np.lexsort((starts, items, rows))
        rows, items, starts = rows[order], items[order], starts[order]
        lengths = np.diff(self.at)[items]
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:] != rows[:-1]) | (items[1:] != items[:-1]) | (starts[1:] - starts[:-1] > lengths[1:])
        cuts = np.append(np.flatnonzero(new), len(rows))
        best: dict[tuple[int, int], tuple[float, int]] = {}
        begins, lasts = cuts[:-1], cuts[1:] - 1
        by_row = np.append(np.flatnonzero(np.diff(rows[begins], prepend=-1)), len(begins))
        good = np.concatenate([self.possible(found[at[rows[begins[x]]]:at[rows[begins[x]] + 1]], items[begins[x:y]])
                               for x, y in zip(by_row[:-1], by_row[1:])])
        for first, last in zip(begins[good], lasts[good]):
            row, item = int(rows[first]), int(items[first])
            own = self.words[self.at[item]:self.at[item + 1]]
            n_words = at[row + 1] - at[row]
            if len(own) < SEED_WORDS and n_words != len(own):
                continue
            slack = len(own) // 2 + SEED_WORDS
            begin = max(0, int(starts[first]) - slack)
            passage = found[at[row] + begin:at[row] + min(n_words, int(starts[last]) + len(own) + slack)]
            goal = MATCH * min(len(own), ENOUGH_WORDS)
            if MATCH * np.isin(own, passage).sum() < LEAST_SCORE * goal:
                continue
            score, end = align(own, passage)
            share = min(1.0, score / goal)
            if share >= LEAST_SCORE and share > best.get((row, item), (0.0, 0))[0]:
                best[row, item] = share, begin + end
        return [(row, item, share, end) for (row, item), (share, end) in best.items()]


def blocks(benchmark: DataFrame, id_column: str, text_column: str) -> Iterator[Items]:
    """The benchmark in parts of about ``BLOCK_BYTES`` of text, each small enough to hand to every task."""
    rows = benchmark.select(F.col(f"`{id_column}`").cast("long").alias("item_id"),
                            F.coalesce(F.col(f"`{text_column}`"), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(total // BLOCK_BYTES) + 1
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for k in range(n):
        own = sorted(rows.filter(part == k).collect(), key=lambda r: (r.item_id is None, r.item_id or 0, r.text))
        yield Items([r.item_id for r in own], [r.text for r in own])


def contaminated(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                 item_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """``doc_id``, ``item_id``, ``score`` and ``end_word`` (words of the document up to the passage's end) of each hit."""
    texts = id_and_text(docs, id_column, text_column)
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("end_word", pa.int64())])
    out = None
    for items in blocks(benchmark, item_column, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in pieces(batch):
                    ids = part.column("doc_id")
                    rows = [{"doc_id": ids[row].as_py(), "item_id": shared.value.ids[item], "score": score, "end_word": end}
                            for row, item, score, end in shared.value.hits(part.column("text"))]
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema)

        hits = texts.mapInArrow(run, "doc_id long, item_id long, score double, end_word long")
        out = hits if out is None else out.union(hits)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_column: str = "text", item_column: str = "item_id",
                      item_text: str = "text") -> DataFrame:
    """The documents without a hit, with the columns they came with."""
    for items in blocks(benchmark, item_column, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in pieces(batch, text_column):
                    hit = {row for row, *_ in shared.value.hits(part.column(text_column))}
                    yield part.filter(pa.array([row not in hit for row in range(part.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
