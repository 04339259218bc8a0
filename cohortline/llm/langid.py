"""Language identification by partial matching: the language under whose statistics a text is shortest.

For each language a tree of byte contexts of order 3, 2, 1 and 0 is learned from
all labelled training texts. A byte is coded in the longest context that has been
seen; a byte new to a context costs an escape and is coded one order lower, without
the bytes the longer context already excludes, down to equal shares. Statistics
are frozen after learning, so a byte's code length depends on it and the three
bytes before it alone, and is looked up once for each distinct code of a slice.

All bytes count as themselves but capital A-Z (lower case) and white space (one
space), so no script folds into another's. Only contexts that were seen are kept, in
sorted arrays of each order, which grow with what the training texts hold; they
come to the driver one language at a time and are handed to the tasks. Counts come
from all training texts, summed where they are read before they are shuffled, so a
language that holds most rows is no hot key.

Defined cases: ``und`` with score 0 if a text is null or has no letter, or nothing
was learned; ties go to the first language in order; a null id is a training id. Repeated
rows are predicted each, very long texts whole; other columns are not read, whatever their
names; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from cohortline.llm.text import SPACE, flat, pieces
from cohortline.session import materialize

ORDER, BYTES = 3, 256
# a small alphabet whose codes can all be listed (code_lengths)
SYMBOLS = 40
HELD_CODES = 1 << 21
UNDETERMINED = "und"
_LETTER_OR_NUMBER = re.compile(r"[^\W\d_]")
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] = _FOLD[97:123]
_FOLD[SPACE] = 32


def has_letter(text: str) -> bool:
    """Whether a text has a character that Unicode counts as a letter; signs of numbers are none."""
    return any(m[0].isalpha() for m in _LETTER_OR_NUMBER.finditer(text))


def remainder(key: Column, divisor: int) -> Column:
    """crc32 of the key as text, modulo ``divisor``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % divisor


def contexts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Each byte with the three before it as one number, and where each text's numbers start and the last end."""
    data, at = flat(texts)
    padded = at + ORDER * np.arange(len(at))
    stream = np.full(padded[-1] + ORDER, 32, np.int64)
    own = np.arange(len(data)) + np.repeat(ORDER * np.arange(1, len(at)), np.diff(at))
    stream[own] = _FOLD[data]
    code = stream.copy()
    for back in range(1, ORDER + 1):
        code[back:] += stream[:-back] * BYTES**back
    return code[own], at


def summed(codes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order and the sum of each."""
    order = np.argsort(codes, kind="stable")
    codes, n = codes[order], n[order]
    first = np.flatnonzero(np.diff(codes, prepend=-1))
    return codes[first], np.add.reduceat(n, first) if len(n) else n


def counted(training: DataFrame) -> DataFrame:
    """``lang``, ``code``, ``n``: how often each byte followed each three in each language."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def given(lang: str) -> Iterator[pa.RecordBatch]:
            codes, n = summed(*map(np.concatenate, zip(*totals.pop(lang))))
            for k in range(0, len(codes), 1 << 16):
                part = codes[k:k + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), pa.array(part, pa.int64()),
                                                  pa.array(n[k:k + (1 << 16)], pa.int64())], ["lang", "code", "n"])

        for batch in batches:
            for part in pieces(batch):
                codes, at = contexts(part.column("text"))
                langs = np.array(part.column("lang").to_pylist(), object)
                for lang in set(langs.tolist()):
                    own = totals.setdefault(lang, [])
                    own.append(np.unique(codes[np.repeat(langs == lang, np.diff(at))], return_counts=True))
                    if sum(len(c) for c, _ in own) > 2 * HELD_CODES // len(totals):
                        totals[lang] = [summed(*map(np.concatenate, zip(*own)))]
                        # many seen codes go on to be summed outside
                        if len(totals[lang][0][0]) > HELD_CODES // len(totals):
                            yield from given(lang)
        for lang in list(totals):
            yield from given(lang)

    return training.select("text", "lang").mapInArrow(run, "lang string, code long, n long").groupBy("lang", "code").agg(
        F.sum("n").alias("n"))


class Contexts:
    """Partial matching with exclusion over the contexts that were seen, in sorted arrays of each order."""

    def __init__(self, codes: np.ndarray, n: np.ndarray, symbols: int = BYTES):
        self.symbols, self.orders = symbols, []
        before = None
        for order in range(ORDER + 1):
            own, counts = summed(codes % symbols**(order + 1), n)
            names, first = np.unique(own // symbols, return_index=True)
            total, kinds = np.add.reduceat(counts, first), np.diff(np.append(first, len(own)))
            lower = np.full(len(own), 1 / symbols) if before is None else before[1][np.searchsorted(before[0], own % symbols**order)]
            # what the order below leaves to symbols not seen here
            left = np.maximum(1 - np.add.reduceat(lower, first), 1e-12)
            # where every symbol has been seen nothing can escape
            shares = counts / np.repeat(total + np.where(kinds < symbols, kinds, 0), kinds)
            before = own, shares
            self.orders.append((own, shares, names, kinds / (total + kinds) / left))

    def bits(self, codes: np.ndarray) -> np.ndarray:
        """Bits of each code's last symbol after the ones before it."""
        share = np.full(len(codes), 1 / self.symbols)
        for order, (own, shares, names, escapes) in enumerate(self.orders):
            code = codes % self.symbols**(order + 1)
            at = np.minimum(np.searchsorted(own, code), len(own) - 1)
            name = np.minimum(np.searchsorted(names, code // self.symbols), len(names) - 1)
            share = np.where(names[name] == code // self.symbols, escapes[name] * share, share)
            share = np.where(own[at] == code, shares[at], share)
        return -np.log2(share)


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Bits of all codes of a small alphabet (``SYMBOLS``), from their counts."""
    seen = np.flatnonzero(counts)
    return Contexts(seen, counts[seen].astype(np.int64), SYMBOLS).bits(np.arange(len(counts)))


class Languages:
    """Frozen statistics of all languages."""

    def __init__(self, names: list[str], trees: list[Contexts]):
        self.names, self.trees = names, trees

    def lengths(self, texts: pa.Array) -> np.ndarray:
        """Code length in bits of each text in each language."""
        codes, at = contexts(texts)
        out = np.zeros((len(at) - 1, len(self.names)))
        full = np.flatnonzero(np.diff(at))
        if len(full):
            kinds, number = np.unique(codes, return_inverse=True)
            for k, tree in enumerate(self.trees):
                out[full, k] = np.add.reduceat(tree.bits(kinds)[number], at[full])
        return out

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and score of each text; the score is its share if all languages were equally likely before."""
        bits = self.lengths(texts)
        known = np.array([t is not None and has_letter(t) for t in texts.to_pylist()], bool) & bool(self.names)
        if not self.names:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        best = bits.argmin(axis=1)
        share = 1 / np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000)).sum(axis=1)
        return [self.names[b] if k else UNDETERMINED for b, k in zip(best, known)], np.where(known, share, 0.0)


def learned(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> Broadcast:
    """Statistics from all labelled texts whose id is not held out (crc32 modulo 3 is 1)."""
    key = F.col(f"`{id_column}`")
    training = docs.select(F.col(f"`{text_column}`").alias("text"), F.col(f"`{lang_column}`").alias("lang"), key.alias("key")).filter(
        F.col("text").isNotNull() & F.col("lang").isNotNull() & (remainder(F.col("key"), 3) != 1)).select("text", "lang")
    counts = materialize(counted(training), "counts")
    names = sorted(r.lang for r in counts.select("lang").distinct().collect())
    trees = []
    for name in names:
        own = counts.filter(F.col("lang") == name).select("code", "n").toPandas()
        trees.append(Contexts(own["code"].to_numpy(), own["n"].to_numpy()))
    return docs.sparkSession.sparkContext.broadcast(Languages(names, trees))


def predicted(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred``, ``score`` of every text."""
    model = learned(docs, id_column, text_column, lang_column)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                names, scores = model.value.predict(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(names, pa.string()),
                                                  pa.array(scores)], schema=schema)

    key = F.col(f"`{id_column}`")
    rows = docs.select(key.cast("long").alias("doc_id"), (remainder(key, 3) == 1).alias("held_out"),
                       F.col(f"`{text_column}`").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang",
                    least_score: float = 0.5) -> DataFrame:
    """The documents whose language is clear, with the columns they came with; the rest go."""
    model = learned(docs, id_column, text_column, lang_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, text_column):
                names, scores = model.value.predict(part.column(text_column))
                keep = (np.array(names) != UNDETERMINED) & (scores >= least_score)
                yield part.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
