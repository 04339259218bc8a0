"""Hard negatives, collocations and harmonic packing next to plain versions."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortline.llm import collocations, hard_negatives, harmonic

SF = "/root/testdata/sf0.001"
CLASHING = ("group", "is_query", "row", "id", "vector", "strip", "pos", "phrase", "word", "words", "ids", "lengths", "f", "n", "p", "q")
DOCS = "doc_id long, text string, lang string"


# hard negatives

def plain_negatives(rows, k=5, m=5, share=(80, 100)):
    """All rows against all anchors in whole numbers of any size."""
    table = {}
    for i, v, y, anchor in rows:
        if i is None or y is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [math.floor(256 * x) for x in v]
        table.setdefault(i, []).append((y, q, anchor))
    items = {i: (*min((y, q) for y, q, _ in of), any(a for *_, a in of)) for i, of in table.items()}
    out = set()
    for a, (label, q, anchor) in items.items():
        if not anchor:
            continue
        scores = sorted((-sum(x * y for x, y in zip(q, items[i][1])), i) for i in items if i != a)
        for minus, p in [s for s in scores if items[s[1]][0] == label][:k]:
            able = [(s, i) for s, i in scores if items[i][0] != label and share[0] * -minus <= share[1] * -s <= share[1] * -minus]
            out |= {(a, p, r + 1, i, -minus, -s) for r, (s, i) in enumerate(able[:m])}
    return out


def found_negatives(spark, rows, **options):
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, anchor boolean")
    d = d.select("*", *[F.lit("x").alias(c) for c in CLASHING])
    got = hard_negatives.hard_negatives(d, F.col("anchor"), **options).collect()
    assert len(got) == len({tuple(r) for r in got})
    return {(r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in got}


def test_negatives_of_odd_rows(spark):
    draw = random.Random(5)
    rows = [(i, [draw.uniform(-1, 1) for _ in range(8)], draw.randrange(3), i % 10 == 0) for i in range(300)]
    rows += [(300 + i, [0.5] * 8, i % 2, i % 20 == 0) for i in range(80)]  # ties
    rows += rows[:40]  # repeated rows
    rows += [(5, [0.9] * 8, 0, False), (None, [0.1] * 8, 1, True), (900, None, 1, True), (901, [0.1] * 8, None, True),
             (902, [0.1, None] + [0.1] * 6, 1, True), (903, [float("nan")] * 8, 1, True), (904, [float("inf")] * 8, 1, True),
             (905, [0.4] * 3, 1, True), (906, [], 1, True), (907, [0.3] * 11, 2, True), (908, [1.0] * 8, 77, True)]
    want = plain_negatives(rows)
    assert len(want) > 300
    assert found_negatives(spark, rows) == want
    assert found_negatives(spark, rows, group_bytes=4096) == want  # many groups


def test_negatives_of_large_values(spark):
    draw = random.Random(6)
    size = lambda i: 1.0 if i % 5 else 10.0 ** draw.randrange(1, 6)
    rows = [(i, [draw.uniform(-1, 1) * size(i) for _ in range(6)], i % 2, i % 7 == 0) for i in range(120)]
    assert found_negatives(spark, rows) == plain_negatives(rows)
    with pytest.raises(Exception, match="64 bits"):
        found_negatives(spark, [(1, [1e200], 0, True), (2, [1e200], 0, False)])


def test_negatives_of_nothing(spark):
    assert not found_negatives(spark, [])
    assert not found_negatives(spark, [(0, [1.0], 1, True), (1, [1.0], 1, False)])  # no other label
    assert not found_negatives(spark, [(0, [1.0], 1, True), (1, [1.0], 2, False)])  # no positive


def test_packed_products_are_exact():
    rng = np.random.default_rng(3)
    for span in (1, 40, 300, 5000, 1 << 20, 1 << 27):
        a, x = rng.integers(-span, span + 1, (7, 33)), rng.integers(-span, span // 3 + 1, (29, 33))
        want = np.array([[sum(int(p) * int(q) for p, q in zip(r, c)) for c in x] for r in a])
        assert (hard_negatives.products(a.astype(float), x.astype(float)) == want).all()
        assert (hard_negatives.all_products(a.astype(float), x.astype(float)) == want).all()


def test_best_of_chunks_and_ties():
    rng = np.random.default_rng(4)
    scores, able = rng.integers(0, 6, (9, 400)), rng.random((9, 400)) < 0.7
    best = hard_negatives.Best(9, 5)
    for at in range(0, 400, 64):
        best.add(scores[:, at:at + 64], able[:, at:at + 64], np.arange(at, min(400, at + 64)))
    for r in range(9):
        want = sorted((-int(scores[r, c]), c) for c in range(400) if able[r, c])[:5]
        mine = best.row == r
        assert list(zip((-best.score[mine]).tolist(), best.id[mine].tolist())) == want


# collocations

def plain_collocations(rows, least, top=2000, longest=4):
    count, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(words)
            for k in range(1, longest + 1):
                count[lang or "und"].update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    out = set()
    for lang, f in count.items():
        able = {w: a for w, a in f.items() if a >= least and len(w) > 1}
        kept = []
        for w, a in able.items():
            if any(100 * b >= 80 * a and any(x[i:i + len(w)] == w for i in range(len(x) - len(w) + 1))
                   for x, b in able.items() if len(x) > len(w)):
                continue
            score, k = min((2_000_000 * a // (f[w[:k]] + f[w[k:]]), k) for k in range(1, len(w)))
            kept.append((-score, -a, " ".join(w).encode(), f[w[:k]], f[w[k:]]))
        for rank, (s, a, phrase, left, right) in enumerate(sorted(kept)[:top]):
            out.add((lang, rank + 1, phrase.decode(), -a, left, right, total[lang], -s))
    return out


def found_collocations(spark, rows, **options):
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], DOCS).select("*", *[F.lit("x").alias(c) for c in CLASHING])
    got = collocations.collocations(d, **options)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    got = got.collect()
    assert len(got) == len({tuple(r) for r in got})
    return {tuple(r) for r in got}


def phrase_rows():
    draw = random.Random(8)
    vocabulary = ["a", "b", "c", "D", "é", "ß", "z z", "e", "f", "x"]
    say = lambda n: "".join(draw.choice(vocabulary) + draw.choice([" ", " ", "  ", "\t", ", ", ".", "\n"]) for _ in range(n))
    rows = [(say(draw.randrange(0, 60)), draw.choice(["en", "en", "de", None])) for _ in range(120)]
    rows += [("new york city hall " * 9, "en"), ("a " * 700, "fr"), (None, "en"), ("", None), (" \t\n ", "de"), ("...", "es")]
    return rows + rows[:10]


@pytest.mark.parametrize("options", [{}, {"limit": 0}, {"strip": 3}, {"strip": 1, "limit": 0}, {"top": 4}, {"longest": 2}])
def test_collocations(spark, options):
    rows = phrase_rows()
    want = plain_collocations(rows, 6, options.get("top", 2000), options.get("longest", 4))
    assert len(want) > 10
    assert found_collocations(spark, rows, least=6, **options) == want
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("occurrences_")]


def test_collocations_of_a_long_text_and_of_nothing(spark):
    draw = random.Random(9)
    long = " ".join(draw.choice("abcdefgh") for _ in range(60_000))
    assert found_collocations(spark, [(long, "en")]) == plain_collocations([(long, "en")], 30)
    assert not found_collocations(spark, [])
    assert not found_collocations(spark, [("one two", "en"), (None, None)])


def test_words_are_numbered_apart_and_never_joined_as_text(spark, monkeypatch):
    words = spark.createDataFrame([("en", "one"), ("en", "two"), ("de", "one")], "lang string, lower string")
    # by the first seed, words of one length share a number
    chosen = collocations.distinct_seed(words, lambda w, seed: collocations.numbered(w, seed) if seed else F.length(w))
    assert chosen == 1 and collocations.distinct_seed(words) == 0
    odd = ["ABCz", "\u00c9A", "\u212a\u0130K", "x", "\U0001d400A"]
    rows = spark.createDataFrame([(w,) for w in odd], "word string").select(collocations.lowered(F.col("word")).alias("low")).collect()
    assert [r.low for r in rows] == ["abcz", "\u00c9a", "\u212a\u0130k", "x", "\U0001d400a"]
    persisted = []
    persist = collocations.Relations.persist

    def spied(self, relation):
        persisted.append(relation._jdf.queryExecution().optimizedPlan().toString())
        return persist(self, relation)

    monkeypatch.setattr(collocations.Relations, "persist", spied)
    rows = phrase_rows()
    assert found_collocations(spark, rows, least=6, limit=0) == plain_collocations(rows, 6)
    assert len(persisted) == 3 and "Join" not in persisted[0] and all("Join" in plan for plan in persisted[1:])


# harmonic packing

def plain_ids(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    return [np.array(e.ids + [2], "<u4") for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def checked(rows, texts, capacity=4096, slack=16):
    """Every id in one piece, sequences gapless, padding bounded."""
    ids = plain_ids(texts)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(range(len(texts)))
    for d, parts in by_doc.items():
        at = 0
        for r in sorted(parts, key=lambda r: r.start):
            own = ids[d][at:at + r.length]
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids[d]), zlib.crc32(own.tobytes())) and r.length > 0
            at += r.length
        assert at == len(ids[d])
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert {(r.n_tokens, r.sequence_length) for r in parts} == {(at, at if at & (at - 1) == 0 else capacity)}
        assert parts[0].sequence_length - at <= slack and at <= capacity


def test_packing_of_odd_texts(spark):
    draw = random.Random(10)
    marks = ["word", "Wörter", "it's", "naïve,", "42", "東京", "<|endoftext|>", "x<|startoftext|>y", "é", " ́", "\x1c", " ",
             "'s", "Σς", "don't.", "!!", " ", "a.", "B?", "é!", "<|ENDOFTEXT|>"]
    texts = [None, "", "  ", "long " * 30_000] + ["".join(draw.choice(marks) + draw.choice(["", " ", "\n"]) for _ in range(draw.randrange(40)))
                                                  for _ in range(400)]
    texts += texts[4:20]
    d = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], DOCS).select("*", *[F.lit("x").alias(c) for c in CLASHING])
    for parts in (1, 5):
        checked(harmonic.piece_checksums(harmonic.sequences(d.coalesce(1) if parts == 1 else d.repartition(parts))).collect(), texts)


def test_packing_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = [r.text for r in docs.orderBy("doc_id").collect()]
    packed = harmonic.sequences(docs)
    rows = harmonic.piece_checksums(packed).collect()
    checked(rows, texts)
    lengths = {r.sequence_id: (r.n_tokens, r.sequence_length) for r in rows}
    used, all_ = map(sum, zip(*lengths.values()))
    assert used > 0.995 * all_
    for r in packed.collect():
        ids = np.frombuffer(r.ids, "<u4")
        assert (ids[r.n_tokens:] == harmonic.PADDING).all() and r.offsets == np.cumsum([0, *r.lengths[:-1]]).tolist()


def test_fewest_fitting_pieces():
    for capacity, slack in ((64, 0), (64, 2), (100, 3), (4096, 16)):
        first = harmonic.first_piece(capacity, slack)
        fitting = {n for n in range(1, capacity + 1) if capacity // n * n >= capacity - slack}
        fewest = [0]
        for n in range(1, capacity + 1 if capacity < 1000 else 300):
            fewest.append(1 + min(fewest[n - f] for f in fitting if f <= n))
            pieces, rest = 0, n
            while rest:
                assert first[rest] in fitting
                rest, pieces = rest - first[rest], pieces + 1
            assert pieces == fewest[n]


def test_a_class_has_a_fixed_count():
    packer = harmonic.Packer(64, 2)
    full = [m for i in range(500) for m in packer.add(i, bytes(4 * (1 + i * 7 % 150)))]
    assert all(len(m) == 64 // p[2] and 62 <= sum(q[2] for q in m) <= 64 for m in full for p in m)
    rest = [sum(p[2] for p in m) for m in packer.rest()]
    assert all(n == 64 or n & (n - 1) == 0 for n in rest) and sum(n < 64 for n in rest) <= 6


def test_packing_of_nothing(spark):
    assert not harmonic.sequences(spark.createDataFrame([], DOCS)).collect()
    ids = plain_ids(["", "", ""])
    rows = harmonic.piece_checksums(harmonic.sequences(spark.createDataFrame([(None, None, None), (0, "", "en"), (0, "", "en")], DOCS))).collect()
    assert sorted((r.doc_id is None, r.start, r.length, r.ids_crc32) for r in rows) == sorted(
        (d, 0, 1, zlib.crc32(ids[0].tobytes())) for d in (True, False, False))
