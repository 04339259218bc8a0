"""The training-data operators on small fixtures, next to brute force, round trips and other libraries."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from functools import cache

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortline.llm import bpe, chat, decontaminate, exact_dedup, extract, langid, lm, near_dup, packing, sharding, text

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# names that operators use inside
CLASHING = ("rid", "v", "hash", "body", "tokens", "kept", "row", "n", "word", "kind", "label", "host", "shard", "block")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and blank texts, repeated rows, ties, a very long text and columns with clashing names."""
    rows = [(1, "same text here", "en", "s", 1), (1, "same text here", "en", "s", 1), (2, "same\t\ttext here", "en", "s", 1),
            (3, None, "de", None, None), (4, "", None, "s", 0), (5, " \n ", "de", "s", 3), (None, "no id at all", "en", "s", 1),
            (6, "long " * 30_000, "en", "s", 1), (7, "der die das und nicht", "de", "s", 1), (None, None, None, None, None)]
    d = spark.createDataFrame(rows, SCHEMA)
    return d.select("*", *[F.lit("x").alias(c) for c in CLASHING])


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# helpers

def plain_words(s):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or ""))


def shingles(s, n=5):
    w = plain_words(s)
    return {tuple(w)} if 0 < len(w) < n else {tuple(w[i:i + n]) for i in range(len(w) - n + 1)}


def test_words_and_shingles_of_any_text():
    texts = ["A b\tc  d e f", "", None, "   ", "one", "x\u2003y é É", "a b c d e f", " lead and trail \n"]
    arr = pa.array(texts, pa.string())
    hashes, at = text.words(arr)
    assert np.diff(at).tolist() == [len(plain_words(t)) for t in texts]
    assert hashes[at[0]:at[1]].tolist() == hashes[at[6]:at[7]].tolist()  # case and white space do not matter
    assert len({*hashes.tolist()}) == len({w for t in texts for w in plain_words(t)})
    values, bounds = text.shingle_sets(arr.slice(1))
    assert np.diff(bounds).tolist() == [len(shingles(t)) for t in texts[1:]]
    assert sum(b.num_rows for b in text.pieces(pa.record_batch([arr], ["text"]))) == len(texts)


# 1

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="<p>no</p>";</script><style>p{{}}</style></head>
<body><header><h1>Site</h1></header><nav><ul><li>Home<li>News</ul></nav><div class="cookie-notice">We use cookies</div>
<div class="{main}"><h2>{title}</h2><p>First &amp; <b>bold</b>
  text {n}<br>second line<p>Unclosed {n}<div class="ad">Buy</div><ul><li>one</li><li>two</li></ul>
<aside>More</aside><form><input value="x">Search</form><div id="comments"><p>Nice page!</p></div></div>
<!-- hidden <p>x</p> --><footer>&copy; all pages</footer></body></html>"""


def test_wrapper_finds_the_region_that_changes(spark):
    pages = [(i, f"https://a.example/{i}", PAGE.format(main="story" if i < 8 else "tale", title=f"Title {i}", n=i))
             for i in range(16)]
    rows = extract.extracted(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(4)).collect()
    assert len(rows) == 16
    for r in rows:
        i = r.page_id
        want = f"Title {i}\n\nFirst & bold text {i} second line\n\nUnclosed {i}\n\none\n\ntwo"
        assert r.text == want and r.n_chars == len(want)


def test_pages_of_the_tables_against_a_plain_reading(spark):
    import html

    def plain(page):
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", page, re.S)[1]
        blocks = re.split(r"</?(?:p|h1)>", re.sub("<br>", " ", re.sub("</?b>", "", inner)))
        return "\n\n".join(b for b in (" ".join(html.unescape(x).split()) for x in blocks) if b)

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r.text for r in extract.extracted(pages).collect()}
    assert got == {r.page_id: plain(r.html) for r in pages.collect()}


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "nonsense", ""), (3, "http://b.example", "no markup at all"), (4, "http://b.example", "<p>cut <b"),
            (5, None, "<div><p>a<p>b</div><article>story"), (5, None, "<div><p>a<p>b</div><article>story"), (None, "http://c", "<p>x")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("region", F.lit(2))
    got = sorted((str(r.page_id), r.text, r.n_chars) for r in extract.extracted(d).collect())
    assert got == sorted([("1", "", 0), ("2", "", 0), ("3", "no markup at all", 16), ("4", "cut", 3), ("5", "story", 5), ("5", "story", 5),
                          ("None", "x", 1)])
    assert extract.extracted(d.limit(0)).count() == 0


def test_alignment_makes_groups_options_and_slots():
    one = extract.stream("<div><h1>A</h1><p>x</p></div>")
    two = extract.stream("<div><h1>B</h1><p>y</p><p>z</p><hr><table><tr><td>1</table></div>")
    merged = extract.merged(one, two)
    keys = [i[0] for i in merged]
    assert "(<p # >p)+" in keys and "<table" in keys and keys[0] == "<div"
    assert [i[1] for i in merged if i[0] == "#"][0] is None  # A and B became a slot
    assert {i[3] for i in merged if i[0] == "<table"} == {1} and {i[3] for i in merged if i[0] == "<div"} == {2}


def test_alignment_is_longest_and_takes_any_length():
    def plain(a, b):
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a) - 1, -1, -1):
            for j in range(len(b) - 1, -1, -1):
                best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
        i = j = 0
        found = []
        while i < len(a) and j < len(b):
            if a[i] == b[j]:
                found.append((i, j))
                i, j = i + 1, j + 1
            elif best[i + 1][j] >= best[i][j + 1]:
                i += 1
            else:
                j += 1
        return found

    rng = random.Random(4)
    for _ in range(300):
        a, b = (rng.choices("abcde", k=rng.randint(0, 40)) for _ in "ab")
        assert [(i, j) for both, i, j in extract.aligned(a, b) if both] == plain(a, b)
    one, two = ([["<div.%s%d" % (side, k % 3000), None, 0, 1, None] if k % 2 else ["<b%d" % k, None, 0, 1, None]
                 for k in range(5000)] for side in "xy")
    whole = extract.merged(one, two)
    assert len(whole) == 7500 and sum(i[3] == 2 for i in whole) == 2500
    # a page that comes after many others still teaches the wrapper
    assert "<late" in [i[0] for i in extract.merged(whole, [["<late", None, 0, 1, None]])]


# 2

def test_packing_loses_nothing(spark, documents, odd):
    for docs in (documents, odd):
        parts = {}
        for r in packing.packed_rows(docs, length=128, window_tokens=5000).collect():
            ids = np.frombuffer(r.ids, "<u2")
            assert len(ids) == 128 and r.cu_seqlens[-1] == r.n_tokens and r.position_resets == r.cu_seqlens[:-1]
            assert (ids[r.n_tokens:] == 50256).all()
            for doc, start, a, b in zip(r.doc_ids, r.doc_starts, r.cu_seqlens, r.cu_seqlens[1:]):
                parts.setdefault(doc, []).append((start, tuple(ids[a:b])))
        encode = packing.encoder().encoding.encode_ordinary
        want = Counter()
        for r in docs.select("doc_id", "text").collect():
            want[r.doc_id, tuple([*encode(r.text or ""), 50256])] += 1
        # segments of repeated ids are told apart by their texts
        for doc in {d for d, _ in want}:
            own = sorted(x for (d, ids), n in want.items() if d == doc for x in
                         [(at, ids[at:at + 128]) for at in range(0, len(ids), 128)] * n)
            assert sorted(parts[doc]) == own


def test_best_fit_against_a_plain_search():
    rng = random.Random(4)
    for _ in range(50):
        length = rng.randint(1, 40)
        lengths = sorted((rng.randint(1, length) for _ in range(rng.randint(0, 60))), reverse=True)
        rows = packing.best_fit(lengths, length)
        free = []  # capacities of open rows, by plain best fit
        for n in lengths:
            fits = [f for f in free if f >= n]
            if fits:
                free[free.index(min(fits))] -= n
            else:
                free.append(length - n)
        assert sorted(length - sum(lengths[i] for i in r) for r in rows) == sorted(free)
        assert sorted(i for r in rows for i in r) == list(range(len(lengths)))


def test_packing_edges(spark, none):
    assert packing.packed_rows(none).count() == 0
    assert packing.position_ids([0, 3, 5]).tolist() == [0, 1, 2, 0, 1]
    with pytest.raises(ValueError):
        packing.packed_rows(none, length=0)
    texts = ["a  b", "x\ty", " lead", "trail ", "line\nnext", "a\n\nb", "don't 123 ça?!", "\u2003wide", ""]
    enc = packing.encoder()
    for t in texts:
        assert np.frombuffer(enc.encode(t), np.uint16).tolist() == enc.encoding.encode_ordinary(t)


# 3

def test_code_lengths_against_a_plain_tree():
    rng = np.random.default_rng(0)
    symbols = rng.integers(0, 5, 400)
    stream = np.concatenate([np.zeros(3, int), symbols])
    counts = np.zeros((langid.SYMBOLS,) * 4, np.int64)
    for i in range(3, len(stream)):
        counts[tuple(stream[i - 3:i + 1])] += 1
    bits = langid.code_lengths(counts.ravel()).reshape(counts.shape)

    sums = [counts.sum(axis=tuple(range(3 - k))) for k in range(4)]

    @cache
    def probability(context, symbol):
        own = sums[len(context)][context]
        seen = {s for s in range(langid.SYMBOLS) if own[s] > 0}
        if not seen:
            return (probability(context[1:], symbol) if len(context) else 1 / langid.SYMBOLS)
        total = own.sum()
        escape = len(seen) if len(seen) < langid.SYMBOLS else 0
        if symbol in seen:
            return own[symbol] / (total + escape)
        lower = [probability(context[1:], s) if len(context) else 1 / langid.SYMBOLS for s in range(langid.SYMBOLS)]
        rest = sum(lower[s] for s in range(langid.SYMBOLS) if s not in seen)
        return escape / (total + escape) * lower[symbol] / rest

    for context in ((0, 0, 0), (1, 2, 3), (4, 4, 4), (7, 1, 2)):
        for symbol in (0, 3, 9):
            assert bits[context][symbol] == pytest.approx(-math.log2(probability(context, symbol)), rel=1e-9)
        assert (2.0 ** -bits[context]).sum() == pytest.approx(1)


def test_languages_of_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.predicted(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held) and all(0 <= r.score <= 1 for r in rows)


def test_small_languages_of_one_script_beside_a_large_one(spark):
    rng = random.Random(4)
    latin = [f"{w}{x}" for w in ("lorem", "quick", "jumps", "vexed", "zebra", "fghkw") for x in "0123456789.,;:!?-()'"]
    # words of one length in letters of one script, in two orders
    scripts = {"la": latin, "uk": ["кот", "дом", "сад", "лес"], "bg": ["ток", "мод", "дас", "сел"]}
    rows = [(i, lang, " ".join(rng.choice(scripts[lang]) for _ in range(2000 if lang == "la" else 12)))
            for i in range(600) for lang in [("la", "la", "uk", "bg")[i % 4]]]
    d = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predicted(d).collect()}
    assert all(got[i][0] == lang and got[i][1] > 0.9 for i, lang, _ in rows)
    assert langid.keep_identified(d).count() == len(rows)


def test_signs_of_numbers_are_no_letters():
    assert not any(map(langid.has_letter, ("½ ² ①", "Ⅷ", "12_3", "", "、。", "\u0301")))
    assert all(map(langid.has_letter, ("½a", "Ⅷ ß", "語", "1ª")))


def test_odd_languages(odd, none):
    rows = langid.predicted(odd).collect()
    assert len(rows) == 10
    for r in rows:
        if r.doc_id in (3, 4, 5):
            assert (r.lang_pred, r.score) == ("und", 0.0)
    assert {r.lang_pred for r in rows if r.doc_id == 1} == {"en"}
    assert langid.predicted(none).count() == 0
    kept = langid.keep_identified(odd)
    assert kept.columns == odd.columns and kept.filter("text is null or trim(text) = ''").count() == 0
    # nothing to learn from
    assert {r.lang_pred for r in langid.predicted(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


# 4

def plain_groups(rows):
    groups = {}
    for i, (doc, t) in enumerate(rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(doc)
    out = []
    for doc, t in rows:
        norm = re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
        ids = [d for d in groups[norm] if d is not None]
        keep = min(ids) if ids else None
        out.append((doc, keep, len(groups[norm]), doc == keep, hashlib.sha256(norm.encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("content_hash", [F.md5, lambda c: F.substring(F.md5(c), 1, 1)])
def test_exact_groups_even_when_hashes_collide(odd, documents, content_hash):
    for docs in (odd, documents):
        rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        found = exact_dedup.exact_groups(docs, content_hash=content_hash)
        assert Counter(tuple(r) for r in found.drop("first").collect()) == plain_groups(rows)
        assert found.filter("first").count() == found.select("text_sha256").distinct().count()


def test_exact_duplicates_go(odd, none):
    kept = exact_dedup.drop_exact_duplicates(odd)
    assert kept.columns == odd.columns
    assert sorted((str(r.doc_id), len(r.text or "")) for r in kept.collect()) == [
        ("1", 14), ("3", 0), ("5", 3), ("6", 150000), ("7", 21), ("None", 12)]
    assert exact_dedup.exact_groups(none).count() == 0 and exact_dedup.drop_exact_duplicates(none).columns == none.columns


# 5

def test_base_scores_and_held_out_gain(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = {r.doc_id: r for r in lm.scored(docs).collect()}
    texts = {r.doc_id: [*plain_words(r.text), ""] for r in docs.collect()}
    counts = Counter(w for d, t in texts.items() if zlib.crc32(str(d).encode()) % 7 != 2 for w in t)
    n, kinds = sum(counts.values()), len(counts)
    for d, t in texts.items():
        base = sum(math.log10((counts[w] + 1) / (n + kinds + 1)) for w in t)
        assert rows[d].base_score == pytest.approx(base) and rows[d].train_tokens == n
        assert (rows[d].n_tokens, rows[d].n_known) == (len(t), sum(counts[w] > 0 for w in t))
    held = [r for r in rows.values() if r.held_out]
    assert sum(r.score for r in held) > 1.1 * sum(r.base_score for r in held) and all(r.score < 0 for r in held)


def test_mixed_bits_are_a_distribution():
    rng = np.random.default_rng(0)
    n0, n1 = (rng.integers(0, 50, lm.SLOTS).astype(np.float32) for _ in range(2))
    model = lm.SpellingModel(n0, n1, lm.learn_mixer(n0, n1, [(0, b"some words to learn from"), (1, b"")]))
    # all bytes that may follow one prefix
    data, at = lm.spelled([bytes([97, b]) if b else b"a" for b in range(256)])
    second = np.array([a + 1 for a in at[:-1]])
    total = np.zeros(len(data))
    for slots, bit in lm.bit_slots(data, lm.of_kind(lm.context_hashes(data, at), 1)):
        final = model.final_odds(slots)
        total -= np.logaddexp(0, np.where(bit == 1, -final, final))
    assert np.exp(total[second]).sum() == pytest.approx(1, abs=1e-4)


def test_every_training_word_teaches_the_weights(spark, monkeypatch):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(400)]
    words = spark.createDataFrame([(w.encode(), k % 2, 1 + k % 7) for k, w in enumerate(sorted(set(vocabulary)))], "word binary, kind int, n long")
    n0, n1 = (np.random.default_rng(k).integers(0, 50, lm.SLOTS).astype(np.float32) for k in (0, 1))
    monkeypatch.setattr(lm, "BLOCK_WORDS", 100)
    found = [lm.learned_blocks(words.repartition(parts), n0, n1).orderBy("block").collect() for parts in (1, 5)]
    assert found[0] == found[1] and len(found[0]) == words.count() // 100
    assert sum(r.tokens for r in found[0]) == words.agg(F.sum("n")).first()[0]
    less = lm.learned_blocks(words.withColumn("n", F.when(F.col("word") == words.first().word, 900).otherwise(F.col("n"))), n0, n1)
    assert (lm.averaged(less).weights != lm.averaged(lm.learned_blocks(words, n0, n1)).weights).any()


def test_odd_scores(odd, none):
    rows = lm.scored(odd).collect()
    assert len(rows) == 10 and {r.n_tokens for r in rows if r.doc_id in (3, 4, 5)} == {1}
    assert len({(r.base_score, r.score) for r in rows if r.doc_id in (3, 4, 5)}) == 1  # the same empty text
    assert [r.n_tokens for r in rows if r.doc_id == 6] == [30_001]
    assert all(np.isfinite(r.score) for r in rows)
    assert lm.scored(none).count() == 0
    assert lm.scored(odd.drop("lang"), label_column=None).count() == 10


def test_bytes_after_one_beginning_are_worked_on_once():
    data, at = lm.spelled([b"abc", b"abd", b"abc", b""])
    first, again, hashes = lm.distinct_bytes(data, at, np.repeat([0, 0, 1, 0], np.diff(at)))
    # a, b, c, d, two ends of words, the end of a text; four in the other kind
    assert len(first) == 11 and (data[first][again] == data).all()
    assert all((own == h[first]).all() for own, h in zip(hashes, lm.context_hashes(data, at)))
    seen = np.arange(70_000, dtype=np.float32)
    assert (lm.seen_level(seen, 0 * seen) == np.minimum(np.ceil(np.log2(seen.astype(float) + 1)), lm.LEVELS - 1)).all()
    counts, made = lm.side_by_side(*np.random.default_rng(3).integers(0, 9, (2, lm.SLOTS)).astype(np.float32)), []
    for words, n in ([b"ab", b"abc", b"ab"], [2, 5, 1]), ([b"abc", b"ab"], [5, 3]):
        made.append(lm.Mixer())
        lm.learn_words(made[-1], counts, words, [1] * len(words), n, 0)
    assert np.allclose(made[0].weights, made[1].weights, atol=1e-6) and not np.allclose(made[0].weights, lm.Mixer().weights, atol=1e-3)


# 6

def plain_components(rows, percent=75):
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                label[root(i)] = root(j)
    out = Counter()
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        low = min(ids) if ids else None
        out[doc, len(sets[i]), doc if not sets[i] else low] += 1
    return out


def copies(n, seed=3):
    """Near copies of a few texts, some chained, some in one large group, and unrelated texts sharing a passage."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    rows, base = [], [rng.choice(vocabulary) for _ in range(120)]
    for i in range(n):
        kind = i % 4
        if kind < 2:  # one group of copies that differ in a few words
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
        elif kind == 2:  # a chain: each a little further from the first
            w = base[i // 2:] + [f"c{k}" for k in range(i // 2)]
        else:
            w = [rng.choice(vocabulary) for _ in range(60)] + passage + [rng.choice(vocabulary) for _ in range(60)]
        rows.append((1000 - i, " ".join(w)))
    return rows


def test_near_groups_against_all_pairs(spark, odd):
    for rows in (copies(240), [(r.doc_id, r.text) for r in odd.collect() if r.doc_id != 6]):
        d = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumn("v", F.lit(1)).withColumn("rid", F.lit(2))
        found = Counter((r.doc_id, r.n_shingles, r.component_id) for r in near_dup.near_groups(d).collect())
        assert found == plain_components(rows)


def test_pairs_in_a_large_passage_group_are_found(spark):
    passage, rows = [f"p{k}" for k in range(350)], []
    for i in range(100):  # pairs of 0.75 to 0.77; others share the passage only, 0.66
        for side in "ab":
            rows.append((2 * i + (side == "b"), " ".join(passage + [f"{i}c{k}" for k in range(32)] + [f"{i}{side}{k}" for k in range(56)])))
    assert len(plain_components(rows)) == 200 and len({k[2] for k in plain_components(rows)}) == 100
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in near_dup.near_groups(d).collect()) == plain_components(rows)


def test_two_groups_with_one_bridge_are_one(spark):
    core, rows = [f"c{k}" for k in range(104)], []
    for side in (0, 1):
        own = [f"{'ab'[side]}{k}" for k in range(16)]
        for i in range(200):  # members link within their group and to their end of the bridge
            w = core + own
            w[2 + i % 90] = f"x{i}s{side}"
            rows.append((2 * i + side, " ".join(w)))
        rows.append((500 + side, " ".join(core + own)))  # what the two ends share is in nearly all members
    want = plain_components(rows)
    assert len({k[2] for k in want}) == 1 and len({k[2] for k in plain_components(rows[:-1])}) == 2
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in near_dup.near_groups(d).collect()) == want


def test_pairs_of_a_part_are_fewer_than_its_rows(spark):
    docs = [(i, " ".join(t.split()[:40] + [f"own{i}"])) for i, t in enumerate([" ".join(f"w{k}" for k in range(40))] * 60)]
    docs += [(100 + i, " ".join(f"u{i}x{k}" for k in range(30))) for i in range(20)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    vertices = near_dup.described(d, 5, True).withColumn("least_id", F.col("doc_id"))
    pairs = near_dup.candidates(vertices)
    assert pairs.count() <= near_dup.TREES * 59 and near_dup.links(d, vertices, 5, 75).count() == 59


def test_large_nodes_and_groups_keep_all_links(spark, monkeypatch):
    passage, rows = [f"p{k}" for k in range(350)], copies(160)
    for i in range(40):
        for side in "ab":
            rows.append((2000 + 2 * i + (side == "b"), " ".join(passage + [f"{i}c{k}" for k in range(32)] + [f"{i}{side}{k}" for k in range(56)])))
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = plain_components(rows)
    for part, shingles_held in ((10, 1 << 20), (4096, 900)):  # many parts and branches; parts by the size of sets
        monkeypatch.setattr(near_dup, "NODE_PART", part)
        monkeypatch.setattr(near_dup, "PART_SHINGLES", shingles_held)
        assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in near_dup.near_groups(d).collect()) == want


def test_one_of_each_near_group_stays(spark, none):
    rows = copies(60)
    d = spark.createDataFrame(rows + [(None, "a text without an id"), (None, "another one"), (5, ""), (6, None)],
                              "doc_id long, text string").withColumn("tokens", F.lit("x"))
    kept = near_dup.drop_near_duplicates(d)
    assert kept.columns == d.columns
    want = {c for _, _, c in plain_components(rows)} | {5, 6}
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(want)
    assert kept.filter("doc_id is null").count() == 2
    assert near_dup.near_groups(none).count() == 0 and near_dup.drop_near_duplicates(none).count() == 0


def test_components_of_a_path_and_a_star(spark):
    edges = [(bytes([i]), bytes([i + 1])) for i in range(20)] + [(b"\xf0", bytes([200 + i])) for i in range(10)]
    d = spark.createDataFrame(edges, "a binary, b binary")
    got = {bytes(r.v): bytes(r.low) for r in near_dup.components(d).collect()}
    assert len(got) == 32 and {got[bytes([i])] for i in range(21)} == {b"\0"}
    assert {got[bytes([200 + i])] for i in range(10)} | {got[b"\xf0"]} == {bytes([200])}


# 7

def test_alignment_against_the_plain_recurrence():
    rng = np.random.default_rng(5)
    for _ in range(30):
        a, b = rng.integers(0, 6, rng.integers(1, 20)), rng.integers(0, 6, rng.integers(1, 30))
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                h[i + 1, j + 1] = max(0, h[i, j] + (2 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
        score, end = decontaminate.align(a.astype(np.uint64), b.astype(np.uint64))
        assert score == h.max() and h[:, end].max() == score


def contaminated_fixture(spark):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(500)]

    def some(n):
        return [rng.choice(vocabulary) for _ in range(n)]

    items = [(i, some(30)) for i in range(20)] + [(20, some(3)), (21, some(200))]
    docs, want = [], set()
    for i in range(200):
        w = some(100)
        if i % 4 == 0:
            item, t = items[i // 4 % 20]
            t = list(t)
            for k in range(i % 3 * 2):  # up to four words changed
                t[(7 * k + 5) % 30] = "changed"
            w[40:40] = t if i % 8 else [x.upper() + "," for x in t]
            want.add((i, item))
        docs.append((i, " ".join(w)))
    docs += [(300, " ".join(items[20][1])), (301, " ".join(items[21][1][50:130])), (302, None), (303, "")]
    want |= {(300, 20), (301, 21)}
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit(1)).repartition(3)
    b = spark.createDataFrame([(i, " ".join(w)) for i, w in items] + [(22, None), (23, "")], "item_id long, text string")
    return d, b, want


def test_planted_items_are_found_and_nothing_else(spark, none):
    d, b, want = contaminated_fixture(spark)
    rows = decontaminate.contaminated(d, b).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == want and len(rows) == len(want)
    assert all(0.6 <= r.score <= 1 for r in rows)
    clean = decontaminate.drop_contaminated(d, b)
    assert clean.columns == d.columns and clean.count() == 204 - len({x for x, _ in want})
    assert decontaminate.contaminated(none, b).count() == 0 and decontaminate.contaminated(d, b.limit(0)).count() == 0


def test_an_item_in_every_document_is_found(spark):
    item = " ".join(f"q{i}" for i in range(25))
    d = spark.createDataFrame([(i, f"start {i} {item} end {i}") for i in range(3000)], "doc_id long, text string")
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert decontaminate.contaminated(d, b).count() == 3000


def test_a_part_in_many_documents_and_the_rest_in_one_are_found(spark):
    item = [f"q{i}" for i in range(100)]
    parts = [item[:42] if i < 100 else item[42:] if i == 100 else [] for i in range(200)]
    rows = [(i, " ".join([f"a{i}x{k}" for k in range(20)] + w + [f"b{i}x{k}" for k in range(20)])) for i, w in enumerate(parts)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    b = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.contaminated(d, b).collect()} == set(range(101))


def test_blocks_of_the_benchmark_give_the_same(spark, monkeypatch):
    d, b, want = contaminated_fixture(spark)
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 1500)
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(d, b).collect()} == want


# 8

def test_ids_and_decoded_texts_of_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    model = bpe.vocabulary()
    rng = random.Random(1)
    letters = "abcdefghijklmnopqrstuvwxyzaeiouTHEé'0123456789  \n\t.,!?-_ßΣσçñ漢字한글🙂\x1c\x85\u2003\u0301Å"
    pieces = [t.removesuffix("</w>") for t in model.vocab]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += [" ".join(rng.choice(pieces) + rng.choice(pieces) for _ in range(20)) for _ in range(1500)]
    texts += ["a<|endoftext|>b <|startoftext|>", "<|endoftext|><|endoftext|>", "<|endof", "", " ", "İstanbul ΑΣ ΑΣ. ﬀ ½ ٣", "x" * 5000]
    for t in texts:
        want = library.encode(t, add_special_tokens=False).ids
        ids, tokens = model.encode(t)
        assert ids == " ".join(map(str, want)) and tokens == library.decode(want, skip_special_tokens=False), repr(t)


def test_every_token_is_its_own_encoding():
    model = bpe.vocabulary()
    assert all(model.whole(i) for i in model.parts)


def test_words_are_encoded_once_and_from_shared_prefixes(monkeypatch):
    model = bpe.vocabulary()
    rng = random.Random(5)
    stems = ["".join(rng.choice("abeinrstäß") for _ in range(rng.randint(2, 12))) for _ in range(60)]
    words = [rng.choice(stems) + rng.choice(stems) for _ in range(400)]

    def plain(word):
        parts = list(word.encode().decode("latin-1").translate(model.characters))
        ids = [model.vocab[p] for p in [*parts[:-1], parts[-1] + "</w>"]]
        while made := [(model.rank[model.merge[ab]], k, model.merge[ab]) for k, ab in enumerate(zip(ids, ids[1:])) if ab in model.merge]:
            _, k, one = min(made)
            ids[k:k + 2] = [one]
        return " ".join(map(str, ids))

    # small stores forget much and give the same
    for size in 7, 100_000:
        monkeypatch.setattr(bpe, "CACHED_WORDS", size)
        monkeypatch.setattr(bpe, "CACHED_PAIRS", size)
        for k in range(0, 400, 50):
            part = words[k:k + 50]
            assert [i for i, _ in model.encode_all(part)] == [plain(w) for w in part]
            assert [model.encode(w) for w in part] == model.encode_all(part)
    asked = []
    encode_words = model.encode_words
    monkeypatch.setattr(model, "encode_words", lambda own: asked.extend(own) or encode_words(own))
    found = model.encode_all(["Qzxvkj qzxvkj, QZXVKJ!", "qzxvkj", ""])
    assert asked.count("qzxvkj") == 1 and found[0][0].split()[-1] == str(model.vocab["!</w>"]) and found[2] == ("", "")


def test_odd_texts_encode(odd, none):
    rows = {(r.doc_id, r.n_tokens) for r in bpe.digests(odd).collect()}
    assert {(3, 0), (4, 0), (5, 0), (6, 30000), (None, 0), (None, 4)} <= rows
    encoded = bpe.encoded(odd)
    back = {r.doc_id: r.text for r in bpe.decoded(encoded.withColumn("text", F.lit("clash"))).collect()}
    assert back[1] == "same</w> text</w> here</w>" and back[3] == ""
    assert bpe.digests(none).count() == bpe.encoded(none).count() == 0
    ids = {r.doc_id: np.frombuffer(r.ids, "<u2").tolist() for r in bpe.digests(odd, with_ids=True).collect()}
    assert ids[1] == next(r.ids for r in encoded.collect() if r.doc_id == 1)


# 9

def test_table_is_even_and_moves_little():
    names = sharding.default_shards(16)
    table = sharding.lookup_table(names, 1031)
    counts = Counter(table)
    assert max(counts.values()) - min(counts.values()) <= 1 and len(counts) == 16
    # against a plain reading of the rule
    plain, at = {}, [0] * 16
    while len(plain) < 1031:
        for i, s in enumerate(names):
            h = hashlib.md5(s.encode()).hexdigest()
            offset, skip = int(h[:15], 16) % 1031, int(h[16:31], 16) % 1030 + 1
            while (offset + at[i] * skip) % 1031 in plain:
                at[i] += 1
            plain[(offset + at[i] * skip) % 1031] = i
            if len(plain) == 1031:
                break
    assert [plain[k] for k in range(1031)] == table
    fewer = sharding.lookup_table(names[:-1], 1031)
    moved = sum(a != b for a, b in zip(table, fewer) if a != 15)
    assert moved < 0.25 * 1031
    for bad in (([], 7), (["a", "a"], 7), (["a"], 8), (["a", "b", "c"], 2)):
        with pytest.raises(ValueError):
            sharding.lookup_table(*bad)


def test_odd_keys_have_a_shard(spark, odd, none, tmp_path):
    rows = sharding.placed(spark, odd, "doc_id", sharding.default_shards(4), 101).select("row.doc_id", "slot", "shard").collect()
    assert len(rows) == 10 and len({r.shard for r in rows if r.doc_id is None}) == 1
    assert len({(r.slot, r.shard) for r in rows if r.doc_id == 1}) == 1
    assert sharding.placed(spark, none, "doc_id", sharding.default_shards()).count() == 0
    sharding.write_shards(spark, odd, "doc_id", str(tmp_path / "shards"), sharding.default_shards(4), 101, 2)
    assert spark.read.parquet(str(tmp_path / "shards")).count() == 10


# 10

def test_branches_of_a_tree(spark):
    rows = [("t", 1, None, "user", "q", 0.0), ("t", 2, 1, "assistant", "a", 1.0), ("t", 3, 1, "assistant", "b </turn>", 5.0),
            ("t", 4, 2, "user", "more ### \\", 3.0), ("t", 5, 4, "assistant", None, None), ("u", 1, 99, None, "lone", 1.0),
            ("t", 5, 4, "assistant", None, None), (None, None, None, "user", "x", None)]
    d = spark.createDataFrame(rows, "tree string, id long, parent long, role string, text string, score double").withColumn("up", F.lit(1))
    turns = chat.conversation_turns(d, "tree", "id", "parent", "role", "text", "score")
    found = {}
    for r in turns.orderBy("tree", "branch", "position").collect():
        found.setdefault((r.tree, r.branch), []).append(r.formatted)
    assert found[("t", 1)] == ["### user: q</turn>\n", "### assistant: b \\</turn></turn>\n"]
    assert found[("t", 2)] == ["### user: q</turn>\n", "### assistant: a</turn>\n", "### user: more \\### \\\\</turn>\n",
                               "### assistant: </turn>\n"]
    assert found[("u", 1)] == ["### : lone</turn>\n"] and found[(None, 1)] == ["### user: x</turn>\n"]
    best = chat.conversation_turns(d, "tree", "id", "parent", "role", "text", "score", best=1)
    assert best.filter("tree = 't'").count() == 2
    with pytest.raises(ValueError):
        chat.conversation_turns(spark.createDataFrame([("t", 1, 2, "a", "b"), ("t", 2, 1, "a", "b")],
                                                      "tree string, id long, parent long, role string, text string"),
                                "tree", "id", "parent", "role", "text")


def test_formatted_texts_read_back(spark):
    rng = random.Random(2)
    pieces = ["\\", "#", "##", "###", "####", "</turn>", "</turn", "<", "/turn>", ":", " ", "\n", "é", "### user: ", "x"]
    rows = [(c, t, rng.choice(["user", "assistant", "a:b", "", "sys\\tem"]), "".join(rng.choices(pieces, k=rng.randint(0, 9))))
            for c in range(40) for t in range(rng.randint(1, 9))] + [(50, t, "assistant", None) for t in range(70)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns = chat.conversation_turns(chat.threads(d), "conv_id", "node", "parent", "role", "text")
    got = {r.conv_id: r for r in chat.read_back(turns).collect()}
    whole = {r.tree: r for r in chat.formatted_conversations(turns).collect()}
    for c in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == c), key=lambda r: r[1])
        told = "".join(f"{r[2]}\n{r[3] or ''}\n" for r in own)
        learned = "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert got[c].turns_sha256 == hashlib.sha256(told.encode()).hexdigest() and got[c].n_turns == len(own)
        assert got[c].loss_sha256 == hashlib.sha256(learned.encode()).hexdigest() and got[c].loss_chars == len(learned)
        text_ = whole[c].formatted
        assert got[c].formatted_chars == len(text_)
        assert "".join(chat.unescaped(text_[a:b]) for a, b in whole[c].loss_spans) == learned
        assert [(chat.unescaped(a), chat.unescaped(b)) for a, b in chat._TURN.findall(text_)] == [(r[2], r[3] or "") for r in own]
    assert chat.read_back(chat.conversation_turns(chat.threads(d.limit(0)), "conv_id", "node", "parent", "role", "text")).count() == 0
