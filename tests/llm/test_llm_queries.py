"""Registered queries next to their SQL on the smallest tables, and the pipeline next to brute force."""

import duckdb
import pytest

import corpus_pipeline
from check import TABLES, compare
from cohortline.llm import bpe, catalog, decontaminate
from test_llm_operators import plain_components, plain_groups, plain_words

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(catalog.CHECKS))
def test_query_and_sql(spark, duck, name):
    note, n = compare(name, catalog.QUERIES[name](spark, SF), duck, catalog.CHECKS[name])
    assert not note and n > 0


def test_stages_and_queries_are_complete():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "decontaminate", "bpe_codec"]
    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in catalog.QUERIES if q != "pipeline"}
    assert set(catalog.CHECKS) <= set(catalog.QUERIES)


def plain_hits(docs, items):
    """Documents holding an item, by the whole alignment of every pair."""
    import numpy as np
    import re

    def tokens(s):
        return re.findall(r"[^\W_]+", (s or "").lower())

    number = {}
    code = lambda s: np.array([number.setdefault(w, len(number)) for w in tokens(s)], np.uint64)
    coded = [(i, code(t)) for i, t in items]
    out = set()
    for doc, t in docs:
        own = code(t)
        for _, item in coded:
            if len(np.intersect1d(own, item)) >= 0.55 * len(set(item.tolist())):
                score, _ = decontaminate.align(item, own)
                if score >= decontaminate.LEAST_SCORE * 2 * min(len(item), decontaminate.ENOUGH_WORDS):
                    out.add(doc)
                    break
    return out


def test_pipeline_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = docs
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = got
        got = stage(spark, got, SF)
        kept[name] = [(r.doc_id, r.text) for r in got.collect()] if name != "bpe_codec" else got.collect()
        if name != "bpe_codec":
            assert got.columns == before.columns == docs.columns
    start = [(r.doc_id, r.text) for r in docs.collect()]
    assert {d for d, t in start} - {d for d, _ in kept["language_id"]} <= {d for d, t in start if len(plain_words(t)) < 3}
    assert {d for d, _ in kept["exact_dedup"]} == {d for d, k, _, keep, _ in plain_groups(kept["language_id"]) if keep}
    assert {d for d, _ in kept["near_dedup"]} == {c for _, _, c in plain_components(kept["exact_dedup"])}
    hits = plain_hits(kept["near_dedup"], items)
    assert {d for d, _ in kept["decontaminate"]} == {d for d, _ in kept["near_dedup"]} - hits and hits
    texts = dict(kept["decontaminate"])
    for r in kept["bpe_codec"]:
        ids, tokens = bpe.vocabulary().encode(texts[r.doc_id])
        assert r.n_tokens == len(ids.split())
    assert len(kept["bpe_codec"]) == len(texts)
