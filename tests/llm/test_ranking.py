"""Ranked search against a plain scoring of every document, on odd rows."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from concord.llm import ranking
from tests.llm.test_operators import ODD, lower, prose

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def terms(text):
    return re.findall(TERM, lower(text or ""))


def plain_ranks(docs, items, k):
    counted = [(i, Counter(t), len(t)) for i, t in ((i, terms(t)) for i, t in docs) if t]
    documents, length = len(counted), sum(n for *_, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in set(items):
        scores = []
        for i, c, n in counted:
            m = 100 - 90 + (90 * n * documents) // length
            score = sum(
                math.floor(1000 * math.log((2 * documents + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
                for t in set(terms(text)) if t in c
            )
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out += [(item, rank + 1, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(scores)[:k])]
    return sorted(map(str, out))


def rows_of(spark, items):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id long, text string, doc_id string, score long").repartition(2)


def found(docs, items, k=10):
    return sorted(str((r.item_id, r["rank"], r.doc_id, r.score)) for r in ranking.ranked(docs, items, k).collect())


@pytest.fixture(scope="module")
def texts():
    return [(i, t) for i, t in prose(400, 9)] + ODD + [(None, "w1 w2 w3"), (900, "w1 w2 w3"), (899, "W1, w2; w3!")]


@pytest.mark.parametrize("k", [1, 10, 1000])
def test_ranked(spark, docs_of, texts, k):
    items = [(i, t) for i, t in prose(40, 21)] + [
        (1, None), (2, ""), (3, "?! ..."), (4, "word"), (5, "w1 w2 w3"), (5, "w1 w2 w3"), (5, "w4 w5"), (None, "W1 w1 ünïcode"), (6, "nowhere at all"),
        (7, "long " * 2000 + "word"),
    ]
    assert found(docs_of(texts, 5), rows_of(spark, items), k) == plain_ranks(texts, items, k)


def test_queries_in_sets(spark, docs_of, texts, monkeypatch):
    monkeypatch.setattr(ranking, "QUERY_TERMS", 100)
    items = [(i, t) for i, t in prose(60, 5)]
    assert found(docs_of(texts, 7), rows_of(spark, items)) == plain_ranks(texts, items, 10)


def test_empty_tables(spark, docs_of, texts):
    items = rows_of(spark, [(1, "w1")])
    assert found(docs_of(texts).limit(0), items) == [] and found(docs_of(texts), items.limit(0)) == []
    assert found(docs_of([(1, None), (2, "..")]), items) == []


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 5), st.booleans())
def test_accumulators(seed, k, outside):
    """The best scores are exact, and documents without an accumulator could not have been among them."""
    rng = random.Random(seed)
    n = rng.randint(1, 40)
    postings = []
    for _ in range(rng.randint(0, 12)):
        at = np.array(sorted(rng.sample(range(n), rng.randint(1, n))))
        postings.append((at, np.array([rng.choice([0, 1, 2, 50, 400]) for _ in at], np.int64)))
    whole = np.zeros(n, np.int64)
    for at, add in postings:
        whole[at] += add
    floor = rng.choice(sorted(whole)) if outside else 0
    score = ranking.accumulate(postings, n, k, int(floor))
    assert all(s in (0, w) for s, w in zip(score, whole))
    bar = max(floor, sorted(whole)[-k] if n >= k else 0, 1)
    assert [s for s, w in zip(score, whole) if w >= bar] == [w for w in whole if w >= bar]


def test_accumulators_are_limited():
    many = np.arange(10_000)
    postings = [(many[:20], np.full(20, 1000)), (many, np.full(10_000, 5)), (many[::2], np.full(5_000, 3))]
    score = ranking.accumulate(postings, 10_000, 10, 0)
    assert np.flatnonzero(score).tolist() == list(range(20)) and score[:4].tolist() == [1008, 1005, 1008, 1005]
