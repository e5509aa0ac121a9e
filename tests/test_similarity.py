"""Similarity functions against published values and brute force."""

import random
from difflib import SequenceMatcher

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from concord.functions import kernels
from concord.functions import similarity as si
from tests import plain_similarity as plain


def test_published_jaro_winkler_values():
    assert round(plain.jaro_winkler_pair("MARTHA", "MARHTA"), 4) == 0.9611
    assert round(plain.jaro_winkler_pair("DIXON", "DICKSONX"), 4) == 0.8133
    assert plain.jaro_winkler_pair("", "a") == 0.0 and plain.jaro_winkler_pair("é", "é") == 1.0


def test_jaro_winkler_on_random_texts():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcd -") for _ in range(rng.randint(1, 16)))
    pairs = [(word(), word()) for _ in range(3000)]
    con = duckdb.connect()
    for a, b in pairs:
        assert "'" not in a + b
    values = ", ".join(f"('{a}', '{b}')" for a, b in pairs)
    for a, b, s in con.sql(f"SELECT a, b, jaro_winkler_similarity(a, b) FROM (VALUES {values}) v(a, b)").fetchall():
        assert plain.jaro_winkler_pair(a, b) == pytest.approx(s, abs=1e-9)


def test_common_subsequence_by_brute_force():
    def slow(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            prev = row[:]
            for j, y in enumerate(b):
                row[j + 1] = prev[j] + 1 if x == y else max(prev[j + 1], row[j])
        return row[-1]

    rng = random.Random(3)
    for _ in range(500):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 70))) for _ in range(2))
        assert plain.common_subsequence(a, b) == slow(a, b)


def test_window_ratio_by_brute_force():
    rng = random.Random(5)
    for _ in range(200):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(1, 6)))
        b = "".join(rng.choice("abc") for _ in range(rng.randint(len(a) + 1, 14)))
        n = len(a)
        windows = {b[max(0, i): i + n] for i in range(-n + 1, len(b))} - {""}
        assert plain.best_window_ratio(a, b) == pytest.approx(max(plain.indel_ratio(a, w) for w in windows))


def test_published_weighted_ratio_values():
    assert plain.weighted_ratio_pair("this is a test", "this is a new test!!!") == pytest.approx(85.5)
    assert plain.weighted_ratio_pair("fuzzy was a bear", "bear a was fuzzy") == pytest.approx(95.0)
    assert plain.weighted_ratio_pair("abc", "abc") == 100.0 and plain.weighted_ratio_pair("", "abc") == 0.0


def some_pairs(n, seed):
    """Pairs of words, edited copies, word lists, short against long texts, and texts longer than a machine word."""
    rng = random.Random(seed)
    word = lambda letters, low, high: "".join(rng.choice(letters) for _ in range(rng.randint(low, high)))
    for _ in range(n):
        kind = rng.random()
        if kind < 0.3:
            yield word("abcd -", 0, 16), word("abcd -", 0, 16)
        elif kind < 0.6:
            a = word("abcdefghijklmnop ", 1, 30)
            b = list(a)
            for _ in range(rng.randint(0, 4)):
                b[rng.randrange(len(b))] = rng.choice("abcxyz é😀")
            yield a, "".join(b) + (word("abc ", 0, 40) if rng.random() < 0.3 else "")
        elif kind < 0.8:
            yield word("ab ", 0, 8), word("ab ", 0, 90)
        elif kind < 0.97:
            yield tuple(" ".join(word("ab", 1, 2) for _ in range(rng.randint(0, 6))) for _ in range(2))
        else:
            yield word("abcdefgh", 60, 140), word("abcdefgh", 100, 300)


def test_kernels_by_brute_force():
    pairs = list(some_pairs(12_000, 2)) + [("", ""), ("a", ""), ("", "a"), ("x" * 300, "x" * 299 + "y"), ("ab" * 150, "ba" * 150)]
    left, right = map(list, zip(*pairs))
    a, b = kernels.coded(left, right)
    at = np.arange(len(pairs))
    assert kernels.jaro_winkler(a, b).tolist() == [plain.jaro_winkler_pair(*p) for p in pairs]
    assert kernels.subsequence(a, b).tolist() == [plain.common_subsequence(*p) for p in pairs]
    assert kernels.best_window(a, b).tolist() == [plain.best_window_ratio(*p) for p in pairs]
    assert kernels.sequence_ratio(a, b).tolist() == [SequenceMatcher(None, *p).ratio() for p in pairs]
    assert kernels.weighted_ratio(left, right, at, at).tolist() == [plain.weighted_ratio_pair(*p) for p in pairs]


def test_kernels_tell_many_characters_apart():
    rng = random.Random(8)
    for size in (300, 70_000):  # more than one byte, more than two bytes of distinct characters
        codes = [c for c in range(0x100, 0x100 + size + 0x900) if not 0xD800 <= c < 0xE000][:size]
        text = "".join(map(chr, codes))
        pairs = [(text, "x")] + [tuple("".join(chr(rng.choice(codes[:40] + codes[-40:])) for _ in range(20)) for _ in range(2)) for _ in range(50)]
        left, right = map(list, zip(*pairs))
        a, b = (s.take(np.arange(1, 51)) for s in kernels.coded(left, right))
        assert kernels.sequence_ratio(a, b).tolist() == [SequenceMatcher(None, *p).ratio() for p in pairs[1:]]
        assert kernels.jaro_winkler(a, b).tolist() == [plain.jaro_winkler_pair(*p) for p in pairs[1:]]


def test_popular_characters_start_no_match():
    rng = random.Random(6)
    pairs = []
    for _ in range(60):
        b = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789" + "  e") for _ in range(rng.randint(190, 420)))
        k = rng.randrange(len(b))
        pairs.append((b[k:] + "e  e" + b[: k // 2], b))
    left, right = map(list, zip(*pairs))
    assert kernels.sequence_ratio(*kernels.coded(left, right)).tolist() == [SequenceMatcher(None, *p).ratio() for p in pairs]


def test_columns_score_every_row(spark):
    rows = [(None, "a"), ("", ""), ("abc", "abc"), ("abc", "abd"), ("x\0y", "x")] * 50
    df = spark.createDataFrame(rows, "a string, b string").select(
        "a", "b", si.jaro_winkler(F.col("a"), F.col("b")).alias("jw"), si.weighted_ratio(F.col("a"), F.col("b")).alias("wr"),
        si.sequence_ratio(F.col("a"), F.col("b")).alias("sr"))
    for r in df.collect():
        a, b = r.a or "", r.b or ""
        assert r.jw == round(plain.jaro_winkler_pair(a, b), 4)
        assert r.wr == round(plain.weighted_ratio_pair(a, b) / 100, 4)
        assert r.sr == plain.sequence_ratio_pair(a, b)


def test_sql_registration(spark):
    si.register(spark)
    assert spark.sql("SELECT jaro_winkler('MARTHA', 'MARHTA')").first()[0] == 0.9611
