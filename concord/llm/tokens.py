"""Token counts: pieces are counted once per distinct pre-token and summed over each document's pre-token frequencies."""

from __future__ import annotations

import functools
import os
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.llm.dictionary import by_distinct_piece


@functools.cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokenizer.from_file(path)


@functools.cache
def _marks(path: str) -> list[str]:
    return [t.content for t in _tokenizer(path).get_added_tokens_decoder().values()]


@functools.cache
def _settled(char: str) -> bool:
    """Whether this Python's Unicode tables know the character; on newer ones libraries may disagree."""
    return unicodedata.category(char) != "Cn"


def _pre_tokens(path: str, cut: regex.Pattern, text: str) -> list[str]:
    """Pieces that the tokenizer never merges across. Texts with characters too new to be sure go to the library."""
    found, rest = [], [text]
    for mark in _marks(path):
        if mark in text:
            found += [mark] * sum(s.count(mark) for s in rest)
            rest = [x for s in rest for x in s.split(mark)]
    for segment in rest:
        if segment.isascii() or all(map(_settled, set(segment))):
            found += cut.findall(segment)
        else:
            found += [segment[a:b] for _, (a, b) in _tokenizer(path).pre_tokenizer.pre_tokenize_str(segment)]
    return found


def token_counts(
    docs: DataFrame, path: str, pattern: str, limit: int = 1024, ident: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row (doc_id, n_bytes, n_tokens, over_limit) per row of ``docs``.

    ``path`` is a byte-level BPE file of the tokenizers library and ``pattern`` its pre-token pattern; special strings in a
    text count as the library takes them, none are added. Null and empty texts have no tokens; rows with a null or
    repeated id are counted like any other. An empty table gives no rows; further columns are not looked at.
    """
    def solve(pieces: list[str]) -> list[list[int]]:
        return [[len(e)] for e in _tokenizer(path).encode_batch_fast(pieces, add_special_tokens=False)]

    def total(offsets: np.ndarray, values: np.ndarray, own: np.ndarray) -> int:
        ids, counts = own[: len(own) // 2], own[len(own) // 2 :]
        return int((values[ids].astype(np.int64) * counts).sum())

    cut = regex.compile(pattern)
    pairs = docs.select(F.col(f"`{ident}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    counted = by_distinct_piece(pairs, lambda t: _pre_tokens(path, cut, t), solve, total, True, pa.int64(), "long")
    return counted.select("doc_id", "n_bytes", F.col("result").alias("n_tokens"), (F.col("result") > limit).alias("over_limit"))
