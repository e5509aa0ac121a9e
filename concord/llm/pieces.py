"""SentencePiece ids: each distinct marked word is segmented once, and its ids are put back where the word stands."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.llm.dictionary import by_distinct_piece

MARK = "▁"
#: A run of blanks or marks and what follows it; the library puts one mark before a text.
_WORD = re.compile(f"[ {MARK}]+[^ {MARK}]*")


@functools.cache
def _processor(path: str):
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=path)


def marked_words_stand_alone(path: str) -> bool:
    """Whether no piece of the model has a mark after another character, so that words can be segmented apart."""
    model = _processor(path)
    return not any(MARK in model.id_to_piece(i).lstrip(MARK) for i in range(model.get_piece_size()))


def encode(docs: DataFrame, path: str, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """One row (doc_id, ids) per row of ``docs``: the ids of its whole text, without begin or end.

    A model whose pieces cross marks is refused. Null and empty texts have no ids. Rows with a null or repeated id are
    kept; an empty table gives no rows; further columns are not looked at. ``docs`` is read twice.
    """
    if not marked_words_stand_alone(path):
        raise ValueError("the model has pieces that cross a white space marker")

    def cut(value: str) -> list[str]:
        return _WORD.findall(" " + value) if value else []

    def solve(words: list[str]) -> list[list[int]]:
        model = _processor(path)
        lone = [model.piece_to_id(MARK)]
        return [ids if len(w) > 1 else lone for w, ids in zip(words, model.encode([w[1:] for w in words], num_threads=1), strict=True)]

    def ids(offsets: np.ndarray, values: np.ndarray, own: np.ndarray) -> np.ndarray:
        start, n = offsets[own], offsets[own + 1] - offsets[own]
        shift = np.repeat(start - np.concatenate(([0], np.cumsum(n)[:-1])), n) if len(own) else np.zeros(0, np.int64)
        return values[shift + np.arange(len(shift))].astype(np.int32)

    pairs = docs.select(F.col(f"`{ident}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return by_distinct_piece(pairs, cut, solve, ids, False, pa.list_(pa.int32()), "array<int>", cut_again=True).select(
        "doc_id", F.col("result").alias("ids")
    )


def decode(rows: DataFrame, path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """``rows`` with the text of their ids; null ids give an empty text."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _processor(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [model.decode(x.as_py() or []) for x in part.column(batch.schema.get_field_index(ids))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, into])

    return rows.mapInArrow(scan, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", `{into}` string")
