"""Benchmark decontamination: documents that contain a benchmark item, by an exact join of shingles.

The table of all items' shingles has a fixed size; each document's shingles are looked up there in one pass, and only hits
leave the task. Hits meet the items' shingles by their words, and the shared ones are counted for each document and item.
That join stands in place of MinHash sketches within size classes: a document that holds the share ``num / den`` of an
item's n shingles holds one of its n - ceil(share * n) + 1 shingles of smallest hash anyway, so the mark of these drops
nothing after the count, and neither does the size class. A shingle of many items and many documents gives a row for each two.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from concord.llm.tables import presence, present
from concord.llm.words import ALNUM, LOWER, Words, mix, parts, text_bytes, words

#: Bits of the table of benchmark shingles. More shingles than bits cost time, not results.
TABLE_BITS = 1 << 23


def _runs(found: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and validity of the ``size`` words that start at each word."""
    h, n = found.hash, len(found.hash)
    rolled, valid = h.copy(), np.ones(n, bool)
    for k in range(1, min(size, n)):
        rolled[: n - k] = mix(rolled[: n - k]) + h[k:]
    if size > 1:
        valid[max(0, n - size + 1) :] = False
        valid[: max(0, n - size + 1)] = found.row[: max(0, n - size + 1)] == found.row[size - 1 :][: max(0, n - size + 1)]
    return mix(rolled + np.uint64(size)), valid


def _shingle_rows(batch: pa.RecordBatch, sizes: list[int], table: np.ndarray | None) -> pa.RecordBatch:
    """(id, size, hash, shingle) of the distinct shingles of each row, with a table only of those present in it."""
    data, offsets = text_bytes(batch.column(1))
    found = words(data, offsets, ALNUM)
    low = LOWER[data].tobytes()
    row, size, hashed, text = [], [], [], []
    for k in sizes:
        h, valid = _runs(found, k)
        at = np.flatnonzero(valid if table is None else valid & present(table, h))
        if len(at) == 0:
            continue
        first = np.unique(np.stack((found.row[at].astype(np.uint64), h[at]), 1), axis=0, return_index=True)[1]
        at = at[first]
        starts, ends = found.start, found.end
        text += [b" ".join(low[starts[j] : ends[j]] for j in range(i, i + k)).decode() for i in at.tolist()]
        row.append(found.row[at])
        size += [k] * len(at)
        hashed.append(h[at].view(np.int64))
    take = pa.array(np.concatenate(row) if row else np.zeros(0, np.int64))
    return pa.RecordBatch.from_arrays(
        [batch.column(0).take(take), pa.array(size, pa.int32()),
         pa.array(np.concatenate(hashed) if hashed else np.zeros(0, np.int64)), pa.array(text, pa.string())],
        names=["id", "size", "hash", "shingle"],
    )


def _shingles(rows: DataFrame, sizes: list[int], table: np.ndarray | None) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(table) if table is not None else None

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, "text"):
                yield _shingle_rows(part, sizes, sent.value if sent else None)

    return rows.mapInArrow(scan, "id long, size int, hash long, shingle string")


def _n_words(items: DataFrame) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = words(*text_bytes(batch.column(1)), ALNUM)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.counts.astype(np.int64))], names=["id", "n_words"])

    return items.mapInArrow(scan, "id long, n_words long")


def contained(
    docs: DataFrame, items: DataFrame, size: int = 5, num: int = 80, den: int = 100,
    ident: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared, containment) for every item that a document contains.

    Words are runs of ASCII letters and digits and all other characters outside ASCII, A-Z lower-cased; shingles are
    ``size`` words, or the whole item where it has fewer. A document contains an item when it holds at least ``num / den``
    of the item's distinct shingles, anywhere in its text. Null and empty texts and texts without words contain nothing and
    are in nothing. Rows of one id count as one document or item with the shingles of all of them; rows with a
    null id are left out. Empty tables give no rows; further columns are not looked at.
    """
    docs = docs.select(F.col(f"`{ident}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    items = items.select(F.col(f"`{item}`").cast("long").alias("id"), F.col(f"`{item_text}`").cast("string").alias("text"))
    docs, items = docs.where("id is not null"), items.where("id is not null")
    short = _n_words(items).where(f"n_words between 1 and {size - 1}").select("n_words").distinct()
    sizes = sorted({size, *(int(r.n_words) for r in short.collect())})  # at most ``size`` numbers

    owned = _shingles(items, sizes, None).join(
        _n_words(items).groupBy("id").agg(F.max("n_words").alias("n_words")), "id"
    ).where(F.col("size") == F.least("n_words", F.lit(size))).select("id", "size", "hash", "shingle").distinct()
    n = F.count("*").over(Window.partitionBy("id"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("hash", "shingle"))
    owned = owned.withColumn("n", n).withColumn("size_class", F.floor(F.log2(n))).withColumn("rank", rank)
    owned = owned.withColumn("sketch", F.col("rank") <= F.col("n") - F.ceil((F.col("n") * num) / F.lit(den)) + 1)
    owned = owned.select(F.col("id").alias("item_id"), "size", "shingle", "hash", "n", "size_class", "sketch")

    table = presence(owned.select("hash").distinct(), TABLE_BITS)
    hits = _shingles(docs, sizes, table).distinct().withColumnRenamed("id", "doc_id")
    found = hits.join(owned.drop("hash"), ["size", "shingle"])
    shared = found.groupBy("doc_id", "size_class", "item_id", "n").agg(
        F.count("*").alias("n_shared"), F.max("sketch").alias("candidate")
    )
    return shared.where("candidate").where(F.col("n_shared") * den >= F.col("n") * num).select(
        "doc_id", "item_id", F.col("n").alias("n_shingles"), "n_shared", (F.col("n_shared") / F.col("n")).alias("containment")
    )
