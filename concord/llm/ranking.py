"""Ranked lexical search: the best documents of every query text, term by term with a limited set of accumulators.

1. One pass over the documents keeps, for each block of them, the postings of those terms that any query holds (a table of
   fixed size says which; a stray term in it costs space, not results). Blocks are written and never shuffled.
2. The blocks give the number of documents, of terms, and of documents for each term.
3. In each block every query's terms come rarest first. A term adds to the accumulators of its documents; once what the
   remaining terms can add at most is below the k-th best partial score so far, no document without an accumulator
   can come up any more: no new ones are made, and those there are go on to their exact scores.
4. A task carries its k best documents of each query from block to block, so later blocks stop earlier; they meet at the end.

Queries are worked on in sets of bounded size, each in one pass over the blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from concord.llm.tables import pack, presence, present, unpack, written
from concord.llm.words import ALNUM, parts, text_bytes, words

#: Bits of the table of query terms.
TABLE_BITS = 1 << 24
#: Text of one block of documents, unless one document has more.
BLOCK_BYTES = 1 << 23
#: Terms of the queries that go to all executors at a time, unless one query has more.
QUERY_TERMS = 1 << 20
#: Terms of a task's counts before equal ones are added up.
HELD = 1 << 21

# Fixed values of the score: how fast repeats of a term saturate, how much length counts, and the scales of whole numbers.
SATURATION, LENGTH_SHARE = 8, 90
WEIGHT_SCALE, IMPACT_SCALE = 1000, 1_000_000_000

INDEX = "ids binary, no_id binary, n binary, terms binary, starts binary, doc binary, tf binary, documents long, length long"


def weight(documents: int, df: int) -> int:
    """Weight of a term that ``df`` of ``documents`` documents hold."""
    return math.floor(WEIGHT_SCALE * math.log((2 * documents + 2) / (2 * df + 1)))


def _index(batch: pa.RecordBatch, table: np.ndarray) -> pa.RecordBatch:
    """The block of a run of documents: postings sorted by term, with lengths of all its documents."""
    found = words(*text_bytes(batch.column(1)), ALNUM)
    at = np.flatnonzero(present(table, found.hash))
    order = at[np.lexsort((found.row[at], found.hash[at]))]
    term, row = found.hash[order], found.row[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (term[1:] != term[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(fresh)
    tf = np.diff(np.append(first, len(order)))
    terms, starts = np.unique(term[first], return_index=True)
    ids = batch.column(0)
    body = [
        ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8),
        found.counts.astype(np.int64), terms, starts.astype(np.int64), row[first].astype(np.int32), tf.astype(np.int32),
    ]
    columns = [pa.array([pack(x)], pa.binary()) for x in body]
    columns += [pa.array([int((found.counts > 0).sum())], pa.int64()), pa.array([len(found.hash)], pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in INDEX.split(", ")])


def index(docs: DataFrame, table: np.ndarray) -> DataFrame:
    """Blocks of ``docs`` (id, text) with the postings of the terms present in ``table``."""
    sent = docs.sparkSession.sparkContext.broadcast(table)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, "text", BLOCK_BYTES):
                yield _index(part, sent.value)

    return docs.mapInArrow(scan, INDEX)


def _added(terms: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys, back = np.unique(np.concatenate(terms), return_inverse=True)
    total = np.zeros(len(keys), np.int64)
    np.add.at(total, back, np.concatenate(counts))
    return keys, total


def frequencies(blocks: DataFrame) -> DataFrame:
    """(term, df): in how many documents each term of the blocks stands; each task adds up its own blocks first."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for batch in batches:
            for keys, starts, doc in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                keys = unpack(keys, np.uint64)
                terms.append(keys)
                counts.append(np.diff(np.append(unpack(starts, np.int64), len(unpack(doc, np.int32)))))
                if sum(map(len, terms)) > HELD:
                    keys, total = _added(terms, counts)
                    terms, counts = [keys], [total]
        keys, total = _added(terms, counts)
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(total)], names=["term", "df"])

    some = blocks.select("terms", "starts", "doc").mapInArrow(count, "term long, df long")
    return some.groupBy("term").agg(F.sum("df").alias("df"))


def query_terms(items: DataFrame) -> DataFrame:
    """(row, id, term) of the distinct terms of each row of ``items`` (row, id, text)."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, "text"):
                found = words(*text_bytes(part.column(2)), ALNUM)
                pairs = np.unique(np.stack((found.row.astype(np.uint64), found.hash), 1), axis=0)
                take = pa.array(pairs[:, 0].astype(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(take), part.column(1).take(take), pa.array(np.ascontiguousarray(pairs[:, 1]).view(np.int64))],
                    names=["row", "id", "term"],
                )

    return items.mapInArrow(scan, "row long, id long, term long")


@dataclass
class Queries:
    """Queries of one set: rows and ids, and their terms with weights, each query's rarest first."""

    row: list[int]
    ids: list[int | None]
    terms: list[np.ndarray]
    weights: list[np.ndarray]


def _gathered(rows: pa.Table, documents: int) -> Queries:
    """Queries out of rows (row, id, term, df); terms of equal frequency stand in order of their hash."""
    row, term, df = (rows.column(c).to_numpy() for c in ("row", "term", "df"))
    ids = rows.column("id").to_pylist()
    order = np.lexsort((term, df, row))
    row, term, df = row[order], term[order].view(np.uint64), df[order]
    starts = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, np.int64)
    ends = np.append(starts[1:], len(row))
    known: dict[int, int] = {}
    w = np.array([known.setdefault(d, weight(documents, d)) for d in df.tolist()], np.int64)
    spans = list(zip(starts.tolist(), ends.tolist()))
    return Queries(
        row[starts].tolist(), [ids[order[a]] for a, _ in spans], [term[a:b] for a, b in spans], [w[a:b] for a, b in spans]
    )


class Best:
    """The ``k`` best documents of one query so far: highest score, then smallest id, a null id last."""

    def __init__(self, k: int):
        self.k = k
        self.score, self.id, self.no_id = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8)

    def floor(self) -> int:
        return int(self.score[-1]) if len(self.score) == self.k else 0

    def add(self, score: np.ndarray, ids: np.ndarray, no_id: np.ndarray) -> None:
        self.score, self.id, self.no_id = (
            np.concatenate(x) for x in ((self.score, score), (self.id, ids), (self.no_id, no_id))
        )
        order = np.lexsort((self.id, self.no_id, -self.score))[: self.k]
        self.score, self.id, self.no_id = self.score[order], self.id[order], self.no_id[order]


def impacts(tf: np.ndarray, size: np.ndarray) -> np.ndarray:
    return (IMPACT_SCALE * tf) // (1000 * tf + SATURATION * size)


def sizes(n: np.ndarray, documents: int, length: int) -> np.ndarray:
    """Relative lengths of documents of ``n`` terms in hundredths, the average being 100."""
    share = [(LENGTH_SHARE * x * documents) // max(length, 1) for x in n.tolist()]  # whole numbers of any size
    return 100 - LENGTH_SHARE + np.array(share, np.int64).reshape(len(n))


def accumulate(postings: list[tuple[np.ndarray, np.ndarray]], n: int, k: int, floor: int) -> np.ndarray:
    """Scores of ``n`` documents for one query, exact for every document that can be among the best ``k``.

    ``postings`` holds (documents, additions) of each term, rarest first; ``floor`` is the k-th best score known from
    elsewhere. A document that has no accumulator when making them ends stays at 0.
    """
    most = np.array([int(add.max()) if len(add) else 0 for _, add in postings] + [0], np.int64)
    left = np.cumsum(most[::-1])[::-1]
    score, held = np.zeros(n, np.int64), np.zeros(n, bool)
    peak, making = 0, True
    for j, (docs, add) in enumerate(postings):
        if making and left[j] < peak and floor <= left[j]:
            have = score[held]
            if len(have) >= k:
                floor = max(floor, int(np.partition(have, len(have) - k)[len(have) - k]))
        making = making and left[j] >= floor
        if not making:
            on = held[docs]
            docs, add = docs[on], add[on]
        else:
            held[docs] = True
        score[docs] += add
        if len(docs):
            peak = max(peak, int(score[docs].max()))
    return score


def _search(blocks: DataFrame, queries: Queries, documents: int, length: int, k: int) -> DataFrame:
    """(row, id, doc_id, score) of each task's best documents of each query."""
    sent = blocks.sparkSession.sparkContext.broadcast(queries)
    kinds = (np.int64, np.uint8, np.int64, np.uint64, np.int64, np.int32, np.int32)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = sent.value
        best = [Best(k) for _ in asked.row]
        for batch in batches:
            for body in zip(*(batch.column(j).to_pylist() for j in range(len(kinds))), strict=True):
                ids, no_id, n, terms, starts, doc, tf = (unpack(b, kind) for b, kind in zip(body, kinds, strict=True))
                if len(terms) == 0:
                    continue
                ends = np.append(starts[1:], len(doc))
                impact = impacts(tf.astype(np.int64), sizes(n, documents, length)[doc])
                for q, own in enumerate(best):
                    at = np.searchsorted(terms, asked.terms[q])
                    here = terms[np.minimum(at, len(terms) - 1)] == asked.terms[q]
                    spans = [slice(a, b) for a, b in zip(starts[at[here]].tolist(), ends[at[here]].tolist())]
                    postings = [(doc[s], impact[s] * w) for s, w in zip(spans, asked.weights[q][here])]
                    floor = own.floor()
                    score = accumulate(postings, len(ids), k, floor)
                    up = np.flatnonzero(score >= max(floor, 1))
                    if len(up) > k:
                        least = np.partition(score[up], len(up) - k)[len(up) - k]
                        up = up[score[up] >= least]
                    if len(up):
                        own.add(score[up], ids[up], no_id[up])
        rows = [(q, own) for q, own in enumerate(best) if len(own.score)]
        for a in range(0, len(rows), 1 << 14):
            some = rows[a : a + (1 << 14)]
            many = [len(own.score) for _, own in some]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat([asked.row[q] for q, _ in some], many), pa.int64()),
                    pa.array([asked.ids[q] for (q, _), m in zip(some, many) for _ in range(m)], pa.int64()),
                    pa.array(np.concatenate([own.id for _, own in some]), mask=np.concatenate([own.no_id for _, own in some]) > 0),
                    pa.array(np.concatenate([own.score for _, own in some])),
                ],
                names=["row", "id", "doc_id", "score"],
            )

    return blocks.drop("documents", "length").mapInArrow(scan, "row long, id long, doc_id long, score long")


def ranked(
    docs: DataFrame, items: DataFrame, k: int = 10,
    ident: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents above score 0 of every item, rank from 1.

    Terms are runs of ASCII letters and digits and all other characters outside ASCII, A-Z lower-cased, told apart by 64-bit
    hashes. Every row of ``docs`` is a document of its own, with or without id; equal scores stand by id, null ids last.
    Rows of ``items`` equal in id and text are one query; other rows of one id, or of a null id, are queries of their
    own, so that such an id has each rank several times. Null and empty texts and texts without terms find nothing and are
    not found, nor do they count as documents. Empty tables give no rows; further columns are not looked at.

    Whole texts count. Memory: a block of BLOCK_BYTES of text or one document, and ``k`` documents for each query of a set.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(f"`{ident}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    items = items.select(F.col(f"`{item}`").cast("long").alias("id"), F.col(f"`{item_text}`").cast("string").alias("text"))
    items = items.distinct().select(F.monotonically_increasing_id().alias("row"), "id", "text")
    terms = written(query_terms(items), "query-terms")
    blocks = written(index(docs, presence(terms.select("term").distinct(), TABLE_BITS)), "postings")
    total = blocks.agg(F.sum("documents").alias("documents"), F.sum("length").alias("length")).first()
    documents, length = total.documents or 0, total.length or 0
    counted = written(terms.join(frequencies(blocks), "term"), "query-frequencies")

    sets = max(1, -(-counted.count() // QUERY_TERMS))
    found = spark.createDataFrame([], "row long, id long, doc_id long, score long")
    for part in range(sets):
        one = counted.where(F.pmod(F.xxhash64("row"), F.lit(sets)) == part)
        found = found.unionByName(_search(blocks, _gathered(one.toArrow(), documents), documents, length, k))
    order = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        F.col("id").alias("item_id"), "rank", "doc_id", "score"
    )
