"""I-Match fingerprints: hashes of a document's sorted distinct terms within several random parts of the lexicon.

The lexicon keeps terms within a band of inverse document frequency. Document frequencies are counted over all rows in a
table of fixed size, where terms that share a slot count together; its noise is the same share of the documents at any size.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.llm.tables import hash_counts
from concord.llm.words import ALNUM, mix, parts, text_bytes, words

#: Slots of the document frequency table.
SLOTS = 1 << 20
#: Terms in at least and at most these shares of all documents are kept.
LOW, HIGH = 0.0005, 0.25
#: Lexicon parts of each rate: a part keeps each term with the probability 1 / rate.
RATES, EACH = (1, 4, 16, 32, 64, 128, 256, 512), 12
#: Terms that are drawn together.
BLOCK_TERMS = 1 << 14
SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, "
    "near_next double"
)


def _distinct_terms(column: pa.Array) -> Iterator[np.ndarray]:
    found = words(*text_bytes(column), ALNUM)
    at = 0
    for n in found.counts.tolist():
        yield np.unique(found.hash[at : at + n])
        at += n


def lexicon(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Which slots of the term table lie within the band, by the document frequencies of all rows."""
    rows = docs.select(F.col(f"`{text}`").cast("string").alias("text"))

    def hashes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for part in parts(batch, "text"):
            found = list(_distinct_terms(part.column(0)))
            if found:
                yield np.concatenate(found)

    counts = hash_counts(rows, hashes, SLOTS)
    total = max(1, rows.count())
    return (counts >= max(1, LOW * total)) & (counts <= max(2, HIGH * total))


@functools.cache
def _seeds() -> np.ndarray:
    return mix(np.arange(1, EACH + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def hashes(docs: list[np.ndarray], band: np.ndarray) -> np.ndarray:
    """A 16-bit hash for each document, by its distinct terms, and lexicon part; -1 where it has no term in a part.

    Each of the EACH draws gives a term one lot, and a part of a higher rate keeps the lowest lots of a part of a lower
    one. So a term is drawn EACH times, and the parts of one rate stay independent of each other.
    """
    found = np.full((len(RATES), EACH * len(docs)), -1, np.int32)
    terms = np.concatenate([*docs, np.zeros(0, np.uint64)])
    inside = np.flatnonzero(band[terms & np.uint64(SLOTS - 1)])
    kept, doc = terms[inside], np.repeat(np.arange(len(docs)), [len(x) for x in docs])[inside]
    lots = mix(kept[None, :] ^ _seeds()[:, None]).ravel()
    part = (doc[None, :] + np.arange(EACH)[:, None] * len(docs)).ravel()
    # The terms are sorted and distinct, so equal parts hold equal sequences; a sum tells them apart as well as a hash of
    # the sequence, and needs no loop.
    values = mix(lots)
    for rate, own in zip(RATES, found, strict=True):
        inside = np.flatnonzero(lots <= np.uint64((1 << 64) // rate - 1))
        if not len(inside):
            break
        lots, values, part = lots[inside], values[inside], part[inside]
        first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        own[part[first]] = mix(np.add.reduceat(values, first)) >> np.uint64(48)
    return found.reshape(len(RATES), EACH, len(docs)).transpose(2, 0, 1).reshape(len(docs), len(RATES) * EACH)


def _all_hashes(column: pa.Array, band: np.ndarray) -> Iterator[np.ndarray]:
    """Hashes of each text, worked out for some documents at a time."""
    some, held = [], 0
    for terms in _distinct_terms(column):
        some.append(terms)
        held += len(terms)
        if held >= BLOCK_TERMS:
            yield from hashes(some, band)
            some, held = [], 0
    yield from hashes(some, band)


def fingerprint(found: np.ndarray) -> str:
    """Four hex digits for each lexicon part; dashes where the document has no term in a part."""
    return "".join(f"{h:04x}" if h >= 0 else "----" for h in found.tolist())


def likeness(a: np.ndarray, b: np.ndarray, equal: bool) -> float:
    """The best rate's share of equal hashes among parts in which either has terms, one more counted; 1 for equal texts.

    The rate at which documents of this length have a term or two in a part tells most, and one rate suits each length.
    """
    if equal:
        return 1.0
    told = ((a >= 0) | (b >= 0)).reshape(len(RATES), EACH)
    alike = told & (a == b).reshape(len(RATES), EACH)
    return float((alike.sum(1) / (told.sum(1) + 1)).max())


def _below(cuts: list[int], value: Column) -> Column:
    """How many of the sorted cuts are smaller than the value: first among every so many, then in the stretch that follows."""
    step = max(1, math.isqrt(len(cuts)))
    stretches = [cuts[k : k + step] for k in range(0, len(cuts), step)]

    def longs(some: list[int]) -> Column:
        return F.array(*[F.lit(c).cast("long") for c in some]).cast("array<bigint>")

    before = F.size(F.filter(longs([x[0] for x in stretches]), lambda c: c < value)) - 1
    within = F.filter(F.get(F.array(longs([]), *[longs(x) for x in stretches]), before + 1), lambda c: c < value)
    return F.greatest(before, F.lit(0)) * step + F.size(within)


def with_next(docs: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], kind: str) -> DataFrame:
    """``work`` over (doc_id, text, next) in descending order of id, the first following the last; rows of one id in order of text, null ids last.

    Rows are dealt by ranges of ids and sorted there; the first row of each range goes to the range before it as well.
    So texts are shuffled once, and no task holds more than its range.
    """
    spark = docs.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select("doc_id")
    asked = ", ".join(str((k + 1) / ranges) for k in range(ranges - 1)) or "0.5"
    cuts = sorted(set(ids.agg(F.expr(f"percentile_approx(doc_id, array({asked}), 10000)")).first()[0] or []))
    last = len(cuts) + 1  # null ids come after the smallest
    where = F.when(F.col("doc_id").isNull(), F.lit(last)).otherwise(F.lit(len(cuts)) - _below(cuts, F.col("doc_id")))
    tops = ids.select(where.alias("range"), "doc_id").groupBy("range").agg(F.max("doc_id").alias("top")).orderBy("range").collect()
    tops = [(r["range"], r["top"]) for r in tops]  # one row for each range
    own = docs.select("doc_id", "text", where.alias("range"), F.lit(False).alias("ghost"))
    moves = [(tops[i][0], tops[i][1], tops[i - 1][0]) for i in range(len(tops))]
    moved = spark.createDataFrame(moves, "range int, top long, to int") if moves else None
    if moved is None:
        return docs.select("doc_id", "text", F.col("text").alias("next")).mapInArrow(work, kind)
    ghosts = docs.select("doc_id", "text", where.alias("range")).join(F.broadcast(moved), "range").where(
        F.col("doc_id").eqNullSafe(F.col("top"))
    ).select("doc_id", "text", F.col("to").alias("range"), F.lit(True).alias("ghost"))
    dealt = own.union(ghosts).repartition("range").sortWithinPartitions(
        "range", "ghost", F.col("doc_id").desc_nulls_last(), "text"
    )

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, done = None, None  # the row that waits for its next one; the range whose next row came

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string()))],
                names=["doc_id", "text", "next"],
            )

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = []
                for row in batch.slice(at, 256).to_pylist():
                    if row["ghost"] and done == row["range"]:
                        continue
                    if held is not None:
                        rows.append((held["doc_id"], held["text"], row["text"]))
                        held = None
                    if row["ghost"]:
                        done = row["range"]
                    else:
                        held = row
                if rows:
                    yield out(rows)

    return dealt.mapInArrow(lambda batches: work(pair(batches)), kind)


def edited(text: str, after: str) -> str:
    """The text with its last third replaced by as much of the beginning of the next."""
    n = len(text) // 3
    return text[: len(text) - n] + after[:n]


def fingerprints(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: fingerprints of the text and of its edited text, and how alike they and the next document's are.

    Null counts as empty. Equal texts have equal fingerprints. Documents without a term of the band have a fingerprint of
    dashes, which is like another text's only if the texts are equal. A single row is its own next one. Rows with null
    or repeated ids are kept; an empty table gives no rows; further columns are not looked at.
    """
    rows = docs.select(
        F.col(f"`{ident}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text")
    )
    band = docs.sparkSession.sparkContext.broadcast(lexicon(rows))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, "text"):
                texts, after = part.column(1).to_pylist(), part.column(2).to_pylist()
                new = [edited(t, x) for t, x in zip(texts, after, strict=True)]
                # Most texts are the next one of another row here, and copies need no second look.
                each = list(dict.fromkeys([*texts, *new, *after]))
                made = dict(zip(each, _all_hashes(pa.array(each, pa.large_string()), band.value), strict=True))
                digests = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in new]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(digests, pa.string()),
                     *[pa.array([fingerprint(made[t]) for t in x], pa.string()) for x in (texts, new)],
                     *[pa.array([likeness(made[t], made[u], t == u) for t, u in zip(texts, x, strict=True)], pa.float64())
                       for x in (new, after)]],
                    names=[f.split(" ", 1)[0] for f in SCHEMA.split(", ")],
                )

    return with_next(rows, scan, SCHEMA)
