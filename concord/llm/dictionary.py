"""Work done once per distinct piece of text, joined back to the documents that hold it.

Documents are cut into pieces within blocks of bounded size. A block sends each distinct piece once, to the shard of
that piece; the shard works it out once however many blocks ask, and answers each block. Documents travel beside as
numbers of their block's pieces. So the most frequent piece costs its shard one row for each block.

Documents either ride along with the pieces or, where that moves too much, are cut a second time and meet the answers
only. Both cuts must see the same rows in the same order, as scans of files do; a block whose pieces differ stops the job.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from concord.llm.tables import pack, shards, unpack

#: Characters of text in a block, unless one document has more.
BLOCK_CHARS = 1 << 24
_KIND = "key long, kind int, shard int, block long, doc_id long, extra long, body binary"
_NAMES = ["key", "kind", "shard", "block", "doc_id", "extra", "body"]
_TYPES = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], t) for i, t in enumerate(_TYPES)], names=_NAMES
    )


def _strings(pieces: list[str]) -> bytes:
    bodies = [p.encode("utf-8", "surrogatepass") for p in pieces]
    lengths = pack(np.array([len(b) for b in bodies], np.uint32))
    return len(lengths).to_bytes(4, "big") + lengths + zstandard.ZstdCompressor(level=3).compress(b"".join(bodies))


def _pieces(body: bytes) -> list[str]:
    n = int.from_bytes(body[:4], "big")
    ends = np.cumsum(unpack(body[4 : 4 + n], np.uint32)).tolist()
    text = zstandard.ZstdDecompressor().decompress(body[4 + n :])
    return [text[a:b].decode("utf-8", "surrogatepass") for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def by_distinct_piece(
    docs: DataFrame,
    cut: Callable[[str], list[str]],
    solve: Callable[[list[str]], list[list[int]]],
    finish: Callable[[np.ndarray, np.ndarray, np.ndarray], object],
    frequencies: bool,
    result: pa.DataType,
    result_sql: str,
    cut_again: bool = False,
) -> DataFrame:
    """(doc_id, n_bytes, result) for rows (doc_id, text).

    ``cut`` gives a text's pieces, ``solve`` the numbers of each of some distinct pieces, and ``finish`` the result of a
    document from the offsets and values of its block's numbers and from its own piece numbers, in order or, with
    ``frequencies``, as distinct numbers followed by their counts. ``cut_again``: documents do not ride along.
    """
    total = shards(docs.sparkSession)

    def block(
        number: int, vocabulary: dict[str, int], held: list[tuple], asking: bool, telling: bool
    ) -> Iterator[pa.RecordBatch]:
        pieces = list(vocabulary)
        shard = np.fromiter((zlib.crc32(p.encode("utf-8", "surrogatepass")) % total for p in pieces), np.int64, len(pieces))
        order = np.argsort(shard, kind="stable")
        renamed = np.empty(len(order), np.uint32)
        renamed[order] = np.arange(len(order), dtype=np.uint32)
        cuts = np.searchsorted(shard[order], np.arange(total + 1)).tolist()
        mark = zlib.crc32(order.tobytes())
        ask = [] if not asking else [
            (k, 0, k, number, None, mark, _strings([pieces[i] for i in order[cuts[k] : cuts[k + 1]]]))
            for k in range(total) if cuts[k] < cuts[k + 1]
        ]
        if ask and asking:
            yield _rows(ask)
        if not telling:
            return
        yield _rows([(number if cut_again else -1 - number, 1, -1, number, None, mark, None)])
        for at in range(0, len(held), 500):
            out = []
            for ordinal, (doc_id, extra, ids) in enumerate(held[at : at + 500]):
                ids = renamed[ids]
                if frequencies:
                    ids = np.concatenate(np.unique(ids, return_counts=True)).astype(np.uint32)
                out.append((number if cut_again else -1 - number - ordinal, 1, 0, number, doc_id, extra, pack(ids)))
            yield _rows(out)

    def scan(asking: bool, telling: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            number = TaskContext.get().partitionId() << 32
            vocabulary: dict[str, int] = {}
            held, chars, any_ = [], 0, False
            for batch in batches:
                for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                    text = text.as_py() or ""
                    pieces = cut(text)
                    if telling:
                        ids = [vocabulary.setdefault(p, len(vocabulary)) for p in pieces]
                        held.append((doc_id.as_py(), len(text.encode("utf-8", "surrogatepass")), np.array(ids, np.uint32)))
                    else:
                        vocabulary.update(dict.fromkeys(pieces))
                    chars, any_ = chars + len(text), True
                    if chars >= BLOCK_CHARS:
                        yield from block(number, vocabulary, held, asking, telling)
                        number, vocabulary, held, chars, any_ = number + 1, {}, [], 0, False
            if any_:
                yield from block(number, vocabulary, held, asking, telling)

        return run

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, asked = None, []

        def flush() -> Iterator[pa.RecordBatch]:
            known: dict[str, int] = {}
            wanted = [(b, mark, [known.setdefault(p, len(known)) for p in _pieces(body)]) for b, mark, body in asked]
            solved = solve(list(known))
            for b, mark, ids in wanted:
                counts = np.array([len(solved[i]) for i in ids], np.uint32)
                flat = np.fromiter((x for i in ids for x in solved[i]), np.uint32, int(counts.sum()))
                lengths = pack(counts)
                yield _rows([(b, 0, key, b, None, mark, len(lengths).to_bytes(4, "big") + lengths + pack(flat))])

        for batch in batches:
            kinds = batch.column("kind")
            texts = batch.filter(pa.compute.equal(kinds, 1))
            if texts.num_rows:
                yield texts.set_column(0, "key", texts.column("block"))
            for row in batch.filter(pa.compute.equal(kinds, 0)).select(["key", "block", "extra", "body"]).to_pylist():
                if row["key"] != key:
                    if asked:
                        yield from flush()
                    key, asked = row["key"], []
                asked.append((row["block"], row["extra"], row["body"]))
        if asked:
            yield from flush()

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, counts, flats, table, marks = None, [], [], None, set()
        for batch in batches:
            out = []
            for at in range(0, batch.num_rows, 256):
                for row in batch.slice(at, 256).to_pylist():
                    if row["block"] != now:
                        now, counts, flats, table, marks = row["block"], [], [], None, set()
                    if row["kind"] == 0 or row["shard"] < 0:
                        marks.add(row["extra"])
                        if len(marks) > 1:
                            raise RuntimeError("the documents were not read in the same order twice")
                    if row["shard"] < 0 and row["kind"] == 1:
                        continue
                    if row["kind"] == 0:
                        n = int.from_bytes(row["body"][:4], "big")
                        counts.append(unpack(row["body"][4 : 4 + n], np.uint32))
                        flats.append(unpack(row["body"][4 + n :], np.uint32))
                        continue
                    if table is None:
                        ends = np.cumsum(np.concatenate(counts, dtype=np.int64)) if counts else np.zeros(0, np.int64)
                        table = np.concatenate(([0], ends)), np.concatenate(flats) if flats else np.zeros(0, np.uint32)
                    out.append((row["doc_id"], row["extra"], finish(*table, unpack(row["body"], np.uint32))))
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int64(), result))],
                        names=["doc_id", "n_bytes", "result"],
                    )
                    out = []

    sent = docs.mapInArrow(scan(True, not cut_again), _KIND).repartition("key").sortWithinPartitions("key", "kind")
    back = sent.mapInArrow(answer, _KIND)
    if cut_again:
        # Documents first: blocks are numbered by task, and a union numbers the tasks of its first part as they were.
        back = docs.mapInArrow(scan(False, True), _KIND).union(back)
    back = back.repartition("key").sortWithinPartitions("key", "kind", "shard")
    return back.mapInArrow(join, f"doc_id long, n_bytes long, result {result_sql}")
