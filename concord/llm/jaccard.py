"""N-gram Jaccard join: documents whose shingle sets are alike, linked through a token-group matrix.

1. Documents with the same shingle set become one node.
2. The tokens of each set are dealt by hash into so many parts that two similar sets must have one part in common
   (pigeonhole); each part is one signature. Unrelated sets share tokens but hardly ever a whole part, and parts that
   hold nothing but frequent tokens are the first that are left out.
3. Nodes that share a signature, directly or through others, form a group around a leader. Every member is written as
   what it lacks and what it adds to the leader's set; members similar to the leader are linked to it.
4. Token-group matrix: how many members hold each lacking or added token. The tokens that a member shares with the union
   of all others bound its overlap with any of them, so most members never open their group. The others are compared
   exactly: inside one task where the group is small, else they meet the members with which they share one of their
   rarest tokens.
5. Components of all links that hold.

No link is lost. With L the leader and d what sets a member apart from it, two members of which one is not similar to L
can only be similar if they share at least ``needed`` tokens of d, and two that are both similar to L are connected.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from concord.llm.components import least_reached, roots
from concord.llm.tables import give_back, hash_counts, pack, presence, present, shards, unpack, written
from concord.llm.words import SPACED, mix, parts, shingles, text_bytes, words

#: Bits of the table that tells which nodes' sets are needed for comparisons.
NEEDED_BITS = 1 << 26
#: Signatures that a task collects before it sends them off.
BLOCK_SIGNATURES = 1 << 19
#: Slots in which tokens are counted. Tokens that share one count together, which only changes what is left out.
COUNT_SLOTS = 1 << 22
#: Bits of a ref that is no small id, and those of a signature beside its shard; equal ones by chance only join groups.
REF_BITS, SIGN_BITS = 40, 48
#: Members and bytes of lacking and added tokens up to which a group is compared inside one task.
GROUP_MEMBERS, GROUP_BYTES = 1 << 12, 1 << 22


def _sets(batch: pa.RecordBatch, size: int) -> Iterator[np.ndarray]:
    data, offsets = text_bytes(batch.column(1))
    return shingles(words(data, offsets, SPACED), size)


def _node(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


class Levels:
    """How sets of each size are dealt into parts.

    Sizes form classes such that a set and a larger one similar to it are in the same or neighbouring classes. Sets of
    a class and of the next share a level. On a level at most ``differ`` tokens set two similar sets apart, so of
    ``differ + 1 + spare`` parts at least ``1 + spare`` agree. Each set leaves out its ``spare`` first parts in an order
    that looks at a part's content only; the last part that agrees is left out by neither.
    """

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.bounds = [1, 2]

    def of(self, n: int) -> Iterator[tuple[int, int, int]]:
        """(level, parts, spare) of the levels on which a set of ``n`` tokens stands."""
        while self.bounds[-1] <= n:
            self.bounds.append(max(self.bounds[-1] + 1, (self.bounds[-1] - 1) * self.den // self.num + 1))
        own = int(np.searchsorted(self.bounds, n, side="right")) - 1
        for level in (own - 1, own):
            if level >= 0:
                differ = (self.bounds[level + 1] - 1) * (self.den - self.num) // self.num
                spare = differ * 3 * (self.den - self.num) // (2 * self.den)
                if differ:  # else only equal sets are similar, and those are one node
                    yield level, differ + 1 + spare, spare


def _token_counts(docs: DataFrame, size: int) -> np.ndarray:
    """In how many documents about the tokens of each slot stand."""
    def tokens(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for part in parts(batch, "text"):
            yield np.concatenate([np.zeros(0, np.uint64), *_sets(part, size)])

    counts = hash_counts(docs, tokens, COUNT_SLOTS)
    return np.minimum(counts, np.iinfo(np.uint32).max).astype(np.uint32)


def _signatures(tokens: np.ndarray, levels: Levels, counts: np.ndarray) -> np.ndarray:
    """Signatures of a sorted token set on all its levels.

    Empty parts are left out first, then those whose rarest token is the most frequent, small ones before large ones: what
    many documents share, like a passage or a license line, ties hardly any of them together. ``counts`` sets nothing but
    this order, so it must be the same for all sets, but not exact.
    """
    out = []
    spread = mix(tokens)
    seen = counts[tokens & np.uint64(len(counts) - 1)].astype(np.int64)
    for level, count, spare in levels.of(len(tokens)):
        part = ((tokens >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)
        first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        total = np.add.reduceat(spread, first)
        held = np.diff(np.append(first, len(tokens)))
        missing = count - len(first)
        key = mix(total + mix(part[first] + np.uint64(level << 32)))
        if missing < spare:
            key = key[np.lexsort((key, held, -np.minimum.reduceat(seen, first)))[spare - missing :]]
        elif missing > spare:
            empty = np.setdiff1d(np.arange(count, dtype=np.uint64), part[first])
            empty = np.sort(mix(mix(empty + np.uint64(level << 32))))
            key = np.concatenate((key, empty[spare:]))
        out.append(key)
    return np.concatenate(out) if out else tokens[:0]


def _nodes(docs: DataFrame, size: int) -> DataFrame:
    """Rows (doc_id, n, node, ref): ``node`` stands for the set, ``ref`` is the id by which signatures name it."""
    ident = docs.schema[0].dataType
    is_long = ident.simpleString() == "bigint"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, "text"):
                sets = list(_sets(part, size))
                nodes = [_node(x) if len(x) else None for x in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array(nodes, pa.binary()),
                     pa.array(_refs(part.column(0), nodes, is_long), pa.int64())],
                    names=["doc_id", "n", "node", "ref"],
                )
            give_back()

    return docs.mapInArrow(scan, f"doc_id {ident.simpleString()}, n long, node binary, ref long")


def _refs(ids: pa.Array, nodes: list[bytes | None], is_long: bool) -> list[int | None]:
    """Short names of sets: a small id, or bits of the set's name where there is none. Two sets of one name both count."""
    own = ids.to_pylist() if is_long else [None] * len(nodes)
    return [
        i if i is not None and 0 <= i < 1 << REF_BITS else int.from_bytes(k[:8], "big") >> 64 - REF_BITS if k else None
        for i, k in zip(own, nodes, strict=True)
    ]


def _stars(sign: np.ndarray, ref: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct signatures with the smallest ref of each, and (ref, smallest) for all other refs."""
    order = np.lexsort((ref, sign))
    sign, ref = sign[order], ref[order]
    first = np.concatenate(([True], sign[1:] != sign[:-1])) if len(sign) else np.zeros(0, bool)
    least = ref[first][np.cumsum(first) - 1] if len(sign) else ref
    apart = ref != least
    return sign[first], ref[first], np.unique(np.stack((ref[apart], least[apart]), 1), axis=0)


def _neighbours(docs: DataFrame, size: int, levels: Levels, counts: np.ndarray) -> DataFrame:
    """Edges (a, b) of refs: all refs with one signature hang on the smallest, by way of the smallest of each block.

    A block sends each signature once, however many of its documents hold it, so the most frequent signature costs a
    shard one row for each block.
    """
    is_long = docs.schema[0].dataType.simpleString() == "bigint"
    total = shards(docs.sparkSession)
    frequent = docs.sparkSession.sparkContext.broadcast(counts)
    kind = "key int, sign binary, ref binary, a long, b long"
    names = ["key", "sign", "ref", "a", "b"]

    def edges(pairs: np.ndarray) -> pa.RecordBatch:
        n = len(pairs)
        return pa.RecordBatch.from_arrays(
            [pa.array(mix(pairs[:, 0].view(np.uint64)) % np.uint64(total), pa.int32()), pa.nulls(n, pa.binary()),
             pa.nulls(n, pa.binary()), pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=names,
        )

    def block(signs: list[np.ndarray], refs: list[int]) -> Iterator[pa.RecordBatch]:
        ref = np.repeat(np.array(refs, np.int64), [len(x) for x in signs])
        sign, least, pairs = _stars(np.concatenate(signs), ref)
        if len(pairs):
            yield edges(pairs)
        shard, sign = (sign >> np.uint64(40)) % np.uint64(total), sign & np.uint64((1 << SIGN_BITS) - 1)
        order = np.lexsort((sign, shard))
        sign, least, shard = sign[order], least[order], shard[order]
        cut = np.searchsorted(shard, np.arange(total + 1))
        at = [k for k in range(total) if cut[k] < cut[k + 1]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(at, pa.int32()), pa.array([pack(sign[cut[k] : cut[k + 1]]) for k in at], pa.binary()),
             pa.array([pack(least[cut[k] : cut[k + 1]]) for k in at], pa.binary()), pa.nulls(len(at), pa.int64()),
             pa.nulls(len(at), pa.int64())], names=names,
        )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signs, refs, held = [], [], 0
        for batch in batches:
            for part in parts(batch, "text"):
                sets = list(_sets(part, size))
                nodes = [_node(x) if len(x) else None for x in sets]
                for tokens, ref in zip(sets, _refs(part.column(0), nodes, is_long), strict=True):
                    own = _signatures(tokens, levels, frequent.value) if len(tokens) else tokens
                    if len(own):
                        signs.append(own)
                        refs.append(ref)
                        held += len(own)
                if held >= BLOCK_SIGNATURES:
                    yield from block(signs, refs)
                    signs, refs, held = [], [], 0
                    give_back()
        if signs:
            yield from block(signs, refs)
        give_back()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, signs, refs = None, [], []

        def flush() -> Iterator[pa.RecordBatch]:
            if signs:
                pairs = _stars(np.concatenate(signs), np.concatenate(refs))[2]
                if len(pairs):
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        for batch in batches:
            local = batch.filter(pa.compute.is_valid(batch.column("a")))
            if local.num_rows:
                yield local.select(["a", "b"])
            for row in range(batch.num_rows):
                if not batch.column("sign")[row].is_valid:
                    continue
                if (own := batch.column("key")[row].as_py()) != key:
                    yield from flush()
                    key, signs, refs = own, [], []
                signs.append(unpack(batch.column("sign")[row].as_py(), np.uint64))
                refs.append(unpack(batch.column("ref")[row].as_py(), np.int64))
        yield from flush()
        give_back()

    sent = docs.mapInArrow(scan, kind).repartition("key").sortWithinPartitions("key")
    return sent.mapInArrow(meet, "a long, b long").distinct()


def _sets_of(docs: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """Rows (node, tokens) for the given nodes and perhaps some more, each once; tokens are sorted 64-bit numbers."""
    first8 = F.conv(F.hex(F.substring("node", 1, 8)), 16, -10).cast("long")
    needed = docs.sparkSession.sparkContext.broadcast(presence(nodes.select(first8.alias("h")), NEEDED_BITS))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = needed.value
        for batch in batches:
            seen: set[bytes] = set()
            for part in parts(batch, "text"):
                sets = [(x, _node(x)) for x in _sets(part, size) if len(x)]
                if not sets:
                    continue
                heads = np.array([int.from_bytes(k[:8], "big") for _, k in sets], np.uint64)
                out = []
                for (tokens, node), hit in zip(sets, present(table, heads), strict=True):
                    if hit and node not in seen:
                        seen.add(node)
                        out.append((node, tokens.tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[i] for x in out], pa.binary()) for i in (0, 1)], names=["node", "tokens"]
                )
            give_back()

    # Copies of one set that several tasks found are one row after this.
    return docs.mapInArrow(scan, "node binary, tokens binary").groupBy("node").agg(F.first("tokens").alias("tokens"))


def _deltas(members: DataFrame, num: int, den: int) -> DataFrame:
    """Rows (g, rep, n, nl, lacks, adds, held) from (g, rep, tokens, own, leader tokens); held: similar to the leader."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x, y in zip(batch.column("tokens"), batch.column("ltokens"), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                lacks, adds = np.setdiff1d(y, x, assume_unique=True), np.setdiff1d(x, y, assume_unique=True)
                common = len(x) - len(adds)
                out.append((len(x), len(y), lacks.tobytes(), adds.tobytes(), den * common >= num * (len(y) + len(adds))))
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.bool_()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("g"), batch.column("rep"), *[pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)]],
                names=["g", "rep", "n", "nl", "lacks", "adds", "held"],
            )
            give_back()

    return members.select("g", "rep", "tokens", "ltokens").mapInArrow(
        scan, "g binary, rep binary, n long, nl long, lacks binary, adds binary, held boolean"
    )


def _delta_tokens(deltas: DataFrame) -> DataFrame:
    """One row (token, g, rep) per lacking or added token; the two kinds never have a token in common in a group."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                tokens = [
                    np.concatenate((np.frombuffer(x.as_py(), np.int64), np.frombuffer(y.as_py(), np.int64)))
                    for x, y in zip(part.column("lacks"), part.column("adds"), strict=True)
                ]
                take = pa.array(np.repeat(np.arange(len(tokens)), [len(x) for x in tokens]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(tokens)), part.column("g").take(take), part.column("rep").take(take)],
                    names=["token", "g", "rep"],
                )

    return deltas.select("g", "rep", "lacks", "adds").mapInArrow(scan, "token long, g binary, rep binary")


def _hold(pairs: DataFrame, deltas: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of one group that reach the threshold, exactly, from what sets both apart from the leader."""
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for k in range(batch.num_rows):
                na, nb, nl, *told = (batch.column(c)[k].as_py() for c in ("na", "nb", "nl", "la", "lb", "aa", "ab"))
                la, lb, aa, ab = (np.frombuffer(x, np.uint64) for x in told)
                lack = len(np.union1d(la, lb))
                common = nl - lack + len(np.intersect1d(aa, ab, assume_unique=True))
                keep.append(den * common >= num * (na + nb - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def side(s: str) -> DataFrame:
        return deltas.select(
            "g", F.col("rep").alias(s), F.col("n").alias(f"n{s}"), F.col("lacks").alias(f"l{s}"), F.col("adds").alias(f"a{s}"),
            *(["nl"] if s == "a" else []),
        )

    full = pairs.join(side("a"), ["g", "a"]).join(side("b"), ["g", "b"])
    return full.select("a", "b", "na", "nb", "nl", "la", "lb", "aa", "ab").mapInArrow(compare, "a binary, b binary")


def _near(rows: list[tuple], num: int, den: int) -> list[tuple[bytes, bytes]]:
    """Links (a, b) that connect all members of one group which are similar and not both similar to the leader.

    ``rows`` are (rep, n, nl, lacks, adds, held). Two members have ``nl`` tokens in common, without those that either
    lacks, and with those lacking or added that they share.
    """
    n, lacks, held = (np.array([r[i] if i != 3 else len(r[i]) // 8 for r in rows]) for i in (1, 3, 5))
    own = [np.frombuffer(r[3] + r[4], np.uint64) for r in rows]
    # The matrix: members by token. Tokens that one member has alone are in no other's reach.
    _, column, members = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
    member = np.repeat(np.arange(len(rows)), [len(x) for x in own])
    kept = members[column] > 1
    column, member = column[kept], member[kept]
    order = np.argsort(column, kind="stable")
    holders, first = member[order], np.searchsorted(column[order], np.arange(len(members) + 1))
    cut = np.searchsorted(member, np.arange(len(rows) + 1))
    a, b = [], []
    for i in np.flatnonzero(~held):
        mine = column[cut[i] : cut[i + 1]]
        # bound: of what it has in common with any other, no more than these tokens are not the leader's
        if (num + den) * (rows[i][2] - lacks[i] + len(mine)) < num * (n[i] + n[i] * num // den):
            continue
        count = first[mine + 1] - first[mine]
        at = np.repeat(first[mine] - np.cumsum(count) + count, count) + np.arange(count.sum())
        common = rows[i][2] - lacks[i] - lacks + np.bincount(holders[at], minlength=len(rows))
        hit = np.flatnonzero(den * common >= num * (n[i] + n - common))
        hit = hit[hit != i]
        a.append(np.full(len(hit), i))
        b.append(hit)
    if not a:
        return []
    root = least_reached(np.concatenate(a), np.concatenate(b), len(rows))
    return [(rows[i][0], rows[k][0]) for i, k in enumerate(root.tolist()) if i != k]


def _near_links(deltas: DataFrame, num: int, den: int) -> DataFrame:
    """The links (a, b) of :func:`_near` in each of some groups, which are small."""
    columns = ["rep", "n", "nl", "lacks", "adds", "held"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows = None, []

        def links() -> pa.RecordBatch:
            found = _near(rows, num, den) if len(rows) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.binary()) for i in (0, 1)], names=["a", "b"])

        for batch in batches:
            g, values = batch.column("g"), [batch.column(c) for c in columns]
            for k in range(batch.num_rows):
                if (own := g[k].as_py()) != group:
                    if rows:
                        yield links()
                    group, rows = own, []
                rows.append(tuple(v[k].as_py() for v in values))
        if rows:
            yield links()
        give_back()

    return deltas.select("g", *columns).repartition("g").sortWithinPartitions("g").mapInArrow(scan, "a binary, b binary")


def _opened(deltas: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (g, a, b) to compare: members that may be similar although not both are similar to the leader."""
    lacks, adds = F.length("lacks") / 8, F.length("adds") / 8
    # What two members must share of what sets them apart from the leader, at least. One outside the leader's reach
    # and one inside: by each one's own distance; two outside: both are as far as the reach, which makes it more.
    share = num / (num + den)
    far = F.greatest(F.lit(1), F.ceil(share * (F.col("n") + F.col("nl")) - F.col("nl") + lacks - 1e-6))
    near = F.floor((1 - share) * lacks + share * adds - 1e-6) + 1
    both_far = F.greatest(F.lit(1), F.floor(share * (F.col("n") - F.col("nl")) + lacks - 1e-6) + 1)

    def role(mixed: bool, needed: Column) -> Column:
        return F.struct(F.lit(mixed).alias("mixed"), needed.cast("long").alias("needed"))

    part = deltas.where("length(lacks) + length(adds) > 0").select(
        "g", "rep", "n", "held", "lacks", "adds",
        F.when(F.col("held"), F.array(role(True, near))).otherwise(F.array(role(True, far), role(False, both_far))).alias("roles"),
    )
    tokens = _delta_tokens(part)
    # The matrix: members by group and token. Tokens that one member has alone are in no other's reach.
    matrix = tokens.groupBy("g", "token").agg(F.count("*").alias("members")).where("members > 1")
    rank = Window.partitionBy("g", "rep").orderBy("members", "token")
    shared = tokens.join(matrix, ["g", "token"]).withColumn("k", F.row_number().over(rank)).withColumn(
        "among", F.count("*").over(Window.partitionBy("g", "rep"))
    )
    kept = (
        shared.join(part.select("g", "rep", "n", "held", F.inline("roles")), ["g", "rep"])
        # bound: no more than `among` tokens can be shared; rank: all but `needed - 1` of the tokens, rarest first
        .where("among >= needed and k <= among - needed + 1").select("mixed", "g", "token", "rep", "n", "held")
    )
    kept = written(kept, "kept")
    a = kept.select("mixed", "g", "token", F.col("rep").alias("a"), F.col("n").alias("na"), F.col("held").alias("ha"))
    b = kept.select("mixed", "g", "token", F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("held").alias("hb"))
    fits = (F.least("na", "nb") * den) >= (F.greatest("na", "nb") * num)
    roles = F.when(F.col("mixed"), F.col("ha") != F.col("hb")).otherwise(True)
    return a.join(b, ["mixed", "g", "token"]).where((F.col("a") < F.col("b")) & roles & fits).select("g", "a", "b").distinct()


def _links(docs: DataFrame, nodes: DataFrame, size: int, num: int, den: int, levels: Levels) -> DataFrame:
    """(node, root) of all classes of equal sets that are linked with another one."""
    named = nodes.where("node is not null").select("ref", F.col("node").alias("rep")).distinct()
    edges = written(_neighbours(docs, size, levels, _token_counts(docs, size)), "neighbours")
    edges = edges.join(named.select(F.col("ref").alias("a"), F.col("rep").alias("x")), "a")
    edges = edges.join(named.select(F.col("ref").alias("b"), F.col("rep").alias("y")), "b")
    edges = written(edges.where("x != y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "edges")
    group = written(roots(edges), "groups").select(F.col("node").alias("rep"), F.col("root").alias("g"))
    # The leader is the member on which most others hang.
    leads = edges.groupBy(F.least("a", "b").alias("rep")).count().join(group, "rep")
    leads = leads.groupBy("g").agg(F.max_by("rep", F.struct("count", "rep")).alias("leader"))
    wanted = group.withColumnRenamed("rep", "node")
    found = _sets_of(docs, wanted.select("node"), size).join(wanted, "node").select(F.col("node").alias("rep"), "g", "tokens")
    found = written(found, "sets")
    lead = found.join(leads, (found.g == leads.g) & (found.rep == leads.leader)).select(
        leads.g, "leader", F.col("tokens").alias("ltokens")
    )
    deltas = written(_deltas(found.join(lead, "g"), num, den), "deltas")
    direct = deltas.where("held").join(leads, "g").select(F.col("rep").alias("a"), F.col("leader").alias("b"))
    size = F.sum(F.length("lacks") + F.length("adds")).alias("bytes")
    busy = deltas.groupBy("g").agg(F.count("*").alias("members"), size, F.bool_and("held").alias("done")).where("not done")
    small = f"members <= {GROUP_MEMBERS} and bytes <= {GROUP_BYTES}"
    near = _near_links(deltas.join(busy.where(small), "g", "left_semi"), num, den)
    large = written(deltas.join(busy.where(f"not ({small})"), "g", "left_semi"), "large")
    more = near if large.isEmpty() else near.union(_hold(_opened(large, num, den), large, num, den))
    return roots(direct.where("a != b").union(more))


def jaccard_groups(
    docs: DataFrame, size: int = 3, num: int = 90, den: int = 100, ident: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row (doc_id, n_shingles, component_id, node) per row of ``docs``.

    Words are runs of anything but white space, A-Z lower-cased; a document's set holds its distinct shingles of ``size``
    words, or the whole sequence where there are fewer. Two documents link when the Jaccard similarity of their sets is
    at least ``num / den``; ``component_id`` is the smallest id that links reach, the own one included. ``node`` is equal
    for equal sets.

    Null and empty texts and texts without words have no set (0 shingles, null node) and link with nothing. Rows with
    equal sets link, repeated rows and rows with a null id among them; a null id is the smallest only if no other is
    there. An empty table gives no rows. Further columns are not looked at.
    """
    docs = docs.select(F.col(f"`{ident}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    levels = Levels(num, den)
    nodes = written(_nodes(docs, size), "nodes")
    sets = nodes.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
    found = written(_links(docs, nodes, size, num, den, levels), "roots")
    sets = sets.join(found, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    least = sets.groupBy("root").agg(F.min("least").alias("component"))
    owner = sets.join(least, "root").select("node", "component")
    return nodes.join(owner, "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id"), "node",
    )
