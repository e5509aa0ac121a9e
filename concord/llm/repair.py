"""Conversation structure repair: the cheapest edits that bring the turns of a conversation into order.

A conversation in order has roles whose initials read ``(s?(ua)+)?``. Rows are kept, given another role or deleted, and
empty turns inserted; what is cheapest is found as the least path of an acyclic graph with whole numbers as weights. A
weight holds the cost in its high digits. Below stand the letters of the edits, one digit each in order, filled up with
zeros to a fixed width, so of equal costs the number of the ASCII-least letters is the smaller one, and a plain
minimum decides everything.

1. Rows are dealt by ranges of (conversation, turn) and sorted; each run of a conversation in a task is cut into pieces
   of at most PIECE rows, so that a conversation of any size spreads over tasks.
2. A conversation that lies whole in one piece is repaired there.
3. For the others, a piece has one least weight for each state before and after it. Rows seen in an earlier piece are found
   by their digests. The pieces of a conversation, by now one narrow row each, are gone through backwards to tell which state
   to aim at from each state, then forwards to choose; the letters of a piece count only by their rank there.
   All letters of a piece end with a row's, hence none is the beginning of another and ranks decide as letters would.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.llm.tables import written

#: Rows and characters of a piece; one longer text is a piece of its own.
PIECE, PIECE_CHARS = 256, 1 << 20

# Fixed values of the task: costs of edits, digits of their letters in ASCII order, blanks, and ends of a whole sentence.
KEEP, REROLE, DELETE, INSERT, UNFINISHED = 0, 3, 4, 3, 3
DIGITS = {"D": 1, "I": 2, "K": 3, "R": 4}
BLANKS = " \t\n\v\f\r"
ENDS = (".", "!", "?")
BITS = 3

#: States: nothing yet, after s, after u, after a. What an initial leads to, and the role that leads on from each.
START, SYSTEM, USER, ASSISTANT = range(4)
STEPS = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
ONWARD = ("user", "user", "assistant", "user")
IN_ORDER = {"su", "ua", "au"}

FINE, BLANK, DUPLICATE, TRUNCATED = ".", "b", "d", "t"

PIECES = "conv_id long, part int, no long, edge boolean, turns array<long>, roles array<string>, texts array<string>"
SOLVED = (
    "conv_id long, part int, no long, edits string, roles array<string>, texts array<string>, cost long, blank long, "
    "duplicate long, truncated long, illegal long, lowest long, highest long, n_turns long"
)


_PLAIN = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string()}
_ARROW = _PLAIN | {f"array<{name}>": pa.list_(kind) for name, kind in _PLAIN.items()}


def _arrow(ddl: str) -> pa.Schema:
    return pa.schema([(name, _ARROW[kind]) for name, kind in (c.split(" ") for c in ddl.split(", "))])


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with nulls as one blank, except in ids and turns, and faults by a checksum of both.

    Of twenty remainders 0 drops the row, 1 empties its text, 2 takes its sentence ends, 3 repeats it, 4 makes it the user's.
    """
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    said = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"), F.pmod(F.crc32(name), F.lit(20)).alias("fault"),
    ).where("fault <> 0")
    text = F.when(F.col("fault") == 1, F.lit("")).when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", ""))
    copies = F.when(F.col("fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return said.select(
        "conv_id", "turn", F.when(F.col("fault") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        text.otherwise(F.col("text")).alias("text"), F.explode(copies).alias("copy"),
    ).drop("copy")


def faults(roles: Sequence[str], texts: Sequence[str], seen: Iterable[tuple[str, bytes]] = ()) -> str:
    """The first fault of each row; ``seen`` has roles and text digests of rows before these."""
    before, own, out = set(seen), set(), []
    for role, text in zip(roles, texts, strict=True):
        body = text.rstrip(BLANKS)
        again = (role, text) in own or bool(before) and (role, hashlib.sha256(text.encode()).digest()) in before
        own.add((role, text))
        out.append(BLANK if not body else DUPLICATE if again else FINE if body.endswith(ENDS) else TRUNCATED)
    return "".join(out)


@dataclass(frozen=True)
class Weights:
    """Weights of paths over ``rows`` rows: cost above ``bits`` bits of letters."""

    rows: int

    @property
    def bits(self) -> int:
        return BITS * (2 * self.rows + 1)

    def ahead(self, letters: str, cost: int, rest: int) -> int:
        """The weight of a path that makes edits ``letters`` at ``cost`` and goes on as one of weight ``rest``."""
        digits = 0
        for c in letters:
            digits = digits << BITS | DIGITS[c]
        low = rest & ((1 << self.bits) - 1)
        long = BITS * len(letters)
        return ((rest >> self.bits) + cost) << self.bits | digits << (self.bits - long) | low >> long

    def cost(self, weight: int) -> int:
        return weight >> self.bits

    def letters(self, weight: int) -> str:
        out, at = [], self.bits
        while at and (digit := weight >> (at := at - BITS) & ((1 << BITS) - 1)):
            out.append(" DIKR"[digit])
        return "".join(out)


def least(roles: Sequence[str], found: str, ends: Sequence[int | None]) -> list[int | None]:
    """From each state the least weight of edits over all rows, where ``ends`` has the weight of each state after them.

    At most one turn is inserted before a row: two in a row could go, or with a lone s be replaced by its deletion, which
    is cheaper.
    """
    w = Weights(len(roles))
    best = list(ends)
    for role, fault in zip(reversed(roles), reversed(found)):
        extra = UNFINISHED if fault == TRUNCATED else 0
        now: list[int | None] = []
        for state in range(4):
            paths = []
            for put, at, price in (("", state, 0), ("I", STEPS[state][ONWARD[state][0]], INSERT)):
                paths.append((put + "D", price + DELETE, at))
                if fault in (FINE, TRUNCATED):
                    paths.append((put + "R", price + REROLE + extra, STEPS[at][ONWARD[at][0]]))
                    if role[:1] in STEPS[at]:
                        paths.append((put + "K", price + KEEP + extra, STEPS[at][role[:1]]))
            now.append(min((w.ahead(c, price, best[to]) for c, price, to in paths if best[to] is not None), default=None))
        best = now
    return best


def closing(rows: int) -> list[int | None]:
    """Weight of the end after each state: a lone user turn gets an answer, a lone system turn is no conversation."""
    return [0, None, Weights(rows).ahead("I", INSERT, 0), 0]


def edited(state: int, letters: str, roles: Sequence[str], texts: Sequence[str]) -> tuple[list[str], list[str]]:
    """Roles and texts that the edits make of the rows, beginning at ``state``."""
    out_roles, out_texts, at = [], [], 0
    for c in letters:
        if c == "D":
            at += 1
            continue
        role, text = (ONWARD[state], "") if c == "I" else (roles[at] if c == "K" else ONWARD[state], texts[at])
        at += c != "I"
        out_roles.append(role)
        out_texts.append(text)
        state = STEPS[state][role[:1]]
    return out_roles, out_texts


def _counts(turns: Sequence[int | None], roles: Sequence[str], found: str) -> dict[str, int | None]:
    known = [t for t in turns if t is not None]
    pairs = [a[:1] + b[:1] for a, b in zip(roles, roles[1:])]
    return {
        "blank": found.count(BLANK), "duplicate": found.count(DUPLICATE), "truncated": found.count(TRUNCATED),
        "illegal": sum(p not in IN_ORDER for p in pairs), "lowest": min(known, default=None), "highest": max(known, default=None),
        "n_turns": len(set(known)),
    }


def _cut(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Pieces of sorted rows. Those of the task's first and last conversation, and of any in several pieces, are at an edge."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    kind = _arrow(PIECES)
    held: list[dict] = []  # pieces of the conversation at hand, of a long one the last only
    done: list[dict] = []
    no, chars, edge = 0, 0, True
    for batch in batches:
        for conv, turn, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            fresh = not held or held[-1]["conv_id"] != conv
            if fresh and held:
                done += [p | {"edge": edge or len(held) > 1} for p in held]
                held, edge = [], False
            elif len(held) > 1:
                done += [p | {"edge": True} for p in held[:-1]]
                held, edge = held[-1:], True
            if fresh or len(held[-1]["turns"]) >= size or chars + len(text) > PIECE_CHARS:
                held.append({"conv_id": conv, "part": part, "no": no, "turns": [], "roles": [], "texts": []})
                no, chars = no + 1, 0
            for name, value in (("turns", turn), ("roles", role), ("texts", text)):
                held[-1][name].append(value)
            chars += len(text)
            if sum(len(p["turns"]) for p in done) > 4 * PIECE:
                yield pa.RecordBatch.from_pylist(done, schema=kind)
                done = []
    yield pa.RecordBatch.from_pylist(done + [p | {"edge": True} for p in held], schema=kind)


def pieces(rows: DataFrame, size: int) -> DataFrame:
    """Pieces of at most ``size`` rows of the conversations in ``rows`` (conv_id, turn, role, text), each in order of (part, no)."""
    # Equal rows may be dealt to several tasks, whichever comes first.
    line = rows.withColumn("line", F.monotonically_increasing_id())
    dealt = line.repartitionByRange(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "text", "line").drop("line")
    ordered = dealt.sortWithinPartitions(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "text")
    return ordered.mapInArrow(lambda batches: _cut(batches, size), PIECES)


def _repair_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = _arrow(SOLVED)
    for batch in batches:
        out = []
        for p in batch.to_pylist():
            found = faults(p["roles"], p["texts"])
            best = least(p["roles"], found, closing(len(found)))[START]
            w = Weights(len(found))
            roles, texts = edited(START, w.letters(best), p["roles"], p["texts"])
            out.append({
                "conv_id": p["conv_id"], "part": p["part"], "no": p["no"], "edits": w.letters(best), "roles": roles, "texts": texts,
                "cost": w.cost(best), **_counts(p["turns"], p["roles"], found),
            })
        yield pa.RecordBatch.from_pylist(out, schema=kind)


#: What each of the 16 ways through a piece (state before, state after) costs, the rank of its letters, and the letters.
WAYS = (
    "conv_id long, part int, no long, costs array<long>, ranks array<int>, letters array<string>, first string, last string, "
    "blank long, duplicate long, truncated long, illegal long, lowest long, highest long, n_turns long"
)


def _ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = _arrow(WAYS)
    for batch in batches:
        out = []
        for p in batch.to_pylist():
            seen = [(s["role"], bytes.fromhex(s["digest"])) for s in p["seen"] or ()]
            found = faults(p["roles"], p["texts"], seen)
            w = Weights(len(found))
            through = [least(p["roles"], found, [0 if q == to else None for q in range(4)]) for to in range(4)]
            best = [through[to][q] for q in range(4) for to in range(4)]
            letters = [None if b is None else w.letters(b) for b in best]
            order = {x: k for k, x in enumerate(sorted({x for x in letters if x is not None}))}
            out.append({
                "conv_id": p["conv_id"], "part": p["part"], "no": p["no"], "letters": letters,
                "costs": [None if b is None else w.cost(b) for b in best], "ranks": [order.get(x) for x in letters],
                "first": p["roles"][0][:1], "last": p["roles"][-1][:1], **_counts(p["turns"], p["roles"], found),
            })
        yield pa.RecordBatch.from_pylist(out, schema=kind)


def _aims(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each piece, last first, the state to leave it in for each state before it."""
    kind = _arrow("part int, no long, aims array<int>, ending boolean")
    conv, ahead, started = None, [], False
    for batch in batches:
        out = []
        for p in batch.to_pylist():
            ending = not started or conv != p["conv_id"]
            if ending:  # (cost, rank of the letters) from each state on
                ahead = [(0, 0), None, (INSERT, 1), (0, 0)]
            conv, started = p["conv_id"], True
            aims, now = [], []
            for q in range(4):
                paths = [
                    (p["costs"][4 * q + to] + ahead[to][0], p["ranks"][4 * q + to], ahead[to][1], to)
                    for to in range(4) if p["costs"][4 * q + to] is not None and ahead[to] is not None
                ]
                best = min(paths, default=None)
                aims.append(best[3] if best else None)
                now.append(best[:3] if best else None)
            order = {x: k for k, x in enumerate(sorted({x[1:] for x in now if x}))}
            ahead = [(x[0], order[x[1:]]) if x else None for x in now]
            out.append({"part": p["part"], "no": p["no"], "aims": aims, "ending": ending})
        yield pa.RecordBatch.from_pylist(out, schema=kind)


def _chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state before each piece and its edits; pairs of rows and equal turns across pieces are settled here."""
    kind = _arrow("part int, no long, state int, edits string, cost long, illegal long, n_turns long")
    conv, state, last, highest, started = None, START, "", None, False
    for batch in batches:
        out = []
        for p in batch.to_pylist():
            if fresh := not started or conv != p["conv_id"]:
                state, highest = START, None
            conv, started = p["conv_id"], True
            to = p["aims"][state]
            way = 4 * state + to
            finish = p["ending"] and to == USER
            out.append({
                "part": p["part"], "no": p["no"], "state": state, "edits": p["letters"][way] + ("I" if finish else ""),
                "cost": p["costs"][way] + (INSERT if finish else 0),
                "illegal": p["illegal"] + (not fresh and last + p["first"] not in IN_ORDER),
                "n_turns": p["n_turns"] - (highest is not None and p["lowest"] == highest),
            })
            state, last = to, p["last"]
            highest = p["highest"] if p["highest"] is not None else highest
        yield pa.RecordBatch.from_pylist(out, schema=kind)


def _edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = _arrow(SOLVED)
    for batch in batches:
        out = []
        for p in batch.to_pylist():
            p["roles"], p["texts"] = edited(p.pop("state"), p["edits"], p["roles"], p["texts"])
            out.append(p)
        yield pa.RecordBatch.from_pylist(out, schema=kind)


def _seen(cut: DataFrame) -> DataFrame:
    """(part, no, seen) for pieces with rows whose role and text stand in an earlier piece of the conversation."""
    said = F.transform(F.arrays_zip("roles", "texts"), lambda x: F.struct(x["roles"].alias("role"), F.sha2(x["texts"], 256).alias("digest")))
    place = F.struct("part", "no").alias("place")
    listed = cut.select("conv_id", place, F.explode(F.array_distinct(said)).alias("said"))
    firsts = listed.groupBy("conv_id", "said").agg(F.min("place").alias("first"))
    a, b = listed.alias("a"), firsts.alias("b")
    again = a.join(b, F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("a.said") == F.col("b.said")))
    again = again.where("place <> first").groupBy("place").agg(F.collect_list("a.said").alias("seen"))
    return again.select("place.part", "place.no", "seen")


def _in_pieces(cut: DataFrame) -> DataFrame:
    """Repair of conversations that lie in several pieces."""
    keys = ["part", "no"]
    ways = written(cut.join(_seen(cut), keys, "left").mapInArrow(_ways, WAYS), "ways")
    narrow = ways.select("conv_id", *keys, "costs", "ranks").repartition("conv_id")
    backwards = narrow.sortWithinPartitions("conv_id", F.desc("part"), F.desc("no"))
    aims = backwards.mapInArrow(_aims, "part int, no long, aims array<int>, ending boolean")
    steps = ways.join(aims, keys).select(
        "conv_id", *keys, "aims", "ending", "costs", "letters", "first", "last", "illegal", "n_turns", "lowest", "highest")
    forwards = steps.repartition("conv_id").sortWithinPartitions("conv_id", *keys)
    chosen = forwards.mapInArrow(_chosen, "part int, no long, state int, edits string, cost long, illegal long, n_turns long")
    counts = ways.select(*keys, "blank", "duplicate", "truncated", "lowest", "highest")
    names = [c.split()[0] for c in SOLVED.split(", ")]
    return cut.drop("turns", "edge").join(chosen, keys).join(counts, keys).select(*names, "state").mapInArrow(_edit, SOLVED)


def repaired(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", size: int = PIECE,
) -> DataFrame:
    """Repaired conversations in pieces, to be read in order of (part, no): the columns of SOLVED, and ``alone`` where it is one piece.

    ``edits`` has the letters of Keep, Rerole, Delete and Insert, ``roles`` and ``texts`` the rows that they leave, ``cost``
    what they cost. A row's first fault counts in ``blank``, ``duplicate`` (role and text stood before) or ``truncated`` (no
    sentence end); ``illegal`` are neighbours out of order. ``lowest``, ``highest`` and ``n_turns`` add up to the gaps.

    Rows stand by turn, a null turn first, equal ones by role and text. Null roles and texts are one blank; rows of a null
    conversation are one conversation; repeated rows are duplicates. An empty table gives no rows; further columns
    are not looked at. A task holds one piece at a time; only narrow rows of a long conversation's pieces meet in one task.
    """
    said = rows.select(
        F.col(f"`{conv}`").cast("long").alias("conv_id"), F.col(f"`{turn}`").cast("long").alias("turn"),
        *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" ")).alias(n) for c, n in ((role, "role"), (text, "text"))],
    )
    cut = written(pieces(said, size), "conversation-pieces")
    whole = cut.where("not edge").mapInArrow(_repair_whole, SOLVED).withColumn("alone", F.lit(True))
    return whole.unionByName(_in_pieces(cut.where("edge")).withColumn("alone", F.lit(False)))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of each conversation's rows, piece by piece."""
    kind = _arrow("conv_id long, repaired_sha256 string")
    conv, digest, any_row = None, None, False
    for batch in batches:
        out = []
        for p in batch.to_pylist():
            if digest is None or conv != p["conv_id"]:
                if digest is not None:
                    out.append({"conv_id": conv, "repaired_sha256": digest.hexdigest()})
                conv, digest, any_row = p["conv_id"], hashlib.sha256(), False
            for role, text in zip(p["roles"], p["texts"], strict=True):
                digest.update(f"{chr(10) if any_row else ''}{role}:{text}".encode())
                any_row = True
        yield pa.RecordBatch.from_pylist(out, schema=kind)
    if digest is not None:
        yield pa.RecordBatch.from_pylist([{"conv_id": conv, "repaired_sha256": digest.hexdigest()}], schema=kind)


def _gaps(lowest: Column, highest: Column, n_turns: Column) -> Column:
    return F.coalesce(highest - lowest + 1 - n_turns, F.lit(0)).cast("long")


def report(solved: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of pieces of :func:`repaired`.

    The letters and the digest of a conversation are one value each, so one task goes through all its pieces for them.
    """
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    lines = F.transform(F.arrays_zip("roles", "texts"), lambda x: F.concat(x["roles"], F.lit(":"), x["texts"]))
    whole = solved.where("alone").select(
        "conv_id", _gaps(F.col("lowest"), F.col("highest"), F.col("n_turns")).alias("gaps"), *names[1:6],
        F.col("edits").alias("audit"), F.sha2(F.array_join(lines, "\n"), 256).alias("repaired_sha256"))
    several = solved.where("not alone")
    sums = several.groupBy("conv_id").agg(
        _gaps(F.min("lowest"), F.max("highest"), F.sum("n_turns")).alias("gaps"), *[F.sum(c).alias(c) for c in names[1:6]],
        F.array_join(F.array_sort(F.collect_list(F.struct("part", "no", "edits")))["edits"], "").alias("audit"))
    ordered = several.select("conv_id", "part", "no", "roles", "texts").repartition("conv_id").sortWithinPartitions("conv_id", "part", "no")
    hashed = ordered.drop("part", "no").mapInArrow(_hashed, "conv_id long, repaired_sha256 string").alias("h")
    both = sums.alias("s").join(hashed, F.col("s.conv_id").eqNullSafe(F.col("h.conv_id")))
    return whole.unionByName(both.select("s.*", "h.repaired_sha256"))


def with_all(found: DataFrame, rows: DataFrame) -> DataFrame:
    """``found`` of :func:`report` and every other conversation of ``rows``, as one without rows."""
    ids = rows.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().alias("all")
    joined = ids.join(found.alias("f"), F.col("all.conv_id").eqNullSafe(F.col("f.conv_id")), "left")
    empty = {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit(""), 256)}
    return joined.select("all.conv_id", *[
        F.coalesce(F.col(f"f.{c}"), empty.get(c, F.lit(0).cast("long"))).alias(c) for c in found.columns if c != "conv_id"
    ])
