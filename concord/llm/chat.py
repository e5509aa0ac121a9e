"""Chat formatting by a grammar round trip: what is rendered is read back, and content that would not come back is escaped.

    conversation = turn*        turn = OPEN role "\\n" text CLOSE

A role has no line break, and neither role nor text holds a control string of the template, so a reader that cuts at OPEN
finds the turns without looking ahead. Each turn is rendered as it is, read back and compared; where another role or
text comes back, or none, the turn is rendered with escaped content and read once more. Content is escaped by a backslash
behind the first character of every control string, one more if there are some already, so reading takes one away.

Only column expressions and a window: rows are rendered, read and escaped apart from each other, whatever conversation
they belong to, and meet by conversation once, as finished segments.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Control strings of public chat models; content never shows them unescaped.
CONTROLS = (
    "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
)


@dataclass(frozen=True)
class Template:
    """Marks of a turn, all control strings, and whose texts are learnt.

    OPEN must be a control string; CLOSE must begin with one and end with a line break, so that no mark can come up
    where two turns meet. No control string may hold a backslash or begin inside another or itself.
    """

    open: str = "<|im_start|>"
    close: str = "<|im_end|>\n"
    controls: tuple[str, ...] = CONTROLS
    learnt: tuple[str, ...] = ("assistant",)

    def __post_init__(self) -> None:
        if any("\\" in c or len(c) < 2 for c in self.controls):
            raise ValueError("control strings need two characters and no backslash")
        tails = [(c[k:], other) for c in self.controls for other in self.controls for k in range(1, len(c))]
        if any(tail.startswith(other) or other.startswith(tail) for tail, other in tails):
            raise ValueError("a control string begins inside another or itself")
        if self.open not in self.controls or not self.close.endswith("\n") or not any(self.close.startswith(c) for c in self.controls):
            raise ValueError("marks of a turn must be control strings")

    def _rests(self) -> dict[str, str]:
        firsts = sorted({c[0] for c in self.controls})
        return {f: "|".join(re.escape(c[1:]) for c in self.controls if c[0] == f) for f in firsts}

    def spelled(self) -> str:
        """Pattern of a control string."""
        return "|".join(re.escape(c) for c in self.controls)

    def escape(self, c: Column) -> Column:
        hit = "|".join(rf"{re.escape(f)}(?=\\*(?:{rest}))" for f, rest in self._rests().items())
        return F.regexp_replace(c, hit, r"$0\\")

    def unescape(self, c: Column) -> Column:
        hit = "|".join(rf"(?<={re.escape(f)})\\(?=\\*(?:{rest}))" for f, rest in self._rests().items())
        return F.regexp_replace(c, hit, "")


def _escaped_role(t: Template, role: Column) -> Column:
    return t.escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _read_role(t: Template, role: Column) -> Column:
    return F.replace(F.replace(t.unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def _segment(t: Template, role: Column, text: Column) -> Column:
    return F.concat(F.lit(t.open), role, F.lit("\n"), text, F.lit(t.close))


def _read_turn(t: Template, body: Column) -> Column:
    """Role and text of what stands between two OPEN marks; null where the grammar does not hold."""
    role = F.substring_index(body, "\n", 1)
    end = F.length(body) - len(t.close)
    text = F.substring(body, F.length(role) + 2, end - F.length(role) - 1)
    whole = F.endswith(body, F.lit(t.close)) & (F.length(role) < end)
    plain = ~F.rlike(F.substring(body, F.lit(1), end), F.lit(t.spelled()))
    return F.when(whole & plain, F.struct(_read_role(t, role).alias("role"), t.unescape(text).alias("text")))


def read(formatted: Column, template: Template = Template()) -> Column:
    """The turns of a formatted conversation as an array of (role, text); a turn that breaks the grammar is null."""
    bodies = F.split(formatted, re.escape(template.open))
    return F.transform(F.slice(bodies, F.lit(2), F.greatest(F.size(bodies) - 1, F.lit(0))), lambda b: _read_turn(template, b))


def masked(formatted: Column, loss: Column, template: Template = Template()) -> Column:
    """The unescaped texts under the loss mask, in order."""
    cut = lambda body, s: F.substring(body, s["start"] + 1, s["end"] - s["start"]).cast("string")
    # An array of one value makes the bytes once for all spans.
    found = F.transform(F.array(formatted.cast("binary")), lambda body: F.transform(loss, lambda s: template.unescape(cut(body, s))))
    return F.get(found, F.lit(0))


def segments(rows: DataFrame, template: Template, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv_id, turn, role, text, segment, loss_start, loss_end) of every row, each read back on its own.

    ``loss_start`` and ``loss_end`` are bytes of the segment, null where its text is not learnt.
    """
    t = template
    said = rows.select(
        F.col(f"`{conv}`").alias("conv_id"), F.col(f"`{turn}`").alias("turn"),
        *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((role, "role"), (text, "text"))],
    )
    source = F.struct("role", "text")
    back = lambda r, x: F.coalesce(F.get(read(_segment(t, r, x), t), F.lit(0)) == source, F.lit(False))
    kept = said.withColumn("same", back(F.col("role"), F.col("text")))
    for name, safe in (("shown_role", _escaped_role(t, F.col("role"))), ("shown_text", t.escape(F.col("text")))):
        kept = kept.withColumn(name, F.when(F.col("same"), F.col(name.removeprefix("shown_"))).otherwise(safe))
    again = F.col("same") | back(F.col("shown_role"), F.col("shown_text"))
    proof = F.when(~again, F.raise_error(F.lit("a turn does not come back from its formatted text")).cast("string"))
    head = F.octet_length(F.col("shown_role")) + len(t.open.encode()) + 1
    learnt = F.col("role").isin(*t.learnt)
    return kept.select(
        "conv_id", "turn", "role", "text",
        F.coalesce(proof, _segment(t, F.col("shown_role"), F.col("shown_text"))).alias("segment"),
        F.when(learnt, head.cast("long")).alias("loss_start"),
        F.when(learnt, (head + F.octet_length("shown_text")).cast("long")).alias("loss_end"),
    )


def formatted(
    rows: DataFrame, template: Template = Template(), conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
) -> DataFrame:
    """(conv_id, formatted, loss) of every conversation: its text, and the spans (start, end) of UTF-8 bytes to learn.

    Rows stand by turn, a null turn first, equal ones by role and text; repeated rows are turns of their own. Null roles and
    texts are empty; rows of a null conversation are one conversation. An empty table gives no rows; further columns are
    not looked at. All content comes back: any role, line breaks, control strings and escapes included.

    The whole conversation is read back too, and the job stops if a turn differs. A conversation's text is one value, so
    it has to stay below 2 GB, which is Spark's limit for a value; a longer one stops the job, it is never cut.
    """
    parts = segments(rows, template, conv, turn, role, text)
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    so_far = F.coalesce(F.sum(F.octet_length("segment").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = parts.select(
        "conv_id", F.row_number().over(order).alias("at"), "segment", F.xxhash64("role", "text").alias("mark"),
        (so_far + F.col("loss_start")).alias("start"), (so_far + F.col("loss_end")).alias("end"),
    )
    turns = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("at", "segment", "mark", "start", "end"))).alias("turns"))
    whole = turns.select(
        "conv_id", F.array_join("turns.segment", "").alias("formatted"), F.col("turns.mark").alias("marks"),
        F.transform(F.filter("turns", lambda x: x["start"].isNotNull()), lambda x: F.struct(x["start"], x["end"])).alias("loss"),
    )
    marks = F.transform(read(F.col("formatted"), template), lambda x: F.xxhash64(x["role"], x["text"]))
    proof = F.when(marks != F.col("marks"), F.raise_error(F.lit("a conversation does not come back from its formatted text")).cast("string"))
    return whole.select("conv_id", F.coalesce(proof, F.col("formatted")).alias("formatted"), "loss")


def digests(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """Per conversation of :func:`formatted`, all read back from its text and mask: turns, digests and lengths."""
    said = conversations.select(
        "conv_id", "formatted", read(F.col("formatted"), template).alias("turns"),
        F.array_join(masked(F.col("formatted"), F.col("loss"), template), "").alias("learnt"),
    )
    line = lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))
    return said.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", line), ""), 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def with_turns(rows: DataFrame, conv_id: int, turns: Sequence[tuple[str, str]]) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) and one more conversation of the given (role, text)."""
    own = [(conv_id, k, role, text) for k, (role, text) in enumerate(turns)]
    more = rows.sparkSession.createDataFrame(own, "conv_id long, turn long, role string, text string")
    return rows.select("conv_id", "turn", "role", "text").unionByName(more)
