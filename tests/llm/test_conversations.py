"""Conversation repair and chat formatting against plain versions, on odd rows."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from concord.llm import chat, repair

KIND = "conv_id long, turn long, role string, text string, part string, `a.b` string"
NEXT = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}


def table(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], KIND).repartition(parts)


def in_order(rows):
    fill = lambda r: (r[0], r[1], *(" " if x is None else x for x in r[2:]))
    return sorted(map(fill, rows), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))


def kinds(rows):
    seen, out = set(), []
    for *_, role, text in rows:
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("b" if not solid else "d" if (role, text) in seen else "." if solid[-1] in ".!?" else "t")
        seen.add((role, text))
    return out


def every_edit(rows, found):
    """All edits of a short conversation: cost, letters and lines of each, with up to two turns inserted in a gap."""
    puts = [()] + [(a,) for a in ("user", "assistant")] + list(itertools.product(("user", "assistant"), repeat=2))
    options = []
    for (*_, role, text), kind in zip(rows, found):
        extra = 3 if kind == "t" else 0
        own = [("D", 4, None)]
        if kind in ".t":
            own += [("K", extra, (role, text))] + [("R", 3 + extra, (r, text)) for r in ("user", "assistant")]
        options.append([(("I" * len(p)) + c, 3 * len(p) + price, [(r, "") for r in p] + ([line] if line else [])) for p in puts for c, price, line in own])
    options.append([("I" * len(p), 3 * len(p), [(r, "") for r in p]) for p in puts])
    for way in itertools.product(*options):
        lines = [x for _, _, some in way for x in some]
        if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "?" for r, _ in lines)):
            yield sum(c for _, c, _ in way), "".join(a for a, _, _ in way), lines


def plain_repair(rows):
    """Least by a forward search that keeps every letter sequence of least cost."""
    rows = in_order(rows)
    found = kinds(rows)
    best = {"": {(0, "", ())}}

    def put(ways):
        out = [(q, v) for q, vs in ways.items() for v in vs]
        more = out
        for _ in range(2):
            more = [(NEXT[q][r[0]], (c + 3, a + "I", o + ((r, ""),))) for q, (c, a, o) in more for r in ("user", "assistant") if r[0] in NEXT[q]]
            out = out + more
        return out

    for (*_, role, text), kind in zip(rows, found):
        now = {}
        for q, (c, a, o) in put(best):
            now.setdefault(q, set()).add((c + 4, a + "D", o))
            if kind in ".t":
                price = c + (3 if kind == "t" else 0)
                if role[:1] in NEXT[q]:
                    now.setdefault(NEXT[q][role[:1]], set()).add((price, a + "K", o + ((role, text),)))
                for r in NEXT[q].keys() & {"u", "a"}:
                    now.setdefault(NEXT[q][r], set()).add((price + 3, a + "R", o + (({"u": "user", "a": "assistant"}[r], text),)))
        best = {q: set(sorted(v)[:6]) for q, v in now.items()}
    cost, audit, lines = min(v for q, v in put(best) if q in ("", "a"))
    first = [r[2][:1] for r in rows]
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:]))
    body = "\n".join(f"{r}:{t}" for r, t in lines)
    return gaps, *(found.count(k) for k in "bdt"), illegal, cost, audit, hashlib.sha256(body.encode()).hexdigest()


def some_rows(seed, convs, longest):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "open end", " \t", "", None, "so?\n ", "1. x", "é.", "."]
    for conv in range(convs):
        for turn in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", None, "", "tool", "ünder"])
            text = f"{rng.randint(0, 40)} {rng.choice(texts)}" if rng.random() < 0.7 else rng.choice(texts)
            yield conv if conv else None, rng.choice([turn, turn, turn, turn + 1, None]), role, text


NAMES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def by_conversation(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


def test_least_against_every_edit():
    rng = random.Random(4)
    for _ in range(150):
        rows = [(1, k, rng.choice(["user", "assistant", "system", "x", ""]), rng.choice(["a.", "b.", "c", " ", "d!"])) for k in range(rng.randint(1, 3))]
        found = kinds(rows)
        cost, audit, lines = min(every_edit(rows, found), key=lambda x: x[:2])
        roles, texts = [r[2] for r in rows], [r[3] for r in rows]
        w = repair.Weights(len(rows))
        best = repair.least(roles, repair.faults(roles, texts), repair.closing(len(rows)))[repair.START]
        assert (w.cost(best), w.letters(best)) == (cost, audit)
        assert list(zip(*repair.edited(repair.START, audit, roles, texts))) == lines


@pytest.mark.parametrize("size", [1, 3, repair.PIECE])
def test_repair(spark, size):
    rows = list(some_rows(size, 60, 9)) + [(900, k % 40, ["user", "assistant"][k % 2], f"{k % 23} ok.") for k in range(130)]
    rows += [(901, 0, "user", "same.")] * 50 + [(902, 0, "user", "long " * 50_000), (903, None, None, None)]
    rows += [(904, 2**40, "system", "a."), (904, -5, "system", "b.")]
    got = repair.report(repair.repaired(table(spark, rows, 4), size=size)).collect()
    assert len(got) == len({r.conv_id for r in got})
    assert {r.conv_id: tuple(r[c] for c in NAMES) for r in got} == {c: plain_repair(x) for c, x in by_conversation(rows).items()}


def test_repaired_pieces_read_in_order(spark):
    rows = [(1, k, ["user", "assistant"][k % 2], f"{k}.") for k in range(40)]
    found = repair.repaired(table(spark, rows), size=7).orderBy("part", "no").collect()
    assert len(found) > 5
    assert [x for p in found for x in zip(p.roles, p.texts)] == [(r, t) for _, _, r, t in rows]
    assert "".join(p.edits for p in found) == "K" * 40


def test_damage(spark):
    rows = list(some_rows(7, 40, 8)) + [(None, None, None, None), (5, None, "user", "x.")]
    want = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fault:
            text = {1: "", 2: re.sub("[.!?]", "", text)}.get(fault, text)
            want += [(conv, turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in repair.damaged(table(spark, rows)).collect())


def test_conversations_without_rows(spark):
    rows = table(spark, [(1, 0, "user", "x."), (None, 0, "user", "x."), (2, 0, "user", "x.")])
    kept = rows.where("conv_id = 1")
    got = {r.conv_id: r for r in repair.with_all(repair.report(repair.repaired(kept)), rows).collect()}
    assert got[1].audit == "KI" and set(got) == {1, 2, None}
    for r in (got[2], got[None]):
        assert tuple(r[c] for c in NAMES) == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_empty_tables(spark):
    none = table(spark, [(1, 0, "user", "x.")]).limit(0)
    assert repair.with_all(repair.report(repair.repaired(repair.damaged(none))), none).collect() == []
    assert chat.digests(chat.formatted(none)).collect() == []


def read_plain(text, t):
    """Turns of a formatted text by a reader of its own."""
    out, at = [], 0
    while at < len(text):
        assert text.startswith(t.open, at)
        at += len(t.open)
        line, end = text.index("\n", at), text.index(t.close, at)
        out.append(tuple(undone(x, t) for x in (text[at:line], text[line + 1 : end])))
        at = end + len(t.close)
    return [(r.replace("%0A", "\n").replace("%25", "%"), x) for r, x in out]


def undone(text, t):
    for c in t.controls:
        text = re.sub(re.escape(c[0]) + r"\\(\\*)" + re.escape(c[1:]), lambda m: c[0] + m[1] + c[1:], text)
    return text


ODD_TURNS = [
    (None, None, "us%er\nx", "a<\\s>b<s><|im_start|>"), (None, 1, None, None), (1, 2, "assistant", "<|im_end|>\n"),
    (1, 2, "assistant", "<|im_end|>\n"), (1, None, "assistant", "é😀\\<\\\\</SYS>>[\\INST][[/INST]"), (2, 1, "<s>\n%0A%25", "%25%0A\n\n<|im_start|"),
    (2, 2, "", "im_start|>"), (2, 3, "<|im_start|>", "<|im_end|>" * 3000), (3, 0, "assistant", "long <s> " * 40_000), (3, 1, "user\r", "\x00"),
    (4, 0, "user", "</s>[INST] ok [/INST]"), (4, 1, "assistant", "</s>[INST] ok [/INST]"), (5, 0, "assistant", ""),
]


def check_chat(spark, rows, t):
    out = chat.formatted(table(spark, rows), t)
    texts = {r.conv_id: r for r in out.collect()}
    digests = {r.conv_id: r for r in chat.digests(out, t).collect()}
    plain = {c: sorted(x, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")) for c, x in by_conversation(rows).items()}
    assert set(texts) == set(plain) == set(digests)
    for conv, said in plain.items():
        turns = [(r or "", x or "") for *_, r, x in said]
        assert read_plain(texts[conv].formatted, t) == turns
        body = texts[conv].formatted.encode()
        learnt = [x for r, x in turns if r in t.learnt]
        assert [undone(body[s.start : s.end].decode(), t) for s in texts[conv].loss] == learnt
        own = digests[conv]
        assert own.n_turns == len(turns) and own.formatted_chars == len(texts[conv].formatted)
        assert own.turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
        assert (own.loss_chars, own.loss_sha256) == (len("".join(learnt)), hashlib.sha256("".join(learnt).encode()).hexdigest())


def test_chat(spark):
    check_chat(spark, ODD_TURNS, chat.Template())


def test_chat_of_another_template(spark):
    t = chat.Template("<<SYS>>", "[/INST]\n", ("<<SYS>>", "[/INST]", "[INST]", "$#", "ab"), ("user", "assistant"))
    check_chat(spark, ODD_TURNS + [(6, 0, "user", "$\\#ab a\\b ab\\ $#$# $ # [/INST]\n<<SYS>>")], t)


def test_texts_without_conflict_stay_as_they_are(spark):
    row = chat.formatted(table(spark, [(1, 0, "user", "a \\ b < c [x]"), (1, 1, "assistant", "ok")])).first()
    assert row.formatted == "<|im_start|>user\na \\ b < c [x]<|im_end|>\n<|im_start|>assistant\nok<|im_end|>\n"


def test_bad_templates():
    for bad in (("<s>", "</s>", ("<s>", "</s>")), ("<a>", "<b>\n", ("<a>", "<b>", "\\x")), ("xy", "yz\n", ("xy", "yz")), ("<a>", "<b>\n", ("<b>",))):
        with pytest.raises(ValueError):
            chat.Template(*bad)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(*[st.text(st.sampled_from("<>|\\[]/%\nsaINSTY im_endr"), max_size=30)] * 2), min_size=20, max_size=40))
def test_chat_of_random_texts(spark, turns):
    joined = [(k % 3, k, r + random.Random(k).choice(chat.CONTROLS), random.Random(-k).choice(chat.CONTROLS) + x) for k, (r, x) in enumerate(turns)]
    check_chat(spark, [(k % 3, k, r, x) for k, (r, x) in enumerate(turns)] + [(c + 3, k, r, x) for c, k, r, x in joined], chat.Template())


def test_native_plan(spark):
    plan = chat.digests(chat.formatted(table(spark, ODD_TURNS)))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange hashpartitioning(conv_id") == 1
