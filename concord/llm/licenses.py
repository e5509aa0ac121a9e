"""License scans: base phrases word by word, and known notices with a bounded number of edits.

A notice that may have k edits is split into k + 1 seeds: with k edits at most, one seed stands unchanged (pigeonhole).
Seeds are found by one automaton over the text; around each hit the regex library matches the notice with at
most k errors, which verifies the candidate and gives its span.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


@dataclass(frozen=True)
class Notice:
    label: str
    text: str
    errors: int


# Phrases whose places count, and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Short notices in words; the labels of the first four equal base labels where the notice says the same.
NOTICES = (
    Notice("gpl", "this work is licensed under the gnu general public license", 5),
    Notice("apache", "licensed under the apache license version 2 0", 4),
    Notice("mit", "released under the mit license", 3),
    Notice("cc-by", "licensed under cc by", 2),
    Notice("cc-by-nc", "licensed under cc by nc", 2),
    Notice("bsd", "redistribution and use in source and binary forms", 5),
    Notice("mpl", "mozilla public license version 2 0", 3),
    Notice("lgpl", "gnu lesser general public license", 3),
    Notice("proprietary", "all rights reserved", 1),
)


def seeds(notice: Notice) -> list[tuple[int, str]]:
    """The notice in errors + 1 runs of about equal length, each with its place."""
    n, k = len(notice.text), notice.errors + 1
    cuts = [n * i // k for i in range(k + 1)]
    return [(a, notice.text[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


@functools.cache
def _automaton(notices: tuple[Notice, ...]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for i, notice in enumerate(notices):
        for at, seed in seeds(notice):
            held = found.get(seed, [])
            found.add_word(seed, [*held, (i, at, len(seed))])
    found.make_automaton()
    return found


@functools.cache
def _pattern(notice: Notice) -> regex.Pattern:
    return regex.compile(f"(?b)(?:{regex.escape(notice.text, special_only=True, literal_spaces=True)}){{e<={notice.errors}}}")


def fuzzy_spans(text: str, notices: tuple[Notice, ...] = NOTICES) -> list[tuple[str, int, int, int]]:
    """(label, start, end, edits) of the notices in a text of words apart by one blank, best match of each candidate place."""
    windows: dict[int, list[tuple[int, int]]] = {}
    for end, hits in _automaton(notices).iter(text):
        for i, at, long in hits:
            n, k = len(notices[i].text), notices[i].errors
            start = end + 1 - long - at
            window = (max(0, start - k), min(len(text), start + n + k))
            held = windows.setdefault(i, [])
            if held and window[0] <= held[-1][1]:
                held[-1] = (min(held[-1][0], window[0]), max(held[-1][1], window[1]))
            else:
                held.append(window)
    out = []
    for i, held in windows.items():
        notice = notices[i]
        for a, b in held:
            for m in _pattern(notice).finditer(text, a, b):
                out.append((notice.label, m.start(), m.end(), sum(m.fuzzy_counts)))
    return sorted(set(out), key=lambda s: (s[1], s[2], s[0]))


def scan_text(text: str) -> dict:
    """Everything that is said of one text; spans are words counted from 0, the last one left out."""
    found = WORD.findall(text.translate(_LOWER))
    line = " " + " ".join(found) + " "
    starts = np.cumsum([1, *(len(w) + 1 for w in found)])
    places: list[tuple[int, str]] = []
    for phrase, label in BASE.items():
        at = line.find(f" {phrase} ")
        while at >= 0:
            places.append((int(np.searchsorted(starts, at + 1)), label))
            at = line.find(f" {phrase} ", at + 1)
    spans = []
    for label, a, b, edits in fuzzy_spans(line):
        first, last = int(np.searchsorted(starts, a + 1, side="right")) - 1, int(np.searchsorted(starts, b - 1, side="right"))
        spans.append((label, max(first, 0), last, edits))
    base = {label for _, label in places}
    labels = base | {label for label, *_ in spans}
    notice_length = {n.label: len(n.text) for n in NOTICES}
    closeness = [1.0 - edits / notice_length[label] for label, _, _, edits in spans] + [1.0] * bool(base)
    at = [p for p, _ in places]
    return {
        "n_words": len(found), "n_base": len(places), "first_word": min(at, default=None), "last_word": max(at, default=None),
        "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(labels)), "score": max(closeness, default=0.0),
        "spans": [{"label": s[0], "start": s[1], "end": s[2], "edits": s[3]} for s in spans],
    }


SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, spans array<struct<label string, start long, end long, edits long>>"
)
_TYPES = [
    pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(),
    pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int64())])),
]


def license_scan(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: base phrases, notices with their spans in words, labels and a score.

    ``score`` is 1 where a base phrase stands, else the share of the best notice that stands unedited, else 0. Null and
    empty texts have no words, no labels (an empty string) and score 0; first and last word are null without a base
    phrase. Rows with null or repeated ids are kept; an empty table gives no rows; further columns are not looked at.
    """
    names = [f.split(" ", 1)[0] for f in SCHEMA.split(", ")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                rows = [scan_text(t.as_py() or "") for t in part.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *[pa.array([r[n] for r in rows], t) for n, t in zip(names[1:9], _TYPES[1:], strict=True)]],
                    names=names[:9],
                )

    rows = docs.select(F.col(f"`{ident}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return rows.mapInArrow(scan, SCHEMA)
