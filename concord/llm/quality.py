"""Quality classifier by positive-unlabelled learning with a non-negative risk.

Numbers that describe a text's characters, words and lines feed a small network. It is trained on trusted positives and
unlabelled texts: the risk of the unlabelled ones, less what positives among them explain at the estimated class
prior, is kept from falling below zero. The fit runs on bounded samples; all texts are scored where they lie.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.llm.tables import written
from concord.llm.words import SLICE_BYTES, SPACED, parts, text_bytes, words

#: Rows of each sample the model is fitted on: positives, unlabelled rows, and labelled rows for prior and cut.
SAMPLE = 20_000
#: Words of a window; the oddest window of a text counts as well as the whole.
WINDOW = 48
THRESHOLD = 0.7

_B = np.arange(256)
_CLASSES = [
    (_B >= 97) & (_B <= 122), (_B >= 65) & (_B <= 90), (_B >= 48) & (_B <= 57), _B == 32, _B == 10, _B >= 128,
    np.isin(_B, list(b".,;:'\"")), np.isin(_B, list(b"!?")), np.isin(_B, list(b"#$%&*@^~+=_")), np.isin(_B, list(b"|<>/\\[](){}-")),
    (_B < 32) & (_B != 10),
]
_CLASS_OF = np.full(256, len(_CLASSES), np.uint8)
for _k, _c in enumerate(_CLASSES):
    _CLASS_OF[_c] = _k
N_CLASSES = len(_CLASSES) + 1
N_FEATURES = 2 * N_CLASSES + 11


def _describe(data: np.ndarray, start: np.ndarray, end: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    """Features of one text: shares of character classes (whole and worst window), words, repeats and lines."""
    kind = _CLASS_OF[data]
    counts = np.bincount(kind, minlength=N_CLASSES)
    n, w = max(1, len(data)), max(1, len(start))
    out = np.zeros(N_FEATURES, np.float32)
    out[:N_CLASSES] = counts / n
    at = 2 * N_CLASSES
    # Windows: cuts at every WINDOW words; a class's largest share, and the smallest share of distinct words.
    edges = np.append(start[::WINDOW], len(data)) if len(start) else np.array([0, len(data)])
    long = np.maximum(1, np.diff(edges))
    cell = np.searchsorted(edges, np.arange(len(data)), side="right") - 1 if len(edges) > 2 else np.zeros(len(data), np.int64)
    cell = np.maximum(cell, 0)
    per = np.bincount(cell * N_CLASSES + kind, minlength=len(long) * N_CLASSES).reshape(-1, N_CLASSES) / long[:, None]
    whole = long >= min(40, long.max())
    out[N_CLASSES:at] = per[whole].max(0) if len(data) else 0
    if len(hashed):
        values, often = np.unique(hashed, return_counts=True)
        window = np.arange(len(hashed)) // WINDOW
        pair = np.unique(np.stack((window.astype(np.uint64), hashed), 1), axis=0)
        distinct = np.bincount(pair[:, 0].astype(np.int64)) / np.bincount(window)
        sizes = end - start
        texts = data.tobytes().split(b"\n")
        out[at : at + 11] = (
            len(values) / w, often.max() / w, distinct.min(), distinct.mean(), sizes.mean() / 10, sizes.std() / 10,
            min(1.0, sizes.max() / 100), np.log1p(w) / 10, len(set(texts)) / len(texts),
            np.count_nonzero(hashed[1:] == hashed[:-1]) / w, (often[often > 1].sum() if (often > 1).any() else 0) / w,
        )
    return out


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, row, x) for rows (doc_id, row, text). Texts are read in stretches, whose features are averaged by length."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, "text", SLICE_BYTES):
                data, offsets = text_bytes(part.column(2))
                found = words(data, offsets, SPACED)
                ends = np.cumsum(found.counts)
                rows = []
                for i in range(len(offsets) - 1):
                    a, b = int(ends[i] - found.counts[i]), int(ends[i])
                    o = offsets[i]
                    stretches, weights = [], []
                    for s in range(a, max(b, a + 1), 20_000):
                        t = min(b, s + 20_000)
                        lo = int(found.start[s] - o) if s > a else 0
                        hi = int(found.start[t] - o) if t < b else int(offsets[i + 1] - o)
                        stretches.append(
                            _describe(data[o + lo : o + hi], found.start[s:t] - o - lo, found.end[s:t] - o - lo, found.hash[s:t])
                        )
                        weights.append(max(1, hi - lo))
                    rows.append(np.average(stretches, axis=0, weights=weights))
                flat = pa.array(np.concatenate(rows).astype(np.float32)) if rows else pa.array([], pa.float32())
                lists = pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, N_FEATURES, dtype=np.int32), flat)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists], names=["doc_id", "row", "x"])

    return docs.mapInArrow(scan, "doc_id long, row long, x array<float>")


@dataclass
class Model:
    """A network with one hidden layer over standardised features, and the cut that stands for THRESHOLD."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    cut: float
    prior: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.tanh(z @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        shifted = self.logits(x) - self.cut + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(shifted, -30, 30)))


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float, hidden: int = 24, rounds: int = 400) -> Model:
    """Minimise the non-negative unbiased risk with sigmoid losses by Adam over whole samples."""
    rng = np.random.default_rng(7)
    both = np.concatenate((positive, unlabelled)).astype(np.float64)
    mean, scale = both.mean(0), both.std(0) + 1e-3
    x = np.clip((both - mean) / scale, -8, 8)
    split = len(positive)
    weights = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 0.3, hidden), np.zeros(1)]
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
    for step in range(1, rounds + 1):
        h = np.tanh(x @ weights[0] + weights[1])
        g = h @ weights[2] + weights[3]
        p = 1 / (1 + np.exp(-np.clip(g, -30, 30)))  # loss of calling it negative; 1 - p of calling it positive
        slope = p * (1 - p)
        rest = p[split:].mean() - prior * p[:split].mean()
        dg = np.zeros(len(x))
        if rest >= 0:
            dg[:split] = -2 * prior * slope[:split] / split
            dg[split:] = slope[split:] / (len(x) - split)
        else:  # step back from a negative risk
            dg[:split] = prior * slope[:split] / split
            dg[split:] = -slope[split:] / (len(x) - split)
        dh = np.outer(dg, weights[2]) * (1 - h * h)
        grads = [x.T @ dh + 1e-4 * weights[0], dh.sum(0), h.T @ dg + 1e-4 * weights[2], np.array([dg.sum()])]
        for i, grad in enumerate(grads):
            m, v = moments[i]
            m[:] = 0.9 * m + 0.1 * grad
            v[:] = 0.999 * v + 0.001 * grad * grad
            weights[i] -= 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, weights[0], weights[1], weights[2], float(weights[3][0]), 0.0, prior)


def best_cut(logits: np.ndarray, labels: np.ndarray) -> float:
    """The logit that tells the labelled rows apart best, by the mean accuracy of both labels."""
    if len(set(labels.tolist())) < 2:
        return 0.0
    order = np.argsort(logits)
    at, y = logits[order], labels[order]
    below = np.concatenate(([0], np.cumsum(1 - y))) / max(1, (1 - y).sum())  # zeros under the cut
    above = 1 - np.concatenate(([0], np.cumsum(y))) / max(1, y.sum())
    k = int(np.argmax(below + above))
    lower, upper = at[max(0, k - 1)], at[min(len(at) - 1, k)]
    return float((lower + upper) / 2)


def _sample(rows: DataFrame, n: int) -> np.ndarray:
    """``n`` rows at most, the same whatever their order: those of the smallest hash."""
    found = rows.orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(n).select("x").collect()
    return np.array([r.x for r in found], np.float64).reshape(-1, N_FEATURES)


def held_out(ident: str = "doc_id") -> F.Column:
    return F.pmod(F.crc32(F.coalesce(F.col(ident).cast("string"), F.lit(""))), F.lit(4)) == 2


def quality_scores(
    docs: DataFrame, labels: DataFrame, ident: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE,
    row: str | None = None,
) -> DataFrame:
    """One row (doc_id, row, held_out, score, predicted) per row of ``docs``; ``row`` is the column of that name, if any.

    Only labels of rows that are not held out are used: those of label 1 as positives, and up to ``sample`` of both kinds
    for the class prior and the cut. Unlabelled rows are a sample of all rows that are not held out, their labels unseen.
    Scores come from the text alone. Null counts as an empty text; null labels are no labels; an id with several labels
    counts once for each; without labels of both kinds every score is that of an untrained cut, and without positives
    0.5. Rows with null or repeated ids are kept; an empty table gives no rows; further columns are not looked at.
    """
    rows = docs.select(
        F.col(f"`{ident}`").cast("long").alias("doc_id"),
        (F.col(f"`{row}`") if row else F.lit(None)).cast("long").alias("row"), F.col(f"`{text}`").cast("string").alias("text"),
    )
    described = written(features(rows), "features")
    known = labels.select(F.col(f"`{ident}`").cast("long").alias("doc_id"), F.col(f"`{label}`").cast("int").alias("y"))
    known = known.where("y in (0, 1)").where(~held_out()).distinct()
    train_rows = described.where(~held_out())
    labelled = train_rows.join(known, "doc_id")
    positive = _sample(labelled.where("y = 1"), sample)
    if len(positive):
        unlabelled = _sample(train_rows, sample)
        told = labelled.orderBy(F.xxhash64("doc_id", F.lit(13)), "doc_id").limit(sample).select("x", "y").collect()
        y = np.array([r.y for r in told])
        prior = float((y.sum() + 1) / (len(y) + 2))
        model = train(positive, unlabelled, prior)
        model.cut = best_cut(model.logits(np.array([r.x for r in told], np.float64)), y)
    else:
        model = None
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2)
            x = np.asarray(column.flatten(), np.float64).reshape(-1, N_FEATURES)
            out = sent.value.score(x) if sent.value is not None else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(out, pa.float64())], names=["doc_id", "row", "score"]
            )

    scored = described.mapInArrow(score, "doc_id long, row long, score double")
    return scored.select(
        "doc_id", "row", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
