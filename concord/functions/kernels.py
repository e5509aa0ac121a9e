"""Similarity of many pairs of texts at a time, as NumPy kernels over code points.

A text is a span of one array of code points. Pairs of like lengths are laid out as matrices, and the loops run over the
characters of a matrix column, never over pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np

#: Cells of the matrices that are worked on at a time.
CELLS = 1 << 21
#: What fills up the rows of either side, counted down from the largest number of a kind; never a character, and not equal.
LEFT_FILL, RIGHT_FILL = 0, 1

# Fixed values of the Winkler variant: the prefix counts only above this plain score.
BOOST_ABOVE = 0.7
PREFIX_WEIGHT = 0.1
PREFIX_MAX = 4
# Fixed values of the matching-block ratio: in a second text of so many characters, those that make up more than one in
# so many (and one more) start no match.
POPULAR_FROM, POPULAR_SHARE = 200, 100


@dataclass
class Spans:
    """Texts as starts and sizes in ``codes``, an array of small numbers that stand for characters."""

    codes: np.ndarray
    start: np.ndarray
    size: np.ndarray

    def take(self, at: np.ndarray) -> Spans:
        return Spans(self.codes, self.start[at], self.size[at])

    def matrix(self, width: int, fill: int) -> np.ndarray:
        at = np.arange(width)
        inside = at < self.size[:, None]
        blank = self.codes.dtype.type(np.iinfo(self.codes.dtype).max - fill)
        if not len(self.codes):
            return np.full(inside.shape, blank)
        return np.where(inside, self.codes[np.minimum(self.start[:, None] + at, len(self.codes) - 1)], blank)


def coded(left: list[str], right: list[str]) -> tuple[Spans, Spans]:
    """Both lists as spans of one array, in the smallest kind of number that tells their characters apart."""
    texts = left + right
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(codes) and codes.max() >= 254:
        known, codes = np.unique(codes, return_inverse=True)
        codes = codes.astype(np.uint8 if len(known) < 254 else np.uint16 if len(known) < 65_534 else np.uint32)
    else:
        codes = codes.astype(np.uint8)
    both = Spans(codes, np.cumsum(size) - size, size)
    return both.take(np.arange(len(left))), both.take(np.arange(len(left), len(texts)))


def _together(left: Spans, right: Spans) -> tuple[Spans, Spans]:
    if left.codes is not right.codes:
        raise ValueError("both sides must be spans of one array")
    return left, right


def _alike(left: np.ndarray, right: np.ndarray) -> Iterator[np.ndarray]:
    """Numbers of pairs whose sizes, rounded up, are equal, at most CELLS cells of their tables at a time or one pair."""
    step = lambda n: np.where(n <= 64, -(-n // 8) * 8, 1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))
    a, b = step(left), step(right)
    order = np.lexsort((b, a))
    bounds = np.flatnonzero((np.diff(a[order]) != 0) | (np.diff(b[order]) != 0)) + 1
    for some in np.split(order, bounds):
        if len(some):
            rows = max(1, int(CELLS // max(1, a[some[0]], b[some[0]])))
            for k in range(0, len(some), rows):
                yield some[k : k + rows]


def _bits(same: np.ndarray) -> np.ndarray:
    """Rows of marks as 64-bit words, the first mark lowest; the width must be a multiple of 64."""
    return np.packbits(same, axis=1, bitorder="little").view(np.uint64)


def _low(n: np.ndarray) -> np.ndarray:
    """Words with the lowest ``n`` bits set, for n from below 0 to above 64."""
    n = np.clip(n, 0, 64).astype(np.uint64)
    return np.where(n == 64, ~np.uint64(0), (np.uint64(1) << np.minimum(n, np.uint64(63))) - np.uint64(1))


def _marks_of_short(a: np.ndarray, b: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Characters of either side that are matched, where ``b`` has 64 columns: sets of places are machine words."""
    one = np.uint64(1)
    free = np.full(len(a), ~np.uint64(0))
    hit = np.zeros(a.shape, bool)
    for x in range(a.shape[1]):
        fits = _bits(b == a[:, x : x + 1])[:, 0] & free & _low(x + reach + 1) & ~_low(x - reach)
        hit[:, x] = fits != 0
        free &= ~(fits & (~fits + one))
    taken = np.unpackbits((~free)[:, None].view(np.uint8), axis=1, bitorder="little").view(bool)
    return hit, taken


def _marks_of_long(a: np.ndarray, b: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    row, column = np.arange(len(a)), np.arange(b.shape[1])
    free, hit = np.ones(b.shape, bool), np.zeros(a.shape, bool)
    for x in range(a.shape[1]):
        fits = (b == a[:, x : x + 1]) & free & (np.abs(column - x) <= reach[:, None])
        at = fits.argmax(1)
        found = fits[row, at]
        hit[:, x] = found
        free[row[found], at[found]] = False
    return hit, ~free


def jaro_winkler(left: Spans, right: Spans) -> np.ndarray:
    """Jaro-Winkler similarity of each pair; 0 when a side is empty."""
    _together(left, right)
    out = np.zeros(len(left.size))
    for some in _alike(left.size, right.size):
        la, lb = left.size[some], right.size[some]
        if la.max() == 0 or lb.max() == 0:
            continue
        short = lb.max() <= 64
        a, b = left.take(some).matrix(int(la.max()), LEFT_FILL), right.take(some).matrix(64 if short else int(lb.max()), RIGHT_FILL)
        reach = np.maximum(np.maximum(la, lb) // 2 - 1, 0)
        hit, taken = (_marks_of_short if short else _marks_of_long)(a, b, reach)
        m = hit.sum(1)
        swaps = np.bincount(np.nonzero(hit)[0], a[hit] != b[taken], len(some)).astype(np.int64) // 2
        width = min(a.shape[1], b.shape[1])
        alike = a[:, :width] == b[:, :width]
        with np.errstate(divide="ignore", invalid="ignore"):
            score = np.where(m > 0, (m / la + m / lb + (m - swaps) / m) / 3.0, 0.0)
        score[(la == lb) & (alike.sum(1) == la) & (la > 0)] = 1.0
        prefix = np.logical_and.accumulate(alike[:, :PREFIX_MAX], axis=1).sum(1)
        out[some] = np.where(score > BOOST_ABOVE, score + prefix * PREFIX_WEIGHT * (1.0 - score), score)
    return out


def subsequence(left: Spans, right: Spans) -> np.ndarray:
    """Length of the longest common subsequence of each pair, 64 characters of the longer text in a machine word."""
    _together(left, right)
    swap = left.size < right.size
    pick = lambda x, y: Spans(left.codes, np.where(swap, x.start, y.start), np.where(swap, x.size, y.size))
    long, short = pick(right, left), pick(left, right)
    out = np.zeros(len(long.size), np.int64)
    for some in _alike(long.size, short.size):
        if short.size[some].max() == 0:
            continue
        words = -(-int(long.size[some].max()) // 64)
        a = long.take(some).matrix(words * 64, LEFT_FILL)
        b = short.take(some).matrix(int(short.size[some].max()), RIGHT_FILL)
        row = np.full((len(some), words), ~np.uint64(0))
        for x in range(b.shape[1]):
            mask = _bits(a == b[:, x : x + 1])
            hit = row & mask
            if words == 1:
                row = (row + hit) | (row - hit)
                continue
            total, carry = np.empty_like(row), np.zeros(len(some), np.uint64)
            for w in range(words):
                half = row[:, w] + hit[:, w]
                total[:, w] = half + carry
                carry = ((half < hit[:, w]) | (total[:, w] < carry)).astype(np.uint64)
            row = total | (row - hit)
        out[some] = 64 * words - np.bitwise_count(row).sum(1, dtype=np.int64)
    return out


def indel(left: Spans, right: Spans) -> np.ndarray:
    """0 to 100: twice the longest common subsequence over both lengths; two empty texts are equal."""
    total = left.size + right.size
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(total == 0, 100.0, 200.0 * subsequence(left, right) / total)


def _windows(short: Spans, long: Spans) -> np.ndarray:
    """Best ratio of each short text against any stretch of its size, or less at the ends, of the other text."""
    out = np.zeros(len(short.size))
    for some in _alike(long.size, short.size):
        s, t = short.take(some), long.take(some)
        n, length = s.size, t.size
        if n.max() == 0:
            continue
        a, b = s.matrix(int(n.max()), LEFT_FILL), t.matrix(int(length.max()), RIGHT_FILL)
        # Windows end before character 1, 2, ... and begin so much earlier; how many of their characters the short text has
        # bounds what they can share.
        ends = np.arange(1, int((length + n).max()))
        live = ends < (length + n)[:, None]
        start, end = np.maximum(ends - n[:, None], 0), np.minimum(ends, length[:, None])
        shared = np.zeros(live.shape, np.int32)
        for k in range(a.shape[1]):
            own = a == a[:, k : k + 1]
            first = (k < n) & ~own[:, :k].any(1)
            if not first.any():
                continue
            counts = np.zeros((first.sum(), b.shape[1] + 1), np.int32)
            np.cumsum(b[first] == a[first, k : k + 1], axis=1, out=counts[:, 1:])
            inside = np.take_along_axis(counts, end[first], 1) - np.take_along_axis(counts, np.minimum(start, end)[first], 1)
            shared[first] += np.minimum(inside, own[first].sum(1, dtype=np.int32)[:, None])
        size = end - np.minimum(start, end)
        bound = np.where(live, 200.0 * shared / np.maximum(n[:, None] + size, 1), -1.0)
        best = np.zeros(len(some))
        row, at = np.arange(len(some)), bound.argmax(1)
        while len(row):
            w = Spans(t.codes, t.start[row] + start[row, at], size[row, at])
            np.maximum.at(best, row, indel(s.take(row), w))
            bound[row, at] = -1.0
            # After the most promising window of each pair, all others that could still be better.
            row, at = np.nonzero(bound > best[:, None])
            bound[row, at] = -1.0 if len(row) else bound[row, at]
        out[some] = np.where(n > 0, best, 0.0)
    return out


def best_window(left: Spans, right: Spans) -> np.ndarray:
    """Best ratio of the shorter text against any window of the longer one; 0 when a side is empty."""
    _together(left, right)
    swap = left.size > right.size
    pick = lambda x, y: Spans(left.codes, np.where(swap, x.start, y.start), np.where(swap, x.size, y.size))
    short, long = pick(right, left), pick(left, right)
    out = _windows(short, long)
    even = np.flatnonzero((short.size == long.size) & (short.size > 0))
    out[even] = np.maximum(out[even], _windows(long.take(even), short.take(even)))
    return out


class Words(NamedTuple):
    """Words of a text: sorted and joined, as a set, and whether each stands once."""

    ordered: str
    all: frozenset[str]
    once: bool

    @classmethod
    def of(cls, words: list[str]) -> Words:
        found = frozenset(words)
        return cls(" ".join(sorted(words)), found, len(found) == len(words))


def _by_words(a: list[Words], b: list[Words]) -> np.ndarray:
    """Best ratio of each pair in any order of words, or of shared words against the rest."""
    left, right = coded([x.ordered for x in a], [y.ordered for y in b])
    total, common = left.size + right.size, subsequence(left, right)
    size = np.maximum(total, 1)
    # Without a shared or repeated word the sets are the ordered texts again, their ratio taken from the edits.
    best = np.where(total == 0, 100.0, np.maximum(200.0 * common / size, 100.0 * (1 - (total - 2 * common) / size)))
    some = [k for k, (x, y) in enumerate(zip(a, b)) if not (x.once and y.once and x.all.isdisjoint(y.all))]
    if some:
        best[some] = np.where(total[some] == 0, 100.0, 200.0 * common[some] / size[some])
    some = [k for k in some if a[k].all and b[k].all]
    if not some:
        return best
    less = lambda x, y: " ".join(sorted(x - y))
    only_a, only_b = coded([less(a[k].all, b[k].all) for k in some], [less(b[k].all, a[k].all) for k in some])
    both = [a[k].all & b[k].all for k in some]
    shared = np.array([sum(map(len, w)) + max(len(w) - 1, 0) for w in both], np.int64)
    gap = (shared > 0).astype(np.int64)
    size_a, size_b = shared + gap + only_a.size, shared + gap + only_b.size
    edits = only_a.size + only_b.size - 2 * subsequence(only_a, only_b)
    of_sets = 100.0 * (1 - edits / (size_a + size_b))
    for size in (size_a, size_b):
        of_sets = np.where(shared > 0, np.maximum(of_sets, 100.0 * 2 * shared / np.maximum(shared + size, 1)), of_sets)
    of_sets = np.where((shared > 0) & ((only_a.size == 0) | (only_b.size == 0)), 100.0, of_sets)
    best[some] = np.maximum(best[some], of_sets)
    return best


def _windows_by_words(a: list[Words], b: list[Words]) -> np.ndarray:
    """Best window ratio of each pair, words sorted, as they are and each once; 100 if they share a word."""
    out = np.full(len(a), 100.0)
    apart = np.array([x.all.isdisjoint(y.all) for x, y in zip(a, b)], bool)
    left, right = [x for x, k in zip(a, apart) if k], [x for x, k in zip(b, apart) if k]
    best = best_window(*coded([x.ordered for x in left], [y.ordered for y in right]))
    again = [k for k, (x, y) in enumerate(zip(left, right)) if not (x.once and y.once)]
    if again:
        once = lambda texts: [" ".join(sorted(texts[k].all)) for k in again]
        best[again] = np.maximum(best[again], best_window(*coded(once(left), once(right))))
    out[apart] = best
    return out


def weighted_ratio(left: list[str], right: list[str], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """0 to 100 for each pair of left[i] and right[j]: the best of the plain, word-order-free and window ratios, scaled down.

    Words are split once for each distinct text; for texts of one word each the other ratios follow from the plain ones.
    """
    spans = coded(left, right)
    a, b = spans[0].take(i), spans[1].take(j)
    best = indel(a, b)
    small, large = np.minimum(a.size, b.size), np.maximum(a.size, b.size)
    out = np.where(small > 0, best, 0.0)
    open_ = np.flatnonzero((small > 0) & ~((small == large) & (best == 100.0)))
    spread = large[open_] / small[open_]
    split = [[t.split() for t in texts] for texts in (left, right)]
    whole = [np.array([w == [t] for w, t in zip(ws, ts, strict=True)], bool) for ws, ts in zip(split, (left, right))]
    one = whole[0][i[open_]] & whole[1][j[open_]]
    words = [{k: Words.of(split[s][k]) for k in np.unique(at[open_[~one]]).tolist()} for s, at in ((0, i), (1, j))]
    lists = lambda some: ([words[0][k] for k in i[some].tolist()], [words[1][k] for k in j[some].tolist()])

    near = open_[(spread < 1.5) & ~one]
    if len(near):
        out[near] = np.maximum(out[near], 0.95 * _by_words(*lists(near)))
    far = spread >= 1.5
    for scale, some in ((0.9, far & (spread <= 8.0)), (0.6, far & (spread > 8.0))):
        at = open_[some]
        if len(at):
            out[at] = np.maximum(out[at], scale * best_window(a.take(at), b.take(at)))
        at = open_[some & ~one]
        if len(at):
            out[at] = np.maximum(out[at], 0.95 * scale * _windows_by_words(*lists(at)))
    return out


def _popular(right: Spans) -> np.ndarray:
    """Code points of each text that start no match, as one array of marks beside its code points."""
    marks = np.zeros(int(right.size.sum()), bool)
    at = np.cumsum(right.size) - right.size
    for k in np.flatnonzero(right.size >= POPULAR_FROM):
        codes = right.codes[right.start[k] : right.start[k] + right.size[k]]
        _, back, counts = np.unique(codes, return_inverse=True, return_counts=True)
        marks[at[k] : at[k] + len(codes)] = counts[back] > right.size[k] // POPULAR_SHARE + 1
    return marks


def sequence_ratio(left: Spans, right: Spans) -> np.ndarray:
    """0 to 1: twice the characters in matching blocks over both lengths; two empty texts are equal.

    The longest block comes first (of equals the earliest in the first text, then in the second), then those of the
    stretches before and behind it. All open stretches of all pairs are searched together, round by round.
    """
    _together(left, right)
    total = left.size + right.size
    matched = np.zeros(len(total), np.int64)
    popular = _popular(right)
    place = np.cumsum(right.size) - right.size
    pair = np.flatnonzero((left.size > 0) & (right.size > 0))
    lo_a, lo_b = np.zeros(len(pair), np.int64), np.zeros(len(pair), np.int64)
    hi_a, hi_b = left.size[pair].copy(), right.size[pair].copy()
    while len(pair):
        found = np.zeros((3, len(pair)), np.int64)  # start in either text, and size
        for some in _alike(hi_a - lo_a, hi_b - lo_b):
            p = pair[some]
            x = Spans(left.codes, left.start[p] + lo_a[some], hi_a[some] - lo_a[some])
            y = Spans(right.codes, right.start[p] + lo_b[some], hi_b[some] - lo_b[some])
            wide = lambda spans, fill: np.ascontiguousarray(spans.matrix(max(1, int(spans.size.max())), fill).T)
            marks = None
            if popular.any():
                own = Spans(popular, place[p] + lo_b[some], y.size)
                marks = wide(Spans(own.codes.astype(np.uint8), own.start, own.size), LEFT_FILL) == 1
            found[:, some] = _longest(wide(x, LEFT_FILL), wide(y, RIGHT_FILL), marks)
        size = found[2]
        np.add.at(matched, pair, size)
        at_a, at_b = lo_a + found[0], lo_b + found[1]
        hit = size > 0
        before = hit & (lo_a < at_a) & (lo_b < at_b)
        behind = hit & (at_a + size < hi_a) & (at_b + size < hi_b)
        pair, lo_a, hi_a, lo_b, hi_b = (
            np.concatenate((u[before], v[behind]))
            for u, v in ((pair, pair), (lo_a, at_a + size), (at_a, hi_a), (lo_b, at_b + size), (at_b, hi_b))
        )
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(total == 0, 1.0, 2.0 * matched / total)


def _longest(a: np.ndarray, b: np.ndarray, popular: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start in either text and size of the longest matching block of each pair; here a column is a pair."""
    pairs = np.arange(a.shape[1])
    small = np.uint8 if min(len(a), len(b)) < 255 else np.int32
    size, at_a, at_b = (np.zeros(a.shape[1], np.int64) for _ in range(3))
    run = np.zeros((len(b) + 1, a.shape[1]), small)
    for x in range(len(a)):
        fits = b == a[x]
        if popular is not None:
            fits &= ~popular
        run[1:] = (run[:-1] + small(1)) * fits
        longest = run.max(0)
        better = np.flatnonzero(longest > size)
        if len(better):
            size[better] = longest[better]
            at_a[better] = x + 1 - size[better]
            at_b[better] = run[:, better].argmax(0) - size[better]
    if popular is not None:  # characters that start no match may still lengthen one
        for step, edge in ((-1, lambda: (at_a - 1, at_b - 1)), (1, lambda: (at_a + size, at_b + size))):
            going = np.ones(len(pairs), bool)
            while going.any():
                u, v = edge()
                inside = (u >= 0) & (v >= 0) & (u < len(a)) & (v < len(b))
                going &= inside & (a[np.clip(u, 0, len(a) - 1), pairs] == b[np.clip(v, 0, len(b) - 1), pairs])
                size = size + going
                if step < 0:
                    at_a, at_b = at_a - going, at_b - going
    return at_a, at_b, size
