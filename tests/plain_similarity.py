"""The three similarities a pair at a time, plainly: what the kernels are held against."""

from __future__ import annotations

from difflib import SequenceMatcher

# Fixed values of the Winkler variant: the prefix counts only above this plain score.
BOOST_ABOVE = 0.7
PREFIX_WEIGHT = 0.1
PREFIX_MAX = 4


def jaro(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken = [False] * len(b)
    hits_a = []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == ch:
                taken[j] = True
                hits_a.append(ch)
                break
    m = len(hits_a)
    if m == 0:
        return 0.0
    hits_b = [ch for ch, t in zip(b, taken) if t]
    swaps = sum(x != y for x, y in zip(hits_a, hits_b)) // 2
    return (m / len(a) + m / len(b) + (m - swaps) / m) / 3.0


def jaro_winkler_pair(a: str, b: str) -> float:
    score = jaro(a, b)
    if score > BOOST_ABOVE:
        prefix = 0
        for x, y in zip(a[:PREFIX_MAX], b[:PREFIX_MAX]):
            if x != y:
                break
            prefix += 1
        score += prefix * PREFIX_WEIGHT * (1.0 - score)
    return score


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, one machine word per row of the table."""
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & where.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def indel_ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 100.0 if total == 0 else 200.0 * common_subsequence(a, b) / total


def best_window_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter text against any window of the longer one."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    n = len(short)
    if n == 0:
        return 0.0
    if short in long:
        return 100.0
    ends = [long[:k] for k in range(1, n)] + [long[-k:] for k in range(1, n)]
    windows = set(ends) | {long[i : i + n] for i in range(len(long) - n + 1)}
    best = max(indel_ratio(short, w) for w in windows)
    if len(long) == n:
        best = max(best, max(indel_ratio(long, w) for w in [short[:k] for k in range(1, n + 1)] + [short[-k:] for k in range(1, n)]))
    return best


def _token_ratio(a: str, b: str) -> float:
    words_a, words_b = a.split(), b.split()
    ordered = indel_ratio(" ".join(sorted(words_a)), " ".join(sorted(words_b)))
    set_a, set_b = set(words_a), set(words_b)
    if not set_a or not set_b:
        return ordered
    both = set_a & set_b
    only_a, only_b = " ".join(sorted(set_a - both)), " ".join(sorted(set_b - both))
    if both and (not only_a or not only_b):
        return 100.0
    shared = len(" ".join(both))
    gap = 1 if shared else 0
    len_a, len_b = shared + gap + len(only_a), shared + gap + len(only_b)
    edits = len(only_a) + len(only_b) - 2 * common_subsequence(only_a, only_b)
    best = 100.0 * (1 - edits / (len_a + len_b))
    if shared:
        best = max(best, 100.0 * 2 * shared / (shared + len_a), 100.0 * 2 * shared / (shared + len_b))
    return max(ordered, best)


def _token_window_ratio(a: str, b: str) -> float:
    words_a, words_b = a.split(), b.split()
    set_a, set_b = set(words_a), set(words_b)
    both = set_a & set_b
    if both:
        return 100.0
    best = best_window_ratio(" ".join(sorted(words_a)), " ".join(sorted(words_b)))
    if len(words_a) == len(set_a) and len(words_b) == len(set_b):
        return best
    return max(best, best_window_ratio(" ".join(sorted(set_a)), " ".join(sorted(set_b))))


def weighted_ratio_pair(a: str, b: str) -> float:
    """0 to 100: the best of the plain, word-order-free and window ratios, each scaled down."""
    if not a or not b:
        return 0.0
    if a == b:
        return 100.0
    plain = indel_ratio(a, b)
    spread = max(len(a), len(b)) / min(len(a), len(b))
    if spread < 1.5:
        return max(plain, 0.95 * _token_ratio(a, b))
    scale = 0.9 if spread <= 8.0 else 0.6
    return max(plain, scale * best_window_ratio(a, b), 0.95 * scale * _token_window_ratio(a, b))


def sequence_ratio_pair(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    return SequenceMatcher(None, a, b).ratio()
