"""The training-data operators against brute force on small tables with odd rows."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from concord.llm import decontaminate, imatch, jaccard, licenses, pieces, quality, sharding, substrings, suffix, tokens, urls
from concord.llm.components import least_reached, roots
from concord.llm.words import SPACED, shingles, text_bytes, words

ODD = [
    (None, "one two three four five six"), (1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, "one two three four five six"),
    (5, "one two three four five six"), (6, "Ünïcode ﬁ 😀 \x00 <|endoftext|> ▁ x▁ y"), (7, "long " * 30_000), (8, "a" * 70_000),
]


def prose(n: int, seed: int = 3) -> list[tuple[int, str]]:
    """Documents of random words with copies, near copies and shared passages."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choices(vocabulary, k=60))
    out: list[str] = []
    for i in range(n):
        kind = rng.random()
        if out and kind < 0.15:
            out.append(rng.choice(out))
        elif out and kind < 0.5:
            old = rng.choice(out).split(" ")
            for _ in range(rng.randint(1, 4)):
                old[rng.randrange(len(old))] = rng.choice(vocabulary)
            out.append(" ".join(old))
        else:
            words = rng.choices(vocabulary, k=rng.randint(1, 90))
            out.append(" ".join(words) + (" " + passage if kind > 0.9 else ""))
    return [(100 + i, t) for i, t in enumerate(out)]


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


@pytest.fixture(scope="module")
def mixed(docs_of):
    rows = ODD + prose(120)
    return rows, docs_of(rows)


@pytest.fixture(scope="module")
def empty(docs_of, mixed):
    return mixed[1].limit(0)


def test_least_reached():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n, m = rng.integers(1, 40), rng.integers(0, 40)
        a, b = rng.integers(0, n, m), rng.integers(0, n, m)
        want = list(range(n))
        for _ in range(n):
            for x, y in zip(a, b):
                want[x] = want[y] = min(want[x], want[y])
        assert least_reached(a, b, n).tolist() == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7), (100, 101)]
    found = {r.node: r.root for r in roots(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}


@pytest.mark.parametrize(("size", "num"), [(3, 90), (5, 80), (2, 50)])
def test_jaccard(mixed, size, num):
    rows, docs = mixed
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    group = list(range(len(rows)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in enumerate(sets):
        for k, b in enumerate(sets[:i]):
            if a and 100 * len(a & b) >= num * len(a | b):
                group[find(i)] = find(k)
    least: dict = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    want = Counter((r[0], len(s), least.get(find(i), r[0]) if s else r[0]) for i, (r, s) in enumerate(zip(rows, sets, strict=True)))
    got = jaccard.jaccard_groups(docs, size, num, 100).drop("node").collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want


@pytest.mark.parametrize(("size", "num"), [(5, 80)])
def test_jaccard_of_large_groups(mixed, size, num, monkeypatch):
    """Groups too large for one task are compared by joins, with the same result."""
    monkeypatch.setattr(jaccard, "GROUP_MEMBERS", 1)
    test_jaccard(mixed, size, num)


def test_frequent_passages_tie_no_documents(docs_of):
    """Documents that have nothing but one passage in common hardly ever meet; near copies among them do."""
    rng = random.Random(6)
    passage = " ".join(rng.choices("abcdefghijklmnop", k=30))
    rows = [(i, " ".join(f"{i}x{k}" for k in range(60)) + " " + passage) for i in range(200)]
    rows += [(1000 + i, t.replace(f"{i}x0 ", "other ")) for i, t in rows[:20]]
    docs = docs_of(rows).select("doc_id", "text")
    levels, counts = jaccard.Levels(80, 100), jaccard._token_counts(docs, 5)
    tied = {(r.a, r.b) for r in jaccard._neighbours(docs, 5, levels, counts).collect()}
    assert tied >= {(1000 + i, i) for i in range(20)} and len(tied) < 40
    assert jaccard._neighbours(docs, 5, levels, np.zeros_like(counts)).count() > 100
    groups = {r.doc_id: r.component_id for r in jaccard.jaccard_groups(docs, size=5, num=80).collect()}
    assert groups == {i: i % 1000 for i, _ in rows}


def test_suffix_array():
    rng = random.Random(1)
    for _ in range(200):
        text = np.array([rng.randint(0, rng.choice([1, 2, 200])) for _ in range(rng.randint(0, 50))], np.uint8)
        body = text.tobytes()
        order = sorted(range(len(body)), key=lambda i: body[i:])
        assert suffix.suffix_array(text).tolist() == order


@pytest.mark.parametrize("length", [50, 100])
def test_substrings(mixed, length):
    rows, docs = mixed
    late = float("inf")
    texts = [(late if i is None else i, (t or "").encode()) for i, t in rows]
    first: dict[bytes, float] = {}
    for i, b in texts:
        for k in range(len(b) - length + 1):
            first[b[k : k + length]] = min(first.get(b[k : k + length], late), i)
    want = []
    for i, b in texts:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < i:
                gone[k : k + length] = True
        spans = int((gone & ~np.concatenate(([False], gone[:-1]))).sum()) if len(b) else 0
        want.append((None if i == late else i, len(b), int(gone.sum()), spans, np.frombuffer(b, np.uint8)[~gone].tobytes()))
    got = substrings.without_repeats(docs, length, carry=["lang", "a.b"]).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == Counter(want)
    assert {(r["rest"]["c0"], r["rest"]["c1"]) for r in got} == {("en", "y")}


def test_suffix_arrays_stay_small(monkeypatch):
    """However many fragments a shard or one anchor has, no suffix array is built over more than some bytes."""
    rng, length, seen = random.Random(7), 20, []
    monkeypatch.setattr(substrings, "SORT_BYTES", 1500)
    monkeypatch.setattr(substrings, "STRING_SLOTS", 1 << 12)
    monkeypatch.setattr(substrings, "suffix_array", lambda x: seen.append(len(x)) or suffix.suffix_array(x))
    shared = "".join(rng.choices("abcd", k=30))
    for hot in (0, 5, 400):
        found = [(0, "".join(rng.choices("ab", k=rng.randint(0, 4))) + shared + "".join(rng.choices("ab", k=3))) for _ in range(hot)]
        found += [(a, "".join(rng.choices(f"{a % 10}x", k=rng.randint(length, 40)))) for a in range(1, 60) for _ in range(rng.randint(1, 9))]
        least = [rng.randrange(1000) for _ in found]
        want: dict = {}
        for (a, s), i in zip(found, least, strict=True):
            for k in range(len(s) - length + 1):
                want[a, s[k : k + length]] = min(want.get((a, s[k : k + length]), i), i)
        text = np.frombuffer("".join(s for _, s in found).encode(), np.uint8)
        anchor, size = (np.array(x) for x in zip(*((a, len(s)) for a, s in found), strict=True))
        got = substrings._least_ids(text, anchor, size, np.array(least), length)
        assert got.tolist() == [want[a, s[k : k + length]] for a, s in found for k in range(len(s) - length + 1)]
    assert max(seen) <= 1500
    alike = substrings._least_of_alike(np.frombuffer(b"abcabdabc", np.uint8), np.array([0, 3, 6, 3]), np.array([5, 9, 4, 8]), 3, 2)
    assert alike.tolist() == [4, 8, 4, 8]
    assert substrings._least_ids(text[:0], anchor[:0], size[:0], np.zeros(0, np.int64), length).tolist() == []


def test_token_counts(mixed):
    from tokenizers import Tokenizer

    rows, docs = mixed
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    want = Counter((i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    got = tokens.token_counts(docs, path, public_tokenizers.PATTERN).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 1024) for r in got)


def test_pieces(mixed):
    from sentencepiece import SentencePieceProcessor

    rows, docs = mixed
    path = public_tokenizers.path("piece_bpe_32k.model")
    library = SentencePieceProcessor(model_file=path)
    got = pieces.decode(pieces.encode(docs, path), path).collect()
    want = Counter((i, tuple(library.encode(t or "")), library.decode(library.encode(t or ""))) for i, t in rows)
    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in got) == want


def test_containment(spark, docs_of):
    rows = prose(60, 9)
    items = [(i, " ".join(t.split(" ")[:30])) for i, t in rows[:20]] + [(900, None), (901, ""), (902, "w1 w2"), (903, "W1, w2!")]
    docs = rows + [(1, "x w1 w2 y"), (2, None), (3, "")]
    got = decontaminate.contained(docs_of(docs), spark.createDataFrame(items, "item_id long, text string")).collect()

    def sets(text, size):
        w = licenses.WORD.findall(lower(text or ""))
        return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}

    want = {}
    for j, item in items:
        n = min(5, len(licenses.WORD.findall(lower(item or ""))))
        own = sets(item, n) if n else set()
        for i, text in docs:
            both = len(own & sets(text, n)) if own else 0
            if own and 100 * both >= 80 * len(own):
                want[i, j] = (len(own), both)
    assert {(r.doc_id, r.item_id): (r.n_shingles, r.n_shared) for r in got} == want


def test_texts_alone_in_a_slice(spark):
    """A slice of one short text is worked out like the same text among others."""
    texts = ["a b c d e f"[:n] for n in range(0, 12)]
    for size in (2, 3, 5, 9):
        data, offsets = text_bytes(pa.array(texts))
        together = [s.tolist() for s in shingles(words(data, offsets, SPACED), size)]
        for text, want in zip(texts, together, strict=True):
            found = words(*text_bytes(pa.array([text])), SPACED)
            assert [s.tolist() for s in shingles(found, size)] == [want]
            assert decontaminate._runs(found, size)[1].sum() == max(0, len(text.split()) - size + 1)

    rows = [(n, " ".join("abcdef"[:n])) for n in range(1, 7)]
    alone = spark.createDataFrame(spark.sparkContext.parallelize(rows, len(rows)), "doc_id long, text string")
    assert [len(p) for p in alone.rdd.glom().collect()] == [1] * len(rows)
    items = alone.withColumnRenamed("doc_id", "item_id")
    held = {(r.doc_id, r.item_id) for r in decontaminate.contained(alone, items).collect()}
    assert held == {(d, i) for d in range(1, 7) for i in range(1, d + 1) if i < 6 or d == 6}
    groups = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_groups(alone, size=5).collect()}
    assert groups == {n: (max(1, n - 4), n) for n in range(1, 7)}


def test_licenses(docs_of):
    rows = [
        (1, "Relesed under teh MIT License."), (2, "Licensed under CC BY-NC 4"), (3, "the GNU General\nPublic License"), (4, None),
        (5, "mitlicense"), (6, "Released under the MXT Lcense today"), (7, "apache license apache license"),
    ]
    got = {r.doc_id: r for r in licenses.license_scan(docs_of(rows)).collect()}
    assert (got[1].n_base, got[1].first_word, got[1].labels) == (1, 3, "mit")
    assert got[2].labels == "cc-by,cc-by-nc" and got[2].base_labels == "cc-by"
    assert got[3].n_words == 5 and got[3].labels == "gpl"
    assert (got[4].n_words, got[4].labels, got[4].score, got[4].first_word) == (0, "", 0.0, None)
    assert got[5].labels == "" and got[6].labels == "mit" and got[6].base_labels == "" and 0 < got[6].score < 1
    assert (got[7].n_base, got[7].first_word, got[7].last_word) == (2, 0, 2)


def test_fuzzy_seeds_lose_nothing():
    """Every text within the allowed edits of a notice holds one of its seeds, and is found."""
    rng = random.Random(5)
    for _ in range(300):
        notice = rng.choice(licenses.NOTICES)
        text = list(notice.text)
        for _ in range(rng.randint(0, notice.errors)):
            at = rng.randrange(len(text))
            text[at : at + 1] = rng.choice([[], [rng.choice("abc ")], [text[at], rng.choice("abc ")]])
        line = " x y " + "".join(text) + " z "
        assert any(s in line for _, s in licenses.seeds(notice))
        assert notice.label in {s[0] for s in licenses.fuzzy_spans(line)}


def test_fingerprints(docs_of):
    rows = prose(80, 4) + [(None, "null id"), (1, None), (2, ""), (90, "same text"), (91, "same text")]
    got = imatch.fingerprints(docs_of(rows)).collect()
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    want = {}
    for k, (i, text) in enumerate(order):
        edit = imatch.edited(text or "", order[(k + 1) % len(order)][1] or "")
        want[i] = (len(text or ""), hashlib.sha256(edit.encode()).hexdigest())
    assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in got} == want and len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[90].fingerprint == by[91].fingerprint and by[91].near_next == 1.0
    assert all(0 <= x <= 1 for r in got for x in (r.near_edited, r.near_next))


def test_quality(spark, docs_of):
    rng = random.Random(2)
    rows, marks = [], []
    for i in range(600):
        good = rng.random() < 0.7
        words = [rng.choice(["the", "house", "on", "hill", "was", "seen", "from", "afar"]) + rng.choice("abcdefgh") for _ in range(40)]
        rows.append((i, " ".join(words) if good else " ".join(w.upper() + "!!" for w in words)))
        marks.append((i, int(good)))
    rows += [(None, "a"), (1000, None), (1001, "")]
    labels = spark.createDataFrame([*marks, (None, 1), (5000, None)], "doc_id long, quality int")
    got = quality.quality_scores(docs_of(rows), labels).collect()
    told = dict(marks)
    held = [r for r in got if r.held_out and r.doc_id in told]
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert sum(r.predicted == told[r.doc_id] for r in held) >= 0.95 * len(held)
    assert quality.quality_scores(docs_of(rows), labels.limit(0)).where("score != 0.5").count() == 0


def test_sharding(docs_of, mixed):
    names = [f"s{i}" for i in range(7)]
    table = sharding.fill(names, 1009)
    shares = Counter(table)
    assert max(shares.values()) - min(shares.values()) <= 1
    moved = sum(a != b for a, b in zip(table, sharding.fill(names[:-1], 1009), strict=True))
    assert moved < 2 * 1009 / 7
    rows, docs = mixed
    got = sharding.place(docs, "doc_id", names, 1009).collect()
    assert len(got) == len(rows) and all(table[r.slot] == r.shard for r in got)


def test_urls(spark):
    rows = [
        (1, "http://Sub.ORG/a"), (2, "https://example.org/es/1"), (3, "x://example.org/en/17?q"), (4, None), (5, "no scheme"),
        (6, "http://a.com/fr/x#t"), (7, "http://a.com/de/y"), (8, "http://a.com/de/y"), (None, "http://net"), (9, "http://b.net?x://y/z"),
    ]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert len(got) == 10
    rules = {1: "org/", 2: "example.org/es/", 3: "example.org/en/1", 4: None, 5: None, 6: "com/fr/", 7: "com/de/", 8: "com/de/", 9: None}
    assert {i: got[i].rule for i in rules} == rules
    assert (got[3].host, got[3].path, got[4].host, got[9].host, got[9].path) == ("example.org", "/en/17", "", "b.net", "")
    assert got[2].verdict == "block" and got[1].verdict == "allow" and got[None].verdict in ("allow", "block")


def plain_templates(pages):
    """Template and share of (host, path, ruled) pages, one segment after the other."""
    labels = [r for _, _, r in pages if r]
    prior = labels.count("allow") / len(labels) if labels else 0.5
    out = {}

    def descend(group, prefix, held):
        """``group``: the segments not looked at yet and ruling of each page number."""
        own = [r for _, r in group.values() if r]
        held = (len(own), own.count("allow")) if own and prefix else held
        for i in [i for i, (rest, _) in group.items() if not rest]:
            out[i] = (prefix, (held[1] + urls.PRIOR_WEIGHT * prior) / (held[0] + urls.PRIOR_WEIGHT))
        group = {i: g for i, g in group.items() if g[0]}
        nodes: dict = {}
        for segment in {rest[0] for rest, _ in group.values()}:
            mine = [r for rest, r in group.values() if rest[0] == segment]
            a, b = [r for r in mine if r], [r for rest, r in group.values() if r and rest[0] != segment]
            node = "*"
            if a and b and not (len(mine) == 1 and len(group) >= urls.MANY_SIBLINGS):
                p = (a + b).count("allow") / len(a + b)
                apart = a.count("allow") / len(a) - b.count("allow") / len(b)
                if apart * apart > urls.STANDARD_ERRORS ** 2 * p * (1 - p) * (1 / len(a) + 1 / len(b)):
                    node = segment
            node = "" if prefix and segment == "" else node
            nodes.setdefault(node, {}).update({i: (rest[1:], r) for i, (rest, r) in group.items() if rest[0] == segment})
        for node, under in nodes.items():
            descend(under, f"{prefix}/{node}", held)

    trees: dict = {}
    for i, (host, path, ruled) in enumerate(pages):
        segments = [re.sub(".*[0-9].*", "*", s) for s in path[1:].split("/")]
        trees.setdefault((host, tuple(map(bool, segments[1:]))), {})[i] = (segments, ruled)
    for group in trees.values():
        descend(group, "", (0, 0))
    return out


def test_url_tree(spark):
    """Every depth of the tree against a plain descent; word slugs below the first segment are generalised."""
    rng = random.Random(8)
    words = ["fr", "de", "es", "en", "blog", "news", "", "1a", "2b", "x", "y"]
    tails = [[], ["x"], ["y"], ["x", "y"], ["x", "x", "y"], ["y", ""], ["", "x"]]
    found = []
    for i in range(900):
        host = rng.choice(["a.com", "b.com", "c.example.org", "example.org", "d.net"])
        first, second = rng.choice(words), rng.choice([*words, f"slug{'abcdefgh'[i % 8]}{'ijklmnop'[i // 8 % 8]}"])
        found.append((host, "/" + "/".join([first, second][: rng.randint(1, 2)] + rng.choice(tails))))
    # Under /en/ of one host blocked pages end in x and allowed ones in y: they part at the third and fourth segment.
    found += [("e.example.org", f"/en/{n}{i}/{end}") for i in range(15) for n, end in ((1, "bad"), (2, "good"), (1, "z/bad"), (2, "z/good"))]
    # Slugs are seen once each; those without a rule are judged by the labelled ones beside them.
    slugs = ["".join(rng.choices("abcdefgh", k=9)) for _ in range(60)]
    found += [("f.com", f"/{'de' if i % 2 else 'blog'}/{s}") for i, s in enumerate(slugs)]
    rows = [(i, f"http://{h}{p}") for i, (h, p) in enumerate(found)]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    ruled = [(h, p, got[i].verdict if got[i].rule else None) for i, (h, p) in enumerate(found)]
    want = plain_templates(ruled)
    assert {i: got[i].template for i in got} == {i: t for i, (t, _) in want.items()}
    assert all(abs(got[i].share - s) < 1e-9 for i, (_, s) in want.items())
    at = {p: got[i] for i, (h, p) in enumerate(found) if h in ("e.example.org", "f.com")}
    assert at["/en/10/bad"].template == "/*/*/bad" and at["/en/20/z/good"].template == "/*/*/*/good"
    assert {at[f"/blog/{s}"].template for s in slugs[::2]} == {"/*/*"} and {at[f"/blog/{s}"].verdict for s in slugs[::2]} == {"block"}


def test_empty_tables(spark, empty):
    path = public_tokenizers.path
    items = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    for frame in (
        jaccard.jaccard_groups(empty), substrings.without_repeats(empty), imatch.fingerprints(empty), licenses.license_scan(empty),
        tokens.token_counts(empty, path("byte_bpe_50k.json"), public_tokenizers.PATTERN), decontaminate.contained(empty, items),
        pieces.encode(empty, path("piece_bpe_32k.model")), quality.quality_scores(empty, labels),
        sharding.place(empty, "doc_id", ["a"], 101), urls.judge(spark.createDataFrame([], "page_id long, url string")),
    ):
        assert frame.collect() == []
