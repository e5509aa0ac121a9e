"""Registered queries beside their SQL, and the pipeline beside a plain version of its stages."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from concord.llm import quality, queries
from tests.compare import connect, plain
from tests.llm.test_operators import lower, prose

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.CHECKS))
def test_against_sql(spark, name):
    got = queries.QUERIES[name](spark, SMALL)
    want = connect(SMALL).sql(queries.CHECKS[name])
    assert sorted(got.columns) == sorted(want.columns)
    mine = Counter(tuple(plain(r[c]) for c in want.columns) for r in got.collect())
    assert mine and mine == Counter(tuple(map(plain, r)) for r in want.fetchall())


def shingles(text: str, size: int, pattern: str) -> set[tuple[str, ...]]:
    words = re.findall(pattern, lower(text))
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def one_of_each_group(rows: dict[int, str]) -> dict[int, str]:
    sets = {i: shingles(t, 5, r"[^\x20\x09-\x0D]+") for i, t in rows.items()}
    group = {i: i for i in rows}
    for a in sorted(rows):
        for b in sorted(rows):
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((group[a], group[b]))
                group = {i: low if g == high else g for i, g in group.items()}
    return {i: t for i, t in rows.items() if group[i] == i}


def without_passages(rows: dict[int, str], long: int) -> dict[int, str]:
    first: dict[bytes, int] = {}
    bodies = {i: t.encode() for i, t in rows.items()}
    for i in sorted(bodies):
        for k in range(len(bodies[i]) - long + 1):
            first.setdefault(bodies[i][k : k + long], i)
    out = {}
    for i, body in bodies.items():
        kept = np.ones(len(body), bool)
        for k in range(len(body) - long + 1):
            if first[body[k : k + long]] < i:
                kept[k : k + long] = False
        out[i] = bytes(np.frombuffer(body, np.uint8)[kept]).decode()
    return out


def holds_item(text: str, items: list[str]) -> bool:
    word = r"[0-9a-z]+"
    for item in items:
        size = min(5, len(re.findall(word, lower(item))))
        own = shingles(item, size, word)
        if own and 100 * len(own & shingles(text, size, word)) >= 80 * len(own):
            return True
    return False


def test_pipeline(spark, tmp_path):
    from sentencepiece import SentencePieceProcessor

    texts = dict(prose(150, 12)) | {1: "", 2: "BUY!!! NOW$$$ " * 30, 3: "WIN!!! CASH$$$ " * 20}
    items = [" ".join(texts[i].split(" ")[5:20]) for i in (110, 130, 140)] + [""]
    docs = spark.createDataFrame(
        [(i, t, "en", "web", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long"
    ).repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int(i > 99), 0) for i in texts]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    scored = quality.quality_scores(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    good = {r.doc_id for r in scored.where(F.col("predicted") == 1).collect()}
    assert len(good & set(range(100, 250))) > 120
    alone = one_of_each_group({i: t for i, t in texts.items() if i in good})
    cut = without_passages(alone, corpus_pipeline.PASSAGE)
    clean = {i: t for i, t in cut.items() if not holds_item(t, items)}
    assert len(good) > len(alone) > len(clean) > 0 and cut != alone
    model = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = {i: (ids := tuple(model.encode(t)), len(ids), model.decode(list(ids))) for i, t in clean.items()}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(got) == len(want)
    assert {r.doc_id: (tuple(r.ids), r.n_tokens, r.decoded) for r in got} == want
