import math
import re
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import lexical as x, queries

SF = "/root/testdata/sf0.001"
TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def slow(docs, items, k=10):
    """Every document scored for every item, from the definition."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = [(i, TERM.findall((t or "").translate(lower))) for i, t in docs]
    n_docs, n_terms = sum(bool(w) for _, w in words), sum(len(w) for _, w in words)
    df = Counter(t for _, w in words for t in set(w))
    counted = [(i, w, Counter(w)) for i, w in words]
    out = []
    for item, text in items:
        ranked = []
        for i, w, tf in counted:
            score = 0
            for t in set(TERM.findall((text or "").translate(lower))):
                if tf[t]:
                    weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += weight * (10 ** 9 * tf[t] // (1000 * tf[t] + 8 * (10 + 90 * len(w) * n_docs // n_terms)))
            if score > 0:
                ranked.append((-score, i is None, i or 0))
        out += [(item, rank + 1, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(ranked)[:k])]
    return sorted(out, key=str)


def rows(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def test_whole_table_against_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert rows(queries.op13_lexical(spark, SF)) == slow(docs, items)


@pytest.mark.parametrize("block", [1, 2, 256])
def test_cases(spark, block):
    docs = [(1, "Apple pie"), (2, "apple PIE"), (None, "apple pie"), (2, "apple"), (5, None), (6, ""), (7, " ., "), (8, "Äpfel äpfel"),
            (9, "pie " * 30000 + "rare"), (10, "other words"), (-3, "apple, pie")]
    items = [(1, "Apple-pie!"), (1, "äpfel"), (None, "RARE"), (4, None), (5, "?"), (6, "unknown"), (7, "pie pie apple Äpfel")]
    a = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, score int").repartition(3)
    b = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, doc_id string")
    assert rows(x.search(a, b, block=block)) == slow(docs, items)
    assert rows(x.search(a, b, k=2, block=block)) == slow(docs, items, 2)
    assert x.search(a.limit(0), b).count() == x.search(a, b.limit(0)).count() == 0


def test_ties_repeated_rows_and_small_indexes(spark, monkeypatch):
    monkeypatch.setattr(x, "BLOCK", 3)
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(60)]
    docs = [(i % 150, " ".join(rng.choice(vocabulary, rng.integers(1, 12)))) for i in range(400)] + [(900 + i, "w1 w2 w3") for i in range(80)]
    items = [(i, " ".join(rng.choice(vocabulary, 5))) for i in range(40)] + [(99, "w1 w2 w3")]
    a = spark.createDataFrame(docs, "doc_id long, text string").coalesce(2)
    assert rows(x.search(a, spark.createDataFrame(items, "item_id long, text string"))) == slow(docs, items)


def test_bounds_hold_and_most_blocks_are_skipped(spark):
    """On the given table: no document scores above its block's bound, and blocks are both scored and skipped."""
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    _, items = next(x.item_blocks((i, r.text) for i, r in enumerate(spark.read.parquet(f"{SF}/benchmark.parquet").collect())))
    w = np.zeros((len(docs), len(items.vocabulary)), np.int64)
    for i, t in enumerate(docs):
        for word, n in Counter(x.terms(t)).items():
            if word in items.vocabulary:
                w[i, items.vocabulary[word]] = 1000 * n // (n + 3)
    index = x.Index(w, items, np.arange(len(docs)), np.zeros(len(docs), bool))
    scored = blocks = 0
    for item, asked in enumerate(items.asked):
        exact = w[:, asked].sum(axis=1)
        for bound, members in zip(*index.bounds(item)):
            assert 0 < len(members) <= x.BLOCK and exact[members].max() <= bound
        best = x.Best(10)
        a, b = index.search(item, best)
        assert list(best.ids) == list(np.lexsort((np.arange(len(docs)), -exact))[:len(best.ids)])
        scored, blocks = scored + a, blocks + b
    assert 0 < scored < 0.8 * blocks
