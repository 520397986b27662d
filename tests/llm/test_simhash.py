import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from tidemark.llm import common, queries, simhash as sh

SF = "/root/testdata/sf0.001"
rnd = random.Random(11)


def slow_fingerprint(text, k=3):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    shingles = [" ".join(w[i:i + k]) for i in range(len(w) - k + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows, max_bits=3):
    """Per row its fingerprint and the smallest id in its component, over all pairs."""
    fps = [slow_fingerprint(t) for _, t in rows]
    comp = list(range(len(rows)))

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= max_bits:
                comp[max(find(i), find(j))] = min(find(i), find(j))
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)].append(d)
    return sorted(((d, f"{fps[i]:016x}", min(least[find(i)], default=None)) for i, (d, _) in enumerate(rows)), key=str)


def copies(n, words, edits):
    base = [f"w{rnd.randrange(500)}" for _ in range(words)]
    for _ in range(n):
        w = base[:]
        for _ in range(rnd.randrange(edits)):
            w[rnd.randrange(words)] = f"e{rnd.randrange(99)}"
        yield " ".join(w)


TEXTS = [None, "", " \t\n", "a", "A", "a b", "a b c", "A  B\tC", "a b c d", "É É é", "x\x1cy z", "İ ß",
         *copies(40, 120, 8), *copies(40, 60, 4), "word " * 5000, "word " * 5001]


@pytest.mark.parametrize("text", TEXTS[:14] + TEXTS[-2:])
def test_fingerprint(text):
    assert sh.fingerprint(text) == slow_fingerprint(text)


def test_matches_brute_force(spark):
    rows = [*enumerate(TEXTS, 5), (None, TEXTS[20]), (None, "only one without id"), (3, "a b c"), (3, "a b c")]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, fp int, root int").repartition(4)
    got = sorted((tuple(r) for r in sh.near_duplicates(df).collect()), key=str)
    assert got == brute(rows)


def test_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in queries.op2_simhash(spark, SF).collect()), key=str) == brute(rows)


def cluster(n, spread):
    base = rnd.getrandbits(64)
    return [base ^ sum({1 << rnd.randrange(64) for _ in range(rnd.randrange(spread + 1))}) for _ in range(n)]


def all_components(fps):
    """Components over all pairs, in numpy."""
    fps = np.array(fps, np.uint64)
    label = np.arange(len(fps))
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    while True:
        new = np.where(near, label[None, :], len(fps)).min(axis=1)
        if (new == label).all():
            return label
        label = new


def grouping(keys, labels):
    out = defaultdict(set)
    for k, v in zip(keys, labels):
        out[v].add(k)
    return sorted(map(sorted, out.values()))


@pytest.mark.parametrize("fps", [cluster(700, 9), cluster(600, 5) + cluster(300, 12), [rnd.getrandbits(64) for _ in range(500)],
                                 list(range(600)), cluster(17, 3), cluster(16, 9)], ids=range(6))
def test_gray_index_finds_every_component(fps):
    fps = sorted(set(fps))
    index = sh.GrayIndex(np.array(fps, np.uint64))
    got = index.components(3)
    assert grouping(index.fps.tolist(), got) == grouping(fps, all_components(fps))


@pytest.mark.parametrize("part", range(4))
def test_gray_index_of_a_field(part):
    """Every pair that agrees in the field is in one component; no component holds texts that all pairs leave apart."""
    field = sh.fields(0, 4)[part]
    fps = np.array(sorted(set(cluster(700, 9) + cluster(300, 4) + [rnd.getrandbits(64) for _ in range(500)])), np.uint64)
    index = sh.GrayIndex(fps, field)
    rank = sh.gray_rank(index.fps & np.uint64(field))
    assert (np.diff(rank.astype(float)) >= 0).all()  # top nodes lie together
    label = index.components(3)
    x, y = np.triu_indices(len(fps), 1)
    bits = index.fps[x] ^ index.fps[y]
    near = (np.bitwise_count(bits) <= 3) & (bits & np.uint64(field) == 0)
    assert near.any() and (label[x[near]] == label[y[near]]).all()
    whole = dict(zip(fps.tolist(), all_components(fps)))
    assert all(whole[a] == whole[b] for a, b in zip(index.fps.tolist(), index.fps[label].tolist()))


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_the_index_decides_on_the_given_tables(spark, sf):
    """The four Gray orders find every link of all pairs, with few leaves compared."""
    docs = spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet")
    fps = np.array([r.fp for r in sh.fingerprints(docs).select("fp").distinct().collect()], np.int64).view(np.uint64)
    label, at = np.arange(len(fps)), {int(f): i for i, f in enumerate(fps)}
    for field in sh.fields(0, 4):
        index = sh.GrayIndex(fps, field)
        own = index.components(3)
        label = sh._join(label, *(np.array([at[int(f)] for f in x]) for x in (index.fps, index.fps[own])))
        leaves = len(index.levels[0][0])
        assert all(index.seen.values()) and index.seen["compared"] < 8 * leaves
        assert index.seen["pruned"] > index.seen["visited"] / 2
    true = np.arange(len(fps))
    for i in range(0, len(fps), 500):
        x, y = np.nonzero(np.bitwise_count(fps[i:i + 500, None] ^ fps[None, :]) <= 3)
        true = sh._join(true, x + i, y)
    assert grouping(fps.tolist(), label) == grouping(fps.tolist(), true)


@pytest.mark.parametrize("max_index", [1, 300])
def test_ranges_of_the_order_in_small_indexes(spark, max_index):
    fps = sorted(set(cluster(500, 6) + cluster(200, 9)))
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    (rows,) = sh.top_nodes(spark.createDataFrame([(f,) for f in signed], "fp long"))
    root = {r.node: r.root for r in sh.components(sh.forest(rows, max_index=max_index)).collect()}
    assert grouping(signed, [root.get(f, f) for f in signed]) == grouping(signed, all_components(fps))


@pytest.mark.parametrize("max_group", [1 << 16, 256])
def test_divided_top_nodes_lose_no_link(spark, max_group):
    """Hot top nodes are divided again; the components stay those of all pairs."""
    fps = sorted(set(cluster(900, 6) + cluster(200, 9) + list(range(100))))
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    tables = sh.top_nodes(df, max_group=max_group)
    assert len(tables) == 1 if max_group > 256 else len(tables) > 1
    for t in tables:
        assert t.groupBy("mask", "value").count().where(f"count > {max_group}").isEmpty()
    links = None
    for t in tables:
        links = sh.forest(t) if links is None else links.union(sh.forest(t))
    root = {r.node: r.root for r in sh.components(links).collect()}
    assert grouping(signed, [root.get(f, f) for f in signed]) == grouping(signed, all_components(fps))


def test_components_of_a_long_chain(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (7, 7)], "u long, v long")
    root = {r.node: r.root for r in sh.components(df).collect()}
    assert root == {i: 0 for i in range(301)} | {1000: 1000, 1001: 1000}


def test_documents_are_not_shuffled(make_docs, monkeypatch):
    docs = make_docs([(i, f"text number {i % 40} of some words") for i in range(200)])
    for most, moved in ((1 << 20, False), (0, True)):
        monkeypatch.setattr(common, "MAX_BROADCAST_ROWS", most)
        out = sh.keep_one(docs)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert ("SortMergeJoin" in plan) == moved and ("BroadcastHashJoin" in plan) != moved
        assert len({r.text for r in out.collect()}) == out.count() <= 40


def test_keep_one_and_empty_table(make_docs):
    docs = make_docs([(1, "a b c"), (2, "A b c"), (3, "other words here"), (None, "a b c")], "1 AS component_id")
    out = sh.keep_one(docs)
    assert out.columns == docs.columns
    assert sorted([r.doc_id or 0 for r in out.collect()]) == [0, 1, 3]
    assert sh.keep_one(make_docs([])).count() == 0 == sh.near_duplicates(make_docs([])).count()
