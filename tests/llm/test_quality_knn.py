import numpy as np
import pytest

from tidemark.llm import quality_knn as q, queries

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = queries.op3_quality_knn(spark, SF).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    good = [r.score for r in held if labels[r.doc_id] == 1]
    bad = [r.score for r in held if labels[r.doc_id] == 0]
    assert len(bad) > 5 and np.mean([g > b for g in good for b in bad]) > 0.98
    assert np.mean([g >= 0.3 for g in good]) > 0.99


def test_held_out_labels_are_never_read(spark):
    """Turning the held-out labels round changes nothing."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.selectExpr("doc_id", "IF(crc32(CAST(CAST(doc_id AS string) AS binary)) % 5 = 0, 1 - quality, quality) AS quality")
    a = {r.doc_id: r.score for r in q.score(docs, labels).collect()}
    assert a == {r.doc_id: r.score for r in q.score(docs.drop("lang", "source"), turned).collect()}


def test_votes_match_all_products():
    rng = np.random.default_rng(0)
    x = rng.random((2500, q.FEATURES), np.float32) * (rng.random((2500, q.FEATURES)) < 0.02)
    y = (rng.random(2500) < 0.7).astype(int)
    x = x.astype(np.float16).astype(np.float32)
    m = q.fit(q.Rows([q.Rows.pack(r) for r in x]), y, {0: 900, 1: 4000})
    new = x[:40] + x[50:90]
    z = m.place(new)
    cos = (z @ m.vectors.T).astype(np.float64)
    want = []
    for row in cos:
        top = np.argsort(-row, kind="stable")[:q.NEIGHBOURS]
        w = np.maximum(row[top], 0) ** q.POWER * m.votes[top]
        want.append((w * y[top]).sum() / w.sum())
    assert np.allclose(m.score(new), want, atol=1e-4)


def test_long_texts_are_counted_in_pieces(monkeypatch):
    text = "Some words, and 12 more! " * 400
    whole = q.features(text)
    monkeypatch.setattr(q, "_PIECE", 100)
    assert np.array_equal(whole, q.features(text))


@pytest.mark.parametrize("labels", [[], [(1, 1), (2, None), (None, 0), (3, 7)], [(i, i % 2) for i in range(12)] + [(3, 0), (3, 1)]])
def test_edge_cases(spark, labels):
    texts = [(i, f"text {i} with words " * 9) for i in range(12)] + [(20, None), (21, ""), (22, " \n"), (None, "a b c"), (1, "a"), (1, "a")]
    docs = spark.createDataFrame([(i, t, 5) for i, t in texts], "doc_id long, text string, score int")
    known = spark.createDataFrame([(i, y, "x") for i, y in labels], "doc_id long, quality int, text string")
    rows = q.score(docs, known).collect()
    assert len(rows) == len(texts) and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (20, 21, 22)}) == 1
    assert not next(r for r in rows if r.doc_id is None).held_out
    assert q.score(docs.limit(0), known).count() == 0


def test_size_of_what_is_learned(spark):
    """The full feature space, and as many labelled rows as it was laid out for."""
    n = 12_000
    docs = spark.range(n).selectExpr("id AS doc_id", "concat('some words ', id, ' and more') AS text")
    labels = spark.range(n).selectExpr("id AS doc_id", "CAST(id % 2 AS int) AS quality")
    model = q.train(docs, labels)
    assert model.project.shape == (4096 + 4096 + 2, q.DIM) and len(model.vectors) == 4000


def test_fit_by_blocks_matches_one_matrix():
    """The latent space from blocks of packed rows against a decomposition of the whole weighted matrix."""
    rng = np.random.default_rng(1)
    group = rng.integers(0, 5, 700)
    x = (rng.random((700, q.FEATURES)) < 0.01) * 1.0
    for g in range(5):
        x[np.ix_(group == g, rng.choice(q.FEATURES, 60))] += 3
    rows = q.Rows([q.Rows.pack(r) for r in x])
    assert np.array_equal(np.concatenate(list(rows.blocks(97))), x)
    model = q.fit(rows, (group < 2).astype(int), {0: 10, 1: 10})
    rarity = np.log(701 / (1 + (x > 0).sum(axis=0))) + 1
    a = x * rarity / np.linalg.norm(x * rarity, axis=1, keepdims=True)
    top = np.linalg.svd(a, full_matrices=False)[2][:5]
    share = np.linalg.norm(a @ (model.project / rarity[:, None].astype(np.float32)), axis=1)
    assert np.allclose(np.linalg.norm(model.vectors, axis=1), 1, atol=1e-4)
    assert (share >= np.linalg.norm(a @ top.T, axis=1) - 0.02).all()
