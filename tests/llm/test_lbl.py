import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from tidemark.llm import lbl as m, queries

SF = "/root/testdata/sf0.01"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return [*re.findall("[^\x20\x09-\x0D]+", (text or "").translate(LOWER)), None]


def base(docs):
    """Everything but the model's score, from the definition."""
    held = [i is not None and crc32(str(i).encode()) % 7 == 2 for i, _ in docs]
    words = [tokens(t) for _, t in docs]
    c = Counter(w for ws, h in zip(words, held) if not h for w in ws)
    n = sum(c.values())
    return [(i, h, len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + len(c) + 1)) for w in ws))
            for (i, _), h, ws in zip(docs, held, words)]


def same(rows, want):
    key = lambda r: (str(r[0]), *r[1:4], round(r[5], 3))
    rows, want = sorted(map(tuple, rows), key=key), sorted(want, key=key)
    assert [r[:5] for r in rows] == [w[:5] for w in want]
    assert np.allclose([r[5] for r in rows], [w[5] for w in want], rtol=1e-9, atol=1e-9)


def test_whole_table_and_held_out_texts(spark):
    """Counts from the definition; held-out texts are likelier than by frequency alone, in whole and nearly each."""
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    rows = queries.op11_lbl_scoring(spark, SF).collect()
    same([tuple(r)[:6] for r in rows], base(docs))
    held = [r for r in rows if r.held_out]
    assert len(held) > 100 and sum(r.score for r in held) / sum(r.n_tokens for r in held) > sum(
        r.base_score for r in held) / sum(r.n_tokens for r in held) + 0.1
    assert np.mean([r.score > r.base_score for r in held if r.n_tokens > 20]) > 0.95


def test_probabilities_of_all_tokens_add_up_to_one():
    """After any context: the known words, and one unknown word for each class of others."""
    rng = np.random.default_rng(1)
    names = [b"", *[f"w{i}".encode() for i in range(900)]]
    count = np.sort(rng.integers(1, 400, len(names)))[::-1]
    cls = np.array([i if i <= m.SINGLES else m.tail(w) for i, w in enumerate(names)])
    n, v = np.bincount(cls, count, m.CLASSES), np.bincount(cls, minlength=m.CLASSES)
    size = np.where(np.arange(m.CLASSES) <= m.SINGLES, 1, n + v + 1)
    model = m.Model.new((n + 1) / (n.sum() + m.CLASSES))
    model.out[:] = rng.normal(0, 1, model.out.shape)
    for before in rng.integers(0, m.CLASSES + 1, (5, m.CONTEXT)):
        p = 10 ** model.log10(np.repeat(before[None], m.CLASSES, 0), np.arange(m.CLASSES))
        inside = np.where(cls <= m.SINGLES, 1, (count + 1) / size[cls])
        unknown = sum(p[k] / size[k] for k in range(m.SINGLES + 1, m.CLASSES))
        assert np.isclose((p[cls] * inside).sum() + unknown, 1, atol=1e-5)


def test_log_probabilities_against_one_softmax_for_each_token(monkeypatch):
    monkeypatch.setattr(m, "PRODUCT", 7)
    rng = np.random.default_rng(2)
    model = m.Model(rng.normal(0, 0.5, (2 * m.CLASSES + 1 + m.CONTEXT, m.DIM + 1)).astype(np.float32))
    cls, ends = rng.integers(0, 9, 200), np.array([1, 60, 61, 200])
    got, at = model.log10(m.contexts(cls, ends), cls), 0
    for end in ends:
        for i in range(at, end):
            h = sum(model.context[cls[i - 1 - k] if i - 1 - k >= at else m.START_CLASS] * model.place[k] for k in range(m.CONTEXT))
            z = model.out @ h + model.bias
            assert math.isclose(got[i], (z[cls[i]] - np.log(np.exp(z).sum())) / np.log(10), abs_tol=1e-4)
        at = end


def test_noise_contrastive_estimation_learns_conditional_shares():
    """A chain of classes whose next class depends on the last one."""
    rng = np.random.default_rng(3)
    chain = [0]
    for _ in range(60_000):
        chain.append((chain[-1] * 3 + 1) % 10 if rng.random() < 0.8 else int(rng.integers(10)))
    cls = np.array(chain)
    share = (np.bincount(cls, minlength=m.CLASSES) + 1) / (len(cls) + m.CLASSES)
    t = m.Trainer(m.Model.new(share).table, share, 1)
    before = m.contexts(cls, np.array([len(cls)]))
    for _ in range(25):
        t.epoch(before, cls)
    p = 10 ** t.model.log10(np.array([[4, 1], [4, 1]]), np.array([3, 5]))
    assert abs(p[0] - 0.82) < 0.08 and p[1] < 0.06


@pytest.mark.parametrize("known,flush", [(1 << 18, 400_000), (40, 30), (0, 3)])
def test_rare_words_and_cases(spark, monkeypatch, known, flush):
    """Counts do not depend on which words all tasks know; nulls, empty, long and repeated texts, clashing columns."""
    monkeypatch.setattr(m, "KNOWN", known)
    monkeypatch.setattr(m, "_FLUSH", flush)
    rng = random.Random(4)
    docs = [(i, " ".join(rng.choices([f"W{k}" for k in range(300)], k=rng.randrange(40)))) for i in range(120)]
    docs += [(7, "again and again"), (7, "again and again"), (None, "A\x85b \x0b c d"), (None, None), (300, ""), (301, " \n"),
             (302, "y" * 5000 + " z"), (303, "long text " * 30_000)]
    df = spark.createDataFrame([(*d, 1, "w") for d in docs], "doc_id long, text string, row int, word string").repartition(4)
    rows = m.score(df).collect()
    same([tuple(r)[:6] for r in rows], base(docs))
    assert all(r.score < 0 and math.isfinite(r.score) for r in rows)
    assert m.score(df.limit(0)).count() == 0


def test_nothing_to_learn_from(spark):
    held = [i for i in range(200) if crc32(str(i).encode()) % 7 == 2][:3]
    rows = m.score(spark.createDataFrame([(i, "a b") for i in held], "doc_id long, text string")).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in rows] == [(3, 0, 0, 0.0)] * 3
