import math
import string
import unicodedata
import zlib

import numpy as np
import pytest

from tidemark.llm import langid, queries, sampling

SF = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"
#: A model's tables as lists.
tables = []


def test_held_out_accuracy(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op4_language_id(spark, SF).collect()
    assert len(rows) == len(lang) and all(0 <= r.score <= 1 for r in rows)
    held = [r.lang_pred == lang[r.doc_id] for r in rows if r.held_out]
    assert len(held) > 200 and np.mean(held) > 0.98
    assert np.mean([r.rejected for r in rows]) < 0.01


def slow_prediction(model, text):
    """Language and score from the definition, subword by subword, in plain Python."""
    if not any(unicodedata.category(c)[0] == "L" for c in text or ""):
        return "und", 0.0
    # Bytes of other scripts and ASCII letters stay.
    data = "".join(c if ord(c) > 127 or c in string.ascii_lowercase else " " for c in text.lower())
    data = f" {' '.join(w for w in data.split(' ') if w)} ".encode()
    z, habit, n = [0.0] * len(model.langs), [0.0] * len(model.langs), 0
    for size in (2, 3, 4):
        for i in range(len(data) - size + 1):
            code = data[i]
            for b in data[i + 1:i + size]:
                code = (code * 0x01000193 & 0xFFFFFFFF) ^ b
            bucket = (code * 0x9E3779B1 + size & 0xFFFFFFFF) >> 17
            n += 1
            for k in range(len(z)):
                z[k] += tables[0][bucket][k]
                habit[k] += tables[1][k][bucket]
    z = [(a / n + b) / model.temperature for a, b in zip(z, model.bias.tolist())]
    e = [math.exp(a - max(z)) for a in z]
    k = e.index(max(e))
    unusual = min(0.0, (habit[k] + model.middle * langid.USUAL) / (n + langid.USUAL) - model.least)
    return model.langs[k], e[k] / sum(e) * math.exp(unusual)


def test_whole_table_against_a_slow_version(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = langid.train(docs)
    tables[:] = model.table.tolist(), model.habit.tolist()
    got = {r.doc_id: r for r in queries.op4_language_id(spark, SMALL).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        lang, score = slow_prediction(model, text)
        assert got[i].lang_pred == lang and got[i].score == pytest.approx(score, rel=1e-3, abs=1e-6)
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)


def test_held_out_rows_are_never_learned_from(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    turned = docs.selectExpr("doc_id", "text", "'x' AS source",
                             "IF(crc32(CAST(CAST(doc_id AS string) AS binary)) % 4 = 2, 'xx', lang) AS lang")
    a = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs).collect()}
    assert a == {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(turned).collect()}


def test_pieces_of_long_texts_count_alike(monkeypatch):
    text = "Größe und Maß, the words et les mots. " * 500
    whole = langid.subwords(text)
    monkeypatch.setattr(langid, "_PIECE", 1000)
    assert np.array_equal(whole, langid.subwords(text)) and whole.sum() > len(text)


def test_no_letters_are_unknown(spark):
    train = [(i, "der die das und nicht mit ist auf " * 3 if i % 2 else "the and of with this that is on " * 3, "de" if i % 2 else "en")
             for i in range(60)]
    odd = [(100, None, "de"), (101, "", "de"), (102, "12 34 !?", "en"), (103, "①½", None), (None, "the and of", "en"),
           (104, "the of and is", None), (105, "日本語", None), (1, "der die", "de"), (1, "der die", "de"), (106, "the of " * 50_000, None)]
    df = spark.createDataFrame([(i, t, x, 1, "p") for i, t, x in train + odd], "doc_id long, text string, lang string, score int, p string")
    rows = {r.doc_id: r for r in langid.identify(df).collect()}
    assert all((rows[i].lang_pred, rows[i].score, rows[i].rejected) == ("und", 0.0, True) for i in (100, 101, 102, 103))
    assert rows[104].lang_pred == rows[106].lang_pred == rows[None].lang_pred == "en" and not rows[None].held_out
    assert rows[105].lang_pred in ("de", "en")
    kept = langid.accepted(df)
    assert kept.columns == df.columns and not {100, 101, 102, 103} & {r.doc_id for r in kept.collect()}


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in langid.identify(df).collect()] == [("und", 0.0)]
    assert langid.identify(df.limit(0)).count() == 0 == langid.accepted(df).count()


def test_many_languages(spark):
    words = {f"l{k}": " ".join(f"{chr(97 + k)}{c}{chr(97 + k)}" for c in "aeiou") for k in range(12)}
    df = spark.createDataFrame([(i, w * 4, x) for i, (x, w) in enumerate(list(words.items()) * 20)], "doc_id long, text string, lang string")
    rows = langid.identify(df).join(df, "doc_id").collect()
    assert np.mean([r.lang_pred == r.lang for r in rows]) > 0.95


def test_an_id_repeated_often_leaves_room_for_the_others(spark):
    words = {"aa": "one two three four", "bb": "eins zwei drei vier", "cc": "uno dos tres cuatro"}
    rows = [(i, f"{w} {i}", x) for i, (x, w) in enumerate(list(words.items()) * 20)]
    df = spark.createDataFrame([rows[0]] * 2000 + rows, "doc_id long, text string, lang string").coalesce(1)
    got = []
    fit, langid.fit = langid.fit, lambda examples: got.extend(examples) or fit(examples)
    try:
        langid.train(df, sample=60)
    finally:
        langid.fit = fit
    learned = df.where("crc32(CAST(CAST(doc_id AS string) AS binary)) % 4 <> 2").select("doc_id").distinct()
    assert len(got) == learned.count() and {x for *_, x in got} == set(words)


def test_many_rare_labels_starve_no_language(spark):
    from tidemark.llm.sampling import LEAST_PER_LABEL, sample_ids
    rows = [(i, "big" if i % 2 else "large") for i in range(4000)] + [(10_000 + i, f"junk{i % 300}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, label string")
    ids, n = sample_ids(df, 1000)
    taken = {x: sum(v == x for v in ids.values()) for x in n}
    assert len(n) == 302 and min(taken.values()) == 1 and taken["big"] > 300 < taken["large"] and len(ids) <= 1010
    # Many labels of some size: each has its least number.
    ids, n = sample_ids(spark.range(6000).selectExpr("id AS doc_id", "concat('x', id % 100) AS label"), 200)
    assert all(sum(v == x for v in ids.values()) == LEAST_PER_LABEL for x in n) and len(n) == 100


def test_foreign_texts_are_rejected(spark):
    """With one, two or three languages learned, texts in another are rejected and their own are not."""
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    for learned in (["en"], ["de", "en"], ["de", "en", "fr"]):
        examples = []
        for i, t, x in rows:
            counts = langid.subwords(t or "")
            idx = np.flatnonzero(counts)
            if i % 2 and x in learned and len(idx):
                examples.append((idx, counts[idx], x))
        m = langid.fit(examples[:400])
        lost = lambda t: m.predict(t)[0] == "und" or m.predict(t)[1] < m.threshold
        foreign = [t for i, t, x in rows if x == "es" and len(t or "") > 40][:50]
        own = [t for i, t, x in rows if not i % 2 and x in learned and len(t or "") > 40][:200]
        assert np.mean([lost(t) for t in foreign]) > 0.95, learned
        assert np.mean([lost(t) for t in own]) < 0.02, learned
        assert lost("これは日本語の文章です。今日は天気がいいですね。") and lost("Это предложение на русском языке.")


def test_more_labels_than_allowed_are_an_error(spark):
    df = spark.createDataFrame([(i, f"l{i}") for i in range(9)], "doc_id long, label string")
    assert len(sampling.sample_ids(df, 100, max_classes=9)[0]) == 9
    with pytest.raises(ValueError, match="more than 8 labels"):
        sampling.sample_ids(df, 100, max_classes=8)
