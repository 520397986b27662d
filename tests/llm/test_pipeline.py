"""The pipeline against a slow version, stage by stage on each stage's own input."""

import re

import pytest
from test_exact_dedup import brute as slow_exact
from test_packing import check as check_packing
from test_quality_rules import base
from test_simhash import brute as slow_near

import corpus_pipeline as cp
from tidemark.llm import langid, quality_rules as q
from tidemark.llm.common import save, scratch, temporary

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def slow_line_ok(line):
    w = re.findall(r"[^\x20\x09-\x0D]+", line)
    ends = bool(re.search(q.CLOSED, line.rstrip(" \t\n\x0b\f\r"))) or (
        len(w) >= q.LONG_LINE and len(re.findall(q.SENTENCE, line, re.ASCII)) * q.LONG_LINE >= len(w))
    return (ends and sum(x in q.NAVIGATION for x in w) * q.NAVIGATION_WORDS <= len(w)
            and not (len(w) >= 2 and line == line.upper() != line.lower()) and len(re.findall(q.SYMBOLS, line)) * 4 <= len(w)
            and not (len(w) >= 8 and 2 * len(set(w)) < len(w))
            and sum(p in line.lower() for p in q.BOILERPLATE) * q.PHRASE_WORDS <= len(w))


def slow_quality(text):
    """The cleaned text, or None for a rejected one."""
    n_words, chars, _, _, _, failed = base(text)
    good = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x) and slow_line_ok(x)]
    left = sum(len(w) for x in good for w in re.findall(r"[^\x20\x09-\x0D]+", x))
    return None if failed or 1 - left / chars > q.MAX_LOSS else "\n".join(good)


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output of each stage."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in cp.STAGES:
        after = save(stage(spark, docs, SF), f"test-{name}")
        out[name] = docs, after
        docs = after
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def folders(spark):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(spark.sparkContext.getCheckpointDir())
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return {f.getPath().getName() for f in fs.listStatus(path)}


def test_scratch_tables_go_with_their_block(spark):
    before = folders(spark)
    lasting = scratch(spark, "lasting", lasting=True)
    with pytest.raises(ValueError), temporary(spark):
        kept = save(spark.range(3), "short")
        assert len(folders(spark) - before) == 1
        kept.write.parquet(lasting)
        raise ValueError
    assert folders(spark) - before == {lasting.rsplit("/", 1)[1]}
    outside = save(spark.range(3), "outside")
    assert outside.count() == 3 == spark.read.parquet(lasting).count()


def test_run_leaves_its_result_alone(spark, stages):
    before = folders(spark)
    out = cp.run(spark, SF)
    assert [f.rsplit("-", 1)[0] for f in folders(spark) - before] == ["pipeline-packing"]
    assert sorted(out.collect()) == sorted(stages["packing"][1].select(out.columns).collect())


def test_names_and_columns(stages):
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "language_id", "exact_dedup", "simhash_near_dedup", "packing"]
    assert all(after.columns == COLUMNS for n, (_, after) in stages.items() if n != "packing")


def test_quality(stages):
    before, after = map(texts, stages["quality_rules"])
    assert after == {i: c for i, t in before.items() if (c := slow_quality(t)) is not None}


def test_language(stages):
    docs, after = stages["language_id"]
    model = langid.train(docs)
    want = {i: t for i, t in texts(docs).items() if (p := model.predict(t))[0] != "und" and p[1] >= model.threshold}
    assert texts(after) == want and len(want) > 0.95 * docs.count()


def test_exact(stages):
    before, after = map(texts, stages["exact_dedup"])
    assert after == {r[0]: before[r[0]] for r in slow_exact(list(before.items())) if r[3]}


def test_near(stages):
    before, after = map(texts, stages["simhash_near_dedup"])
    assert after == {i: before[i] for i, _, c in slow_near(list(before.items())) if i == c}


def test_packing_and_run(spark, stages):
    docs, after = stages["packing"]
    check_packing(after.collect(), texts(docs), 1024)
    rows = cp.run(spark, SF)
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, after.collect()))


@pytest.mark.parametrize("rows", [[], [(None, None), (1, ""), (2, "a b")], [(i, None) for i in range(3)]])
def test_odd_tables(make_docs, spark, rows):
    docs = make_docs(rows, "'x' AS fp").selectExpr("*", "1 AS p", "2 AS __doc")
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        out.collect()
    assert cp.STAGES[-1][1](spark, docs, SF).count() == len(rows)


TEXT_A, TEXT_B = "one of the long texts here", "quite another text that shares nothing"
REPEATED = [
    ([(5, "a"), (9, "a"), (5, "unique")], [(5, "unique"), (9, "a")]),
    ([(1, "a"), (1, "a"), (1, "a")], [(1, "a")]),
    ([(None, "a"), (None, "a"), (None, "b")], [(None, "a"), (None, "b")]),
    ([(None, "a"), (3, "a"), (None, None), (None, "")], [(3, "a"), (None, "-")]),
]


def by_row(df):
    return sorted([(r.doc_id, r.text or "-") for r in df.collect()], key=str)


@pytest.mark.parametrize("rows, want", REPEATED)
def test_exact_decides_by_row(spark, make_docs, rows, want):
    docs = make_docs(rows, "7 AS __row").repartition(3)
    out = cp.exact_stage(spark, docs, SF)
    assert out.columns == docs.columns and by_row(out) == sorted(want, key=str)


@pytest.mark.parametrize("rows, want", [
    # Components {1, 2} and {0, 1}: the row 1 of the second must not end the first.
    ([(1, TEXT_A), (2, TEXT_A), (0, TEXT_B), (1, TEXT_B)], [(0, TEXT_B), (1, TEXT_A)]),
    # Two components of the same smallest id.
    ([(1, TEXT_A), (2, TEXT_A), (1, TEXT_B), (3, TEXT_B)], [(1, TEXT_A), (1, TEXT_B)]),
    ([(1, TEXT_A)] * 4, [(1, TEXT_A)]),
    ([(None, TEXT_A), (None, TEXT_A.upper()), (4, TEXT_B), (None, TEXT_B)], [(4, TEXT_B), (None, "one")]),
])
def test_near_decides_by_row(spark, make_docs, rows, want):
    docs = make_docs(rows, "7 AS __row").repartition(3)
    out = cp.near_stage(spark, docs, SF)
    got = [(i, t if i else "one") for i, t in by_row(out)] if (None, "one") in want else by_row(out)
    assert out.columns == docs.columns and sorted(got, key=str) == sorted(want, key=str)


def test_rows_linked_by_bits_stay_once(spark, make_docs):
    """A chain of near texts under repeated and NULL ids is one component and leaves one row."""
    words = [f"w{i}" for i in range(400)]
    rows = [(None if i % 3 else 8, " ".join(words[:-1] + [f"e{i}"])) for i in range(12)]
    assert len({c for _, _, c in slow_near(rows)}) == 1
    assert [i for i, _ in by_row(cp.near_stage(spark, make_docs(rows).repartition(3), SF))] == [8]
