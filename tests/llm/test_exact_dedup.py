import hashlib
import random
from collections import defaultdict

import pytest

from tidemark.llm import exact_dedup as x, queries
from tidemark.testing.compare import compare, duckdb_connection

SF = "/root/testdata/sf0.001"
rnd = random.Random(3)
LONG = "".join(rnd.choice("abcdefgh \n") for _ in range(60_000))


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for i, t in rows:
        ids = groups[t or ""]
        keep = max((v for v in ids if v is not None), default=None)
        if len(ids) == 1:
            keep = i
        out.append((i, keep, len(ids), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


CASES = [(1, "a"), (2, "a"), (3, "a "), (4, None), (5, ""), (6, LONG), (7, LONG), (8, LONG + "."), (9, "x" + LONG),
         (10, LONG[:30_000] + "é" + LONG[30_000:]), (11, LONG[:-1]), (None, "a"), (None, "only here"), (12, "Ü" * 9000),
         (13, LONG[30_000:] + LONG[:30_000]), (14, "z"), (14, "z"), (None, "n"), (None, "n"), (15, LONG + LONG)]


@pytest.mark.parametrize("digest_bytes", [16, 1])
def test_matches_brute_force(spark, digest_bytes):
    docs = spark.createDataFrame(CASES, "doc_id long, text string").repartition(3)
    rows = [tuple(r) for r in x.exact_duplicates(docs, digest_bytes=digest_bytes).collect()]
    assert sorted(rows, key=str) == brute(CASES)


def test_weak_digests_do_clash(spark):
    docs = spark.createDataFrame(CASES, "doc_id long, text string")
    assert x.clashes(x.distinct_chunks(docs, 1)) and not x.clashes(x.distinct_chunks(docs))


def test_chunks_follow_content():
    data = LONG.encode()
    a, b = x.chunks(data), x.chunks(b"inserted" + data)
    assert b"".join(a) == data and max(map(len, a)) <= x.MAX_CHUNK
    assert len(set(a) & set(b)) > 0.8 * len(a)
    assert x.chunks(b"") == [] and x.chunks(b"\0" * 50_000)


def test_keep_one_keeps_columns_and_empty_table(make_docs):
    docs = make_docs([(1, "a"), (2, "a"), (3, "b"), (None, "b")], "1 AS keep_id").selectExpr("*", "2 AS recipe")
    out = x.keep_one(docs)
    assert out.columns == docs.columns
    assert sorted([(r.doc_id, r.text) for r in out.collect()], key=str) == [(2, "a"), (3, "b"), (None, "b")]
    assert x.keep_one(make_docs([])).count() == 0 == x.exact_duplicates(make_docs([])).count()


def test_matches_sql(spark):
    r = compare(queries.op7_exact_dedup(spark, SF), duckdb_connection(SF), queries.oracle_sql()["op7_exact_dedup"])
    assert r["columns_match"] and r["values_match"], r["diff_example"]
