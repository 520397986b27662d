import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from tidemark.llm import packing, queries, tokens

SF = "/root/testdata/sf0.001"
TOK = Tokenizer.from_file(tokens.TOKENIZER)
TEXTS = ["", "Hello world", "don't  stop\n\n\n now's", "<|endoftext|> x<|endoftext|>", "日本語 ½ ١٢ é", " " * 3000,
         "a" * 5000, "word " * 4000, "\U0001F600‍\x00\x1c x", "tab\t\ttab \r\n"]


def ids_of(text):
    return TOK.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("text", TEXTS)
def test_ids_equal_the_tokenizers_library(text):
    assert tokens.encode(text).tolist() == ids_of(text)


def check(rows, docs, window):
    """Every id lies in exactly one piece, and sequences are filled from 0 without gaps."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(docs)
    for doc_id, text in docs.items():
        ids = np.array([*ids_of(text), 0], "<u4")
        at = 0
        for r in sorted(by_doc[doc_id], key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for seq, pieces in by_seq.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == window or (seq == max(by_seq) and at < window)
    assert sorted(by_seq) == list(range(len(by_seq)))


@pytest.mark.parametrize("window", [1024, 7])
def test_pack(spark, window):
    docs = dict(enumerate([*TEXTS, None]))
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(4)
    check(packing.pack(df, window=window).collect(), docs, window)


def test_whole_table(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    check(queries.op5_packing(spark, SF).collect(), docs, 1024)


def test_cut_of_long_documents_needs_no_python(spark):
    """Pass 2 stays in Spark's expressions: no batch of ids goes to a Python worker."""
    sizes, rows, at = [1, 1023, 1, 1024, 2048, 5, 300_000, 7], [], 0
    for i, n in enumerate(sizes):
        rows.append((i, np.arange(at, at + n).astype("<u4").tobytes(), 3, at))
        at += n
    df = packing.cut(spark.createDataFrame([(i, bytearray(v), p, b) for i, v, p, b in rows],
                                           "doc_id long, ids binary, part int, before long"), {2: 0, 3: 700})
    got = sorted((r.sequence_id, r.offset, r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in df.collect())
    want = []
    for i, v, _, before in rows:
        start, n = 0, len(v) // 4
        while start < n:
            place = 700 + before + start
            length = min(1024 - place % 1024, n - start)
            want.append((place // 1024, place % 1024, i, start, length, zlib.crc32(v[4 * start:4 * (start + length)]), n))
            start += length
    assert got == sorted(want)
    assert "MapInArrow" not in df._jdf.queryExecution().executedPlan().toString()


def test_empty_repeated_and_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(empty).count() == 0
    df = spark.createDataFrame([(1, "a b", 9), (1, "a b", 9), (None, None, 9)], "doc_id long, text string, part int")
    rows = packing.pack(df).collect()
    assert sorted((r.doc_id or 0, r.length) for r in rows) == [(0, 1), (1, 3), (1, 3)]


@pytest.mark.parametrize("window, parts", [(1024, 4), (7, 3), (1, 2), (100_000, 5)])
def test_sequences_are_the_stream_that_pack_cuts(spark, window, parts):
    docs = dict(enumerate([*TEXTS, None, *TEXTS]))
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(parts, "doc_id")
    got = {r.sequence_id: r.ids for r in packing.sequences(df, window=window).collect()}
    assert sorted(got) == list(range(len(got)))
    assert all(len(ids) == window for s, ids in got.items() if s != max(got))
    # Each document's ids lie where its pieces say.
    stream = [i for s in sorted(got) for i in got[s]]
    ids = {i: [*ids_of(t), 0] for i, t in docs.items()}
    assert len(stream) == sum(map(len, ids.values()))
    for r in packing.pack(df, window=window).collect():
        want = ids[r.doc_id][r.start:r.start + r.length]
        assert got[r.sequence_id][r.offset:r.offset + r.length] == want


def test_sequences_of_the_whole_table_padded(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = sum(len(ids_of(r.text)) + 1 for r in docs.select("text").collect())
    rows = packing.sequences(docs, pad_id=0).collect()
    assert sorted(r.sequence_id for r in rows) == list(range(-(-n // 1024)))
    assert {len(r.ids) for r in rows} == {1024}


def test_sequences_of_an_empty_table(spark):
    assert packing.sequences(spark.createDataFrame([], "text string")).count() == 0
