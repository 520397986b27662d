import hashlib
import random

import pytest
from tokenizers import Tokenizer

from tidemark.llm import bpe_trie, queries, tokens

SF = "/root/testdata/sf0.001"
TOK = Tokenizer.from_file(tokens.TOKENIZER)
rnd = random.Random(5)
TEXTS = ["", "Hello world", "don't  stop\n\n\n now's we'll", "<|endoftext|> x<|endoftext|><|endoftext|>", "日本語 ½ ١٢ é",
         " " * 700 + "x", "a" * 2000, "aaa aaaa aaaaaaa " * 50, "\U0001F600‍\x00\x1c x \U000323b0࢏", "tab\t\ttab \r\n",
         "Ünïcödé Straße ΑΒΓ кириллица 한국어", "".join(rnd.choice("etaoin shr") for _ in range(5000)),
         "".join(chr(rnd.randrange(1, 0xD7FF)) for _ in range(3000)), "0123456789" * 100, "=" * 500 + "-" * 333]


@pytest.fixture(scope="module")
def coder():
    return bpe_trie.TrieCoder()


@pytest.mark.parametrize("i", range(len(TEXTS)))
def test_equals_the_library(coder, i):
    want = TOK.encode(TEXTS[i], add_special_tokens=False).ids
    got = coder.encode([TEXTS[i]])[0]
    assert got == want
    assert coder.decode(got) == TOK.decode(want, skip_special_tokens=False) == TEXTS[i]


def test_every_token_of_the_vocabulary(coder):
    words = [b.decode() for b in tokens.vocabulary().ids if b.isascii()]
    assert coder.encode(words) == [e.ids for e in TOK.encode_batch(words, add_special_tokens=False)]


def test_decodes_partial_characters(coder):
    ids = TOK.encode("日本語", add_special_tokens=False).ids[:-1]
    assert coder.decode(ids) == TOK.decode(ids, skip_special_tokens=False)


def test_cache_starts_anew(monkeypatch):
    monkeypatch.setattr(bpe_trie, "MAX_WORDS", 5)
    monkeypatch.setattr(bpe_trie, "MAX_PAIRS", 3)
    c = bpe_trie.TrieCoder()
    for t in TEXTS[:4] + TEXTS[9:11]:
        assert c.encode([t])[0] == TOK.encode(t, add_special_tokens=False).ids


def expect(i, text):
    ids = TOK.encode(text or "", add_special_tokens=False).ids
    back = TOK.decode(ids, skip_special_tokens=False)
    return (i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256(back.encode()).hexdigest())


def test_whole_table(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert sorted(tuple(r) for r in queries.op8_bpe(spark, SF).collect()) == sorted(expect(r.doc_id, r.text) for r in rows)


def test_round_trip_nulls_and_empty_table(spark):
    data = [*enumerate(TEXTS), (None, None), (0, "twice"), (0, "twice")]
    df = spark.createDataFrame([(i, t, 1) for i, t in data], "doc_id long, text string, ids int").repartition(3)
    back = bpe_trie.decode(bpe_trie.encode(df)).collect()
    assert sorted([(r.doc_id, r.text) for r in back], key=str) == sorted([(i, t or "") for i, t in data], key=str)
    empty = df.limit(0)
    assert bpe_trie.digests(empty).count() == 0 == bpe_trie.encode(empty).count()
