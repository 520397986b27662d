"""Byte-pair encoding by a prefix-sharing trie traversal, and decoding.

The encoding of a prefix is the encoding of a shorter prefix plus one last
token, so the last token of every prefix describes it fully.  The distinct
words of a batch form a trie; a depth-first walk carries, for each node on
the path, the last token of its prefix.  A node's last token is the one
suffix of the path that is a token and may follow the last token of the node
where it begins: two tokens may stand side by side when merging their joined
bytes gives the two again.  A prefix shared by many words is worked out once.

Words in sorted order are the trie's depth-first order: the bytes that a word
shares with the one before are the path that stays.

Work stays inside a task; a task holds the words of one Arrow batch and a
cache of at most ``MAX_WORDS`` words (a cache only: every word is encoded).

Cases: NULL and empty texts have no ids; special tokens in a text become their
ids; ids unknown to the vocabulary are an error in decoding.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import tokens
from tidemark.llm.common import shipped

#: Entries of a task's caches of words and token pairs; a full cache starts anew.
MAX_WORDS, MAX_PAIRS = 1_000_000, 1_000_000
_START = -1


class TrieCoder:
    def __init__(self, path: str = tokens.TOKENIZER):
        v = tokens.vocabulary(path)
        self.path, self.ids, self.special = path, v.ids, v.special
        top = max(v.bytes)
        self.bytes = [v.bytes.get(i) for i in range(top + 1)]
        self.names = [str(i) for i in range(top + 1)]
        self.longest = max(map(len, v.ids))
        self.words: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}

    def merged(self, data: bytes) -> list[int]:
        """The merges applied to a few bytes, lowest rank and leftmost first."""
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, i = min((self.ids.get(a + b, len(self.bytes)), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == len(self.bytes):
                break
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return [self.ids[p] for p in parts]

    def follows(self, left: int, right: int) -> bool:
        """Whether ``right`` may follow ``left``, or begin a word."""
        known = self.pairs.get((left, right))
        if known is None:
            if left == _START:
                known = self.merged(self.bytes[right]) == [right]
            else:
                known = self.merged(self.bytes[left] + self.bytes[right]) == [left, right]
            if len(self.pairs) >= MAX_PAIRS:
                self.pairs.clear()
            self.pairs[left, right] = known
        return known

    def walk(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of sorted distinct words."""
        ids, pairs, follows, longest, size = self.ids, self.pairs, self.follows, self.longest, self.bytes
        last, path, out = [_START], b"", []
        for word in words:
            n = min(len(path), len(word))
            d = n if path[:n] == word[:n] else next(i for i in range(n) if path[i] != word[i])
            del last[d + 1:]
            for d in range(d + 1, len(word) + 1):
                for begin in range(max(0, d - longest), d):
                    t = ids.get(word[begin:d])
                    if t is not None:
                        p = last[begin]
                        ok = pairs.get((p, t))
                        if ok or ok is None and follows(p, t):
                            last.append(t)
                            break
            path, d, back = word, len(word), []
            while d:
                t = last[d]
                back.append(t)
                d -= len(size[t])
            out.append(tuple(back[::-1]))
        return out

    def learn(self, new: set[str]) -> None:
        if len(self.words) + len(new) > MAX_WORDS:
            self.words.clear()
        order = sorted((w.encode(), w) for w in new)
        self.words.update(zip((w for _, w in order), self.walk([b for b, _ in order])))

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text, the words of all texts in one trie."""
        cut = [[s if i % 2 else tokens.pretokens(s, self.path) for i, s in enumerate(tokens.sections(t, self.path))]
               for t in texts]
        seen = set().union(*(part for parts in cut for part in parts[::2]))
        new = seen.difference(self.words)
        if len(self.words) + len(new) > MAX_WORDS:
            new = seen  # the cache starts anew
        if new:
            self.learn(new)
        of = self.words.__getitem__
        return [list(chain.from_iterable((self.special[p],) if i % 2 else chain.from_iterable(map(of, p))
                                         for i, p in enumerate(parts))) for parts in cut]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(2)
def trie_coder(path: str = tokens.TOKENIZER) -> TrieCoder:
    return TrieCoder(path)


#: Texts are encoded together until they hold so many characters.
GROUP_CHARS = 8_000_000


def _groups(texts: list[str]):
    group, held = [], 0
    for t in texts:
        group.append(t)
        held += len(t)
        if held >= GROUP_CHARS:
            yield group
            group, held = [], 0
    if group:
        yield group


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [t or "" for t in batch.column("text").to_pylist()]


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return shipped(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           tokenizer: str = tokens.TOKENIZER) -> DataFrame:
    """``doc_id, ids``: the ids of every text."""
    def run(batches):
        for batch in batches:
            at = 0
            for group in _groups(_texts(batch)):
                ids = trie_coder(tokenizer).encode(group)
                yield pa.record_batch([batch.column("doc_id").slice(at, len(ids)), pa.array(ids, pa.list_(pa.int32()))],
                                      names=["doc_id", "ids"])
                at += len(ids)

    return _rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, tokenizer: str = tokens.TOKENIZER) -> DataFrame:
    """``doc_id, text`` of ``doc_id, ids``; NULL ids give an empty text."""
    def run(batches):
        for batch in batches:
            texts = [trie_coder(tokenizer).decode(i or []) for i in batch.column("ids").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return shipped(encoded.select("doc_id", "ids")).mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            tokenizer: str = tokens.TOKENIZER) -> DataFrame:
    """Per document its number of ids and the digests of its ids and of its decoded text; ids never leave the task."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()),
                        ("decoded_sha256", pa.string())])

    def run(batches):
        coder = trie_coder(tokenizer)
        name = coder.names.__getitem__
        for batch in batches:
            n, of_ids, of_text = [], [], []
            for group in _groups(_texts(batch)):
                for ids in coder.encode(group):
                    n.append(len(ids))
                    of_ids.append(hashlib.sha256(",".join(map(name, ids)).encode()).hexdigest())
                    of_text.append(hashlib.sha256(coder.decode(ids).encode()).hexdigest())
            yield pa.record_batch([batch.column("doc_id").cast(pa.int64()), n, of_ids, of_text], schema=schema)

    return _rows(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
