"""Edit-aware token counts.

A text is kept as its pre-tokens with their token counts, grouped into leaves
of a segment tree whose nodes hold the sums of characters and tokens below.
An edit finds its leaf through the character sums, takes the text again from
the last pre-token that the edit cannot have changed, and re-encodes until a
new boundary meets an old one beyond the edit: from there on all pre-tokens
are the old ones.  Only the leaves in between and the sums above them change.

The boundary context is the longest look-ahead of the splitting pattern or,
if longer, a special token: a pre-token that ends so far before an edit, and a
boundary so far behind it, are the same with and without the edit.

Edits ``(pos, cut, ins)`` apply in order, each to the text as the ones before
left it: ``cut`` characters at ``pos`` give way to ``ins``.  Positions beyond
the end mean the end, lengths beyond the end the rest.

Cases: NULL text is empty, NULL edits are none, NULL fields of an edit are 0
or empty; rows are independent, so repeated rows and ties get equal results.
A task holds one Arrow batch, one tree and a cache of at most ``MAX_WORDS``
counts (a cache only).
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import tokens
from tidemark.llm.common import shipped

#: Pre-tokens in a new leaf; a leaf that grows to ``REBUILD`` times this has the tree built anew from its counts.
LEAF, REBUILD = 32, 8
#: Characters behind an edit that are looked at first; doubled while no old boundary is met.
REACH = 64
#: Look-ahead of the splitting pattern in characters (an apostrophe and two letters).
LOOKAHEAD = 3
MAX_WORDS = 1_000_000
EDITS = "array<struct<pos: int, cut: int, ins: string>>"

_counts: dict[str, dict[str, int]] = {}


def counts_of(items: list[str], path: str) -> list[int]:
    """Tokens of each pre-token or special token."""
    known = _counts.setdefault(path, {})
    new = set(items).difference(known)
    if new:
        if len(known) + len(new) > MAX_WORDS:
            known.clear()
            new = set(items)
        for w in new:
            known[w] = len(tokens.encode(w, path))
    return list(map(known.__getitem__, items))


def split(text: str, path: str) -> list[str]:
    """Pre-tokens and special tokens of a text, in order."""
    parts = tokens.sections(text, path)
    if len(parts) == 1:
        return tokens.pretokens(text, path)
    return [x for i, s in enumerate(parts) for x in ([s] if i % 2 else tokens.pretokens(s, path))]


class CountTree:
    """Segment tree over the pre-tokens of one text."""

    def __init__(self, items: list[str], counts: list[int], path: str = tokens.TOKENIZER):
        self.path = path
        self.context = max([LOOKAHEAD, *map(len, tokens.vocabulary(path).special)])
        self._build(items, counts)

    @classmethod
    def of(cls, text: str, path: str = tokens.TOKENIZER) -> CountTree:
        items = split(text, path)
        return cls(items, counts_of(items, path), path)

    def _build(self, items, counts):
        self.leaves = [(items[i:i + LEAF], counts[i:i + LEAF]) for i in range(0, len(items), LEAF)] or [([], [])]
        self.width = 1 << (len(self.leaves) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        for i, (words, n) in enumerate(self.leaves, self.width):
            self.chars[i], self.tokens[i] = sum(map(len, words)), sum(n)
        for i in range(self.width - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    def items(self) -> tuple[list[str], list[int]]:
        return [w for words, _ in self.leaves for w in words], [c for _, n in self.leaves for c in n]

    def text(self) -> str:
        return "".join(w for words, _ in self.leaves for w in words)

    def _find(self, pos: int) -> tuple[int, int]:
        """The leaf with the character at ``pos`` (the last leaf, for the end), and the characters before it."""
        node, before = 1, 0
        while node < self.width:
            node *= 2
            if pos - before >= self.chars[node] and self.chars[node + 1]:
                before += self.chars[node]
                node += 1
        return node - self.width, before

    def _set(self, leaf: int, words: list[str], counts: list[int]) -> None:
        """New contents of a leaf, and the sums on the way to the root."""
        self.leaves[leaf] = (words, counts)
        node = leaf + self.width
        more = sum(map(len, words)) - self.chars[node], sum(counts) - self.tokens[node]
        while node:
            self.chars[node] += more[0]
            self.tokens[node] += more[1]
            node //= 2

    def edit(self, pos: int, cut: int, ins: str) -> int:
        """Apply one edit; the number of characters that were encoded again."""
        pos = min(max(pos, 0), self.chars[1])
        cut = min(max(cut, 0), self.chars[1] - pos)
        if not cut and not ins:
            return 0
        first, before = self._find(max(0, pos - self.context))
        words = self.leaves[first][0]
        skip = 0
        while skip < len(words) and before + len(words[skip]) <= pos - self.context:
            before += len(words[skip])
            skip += 1
        a = pos - before  # of the text from here on
        reach, old, last = REACH, list(words[skip:]), first
        held = sum(map(len, old))
        safe, shift = a + len(ins) + self.context, len(ins) - cut
        while True:
            while held < a + cut + self.context + reach and last + 1 < len(self.leaves):
                last += 1
                old += self.leaves[last][0]
                held += self.chars[last + self.width]
            was = "".join(old)
            now = was[:a] + ins + was[a + cut:]
            new = split(now, self.path)
            at_end = last + 1 == len(self.leaves)
            trusted = len(now) if at_end else len(now) - self.context
            bounds = {b + shift: i for i, b in enumerate(accumulate(map(len, old)), 1)}
            meet = next(((i, bounds[b]) for i, b in enumerate(accumulate(map(len, new)), 1)
                         if safe <= b <= trusted and b in bounds), (len(new), len(old)) if at_end else None)
            if meet:
                break
            reach *= 2
        new, rest = new[:meet[0]], len(old) - meet[1]
        words, n = words[:skip] + new, self.leaves[first][1][:skip] + counts_of(new, self.path)
        # The old pre-tokens behind the meeting point, from the last leaf backwards, stay where they are.
        for leaf in range(last, first - 1, -1):
            old_words, old_n = self.leaves[leaf]
            stay = len(old_words) - min(rest, len(old_words) - (skip if leaf == first else 0))
            rest -= len(old_words) - stay
            more = (words, n) if leaf == first else ([], [])
            self._set(leaf, more[0] + old_words[stay:], more[1] + old_n[stay:])
        if len(self.leaves[first][0]) > REBUILD * LEAF:
            self._build(*self.items())
        return sum(map(len, new))


def _edits(value) -> list[tuple[int, int, str]]:
    return [(e["pos"] or 0, e["cut"] or 0, e["ins"] or "") for e in value or [] if e]


def _pack(values: list[int]) -> bytes:
    return np.array(values, "<u4").tobytes()


_STATE = "doc_id long, n_tokens long, text string, sizes binary, counts binary"


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          tokenizer: str = tokens.TOKENIZER) -> DataFrame:
    """The state to keep for each document: its count, its text, and characters and tokens of each pre-token."""
    def run(batches):
        for batch in batches:
            rows = []
            for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                items = split(text := t.as_py() or "", tokenizer)
                n = counts_of(items, tokenizer)
                rows.append((i, sum(n), text, _pack(list(map(len, items))), _pack(n)))
            yield _state(rows)

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return shipped(d).mapInArrow(run, _STATE)


def _state(rows) -> pa.RecordBatch:
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("text", pa.string()), ("sizes", pa.binary()),
                        ("counts", pa.binary())])
    return pa.record_batch([list(c) for c in zip(*rows)] if rows else [[]] * 5, schema=schema)


def update(state: DataFrame, edits_col: str = "edits", tokenizer: str = tokens.TOKENIZER) -> DataFrame:
    """The state after the edits in ``edits_col`` of each row; unedited text is not split or encoded again."""
    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                ends = list(accumulate(np.frombuffer(r["sizes"], "<u4").tolist(), initial=0))
                items = [r["text"][a:b] for a, b in zip(ends, ends[1:])]
                tree = CountTree(items, np.frombuffer(r["counts"], "<u4").tolist(), tokenizer)
                for e in _edits(r["edits"]):
                    tree.edit(*e)
                items, n = tree.items()
                rows.append((r["doc_id"], tree.n_tokens, "".join(items), _pack(list(map(len, items))), _pack(n)))
            yield _state(rows)

    cols = [F.col(c) for c in ("doc_id", "text", "sizes", "counts")]
    return shipped(state.select(*cols, F.col(edits_col).cast(EDITS).alias("edits"))).mapInArrow(run, _STATE)


def count_edited(docs: DataFrame, edits: Column, id_col: str = "doc_id", text_col: str = "text",
                 tokenizer: str = tokens.TOKENIZER) -> DataFrame:
    """Per document its count before and after its edits, and the characters encoded again for them."""
    names = ("doc_id", "n_tokens", "n_edits", "n_tokens_edited", "n_chars_reencoded")
    schema = pa.schema([(n, pa.int64()) for n in names])

    def run(batches):
        for batch in batches:
            rows = []
            for i, t, e in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("edits").to_pylist()):
                tree = CountTree.of(t.as_py() or "", tokenizer)
                n, todo = tree.n_tokens, _edits(e)
                again = sum(tree.edit(*x) for x in todo)
                rows.append((i, n, len(todo), tree.n_tokens, again))
            yield pa.record_batch([list(c) for c in zip(*rows)] if rows else [[]] * 5, schema=schema)

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), edits.cast(EDITS).alias("edits"))
    return shipped(d).mapInArrow(run, ", ".join(f"{n} long" for n in names))


def revision(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """A small revision of each document, derived from its id and length: a new heading, a replaced and a deleted
    stretch, an inserted phrase and a closing line."""
    size = F.coalesce(F.length(text_col), F.lit(0))
    spot = lambda k: F.pmod(F.xxhash64(F.col(id_col), F.lit(k)), size + 1).cast("int")
    step = lambda pos, cut, ins: F.struct(pos.alias("pos"), F.lit(cut).alias("cut"), F.lit(ins).alias("ins"))
    return F.array(step(F.lit(0), 0, "Revised: "), step(spot(1), 12, " it's new"), step(spot(2), 25, ""),
                   step(spot(3), 0, " inserted, 2nd"), step(size + 100, 0, "\nEnd."))
