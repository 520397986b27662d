"""Ranked lexical search over posting lists with per-term geometric blocking.

The items' texts are taken in blocks of at most ``ITEMS`` items; for each block
one pass over the documents keeps, for every document, its length and the
frequencies of the terms that the block asks for, written once as a table.  The
lists are divided by documents: a task indexes its own rows, ``CELLS`` cells of
(document, term) at a time, and never sends postings anywhere.

In such an index every term's posting list is ordered by document similarity
(the nearest of a few pivot documents by inner product, then the product
itself) and cut into blocks of ``BLOCK`` postings.  A block's summary holds the
coordinatewise maximum of its documents' weighted vectors, over the terms that
some item asks for together with the list's own term: no item reads others.  The
sum of a summary over an item's terms is at least the score of every document in
the block, in the same integers, so a block is skipped only when that sum is
under the item's ``k``-th best score so far; others are scored exactly.

Cases: a NULL, empty or blank text has no term, neither as a document nor as an
item (such an item has no rows); a document without an id counts and ranks after
others of equal score; every row is a document or an item of its own, also where
ids or texts repeat; very long texts are read whole; without documents or items
the result is empty; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import save, shipped

#: Items searched in one pass over the documents, and terms after which a block of items is closed.
ITEMS, ITEM_TERMS = 256, 16_384
#: Cells (documents x terms) of a task's index, and most documents in it.
CELLS, SHARD = 8 << 20, 2048
#: Postings of a block.
BLOCK = 32
K = 10
#: Length normalisation and saturation of the score.
BASE, SLOPE, SATURATION, SCALE = 100, 90, 8, 1_000_000_000

#: ASCII letters, digits and all bytes of other characters belong to terms; A-Z are lower-cased.
_TERMS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b > 0x7F else 0x20
               for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """All terms of a text, in order."""
    return (text or "").encode().translate(_TERMS).split()


@dataclass
class Items:
    """A block of items: the terms asked for, each item's terms, and the terms asked for together with each."""
    vocabulary: dict[bytes, int]
    asked: list[np.ndarray]

    def __post_init__(self):
        with_term: list[set] = [set() for _ in self.vocabulary]
        for q in self.asked:
            for t in q:
                with_term[t].update(q)
        self.beside = [np.array(sorted(s), np.int64) for s in with_term]
        #: For each item, where its terms stand in the summaries of each of its lists.
        self.places = [[np.searchsorted(self.beside[t], q) for t in q] for q in self.asked]


def item_blocks(rows: Iterator[tuple], items: int = ITEMS) -> Iterator[tuple[list, Items]]:
    """Blocks of (item id, text) rows; no more than one block is held."""
    ids, vocabulary, asked = [], {}, []
    for item_id, text in rows:
        ids.append(item_id)
        asked.append(np.array(sorted({vocabulary.setdefault(t, len(vocabulary)) for t in terms(text)}), np.int64))
        if len(ids) >= items or len(vocabulary) >= ITEM_TERMS:
            if vocabulary:
                yield ids, Items(vocabulary, asked)
            ids, vocabulary, asked = [], {}, []
    if vocabulary:
        yield ids, Items(vocabulary, asked)


class Index:
    """Blocked posting lists of the rows of ``x`` (documents x terms, weighted)."""

    def __init__(self, x: np.ndarray, items: Items, ids: np.ndarray, without: np.ndarray, block: int = BLOCK):
        self.x, self.items, self.ids, self.without = x, items, ids, without
        order = self._similar(x)
        self.lists, self.summaries = [], []
        for t, beside in enumerate(items.beside):
            docs = order[x[order, t] > 0]
            self.lists.append([docs[i:i + block] for i in range(0, len(docs), block)])
            if len(docs):
                own = x[np.ix_(docs, beside)]
                self.summaries.append(np.maximum.reduceat(own, np.arange(0, len(docs), block), axis=0))
            else:
                self.summaries.append(np.zeros((0, len(beside)), np.int64))

    @staticmethod
    def _similar(x: np.ndarray) -> np.ndarray:
        """The rows with like ones side by side: by nearest pivot, then by closeness to it."""
        y = x.astype(np.float32)
        y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)
        pivots = np.linspace(0, len(y) - 1, max(1, int(len(y) ** 0.5))).astype(int)
        near = y @ y[pivots].T
        at = near.argmax(axis=1)
        return np.lexsort((-near[np.arange(len(y)), at], at))

    def bounds(self, item: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """For an item, the summary bounds of the blocks of its lists, and their documents."""
        parts, blocks = [np.zeros(0, np.int64)], []
        for t, place in zip(self.items.asked[item], self.items.places[item]):
            parts.append(self.summaries[t][:, place].sum(axis=1))
            blocks += self.lists[t]
        return np.concatenate(parts), blocks

    def search(self, item: int, best: "Best") -> tuple[int, int]:
        """Bring the documents of this index that are among the item's best into ``best``; blocks scored, and all."""
        bound, blocks = self.bounds(item)
        order, at, step, scored = np.argsort(-bound, kind="stable"), 0, 4, 0
        done = np.zeros(len(self.x), bool)
        while at < len(order) and bound[order[at]] >= best.least:
            some = [b for b in order[at:at + step] if bound[b] >= best.least]
            docs = np.unique(np.concatenate([blocks[b] for b in some]))
            docs = docs[~done[docs]]
            done[docs] = True
            best.add(self.x[np.ix_(docs, self.items.asked[item])].sum(axis=1), self.ids[docs], self.without[docs])
            at, step, scored = at + step, step * 2, scored + len(some)
        return scored, len(order)


class Best:
    """The ``k`` highest scores of an item, ties by id with missing ids last."""

    def __init__(self, k: int):
        self.k, self.scores = k, np.zeros(0, np.int64)
        self.ids, self.without = np.zeros(0, np.int64), np.zeros(0, bool)

    @property
    def least(self) -> int:
        """No score below this one can enter."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, ids: np.ndarray, without: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        without = np.concatenate([self.without, without])
        top = np.lexsort((ids, without, -scores))[:self.k]
        top = top[scores[top] > 0]
        self.scores, self.ids, self.without = scores[top], ids[top], without[top]


def postings(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document with a term ``doc_id, n, term array, tf array``, of the terms in ``vocabulary``."""
    shared = shipped(docs).sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        get = shared.value.get
        for batch in batches:
            out = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = terms(text.as_py())
                if words:
                    found = Counter(filter(lambda v: v is not None, map(get, words)))
                    out.append((i, len(words), list(found), list(found.values())))
            cols = list(zip(*out)) or [()] * 4
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (
                pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64())))], names=["doc_id", "n", "term", "tf"])

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return d.mapInArrow(run, "doc_id long, n long, term array<int>, tf array<long>")


def weights(kept: DataFrame, size: int) -> tuple[np.ndarray, int, int]:
    """Weight of every term of the vocabulary, documents with a term, and all their terms."""
    total = kept.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    df = np.zeros(size, np.int64)
    for r in kept.select(F.explode("term").alias("term")).groupBy("term").count().toLocalIterator():
        df[r["term"]] = r["count"]
    return np.floor(1000 * np.log((2 * total.docs + 2) / (2 * df + 1))).astype(np.int64), total.docs, total.terms


def _ranked(kept: DataFrame, items: Items, k: int) -> DataFrame:
    """Per task and item the ``k`` best documents of the task: ``item int, doc_id, score``."""
    w, n_docs, n_terms = weights(kept, len(items.vocabulary))
    shared = kept.sparkSession.sparkContext.broadcast((items, w))
    most = min(SHARD, max(16, CELLS // len(items.vocabulary)))

    def run(batches):
        block, weight = shared.value
        best = [Best(k) for _ in block.asked]
        for batch in batches:
            for at in range(0, len(batch), most):
                part = batch.slice(at, most)
                n, term, tf = (part.column(c) for c in ("n", "term", "tf"))
                norm = BASE - SLOPE + SLOPE * n.to_numpy() * n_docs // n_terms
                size = np.diff(term.offsets.to_numpy())
                doc = np.repeat(np.arange(len(part)), size)
                t, f = term.flatten().to_numpy(), tf.flatten().to_numpy()
                x = np.zeros((len(part), len(weight)), np.int64)
                x[doc, t] = weight[t] * (SCALE * f // (1000 * f + SATURATION * norm[doc]))
                ids = part.column("doc_id")
                index = Index(x, block, ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False))
                for item, b in enumerate(best):
                    index.search(item, b)
        rows = [(item, None if w else int(i), int(s)) for item, b in enumerate(best)
                for s, i, w in zip(b.scores, b.ids, b.without)]
        cols = list(zip(*rows)) or [()] * 3
        yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int64()))],
                              names=["item", "doc_id", "score"])

    return kept.where(F.size("term") > 0).mapInArrow(run, "item int, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text", block: int = ITEMS) -> DataFrame:
    """The ``k`` highest-scoring documents of every item row: ``item_id, rank, doc_id, score``."""
    spark = docs.sparkSession
    kind = items.schema[item_col].dataType
    empty = spark.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id long, score long")
    rows = items.select(item_col, F.col(item_text_col)).toLocalIterator()
    found = []
    for ids, asked in item_blocks(rows, block):
        kept = save(postings(docs, asked.vocabulary, id_col, text_col), "postings")
        # Few rows for each task and item; the item's number tells equal ids apart.
        names = spark.createDataFrame(list(enumerate(ids)), f"item int, item_id {kind.simpleString()}")
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        best = _ranked(kept, asked, k).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        found.append(best.join(names, "item").select("item_id", "rank", "doc_id", "score"))
    return reduce(DataFrame.unionByName, found, empty)
