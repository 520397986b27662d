"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

A text becomes counts of hashed features of its whole length: byte trigrams,
four-grams of character classes (the shapes of words), and how often a word
or a pair of words comes again.  Damped and weighted by rarity, the counts of
a bounded sample of labelled documents (``SAMPLE`` rows, half of each label)
give a latent-semantic space of ``DIM`` dimensions.  The labelled vectors and
the projection are broadcast: at most ``SAMPLE`` x ``DIM`` and ``FEATURES`` x
``DIM`` floats, whatever the size of the corpus.

Each block of documents is multiplied with each block of labelled vectors,
exactly, keeping the ``NEIGHBOURS`` largest cosines seen; their labels vote
with a power of the cosine, and with the label's rows for each sampled row, so
that the even sample does not shift the result.

Cases: an empty, NULL or blank text has no direction, and its score is the
share of label 1 among the labelled rows, as is any score without a near
neighbour; without labels it is 0.5; a NULL id is neither held out nor learned
from; of contradicting labels of one id the smaller counts, and of its texts
the one whose features come first; equally near
neighbours are taken in the order of their ids.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import shipped
from tidemark.llm.sampling import held_out, sample_ids

TRIGRAMS, SHAPES = 1 << 12, 1 << 12
FEATURES = TRIGRAMS + SHAPES + 2
DIM, NEIGHBOURS, POWER = 48, 15, 4
#: Weight of the two repetition features among thousands of others.
REPEAT_WEIGHT = 4
#: Most labelled documents that are learned from.
SAMPLE = 4000
#: Documents and labelled vectors multiplied at a time.
DOC_BLOCK, LABEL_BLOCK = 256, 1024
THRESHOLD = 0.3
_PIECE = 1 << 20

_CLASSES = [str.isupper, str.islower, str.isdigit, str.isspace, lambda c: c in ".,;:?", lambda c: c in "!",
            lambda c: c in "'\"()[]-", lambda c: c in "#*$%&", lambda c: c in "|<>"]
#: Class of each byte; other ASCII characters and bytes of other characters have the last two.
_CLASS = bytes(len(_CLASSES) + 1 if b > 127 else next((i for i, f in enumerate(_CLASSES) if f(chr(b))), len(_CLASSES))
               for b in range(256))


def _grams(data: bytes, n: int, size: int) -> np.ndarray:
    """Counts of hashed runs of ``n`` bytes."""
    out = np.zeros(size, np.float32)
    for at in range(0, len(data) - n + 1, _PIECE):
        b = np.frombuffer(data[at:at + _PIECE + n - 1], np.uint8).astype(np.uint32)
        code = b[:len(b) - n + 1]
        for k in range(1, n):
            code = code * np.uint32(0x01000193) ^ b[k:len(b) - n + 1 + k]
        out += np.bincount((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - (size.bit_length() - 1)), minlength=size)
    return out


def features(text: str | None) -> np.ndarray:
    """Damped counts of a whole text."""
    data = (text or "").encode()
    words = data.split()
    out = np.zeros(FEATURES, np.float32)
    if words:
        again = sum(map(eq, words, islice(words, 1, None)))
        pairs = len(words) - 1 - len(set(zip(words, islice(words, 1, None))))
        out[:TRIGRAMS] = _grams(data, 3, TRIGRAMS)
        out[TRIGRAMS:-2] = _grams(data.translate(_CLASS), 4, SHAPES)
        # Shares of the words, on the scale of the other counts.
        out[-2:] = 1000 * again / len(words), 1000 * max(0, pairs) / len(words)
    out = np.log1p(out)
    out[-2:] *= REPEAT_WEIGHT
    return out


@dataclass
class Model:
    prior: float
    project: np.ndarray  # FEATURES x DIM, rarity included
    vectors: np.ndarray  # labelled rows x DIM, of length 1
    labels: np.ndarray
    votes: np.ndarray  # rows of the corpus that a sampled row stands for

    def place(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.project
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Votes for the rows of ``x``, by exact blocked cosine products."""
        if not len(self.vectors):
            return np.full(len(x), self.prior)
        z = self.place(x)
        near = np.empty((len(x), 0), np.float32)
        who = np.empty((len(x), 0), np.int64)
        for at in range(0, len(self.vectors), LABEL_BLOCK):
            cos = z @ self.vectors[at:at + LABEL_BLOCK].T
            near = np.concatenate([near, cos], axis=1)
            who = np.concatenate([who, np.broadcast_to(np.arange(at, at + cos.shape[1]), cos.shape)], axis=1)
            top = np.argsort(-near, axis=1, kind="stable")[:, :NEIGHBOURS]
            near, who = np.take_along_axis(near, top, 1), np.take_along_axis(who, top, 1)
        weight = np.maximum(near, 0).astype(np.float64) ** POWER * self.votes[who]
        total = weight.sum(axis=1)
        return np.where(total > 0, (weight * self.labels[who]).sum(axis=1) / np.where(total > 0, total, 1), self.prior)


class Rows:
    """Feature rows kept as numbers (uint16) and values (float16) of the features that are not zero."""

    def __init__(self, packed: list[bytes]):
        self.packed = packed

    def __len__(self) -> int:
        return len(self.packed)

    @staticmethod
    def pack(x: np.ndarray) -> bytes:
        at = np.flatnonzero(x)
        return at.astype("<u2").tobytes() + x[at].astype("<f2").tobytes()

    def blocks(self, size: int = DOC_BLOCK):
        """The rows as dense blocks, one at a time."""
        for at in range(0, len(self.packed), size):
            part = self.packed[at:at + size]
            x = np.zeros((len(part), FEATURES), np.float32)
            for row, data in zip(x, part):
                n = len(data) // 4
                row[np.frombuffer(data, "<u2", n)] = np.frombuffer(data, "<f2", n, 2 * n)
            yield x


def fit(x: Rows, y: np.ndarray, rows: dict[int, int], seed: int = 3) -> Model:
    """The latent-semantic space of the labelled rows ``x``; ``rows`` has all rows of each label.

    Every product over the rows goes block by block, so no matrix of all rows and features exists.
    """
    prior = rows.get(1, 0) / sum(rows.values()) if rows else 0.5
    if not len(x):
        return Model(prior, np.zeros((FEATURES, DIM), np.float32), np.zeros((0, DIM), np.float32), y, y)
    held = np.zeros(FEATURES, np.int64)
    for b in x.blocks():
        held += (b > 0).sum(axis=0)
    rarity = np.log((1 + len(x)) / (1 + held)).astype(np.float32) + 1

    def weighted():
        for b in x.blocks():
            b *= rarity
            b /= np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-12)
            yield b

    # Randomised range finder with power steps, then an exact decomposition of the small matrix.
    q = np.random.default_rng(seed).standard_normal((FEATURES, DIM + 16)).astype(np.float32)
    for _ in range(4):
        z = np.zeros_like(q)
        for a in weighted():
            z += a.T @ (a @ q)
        q = np.linalg.qr(z)[0]
    _, _, vt = np.linalg.svd(np.concatenate([a @ q for a in weighted()]), full_matrices=False)
    project = np.zeros((FEATURES, DIM), np.float32)
    space = (q @ vt.T)[:, :DIM]
    project[:, :space.shape[1]] = rarity[:, None] * space
    model = Model(prior, project, np.zeros((0, DIM), np.float32), y.astype(np.float64), np.ones(len(y)))
    model.vectors = np.concatenate([model.place(b) for b in x.blocks()]).astype(np.float32)
    n = {k: int((y == k).sum()) for k in (0, 1)}
    model.votes = np.array([rows.get(int(k), 0) / max(1, n[int(k)]) for k in y])
    return model


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", mod: int = 5, remainder: int = 0, sample: int = SAMPLE) -> Model:
    """Learn from at most ``sample`` labelled documents that are not held out; the tasks send counts, never texts."""
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    known = known.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull()
                        & ~held_out(F.col("doc_id"), mod, remainder))
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"))
    ids, rows = sample_ids(known, sample)
    if not ids:
        return fit(Rows([]), np.zeros(0), rows)

    def count(batches):
        for batch in batches:
            x = [Rows.pack(features(t.as_py())) for t in batch.column("text")]
            yield pa.record_batch([batch.column("doc_id"), pa.array(x, pa.binary())], names=["doc_id", "x"])

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    chosen = shipped(d.where(F.col("doc_id").isin(list(ids))))
    # One row for each id, however often it is repeated.
    got = chosen.mapInArrow(count, "doc_id long, x binary").groupBy("doc_id").agg(F.min("x"))
    got = sorted((r[0], bytes(r[1])) for r in got.collect())
    return fit(Rows([x for _, x in got]), np.array([ids[i] for i, _ in got]), rows)


def score(docs: DataFrame, labels: DataFrame, model: Model | None = None, id_col: str = "doc_id",
          text_col: str = "text", label_col: str = "quality", mod: int = 5, remainder: int = 0) -> DataFrame:
    """Per document ``doc_id, held_out, score, predicted``; without a model, one is trained from the labels."""
    model = model or train(docs, labels, id_col, text_col, label_col, mod, remainder)
    shared = shipped(docs).sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            texts, out = batch.column("text"), []
            for at in range(0, len(texts), DOC_BLOCK):
                x = np.array([features(t.as_py()) for t in texts.slice(at, DOC_BLOCK)])
                out.append(np.where(x.any(axis=1), m.score(x), m.prior))
            yield pa.record_batch([batch.column("doc_id"), pa.array(np.concatenate(out) if out else [], pa.float64())],
                                  names=["doc_id", "score"])

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    s = d.mapInArrow(run, "doc_id long, score double")
    return s.select("doc_id", held_out(F.col("doc_id"), mod, remainder).alias("held_out"), "score",
                    (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
