"""Scores of texts by a log-bilinear neural language model with corpus counts inside its classes.

A token is a word (ASCII letters in lower case) or the end of a text.  Every token
has a class: the end, each of the ``SINGLES`` most frequent words, and ``TAILS``
classes of other words by the hash of their last bytes.  P(token) is
P(class | classes of the ``CONTEXT`` tokens before) x P(token | class).

* The class model is log-bilinear: the vectors of the context's classes, weighted
  by position, add up to a prediction, whose products with the classes' output
  vectors, plus biases, go through a softmax over all classes.  It is trained with
  noise-contrastive estimation (noise from the classes' frequencies, shared within
  a batch) in numpy: first on the driver over at most ``START`` tokens, then by every task over all of its training
  tokens, starting there; the mean of the tasks' parameters, weighted by tokens, is
  the model.  Log-probabilities are normalised exactly, by products of all distinct
  contexts of a batch with all output vectors.
* Inside a class a word's share is (c + 1) / (n + v + 1), from the counts c of all
  training words, n tokens and v distinct words in the class, so that one place is
  left for words that were not seen: the probabilities of all known tokens and one
  unknown word of each class add up to 1.

Counts of the at most ``KNOWN`` most frequent words of at most ``LONGEST`` bytes
are sent to the tasks; other words of a document meet their counts in a join,
where none of them is frequent.

Cases: a NULL, empty or blank text has one token, its end; a NULL id is not held
out; without training texts all counts are 0 and classes are equally likely; rows
with equal ids are scored one by one; texts of any length are read whole, as one
document of a batch; no documents give no rows; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from itertools import chain, repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import save, shipped
from tidemark.llm.sampling import held_out

SINGLES, TAILS = 255, 256
CLASSES = 1 + SINGLES + TAILS
#: Class that stands before the first token; it is never predicted.
START_CLASS = CLASSES
CONTEXT, DIM, NOISE = 2, 32, 32
#: Most tokens that the first parameters are learned from, and updates made on them.
START, START_STEPS = 1 << 20, 768
BATCH, RATE = 4096, 0.15
#: Contexts multiplied with all output vectors at a time.
PRODUCT = 512
#: Words whose counts every task has, and their longest.
KNOWN, LONGEST = 1 << 18, 64
#: Distinct words a task counts before it passes them on; tokens scored together.
_FLUSH, _TOKENS = 400_000, 1 << 19
END = b""


def tokens(text: str | None) -> list[bytes]:
    """Words of a text in UTF-8, A-Z lower-cased, and its end; bytes split at the six ASCII white-space characters."""
    return [*(text or "").encode().lower().split(), END]


def tail(word: bytes) -> int:
    """Class of a word among those without a class of their own."""
    return 1 + SINGLES + crc32(word[-3:]) % TAILS


@dataclass
class Counts:
    """Totals of the training tokens, and what every task knows of frequent words and classes."""
    tokens: int
    distinct: int
    known: dict[bytes, int]  # number of a word; 0 is the end
    count: np.ndarray
    cls: np.ndarray
    size: np.ndarray  # of every class: n + v + 1, or 1 if it has one token
    share: np.ndarray  # of every class among the tokens, smoothed

    def classes(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Of the tokens of texts, one after another: known words' numbers (-1: not known), classes, and other words in order."""
        flat = list(chain.from_iterable(texts))
        ids = np.fromiter(map(self.known.get, flat, repeat(-1)), np.int32, len(flat))
        cls, at = self.cls[ids], np.flatnonzero(ids < 0)
        other = [flat[i] for i in at]
        cls[at] = [tail(w) for w in other]
        return ids, cls, other


def contexts(cls: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Classes of the ``CONTEXT`` tokens before each token, nearest first, within its text; ``ends`` has where texts end."""
    out = np.full((len(cls), CONTEXT), START_CLASS, np.int64)
    first = np.concatenate([[0], ends[:-1]])
    since = np.arange(len(cls)) - np.repeat(first, np.diff(np.concatenate([[0], ends])))
    for k in range(CONTEXT):
        has = since > k
        out[has, k] = cls[np.flatnonzero(has) - k - 1]
    return out


class Model:
    """Parameters of the log-bilinear model: rows of context vectors, output vectors with biases, position weights."""

    def __init__(self, table: np.ndarray):
        self.table = table
        n = CLASSES + 1
        self.context, self.out, self.bias = table[:n, :DIM], table[n:n + CLASSES, :DIM], table[n:n + CLASSES, DIM]
        self.place = table[n + CLASSES:, :DIM]

    @classmethod
    def new(cls, share: np.ndarray, seed: int = 7) -> Model:
        table = np.random.default_rng(seed).normal(0, 0.1, (2 * CLASSES + 1 + CONTEXT, DIM + 1)).astype(np.float32)
        m = cls(table)
        m.bias[:] = np.log(share)
        m.place[:] = 1
        return m

    def predicted(self, before: np.ndarray) -> np.ndarray:
        return sum(self.context[before[:, k]] * self.place[k] for k in range(CONTEXT))

    def log10(self, before: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """Normalised log-probability of each class after its context."""
        base = (CLASSES + 1) ** np.arange(CONTEXT)
        code = before @ base
        # Distinct contexts by a table of all that there can be, which is faster than sorting.
        number = np.zeros(base[-1] * (CLASSES + 1), np.int32)
        number[code] = 1
        distinct = np.flatnonzero(number)
        number[distinct] = np.arange(len(distinct))
        which = number[code]
        h = self.predicted(distinct[:, None] // base % (CLASSES + 1))
        total = np.empty(len(distinct))
        for at in range(0, len(distinct), PRODUCT):
            z = h[at:at + PRODUCT] @ self.out.T
            z += self.bias
            most = z.max(axis=1)
            z -= most[:, None]
            total[at:at + PRODUCT] = most + np.log(np.exp(z, out=z).sum(axis=1))
        out = np.einsum("ij,ij->i", h[which], self.out[cls]) + self.bias[cls] - total[which]
        return out / np.log(10)


def _add_rows(to: np.ndarray, rows: np.ndarray, what: np.ndarray) -> None:
    """``to[rows] += what``, rows repeated."""
    order = np.argsort(rows, kind="stable")
    sorted_rows = rows[order]
    starts = np.flatnonzero(np.concatenate([[True], sorted_rows[1:] != sorted_rows[:-1]]))
    to[sorted_rows[starts]] += np.add.reduceat(what[order], starts, axis=0)


class Trainer:
    """Noise-contrastive estimation by AdaGrad over batches of (context, class)."""

    def __init__(self, table: np.ndarray, share: np.ndarray, seed: int):
        self.model, self.share = Model(table.copy()), share
        self.gain = np.log(NOISE * share).astype(np.float32)
        self.sum = np.full(table.shape, 1e-4, np.float32)
        self.rng, self.seen = np.random.default_rng(seed), 0

    def step(self, before: np.ndarray, cls: np.ndarray) -> None:
        m, n = self.model, CLASSES + 1
        noise = self.rng.choice(CLASSES, NOISE, p=self.share)
        h, target, against = m.predicted(before), m.out[cls], m.out[noise]
        right = (h * target).sum(axis=1) + m.bias[cls] - self.gain[cls]
        wrong = h @ against.T + (m.bias - self.gain)[noise]
        up = 1 / (1 + np.exp(np.clip(right, -30, 30)))
        down = -1 / (1 + np.exp(-np.clip(wrong, -30, 30)))
        grad = np.zeros_like(m.table)
        dh = up[:, None] * target + down @ against
        _add_rows(grad, n + cls, np.concatenate([up[:, None] * h, up[:, None]], axis=1))
        _add_rows(grad, n + noise, np.concatenate([down.T @ h, down.sum(axis=0)[:, None]], axis=1))
        for k in range(CONTEXT):
            _add_rows(grad[:, :DIM], before[:, k], dh * m.place[k])
            grad[n + CLASSES + k, :DIM] = (dh * m.context[before[:, k]]).sum(axis=0)
        grad /= len(cls)
        self.sum += grad * grad
        m.table += RATE * grad / np.sqrt(self.sum)
        self.seen += len(cls)

    def epoch(self, before: np.ndarray, cls: np.ndarray) -> None:
        order = self.rng.permutation(len(cls))
        for at in range(0, len(order), BATCH):
            self.step(before[order[at:at + BATCH]], cls[order[at:at + BATCH]])


def _texts(batch: pa.RecordBatch):
    """Runs of a batch's rows with at most ``_TOKENS`` tokens, or one row: first row, and the tokens of each."""
    start, some, size = 0, [], 0
    for i, text in enumerate(batch.column("text")):
        w = tokens(text.as_py())
        if some and size + len(w) > _TOKENS:
            yield start, some
            start, some, size = i, [], 0
        some.append(w)
        size += len(w)
    if some:
        yield start, some


def word_counts(docs: DataFrame) -> DataFrame:
    """``word binary, tail int, n`` of all tokens of the texts; the empty word is the end."""
    def run(batches):
        def out(c):
            return pa.record_batch([pa.array(list(c), pa.binary()), pa.array([tail(w) for w in c], pa.int32()),
                                    pa.array(list(c.values()), pa.int64())], names=["word", "tail", "n"])
        c = Counter()
        for batch in batches:
            for text in batch.column("text"):
                c.update(tokens(text.as_py()))
                if len(c) > _FLUSH:
                    yield out(c)
                    c = Counter()
        if c:
            yield out(c)

    return shipped(docs).mapInArrow(run, "word binary, tail int, n long").groupBy("word", "tail").agg(F.sum("n").alias("n"))


def _steps(n):
    """Eighths of the power of two of a count: a bounded number of values."""
    return F.floor(8 * F.log2(n))


def gather(counted: DataFrame) -> tuple[Counts, int]:
    """What tasks need of the counts, and the step from which words are known to all."""
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    steps = {r.step: r.words for r in counted.groupBy(_steps(F.col("n")).alias("step")).agg(F.count(F.lit(1)).alias("words")).collect()}
    least, held = max(steps, default=0) + 1, 0
    for step in sorted(steps, reverse=True):
        held += steps[step]
        if held > KNOWN:
            break
        least = step
    rows = counted.where(_known(least)).select("word", "n").collect()
    rows = sorted(((bytes(r.word), r.n) for r in rows), key=lambda r: (r[0] != END, -r[1], r[0]))
    if not rows or rows[0][0] != END:
        rows.insert(0, (END, 0))
    count = np.array([n for _, n in rows], np.int64)
    cls = np.array([i if i <= SINGLES else tail(w) for i, (w, _) in enumerate(rows)], np.int64)
    n, v = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    for r in counted.where(F.col("word") != F.lit(END)).groupBy("tail").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        n[r.tail], v[r.tail] = r.n, r.v
    single = min(len(rows), 1 + SINGLES)
    for i, (w, c) in enumerate(rows[1:single], 1):
        n[tail(w)] -= c
        v[tail(w)] -= 1
    n[:single] = count[:single]
    size = np.where(np.arange(CLASSES) <= SINGLES, 1, n + v + 1)
    return Counts(total.n, total.v, {w: i for i, (w, _) in enumerate(rows)}, count, cls, size, (n + 1) / (n.sum() + CLASSES)), least


def _known(least: int):
    return (_steps(F.col("n")) >= least) & (F.length("word") <= LONGEST) | (F.length("word") == 0)


def train(docs: DataFrame, counts: Counts, seed: int = 7) -> Model:
    """The model over all texts of ``docs``."""
    start = Trainer(Model.new(counts.share, seed).table, counts.share, seed)
    if not counts.tokens:
        return start.model
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(counts)
    # A share of the texts by their hash; equal or very long texts are cut at START tokens.
    part = docs.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < max(1, int(min(1.0, START / counts.tokens) * (1 << 20))))

    def classes(batches):
        for batch in batches:
            for _, texts in _texts(batch):
                cls = np.split(known.value.classes(texts)[1].astype("<u2"), np.cumsum(list(map(len, texts)))[:-1])
                yield pa.record_batch([pa.array([x.tobytes() for x in cls], pa.binary())], names=["cls"])

    first, size = [], 0
    for r in shipped(part).mapInArrow(classes, "cls binary").toLocalIterator():
        first.append(np.frombuffer(bytes(r.cls), "<u2")[:START - size].astype(np.int64))
        size += len(first[-1])
        if size >= START:
            break
    if first:
        before, cls = contexts(np.concatenate(first), np.cumsum([len(x) for x in first])), np.concatenate(first)
        while start.seen < START_STEPS * min(BATCH, len(cls)):
            start.epoch(before, cls)
    begun = spark.sparkContext.broadcast(start.model.table)

    def learn(batches):
        mine = Trainer(begun.value, known.value.share, seed)
        for batch in batches:
            for _, texts in _texts(batch):
                cls = known.value.classes(texts)[1]
                mine.epoch(contexts(cls, np.cumsum(list(map(len, texts)))), cls)
        if mine.seen:
            t = mine.model.table
            yield pa.record_batch([pa.array(range(len(t)), pa.int32()), pa.array([float(mine.seen)] * len(t), pa.float64()),
                                   pa.array(list(t.astype(np.float64)), pa.list_(pa.float64()))], names=["row", "w", "x"])

    mean = [(F.sum(F.col("w") * F.get("x", F.lit(j))) / F.sum("w")).alias(f"x{j}") for j in range(DIM + 1)]
    rows = docs.mapInArrow(learn, "row int, w double, x array<double>").groupBy("row").agg(*mean).collect()
    table = start.model.table.copy()
    for r in rows:
        table[r[0]] = r[1:]
    return Model(table)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mod: int = 7, remainder: int = 2) -> DataFrame:
    """Per document ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``; ids of the remainder are not learned from."""
    d = shipped(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    learned = d.where(~held_out(F.col("doc_id"), mod, remainder)).select("text")
    counted = save(word_counts(learned), "counts")
    counts, least = gather(counted)
    model = train(learned, counts)
    shared = docs.sparkSession.sparkContext.broadcast((counts, model.table))
    kind = dict(d.dtypes)["doc_id"]

    def run(batches):
        c, m = shared.value[0], Model(shared.value[1])
        log_count = np.append(np.log10(c.count + 1), 0)  # the last one: words that are not known here
        log_size, times = np.log10(c.size), np.append(c.count > 0, False)
        for batch in batches:
            for at, texts in _texts(batch):
                ids, cls, other = c.classes(texts)
                ends = np.cumsum(list(map(len, texts)))
                starts = np.concatenate([[0], ends[:-1]])
                one = np.where((cls <= SINGLES) & (ids >= 0), 0, log_count[ids])
                own = m.log10(contexts(cls, ends), cls) - log_size[cls] + one
                cuts = np.cumsum(np.add.reduceat((ids < 0).astype(np.int64), starts))
                rest = [Counter(other[a:b]) for a, b in zip([0, *cuts[:-1]], cuts)]
                yield pa.record_batch(
                    [batch.column("doc_id").slice(at, len(texts)), pa.array(ends - starts),
                     pa.array(np.add.reduceat(times[ids].astype(np.int64), starts)),
                     pa.array(np.add.reduceat(log_count[ids], starts)), pa.array(np.add.reduceat(own, starts)),
                     pa.array([list(r) for r in rest], pa.list_(pa.binary())),
                     pa.array([list(r.values()) for r in rest], pa.list_(pa.int64()))],
                    names=["doc_id", "n_tokens", "n_known", "counts", "own", "word", "n"])

    found = d.mapInArrow(run, f"doc_id {kind}, n_tokens long, n_known long, counts double, own double, word array<binary>, n array<long>")
    found = save(found.withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = found.select("row", F.explode(F.arrays_zip("word", "n")).alias("w")).select("row", "w.word", F.col("w.n").alias("times"))
    rare = (rare.join(counted.where(~_known(least)).select("word", "n"), "word").groupBy("row")
            .agg(F.sum("times").alias("more_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more")))
    more, total = F.coalesce("more", F.lit(0.0)), float(np.log10(counts.tokens + counts.distinct + 1))
    return found.join(rare, "row", "left").select(
        "doc_id", held_out(F.col("doc_id"), mod, remainder).alias("held_out"), "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(counts.tokens).cast("long").alias("train_tokens"),
        (F.col("counts") + more - F.col("n_tokens") * F.lit(total)).alias("base_score"), (F.col("own") + more).alias("score"))
