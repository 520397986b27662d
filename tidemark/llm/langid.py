"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text's letters are folded, and its 2-, 3- and 4-byte subwords (with word
boundaries) are hashed into ``BUCKETS`` embeddings, whose average goes through
a linear softmax.  Both layers are trained together by stochastic gradient
descent in numpy, on the driver, from a bounded sample of labelled documents
(``SAMPLE`` rows, spread evenly over the languages; the tasks send subword
counts, never texts).  A part of the sample that is not trained on calibrates
the scores: one temperature for the probabilities, and a score below which a
document is rejected.

The probabilities only weigh the learned languages against each other.  So each
language also keeps how usual every subword is in its training part, and the
score is the probability times how usual the text is: 1 down to the least usual
rightly labelled calibration texts, less by the factor e for each further unit
of the mean log share.  Texts in languages that were not learned fall far below,
also where one or two languages are learned.

Scoring reads every whole text once, in place; nothing is shuffled.  The
broadcast model has twice ``BUCKETS`` x languages floats, 262 MB at the most
languages that can be learned (``sampling``: more are an error).

Cases: NULL texts and texts without a letter are ``und`` with score 0 and are
rejected; without anything to learn from, every text is; a NULL id is neither
held out nor learned from; of an id's rows one is learned from; repeated rows and ties get equal results (the
alphabetically first of equally likely languages); a very long text is counted
whole, in pieces; an empty table gives an empty result; extra columns are not
looked at, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import shipped
from tidemark.llm.sampling import held_out, sample_ids

UNKNOWN = "und"
BUCKETS, DIM = 1 << 15, 16
#: Most labelled documents that are learned from, and the share of them that calibrates.
SAMPLE, CALIBRATION = 3000, 0.2
#: Passes over the training part, more of them until there are ``STEPS`` steps.
EPOCHS, STEPS, RATE = 6, 15_000, 0.5
#: Share of rightly labelled calibration texts that may fall under the rejection score, and that score's upper limit.
REJECT_SHARE, REJECT_MOST = 0.001, 0.4
#: Documents that an unseen subword counts for, and subwords of middling use added to every text: a few say little.
UNSEEN, USUAL = 1e-4, 10
_SIZES = (2, 3, 4)
_LETTER = regex.compile(r"\p{L}")
#: ASCII letters and bytes of other characters stay, the rest separates words.
_FOLD = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
#: Bytes hashed together; a long text goes through in pieces that overlap.
_PIECE = 1 << 20


def subwords(text: str) -> np.ndarray:
    """Counts of the hashed subwords of a whole text."""
    data = b" " + b" ".join(text.lower().encode().translate(_FOLD).split()) + b" "
    out = np.zeros(BUCKETS, np.float32)
    for at in range(0, len(data), _PIECE):
        b = np.frombuffer(data[at:at + _PIECE + max(_SIZES) - 1], np.uint8).astype(np.uint32)
        code = b
        for n in range(2, max(_SIZES) + 1):
            code = code[:-1] * np.uint32(0x01000193) ^ b[n - 1:]
            own = code[:max(0, min(_PIECE, len(data) - n + 1 - at))]  # those that begin in this piece
            hashed = (own * np.uint32(0x9E3779B1) + np.uint32(n)) >> np.uint32(32 - (BUCKETS.bit_length() - 1))
            out += np.bincount(hashed, minlength=BUCKETS)
    return out


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # embeddings times output layer: BUCKETS x languages
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0
    habit: np.ndarray | None = None  # log shares of the subwords: languages x BUCKETS
    middle: float = 0.0  # mean log share of the middle calibration text, and of the least usual ones
    least: float = -np.inf

    def logits(self, counts: np.ndarray) -> np.ndarray:
        return counts @ self.table / max(1.0, counts.sum()) + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.langs or not text or not _LETTER.search(text):
            return UNKNOWN, 0.0
        counts = subwords(text)
        p = _softmax(self.logits(counts) / self.temperature)
        k = int(p.argmax())
        log_share = 0.0 if self.habit is None else counts @ self.habit[k] / max(1.0, counts.sum())
        return self.langs[k], float(p[k] * self.usual(log_share, counts.sum()))

    def usual(self, log_share: np.ndarray, n: np.ndarray) -> np.ndarray:
        """How usual texts are, 0 to 1, by the mean log share of their ``n`` subwords."""
        return np.exp(np.minimum(0, (log_share * n + self.middle * USUAL) / (n + USUAL) - self.least))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(examples: list[tuple[np.ndarray, np.ndarray, str]], seed: int = 1) -> Model:
    """Train on ``(buckets, counts, lang)`` of the examples, then calibrate on those left out."""
    langs = sorted({lang for *_, lang in examples})
    if not langs:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.float32))
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(examples))
    n_cal = int(len(examples) * CALIBRATION)
    cal, train = order[:n_cal], order[n_cal:]
    target = np.array([langs.index(lang) for *_, lang in examples])
    table = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    epochs = max(EPOCHS, -(-STEPS // len(train)))
    steps, done = epochs * len(train), 0
    for _ in range(epochs):
        for i in rng.permutation(train):
            idx, counts, _ = examples[i]
            share = (counts / counts.sum()).astype(np.float32)
            hidden = share @ table[idx]
            grad = _softmax(hidden @ out + bias)
            grad[target[i]] -= 1
            rate = RATE * (1 - done / steps)
            # An averaged embedding moves little by each subword, hence the larger step there.
            table[idx] -= (rate * 50 * share)[:, None] * (out @ grad)[None, :]
            out -= rate * np.outer(hidden, grad)
            bias -= rate * 0.1 * grad
            done += 1
    habit = np.full((len(langs), BUCKETS), UNSEEN, np.float32)
    for i in train:
        idx, counts, _ = examples[i]
        habit[target[i], idx] += counts / counts.sum()
    habit = np.log(habit / habit.sum(axis=1, keepdims=True))
    model = Model(langs, table @ out, bias, habit=habit)
    if len(cal):
        z = np.array([examples[i][1] @ model.table[examples[i][0]] / examples[i][1].sum() + bias for i in cal])
        y = target[cal]
        loss = lambda t: -np.log(_softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean()
        model.temperature = float(min(np.geomspace(0.05, 5, 60), key=loss))
        p = _softmax(z / model.temperature)
        right = p.argmax(axis=1) == y
        if right.any():
            n = np.array([examples[i][1].sum() for i in cal])[right]
            log_share = np.array([examples[i][1] @ habit[target[i], examples[i][0]] for i in cal])[right] / n
            model.middle = float(np.median(log_share))
            model.least = float(np.quantile((log_share * n + model.middle * USUAL) / (n + USUAL), REJECT_SHARE))
            score = p.max(axis=1)[right] * model.usual(log_share, n)
            model.threshold = float(min(REJECT_MOST, np.quantile(score, REJECT_SHARE)))
    return model


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", mod: int = 4,
          remainder: int = 2, sample: int = SAMPLE) -> Model:
    """Learn from at most ``sample`` labelled documents that are not held out."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                    F.col(lang_col).cast("string").alias("label"))
    d = d.where(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), mod, remainder))
    ids, _ = sample_ids(d.select("doc_id", "label"), sample)
    if not ids:
        return fit([])

    def count(batches):
        for batch in batches:
            rows = []
            for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                counts = subwords(t.as_py() or "")
                idx = np.flatnonzero(counts)
                if len(idx):
                    rows.append((i, idx.astype("<u2").tobytes(), counts[idx].astype("<f4").tobytes()))
            yield pa.record_batch([list(c) for c in zip(*rows)] if rows else [[], [], []],
                                  schema=pa.schema([("doc_id", pa.int64()), ("idx", pa.binary()), ("counts", pa.binary())]))

    chosen = shipped(d.where(F.col("doc_id").isin(list(ids))).select("doc_id", "text"))
    # One row for each id, however often it is repeated.
    rows = chosen.mapInArrow(count, "doc_id long, idx binary, counts binary").groupBy("doc_id")
    rows = rows.agg(F.min(F.struct("idx", "counts")).alias("x")).select("doc_id", "x.idx", "x.counts").collect()
    rows = sorted(rows, key=lambda r: r.doc_id)
    return fit([(np.frombuffer(r.idx, "<u2").astype(np.int64), np.frombuffer(r.counts, "<f4"), ids[r.doc_id]) for r in rows])


def predictor(docs: DataFrame, model: Model):
    """A column function: the struct ``lang, score, rejected`` of a text."""
    shared = shipped(docs).sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double, rejected boolean")
    def predict(texts: pd.Series) -> pd.DataFrame:
        m = shared.value
        out = [m.predict(t) for t in texts]
        return pd.DataFrame({"lang": [x for x, _ in out], "score": [s for _, s in out],
                             "rejected": [x == UNKNOWN or s < m.threshold for x, s in out]})

    return predict


def identify(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text",
             lang_col: str = "lang", mod: int = 4, remainder: int = 2) -> DataFrame:
    """Per document ``doc_id, held_out, lang_pred, score, rejected``; without a model, one is trained from ``docs``."""
    model = model or train(docs, id_col, text_col, lang_col, mod, remainder)
    p = docs.select(F.col(id_col).cast("long").alias("doc_id"), predictor(docs, model)(F.col(text_col)).alias("p"))
    return p.select("doc_id", held_out(F.col("doc_id"), mod, remainder).alias("held_out"),
                    F.col("p.lang").alias("lang_pred"), "p.score", "p.rejected")


def accepted(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text",
             lang_col: str = "lang") -> DataFrame:
    """``docs`` without the documents that the identifier rejects."""
    model = model or train(docs, id_col, text_col, lang_col)
    row = docs.select(F.struct("*").alias("doc"))
    row = row.select("doc", predictor(docs, model)(F.col(f"doc.`{text_col}`")).alias("p")).where("NOT p.rejected")
    return row.select(*[F.col(f"doc.`{c}`") for c in docs.columns])
