"""Packing by concatenate and cut.

Pass 1 encodes every document once, on its input partition, and writes its
ids with the running total of tokens in that partition.  The partitions'
totals (one number for each) are summed into global offsets.  Pass 2 reads
the ids back and cuts every document where its global span crosses a multiple
of the window, in Spark's own expressions: no batch of ids is copied to a
Python worker again; a document over a boundary leaves one record on each side.
The stream has no gaps, so only the last sequence is padded.  ``pack`` gives
the pieces, ``sequences`` the training sequences themselves.

Work and memory follow the documents of a task; nothing is shuffled by a key,
so hot sources and groups of copies make no difference.  What reaches the
driver and the tasks of pass 2 is 16 bytes for each input partition.

Cases: NULL and empty texts still give their closing id 0; rows with NULL or
repeated ids are packed like any other; an empty table gives no piece.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import tokens
from tidemark.llm.common import save, shipped

WINDOW = 1024
END_ID = 0
#: Encoded rows of a task are sent on when so many bytes have gathered.
_BATCH_BYTES = 4 << 20


def encoded(docs: DataFrame, tokenizer: str = tokens.TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """Per document ``doc_id, ids`` (little-endian uint32), with its partition and the tokens before it there."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("part", pa.int32()), ("before", pa.int64())])

    def run(batches):
        from pyspark import TaskContext

        part, total, rows, held = TaskContext.get().partitionId(), 0, ([], [], []), 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = np.append(tokens.encode(text.as_py() or "", tokenizer), end_id).astype("<u4").tobytes()
                for column, value in zip(rows, (doc_id, ids, total)):
                    column.append(value)
                total += len(ids) // 4
                held += len(ids)
                if held >= _BATCH_BYTES:
                    yield pa.record_batch([rows[0], rows[1], [part] * len(rows[0]), rows[2]], schema=schema)
                    rows, held = ([], [], []), 0
        if rows[0]:
            yield pa.record_batch([rows[0], rows[1], [part] * len(rows[0]), rows[2]], schema=schema)

    return shipped(docs).mapInArrow(run, "doc_id long, ids binary, part int, before long")


def offsets(ids: DataFrame) -> dict[int, int]:
    """Tokens before each partition: prefix sums over the partitions' totals."""
    totals = ids.groupBy("part").agg(F.max(F.col("before") + F.octet_length("ids") / 4).cast("long").alias("n"))
    out, total = {}, 0
    for part, n in sorted(totals.collect()):
        out[part] = total
        total += n
    return out


def cut(ids: DataFrame, starts: dict[int, int], window: int = WINDOW) -> DataFrame:
    """One row for each piece of a document inside one window; built-in expressions only, no Python worker."""
    table = pa.table({"part": pa.array(starts.keys(), pa.int32()), "first": pa.array(starts.values(), pa.int64())})
    known = ids.sparkSession.createDataFrame(table)
    n, at = (F.octet_length("ids") / 4).cast("long"), F.col("first") + F.col("before")
    d = ids.join(F.broadcast(known), "part").select("doc_id", "ids", n.alias("n"), at.alias("at")).where("n > 0")
    d = d.select("*", F.explode(F.expr(f"sequence(at div {window}, (at + n - 1) div {window})")).alias("sequence_id"))
    begin = F.col("sequence_id") * window - F.col("at")  # of the window, in the document
    start = F.greatest(F.lit(0).cast("long"), begin)
    length = F.least(F.col("n"), begin + window) - start
    own = F.substring("ids", (4 * start + 1).cast("int"), (4 * length).cast("int"))
    return d.select("doc_id", start.alias("start"), length.alias("length"), F.crc32(own).alias("ids_crc32"),
                    F.col("n").alias("doc_tokens"), "sequence_id", ((F.col("at") + start) % window).alias("offset"))


def runs(ids: DataFrame, starts: dict[int, int], window: int = WINDOW) -> DataFrame:
    """The stream in pieces ``sequence_id, offset, ids``: neighbours that a task reads together are one piece.

    A task holds one sequence and one batch; most pieces are whole sequences.
    """
    schema = pa.schema([("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.list_(pa.int32()))])
    known = ids.sparkSession.sparkContext.broadcast(starts)

    def run(batches):
        begun, held, parts = 0, 0, []  # where the piece in work begins, its length and its ids
        for batch in batches:
            out = []
            for data, part, before in zip(*(batch.column(c) for c in ("ids", "part", "before"))):
                values, at = np.frombuffer(data.as_buffer(), "<u4"), known.value[part.as_py()] + before.as_py()
                if held and at != begun + held:
                    out.append((begun, np.concatenate(parts)))
                    held, parts = 0, []
                while len(values):
                    if not held:
                        begun = at
                    values, piece = values[(n := min(window - at % window, len(values))):], values[:n]
                    at, held = at + n, held + n
                    parts.append(piece)
                    if at % window == 0:
                        out.append((begun, np.concatenate(parts)))
                        held, parts = 0, []
            parts = [np.concatenate(parts)] if parts else []  # no view of this batch is kept
            yield piece_rows(out)
        if held:
            yield piece_rows([(begun, parts[0])])

    def piece_rows(out):
        return pa.record_batch([[at // window for at, _ in out], [at % window for at, _ in out],
                                pa.array([v.astype("<i4") for _, v in out], pa.list_(pa.int32()))], schema=schema)

    return shipped(ids).mapInArrow(run, "sequence_id long, offset long, ids array<int>")


def sequences(docs: DataFrame, text_col: str = "text", window: int = WINDOW, tokenizer: str = tokens.TOKENIZER,
              end_id: int = END_ID, pad_id: int | None = None) -> DataFrame:
    """The packed training sequences ``sequence_id, ids``, numbered as in ``pack``.

    All have ``window`` ids but the last, which is filled up with ``pad_id``
    if one is given.  Whole sequences stay where they were read; only the
    pieces at the ends of what a task reads are shuffled, at most ``window``
    of them for a sequence.  An empty table gives no sequence.
    """
    d = docs.select(F.lit(None).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ids = save(encoded(d, tokenizer, end_id), "packing-ids")
    pieces = save(runs(ids, offsets(ids), window), "packing-runs")
    whole = F.size("ids") == window
    joined = pieces.where(~whole).groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    out = pieces.where(whole).select("sequence_id", "ids").unionByName(
        joined.select("sequence_id", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids")))
    if pad_id is None:
        return out
    fill = F.array_repeat(F.lit(pad_id).cast("int"), F.lit(window) - F.size("ids"))
    return out.select("sequence_id", F.concat("ids", fill).alias("ids"))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
         tokenizer: str = tokens.TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """Pieces ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` of the packed documents."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ids = save(encoded(d, tokenizer, end_id), "packing-ids")
    return cut(ids, offsets(ids), window)
