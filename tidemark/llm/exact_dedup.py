"""Exact deduplication by content-defined chunk recipes.

1. Every text is cut into chunks where a rolling hash of its last 32 bytes
   has a fixed pattern, so equal passages give equal chunks wherever they are.
2. Chunks are deduplicated to identifiers: one shuffle groups them by digest
   *and* content, and an identifier is verified when its digest has a single
   content.  Where a digest has several, each content gets a variant number.
3. A document's recipe is the ordered list of its chunk identifiers.  Texts
   are equal exactly when their recipes are, so groups are formed from the
   recipes (16 bytes for about 2 KiB) and no document is moved again.

Copies are combined before each shuffle, so a group of copies holding a third
of all rows ends in one small row per task; the join that hands a group's
result back broadcasts the groups that hold more than a thousandth of all rows
(fewer than a thousand) and shuffles the others.

Cases: NULL text counts as empty, and all empty texts are equal.  The row with
the largest ``doc_id`` stays; a NULL ``doc_id`` loses to any other, and in a
group without ids ``keep_id`` is NULL and every row is kept.  Rows that repeat
both id and text are the same document and share the flag.  A very long text
is cut and compared whole; an empty table gives an empty result; extra columns
are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import join_by_key, numbered, save, shipped, without_rows

MIN_CHUNK, AVG_CHUNK, MAX_CHUNK = 512, 2048, 8192
WINDOW = 32
DIGEST_BYTES = 16
#: Most bytes of chunks with a clashing digest that the driver hands to the tasks (none are expected).
MAX_CLASH_BYTES = 64 << 20
#: Longest recipe of a large group that is broadcast, in bytes (a text of about 1 MB).
MAX_HOT_RECIPE = 8192
#: Chunks of a task are sent on when so many bytes have gathered.
_BATCH_BYTES = 4 << 20


@lru_cache(1)
def _gear() -> np.ndarray:
    return np.random.default_rng(7).integers(0, 1 << 32, 256, dtype=np.uint32)


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks of ``data``; they depend on the content alone."""
    n = len(data)
    if n <= MIN_CHUNK:
        return [n] if n else []
    # Rolling sum of shifted table values over WINDOW bytes, by doubling.
    h = _gear()[np.frombuffer(data, np.uint8)]
    for k in (1, 2, 4, 8, 16):
        h[k:] += h[:-k] << np.uint32(k)
    spots = np.flatnonzero(h >> np.uint32(32 - (AVG_CHUNK - 1).bit_length()) == 0) + 1
    out, last = [], 0
    for s in spots.tolist():
        if s - last < MIN_CHUNK:
            continue
        while s - last > MAX_CHUNK:
            last += MAX_CHUNK
            out.append(last)
        if s - last >= MIN_CHUNK:
            last = s
            out.append(last)
    while n - last > MAX_CHUNK:
        last += MAX_CHUNK
        out.append(last)
    if last < n:
        out.append(n)
    return out


def chunks(data: bytes) -> list[bytes]:
    ends = cuts(data)
    return [data[a:b] for a, b in zip([0, *ends], ends)]


def _digest(chunk: bytes, size: int) -> bytes:
    return xxhash.xxh3_128_digest(chunk)[:size]


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    for t in batch.column("text").cast(pa.large_binary()):
        yield t.as_py() or b""


def distinct_chunks(docs: DataFrame, digest_bytes: int = DIGEST_BYTES) -> DataFrame:
    """One row ``(digest, content)`` for each distinct chunk of the texts."""
    def cut(batches):
        schema = pa.schema([("digest", pa.binary()), ("content", pa.binary())])
        found: dict[bytes, bytes] = {}
        held = 0
        for batch in batches:
            for data in _texts(batch):
                for c in chunks(data):
                    if c not in found:
                        found[c] = _digest(c, digest_bytes)
                        held += len(c)
                if held >= _BATCH_BYTES:
                    yield pa.record_batch([list(found.values()), list(found)], schema=schema)
                    found, held = {}, 0
        if found:
            yield pa.record_batch([list(found.values()), list(found)], schema=schema)

    rows = shipped(docs.select("text")).mapInArrow(cut, "digest binary, content binary")
    return rows.groupBy("digest", "content").agg(F.count(F.lit(1)).alias("uses"))


def clashes(distinct: DataFrame) -> dict[bytes, dict[bytes, int]]:
    """Variant numbers of the contents that share a digest; empty when every identifier is verified."""
    many = distinct.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest")
    if many.isEmpty():
        return {}
    rows = distinct.join(many, "digest").select("digest", "content")
    size = rows.agg(F.sum(F.octet_length("content"))).first()[0]
    if size > MAX_CLASH_BYTES:
        raise RuntimeError(f"{size} bytes of chunks share a digest; use more digest_bytes")
    out: dict[bytes, dict[bytes, int]] = {}
    for d, c in sorted((bytes(r.digest), bytes(r.content)) for r in rows.collect()):
        of = out.setdefault(d, {})
        of[c] = len(of)
    return out


def recipes(docs: DataFrame, variants: dict[bytes, dict[bytes, int]] | None = None,
            digest_bytes: int = DIGEST_BYTES) -> DataFrame:
    """Per row: the columns but ``text`` (all of them long), ``text_sha256`` and ``recipe``, the chunk identifiers in order."""
    longs = [c for c in docs.columns if c != "text"]
    schema = pa.schema([*((c, pa.int64()) for c in longs), ("text_sha256", pa.string()), ("recipe", pa.binary())])
    known = docs.sparkSession.sparkContext.broadcast(variants or {})

    def read(batches):
        of = known.value
        for batch in batches:
            sha, lists = [], []
            for data in _texts(batch):
                ids = []
                for c in chunks(data):
                    d = _digest(c, digest_bytes)
                    ids.append(d + of[d][c].to_bytes(4, "big") if d in of else d + bytes(4) if of else d)
                sha.append(hashlib.sha256(data).hexdigest())
                lists.append(b"".join(ids))
            yield pa.record_batch([*(batch.column(c).cast(pa.int64()) for c in longs), sha, lists], schema=schema)

    return shipped(docs).mapInArrow(read, "".join(f"{c} long, " for c in longs) + "text_sha256 string, recipe binary")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     digest_bytes: int = DIGEST_BYTES) -> DataFrame:
    """Per row: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    variants = clashes(distinct_chunks(d, digest_bytes))
    each = save(recipes(d, variants, digest_bytes), "recipes")
    groups = each.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = save(groups.where("group_size > 1").withColumn("n", F.col("group_size")), "recipe-groups")
    joined = join_by_key(each, groups, "recipe", each.count(), "left", F.octet_length("recipe") <= MAX_HOT_RECIPE)
    alone = F.col("group_size").isNull()
    keep = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
                         F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", null_ids: bool = False) -> DataFrame:
    """``docs`` with one row of each group of equal texts, the largest id; of rows that repeat that id, any one.

    The verdict is on rows, not on ids: another text under the same id has its
    own.  Rows without an id stay, all of them; with ``null_ids`` they take part
    like others and lose to any id.
    """
    docs_, row = numbered(docs, "exact-rows")
    d = docs_.select(F.col(id_col).cast("long").alias("doc_id"), F.col(row).alias("row"), F.col(text_col).alias("text"))
    each = save(recipes(d, clashes(distinct_chunks(d))), "recipes")
    # A NULL id is smaller than any other.
    best = each.groupBy("recipe").agg(F.max(F.struct("doc_id", "row")).alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1")
    groups = save(best.select("recipe", "n", F.col("best.row").alias("best")), "recipe-groups")
    small = F.octet_length("recipe") <= MAX_HOT_RECIPE
    dropped = join_by_key(each, groups, "recipe", each.count(), small=small).where("row <> best")
    if not null_ids:
        dropped = dropped.where("doc_id IS NOT NULL")
    return without_rows(docs_, row, dropped.select("row")).select(*[F.col(f"`{c}`") for c in docs.columns])
