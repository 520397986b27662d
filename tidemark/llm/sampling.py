"""Bounded, repeatable samples of labelled rows for the models that are trained here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_STEPS = 1 << 30
#: Every label may have so many sampled rows, however many labels there are.
LEAST_PER_LABEL = 20


def held_out(id_col: Column, mod: int, remainder: int) -> Column:
    """Whether the CRC-32 of the id as text leaves ``remainder``; false for a NULL id."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(mod)) == remainder, F.lit(False))


def _quota(ids: list[int], size: int) -> int:
    """The largest number of ids to take from each label, so that all labels together give ``size`` where they have it."""
    left, ids = size, sorted(ids)
    for k, n in enumerate(ids):
        if n * (len(ids) - k) > left:
            return max(LEAST_PER_LABEL, left // (len(ids) - k))
        left -= n
    return max(LEAST_PER_LABEL, size)


def sample_ids(labelled: DataFrame, size: int, seed: int = 0, max_classes: int = 1000) -> tuple[dict[int, object], dict]:
    """About ``size`` ids of ``doc_id, label`` with their labels, evenly over the labels, and all labels' row counts.

    Labels with few ids leave their places to the others, and with many labels
    the sample grows, to at most ``LEAST_PER_LABEL`` ids for each of them.

    An id belongs to the sample by the hash of the id alone.  The counts are
    read first, so that a threshold on the hash leaves little more than the
    sample; only those few rows are sorted and reach the driver.  The threshold
    goes by a label's ids, not its rows, so that an id repeated often takes no
    place from others; of an id's labels the smallest counts.  More than
    ``max_classes`` labels are an error: none is left out silently.
    """
    counts = (labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("doc_id").alias("ids"))
              .orderBy(F.desc("n"), "label").limit(max_classes + 1).collect())
    if not counts:
        return {}, {}
    if len(counts) > max_classes:
        raise ValueError(f"more than {max_classes} labels; join rare ones, or raise max_classes")
    quota = _quota([max(1, r.ids) for r in counts], size)
    size = max(size, LEAST_PER_LABEL * len(counts))
    share = F.create_map(*[x for r in counts for x in (F.lit(r.label), F.lit(int(_STEPS * min(1.0, 2 * quota / max(1, r.ids)))))])
    rank = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(_STEPS))
    near = labelled.select("doc_id", "label", rank.alias("rank")).where(F.col("rank") <= share[F.col("label")])
    near = near.groupBy("doc_id", "rank").agg(F.min("label").alias("label"))
    # About twice the sample passes; the limit is far above it.
    out: dict[int, object] = {}
    taken: dict[object, int] = {}
    for x in near.orderBy("rank", "doc_id").limit(8 * size).collect():
        if x.doc_id not in out and taken.get(x.label, 0) < quota:
            taken[x.label] = taken.get(x.label, 0) + 1
            out[x.doc_id] = x.label
    return out, {r.label: r.n for r in counts}
