"""SimHash near-duplicates by a Gray-order hierarchical index.

Fingerprints: every bit is the majority vote of the 64-bit hashes of a text's
word shingles.  Equal fingerprints are combined first, so a group of exact
copies is one entry.

Index: two fingerprints that differ in at most ``max_bits`` bits agree in at
least one of ``max_bits + 1`` bit fields.  So there is one Gray order for each
field, with that field's bits first: fingerprints that agree in the field (a
top node) lie together, and neighbouring top nodes differ in few bits.  Tasks
take ranges of that order.  In a task, runs of neighbours form leaves and runs
of leaves form upper nodes, across top nodes, and each node keeps the bits
that all its members share.  The search walks pairs of nodes downwards from
the root, adding up the differences of the bits that a level newly fixes, and
drops a pair, that is two whole groups, as soon as the sum passes ``max_bits``
or a bit of the field differs.  Only leaves that are left are compared one by
one; ``GrayIndex.seen`` counts the pairs of nodes visited, pruned and compared.

A top node with more than ``MAX_GROUP`` members is divided again: its free
bits form new fields, by the same argument, so no pair is lost.  With 16 free
bits left a node has at most 65,536 members, so the division ends; a task
indexes whole top nodes until it holds ``MAX_INDEX`` fingerprints, then starts
the next index.  Each index hands on a spanning forest of its links, not its
pairs; connected components are then found by large-star and small-star
rounds, each written as a table.  Keys with more than a thousandth of all rows
(empty texts, exact copies, the hub of a component) are joined by broadcast;
there are fewer than a thousand of them.

Cases: NULL and blank texts have fingerprint zero and are linked like others;
a NULL ``doc_id`` takes part but never names a component that has an id;
repeated rows get equal results (``keep_one`` numbers the rows and keeps
one); a very long text is hashed whole, shingle by shingle, and its votes are
added up in blocks; ties of a vote leave the bit unset; an empty table gives
an empty result; extra columns are not looked at, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import join_by_key, numbered, save, shipped, without_rows

SHINGLE_WORDS = 3
MAX_BITS = 3
SEED = 42
#: Most fingerprints under one top node.
MAX_GROUP = 1 << 16
#: Fingerprints from which a task closes one index and starts the next; the last top node comes in whole.
MAX_INDEX = 1 << 16
LEAF, FANOUT = 16, 8
#: Node pairs and fingerprint pairs looked at together, and shingles voted on together.
_NODE_PAIRS, _PAIRS, _VOTES = 1 << 14, 1 << 18, 1 << 16


# ---------------------------------------------------------------- fingerprints

def fingerprint(text: str | None, k: int = SHINGLE_WORDS) -> int:
    """The 64-bit fingerprint of a text (ASCII letters folded, words split at ASCII white space)."""
    line = b" ".join((text or "").encode().lower().split())
    if not line:
        return 0
    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    if len(gaps) < k:
        spans = [(0, len(line))]
    else:
        spans = zip(np.append(0, gaps[:len(gaps) - k + 1] + 1).tolist(), np.append(gaps[k - 1:], len(line)).tolist())
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(line[a:b], SEED) for a, b in spans], "<u8")
    votes = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _VOTES):
        part = hashes[i:i + _VOTES].view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE_WORDS,
                 row_col: str | None = None) -> DataFrame:
    """``doc_id, fp`` with the fingerprint as a signed long; with a ``row_col`` also ``row``, its number."""
    ids = {"doc_id": id_col} | ({"row": row_col} if row_col else {})

    def run(batches):
        for batch in batches:
            fp = np.array([fingerprint(t.as_py(), k) for t in batch.column("text")], np.uint64)
            yield pa.record_batch([*(batch.column(c) for c in ids), fp.view(np.int64)], names=[*ids, "fp"])

    d = docs.select(*[F.col(c).cast("long").alias(name) for name, c in ids.items()], F.col(text_col).alias("text"))
    return shipped(d).mapInArrow(run, "".join(f"{c} long, " for c in ids) + "fp long")


# ---------------------------------------------------------------- the index of a range of top nodes

def gray_rank(fp: np.ndarray) -> np.ndarray:
    """Position of each fingerprint in the Gray code's order."""
    for s in (1, 2, 4, 8, 16, 32):
        fp = fp ^ (fp >> np.uint64(s))
    return fp


def gray_order(fps: np.ndarray, field: int = 0) -> np.ndarray:
    """The order of fingerprints in the Gray code that has the bits of ``field`` first."""
    mask = np.uint64(field)
    first, rest = fps & mask, gray_rank(fps & ~mask)
    # Under every other value of the field the code runs through the other bits backwards.
    return np.lexsort((np.where(np.bitwise_count(first) & 1, ~rest, rest), gray_rank(first)))


class GrayIndex:
    """Nodes over Gray-sorted fingerprints; ``levels[0]`` are the leaves, the last level is the root.

    Finds the pairs that agree in the bits of ``field`` (and maybe others).
    """

    def __init__(self, fps: np.ndarray, field: int = 0):
        self.fps = fps[gray_order(fps, field)]
        self.field = np.uint64(field)
        self.seen = dict(visited=0, pruned=0, compared=0)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        starts, width = np.arange(0, len(fps), LEAF), LEAF
        while True:
            first = np.repeat(self.fps[starts], np.diff(np.append(starts, len(fps))))
            mask = ~np.bitwise_or.reduceat(self.fps ^ first, starts)
            self.levels.append((mask, self.fps[starts] & mask))
            if len(starts) == 1:
                break
            width *= FANOUT
            starts = np.arange(0, len(fps), width)

    def components(self, max_bits: int) -> np.ndarray:
        """For each sorted fingerprint the first one that it is linked to, directly or through others."""
        label = np.arange(len(self.fps))
        near = np.bitwise_count(self.fps[1:] ^ self.fps[:-1]) <= max_bits
        at = np.flatnonzero(near)
        label = _join(label, at, at + 1)
        top = len(self.levels) - 1
        stack = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while stack:
            level, a, b, differ = stack.pop()
            if len(a) > _NODE_PAIRS:
                for i in range(0, len(a), _NODE_PAIRS):
                    part = slice(i, i + _NODE_PAIRS)
                    stack.append((level, a[part], b[part], differ[part]))
            elif level:
                stack.append((level - 1, *self._below(level, a, b, differ, max_bits)))
            elif len(a):
                label = self._compare(a, b, label, max_bits)
        return label

    def _below(self, level, a, b, differ, max_bits):
        """The pairs of children that are still near enough; ``differ`` grows by the newly fixed bits."""
        mask, _ = self.levels[level]
        below, pattern = self.levels[level - 1]
        i, j = np.divmod(np.arange(FANOUT * FANOUT), FANOUT)
        x, y = (a[:, None] * FANOUT + i).ravel(), (b[:, None] * FANOUT + j).ravel()
        known, differ = np.repeat(mask[a] & mask[b], len(i)), np.repeat(differ, len(i))
        there = (x <= y) & (y < len(below))
        x, y, known, differ = x[there], y[there], known[there], differ[there]
        apart = (pattern[x] ^ pattern[y]) & below[x] & below[y] & ~known
        differ = differ + np.bitwise_count(apart)
        near = (differ <= max_bits) & (apart & self.field == 0)
        self.seen["visited"] += len(x)
        self.seen["pruned"] += len(x) - int(near.sum())
        return x[near], y[near], differ[near]

    def _compare(self, a, b, label, max_bits):
        """Compare the members of pairs of leaves, but for leaves that lie in one component already."""
        starts = np.arange(0, len(label), LEAF)
        low, high = np.minimum.reduceat(label, starts), np.maximum.reduceat(label, starts)
        open_ = ~((low[a] == high[a]) & (low[b] == high[b]) & (low[a] == low[b]))
        a, b = a[open_], b[open_]
        self.seen["compared"] += len(a)
        i, j = np.divmod(np.arange(LEAF * LEAF), LEAF)
        step = max(1, _PAIRS // len(i))
        for s in range(0, len(a), step):
            x, y = (a[s:s + step, None] * LEAF + i).ravel(), (b[s:s + step, None] * LEAF + j).ravel()
            there = (x < y) & (y < len(self.fps))
            x, y = x[there], y[there]
            near = np.bitwise_count(self.fps[x] ^ self.fps[y]) <= max_bits
            label = _join(label, x[near], y[near])
        return label


def _join(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Labels after linking x with y: the smallest index of each component, everywhere."""
    while len(x):
        lx, ly = label[x], label[y]
        apart = lx != ly
        if not apart.any():
            break
        x, y, lx, ly = x[apart], y[apart], lx[apart], ly[apart]
        np.minimum.at(label, np.maximum(lx, ly), np.minimum(lx, ly))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
    return label


def links(fps: np.ndarray, max_bits: int, field: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among distinct fingerprints that agree in ``field``."""
    index = GrayIndex(fps, field)
    label = index.components(max_bits)
    at = np.flatnonzero(label != np.arange(len(label)))
    return index.fps[at], index.fps[label[at]]


# ---------------------------------------------------------------- top nodes

def fields(mask: int, parts: int) -> list[int]:
    """``mask`` extended by each of ``parts`` even runs of the bits it leaves free."""
    free = [b for b in range(64) if not mask >> b & 1]
    runs = np.array_split(free, parts)
    return [mask | sum(1 << int(b) for b in run) for run in runs]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def top_nodes(fps: DataFrame, max_bits: int = MAX_BITS, max_group: int = MAX_GROUP) -> list[DataFrame]:
    """Tables ``mask, value, fp``: every fingerprint under the top nodes that it belongs to, none above ``max_group``."""
    done, masks = [], [0]
    rows = fps.select(F.lit(0).cast("long").alias("mask"), "fp")
    while True:
        children = {m: fields(m, max_bits + 1) for m in masks}
        table = F.create_map(*[x for m, c in children.items()
                               for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(v)) for v in c]))])
        rows = rows.select(F.explode(table[F.col("mask")]).alias("mask"), "fp")
        rows = rows.select("mask", F.col("mask").bitwiseAND(F.col("fp")).alias("value"), "fp")
        if done:  # two ways of dividing may meet in one node
            rows = rows.distinct()
        masks = sorted({v for c in children.values() for v in c})
        if max(64 - m.bit_count() for m in masks) <= max_group.bit_length() - 1:
            return [*done, rows]
        large = rows.groupBy("mask", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_group)
        large = save(large.select("mask", "value"), "simhash-large")
        if large.isEmpty():
            return [*done, rows]
        done.append(rows.join(large, ["mask", "value"], "left_anti"))
        rows = rows.join(large, ["mask", "value"], "left_semi").select("mask", "fp")


def gray_rank_of(x: Column) -> Column:
    """``gray_rank`` of a column of signed longs."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x.bitwiseXOR(F.shiftrightunsigned(x, s))
    return x


def forest(rows: DataFrame, max_bits: int = MAX_BITS, max_index: int = MAX_INDEX) -> DataFrame:
    """Links ``u, v`` within the top nodes of ``mask, value, fp``."""
    def run(batches):
        held: list[np.ndarray] = []
        size = 0

        def settle(mask, fp):
            """Links of whole top nodes, given in order of the mask."""
            ends = np.append(np.flatnonzero(mask[1:] != mask[:-1]) + 1, len(mask))
            found = [links(part.view(np.uint64), max_bits, int(mask[e - 1]) & (1 << 64) - 1)
                     for part, e in zip(np.split(fp, ends[:-1]), ends)]
            u, v = (np.concatenate(x).view(np.int64) for x in zip(*found))
            return pa.record_batch([u, v], names=["u", "v"])

        for batch in batches:
            held.append(np.stack([batch.column(c).to_numpy() for c in ("mask", "value", "fp")]))
            size += batch.num_rows
            if size < max_index:
                continue
            all_ = np.concatenate(held, axis=1)
            whole = np.flatnonzero((all_[:2] != all_[:2, -1:]).any(axis=0))
            if len(whole):  # all but the last node are complete
                cut = whole[-1] + 1
                yield settle(all_[0, :cut], np.ascontiguousarray(all_[2, :cut]))
                all_ = all_[:, cut:].copy()
            held, size = [all_], all_.shape[1]
        if size:
            all_ = np.concatenate(held, axis=1)
            yield settle(all_[0], np.ascontiguousarray(all_[2]))

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["mask", gray_rank_of(F.col("value"))]
    rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return shipped(rows).mapInArrow(run, "u long, v long")


# ---------------------------------------------------------------- components

def components(links_: DataFrame) -> DataFrame:
    """``node, root`` for every linked node: root is the smallest node that it reaches (large-star, small-star)."""
    def tidy(df):
        return df.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    def mark(df):
        return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    def least(df):
        return df.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))

    edges = save(tidy(links_), "components")
    seen = mark(edges)
    while seen[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Large star: larger neighbours move to the smallest node around.
        edges = join_by_key(both.where("v > u"), save(least(both), "components-least"), "u", 2 * seen[0])
        edges = edges.select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        edges = save(tidy(edges), "components")
        # Small star: smaller neighbours, and the node itself, move to the smallest of them.
        low = save(least(edges), "components-least")
        moved = join_by_key(edges, low, "u", seen[0])
        edges = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        edges = save(tidy(edges), "components")
        now = mark(edges)
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots.select("node", F.col("node").alias("root")))


def _members(each: DataFrame, first: Column, max_bits: int, max_group: int) -> tuple[DataFrame, DataFrame]:
    """The distinct fingerprints ``fp, first, n`` (rows) of ``each``, and those that are linked: ``fp, root, first``."""
    nodes = save(each.groupBy("fp").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("n")), "fingerprint-nodes")
    found = None
    for rows in top_nodes(nodes.select("fp"), max_bits, max_group):
        part = forest(rows, max_bits)
        found = part if found is None else found.union(part)
    return nodes, save(components(found).withColumnRenamed("node", "fp").join(nodes, "fp"), "fingerprint-members")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE_WORDS,
                    max_bits: int = MAX_BITS, max_group: int = MAX_GROUP) -> DataFrame:
    """Per row: ``doc_id, fingerprint, component_id``."""
    each = save(fingerprints(docs, id_col, text_col, k), "fingerprints")
    nodes, member = _members(each, F.col("doc_id"), max_bits, max_group)
    ids = member.groupBy("root").agg(F.min("first").alias("component_id"))
    linked = member.join(ids, "root").select("fp", "component_id")
    of = nodes.join(linked, "fp", "left").select("fp", "n", F.coalesce("component_id", "first").alias("component_id"))
    out = join_by_key(each, save(of, "fingerprint-components"), "fp", each.count())
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", null_ids: bool = False) -> DataFrame:
    """``docs`` with one row of each component, the smallest id; of rows that repeat that id, any one.

    The verdict is on rows, not on ids: a row in another component has its own,
    whatever its id.  Rows without an id stay, all of them; with ``null_ids``
    they take part like others and lose to any id.
    """
    docs_, row = numbered(docs, "near-rows")
    each = save(fingerprints(docs_, id_col, text_col, row_col=row), "fingerprints")
    first = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")
    nodes, member = _members(each, first, MAX_BITS, MAX_GROUP)
    roots = nodes.join(member.select("fp", "root"), "fp", "left")
    roots = roots.select("fp", "n", F.coalesce("root", "fp").alias("root"), "first")
    best = roots.groupBy("root").agg(F.min("first").alias("first"))
    of = save(roots.select("fp", "n", "root").join(best, "root").select("fp", "n", F.col("first.row").alias("best")), "fingerprint-best")
    dropped = join_by_key(each, of, "fp", each.count()).where("row <> best")
    if not null_ids:
        dropped = dropped.where("doc_id IS NOT NULL")
    return without_rows(docs_, row, dropped.select("row")).select(*[F.col(f"`{c}`") for c in docs.columns])
