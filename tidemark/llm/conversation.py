"""Repair of conversation structure by weighted CYK parsing of intervals.

A conversation should read ``(s?(ua)+)?`` in the initials of its roles.  Edits on
its rows: Keep costs 0, Rerole to user or assistant 2, Delete 3 (the only one for
blank and duplicate rows), Insert an empty user or assistant row 2; a truncated
row that stays costs 1 more.  The cheapest repair is sought, of equal ones the
one whose edits' initials (the audit) come first in ASCII order.

The grammar has a nonterminal for each pair of places in the pattern between
which a span of rows can lead, and rules ``pq -> pr rq`` (Chomsky normal form).
A span's cell holds the least (cost, audit) of every nonterminal; a row's cell is
closed under insertions on both sides; cells of longer spans are combined from all
their splits, bottom-up by length.  In one cell no audit is the beginning of
another of equal cost (it would be short of an insertion), so the least audits of
two spans give the least of both.  Rows are parsed in groups of ``GROUP``, and the
groups' cells by the same rules, so that work grows with the rows.

Rows are range-partitioned and sorted by conversation and turn, so a conversation
of any size is divided.  Conversations that lie inside a partition are parsed
there; those at a partition's ends are parsed in segments, whose cells, and no
texts, meet in one task.

The result is the table of edits: ``conv_id, place, sub, edit, fault, turn, role,
text, new_role``, in the order of (place, sub); deleted rows have no new role,
inserted ones no turn and role.

Cases: a NULL role or text is one space; a NULL turn comes first; NULL ids are one
conversation; rows of equal turn are taken by role and text; a role that is empty
or begins with another letter cannot be kept; texts of any length are read whole,
one partition's rows at most at a time; no rows give no edits; other columns are
not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.llm.common import SPACES, save, shipped

#: Spans parsed together; longer conversations are parsed group by group.
GROUP = 8
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
_BATCH = 2048

# Places in the pattern: nothing yet, after a system row, after a user row, after an assistant row.
_STEPS = {"s": ((0, 1),), "u": ((0, 2), (1, 2), (3, 2)), "a": ((2, 3),)}
_AFTER = {"s": 1, "u": 2, "a": 3}
_PAIRS = [(p, q) for p in range(4) for q in range(4) if p <= q or (p, q) == (3, 2)]
#: For each nonterminal, the pairs of nonterminals that make it up.
RULES = [[(_PAIRS.index((p, r)), _PAIRS.index((r, q))) for r in range(4) if (p, r) in _PAIRS and (r, q) in _PAIRS]
         for p, q in _PAIRS]
_ENDS = _PAIRS.index((0, 0)), _PAIRS.index((0, 3))

Cell = list[tuple[int, str] | None]


def _cell(found: list[tuple[tuple[int, int], int, str]]) -> Cell:
    out: Cell = [None] * len(_PAIRS)
    for pair, cost, audit in found:
        at = _PAIRS.index(pair)
        out[at] = min(out[at] or (cost, audit), (cost, audit))
    return out


def _parse(cells: list[Cell]) -> Cell:
    """The cell of a whole sequence from all splits of all its spans, shorter spans first."""
    chart = [cells]
    for length in range(2, len(cells) + 1):
        spans = []
        for start in range(len(cells) - length + 1):
            splits = [(chart[k - 1][start], chart[length - k - 1][start + k]) for k in range(1, length)]
            cell: Cell = []
            for rules in RULES:
                best = None
                for left, right in splits:
                    for a, b in rules:
                        x, y = left[a], right[b]
                        if x and y and (not best or x[0] + y[0] <= best[0]):
                            new = x[0] + y[0], x[1] + y[1]
                            best = min(best, new) if best else new
                cell.append(best)
            spans.append(cell)
        chart.append(spans)
    return chart[-1][0]


_INSERTED = _cell([((p, p), 0, "") for p in range(4)] + [((p, 2), INSERT, "I") for p in (0, 1, 3)] + [((2, 3), INSERT, "I")]
                  + [((p, 3), 2 * INSERT, "II") for p in (0, 1)])


@lru_cache(None)
def row_cell(symbol: str) -> Cell:
    """Cell of one row: ``s u a`` by its role, ``x`` another role, upper case if truncated, ``d`` to be deleted."""
    own, more = symbol.lower(), TRUNCATED * symbol.isupper()
    found = [((p, p), DELETE, "D") for p in range(4)]
    if own != "d":
        found += [(step, REROLE + more, "R") for to in "ua" for step in _STEPS[to]]
        found += [(step, more, "K") for step in _STEPS.get(own, ())]
    return _parse([_INSERTED, _cell(found), _INSERTED])


def combine(cells: list[Cell]) -> Cell:
    """The cell of neighbouring spans, parsed group by group."""
    while len(cells) > 1:
        cells = [_parse(cells[i:i + GROUP]) for i in range(0, len(cells), GROUP)]
    return cells[0] if cells else _INSERTED


@lru_cache(1 << 14)
def _short(symbols: str) -> Cell:
    return combine([row_cell(s) for s in symbols])


def span_cell(symbols: str) -> Cell:
    if len(symbols) <= GROUP:
        return _short(symbols)
    return combine([_short(symbols[i:i + GROUP]) for i in range(0, len(symbols), GROUP)])


def best(cell: Cell) -> tuple[int, str]:
    """Cost and audit of the cheapest repair."""
    return min(cell[i] for i in _ENDS if cell[i])


def walk(audit: str, symbols: str, place: int = 0) -> Iterator[tuple[str, int | None, str | None, int]]:
    """For each edit from ``place`` in the pattern on: its initial, its row, the role it gives if not the row's own, the place after it."""
    row = 0
    for edit in audit:
        new = None
        if edit in "IR":
            new, place = ("assistant", 3) if place == 2 else ("user", 2)
        elif edit == "K":
            place = _AFTER[symbols[row].lower()]
        yield edit, None if edit == "I" else row, new, place
        row += edit != "I"


def symbol(role: str, fault: str | None) -> str:
    if fault in ("blank", "duplicate"):
        return "d"
    own = role[:1] if role[:1] in _AFTER else "x"
    return own.upper() if fault == "truncated" else own


_IN = ["conv_id", "place", "turn", "role", "text", "fault", "gone"]
_EDITS = ["conv_id", "place", "sub", "edit", "fault", "turn", "role", "text", "new_role"]


def _schema(rows: DataFrame) -> str:
    kinds = dict(rows.dtypes)
    return (f"conv_id {kinds['conv_id']}, place long, sub int, edit string, fault string, turn {kinds['turn']}, role string, "
            "text string, new_role string")


def _script(audit: str, symbols: str, places: list[int], place: int = 0) -> Iterator[tuple[int, int, str, int | None, str | None]]:
    """``place, sub, edit, row, role given`` of an audit; insertions stand behind the row before them, or before the first."""
    lead = len(audit) - len(audit.lstrip("I"))
    at, sub = places[0], -lead - 1
    for edit, row, new, _ in walk(audit, symbols, place):
        at, sub = (places[row], 0) if row is not None else (at, sub + 1)
        yield at, sub, edit, row, new


def _repaired(rows: list[tuple]) -> Iterator[tuple]:
    """Edits of one whole conversation, given as ``_IN`` rows in order."""
    live, seen, symbols = [], set(), []
    for conv, place, turn, role, text, fault, gone in rows:
        if gone:
            yield conv, place, 0, "", None, turn, None, None, None
            continue
        if fault != "blank" and (role, text) in seen:
            fault = "duplicate"
        seen.add((role, text))
        live.append((conv, place, turn, role, text, fault))
        symbols.append(symbol(role, fault))
    if live:
        said = "".join(symbols)
        for place, sub, edit, row, new in _script(best(span_cell(said))[1], said, [x[1] for x in live]):
            if row is None:
                yield live[0][0], place, sub, edit, None, None, None, "", new
            else:
                conv, _, turn, role, text, fault = live[row]
                yield conv, place, sub, edit, fault, turn, role, text, new or (role if edit == "K" else None)


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    part: list[tuple] = []
    for r in rows:
        part.append(r)
        if len(part) == _BATCH:
            yield pa.record_batch(list(map(pa.array, zip(*part), schema.types)), schema=schema)
            part = []
    if part:
        yield pa.record_batch(list(map(pa.array, zip(*part), schema.types)), schema=schema)


def _rows(batches) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns])


def _arrow(schema: str, spark: SparkSession) -> pa.Schema:
    return to_arrow_schema(spark.createDataFrame([], schema).schema)


def ordered(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
            text_col: str = "text", gone: Column | None = None) -> DataFrame:
    """The rows in the order of their conversations, with faults that a row shows by itself, and their places.

    Rows where ``gone`` is true are no part of their conversation, which is reported all the same.
    """
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in (role_col, text_col))
    fault = (F.when(~F.col("text").rlike("[^" + SPACES[1:]), "blank")
             .when(~F.col("text").rlike(r"[.!?]" + SPACES + r"*\z"), "truncated"))
    d = rows.select(F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"),
                    (F.lit(False) if gone is None else gone).alias("gone"))
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role")]
    d = d.repartitionByRange(*order, F.substring("text", 1, 32)).sortWithinPartitions(*order, "text", "gone")
    return d.withColumn("place", F.monotonically_increasing_id()).withColumn("fault", fault).select(_IN)


def repair(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text", gone: Column | None = None) -> DataFrame:
    """The edits of every conversation; ``whole`` tells those whose edits lie in one partition, in order."""
    lines = shipped(ordered(rows, id_col, turn_col, role_col, text_col, gone))
    spark, schema = lines.sparkSession, _schema(lines)
    kinds = _arrow(schema, spark)

    def run(batches):
        def edits():
            """A partition's first and last conversation may go on elsewhere: their rows pass without an edit."""
            first, now, held = True, None, []
            opened = lambda r: (r[0], r[1], 0, None, "gone" if r[6] else r[5], r[2], r[3], r[4], None)
            for r in _rows(batches):
                if now != (r[0],):
                    if now and not first:
                        yield from _repaired(held)
                    first, now, held = not now, (r[0],), []
                if first:
                    yield opened(r)
                else:
                    held.append(r)
            yield from map(opened, held)
        return _batches(edits(), kinds)

    done = save(lines.mapInArrow(run, schema), "conversations")
    whole = done.where(F.col("edit").isNotNull()).withColumn("whole", F.lit(True))
    return whole.unionByName(_open(done.where(F.col("edit").isNull())).withColumn("whole", F.lit(False)))


def _open(rows: DataFrame) -> DataFrame:
    """Edits of conversations that may lie in several partitions, by segments."""
    spark, schema, id_type = rows.sparkSession, _schema(rows), dict(rows.dtypes)["conv_id"]
    live = rows.where(~F.col("fault").eqNullSafe("gone")).withColumn("sha", F.sha2("text", 256))
    first = live.groupBy("conv_id", "role", "sha").agg(F.min("place").alias("first"))
    fault = F.when((F.col("place") > F.col("first")) & ~F.col("fault").eqNullSafe("blank"), "duplicate").otherwise(F.col("fault"))
    first = first.withColumnsRenamed({"conv_id": "conv", "role": "said", "sha": "digest"})
    marked = live.join(first, F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("role") == F.col("said"))
                       & (F.col("sha") == F.col("digest"))).withColumn("fault", fault)
    own = F.when(F.left("role", F.lit(1)).isin("s", "u", "a"), F.left("role", F.lit(1))).otherwise("x")
    mark = (F.when(F.col("fault").isin("blank", "duplicate"), "d").when(F.col("fault") == "truncated", F.upper(own)).otherwise(own))
    segment = F.shiftright("place", 33).alias("segment")
    parts = (marked.groupBy("conv_id", segment)
             .agg(F.sort_array(F.collect_list(F.struct("place", mark.alias("mark")))).alias("rows"))
             .select("conv_id", "segment", F.col("rows.place").alias("places"), F.array_join("rows.mark", "").alias("symbols")))
    cell_schema = f"conv_id {id_type}, segment long, symbols string, cost array<long>, audit array<string>"
    cell_kinds = _arrow(cell_schema, spark)

    def cells(batches):
        def out():
            for conv, segment, symbols in _rows(batches):
                cell = span_cell(symbols)
                yield conv, segment, symbols, [c and c[0] for c in cell], [c and c[1] for c in cell]
        return _batches(out(), cell_kinds)

    parts = save(parts, "segments")
    found = shipped(parts.select("conv_id", "segment", "symbols")).mapInArrow(cells, cell_schema)
    found = found.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("segment", "symbols", "cost", "audit"))).alias("parts"))
    part_schema = f"conv_id {id_type}, segment long, audit string, start int"
    part_kinds = _arrow(part_schema, spark)

    def joined(batches):
        def out():
            for batch in batches:
                for conv, all_parts in zip(batch.column(0).to_pylist(), batch.column(1)):
                    segs = all_parts.as_py()
                    _, audit = best(combine([[None if c is None else (c, a) for c, a in zip(s["cost"], s["audit"])] for s in segs]))
                    steps, at, place = list(walk(audit, "".join(s["symbols"] for s in segs))), 0, 0
                    for i, s in enumerate(segs):
                        start, left, begun = place, len(s["symbols"]), at
                        while at < len(steps) and (left or steps[at][0] == "I"):
                            left -= steps[at][0] != "I"
                            place, at = steps[at][3], at + 1
                        yield conv, s["segment"], audit[begun:at], start
        return _batches(out(), part_kinds)

    audits = found.mapInArrow(joined, part_schema)
    edit_schema = f"conv_id {id_type}, place long, sub int, edit string, given string"
    edit_kinds = _arrow(edit_schema, spark)

    def edited(batches):
        def out():
            for conv, places, symbols, audit, start in _rows(batches):
                for place, sub, edit, _, new in _script(audit, symbols, places, start):
                    yield conv, place, sub, edit, new
        return _batches(out(), edit_kinds)

    both = (parts.alias("p").join(audits.alias("a"), F.col("p.conv_id").eqNullSafe(F.col("a.conv_id"))
                                  & (F.col("p.segment") == F.col("a.segment")))
            .select("p.conv_id", "places", "symbols", "audit", "start"))
    script = both.mapInArrow(edited, edit_schema)
    texts = marked.select(F.col("place").alias("of"), F.col("fault"), "turn", "role", "text")
    script = script.join(texts, (F.col("place") == F.col("of")) & (F.col("sub") == 0), "left")
    script = script.withColumn("new_role", F.coalesce("given", F.when(F.col("edit") == "K", F.col("role"))))
    script = script.withColumn("text", F.coalesce("text", F.lit(""))).select(_EDITS)
    gone = rows.where(F.col("fault").eqNullSafe("gone")).select(
        "conv_id", "place", "sub", F.lit("").alias("edit"), F.lit(None).cast("string").alias("fault"), "turn",
        *[F.lit(None).cast("string").alias(c) for c in ("role", "text", "new_role")])
    return script.unionByName(gone).select(*[F.col(c) for c in _EDITS])


_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def digests(edits: DataFrame) -> DataFrame:
    """Per conversation what was wrong, what the repair cost, its audit and the digest of the repaired conversation.

    Edits of whole conversations are read where they lie, in order; the others
    are brought together and sorted.  Texts pass through the digest one by one.
    """
    schema = f"conv_id {dict(edits.dtypes)['conv_id']}, " + ", ".join(f"{c} long" for c in _COUNTS) + ", audit string, repaired_sha256 string"
    kinds = _arrow(schema, edits.sparkSession)

    def run(batches):
        def out():
            now, c = None, None
            for conv, edit, fault, turn, role, text, new in _rows(batches):
                if now != (conv,):
                    if now:
                        yield c.row(now[0])
                    now, c = (conv,), _Summary()
                if edit:
                    c.add(edit, fault, turn, role, text, new)
            if now:
                yield c.row(now[0])
        return _batches(out(), kinds)

    cols = ["conv_id", "edit", "fault", "turn", "role", "text", "new_role"]
    apart = edits.where(~F.col("whole")).repartition("conv_id").sortWithinPartitions("conv_id", "place", "sub")
    return (shipped(edits).where("whole").select(cols).mapInArrow(run, schema)
            .unionByName(apart.select(cols).mapInArrow(run, schema)))


class _Summary:
    """Counts over the edits of one conversation, taken in order."""

    def __init__(self):
        self.count, self.audit, self.sha = dict.fromkeys(_COUNTS, 0), [], hashlib.sha256()
        self.low = self.last = self.before = None
        self.turns, self.lines = 0, 0

    def add(self, edit, fault, turn, role, text, new) -> None:
        self.audit.append(edit)
        self.count["cost"] += {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}[edit] + TRUNCATED * (fault == "truncated" and edit != "D")
        if new is not None:
            self.sha.update(("\n" * (self.lines > 0) + f"{new}:{text}").encode())
            self.lines += 1
        if edit == "I":
            return
        if fault:
            self.count[fault] += 1
        if turn is not None and turn != self.last:
            self.low, self.last, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        if self.before is not None:
            self.count["illegal"] += self.before[:1] + role[:1] not in ("su", "ua", "au")
        self.before = role

    def row(self, conv) -> tuple:
        if self.turns:
            self.count["gaps"] = self.last - self.low + 1 - self.turns
        return conv, *self.count.values(), "".join(self.audit), self.sha.hexdigest()


def damaged(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
            text_col: str = "text") -> DataFrame:
    """Rows with repeatable faults by the hash of (conversation, turn); dropped rows stay, with ``gone`` set."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (id_col, turn_col)])
    h = F.crc32(key.cast("binary")) % 20
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in (role_col, text_col))
    text = F.when(h == 1, "").when(h == 2, F.translate(text, ".!?", "")).otherwise(text)
    return rows.select(F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"),
                       F.when(h == 4, "user").otherwise(role).alias("role"), text.alias("text"), (h == 0).alias("gone"),
                       F.explode(F.when(h == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
