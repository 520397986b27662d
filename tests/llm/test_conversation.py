import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest

from tidemark.llm import conversation as c, queries

SF = "/root/testdata/sf0.01"
PATTERN = re.compile("(s?(ua)+)?")
BLANK, CLOSED = re.compile("[^\x20\x09-\x0D]"), re.compile("[.!?][\x20\x09-\x0D]*\\Z")


def damage(rows):
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        h, role, text = zlib.crc32(key.encode()) % 20, " " if role is None else role, " " if text is None else text
        if h == 0:
            continue
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        yield from [(conv, turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        out.append("blank" if not BLANK.search(text) else "duplicate" if (role, text) in seen
                   else None if CLOSED.search(text) else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows, found):
    """Cheapest first search over (row, place in the pattern); of equal costs the least audit."""
    heap, done = [(0, "", 0, 0, ())], set()
    while heap:
        cost, audit, row, place, out = heapq.heappop(heap)
        if (row, place) in done:
            continue
        done.add((row, place))
        if row == len(rows) and place in (0, 3):
            return cost, audit, out
        new, after = ("assistant", 3) if place == 2 else ("user", 2)
        heapq.heappush(heap, (cost + 2, audit + "I", row, after, (*out, f"{new}:")))
        if row < len(rows):
            _, _, role, text = rows[row]
            more = found[row] == "truncated"
            heapq.heappush(heap, (cost + 3, audit + "D", row + 1, place, out))
            if found[row] not in ("blank", "duplicate"):
                heapq.heappush(heap, (cost + 2 + more, audit + "R", row + 1, after, (*out, f"{new}:{text}")))
                to = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}.get(role[:1], {}).get(place)
                if to:
                    heapq.heappush(heap, (cost + more, audit + "K", row + 1, to, (*out, f"{role}:{text}")))


def slow(rows, hurt=True):
    out = {}
    order = lambda r: (r[1] is not None, r[1] or 0, r[2], r[3])
    for conv in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == conv]
        spaced = [(a, b, " " if r is None else r, " " if t is None else t) for a, b, r, t in mine]
        mine = sorted(damage(mine) if hurt else spaced, key=order)
        found, turns = faults(mine), {r[1] for r in mine} - {None}
        cost, audit, text = cheapest(mine, found)
        first = [r[2][:1] for r in mine]
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *[found.count(x) for x in ("blank", "duplicate", "truncated")],
                     sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(first)), cost, audit,
                     hashlib.sha256("\n".join(text).encode()).hexdigest())
    return out


COLS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def got(df):
    rows = df.select(COLS).collect()
    out = {r[0]: tuple(r)[1:] for r in rows}
    assert len(out) == len(rows)
    return out


def test_whole_table_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(queries.op12_conversation_repair(spark, SF)) == slow(rows)


def test_every_short_sequence_of_rows():
    """Cost and audit by the chart against all edit sequences with up to three insertions a gap."""
    for n in range(4):
        for symbols in itertools.product("suaxSUAXd", repeat=n):
            said = "".join(symbols)
            rows = [(1, i, {"s": "system", "u": "user", "a": "assistant"}.get(s.lower(), "tool"), f"{i}." if s.islower() else f"{i}") for i, s in enumerate(said)]
            found = ["blank" if s == "d" else "truncated" if s.isupper() else None for s in said]
            cost, audit, lines = cheapest(rows, found)
            assert c.best(c.span_cell(said)) == (cost, audit)
            assert PATTERN.fullmatch("".join(x[0] for x in lines))


@pytest.mark.parametrize("group", [2, 3, 8, 40])
def test_any_grouping_gives_the_same(group, monkeypatch):
    rng = random.Random(group)
    monkeypatch.setattr(c, "GROUP", group)
    c._short.cache_clear()
    for _ in range(60):
        said = "".join(rng.choices("suaxSUAXd", k=rng.randrange(1, 40)))
        rows = [(1, i, {"s": "s", "u": "u", "a": "a"}.get(s.lower(), "x"), str(i)) for i, s in enumerate(said)]
        found = ["blank" if s == "d" else "truncated" if s.isupper() else None for s in said]
        assert c.best(c.span_cell(said)) == cheapest(rows, found)[:2]
        cut = sorted(rng.choices(range(len(said) + 1), k=3))
        parts = [said[a:b] for a, b in zip([0, *cut], [*cut, len(said)]) if a < b]
        assert c.combine([c.span_cell(p) for p in parts])[3] == c.span_cell(said)[3]
    c._short.cache_clear()


def conversations():
    rng = random.Random(11)
    texts = ["Yes.", "No", "", " \t\n", "Why? ", "Fine!\n", None, "x" * 50_000 + ".", "A. B"]
    rows = [(conv, turn, rng.choice(["system", "user", "assistant", "tool", "", None, "User"]), rng.choice(texts))
            for conv in [*range(30), None] for turn in rng.sample([None, *range(-3, 12)], rng.randrange(1, 9))]
    rows += [(500, i, "user" if i % 2 else "assistant", f"{i % 150}.") for i in range(700)]  # most of all rows
    rows += [(600, 2, "user", "Same.")] * 30 + [(601, None, "user", "Same.")] * 3
    return rows


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_cases_and_divided_conversations(spark, parts):
    rows = conversations()
    df = spark.createDataFrame([(*r, "?", 1) for r in rows], "conv_id long, turn long, role string, text string, edit string, place int")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert got(c.digests(c.repair(df))) == slow(rows, hurt=False)
        hurt = c.repair(c.damaged(df), gone=c.F.col("gone"))
        assert got(c.digests(hurt)) == slow(rows)
        if parts > 1:
            assert hurt.where("NOT whole").select("conv_id").distinct().count() > 1
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_repaired_rows_follow_the_pattern(spark):
    edits = c.repair(spark.read.parquet(f"{SF}/conversations.parquet")).orderBy("conv_id", "place", "sub").collect()
    for _, rows in itertools.groupby(edits, key=lambda r: r.conv_id):
        assert PATTERN.fullmatch("".join(r.new_role[0] for r in rows if r.new_role))


def test_empty_table_and_conversations_that_lose_all_rows(spark):
    df = spark.createDataFrame([(1, 1, "user", "Hi.")] * 2, "conv_id long, turn long, role string, text string")
    assert c.digests(c.repair(df.limit(0))).count() == 0
    r = got(c.digests(c.repair(df, gone=c.F.lit(True))))
    assert r == {1: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
