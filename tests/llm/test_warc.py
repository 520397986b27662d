import base64
import gzip
import hashlib
import random

import pytest

from tidemark.llm import queries, warc
from tidemark.llm.common import scratch
from tidemark.testing.compare import compare, duckdb_connection

SF = "/root/testdata/sf0.001"
rnd = random.Random(2)


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def brute(rows):
    out = []
    for i, _, h in rows:
        body = (h or "").encode()
        first = min((j for j, _, g in rows if (g or "") == (h or "") and j is not None), default=None)
        revisit = first is not None and i != first
        out.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(),
                    "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


ROWS = [(1, "http://a/", "<p>x</p>"), (2, "http://a/2", "<p>x</p>"), (3, None, None), (4, "http://é/\r\nX: y", ""),
        (5, "u", "WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 3), (6, "u", "ü" * 50_000), (None, "n", "<p>x</p>"),
        (None, "n", "no id"), (None, "n", "no id"), (7, "u", "<p>x</p> "), (8, "r", "again"), (8, "r", "again"), (-9, "m", "again")]


def test_round_trip(spark):
    df = pages(spark, ROWS).selectExpr("*", "1 AS key", "2 AS first").repartition(3)
    segments = warc.write_archives(df, scratch(spark, "warc-test"))
    got = sorted((tuple(r) for r in warc.read_pages(segments).collect()), key=str)
    assert got == brute(ROWS)
    full = warc.read_archives(segments).where("gap IS NULL AND record_type = 'response'").collect()
    texts = {(h or "").encode() for _, _, h in ROWS}
    assert {bytes(r.payload) for r in full} == texts and all(len(r.payload) == r.payload_bytes for r in full)


def test_min_revisit_bytes(spark):
    segments = warc.write_archives(pages(spark, ROWS), scratch(spark, "warc-test"), min_revisit_bytes=8)
    kinds = {(r.page_id, r.payload_bytes): r.record_type for r in warc.read_pages(segments).collect()}
    assert kinds[2, 8] == "revisit" and kinds[8, 5] == "response" and kinds[4, 0] == "response"


def test_files_are_gzip_members_and_segments_cover_them(spark, monkeypatch):
    monkeypatch.setattr(warc, "SEGMENT_BYTES", 1)
    segments = warc.write_archives(pages(spark, ROWS[:3]).coalesce(1), scratch(spark, "warc-test")).collect()
    path = warc.filesystem(segments[0].path)[1]
    data = open(path, "rb").read()
    ends = sorted((s.start, s.end) for s in segments)
    assert ends[0][0] == 0 and ends[-1][1] == len(data) and all(a[1] == b[0] for a, b in zip(ends, ends[1:]))
    assert gzip.decompress(data).count(b"WARC/1.1\r\n") == 4


BODIES = [bytes(rnd.randrange(256) for _ in range(n)).hex() for n in (10, 3000, 500, 70_000, 20)]


def archive(packed=True):
    parts = [warc.page_record(i, f"http://x/{i}", b.encode(), None) for i, b in enumerate(BODIES)]
    return [warc.member(p) if packed else p for p in parts]


def read(spark, tmp_path, data):
    path = tmp_path / "a.warc.gz"
    path.write_bytes(data)
    rows = warc.read_archives(warc.whole_files(spark, [str(path)])).collect()
    found = {int(r.record_id.rpartition(":")[2]) for r in rows if not r.gap}
    for r in rows:
        if not r.gap:
            assert bytes(r.payload).decode() == BODIES[int(r.record_id.rpartition(":")[2])]
    spans = sorted((r.offset, r.offset + r.length) for r in rows if r.length is not None)
    assert spans[0][0] == 0 and spans[-1][1] == len(data) and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    return found, [(r.offset, r.length) for r in rows if r.gap]


@pytest.mark.parametrize("packed", [True, False])
@pytest.mark.parametrize("damage", ["none", "flip", "cut_end", "cut_middle", "garbage", "front", "lost_length", "magic"])
def test_salvage(spark, tmp_path, packed, damage):
    parts = archive(packed)
    size = [len(p) for p in parts]
    want, gaps = {0, 1, 2, 3, 4}, []
    if damage == "flip":
        k = len(parts[1]) // 2
        parts[1] = parts[1][:k] + bytes([parts[1][k] ^ 1]) + parts[1][k + 1:]
        want, gaps = {0, 2, 3, 4}, [(size[0], size[1])]
    elif damage == "cut_end":
        parts[4] = parts[4][:-7]
        # A member without its checksum still holds a whole record; a plain record without its end is none.
        want, gaps = {0, 1, 2, 3, 4} if packed else {0, 1, 2, 3}, [(sum(size[:4]), size[4] - 7)]
    elif damage == "cut_middle":
        parts[3] = parts[3][:-900]
        want, gaps = {0, 1, 2, 4}, [(sum(size[:3]), size[3] - 900)]
    elif damage == "garbage":
        junk = bytes(rnd.randrange(256) for _ in range(5000))
        parts.insert(2, junk)
        gaps = [(sum(size[:2]), 5000)]
    elif damage == "front":
        parts.insert(0, b"\x00\x1f\x8b")
        gaps = [(0, 3)]
    elif damage == "lost_length":
        parts[2] = (warc.member if packed else bytes)(
            warc.page_record(2, "u", BODIES[2].encode(), None).replace(b"Content-Length: " + str(
                len(BODIES[2]) + 78).encode(), b"Content-Length: x").replace(b"WARC-Type", b"WARC Type"))
        want, gaps = {0, 1, 3, 4}, [(sum(size[:2]), len(parts[2]))]
    elif damage == "magic":
        parts.insert(3, b"\x1f\x8b\x08\x00WARC/1.1\r\nbad line\r\n\r\n" * 50)
        gaps = [(sum(size[:3]), len(parts[3]))]
    assert read(spark, tmp_path, b"".join(parts)) == (want, gaps)


def one_member(bodies, break_at=None):
    parts = [warc.page_record(i, f"http://x/{i}", b.encode(), None) for i, b in enumerate(bodies)]
    if break_at is not None:
        parts[break_at] = parts[break_at].replace(bodies[break_at][:9].encode(), b"#damaged#", 1)
    return warc.member(b"".join(parts))


MANY = [f"<p>{i} {rnd.random()} " + rnd.randbytes(rnd.randrange(500, 1500)).hex() for i in range(20)]


def numbers(found):
    return [int(r.headers["warc-record-id"].strip("<>").rpartition(":")[2]) for _, _, _, r in found if r]


def salvaged(data, tmp_path):
    path = tmp_path / "m.warc.gz"
    path.write_bytes(data)
    with warc.pafs.LocalFileSystem().open_input_file(str(path)) as f:
        return list(warc.salvage(warc._Bytes(f, 0, len(data))))


def test_records_before_a_cut_and_beside_a_bad_record_are_recovered(tmp_path):
    whole = one_member(MANY)
    assert numbers(salvaged(whole, tmp_path)) == list(range(20))
    found = salvaged(whole[:-9], tmp_path)
    assert numbers(found) == list(range(20)) and [(a, n, g) for a, n, g, _ in found if g] == [(0, len(whole) - 9, "member cut off")]
    bad = one_member(MANY, break_at=7)
    found = salvaged(bad + one_member(MANY[:2]), tmp_path)
    assert numbers(found) == [i for i in range(20) if i != 7] + [0, 1]
    assert [(a, n, g) for a, n, g, _ in found if g] == [(0, len(bad), "block digest")]


@pytest.mark.parametrize("share", [0.1, 0.5, 0.9])
def test_records_before_damaged_data_of_a_member_are_recovered(tmp_path, share):
    """Noise inside a member: what was written before it comes back whole, and the reader goes on behind the member."""
    whole, after = one_member(MANY), one_member(MANY[:3])
    k = int(len(whole) * share)
    found = salvaged(whole[:k] + bytes(rnd.randrange(256) for _ in range(300)) + whole[k + 300:] + after, tmp_path)
    got = numbers(found)
    first = len(got) - 3
    assert got[first:] == [0, 1, 2] and got[:first] == sorted(set(got[:first])) and len(got[:first]) >= int(20 * share) - 4
    assert [(a, n) for a, n, g, _ in found if g] == [(0, len(whole))]


def test_a_member_is_unpacked_as_a_stream(tmp_path):
    """Of a long member no more than a few records are held."""
    data, most = one_member(MANY * 40), 0
    path = tmp_path / "m.warc.gz"
    path.write_bytes(data)
    with warc.pafs.LocalFileSystem().open_input_file(str(path)) as f:
        m = warc._Member(warc._Bytes(f, 0, len(data)), 0)
        for _ in m.records():
            most = max(most, len(m.held))
    assert m.reason is None and m.end == len(data) and most < 100_000 < sum(map(len, MANY)) * 40


def test_damage_is_an_error_for_pages(spark, tmp_path):
    path = tmp_path / "a.warc.gz"
    path.write_bytes(one_member(MANY)[:-9])
    files = warc.whole_files(spark, [str(path)])
    with pytest.raises(Exception, match="damaged archive"):
        warc.read_pages(files).count()
    assert warc.read_pages(files, skip_gaps=True).count() == 20
    assert [tuple(r)[1:] for r in warc.gaps(files).collect()] == [(0, path.stat().st_size, "member cut off")]


def test_search_crosses_blocks(spark, tmp_path, monkeypatch):
    parts = archive()
    junk = bytes(3 * warc._BLOCK - len(parts[0]) - 1)
    assert read(spark, tmp_path, parts[0] + junk + b"".join(parts[1:])) == ({0, 1, 2, 3, 4}, [(len(parts[0]), len(junk))])


def test_empty_table(spark):
    segments = warc.write_archives(pages(spark, []), scratch(spark, "warc-test"))
    assert warc.read_pages(segments).count() == 0


def test_matches_sql(spark):
    r = compare(queries.op9_warc(spark, SF), duckdb_connection(SF), queries.oracle_sql()["op9_warc"])
    assert r["columns_match"] and r["values_match"], r["diff_example"]
