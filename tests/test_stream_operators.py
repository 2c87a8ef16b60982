import duckdb
import numpy as np
import pytest

from seamline.functions import resolution
from seamline.operators import byte_diff, evidence
from seamline.plans.queries import ORACLE_SQL, QUERIES
from seamline.sources import frames

SF = "/root/testdata/sf0.01"


def plain(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("events", "documents", "labels", "pages", "part", "embeddings", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_agrees_with_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.execute(ORACLE_SQL[name])
    columns = sorted(c[0] for c in want.description)
    assert sorted(got.columns) == columns
    places = [[c[0] for c in want.description].index(c) for c in columns]
    rows = plain(tuple(r[i] for i in places) for r in want.fetchall())
    assert rows and plain(got.select(*columns).collect()) == rows


def test_keep_first_across_batches(spark):
    rng = np.random.default_rng(3)
    rows = [(int(k), int(t), i) for i, (k, t) in enumerate(zip(rng.integers(0, 3, 5000), rng.integers(0, 20000, 5000)))]
    df = spark.createDataFrame([*rows, (None, 5, 6000), (None, 6, 6001), (1, None, 6002)], "k long, t long, i long")
    want = []
    for key in (None, 0, 1, 2):
        last = None
        for t, i in sorted((t, i) for k, t, i in [*rows, (None, 5, 6000), (None, 6, 6001)] if k == key):
            if last is None or t - last > 25:
                want.append(i)
                last = t
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "97")
    try:
        got = [r.i for r in evidence.keep_first(df, ["k"], "t", 25, ["i"]).collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted(got) == sorted(want)


def test_byte_cuts():
    rng = np.random.default_rng(1)
    a, b, x, y = [rng.bytes(n) for n in (6000, 9000, 1500, 2100)]
    assert byte_diff.byte_cuts(a + x + b, a + y + b, 256) == [(6000, 7500)]
    assert byte_diff.byte_cuts(a + x + b, a + b, 256) == [(6000, 7500)]
    assert byte_diff.byte_cuts(a + b, a + x + b, 256) == []
    assert byte_diff.byte_cuts(a + x, a, 256) == [(6000, 7500)]
    assert byte_diff.byte_cuts(b"", a, 256) == [] and byte_diff.byte_cuts(a, b"", 256) == [(0, 6000)]
    for _ in range(30):
        order = rng.permutation(6)
        reference = b"".join(a[k * 1000 : (k + 1) * 1000] for k in order)
        at = int(rng.integers(0, len(reference)))
        primary = reference[:at] + x + reference[at:]
        assert byte_diff.splice(primary, byte_diff.byte_cuts(primary, reference, 64)) == reference


def test_window_hashes_compare_by_content():
    data = b"abcabcabd"
    h = byte_diff.window_hashes(data, 3)
    for i in range(len(h)):
        for j in range(len(h)):
            assert (h[i] == h[j]) == (data[i : i + 3] == data[j : j + 3])


def test_verdicts():
    assert [byte_diff.verdict(100, c) for c in ([(0, 60)], [], [(0, 30)], [(0, 25)])] == ["no agreement", "nothing found", "too much", "cut"]


def frame(version, rate_no, hertz_no, padding, length):
    return bytes([0xFF, 0xE0 | version << 3 | 1 << 1 | 1, rate_no << 4 | hertz_no << 2 | padding << 1, 0]) + b"\x11" * (length - 4)


def test_frames(spark):
    one, two, padded = frame(2, 9, 0, 0, 261), frame(0, 2, 0, 0, 104), frame(2, 9, 0, 1, 262)
    tag = b"ID3\x04\x00\x00\x00\x00\x00\x05hello"
    found = list(frames.frames(tag + one + b"\x00" + two + padded + one[:100]))
    assert [f[:3] for f in found] == [(15, 261, 80000), (277, 104, 16000), (381, 262, 80000)]
    rows = frames.frame_rows(spark.createDataFrame([(7, bytearray(one * 3)), (8, None)], "k long, content binary"), "k", "content").collect()
    assert [(r.id, r.frame_no, r.offset) for r in rows] == [(7, 0, 0), (7, 1, 261), (7, 2, 522)]
    marked = one[:4] + b"Xing" + b"\x00" * 253
    assert frames.is_tag_frame(marked) and not frames.is_tag_frame(one)


@pytest.mark.parametrize("version", [3, 4])
def test_chapters(version):
    body = b"c1\x00" + b"".join(n.to_bytes(4, "big") for n in (0, 5000, 10, 0xFFFFFFFF))
    chap = b"CHAP" + len(body).to_bytes(4, "big") + b"\0\0" + body
    head = lambda flags: b"ID3" + bytes([version, 0, flags]) + len(chap).to_bytes(4, "big")
    assert list(frames.chapters(head(0) + chap)) == [(0, 5000, 10, 0xFFFFFFFF)]
    assert list(frames.chapters(head(0x80) + chap)) == [] and list(frames.chapters(b"plain")) == []


def test_resolution(spark):
    df = spark.createDataFrame([("[2682539,2682539,1478560, x]", 66843410, 4170), ("garbage", 70539410, 4170), (None, 1, 10)], "m string, size long, seconds long")
    from pyspark.sql import functions as F

    got = df.select(resolution.slots(F.col("m")), resolution.implied_rate(F.col("size"), F.col("seconds")), resolution.size_matches(F.col("size"), F.lit(66843410))).collect()
    assert [tuple(r) for r in got] == [([1478560, 2682539], 128000, True), ([], None, False), (None, None, False)]
