import numpy as np
import pytest
from pyspark.sql import functions as F

from seamline.functions import resolution
from seamline.operators import blocks, byte_diff, intervals, landmarks, spectra
from seamline.plans import queries
from seamline.sources import frames, synthetic
from seamline.streaming import candidates


def slow_cuts(a, b, block):
    """What byte_cuts must give, by trying every window of the reference against every block."""
    places = range(0, len(a) - block + 1, block)
    cuts, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            i, j = i + 1, j + 1
            continue
        found = None
        for h in range(j, len(b) - block + 1):
            for p in places:
                if p >= i and a[p : p + block] == b[h : h + block]:
                    x, y = p, h
                    while x and y and a[x - 1] == b[y - 1]:
                        x, y = x - 1, y - 1
                    if found is None or x < found[0]:
                        found = (x, y)
            if found and found[0] <= i:
                break
        if found is None:
            break
        x, y = found
        if x < i:
            x, y = i, y + i - x
        else:
            cuts.append((i, x))
        i, j = x, y
    return [c for c in [*cuts, (i, len(a))] if c[1] > c[0]]


def test_byte_cuts_against_trying_everything():
    rng = np.random.default_rng(1)
    for n in range(250):
        letters = 2 + n % 5 * 40
        piece = lambda most: bytes(rng.integers(0, letters, rng.integers(0, most), dtype=np.uint8))  # noqa: E731, B023
        parts = [piece(60) for _ in range(4)]
        a = parts[0] + piece(20) + parts[1] + piece(30) + parts[2]
        b = parts[0] + piece(20) + parts[1] + parts[3] + parts[2]
        assert byte_diff.byte_cuts(a, b, block=8) == slow_cuts(a, b, 8), (a, b)


def test_byte_cuts_of_long_and_of_monotonous_values():
    rng = np.random.default_rng(2)
    base, stretch = rng.bytes(5_000_000), rng.bytes(300_000)
    assert byte_diff.byte_cuts(base[:2_000_000] + stretch + base[2_000_000:], base) == [(2_000_000, 2_300_000)]
    zeros = base[:1_000_000] + bytes(500_000) + base[1_000_000:]
    assert byte_diff.byte_cuts(zeros, base[:500_000] + bytes(20_000) + base[500_000:]) == [(1_000_000, 1_500_000)]


def test_peaks_take_the_place_of_the_first_weakest(spark):
    # Four are kept, the weakest two are equal; a stronger one takes the first one's place.
    assert landmarks.strongest_places([5.0, 1.0, 1.0, 6.0, 3.0]) == [0, 4, 2, 3] and landmarks.strongest_places([1.0, 1.0]) == [0, 1]
    rows = [([(5.0, 3), (1.0, 10), (1.0, 20), (6.0, 25), (3.0, 30)],), ([(2.0, 4), (2.0, 5), (2.0, 6), (2.0, 7), (2.0, 8)],), ([(2.0, 4)],), ([],)]
    df = spark.createDataFrame(rows, "p array<struct<strength double, bin int>>").select(spectra.strongest_places(F.col("p"), 4).alias("p"))
    assert [sorted(x.bin for x in r.p) for r in df.collect()] == [[3, 20, 25, 30], [4, 5, 6, 7], [4], []]


def test_overlaps_against_the_greedy_choice(spark):
    rng = np.random.default_rng(3)
    rows = [(int(k), int(a), int(a + d), float(v)) for k, a, d, v in zip(rng.integers(0, 4, 300), rng.integers(0, 900, 300), rng.integers(1, 30, 300), rng.integers(0, 5, 300))]
    want = []
    for k in range(4):
        kept = []
        for v, a, b in sorted((-v, a, b) for x, a, b, v in rows if x == k):
            if all(b <= y or a >= z for y, z in kept):
                kept.append((a, b))
        want += [(k, *s) for s in kept]
    got = landmarks.keep_apart(spark.createDataFrame(rows, "k int, a int, b int, v double").repartition(3), ["k"], "a", "b", "v")
    assert sorted((r.k, r.a, r.b) for r in got.collect()) == sorted(want)


def test_segments_of_frames(spark):
    found = {}
    for r in queries.frame_walk_synthetic(spark, "").collect():
        found.setdefault(r.id, []).append((r.segment, r.start_byte, r.end_byte, round(r.seconds, 3)))
    sizes = [len(r.content) for r in synthetic.streams(spark).orderBy("id").collect()]
    frame, long = 261, 576 / 22050
    assert found[0] == [(0, 0, sizes[0], round(201 * long, 3))]
    assert sorted(found[1]) == [(0, 0, 201 * frame, round(201 * long, 3)), (1, 201 * frame, sizes[1], round(151 * long, 3))]
    # The tail of 41 frames lasts a second and begins no segment of its own.
    assert sorted(found[2]) == [(0, 0, 201 * frame, round(201 * long, 3)), (1, 201 * frame, sizes[2], round(192 * long, 3))]
    assert found[3][0][1] == 34 and set(found) == {0, 1, 2, 3}
    assert frames.first_audio_byte(b"no frames here") == 14 and frames.first_audio_byte(synthetic.frame(9)) == 0


def test_chapters_move_with_cuts(spark):
    after = [tuple(r)[3:] for r in queries.id3_chapters_synthetic(spark, "").where("cut and version = 4").orderBy("chapter").collect()]
    none = 0xFFFFFFFF
    assert after == [(0, 5000, 0, 10_000), (5000, 7000, none, none), (5000, 5000, 10_000, 10_000), (7000, 11_000, 20_000, 50_000)]
    two = frames.shift_chapters(synthetic.chapter_tag([(10_000, 14_000, none, none)]), [(1000, 2000), (5000, 8000)], [])
    assert [c[:2] for c in frames.chapters(two)] == [(6000, 10_000)]
    assert frames.shift_chapters(b"no tag", [(0, 5)], []) == b"no tag"


def test_landmarks_of_made_sound_match_where_the_clip_stands(spark):
    (match,) = queries.stft_landmarks_synthetic(spark, "").collect()
    second = landmarks.HERTZ / landmarks.HOP
    assert (match.id, match.known_id) == (1, 2) and 11.5 < match.from_frame / second < 13.5 and 18.5 < match.to_frame / second < 20.5
    heard = landmarks.landmark_rows(synthetic.clips(spark))
    assert {r.id for r in landmarks.landmark_floors(heard).where("enough").collect()} == {1, 2}
    assert landmarks.whole_matches(heard.where("id = 2"), heard.where("id = 2").where("frame < 0")).count() == 0


def test_frame_ranges(spark):
    rows = spark.createDataFrame([(k, 100 * (n + 1), 10 * n, 10 * (n + 1)) for k in range(4) for n in range(5)], "k int, until int, start_byte int, end_byte int")
    asked = spark.createDataFrame([(0, 100, 200), (1, 0, 9999), (2, 500, 600), (3, 150, 151)], "k int, since int, till int")
    got = {r.k: (r.from_byte, r.to_byte) for r in intervals.frame_ranges(rows, asked, ["k"]).collect()}
    assert got == {0: (10, 20), 1: (0, 50), 2: (None, None), 3: (10, 20)}


def test_sources(spark):
    rows = [("bytes", 1, 70_539_410, 66_843_410, 4170), ("bytes", 2, 66_843_410, 66_843_410, 4170), ("rate", 1, 66_843_410, None, 4170), ("none", 1, 66_843_410, 0, 0), ("filled", 1, 70_539_410, None, 4170)]
    df = spark.createDataFrame(rows, "k string, priority int, size long, declared long, seconds long")
    got = {r.k: (r.priority, r.required_rate) for r in resolution.first_valid(df, ["k"], "priority", "size", "declared", "seconds").collect()}
    assert got == {"bytes": (2, None), "rate": (1, 128000)}
    urls = spark.createDataFrame([("https://a/b?m=%5B2682539,2682539,1478560%5D&fallback_url=https%3A%2F%2Fc%2Fd", "bytes 0-0/77"), ("https://a/b?m=garbage&fallback_url=ftp", "bytes 0-0/*"), ("not one", None)], "u string, h string")
    found = [tuple(r) for r in urls.select(resolution.final_slots(F.col("u")), resolution.fallback_url(F.col("u")), resolution.total_of_range(F.col("h"))).collect()]
    assert found == [([1478560, 2682539], "https://c/d", 77), ([], None, None), ([], None, None)]


def test_texts_without_cuts(spark):
    df = spark.createDataFrame([("abcdefgh", [(2, 4), (6, 7)]), ("ab", [])], "t string, c array<struct<start int, stop int>>")
    assert [r[0] for r in df.select(blocks.without_cuts("t", F.col("c"))).collect()] == ["abefh", "ab"]


def test_a_new_sink_goes_on_from_the_last_version(spark, tmp_path):
    make = lambda *rows: spark.createDataFrame(rows, "k long, rank int, at long")
    sink = lambda: candidates.UpsertSink(spark, str(tmp_path), "k", "rank", "at", "k long, rank int, at long")
    assert sink().now.count() == 0
    sink().batch(make((1, 0, 5), (2, 1, 6)), 0)
    sink().batch(make((3, 0, 7)), 1)
    sink().batch(make((1, 1, 8)), 2)
    sink().batch(make((9, 9, 9)), 2)
    assert sorted(tuple(r) for r in sink().now.collect()) == [(1, 1, 8), (2, 1, 6), (3, 0, 7)] and sink().versions() == [1, 2]


@pytest.mark.parametrize("lateness", [None, 1000])
def test_keep_first_stream_in_batches(spark, tmp_path, lateness):
    for n, rows in enumerate([[("a", 5000), ("a", 5100), ("b", 5050)], [("a", 5120), ("a", 5090), ("b", 5400)], [("a", 9000), ("a", 9050)]]):
        spark.createDataFrame(rows, "key string, t long").coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    stream = spark.readStream.schema("key string, t long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    got = candidates.drained(candidates.keep_first_stream(stream, "key", "t", 100, lateness), f"{tmp_path}/out")
    assert sorted(tuple(r) for r in got.collect()) == [("a", 5000), ("a", 5120), ("a", 9000), ("b", 5050), ("b", 5400)]
