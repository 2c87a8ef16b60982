import numpy as np
import pytest

from seamline.operators import landmarks, recurrence, spectra
from seamline.streaming import candidates

SF = "/root/testdata/sf0.001"


def sound(seconds, seed):
    """Blocks of 250 ms with three tones and a noisy start each."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(int(seconds * 4)):
        t = np.arange(landmarks.HERTZ // 4) / landmarks.HERTZ
        block = sum(rng.uniform(0.1, 0.2) * np.sin(2 * np.pi * rng.uniform(200, 4000) * t) for _ in range(3))
        block[:110] += rng.normal(0, 0.1, 110)
        out.append(block)
    return np.concatenate(out).astype(np.float32)


def test_landmarks_under_gain():
    a = sound(20, 1)
    full, half = [set(zip(*landmarks.landmarks(x))) for x in (a, a * 0.5)]
    assert len(full) > 100 and len(full & half) / len(full) >= 0.95
    assert not len(landmarks.landmarks(np.zeros(50000, dtype=np.float32))[0]) and not len(landmarks.landmarks(a[:900])[0])


def test_log_power_against_a_plain_transform():
    a = sound(1, 2)[: landmarks.FRAME]
    n = np.arange(landmarks.FRAME)
    windowed = a * (0.5 - 0.5 * np.cos(2 * np.pi * n / landmarks.FRAME))
    for k in (0, 7, 300, 511):
        assert abs(landmarks.log_power(a)[0, k] - np.log(abs((windowed * np.exp(-2j * np.pi * k * n / landmarks.FRAME)).sum()) ** 2 + 1e-12)) < 1e-2


def test_match_landmarks(spark):
    creative = sound(8, 3)
    once, without = np.concatenate([sound(20, 4), creative * 0.7, sound(12, 5)]), sound(40, 6)
    clips = spark.createDataFrame([(1, landmarks.HERTZ, once.tolist()), (2, landmarks.HERTZ, without.tolist()), (3, landmarks.HERTZ, None)], "id long, hertz int, samples array<float>")
    known = spark.createDataFrame([(9, landmarks.HERTZ, creative.tolist())], "id long, hertz int, samples array<float>")
    found = landmarks.match_landmarks(landmarks.landmark_rows(clips), landmarks.landmark_rows(known))
    kept = landmarks.keep_apart(found, ["id", "known_id"], "from_frame", "to_frame", "votes").collect()
    assert [(r.id, r.known_id) for r in kept] == [(1, 9)]
    second = landmarks.HOP / landmarks.HERTZ
    assert 18.5 <= kept[0].from_frame * second <= 21.5 and 26 <= kept[0].to_frame * second <= 29.5


def every_pair(heard, known):
    """Offset, votes, first and last heard frame, pair by pair."""
    found = {}
    for a, b in zip(heard, known):
        for x in a.tolist():
            for offset in (x - b).tolist():
                n, first, last = found.get(offset, (0, x, x))
                found[offset] = n + 1, min(first, x), max(last, x)
    return [(offset, *found[offset]) for offset in sorted(found)]


@pytest.mark.parametrize(("few", "steps", "pairs"), [(256, 4096, 1 << 20), (2, 3, 50)])
def test_dense_votes_against_every_pair(monkeypatch, few, steps, pairs):
    monkeypatch.setattr(landmarks, "_FEW", few)
    monkeypatch.setattr(landmarks, "_STEPS", steps)
    monkeypatch.setattr(landmarks, "_PAIRS", pairs)
    rng = np.random.default_rng(10)
    by_transform = []
    monkeypatch.setattr(landmarks, "earliest", lambda *a, f=landmarks.earliest: by_transform.append(1) or f(*a))
    for _ in range(40):
        hashes, n, m = rng.integers(1, 90), *rng.integers(1, 150, 2)
        heard, known = [[rng.integers(0, x, rng.integers(1, 120)) + shift for _ in range(hashes)] for x, shift in ((n, -7), (m, 50))]
        assert [tuple(map(int, r)) for r in zip(*landmarks.dense_votes(heard, known))] == every_pair(heard, known)
    assert len(by_transform) > 20
    # Frames that meet only at their ends, after long stretches of others.
    heard, known = [np.arange(3000, 4000), np.arange(3000)], [np.arange(5000, 6000), np.arange(9000, 9900)]
    assert [tuple(map(int, r)) for r in zip(*landmarks.dense_votes(heard, known))] == every_pair(heard, known)


def test_matches_of_a_hash_in_every_frame(spark):
    n = 200_000  # 40 billion pairs
    rows = spark.range(n).selectExpr("1L AS id", "id AS frame", "7L AS hash")
    assert [tuple(r) for r in landmarks.match_landmarks(rows, rows).collect()] == [(1, 1, 0, 3 * n - 2, 0, n - 1)]


def test_offset_counts_against_a_join(spark, monkeypatch):
    monkeypatch.setattr(landmarks, "BLOCK_BITS", 5)
    monkeypatch.setattr(landmarks, "DENSE", 4)
    rng = np.random.default_rng(11)
    rows = [(int(k), int(f), int(h)) for k, f, h in zip(rng.integers(0, 3, 900), rng.integers(-70, 90, 900), rng.integers(0, 12, 900) ** 2 // 12)]
    heard = spark.createDataFrame([*rows, (None, 5, 1), (1, None, 1), (1, 5, None)], "id long, frame int, hash long")
    known = spark.createDataFrame([(str(k), f, h) for k, f, h in rows[::2]], "id string, frame long, hash long")
    got = landmarks.offset_counts(heard, known)
    pairs = heard.where("frame is not null").join(known.selectExpr("id AS known_id", "frame AS at", "hash"), "hash")
    want = pairs.groupBy("id", "known_id", (pairs.frame - pairs["at"]).alias("offset")).agg({"*": "count", "frame": "min"}).collect()
    last = {(r[0], r[1], r[2]): r[3] for r in pairs.groupBy("id", "known_id", (pairs.frame - pairs["at"]).alias("offset")).agg({"frame": "max"}).collect()}
    plain = {(r["id"], r["known_id"], r["offset"]): (r["count(1)"], r["min(frame)"], last[r["id"], r["known_id"], r["offset"]]) for r in want}
    assert {(r.id, r.known_id, r.offset): (r.n, r.first, r.last) for r in got.collect()} == plain
    assert landmarks.match_landmarks(heard, known).schema.simpleString() == "struct<id:bigint,known_id:string,offset:bigint,votes:bigint,from_frame:int,to_frame:int>"


def test_spectral_peaks_of_uneven_frames(spark):
    rng = np.random.default_rng(12)
    clips = {k: [None if rng.random() < 0.04 else [None if rng.random() < 0.03 else float(x) for x in rng.integers(0, 40, rng.integers(0, 24)) / 8] for _ in range(60)] for k in range(3)}
    clips[3] = [[], [], [1.0], [], []]
    df = spark.createDataFrame([(k, f, v) for k, frames in clips.items() for f, v in enumerate(frames)], "k long, f long, v array<float>")
    want = []
    for k, frames in clips.items():
        for f in range(2, len(frames) - 2):
            near = frames[f - 2 : f + 3]
            if any(v is None for v in near):
                continue
            heard = [x for x in near[2][2:] if x is not None]
            found = []
            for i, x in enumerate(near[2]):
                around = [y for n, v in enumerate(near) for j, y in enumerate(v) if abs(i - j) <= 3 and (n, j) != (2, i) and y is not None]
                if i >= 2 and x is not None and x >= max(heard) - 3 and around and x > max(around):
                    found.append((x, i))
            places = landmarks.strongest_places([x for x, _ in found]) if found else []
            want += [(k, f, found[p][1]) for p in places]
    assert len(want) > 20 and sorted(tuple(r) for r in spectra.spectral_peaks(df, "k", "f", "v", 2, 3.0, 2, 3, 4).collect()) == sorted(want)


def test_keep_apart(spark):
    rows = [(1, 0, 10, 5), (1, 5, 15, 7), (1, 14, 20, 6), (1, 15, 18, 1), (1, 30, 31, 1), (2, 0, 1, 1)]
    df = spark.createDataFrame(rows, "k long, a long, b long, s long")
    assert sorted(tuple(r) for r in landmarks.keep_apart(df, ["k"], "a", "b", "s").collect()) == [(1, 5, 15, 7), (1, 15, 18, 1), (1, 30, 31, 1), (2, 0, 1, 1)]


def test_recurrences(spark):
    rng = np.random.default_rng(8)
    known, other = rng.bytes(64 * 6 + 5), rng.bytes(1000)
    rows = [(1, other[:333] + known + other[:50]), (2, other), (3, None), (4, known[64:]), (5, known[:200] + other + known[128:330] + known)]
    df = spark.createDataFrame([(k, None if c is None else bytearray(c)) for k, c in rows], "id long, content binary")
    got = sorted(tuple(r) for r in recurrence.recurrences(df, [(7, known), (8, b"short")], 64, 3).collect())
    # A clip that begins before the first byte has no alignment.
    assert got == [(1, 7, 333, 6), (5, 7, 0, 3), (5, 7, 1200, 3), (5, 7, 1402, 6)]


def test_recurrences_in_several_passes(spark, monkeypatch):
    rng = np.random.default_rng(9)
    known = [(k, rng.bytes(64 * 4)) for k in range(5)]
    df = spark.createDataFrame([(1, bytearray(b"xx".join(c for _, c in known)))], "id long, content binary")
    monkeypatch.setattr(recurrence, "MOST_BLOCKS", 9)
    got = sorted(tuple(r) for r in recurrence.recurrences(df, known, 64, 3).collect())
    assert len(recurrence.groups_of(known, 64)) == 3 and got == [(1, k, k * 258, 4) for k in range(5)]


def test_keep_first_stream(spark, tmp_path):
    for n, part in enumerate(([(1, 0), (1, 10), (2, 5)], [(1, 11), (1, 40), (2, 30), (1, None)])):
        spark.createDataFrame(part, "k long, t long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/p={n}")
    stream = spark.readStream.schema("k long, t long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = candidates.keep_first_stream(stream, "k", "t", 10).writeStream.format("memory").queryName("kept_first").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert sorted(tuple(r) for r in spark.table("kept_first").collect()) == [(1, 0), (1, 11), (1, 40), (2, 5), (2, 30)]


def test_upsert_sink(spark, tmp_path):
    sink = candidates.UpsertSink(spark, str(tmp_path), "k", "rank", "at", "k long, rank int, at long")
    make = lambda *rows: spark.createDataFrame(rows, "k long, rank int, at long")
    sink.batch(make((1, 0, 5), (2, 1, 6)), 0)
    sink.batch(make((1, 1, 7), (2, 0, 8), (2, 1, 1), (3, 0, 9)), 1)
    sink.batch(make((1, 1, 7)), 1)
    assert sorted(tuple(r) for r in sink.now.collect()) == [(1, 1, 7), (2, 1, 6), (3, 0, 9)]


@pytest.mark.parametrize("width", ["1 day"])
def test_windowed_counts(spark, tmp_path, width):
    events = spark.read.parquet(f"{SF}/events.parquet")
    stream = spark.readStream.schema(events.schema).parquet(f"{SF}/events.parq*t")
    counts = candidates.windowed_counts(stream, "ts", "event_type", width, "1 hour")
    query = counts.writeStream.format("memory").queryName("counted").outputMode("complete").option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert spark.table("counted").groupBy().sum("n").first()[0] == events.count()
