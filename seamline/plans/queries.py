"""The registered queries of the stream operators over whole driver tables, each with DuckDB SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seamline.functions import resolution
from seamline.operators import blocks, byte_diff, evidence, intervals, landmarks, recurrence, spectra, stores
from seamline.sources import frames, synthetic
from seamline.streaming import candidates

#: Milliseconds within which signals meet, and the length of an interval.
NEAR, SPAN = 30 * 60 * 1000, 10 * 60 * 1000
#: Prior confidence by source, in the order of sources.
PRIORS = {"view": 0.3, "click": 0.4, "signup": 0.65, "purchase": 0.85, "error": 0.9}
MOST, SAMPLE, BLOCK, LEAST_RUN, LEAST_TAIL = 64, 32, 64, 3, 30 * 60 * 1000

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Milliseconds of a timestamp without a zone, whatever the session's zone is.
_MILLIS = "CAST(datediff(CAST(ts AS DATE), DATE'1970-01-01') AS BIGINT) * 86400000 + hour(ts) * 3600000L + minute(ts) * 60000L + CAST(extract(SECOND FROM ts) * 1000 AS BIGINT)"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", F.expr(_MILLIS).alias("t"))


def _order_of_source() -> F.Column:
    return F.coalesce(*[F.when(F.col("event_type") == s, i) for i, s in enumerate(PRIORS)])


def _with_prior(df: DataFrame) -> DataFrame:
    return df.withColumn("confidence", F.coalesce(*[F.when(F.col("event_type") == s, c) for s, c in PRIORS.items()]))


_EV = "e AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) // 1000 AS t FROM events)"
_PRIOR = "CASE event_type " + " ".join(f"WHEN '{s}' THEN {c}::DOUBLE" for s, c in PRIORS.items()) + " END"
_ORDER = "CASE event_type " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(PRIORS)) + " END"
_KEPT = f"""{_EV},
k AS (SELECT user_id, event_type, min(t) AS t FROM e GROUP BY 1, 2
 UNION ALL SELECT e.user_id, e.event_type, min(e.t) FROM k JOIN e ON e.user_id = k.user_id AND e.event_type = k.event_type AND e.t > k.t + {NEAR} GROUP BY 1, 2),
kept AS (SELECT k.user_id, k.event_type, k.t, min(e.event_id) AS event_id FROM k JOIN e ON e.user_id = k.user_id AND e.event_type = k.event_type AND e.t = k.t GROUP BY ALL),
prior AS (SELECT *, {_PRIOR} AS c FROM kept),
agreed AS (SELECT a.user_id, a.event_type, a.t, a.event_id, round(1 - (1 - a.c) * coalesce(product(1 - b.c), 1), 6) AS confidence
 FROM prior a LEFT JOIN prior b ON b.user_id = a.user_id AND b.event_type <> a.event_type AND abs(b.t - a.t) <= {NEAR} GROUP BY a.user_id, a.event_type, a.t, a.event_id, a.c)"""


def _kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.keep_first(_events(spark, sf_dir), ["user_id", "event_type"], "t", NEAR, ["event_id"])


def _agreed(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evidence.corroborate(_with_prior(_kept(spark, sf_dir)), ["user_id"], "event_type", "t", "confidence", NEAR)
    return found.select("user_id", "event_type", "t", "event_id", F.round("confidence", 6).alias("confidence"))


@_query(f"""WITH RECURSIVE {_KEPT}, seen AS (SELECT user_id, event_type, min(event_id) AS seen FROM e GROUP BY 1, 2),
r AS (SELECT agreed.*, row_number() OVER (PARTITION BY user_id ORDER BY confidence DESC, t, seen) AS rank FROM agreed JOIN seen USING (user_id, event_type))
SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, {_ORDER}) AS place FROM r WHERE rank <= {MOST}""")
def fusion_flagship(spark, sf_dir):
    """Equal confidences and times go by the source seen first; ``place`` is the order of output."""
    seen = _events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.min("event_id").alias("seen"))
    best = evidence.strongest(_agreed(spark, sf_dir).join(seen, ["user_id", "event_type"]), ["user_id"], [F.col("confidence").desc(), F.col("t"), F.col("seen")], MOST)
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("t", _order_of_source()))
    return best.select("user_id", "event_type", "t", "event_id", "confidence", "rank", place.alias("place"))


@_query(f"WITH RECURSIVE {_KEPT} SELECT user_id, event_type, t, event_id FROM kept")
def keep_first_merge(spark, sf_dir):
    return _kept(spark, sf_dir).select("user_id", "event_type", "t", "event_id")


@_query(f"WITH RECURSIVE {_KEPT} SELECT user_id, event_type, t, event_id, confidence FROM agreed")
def corroborate_range_join(spark, sf_dir):
    return _agreed(spark, sf_dir)


@_query(f"WITH {_EV} SELECT user_id, event_id, value, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC NULLS LAST, t, event_id) AS rank FROM e) WHERE rank <= {MOST}")
def top_candidates_per_scope(spark, sf_dir):
    order = [F.col("value").desc_nulls_last(), F.col("t"), F.col("event_id")]
    return evidence.strongest(_events(spark, sf_dir), ["user_id"], order, MOST).select("user_id", "event_id", "value", "rank")


@_query(f"""WITH {_EV}, f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS place FROM e),
c AS (SELECT user_id, event_type, count(*) AS n, min(place) AS first FROM f WHERE place <= {SAMPLE} GROUP BY 1, 2)
SELECT user_id, event_type, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first) AS r FROM c) WHERE r = 1""")
def dominant_value(spark, sf_dir):
    return evidence.dominant(_events(spark, sf_dir), ["user_id"], "event_type", [F.col("t"), F.col("event_id")], SAMPLE)


# ---- intervals

_SPANS = f"""{_EV}, s AS (SELECT user_id, t AS start, t + {SPAN} AS stop FROM e),
n AS (SELECT *, CASE WHEN start <= max(stop) OVER (PARTITION BY user_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM s),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS island FROM n)"""


@_query(f"WITH {_SPANS} SELECT user_id, min(start) AS start, max(stop) AS stop, count(*) AS parts FROM i GROUP BY user_id, island")
def interval_merge(spark, sf_dir):
    spans = _events(spark, sf_dir).select("user_id", F.col("t").alias("start"), (F.col("t") + SPAN).alias("stop"))
    return intervals.merge_intervals(spans, ["user_id"], "start", "stop")


@_query(f"""WITH {_SPANS.replace("FROM e)", "FROM e WHERE event_type = 'error')")}, m AS (SELECT user_id, min(start) AS start, max(stop) AS stop FROM i GROUP BY user_id, island)
SELECT e.event_id, e.user_id, e.t, CAST(e.t - coalesce(sum(greatest(0, least(e.t, m.stop) - m.start)), 0) AS BIGINT) AS shifted
FROM e LEFT JOIN m ON m.user_id = e.user_id AND m.start < e.t GROUP BY e.event_id, e.user_id, e.t""")
def timeline_shift(spark, sf_dir):
    events = _events(spark, sf_dir)
    spans = events.where("event_type = 'error'").select("user_id", F.col("t").alias("start"), (F.col("t") + SPAN).alias("stop"))
    cuts = intervals.merge_intervals(spans, ["user_id"], "start", "stop")
    return intervals.shift_times(events.select("event_id", "user_id", "t"), cuts, ["user_id"], "t")


@_query(f"""WITH {_EV} SELECT event_id, user_id, t, (SELECT max(c.t) FROM e c WHERE c.user_id = e.user_id AND c.event_type = 'click' AND c.t <= e.t) AS floor_t,
(SELECT min(c.t) FROM e c WHERE c.user_id = e.user_id AND c.event_type = 'click' AND c.t >= e.t) AS ceil_t FROM e""")
def asof_snap(spark, sf_dir):
    found = intervals.as_of(_events(spark, sf_dir), ["user_id"], "t", F.col("event_type") == "click", "floor_t", "ceil_t")
    return found.select("event_id", "user_id", "t", "floor_t", "ceil_t")


@_query(f"""WITH {_EV} SELECT event_id, user_id, CAST(coalesce(sum(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before,
lead(t) OVER (PARTITION BY user_id ORDER BY t, event_id) - t AS lasts FROM e""")
def prefix_timeline(spark, sf_dir):
    cents = F.round(F.col("value") * 100).cast("long")
    return intervals.prefix_timeline(_events(spark, sf_dir), ["user_id"], "t", "event_id", cents).select("event_id", "user_id", "before", "lasts")


@_query(f"""WITH {_EV}, o AS (SELECT *, CASE WHEN event_type = 'signup' AND row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) > 1 THEN 1 ELSE 0 END AS opens FROM e),
g AS (SELECT *, CAST(sum(opens) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM o),
s AS (SELECT user_id, segment, min(t) AS start, max(t) AS stop, count(*) AS n FROM g GROUP BY user_id, segment),
l AS (SELECT *, segment = max(segment) OVER (PARTITION BY user_id) AND segment > 0 AND stop - start < {LEAST_TAIL} AS short FROM s)
SELECT user_id, CASE WHEN short THEN segment - 1 ELSE segment END AS segment, min(start) AS start, max(stop) AS stop, CAST(sum(n) AS BIGINT) AS n FROM l GROUP BY 1, 2""")
def segment_scan(spark, sf_dir):
    found = intervals.segments(_events(spark, sf_dir), ["user_id"], "t", "event_id", F.col("event_type") == "signup")
    return intervals.merged_tail(found, ["user_id"], LEAST_TAIL)


_FRAMES = """f AS (SELECT l_orderkey, 10 * CAST(sum(l_quantity) OVER w AS BIGINT) AS until, CAST(sum(round(l_extendedprice)) OVER w AS BIGINT) AS end_byte, CAST(round(l_extendedprice) AS BIGINT) AS size
 FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice ROWS UNBOUNDED PRECEDING))"""


@_query(f"""WITH {_FRAMES}, j AS (SELECT l_orderkey, until, end_byte - size AS start_byte, end_byte, (l_orderkey % 7) * 100 AS since, (l_orderkey % 7) * 100 + 300 AS till FROM f),
g AS (SELECT l_orderkey, min(CASE WHEN since < until THEN start_byte END) AS from_byte, coalesce(min(CASE WHEN till <= until THEN end_byte END), max(end_byte)) AS last FROM j GROUP BY 1)
SELECT l_orderkey, from_byte, CASE WHEN from_byte IS NOT NULL THEN last END AS to_byte FROM g""")
def interval_lookup(spark, sf_dir):
    """The lines of an order as frames: milliseconds by quantity, bytes by price."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").rowsBetween(Window.unboundedPreceding, 0)
    size, lines = F.round("l_extendedprice").cast("long"), _table(spark, sf_dir, "lineitem")
    frames = lines.select("l_orderkey", (10 * F.sum("l_quantity").over(w).cast("long")).alias("until"), F.sum(size).over(w).alias("end_byte"), size.alias("size"))
    frames = frames.select("l_orderkey", "until", (F.col("end_byte") - F.col("size")).alias("start_byte"), "end_byte")
    since = (F.col("l_orderkey") % 7) * 100
    requests = lines.select("l_orderkey").distinct().select("l_orderkey", since.alias("since"), (since + 300).alias("till"))
    return intervals.frame_ranges(frames, requests, ["l_orderkey"])


@_query()
def overlap_suppression(spark, sf_dir):
    """Events as spans of their user, the stronger value first."""
    spans = _events(spark, sf_dir).where("value is not null").select("user_id", "event_id", F.col("t").alias("start"), (F.col("t") + SPAN).alias("stop"), "value")
    return landmarks.keep_apart(spans, ["user_id"], "start", "stop", "value")


@_query(f"WITH RECURSIVE {_KEPT} SELECT concat(user_id, ' ', event_type) AS key, t FROM kept")
def stream_candidates(spark, sf_dir):
    """keep_first_merge as a file stream that ends where its files do."""
    rows = spark.readStream.schema(_table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.[p]arquet")  # a pattern, as a stream takes a folder or a pattern, not a file
    rows = rows.select(F.concat_ws(" ", F.col("user_id").cast("string"), "event_type").alias("key"), F.expr(_MILLIS).alias("t"))
    folder = f"{candidates.shared_folder(spark)}/candidates-{uuid.uuid4().hex}"
    return candidates.drained(candidates.keep_first_stream(rows, "key", "t", NEAR), folder)


# ---- blocks

_BLOCKS = f"b AS (SELECT doc_id, i AS place, sha256(substr(text, i * {BLOCK} + 1, {BLOCK})) AS digest FROM (SELECT doc_id, text, unnest(range(0, length(text) // {BLOCK})) AS i FROM documents))"
_SIDES = f"{_BLOCKS}, known AS (SELECT DISTINCT digest FROM b WHERE doc_id % 2 = 1), p AS (SELECT * FROM b WHERE doc_id % 2 = 0)"


def _digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.block_digests(_table(spark, sf_dir, "documents"), "doc_id", "text", BLOCK)


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Blocks of the primary copies (even ids) and of the reference copies (odd ids): all rows, in two roles."""
    digests = _digests(spark, sf_dir)
    return digests.where("doc_id % 2 = 0"), digests.where("doc_id % 2 = 1")


@_query(f"WITH {_BLOCKS} SELECT doc_id, place, digest FROM b")
def block_digests(spark, sf_dir):
    return _digests(spark, sf_dir)


@_query(f"WITH {_BLOCKS}, c AS (SELECT doc_id, count(*) AS n, string_agg(digest, '' ORDER BY place) AS d FROM b GROUP BY doc_id) SELECT doc_id, coalesce(n, 0) AS blocks, sha256(coalesce(d, '')) AS content_id FROM documents LEFT JOIN c USING (doc_id)")
def content_id(spark, sf_dir):
    return blocks.content_ids(_table(spark, sf_dir, "documents"), "doc_id", "text", BLOCK)


@_query(f"WITH {_BLOCKS} SELECT digest, count(DISTINCT doc_id) AS ids, count(*) AS occurrences, min(doc_id) AS first_id FROM b GROUP BY digest HAVING count(DISTINCT doc_id) > 1")
def shared_blocks(spark, sf_dir):
    return blocks.shared_blocks(_digests(spark, sf_dir), "doc_id")


@_query(f"WITH {_SIDES}, m AS (SELECT doc_id, place, place - row_number() OVER (PARTITION BY doc_id ORDER BY place) AS g FROM p ANTI JOIN known USING (digest)) SELECT doc_id, min(place) AS from_place, max(place) AS to_place FROM m GROUP BY doc_id, g")
def aligned_block_diff(spark, sf_dir):
    return blocks.absent_runs(*_sides(spark, sf_dir), "doc_id")


@_query(f"""WITH {_SIDES}, m AS (SELECT doc_id, place, place - row_number() OVER (PARTITION BY doc_id ORDER BY place) AS g FROM p SEMI JOIN known USING (digest)),
r AS (SELECT doc_id, min(place) AS from_place, count(*) AS blocks FROM m GROUP BY doc_id, g HAVING count(*) >= {LEAST_RUN})
SELECT doc_id, from_place, blocks FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY blocks DESC, from_place) AS n FROM r) WHERE n = 1""")
def longest_verified_run(spark, sf_dir):
    return blocks.longest_verified_run(*_sides(spark, sf_dir), "doc_id", LEAST_RUN)


#: A text with a stretch of its own set before it: bytes of the stretch, and of a block. The stretch is found if a whole
#: block of the primary lies behind it. (Set in further back, repeated lines could align with an earlier one.)
_STRETCH, _DIFF_BLOCK = 100, 32


@_query(f"""WITH d AS (SELECT doc_id AS id, strlen(coalesce(text, '')) + {_STRETCH} AS total FROM documents),
r AS (SELECT *, CASE WHEN total >= (({_STRETCH} + {_DIFF_BLOCK} - 1) // {_DIFF_BLOCK} + 1) * {_DIFF_BLOCK} THEN {_STRETCH} ELSE total END AS removed FROM d)
SELECT id, CASE WHEN total - removed < 0.5 * total THEN 'no agreement' WHEN removed > 0.25 * total THEN 'too much' ELSE 'cut' END AS verdict, 1::BIGINT AS cuts, removed, total - removed AS kept_bytes FROM r""")
def byte_diff_cuts(spark, sf_dir):
    """Each text with a stretch of bytes set before it, against itself."""
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.coalesce(F.encode("text", "UTF-8"), F.lit(b"")).alias("reference"))
    return byte_diff.diff_pairs(docs.select("id", F.concat(F.lit(b"\x01" * _STRETCH), "reference").alias("primary"), "reference"), block=_DIFF_BLOCK)


@_query("""SELECT doc_id, sha256(concat(substr(text, 1, length(text) // 4), substr(text, length(text) // 2 + 1))) AS digest FROM documents WHERE text IS NOT NULL""")
def binary_splice(spark, sf_dir):
    """The second quarter of every text cut out."""
    docs = _table(spark, sf_dir, "documents").where("text is not null").withColumn("n", F.char_length("text"))
    cuts = F.array(F.struct(F.floor(F.col("n") / 4).cast("int").alias("start"), F.floor(F.col("n") / 2).cast("int").alias("stop")))
    return docs.select("doc_id", F.sha2(blocks.without_cuts("text", cuts), 256).alias("digest"))


@_query()
def any_offset_match(spark, sf_dir):
    """Where runs of benchmark passages recur in documents, at any byte. The driver holds the passages, which go in groups."""
    passages = _table(spark, sf_dir, "benchmark").where("text is not null")
    known = [(r["item_id"], r["text"].encode()) for r in passages.collect()]
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.encode("text", "UTF-8").alias("content"))
    return recurrence.recurrences(docs, known, 32, LEAST_RUN)


# ---- spectra

_PEAKS = """f AS (SELECT label, vec_id, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n, count(*) OVER (PARTITION BY label) AS total FROM embeddings),
v AS (SELECT label, vec_id, n, total, i, embedding[i + 1] AS x, list_max(embedding[5:]) - 1::FLOAT AS low FROM (SELECT *, unnest(range(64)) AS i FROM f)),
o AS (SELECT a.label, a.vec_id, a.i, a.x FROM v a JOIN v b ON b.label = a.label AND b.n BETWEEN a.n - 2 AND a.n + 2 AND b.i BETWEEN a.i - 3 AND a.i + 3 AND (b.n <> a.n OR b.i <> a.i)
 WHERE a.i >= 4 AND a.x >= a.low AND a.n > 2 AND a.n <= a.total - 2 GROUP BY a.label, a.vec_id, a.i, a.x HAVING a.x > max(b.x)),
l AS (SELECT label, vec_id, list({'x': x, 'i': i} ORDER BY i) AS c FROM o GROUP BY label, vec_id),
k AS (SELECT label, vec_id, list_reduce(list_transform(c[5:], lambda q: [q]), lambda h, q: CASE WHEN q[1].x > list_min(list_transform(h, lambda z: z.x))
 THEN list_transform(h, lambda z, n: CASE WHEN n = list_position(list_transform(h, lambda y: y.x), list_min(list_transform(h, lambda y: y.x))) THEN q[1] ELSE z END) ELSE h END, c[1:4]) AS c FROM l),
peaks AS (SELECT label, vec_id, unnest(c).i AS bin FROM k)"""


#: Least bin, distance under the maximum, neighbourhood in frames and bins, and peaks kept a frame.
_PEAK_RULE = 4, 1.0, 2, 3, 4


def _peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectra.spectral_peaks(_table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding", *_PEAK_RULE)


@_query(f"WITH {_PEAKS} SELECT label, vec_id, bin FROM peaks")
def spectral_peaks(spark, sf_dir):
    return _peaks(spark, sf_dir)


@_query(f"""WITH {_PEAKS}, p AS (SELECT a.label, a.vec_id, a.bin, b.vec_id AS f, b.bin AS b, row_number() OVER (PARTITION BY a.label, a.vec_id, a.bin ORDER BY b.vec_id, b.bin) AS r
 FROM peaks a JOIN peaks b ON b.label = a.label AND b.vec_id BETWEEN a.vec_id + 1 AND a.vec_id + 63)
SELECT label, vec_id, (bin << 15) | (b << 6) | (f - vec_id) AS hash FROM p WHERE r <= 6""")
def landmark_pairs(spark, sf_dir):
    return spectra.landmark_pairs(_peaks(spark, sf_dir), "label", "vec_id", 63, 6)


_HEARD = f"""{_PEAKS}, place AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS frame FROM embeddings),
h AS (SELECT p.label AS id, place.frame, p.bin AS hash FROM peaks p JOIN place USING (label, vec_id))"""
#: Votes and frames that an offset needs on these small tables.
_VOTES, _FRAMES_LONG = 4, 10


def _heard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames are numbered before the peaks are looked for: joined with them later, no plan would take two uses of this for equal."""
    place = F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))
    numbered = _table(spark, sf_dir, "embeddings").where("label is not null").select("label", F.when(F.col("vec_id").isNotNull(), place).alias("frame"), "embedding")
    heard = spectra.spectral_peaks(numbered, "label", "frame", "embedding", *_PEAK_RULE)
    return heard.where("frame is not null").select(F.col("label").alias("id"), "frame", F.col("bin").alias("hash"))


@_query(f"""WITH {_HEARD}, u AS (SELECT a.id, b.id AS known_id, a.frame - b.frame AS "offset", count(*) AS n, min(a.frame) AS first, max(a.frame) AS last FROM h a JOIN h b USING (hash) GROUP BY ALL),
s AS (SELECT id, known_id, "offset", n, CAST(sum(n) OVER w AS BIGINT) AS votes, max(n) OVER w AS most, min(first) OVER w AS from_frame, max(last) OVER w AS to_frame FROM u
 WINDOW w AS (PARTITION BY id, known_id ORDER BY "offset" RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING))
SELECT id, known_id, "offset", votes, from_frame, to_frame FROM s WHERE votes >= {_VOTES} AND n = most AND to_frame - from_frame >= {_FRAMES_LONG}""")
def offset_votes(spark, sf_dir):
    """Every label's peaks as a clip against every other's; a peak's bin is its hash."""
    heard = _heard(spark, sf_dir)
    return landmarks.match_landmarks(heard, heard, _VOTES, _FRAMES_LONG * landmarks.HOP / landmarks.HERTZ)


@_query(f"""WITH {_HEARD}, c AS (SELECT id, count(*) AS landmarks, count(DISTINCT hash) AS hashes, (max(frame) - min(frame)) * (512 / 11025::DOUBLE) AS seconds FROM h GROUP BY id)
SELECT id, landmarks, hashes, landmarks >= 64 AND hashes >= 48 AND seconds BETWEEN 5 AND 600 AS enough FROM c""")
def distinct_hash_floor(spark, sf_dir):
    return landmarks.landmark_floors(_heard(spark, sf_dir))


@_query()
def stft_landmarks_synthetic(spark, sf_dir):
    """Made sound: a clip, and a longer one that holds it from the twelfth second on, somewhat softer; where they match."""
    heard = landmarks.landmark_rows(synthetic.clips(spark))
    return landmarks.whole_matches(heard.where("id = 1"), heard.where("id = 2"))


@_query()
def frame_walk_synthetic(spark, sf_dir):
    """Made frames: the segments of streams of two encodes, with and without a short tail, and of no frames."""
    return frames.segment_scan(synthetic.streams(spark), "id", "content")


@_query()
def id3_chapters_synthetic(spark, sf_dir):
    """Made chapters before and after a cut of bytes 10,000 to 40,000 and of 5 to 8 seconds."""
    return synthetic.chapter_rows(spark, [(5000, 8000)], [(10_000, 40_000)])


# ---- stores

_STORE = "s AS (SELECT doc_id % 97 AS fp_id, quality AS provenance, doc_id AS arrival, doc_id % 2 AS incoming FROM labels WHERE quality IS NOT NULL)"


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "labels").where("quality is not null").selectExpr("doc_id % 97 AS fp_id", "quality AS provenance", "doc_id AS arrival", "doc_id % 2 AS incoming")


def _attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = _table(spark, sf_dir, "labels").join(_table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return stores.merge_attribution(named.selectExpr("doc_id % 97 AS fp_id", "source AS feed", "quality AS provenance"), "fp_id", "feed", "provenance")


_ATTRIBUTION = "a AS (SELECT doc_id % 97 AS fp_id, source AS feed, max(quality) AS provenance FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2)"
_TOXIC = "x AS (SELECT DISTINCT doc_id % 97 AS fp_id, source AS feed FROM labels JOIN documents USING (doc_id) WHERE toxic = 1)"


@_query(f"WITH {_STORE} SELECT fp_id, provenance, arrival, incoming = 1 AS changed FROM (SELECT *, row_number() OVER (PARTITION BY fp_id ORDER BY provenance DESC, incoming, arrival) AS r FROM s) WHERE r = 1")
def store_upsert(spark, sf_dir):
    entries = _entries(spark, sf_dir)
    stored, incoming = [entries.where(F.col("incoming") == k).drop("incoming") for k in (0, 1)]
    return stores.upsert(stored, incoming, "fp_id", "provenance", "arrival")


@_query(f"WITH {_ATTRIBUTION} SELECT * FROM a")
def attribution_merge(spark, sf_dir):
    return _attribution(spark, sf_dir)


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    toxic = _table(spark, sf_dir, "labels").where("toxic = 1").join(_table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return toxic.selectExpr("doc_id % 97 AS fp_id", "source AS feed")


@_query(f"WITH {_STORE}, {_TOXIC} SELECT fp_id, provenance, arrival FROM s WHERE fp_id NOT IN (SELECT fp_id FROM x)")
def prune_anti(spark, sf_dir):
    return stores.prune(_entries(spark, sf_dir).drop("incoming"), _matched(spark, sf_dir), "fp_id")


@_query(f"WITH {_ATTRIBUTION}, {_TOXIC} SELECT a.* FROM a ANTI JOIN x USING (fp_id, feed)")
def revoke_attribution(spark, sf_dir):
    return stores.revoke(_attribution(spark, sf_dir), _matched(spark, sf_dir), "fp_id", "feed")


@_query(f"WITH {_ATTRIBUTION} SELECT doc_id, doc_id % 97 AS fp_id, coalesce(n, 0) AS feeds FROM documents LEFT JOIN (SELECT fp_id, count(DISTINCT feed) AS n FROM a GROUP BY 1) c ON c.fp_id = doc_id % 97")
def attribution_lookup(spark, sf_dir):
    matches = _table(spark, sf_dir, "documents").selectExpr("doc_id", "doc_id % 97 AS fp_id")
    return stores.attributed(matches, _attribution(spark, sf_dir), "fp_id", "feed").select("doc_id", "fp_id", "feeds")


# ---- resolution

_RATES = ", ".join(map(str, resolution.STANDARD_RATES))


@_query(f"""WITH r AS (SELECT p_partkey, p_retailprice * 100 AS rate FROM part), n AS (SELECT p_partkey, rate, list_min(list_transform([{_RATES}], lambda x: {{'d': abs(x - rate), 'r': x}})).r AS nearest FROM r)
SELECT p_partkey, nearest, rate >= nearest * {resolution.RATE_FLOOR}::DOUBLE AND rate <= nearest * {resolution.RATE_CEILING}::DOUBLE AS fits FROM n""")
def nearest_standard(spark, sf_dir):
    rate = F.col("p_retailprice") * 100
    near = resolution.nearest_rate(rate)
    fits = (rate >= near * resolution.RATE_FLOOR) & (rate <= near * resolution.RATE_CEILING)
    return _table(spark, sf_dir, "part").select("p_partkey", near.alias("nearest"), fits.alias("fits"))


@_query("SELECT doc_id, CASE WHEN n_chars > 0 THEN abs(strlen(text) - n_chars) <= greatest(least(n_chars // 200, 100000), 16) END AS matches FROM documents")
def declared_size_check(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", resolution.size_matches(F.octet_length("text"), F.col("n_chars"), least=16).alias("matches"))


@_query(r"""SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path,
TRY_CAST(nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS BIGINT) AS page FROM pages""")
def url_metadata(spark, sf_dir):
    part = lambda name, *key: F.try_parse_url("url", F.lit(name), *map(F.lit, key))
    return _table(spark, sf_dir, "pages").select("page_id", part("HOST").alias("host"), part("PATH").alias("path"), part("QUERY", "page").try_cast("bigint").alias("page"))


_SOURCES = "p AS (SELECT page_id, page_id % 50 AS scope, octet_length(encode(coalesce(html, ''))) AS size FROM pages), d AS (SELECT scope, arg_min(size, page_id) + 3 AS declared, 60 + scope * 10 AS seconds FROM p GROUP BY scope), s AS (SELECT p.*, CASE WHEN scope % 3 > 0 THEN declared END AS declared, seconds FROM p JOIN d USING (scope))"


@_query(f"""WITH {_SOURCES}, r AS (SELECT *, size * 8.0::DOUBLE / seconds AS rate, list_min(list_transform([{_RATES}], lambda x: {{'d': abs(x - size * 8.0::DOUBLE / seconds), 'r': x}})).r AS near FROM s),
a AS (SELECT *, coalesce(declared > 0 AND abs(size - declared) <= greatest(least(declared // 200, 100000), 4096), false) AS by_size, seconds >= 60 AND rate BETWEEN near * 0.999::DOUBLE AND near * 1.015::DOUBLE AS by_rate FROM r),
v AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY page_id) AS n FROM a WHERE by_size OR by_rate)
SELECT scope, page_id, size, CASE WHEN NOT by_size THEN CAST(near AS INTEGER) END AS required_rate FROM v WHERE n = 1""")
def first_valid_source(spark, sf_dir):
    """Pages as the sources of fifty things: the first that has the size (two things in three) or rate declared."""
    pages = _table(spark, sf_dir, "pages").select("page_id", (F.col("page_id") % 50).alias("scope"), F.octet_length(F.coalesce("html", F.lit(""))).cast("long").alias("size"))
    told = pages.groupBy("scope").agg((F.min_by("size", "page_id") + 3).alias("declared"), (60 + F.col("scope") * 10).alias("seconds"))
    told = told.withColumn("declared", F.when(F.col("scope") % 3 > 0, F.col("declared")))
    return resolution.first_valid(pages.join(told, "scope"), ["scope"], "page_id", "size", "declared", "seconds")
