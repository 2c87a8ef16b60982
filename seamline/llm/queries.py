"""The registered queries of this subpackage: thin projections of the operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seamline.llm import archives, language, merge_replay, mixing, near_copies, personal_data, quality, token_counts, transport_stream, tree_search
from seamline.llm.sampling import crc_of


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), ["doc_id"])


def op2_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transport_stream.media_columns(_table(spark, sf_dir, "documents"), ["doc_id"], with_media=False)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.fit_quality(docs, _table(spark, sf_dir, "labels"))
    scored = quality.score_quality(docs, model, ["doc_id"])
    return scored.select("doc_id", (crc_of("doc_id") % 4 == 2).alias("held_out"), "score", "predicted")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_replay.encode_documents(_table(spark, sf_dir, "documents"), ["doc_id"], digests_only=True)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = language.predict_language(docs, language.fit_language(docs), ["doc_id"])
    return found.select("doc_id", (crc_of("doc_id") % 5 == 0).alias("held_out"), "lang_pred", "score", "accepted")


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.find_personal_data(_table(spark, sf_dir, "documents"), ["doc_id"])


def op7_archive_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = archives.round_trip(_table(spark, sf_dir, "pages"), "page_id", "url", "html")
    return back.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "date")


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mixed(_table(spark, sf_dir, "documents"), columns=["doc_id"])
    return mix.select("doc_id", "_mix.*").withColumns({c: F.round(c, 6) for c in ("ratio", "probability")})


def op9_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies.near_copies(_table(spark, sf_dir, "documents"))


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree_search.top_inner_products(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_transport_stream, op3_quality_classifier, op4_byte_bpe, op5_language_id,
        op6_personal_data, op7_archive_round_trip, op8_source_mixing, op9_simhash_components, op10_exact_top_k,
    )
}

#: DuckDB SQL for the queries that SQL can express.
ORACLE_SQL: dict[str, str] = {
    "op8_source_mixing": mixing.mixing_sql(),
    "op10_exact_top_k": """
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
 WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (SELECT q.n, q.vec_id AS query_id, x.vec_id, CAST(list_inner_product(q.e, x.e) AS BIGINT) AS score FROM v q JOIN v x ON q.n <> x.n WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
}
