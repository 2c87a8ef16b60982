"""Mixing sources to target weights by iterative proportional fitting, with DataFrame functions alone.

Token weights of the cells (source, language, topic) are raked in turn to target shares of each of the three margins;
a target is the margin's own token share to a power, scaled to sum to one. Rounds go on until every margin is within
``TOLERANCE`` of its targets, relatively; where the targets contradict each other (cells that do not exist cannot take
weight) the rounds end once the error no longer falls, and a warning states it. Documents are then sampled with probabilities
proportional to their cell's weight per token, at most one, and calibrated so that the expected share of tokens kept is
``keep_share``. A document's draw is a hash of its id, so it does not depend on partitioning.

Tokens are estimated as a quarter of the UTF-8 bytes, rounded up. The default topic is a rule on the text; any column or
expression will do.

Defined cases: a null source or language counts as an empty string; a null or empty text has no tokens, and such documents
have their cell's probability (one where the whole cell has no tokens); a null id draws like an empty id; repeated rows
draw alike; a table without tokens is kept whole; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seamline.llm.arrow import quoted
from seamline.llm.storage import scratch, written

MARGINS = ("source", "lang", "topic")
#: Powers of the margins' own shares that make the targets.
POWERS = {"source": 0.8, "lang": 0.7, "topic": 0.8}
ROUNDS, KEEP_SHARE, CALIBRATIONS = 6, 0.8, 24
#: Largest relative error of a margin that ends the raking; rounds in which the error must fall by a tenth, or it stalls.
TOLERANCE, PATIENCE = 1e-12, 30
#: SQL cannot stop at a tolerance, so it goes on for so many rounds.
SQL_ROUNDS = 40


def rule_topic(text: Column) -> Column:
    """A topic by rule: tables, addresses, long and short prose."""
    text = F.coalesce(text, F.lit(""))
    return (
        F.when(F.instr(text, " | ") > 0, "table").when(F.instr(text, "@") > 0, "contact").when(F.octet_length(text) >= 4000, "long").otherwise("short")
    )


def with_cells(df: DataFrame, text_col: str, source_col: str, lang_col: str, topic: Column | None, carried: dict[str, Column]) -> DataFrame:
    """The ``carried`` columns and one struct column ``cell`` of source, lang, topic and tokens; no other name is left."""
    text = F.col(quoted(text_col))
    cell = F.struct(
        F.coalesce(F.col(quoted(source_col)).cast("string"), F.lit("")).alias("source"),
        F.coalesce(F.col(quoted(lang_col)).cast("string"), F.lit("")).alias("lang"),
        F.coalesce(rule_topic(text) if topic is None else topic, F.lit("")).alias("topic"),
        F.floor((F.octet_length(F.coalesce(text, F.lit(""))) + 3) / 4).cast("long").alias("tokens"),
    )
    return df.select(*[c.alias(n) for n, c in carried.items()], cell.alias("cell"))


def _sum_over(margin: str) -> Column:
    return F.sum("w").over(Window.partitionBy(margin))


def raked_cells(cells: DataFrame, powers: dict[str, float] = POWERS, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """``cells`` (source, lang, topic, tokens) with w, the raked share of all tokens: ``rounds`` at least, and on to ``tolerance``.

    Each cell carries the targets of its three margins, so that a round is three window sums over cells and no join.
    """
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    w = cells.withColumn("w", F.col("tokens") / F.lit(float(max(total, 1))))
    for m in MARGINS:
        share = _sum_over(m)
        w = w.withColumn(f"t_{m}", F.when(share > 0, F.pow(share, F.lit(powers[m]))).otherwise(0.0))
    # A margin's value counts once in the scale, in however many cells it stands.
    once = [F.sum(F.col(f"t_{m}") / F.col(f"n_{m}")).alias(m) for m in MARGINS]
    scale = w.withColumns({f"n_{m}": F.count(F.lit(1)).over(Window.partitionBy(m)) for m in MARGINS}).agg(*once).first()
    w = written(w.withColumns({f"t_{m}": F.col(f"t_{m}") / F.lit(scale[m] or 1.0) for m in MARGINS}), "targets")
    errors: list[float] = []
    while len(errors) < rounds or errors[-1] > tolerance:
        if len(errors) > max(rounds, PATIENCE) and errors[-1] > 0.9 * errors[-1 - PATIENCE]:
            warnings.warn(f"raking: the targets contradict each other; margins are off by up to {errors[-1]:.3g} after {len(errors)} rounds", stacklevel=2)
            break
        for m in MARGINS:
            s = _sum_over(m)
            w = w.withColumn("w", F.col("w") * F.when(s > 0, F.col(f"t_{m}") / s).otherwise(0.0))
        off = F.greatest(*[F.when(F.col(f"t_{m}") > 0, F.abs(_sum_over(m) / F.col(f"t_{m}") - 1)).otherwise(0.0) for m in MARGINS])
        w = written(w.withColumn("off", off), "raked")
        errors.append(w.agg(F.max("off")).first()[0] or 0.0)
        w = w.drop("off")
    return w.select(*MARGINS, "tokens", "w")


def cell_probabilities(raked: DataFrame, keep_share: float = KEEP_SHARE) -> DataFrame:
    """``raked`` with probability: min(1, c * w / tokens), c such that ``keep_share`` of all tokens is expected."""
    total = raked.agg(F.sum("tokens")).first()[0] or 0
    c = keep_share * total
    for _ in range(CALIBRATIONS):
        full = F.lit(c) * F.col("w") >= F.col("tokens")
        sums = raked.agg(F.sum(F.when(full, F.col("tokens")).otherwise(0)).alias("full"), F.sum(F.when(full, 0.0).otherwise(F.col("w"))).alias("open")).first()
        if not sums["open"]:
            break
        before, c = c, (keep_share * total - sums["full"]) / sums["open"]
        if abs(c - before) <= 1e-12 * abs(before):
            break
    chance = F.when(F.col("tokens") > 0, F.least(F.lit(1.0), F.lit(c) * F.col("w") / F.col("tokens"))).otherwise(1.0)
    return raked.withColumn("probability", chance)


def draw(id_col: str) -> Column:
    """A number in [0, 1) from the id's MD5."""
    digest = F.md5(F.coalesce(F.col(quoted(id_col)).cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))


def _weighed(df: DataFrame, id_col: str, text_col: str, source_col: str, lang_col: str, topic: Column | None, powers: dict[str, float], keep_share: float, rounds: int, columns: list[str]) -> DataFrame:
    """``row``, the named columns as one struct, so that none of them can clash with what is made here, and ``mix``."""
    row = F.struct(*[F.col(quoted(n)) for n in columns])
    marked = with_cells(df, text_col, source_col, lang_col, topic, {"row": row, "u": draw(id_col)})
    cells = marked.groupBy(*[F.col(f"cell.{m}").alias(m) for m in MARGINS]).agg(F.sum("cell.tokens").alias("tokens"))
    with scratch(df.sparkSession):
        raked = written(cell_probabilities(raked_cells(written(cells, "cells"), powers, rounds), keep_share), "probabilities", read_later=True)
    total = raked.agg(F.sum("tokens")).first()[0] or 0
    ratio = F.when(F.col("tokens") > 0, F.col("w") * F.lit(float(total)) / F.col("tokens")).otherwise(1.0)
    side = raked.select(F.struct(*MARGINS).alias("key"), ratio.alias("ratio"), F.col("probability").alias("p"))
    left = marked.withColumn("key", F.struct(*[F.col(f"cell.{m}").alias(m) for m in MARGINS]))
    mix = F.struct("cell.source", "cell.lang", "cell.topic", "cell.tokens", "ratio", F.col("p").alias("probability"), (F.col("u") < F.col("p")).alias("kept"))
    return left.join(side, "key").select("row", mix.alias("mix"))


def mixed(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    lang_col: str = "lang",
    topic: Column | None = None,
    powers: dict[str, float] = POWERS,
    keep_share: float = KEEP_SHARE,
    rounds: int = ROUNDS,
    columns: list[str] | None = None,
    out: str = "_mix",
) -> DataFrame:
    """``columns`` of every document (all, unless named) and a struct ``out``: source, lang, topic, tokens, ratio (weight
    per token against the corpus), probability and kept. A column of the input named as ``out`` gives way to it."""
    names = [n for n in (df.columns if columns is None else columns) if n.lower() != out.lower()]
    found = _weighed(df, id_col, text_col, source_col, lang_col, topic, powers, keep_share, rounds, names)
    return found.select("row.*", F.col("mix").alias(out))


def sampled(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    lang_col: str = "lang",
    topic: Column | None = None,
    powers: dict[str, float] = POWERS,
    keep_share: float = KEEP_SHARE,
    rounds: int = ROUNDS,
) -> DataFrame:
    """The documents that are kept, with all their columns, whatever those are named."""
    return _weighed(df, id_col, text_col, source_col, lang_col, topic, powers, keep_share, rounds, df.columns).where("mix.kept").select("row.*")


def mixing_sql(powers: dict[str, float] = POWERS, keep_share: float = KEEP_SHARE, rounds: int = SQL_ROUNDS) -> str:
    """DuckDB SQL for the registered query on ``documents``: ``rounds`` written out, enough for the margins to be reached."""
    parts = [
        """docs AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang,
 CASE WHEN contains(coalesce(text, ''), ' | ') THEN 'table' WHEN contains(coalesce(text, ''), '@') THEN 'contact'
 WHEN strlen(coalesce(text, '')) >= 4000 THEN 'long' ELSE 'short' END AS topic,
 CAST((strlen(coalesce(text, '')) + 3) // 4 AS BIGINT) AS tokens FROM documents)""",
        "cells AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(tokens) AS BIGINT) AS tokens FROM docs GROUP BY ALL)",
        "all_tokens AS MATERIALIZED (SELECT CAST(greatest(sum(tokens), 1) AS DOUBLE) AS total FROM cells)",
        "w0 AS MATERIALIZED (SELECT source, lang, topic, tokens, tokens / total AS w FROM cells, all_tokens)",
    ]
    for m in MARGINS:
        parts.append(
            f"t_{m} AS MATERIALIZED (SELECT {m}, p / sum(p) OVER () AS target FROM (SELECT {m}, CASE WHEN sum(w) > 0 THEN pow(sum(w), {powers[m]}) ELSE 0 END AS p FROM w0 GROUP BY {m}))"
        )
    at = 0
    for _ in range(rounds):
        for m in MARGINS:
            parts.append(
                f"w{at + 1} AS MATERIALIZED (SELECT x.source, x.lang, x.topic, x.tokens, CASE WHEN s > 0 THEN x.w * (target / s) ELSE 0 END AS w "
                f"FROM (SELECT *, sum(w) OVER (PARTITION BY {m}) AS s FROM w{at}) x JOIN t_{m} t ON x.{m} = t.{m})"
            )
            at += 1
    parts.append(f"c0 AS MATERIALIZED (SELECT {keep_share} * total AS c FROM all_tokens)")
    for k in range(CALIBRATIONS):
        parts.append(
            f"c{k + 1} AS MATERIALIZED (SELECT CASE WHEN o > 0 THEN ({keep_share} * total - f) / o ELSE c END AS c FROM (SELECT c, "
            f"sum(CASE WHEN c * w >= tokens THEN tokens ELSE 0 END) AS f, sum(CASE WHEN c * w >= tokens THEN 0 ELSE w END) AS o FROM w{at}, c{k} GROUP BY c), all_tokens)"
        )
    parts.append(
        f"p AS MATERIALIZED (SELECT source, lang, topic, CASE WHEN tokens > 0 THEN w * total / tokens ELSE 1 END AS ratio, "
        f"CASE WHEN tokens > 0 THEN least(1.0::DOUBLE, c * w / tokens) ELSE 1 END AS probability FROM w{at}, c{CALIBRATIONS}, all_tokens)"
    )
    return (
        "WITH " + ",\n".join(parts) + "\nSELECT doc_id, source, lang, topic, tokens, round(ratio, 6) AS ratio, round(probability, 6) AS probability, "
        "('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE < probability AS kept FROM docs JOIN p USING (source, lang, topic)"
    )
