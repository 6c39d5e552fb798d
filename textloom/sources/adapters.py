"""Bindings of texts, learners, features, edits and predictions to the star schema's tables, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import scalars as S

BANDS5 = S.BANDS[:5]
#: The features of a text: name to the lineitem aggregate that stands for it.
FEATURES = {
    "complexity__basic__n_lines": "count(*)", "complexity__basic__sum_qty": "sum(l_quantity)", "complexity__price__avg_price": "avg(l_extendedprice)",
    "complexity__price__avg_disc": "avg(l_discount)", "accuracy__edits__total_errors": "sum(case when l_returnflag = 'R' then 1 else 0 end)", "accuracy__edits__open_errors": "sum(case when l_linestatus = 'O' then 1 else 0 end)",
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def texts(spark: SparkSession, sf: str) -> DataFrame:
    """(text_id, learner_id, cefr_level, level, topic): one row for each order."""
    digit = F.substring("o_orderpriority", 1, 1).cast("int")
    step = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(3)
    band = F.element_at(F.array(*map(F.lit, BANDS5)), digit)
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("text_id"), F.col("o_custkey").alias("learner_id"), band.alias("cefr_level"), ((digit - 1) * 3 + step).alias("level"), (F.col("o_orderkey") % 8).alias("topic"))


TEXTS = """texts AS (
  SELECT o_orderkey AS text_id, o_custkey AS learner_id, ['A1','A2','B1','B2','C1'][CAST(substr(o_orderpriority, 1, 1) AS INTEGER)] AS cefr_level,
    CAST((CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1) * 3 + CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS INTEGER) AS level,
    o_orderkey % 8 AS topic FROM orders)"""


def measurements(spark: SparkSession, sf: str, source: str | None = None) -> DataFrame:
    """(text_id, features) of the texts that a tool has results for; one source's features or all."""
    mine = {k: v for k, v in FEATURES.items() if source in (None, k.split("__")[1])}
    return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("text_id")).agg(*[F.expr(f"cast({v} as double)").alias(k) for k, v in mine.items()])


MEASURED = "measured AS (SELECT l_orderkey AS text_id, " + ", ".join(f"CAST({v} AS DOUBLE) AS {k}" for k, v in FEATURES.items()) + " FROM lineitem GROUP BY l_orderkey)"


def frame(spark: SparkSession, sf: str) -> DataFrame:
    """The wide frame: every text with its labels and features, null where a tool has no result."""
    return texts(spark, sf).join(measurements(spark, sf), "text_id", "left")


FRAME = f"{TEXTS}, {MEASURED}, frame AS (SELECT texts.*, {', '.join(FEATURES)} FROM texts LEFT JOIN measured USING (text_id))"


def long_frame(spark: SparkSession, sf: str) -> DataFrame:
    """(text_id, learner_id, cefr_level, level, feature, value), nulls kept."""
    return frame(spark, sf).unpivot(["text_id", "learner_id", "cefr_level", "level"], list(FEATURES), "feature", "value")


LONG = FRAME + ", long AS (" + " UNION ALL ".join(f"SELECT text_id, learner_id, cefr_level, level, '{k}' AS feature, {k} AS value FROM frame" for k in FEATURES) + ")"


def edits(spark: SparkSession, sf: str) -> DataFrame:
    """(text_id, error_type, start, stop): one row for each line of an order."""
    op = F.when(F.col("l_returnflag") == "A", "M").when(F.col("l_returnflag") == "N", "U").otherwise("R")
    start = F.col("l_quantity").cast("long")
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("text_id"), F.concat_ws(":", op, "l_linestatus").alias("error_type"), start.alias("start"), (start + F.col("l_linenumber")).alias("stop"), F.col("l_tax").alias("tax"))


EDITS = """edits AS (
  SELECT l_orderkey AS text_id, CASE l_returnflag WHEN 'A' THEN 'M' WHEN 'N' THEN 'U' ELSE 'R' END || ':' || l_linestatus AS error_type,
    CAST(floor(l_quantity) AS BIGINT) AS start, CAST(floor(l_quantity) AS BIGINT) + l_linenumber AS stop, l_tax AS tax FROM lineitem)"""


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """(labels, predicted_level_continuous, predicted_level, predicted_cefr, split) by a fixed rule instead of a model."""
    t = texts(spark, sf)
    x = S.clamp(F.col("level") + ((F.col("text_id") * 7) % 11 - 5).cast("double") / 4.0, 1.0, 15.0)
    p = S.rounded_level(x)
    band = F.element_at(F.array(*map(F.lit, BANDS5)), (F.floor((p - 1) / 3.0) + 1).cast("int"))
    return t.select("*", x.alias("predicted_level_continuous"), p.alias("predicted_level"), band.alias("predicted_cefr"), S.split_of(F.col("learner_id")).alias("split"))


PREDICTED = TEXTS + """, scored AS (
  SELECT *, greatest(1.0, least(15.0, level + CAST((text_id * 7) % 11 - 5 AS DOUBLE) / 4)) AS predicted_level_continuous FROM texts
), predicted AS (
  SELECT *, ['A1','A2','B1','B2','C1'][(predicted_level - 1) // 3 + 1] AS predicted_cefr,
    CASE WHEN share < 0.70 THEN 'train' WHEN share < 0.85 THEN 'validation' ELSE 'test' END AS split
  FROM (SELECT *, CAST(round_even(CAST(predicted_level_continuous AS DOUBLE), 0) AS INTEGER) AS predicted_level,
    CAST(('0x' || substr(sha256('42:' || CAST(learner_id AS VARCHAR)), 1, 16))::UBIGINT AS DOUBLE) / 18446744073709551616.0 AS share FROM scored))"""
