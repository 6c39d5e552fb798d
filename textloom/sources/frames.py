"""Frames of any columns. What a run works on is given as tables: a frame with a row for each text, a dictionary with a row
for each of its features, the texts' learners and levels, and lists of features."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import scalars as S
from textloom.operators import relational
from textloom.sources import readers

#: The columns of a frame that are no features.
LABELS = ["text_id", "learner_id", "cefr_level", "level", "topic", "filename"]
#: The groups that a feature can have.
GROUPS = ["complexity", "accuracy", "composition"]
LISTS = ["direct", "correlated", "duplicate"]


@dataclass(frozen=True)
class Given:
    """Where a run's tables are: Parquet, CSV (also gzip) or, for learners, a workbook.

    frame: text_id, features, and any of LABELS. dictionary: column, group, source, original_feature. learners: text_id (or
    writing_id), learner_id, cefr_level (or cefr). labels: text_id, level and maybe topic; None if the frame has level. direct,
    correlated, duplicate: lists of features by ``column``, or none. one_source: the source of the experiment of this name.
    words: the feature that counts a text's words."""

    frame: str
    dictionary: str
    learners: str
    labels: str | None = None
    direct: str | None = None
    correlated: str | None = None
    duplicate: str | None = None
    one_source: str | None = None
    words: str | None = None


def _read(spark: SparkSession, path: str, workbook: list[str] = ()) -> DataFrame:
    path = readers.with_fallback(path)
    if path.endswith(".xlsx"):
        return readers.read_xlsx(spark, path, list(workbook))
    df = readers.read_csv(spark, path) if path.endswith((".csv", ".csv.gz")) else spark.read.parquet(path)
    readers.header(df.columns)  # names that differ in case alone raise
    return df


def _ids(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with whole-number ids; one that is none raises, and so does a repeated first one."""
    df = df.withColumns({c: S.integer_id(F.col(c).cast("string")) for c in columns})
    bad = df.where(F.greatest(*[F.col(c).isNull().cast("int") for c in columns], F.lit(0)) == 1).limit(1).count()
    if bad:
        raise ValueError(f"an id of {columns} is null or no whole number")
    return relational.unique(df, columns[0])


def read_features(spark: SparkSession, given: Given) -> DataFrame:
    """(feature, kind, source, direct, correlated, duplicate, one_source): a row for each feature of the dictionary, which
    must name every feature once, as group__source__original_feature. A list may only name features of the dictionary."""
    rows = readers.read_metadata(spark, readers.with_fallback(given.dictionary), ["column", "group", "source", "original_feature"], [])
    told = F.concat_ws("__", "group", "source", "original_feature")
    wrong = [r["column"] for r in rows.where(~F.coalesce(F.col("group").isin(GROUPS) & (F.col("column") == told), F.lit(False))).limit(5).collect()]
    if wrong:
        raise ValueError(f"group, source and original feature of the dictionary are not those of the column: {wrong}")
    out = rows.select(F.col("column").alias("feature"), F.col("group").alias("kind"), "source")
    for name in LISTS:
        path = getattr(given, name)
        if path is None:
            out = out.withColumn(name, F.lit(False))
            continue
        listed = readers.read_metadata(spark, readers.with_fallback(path), ["column"], []).select(F.col("column").alias("feature"))
        unknown = [r["feature"] for r in listed.join(out, "feature", "left_anti").limit(5).collect()]
        if unknown:
            raise ValueError(f"{name} names columns that the dictionary lacks: {unknown}")
        out = out.join(listed.withColumn(name, F.lit(True)), "feature", "left").fillna(False, [name])
    one = F.col("source") == given.one_source if given.one_source else F.lit(False)
    return out.withColumn("one_source", one)


def features_of(spark: SparkSession, given: Given) -> list[str]:
    """The frame's features, in its order, which must be those of the dictionary."""
    columns = [c for c in _read(spark, given.frame).columns if c not in LABELS]
    named = {r["feature"] for r in read_features(spark, given).select("feature").collect()}  # a row for each column of a table
    if set(columns) != named:
        raise ValueError(f"only in the frame: {sorted(set(columns) - named)[:5]}; only in the dictionary: {sorted(named - set(columns))[:5]}")
    if given.words is not None and given.words not in named:
        raise ValueError(f"no feature {given.words}")
    return columns


def texts(spark: SparkSession, given: Given) -> DataFrame:
    """(text_id, learner_id, cefr_level, level and maybe topic) of all texts. The frame, the learners and the labels must have
    the same texts and, where several have them, the same bands; a level has one band. Nothing is dropped: what does not
    agree raises."""
    wide = _ids(_read(spark, given.frame), ["text_id"])
    people = _read(spark, given.learners, ["writing_id", "learner_id", "cefr"])
    people = people.toDF(*[c.strip().lower() for c in people.columns]).withColumnsRenamed({"writing_id": "text_id", "cefr": "cefr_level"})
    out = _ids(people, ["text_id", "learner_id"]).select("text_id", "learner_id", F.upper(F.trim("cefr_level")).alias("cefr_level"))
    levels = wide if given.labels is None else _ids(_read(spark, given.labels), ["text_id"])
    if "level" not in levels.columns:
        raise ValueError("neither the frame nor the labels have a level")
    for other in [wide] if given.labels is None else [wide, levels]:
        has = "cefr_level" in other.columns
        band = F.upper(F.trim("cefr_level")) if has else F.lit(None)
        r = relational.agreement(out.withColumn("band", F.col("cefr_level") if has else F.lit(None)), other.withColumn("band", band), "text_id", ["band"]).first()
        if r["only_left"] or r["only_right"] or r["different"]:
            raise ValueError(f"texts differ: {r['only_left']} have only a learner, {r['only_right']} have none, {r['different']} have another band")
    more = ["topic"] if "topic" in levels.columns else []
    out = out.join(levels.select("text_id", S.level(F.col("level")).alias("level"), *more), "text_id")
    bands = out.groupBy("level").agg(F.countDistinct("cefr_level").alias("n"))
    bad = F.col("level").isNull() | (F.col("n") != 1)
    invalid = out.where(~F.coalesce(F.col("cefr_level").isin(S.BANDS[:5]), F.lit(False))).limit(1).count()
    if invalid or bands.where(bad).limit(1).count():
        raise ValueError("an unknown band or level, or a level with several bands")
    return out


def frame(spark: SparkSession, given: Given) -> DataFrame:
    """texts with the frame's features as finite doubles: what is no finite number is null, never 0."""
    measured = _ids(_read(spark, given.frame), ["text_id"])
    features, kinds = features_of(spark, given), dict(measured.dtypes)
    measured = measured.withColumns({c: S.safe_number(F.col(S.quoted(c))) for c in features if kinds[c] == "string"})
    # abs(NaN) < infinity is false; one text for each column, as thousands of columns of calls take longer than the job
    finite = "if(abs(cast({0} as double)) < double('Infinity'), cast({0} as double), null) as {0}"
    values = measured.selectExpr("text_id", *[finite.format(S.quoted(c)) for c in features])
    return texts(spark, given).join(values, "text_id")
