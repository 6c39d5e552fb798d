"""Queries of scans, projections, predicates, joins, sets and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions import scalars as S
from textloom.operators import describe, relational, resample
from textloom.plans.registry import query
from textloom.sources import files, readers, writers
from textloom.sources.adapters import EDITS, FEATURES, FRAME, LONG, PREDICTED, TEXTS, edits, frame, long_frame, measurements, predictions, table, texts


def _scratch(spark: SparkSession) -> str:
    return files.scratch(spark, "plans")


@query("a03_csv_scan_strings", "SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_brand, CAST(p_size AS VARCHAR) AS p_size FROM part")
def a03(spark, sf):
    path = _scratch(spark) + "/part"
    writers.write_csv(table(spark, sf, "part").select("p_partkey", "p_brand", "p_size"), path)
    return readers.read_csv(spark, path)


@query("a04_csv_short_rows_gzip", "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(NULL AS VARCHAR) AS missing FROM nation")
def a04(spark, sf):
    path = _scratch(spark) + "/nation"
    writers.write_csv(table(spark, sf, "nation").select("n_nationkey", "n_name"), path, "gzip")
    return readers.read_csv(spark, path, ["n_nationkey", "n_name", "missing"])


@query("a06_parquet_projection", "SELECT l_orderkey, l_quantity, l_discount FROM lineitem WHERE l_quantity >= 45 AND l_returnflag = 'R'")
def a06(spark, sf):
    return table(spark, sf, "lineitem").where("l_quantity >= 45 and l_returnflag = 'R'").select("l_orderkey", "l_quantity", "l_discount")


@query("a07_named_source_view", f"WITH {FRAME} SELECT text_id, cefr_level, level, complexity__price__avg_price AS avg_price FROM frame WHERE complexity__price__avg_price IS NOT NULL", d="avg_price", n="level")
def a07(spark, sf):
    price = measurements(spark, sf, "price").withColumnRenamed("complexity__price__avg_price", "avg_price")
    return texts(spark, sf).join(price, "text_id").where("avg_price is not null").select("text_id", "cefr_level", "level", "avg_price")


@query("a08_schema_introspection", f"SELECT column_name AS \"column\", CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double' END AS type FROM (DESCRIBE WITH {FRAME} SELECT * FROM frame)")
def a08(spark, sf):
    return spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in frame(spark, sf).schema], "column string, type string")


@query("a10_registered_ids", f"WITH {TEXTS} SELECT text_id, level FROM texts WHERE text_id IN (1, 2, 3, 5, 8, 13, 21)", n="level")
def a10(spark, sf):
    ids = spark.createDataFrame([(i,) for i in (1, 2, 3, 5, 8, 13, 21)], "text_id long")
    return texts(spark, sf).join(F.broadcast(ids), "text_id", "left_semi").select("text_id", "level")


LISTED = [("BASIC", "N_LINES"), ("PRICE", "avg_disc"), ("OTHER", "sum_qty")]


@query("a13_length_list_flags", "SELECT c AS feature, CASE WHEN (upper(split_part(c, '__', 2)), lower(split_part(c, '__', 3))) IN (('BASIC', 'n_lines'), ('PRICE', 'avg_disc'), ('OTHER', 'sum_qty')) THEN 'yes' ELSE 'no' END AS is_length FROM (SELECT unnest([" + ", ".join(f"'{k}'" for k in FEATURES) + "]) AS c)")
def a13(spark, sf):
    listed = spark.createDataFrame(LISTED, "s string, f string").select(F.upper("s").alias("s"), F.lower("f").alias("f"), F.lit("yes").alias("hit")).distinct()
    f = spark.createDataFrame([(k,) for k in FEATURES], "feature string")
    f = f.withColumn("s", F.upper(S.column_part(F.col("feature"), 1))).withColumn("f", F.lower(S.column_part(F.col("feature"), 2)))
    return f.join(F.broadcast(listed), ["s", "f"], "left").select("feature", F.coalesce("hit", F.lit("no")).alias("is_length"))


@query("a14_upsert_latest_wins", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def a14(spark, sf):
    return relational.latest(table(spark, sf, "events"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("a16_metadata_checks", f"WITH {TEXTS} SELECT count(*) AS n, count(DISTINCT text_id) AS ids, count(*) FILTER (WHERE level IS NULL) AS bad FROM texts")
def a16(spark, sf):
    return texts(spark, sf).agg(F.count("*").alias("n"), F.countDistinct("text_id").alias("ids"), F.count_if(F.col("level").isNull()).alias("bad"))


@query("b01_parquet_zstd_round_trip", f"WITH {FRAME} SELECT level, count(*) AS n, sum(complexity__basic__sum_qty) AS qty FROM frame GROUP BY level", d="qty", n="level")
def b01(spark, sf):
    path = _scratch(spark) + "/frame"
    writers.write_parquet(frame(spark, sf), path)
    return spark.read.parquet(path).groupBy("level").agg(F.count("*").alias("n"), F.sum("complexity__basic__sum_qty").alias("qty"))


@query("b12_ordered_preview", f"WITH {FRAME} SELECT text_id, cefr_level, complexity__basic__n_lines AS n_lines FROM frame ORDER BY text_id LIMIT 100", d="n_lines")
def b12(spark, sf):
    return frame(spark, sf).select("text_id", "cefr_level", F.col("complexity__basic__n_lines").alias("n_lines")).orderBy("text_id").limit(100)


CASES = ["12.5", " 7 ", "nan", "inf", "-inf", "abc", "", "1e3", ".5", "-3.0", "15", "3.7", "16", "0", "1_000"]
ARRAY = "[" + ", ".join(f"'{c}'" for c in CASES) + "]"
RAW = f"raw AS (SELECT o_orderkey AS id, {ARRAY}[CAST(o_orderkey % {len(CASES)} AS INTEGER) + 1] AS v FROM orders)"
NUMBER = r"regexp_full_match(v, '\s*[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?\s*')"


def raw(spark, sf) -> DataFrame:
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.element_at(F.array(*map(F.lit, CASES)), (F.col("o_orderkey") % len(CASES) + 1).cast("int")).alias("v"))


@query("c01_safe_number", f"WITH {RAW} SELECT id, v, CASE WHEN {NUMBER} THEN TRY_CAST(trim(v) AS DOUBLE) END AS x FROM raw", d="x")
def c01(spark, sf):
    return raw(spark, sf).select("id", "v", S.safe_number(F.col("v")).alias("x"))


@query("c02_integral_level", f"WITH {RAW}, num AS (SELECT id, CASE WHEN {NUMBER} THEN TRY_CAST(trim(v) AS DOUBLE) END AS x FROM raw) SELECT id, CASE WHEN x BETWEEN 1 AND 15 AND x = floor(x) THEN CAST(x AS BIGINT) END AS level FROM num")
def c02(spark, sf):
    return raw(spark, sf).select("id", S.level(F.col("v")).alias("level"))


NAMED = TEXTS + r""", named AS (SELECT *, CASE WHEN text_id % 3 = 0 THEN 'data\texts\' ELSE 'data/' END || CAST(text_id AS VARCHAR) || '_cefr_' || CASE WHEN text_id % 5 = 0 THEN lower(cefr_level) ELSE cefr_level END
  || '_level_' || CAST(CASE WHEN text_id % 7 = 0 THEN level + 1 ELSE level END AS VARCHAR) || CASE WHEN text_id % 11 = 0 THEN '.txt' ELSE '_grade_' || CAST(topic AS VARCHAR) || '.txt' END AS filename FROM texts),
parsed AS (SELECT *, nullif(regexp_extract(base, '(?i)^([^_]+)_cefr_', 1), '') AS f_id, upper(nullif(regexp_extract(base, '(?i)_cefr_([a-c][12])(_|\.|$)', 1), '')) AS f_cefr,
  TRY_CAST(nullif(regexp_extract(base, '(?i)_level_([0-9]+)(_|\.|$)', 1), '') AS BIGINT) AS f_raw FROM (SELECT *, regexp_extract(replace(filename, '\', '/'), '([^/]*)$', 1) AS base FROM named)),
labels AS (SELECT *, CASE WHEN f_raw BETWEEN 1 AND 15 THEN f_raw END AS f_level FROM parsed)"""


def named(spark, sf) -> DataFrame:
    t = texts(spark, sf)
    i = F.col("text_id")
    band = F.when(i % 5 == 0, F.lower("cefr_level")).otherwise(F.col("cefr_level"))
    step = F.when(i % 7 == 0, F.col("level") + 1).otherwise(F.col("level"))
    tail = F.when(i % 11 == 0, ".txt").otherwise(F.concat(F.lit("_grade_"), F.col("topic").cast("string"), F.lit(".txt")))
    name = F.concat(F.when(i % 3 == 0, "data\\texts\\").otherwise("data/"), i.cast("string"), F.lit("_cefr_"), band, F.lit("_level_"), step.cast("string"), tail)
    t = t.withColumn("filename", name)
    return t.select("*", S.id_of_name(name).alias("f_id"), S.band_of_name(name).alias("f_cefr"), S.level_of_name(name).alias("f_level"))


@query("c03_labels_from_file_names", f"WITH {NAMED} SELECT text_id, filename, f_id, f_cefr, f_level FROM labels", n="f_level")
def c03(spark, sf):
    return named(spark, sf).select("text_id", "filename", "f_id", "f_cefr", "f_level")


@query("c04_label_precedence", f"WITH {NAMED} SELECT text_id, coalesce(CASE WHEN text_id % 4 > 0 THEN level END, f_level) AS column_first, coalesce(f_level, CASE WHEN text_id % 4 > 0 THEN level END) AS name_first FROM labels", n="column_first name_first")
def c04(spark, sf):
    own = F.when(F.col("text_id") % 4 > 0, F.col("level"))
    return named(spark, sf).select("text_id", F.coalesce(own, "f_level").alias("column_first"), F.coalesce("f_level", own).alias("name_first"))


@query("c05_label_contradictions", f"WITH {NAMED} SELECT text_id, f_level FROM labels WHERE coalesce(level <> f_level OR cefr_level <> f_cefr OR CAST(text_id AS VARCHAR) <> f_id, false)", n="f_level")
def c05(spark, sf):
    differs = (F.col("level") != F.col("f_level")) | (F.col("cefr_level") != F.col("f_cefr")) | (F.col("text_id").cast("string") != F.col("f_id"))
    return named(spark, sf).where(F.coalesce(differs, F.lit(False))).select("text_id", "f_level")


@query("c06_integer_ids", f"WITH {RAW} SELECT id, CASE WHEN regexp_full_match(trim(v), '[0-9]+([.]0+)?') THEN CAST(regexp_extract(trim(v), '^([0-9]+)', 1) AS BIGINT) END AS k FROM raw")
def c06(spark, sf):
    return raw(spark, sf).select("id", S.integer_id(F.col("v")).alias("k"))


@query("c07_range_and_membership", f"WITH {TEXTS} SELECT text_id, level FROM texts WHERE level BETWEEN 4 AND 9 AND cefr_level IN ('A2', 'B1') AND topic IN (1, 3)", n="level")
def c07(spark, sf):
    return texts(spark, sf).where(F.col("level").between(4, 9) & F.col("cefr_level").isin("A2", "B1") & F.col("topic").isin(1, 3)).select("text_id", "level")


@query("c08_is_distinct_from", f"WITH {FRAME} SELECT text_id FROM frame WHERE complexity__basic__n_lines IS DISTINCT FROM accuracy__edits__open_errors")
def c08(spark, sf):
    return frame(spark, sf).where(~F.col("complexity__basic__n_lines").eqNullSafe(F.col("accuracy__edits__open_errors"))).select("text_id")


@query("c09_filtered_aggregates", f"WITH {FRAME} SELECT cefr_level, count(*) FILTER (WHERE complexity__basic__n_lines IS NULL) AS missing, count_if(level % 2 = 0) AS even, sum(complexity__basic__sum_qty) FILTER (WHERE topic = 1) AS qty FROM frame GROUP BY cefr_level", d="qty", n="missing even")
def c09(spark, sf):
    return frame(spark, sf).groupBy("cefr_level").agg(F.count_if(F.col("complexity__basic__n_lines").isNull()).alias("missing"), F.count_if(F.col("level") % 2 == 0).alias("even"), F.sum(F.when(F.col("topic") == 1, F.col("complexity__basic__sum_qty"))).alias("qty"))


@query("c10_all_but_a_column", f"WITH {TEXTS} SELECT * EXCLUDE (topic) FROM texts", n="level")
def c10(spark, sf):
    return texts(spark, sf).drop("topic")


@query("c11_guarded_shares", f"WITH {FRAME} SELECT text_id, CASE WHEN a = 0 AND b = 0 THEN 0.0 WHEN b > 0 AND a >= 0 AND a <= b THEN CAST(a AS DOUBLE) / b END AS share FROM (SELECT text_id, accuracy__edits__total_errors - 1 AS a, accuracy__edits__open_errors AS b FROM frame)", d="share")
def c11(spark, sf):
    return frame(spark, sf).select("text_id", S.guarded_share(F.col("accuracy__edits__total_errors") - 1, F.col("accuracy__edits__open_errors")).alias("share"))


@query("c12_rates_per_hundred", f"WITH {FRAME} SELECT text_id, CASE WHEN b <> 0 THEN 100.0 * CAST(a AS DOUBLE) / b ELSE 0.0 END AS rate FROM (SELECT text_id, accuracy__edits__total_errors AS a, accuracy__edits__open_errors AS b FROM frame)", d="rate")
def c12(spark, sf):
    return frame(spark, sf).select("text_id", S.per_hundred(F.col("accuracy__edits__total_errors"), F.col("accuracy__edits__open_errors")).alias("rate"))


@query("c13_schema_driven_features", f"SELECT column_name AS \"column\", CASE WHEN regexp_matches(column_name, '__n_|errors$|sum_') THEN 'count' ELSE 'mean' END AS measure_type FROM (DESCRIBE WITH {FRAME} SELECT * FROM frame) WHERE len(column_name) - len(replace(column_name, '__', '')) = 4")
def c13(spark, sf):
    names = [c for c in frame(spark, sf).columns if c.count("__") == 2]
    kind = F.when(F.col("column").rlike("__n_|errors$|sum_"), "count").otherwise("mean")
    return spark.createDataFrame([(c,) for c in names], "column string").withColumn("measure_type", kind)


@query("c14_wide_to_long", f"WITH {LONG} SELECT text_id, feature, value FROM long", d="value")
def c14(spark, sf):
    return long_frame(spark, sf).select("text_id", "feature", "value")


R = "(CAST((o_orderkey * 37) % 201 AS DOUBLE) - 100) / 100"


@query("c15_strength_and_direction", f"SELECT o_orderkey, CASE WHEN r > 0 THEN 'positive' WHEN r < 0 THEN 'negative' ELSE 'none' END AS direction, CASE WHEN abs(r) < 0.2 THEN 'very weak' WHEN abs(r) < 0.4 THEN 'weak' WHEN abs(r) < 0.6 THEN 'moderate' WHEN abs(r) < 0.8 THEN 'strong' ELSE 'very strong' END AS strength FROM (SELECT o_orderkey, {R} AS r FROM orders)")
def c15(spark, sf):
    r = ((F.col("o_orderkey") * 37) % 201).cast("double")
    r = (r - 100) / 100
    return table(spark, sf, "orders").select("o_orderkey", S.direction(r).alias("direction"), S.strength(r).alias("strength"))


@query("c16_selection_labels", f"WITH {TEXTS} SELECT text_id, CASE WHEN topic < 4 AND level < 8 THEN 'Both' WHEN topic < 4 THEN 'MI only' WHEN level < 8 THEN 'IG only' ELSE 'Neither' END AS selected FROM texts")
def c16(spark, sf):
    return texts(spark, sf).select("text_id", S.selection(F.col("topic") < 4, F.col("level") < 8).alias("selected"))


@query("c17_prediction_routes", f"WITH {TEXTS} SELECT text_id, CASE WHEN task = target THEN 'direct' WHEN task = 'level' AND target = 'cefr' THEN 'via level' ELSE 'not applicable' END AS route FROM (SELECT text_id, CASE WHEN topic % 2 = 0 THEN 'level' ELSE 'cefr' END AS task, CASE WHEN level % 2 = 0 THEN 'level' ELSE 'cefr' END AS target FROM texts)")
def c17(spark, sf):
    task = F.when(F.col("topic") % 2 == 0, "level").otherwise("cefr")
    return texts(spark, sf).select("text_id", S.route(task, F.when(F.col("level") % 2 == 0, "level").otherwise("cefr")).alias("route"))


@query("c18_word_count_bins", f"WITH {FRAME} SELECT CASE WHEN w IS NULL THEN NULL WHEN w < 50 THEN '0-49' WHEN w < 100 THEN '50-99' WHEN w < 150 THEN '100-149' WHEN w < 200 THEN '150-199' ELSE '200+' END AS bin, count(*) AS n FROM (SELECT complexity__basic__sum_qty AS w FROM frame) GROUP BY 1")
def c18(spark, sf):
    return describe.histogram(frame(spark, sf), S.word_bin(F.col("complexity__basic__sum_qty")), "bin")


@query("c19_clip_and_round_half_even", f"WITH {PREDICTED} SELECT text_id, predicted_level_continuous, predicted_level, predicted_cefr FROM predicted", d="predicted_level_continuous", n="predicted_level")
def c19(spark, sf):
    return predictions(spark, sf).select("text_id", "predicted_level_continuous", "predicted_level", "predicted_cefr")


@query("c20_usable_features", f"WITH {LONG} SELECT feature, count(value) AS n FROM long GROUP BY feature HAVING count(value) >= 20 AND min(value) <> max(value)")
def c20(spark, sf):
    return describe.usable_features(long_frame(spark, sf))


@query("c21_exclusion_reasons", f"WITH {FRAME} SELECT CASE WHEN level % 5 = 0 THEN 'bad level' WHEN w IS NULL THEN 'bad word count' WHEN w - 20 <= 0 THEN 'no words' ELSE '' END AS reason, count(*) AS n FROM (SELECT level, complexity__basic__sum_qty AS w FROM frame) GROUP BY 1")
def c21(spark, sf):
    return describe.tally(frame(spark, sf), F.when(F.col("level") % 5 != 0, F.col("level")), F.col("complexity__basic__sum_qty") - 20)


@query("c22_valid_rates", f"WITH {FRAME} SELECT text_id, rate * words AS uses FROM (SELECT text_id, complexity__price__avg_disc AS rate, complexity__basic__sum_qty AS words FROM frame) WHERE rate >= 0 AND words > 0", d="uses")
def c22(spark, sf):
    uses = S.finite(F.col("complexity__price__avg_disc") * F.col("complexity__basic__sum_qty"))
    return frame(spark, sf).where((F.col("complexity__price__avg_disc") >= 0) & (F.col("complexity__basic__sum_qty") > 0)).select("text_id", uses.alias("uses")).where("uses is not null")


@query("c23_feature_tokens", "SELECT DISTINCT p_type, regexp_replace(regexp_replace(lower('% ' || p_type || '/ ' || p_brand || '!'), '[^a-z0-9]+', '_', 'g'), '^_|_$', '', 'g') AS token FROM part")
def c23(spark, sf):
    return table(spark, sf, "part").select("p_type", S.feature_token(F.concat(F.lit("% "), "p_type", F.lit("/ "), "p_brand", F.lit("!"))).alias("token")).distinct()


#: Forms of error types beside those of the edits: three parts, small letters, unknown operations, missing parts.
TYPE_FORMS = ["R:VERB:TENSE", "m:noun", "X:NOUN", "M", "U:", "", "other", "u:Punct:x"]


@query("c24_error_families", f"WITH {EDITS}, t AS (SELECT error_type FROM edits UNION ALL SELECT unnest({TYPE_FORMS})) SELECT error_type, CASE upper(split_part(error_type, ':', 1)) WHEN 'M' THEN 'missing' WHEN 'U' THEN 'unnecessary' WHEN 'R' THEN 'replacement' ELSE 'other' END AS operation, coalesce(nullif(upper(split_part(error_type, ':', 2)), ''), 'OTHER') AS family, count(*) AS n FROM t GROUP BY ALL")
def c24(spark, sf):
    more = spark.createDataFrame([(x,) for x in TYPE_FORMS], "error_type string")
    t = edits(spark, sf).select("error_type").unionByName(more).groupBy("error_type").agg(F.count("*").alias("n"))
    return t.select("error_type", S.operation(F.col("error_type")).alias("operation"), S.family(F.col("error_type")).alias("family"), "n")


@query("c25_tool_dimensions", f"WITH {LONG} SELECT CASE split_part(feature, '__', 2) WHEN 'basic' THEN 'length' WHEN 'price' THEN 'lexis' ELSE 'accuracy' END AS dimension, count(value) AS n FROM long GROUP BY 1")
def c25(spark, sf):
    tool = S.column_part(F.col("feature"), 1)
    return long_frame(spark, sf).groupBy(F.when(tool == "basic", "length").when(tool == "price", "lexis").otherwise("accuracy").alias("dimension")).agg(F.count("value").alias("n"))


@query("c26_column_names_parsed", "SELECT c AS feature, split_part(c, '__', 1) AS grp, split_part(c, '__', 2) AS source, split_part(c, '__', 3) AS name FROM (SELECT unnest([" + ", ".join(f"'{k}'" for k in FEATURES) + "]) AS c)")
def c26(spark, sf):
    f = F.col("feature")
    return spark.createDataFrame([(k,) for k in FEATURES], "feature string").select("feature", S.column_part(f, 0).alias("grp"), S.column_part(f, 1).alias("source"), S.column_part(f, 2).alias("name"))


@query("d01_wide_join", f"WITH {FRAME} SELECT * EXCLUDE (topic) FROM frame WHERE complexity__basic__n_lines IS NOT NULL", d=" ".join(FEATURES), n="level")
def d01(spark, sf):
    tools = [measurements(spark, sf, s) for s in ("basic", "price", "edits")]
    return relational.wide([texts(spark, sf).drop("topic"), *tools])


@query("d02_join_count_validation", f"WITH {TEXTS}, m AS (SELECT DISTINCT l_orderkey AS text_id FROM lineitem) SELECT (SELECT count(*) FROM texts ANTI JOIN m USING (text_id)) AS only_left, (SELECT count(*) FROM m ANTI JOIN texts USING (text_id)) AS only_right, CAST(0 AS BIGINT) AS different, (SELECT count(*) FROM texts JOIN m USING (text_id)) AS equal")
def d02(spark, sf):
    return relational.agreement(texts(spark, sf), measurements(spark, sf, "basic"), "text_id", ["text_id"])


@query("d03_full_outer_reconciliation", f"WITH {NAMED}, n AS (SELECT text_id, f_level AS level FROM labels WHERE text_id % 13 > 0) SELECT coalesce(t.text_id, n.text_id) AS text_id FROM (SELECT * FROM texts WHERE text_id % 17 > 0) t FULL JOIN n USING (text_id) WHERE t.text_id IS NULL OR n.text_id IS NULL OR t.level IS DISTINCT FROM n.level")
def d03(spark, sf):
    t = texts(spark, sf).where("text_id % 17 > 0").select(F.col("text_id").alias("a"), "level")
    n = named(spark, sf).where("text_id % 13 > 0").select(F.col("text_id").alias("b"), F.col("f_level").alias("other"))
    return t.join(n, F.col("a") == F.col("b"), "full_outer").where(F.col("a").isNull() | F.col("b").isNull() | ~F.col("level").eqNullSafe(F.col("other"))).select(F.coalesce("a", "b").alias("text_id"))


@query("d04_fact_metadata_join", "SELECT o_orderkey, c_mktsegment, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def d04(spark, sf):
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    return table(spark, sf, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("o_orderkey", "c_mktsegment", "n_name")


SAMPLE = "picked AS (SELECT text_id FROM texts ORDER BY md5(CAST(text_id AS VARCHAR)), text_id LIMIT 300)"


@query("d05_sample_semi_join", f"WITH {FRAME}, {SAMPLE} SELECT text_id, complexity__basic__n_lines AS n_lines FROM frame SEMI JOIN picked USING (text_id)", d="n_lines")
def d05(spark, sf):
    picked = resample.hash_sample(texts(spark, sf).select("text_id"), 300, "text_id")
    return frame(spark, sf).join(picked, "text_id", "left_semi").select("text_id", F.col("complexity__basic__n_lines").alias("n_lines"))


@query("d06_samples_of_sources_joined", f"WITH {FRAME}, {SAMPLE} SELECT text_id, complexity__basic__sum_qty AS qty, complexity__price__avg_disc AS disc FROM frame JOIN picked USING (text_id) WHERE complexity__basic__sum_qty IS NOT NULL", d="qty disc")
def d06(spark, sf):
    picked = resample.hash_sample(texts(spark, sf).select("text_id"), 300, "text_id")
    return relational.wide([picked, measurements(spark, sf, "basic"), measurements(spark, sf, "price")]).select("text_id", F.col("complexity__basic__sum_qty").alias("qty"), F.col("complexity__price__avg_disc").alias("disc"))


@query("d07_edits_with_texts", f"WITH {TEXTS}, {EDITS} SELECT text_id, cefr_level, error_type, start, stop FROM edits JOIN texts USING (text_id)")
def d07(spark, sf):
    return edits(spark, sf).join(texts(spark, sf), "text_id").select("text_id", "cefr_level", "error_type", "start", "stop")


TYPES = ["M:F", "M:O", "R:F", "R:O", "U:F", "U:O"]


@query("d08_wide_pivot_of_types", f"WITH {TEXTS}, {EDITS} SELECT text_id, " + ", ".join(f"count(error_type) FILTER (WHERE error_type = '{t}') AS \"{t}\"" for t in TYPES) + " FROM texts LEFT JOIN edits USING (text_id) GROUP BY text_id")
def d08(spark, sf):
    return relational.pivot_counts(edits(spark, sf), texts(spark, sf), TYPES)


@query("d09_validated_left_join", f"WITH {NAMED} SELECT t.text_id, l.f_level, l.cefr_level = t.cefr_level AS agrees FROM texts t LEFT JOIN (SELECT * FROM labels WHERE text_id % 2 = 0) l USING (text_id)", n="f_level")
def d09(spark, sf):
    right = relational.unique(named(spark, sf).where("text_id % 2 = 0").select("text_id", "f_level", F.col("cefr_level").alias("other")), "text_id")
    return texts(spark, sf).join(right, "text_id", "left").select("text_id", "f_level", (F.col("other") == F.col("cefr_level")).alias("agrees"))


@query("d10_full_outer_indicator", f"WITH {TEXTS} SELECT coalesce(a.text_id, b.text_id) AS text_id, CASE WHEN b.text_id IS NULL THEN 'left only' WHEN a.text_id IS NULL THEN 'right only' ELSE 'both' END AS state FROM (SELECT text_id FROM texts WHERE text_id % 3 > 0) a FULL JOIN (SELECT text_id FROM texts WHERE text_id % 5 > 0) b USING (text_id)")
def d10(spark, sf):
    t = texts(spark, sf)
    return relational.pairing(t.where("text_id % 3 > 0"), t.where("text_id % 5 > 0"), "text_id")


@query("d11_many_to_one_enrichment", f"WITH {TEXTS}, m AS (SELECT level, count(*) AS size FROM texts GROUP BY level) SELECT text_id, size FROM texts LEFT JOIN m USING (level)")
def d11(spark, sf):
    t = texts(spark, sf)
    return t.join(F.broadcast(t.groupBy("level").agg(F.count("*").alias("size"))), "level", "left").select("text_id", "size")


@query("d12_pairing_by_set", "WITH a AS (SELECT doc_id FROM documents WHERE lang = 'en'), b AS (SELECT doc_id FROM labels) SELECT doc_id, 'both' AS state FROM a SEMI JOIN b USING (doc_id) UNION ALL SELECT doc_id, 'left only' FROM a ANTI JOIN b USING (doc_id) UNION ALL SELECT doc_id, 'right only' FROM b ANTI JOIN a USING (doc_id)")
def d12(spark, sf):
    a, b = table(spark, sf, "documents").where("lang = 'en'").select("doc_id"), table(spark, sf, "labels").select("doc_id")
    one = lambda x, y, how, state: x.join(y, "doc_id", how).select("doc_id", F.lit(state).alias("state"))
    return one(a, b, "left_semi", "both").unionByName(one(a, b, "left_anti", "left only")).unionByName(one(b, a, "left_anti", "right only"))


@query("d13_resume_anti_join", f"WITH {TEXTS}, f AS (SELECT l_orderkey AS text_id FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1 HAVING count(*) >= 3) SELECT text_id FROM texts WHERE text_id % 4 <> 0 AND text_id NOT IN (SELECT text_id FROM f)")
def d13(spark, sf):
    t = texts(spark, sf).select("text_id")
    failed = table(spark, sf, "lineitem").where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("text_id"))
    return relational.pending(t, t.where("text_id % 4 = 0"), failed, "text_id")


@query("d14_wanted_ids", f"WITH {FRAME} SELECT text_id, complexity__basic__sum_qty AS qty FROM frame WHERE topic = 2 ORDER BY text_id", d="qty")
def d14(spark, sf):
    wanted = texts(spark, sf).where("topic = 2").select("text_id")
    return frame(spark, sf).join(wanted, "text_id", "left_semi").select("text_id", F.col("complexity__basic__sum_qty").alias("qty")).orderBy("text_id")


@query("d15_triangular_pairs", "WITH f AS (SELECT unnest([" + ", ".join(f"'{k}'" for k in FEATURES) + "]) AS c) SELECT a.c AS a, b.c AS b FROM f a JOIN f b ON a.c < b.c")
def d15(spark, sf):
    f = spark.createDataFrame([(k,) for k in FEATURES], "c string")
    return f.alias("a").join(F.broadcast(f.alias("b")), F.col("a.c") < F.col("b.c")).select(F.col("a.c").alias("a"), F.col("b.c").alias("b"))


@query("d16_layered_lookup", "WITH f AS (SELECT unnest([" + ", ".join(f"'{k}'" for k in FEATURES) + "]) AS feature) SELECT feature, split_part(feature, '__', 2) AS source, CASE WHEN feature = 'complexity__price__avg_disc' THEN 'exact' WHEN split_part(feature, '__', 2) = 'price' THEN 'general' ELSE 'unknown' END AS label FROM f")
def d16(spark, sf):
    f = spark.createDataFrame([(k, k.split("__")[1]) for k in FEATURES], "feature string, source string")
    return relational.context(f, spark.createDataFrame([("complexity__price__avg_disc", "exact")], "feature string, exact_label string"), spark.createDataFrame([("price", "general")], "source string, general_label string"), "unknown")


@query("d17_group_denominators", f"WITH {TEXTS}, g AS (SELECT cefr_level, level, count(*) AS n FROM texts GROUP BY GROUPING SETS ((), (cefr_level), (cefr_level, level))) SELECT t.cefr_level, t.level, t.topic, t.k, g.n FROM (SELECT cefr_level, level, topic, count(*) AS k FROM texts GROUP BY GROUPING SETS ((topic), (cefr_level, topic), (cefr_level, level, topic))) t JOIN g ON t.cefr_level IS NOT DISTINCT FROM g.cefr_level AND t.level IS NOT DISTINCT FROM g.level", n="level")
def d17(spark, sf):
    t = texts(spark, sf)
    c, v, p = F.col("cefr_level"), F.col("level"), F.col("topic")
    part = t.groupingSets([[p], [c, p], [c, v, p]], c, v, p).agg(F.count("*").alias("k"))
    whole = t.groupingSets([[], [c], [c, v]], c, v).agg(F.count("*").alias("n")).select(c.alias("_c"), v.alias("_v"), "n")
    return part.join(F.broadcast(whole), c.eqNullSafe(F.col("_c")) & v.eqNullSafe(F.col("_v"))).select("cefr_level", "level", "topic", "k", "n")


@query("g01_hash_sample", f"WITH {TEXTS} SELECT text_id, level FROM texts ORDER BY md5(CAST(text_id AS VARCHAR)), text_id LIMIT 500", n="level")
def g01(spark, sf):
    return resample.hash_sample(texts(spark, sf).select("text_id", "level"), 500, "text_id")


@query("g05_stratified_sample", f"WITH {PREDICTED} SELECT text_id, split, level FROM (SELECT *, row_number() OVER (PARTITION BY split, level ORDER BY md5('42:' || CAST(text_id AS VARCHAR)), text_id) AS k FROM predicted) WHERE k <= 5", n="level")
def g05(spark, sf):
    return resample.stratified_sample(predictions(spark, sf).select("text_id", "split", "level"), 5, ["split", "level"])


@query("h01_union_by_name", "SELECT n_name AS name, CAST(NULL AS VARCHAR) AS segment FROM nation UNION ALL SELECT c_name, c_mktsegment FROM customer")
def h01(spark, sf):
    return table(spark, sf, "nation").select(F.col("n_name").alias("name")).unionByName(table(spark, sf, "customer").select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")), allowMissingColumns=True)


@query("h02_intersect_and_difference", "SELECT doc_id, 'in both' AS state FROM (SELECT doc_id FROM documents WHERE lang = 'fr' INTERSECT SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'only here' FROM (SELECT doc_id FROM documents WHERE lang = 'fr' EXCEPT SELECT doc_id FROM labels)")
def h02(spark, sf):
    a, b = table(spark, sf, "documents").where("lang = 'fr'").select("doc_id"), table(spark, sf, "labels").select("doc_id")
    return a.intersect(b).withColumn("state", F.lit("in both")).unionByName(a.subtract(b).withColumn("state", F.lit("only here")))


@query("h03_distinct", f"WITH {EDITS} SELECT DISTINCT error_type FROM edits")
def h03(spark, sf):
    return edits(spark, sf).select("error_type").distinct()


#: Operations whose shares among a text's errors are the composition features.
SHARES = ["accuracy__edits__share_missing", "accuracy__edits__share_unnecessary", "accuracy__edits__share_replacement", "accuracy__edits__share_other"]
FLAGS = f"""{LONG}, score AS (SELECT feature, abs(corr(value, level)) AS s FROM long WHERE value IS NOT NULL GROUP BY 1), top AS (SELECT feature, row_number() OVER (ORDER BY s DESC, feature) AS best, row_number() OVER (ORDER BY s, feature) AS worst FROM score),
flags AS (SELECT feature, split_part(feature, '__', 1) AS kind, ends_with(feature, 'n_lines') AS direct, ends_with(feature, 'sum_qty') OR ends_with(feature, 'total_errors') AS correlated, ends_with(feature, 'open_errors') AS duplicate, contains(feature, '__price__') AS one_source, best <= 2 AS mi, worst <= 2 AS ig FROM top
  UNION ALL SELECT unnest({SHARES}), 'composition', false, false, false, false, false, false)"""


def feature_flags(spark, sf):
    long = long_frame(spark, sf).where("value is not null")
    score = long.groupBy("feature").agg(F.abs(F.corr("value", F.col("level").cast("double"))).alias("s"))
    w = Window.partitionBy(F.lit(0))  # a row for each feature
    top = score.select("feature", F.row_number().over(w.orderBy(F.col("s").desc(), "feature")).alias("best"), F.row_number().over(w.orderBy("s", "feature")).alias("worst"))
    f = F.col("feature")
    flags = top.select(f, S.column_part(f, 0).alias("kind"), f.endswith("n_lines").alias("direct"), (f.endswith("sum_qty") | f.endswith("total_errors")).alias("correlated"), f.endswith("open_errors").alias("duplicate"), f.contains("__price__").alias("one_source"), (F.col("best") <= 2).alias("mi"), (F.col("worst") <= 2).alias("ig"))
    no = [F.lit(False).alias(c) for c in ("direct", "correlated", "duplicate", "one_source", "mi", "ig")]
    return flags.unionByName(spark.createDataFrame([(x,) for x in SHARES], "feature string").select("feature", F.lit("composition").alias("kind"), *no))


@query("h04_feature_set_algebra", f"WITH {FLAGS} " + " UNION ALL ".join(f"SELECT '{name}' AS name, feature FROM flags WHERE {rule}" for name, rule in relational.FEATURE_SETS.items()))
def h04(spark, sf):
    return relational.feature_sets(feature_flags(spark, sf))
