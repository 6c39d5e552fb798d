"""Queries of workbooks, text files, reports, manifests and stored scores, each through a file and back."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import scalars as S
from textloom.operators import additive, context, correlate, describe, experiments, information, metrics
from textloom.plans.registry import query
from textloom.plans.relational import _scratch
from textloom.plans.statistics import CORR, E03, FOLDS, GROUPED, QTY, SCORES, USAGE, _named_progression, contributions, error_statistics, fold_scores, terms, usage
from textloom.sources import files, parts, readers, reports, writers
from textloom.sources.adapters import BANDS5, EDITS, FEATURES, FRAME, LONG, PREDICTED, TEXTS, edits, frame, long_frame, predictions, table, texts


@query("a01_workbook", "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation")
def a01(spark, sf):
    path = _scratch(spark) + "/nation.xlsx"
    writers.write_xlsx(table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey"), path)
    return readers.read_xlsx(spark, path, ["n_nationkey", "n_name", "n_regionkey"])


@query("a02_workbook_needed_columns", "SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, CAST(s_nationkey AS VARCHAR) AS s_nationkey FROM supplier")
def a02(spark, sf):
    path = _scratch(spark) + "/supplier.xlsx"
    writers.write_xlsx(table(spark, sf, "supplier").select(F.lit("unused").alias("note"), "s_nationkey", F.col("s_suppkey").alias("S_SUPPKEY ")), path)
    return readers.read_xlsx(spark, path, ["s_suppkey", "s_nationkey"])


@query("a05_gzip_fallback", "SELECT r_name FROM region")
def a05(spark, sf):
    path = _scratch(spark) + "/region.csv"
    writers.write_csv(table(spark, sf, "region").select("r_name"), path + ".gz", "gzip")
    return readers.read_csv(spark, readers.with_fallback(path))


@query("a11_b11_text_files_by_name", "SELECT c_custkey || '_cefr_' || ['A1','A2','B1','B2','C1'][CAST(c_custkey % 15 // 3 + 1 AS INTEGER)] || '_level_' || (c_custkey % 15 + 1) AS filename, ['A1','A2','B1','B2','C1'][CAST(c_custkey % 15 // 3 + 1 AS INTEGER)] AS cefr_level, c_custkey % 15 + 1 AS level, c_name AS text FROM customer", n="level")
def a11(spark, sf):
    """A text for each customer, its labels in the file's name and read back from it."""
    path, level = _scratch(spark) + "/texts", F.col("c_custkey") % 15
    band = F.element_at(F.array(*map(F.lit, BANDS5)), (F.floor(level / 3) + 1).cast("int"))
    name = F.concat(F.col("c_custkey").cast("string"), F.lit("_cefr_"), band, F.lit("_level_"), (level + 1).cast("string"))
    writers.write_texts(table(spark, sf, "customer").select(name.alias("name"), "c_name"), path, "name", "c_name")
    n = F.col("filename")
    return readers.read_texts(spark, path).select("filename", S.band_of_name(n).alias("cefr_level"), S.level_of_name(n).alias("level"), "text")


@query("b11_texts_through_files", "SELECT CAST(item_id AS VARCHAR) AS filename, coalesce(text, '') AS text FROM benchmark")
def b11(spark, sf):
    path = _scratch(spark) + "/items"
    writers.write_texts(table(spark, sf, "benchmark"), path, "item_id", "text")
    return readers.read_texts(spark, path)


@query("a12_decoding_with_fallback", "SELECT doc_id, replace(text, chr(0), ' ') AS text FROM documents")
def a12(spark, sf):
    """Texts as UTF-8 with a mark, as UTF-16 with one, and in one byte a character where they can be; nulls stay null."""
    d = table(spark, sf, "documents")
    latin = ~F.col("text").rlike("[\\x80-\\x9F]") & (F.col("doc_id") % 3 == 2) & F.col("text").rlike("\\A[\\x00-\\xFF]*\\z") & F.col("text").rlike("[\\xC0-\\xFF][ -~]")
    raw = F.when(latin, F.encode("text", "ISO-8859-1")).when(F.col("doc_id") % 3 == 1, F.encode("text", "UTF-16")).otherwise(F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", "UTF-8")))
    return d.select("doc_id", readers.decoded(raw).alias("text"))


@query("a15_json_through_a_file", "SELECT r_name, count(*) AS nations FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
def a15(spark, sf):
    path = _scratch(spark) + "/nations.json"
    counts = table(spark, sf, "region").join(table(spark, sf, "nation"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.count("*").alias("n"))
    writers.write_json({r["r_name"]: r["n"] for r in writers.small(counts)}, path)
    return spark.createDataFrame(sorted(readers.read_json(path).items()), "r_name string, nations long")


@query("b02_report_csv_with_mark", f"WITH {TEXTS} SELECT cefr_level, CAST(count(*) AS VARCHAR) AS n FROM texts GROUP BY 1")
def b02(spark, sf):
    path = _scratch(spark) + "/report.csv"
    writers.write_report_csv(texts(spark, sf).groupBy("cefr_level").agg(F.count("*").alias("n")), path)
    assert files.get(path)[:3] == b"\xef\xbb\xbf"
    return readers.read_csv(spark, path)


@query("b03_csv_in_chunks", "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1")
def b03(spark, sf):
    path = _scratch(spark) + "/lines"
    writers.write_csv_chunks(table(spark, sf, "lineitem").select("l_orderkey", "l_returnflag"), path)
    return readers.read_csv(spark, path).groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query("b05_xml_counts", f"WITH {TEXTS} SELECT level, count(*) AS n FROM texts GROUP BY 1", n="level")
def b05(spark, sf):
    path = _scratch(spark) + "/counts.xml"
    writers.write_counts_xml(texts(spark, sf).groupBy("cefr_level", "level").agg(F.count("*").alias("n")), path)
    return spark.read.format("xml").option("rowTag", "level").schema("_name long, _count long").load(path).select(F.col("_name").alias("level"), F.col("_count").alias("n"))


@query("b06_p18_ranking_workbook", f"WITH {CORR} SELECT feature, CAST(row_number() OVER (ORDER BY abs(spearman) DESC, feature) AS VARCHAR) AS rank, true AS intact FROM cor")
def b06(spark, sf):
    path = _scratch(spark) + "/ranking.xlsx"
    c = correlate.correlations(long_frame(spark, sf)).select("feature", F.abs("spearman").alias("score"), S.column_part(F.col("feature"), 1).alias("source"))
    ranks = context.relabel(c, spark.createDataFrame([], "source string, feature string")).select("feature", "rank")
    digest = writers.write_xlsx(ranks, path)
    kept = readers.read_xlsx(spark, path, ["sha256"], sheet=2).collect() or [[r for r in readers.xlsx_rows(_book(path), 2)][0][1]]
    return readers.read_xlsx(spark, path, ["feature", "rank"]).withColumn("intact", F.lit(digest in str(kept)))


def _book(path: str):
    import io

    return io.BytesIO(files.get(path))


@query("b07_markdown_table", f"WITH {TEXTS}, t AS (SELECT cefr_level, count(*) AS n, avg(level) AS mean FROM texts GROUP BY 1) SELECT '| ' || cefr_level || ' | ' || n || ' | ' || printf('%.3f', mean) || ' |' AS line FROM t UNION ALL SELECT * FROM (VALUES ('| cefr_level | n | mean |'), ('| --- | --- | --- |'))")
def b07(spark, sf):
    t = texts(spark, sf).groupBy("cefr_level").agg(F.count("*").alias("n"), F.avg("level").alias("mean")).orderBy("cefr_level")
    return spark.createDataFrame([(x,) for x in writers.markdown(t).strip().split("\n")], "line string")


@query("b07_latex_table", f"WITH {TEXTS}, t AS (SELECT cefr_level, count(*) AS n, avg(level) AS mean FROM texts GROUP BY 1) SELECT cefr_level || ' & ' || n || ' & ' || printf('%.3f', mean) || ' \\\\' AS line FROM t")
def b07b(spark, sf):
    t = texts(spark, sf).groupBy("cefr_level").agg(F.count("*").alias("n"), F.avg("level").alias("mean")).orderBy("cefr_level")
    body = writers.latex(t).split("\\midrule\n")[1].split("\n\\bottomrule")[0]
    return spark.createDataFrame([(x,) for x in body.split("\n")], "line string")


@query("b08_error_summary", f"""WITH {E03[5:E03.index("SELECT CASE GROUPING")]}, stat AS (SELECT {E03[E03.index("SELECT CASE GROUPING") + 7:]}),
line AS (SELECT group_type, cefr_level, printf('%d texts, %.0f errors, %.4f per 100 words, %.2f%% without', texts, errors, pooled_rate, error_free_percent) AS x FROM stat)
SELECT 'All: ' || x AS line FROM line WHERE group_type = 'overall' UNION ALL SELECT cefr_level || ': ' || x FROM line WHERE group_type = 'cefr'""")
def b08(spark, sf):
    path = _scratch(spark) + "/errors.txt"
    reports.write_lines(reports.error_summary(error_statistics(spark, sf), describe.error_types(edits(spark, sf), texts(spark, sf))), path)
    lines = spark.read.text(path).select(F.regexp_replace("value", "(?<=\\d),(?=\\d)", "").alias("line"))
    return lines.where(F.col("line").contains(" without"))


@query("b08_correlation_summary", f"""WITH {CORR}, s AS (SELECT CASE WHEN spearman IS NULL THEN 'not calculable' WHEN abs(spearman) < 0.2 THEN 'very weak' WHEN abs(spearman) < 0.4 THEN 'weak' WHEN abs(spearman) < 0.6 THEN 'moderate' WHEN abs(spearman) < 0.8 THEN 'strong' ELSE 'very strong' END AS k FROM cor)
SELECT k || ': ' || count(s.k) AS line FROM (VALUES ('very strong'), ('strong'), ('moderate'), ('weak'), ('very weak'), ('not calculable')) AS v(k) LEFT JOIN s USING (k) GROUP BY k""")
def b08b(spark, sf):
    tests = correlate.correlations(long_frame(spark, sf)).withColumn("strength", S.strength(F.col("spearman")))
    tests = correlate.benjamini_hochberg(tests.withColumn("p", correlate.p_value(F.col("spearman"), F.col("n"))))
    lines = reports.correlation_summary(tests)
    at = lines.index("STRENGTH (SPEARMAN)")
    return spark.createDataFrame([(x,) for x in lines[at + 2 : at + 8]], "line string")


@query("b08_feature_summary")
def b08c(spark, sf):
    long = long_frame(spark, sf)
    return spark.createDataFrame(list(enumerate(reports.feature_summary(describe.feature_statistics(long), describe.feature_statistics(long, "cefr_level", "level")))), "place int, line string")


@query("b08_progression_summary_p08_settings", f"WITH {USAGE}, {_named_progression(70, 's')} SELECT status, count(*) AS n, 70.0::DOUBLE AS threshold, 100 AS texts FROM s GROUP BY 1", n="texts")
def b08d(spark, sf):
    """The summary is written with its settings beside it, which are read back and used again."""
    path = _scratch(spark) + "/progressions.txt"
    u, settings = usage(spark, sf), context.check_settings({})
    every = None
    for x in (70.0, *settings["comparison_thresholds"]):
        one = describe.progression(u, x).withColumn("threshold", F.lit(x))
        every = one if every is None else every.unionByName(one)
    trends, note = context.error_trends(None)
    reports.write_lines(reports.progression_summary(every, settings, trends, note), path)
    context.put_settings(settings, f"{path}.settings.json")
    again = context.settings_of(f"{path}.settings.json")
    own = describe.progression(u, again["common_usage_percent"], again["min_later_levels"])
    return own.groupBy("status").agg(F.count("*").alias("n")).withColumns({"threshold": F.lit(again["common_usage_percent"]), "texts": F.lit(again["min_texts_per_level"])})


@query("b10_model_bundle", f"WITH {SCORES} SELECT text_id, 7.5 + sum(score) AS score FROM part GROUP BY 1", d="score")
def b10(spark, sf):
    """A model's terms are written, read back and score every text."""
    path = _scratch(spark) + "/model"
    writers.write_parquet(terms(spark), path)
    return additive.predict(frame(spark, sf), list(FEATURES), spark.read.parquet(path)).select("text_id", "score")


@query("j08_j10_complete_runs_and_seals", "SELECT * FROM (VALUES ('complete', true), ('other settings', false), ('unknown run', false), ('sealed', true), ('changed', false), ('sealed twice', false)) AS t(state, ok)")
def j08(spark, sf):
    base, run = _scratch(spark), {"scores": fold_scores(spark, sf)}
    experiments.record(base + "/run.json", {"rounds": 200, "folds": [1, 2]}, 1.5)
    experiments.seal(run, base + "/seal.json")

    def holds(work) -> bool:
        try:
            work()
        except (ValueError, FileExistsError):
            return False
        return True

    rows = [
        ("complete", experiments.complete(base + "/run.json", {"folds": [1, 2], "rounds": 200})), ("other settings", experiments.complete(base + "/run.json", {"rounds": 30})), ("unknown run", experiments.complete(base + "/none.json", {})),
        ("sealed", holds(lambda: experiments.check_seal(run, base + "/seal.json"))), ("changed", holds(lambda: experiments.check_seal({"scores": run["scores"].limit(3)}, base + "/seal.json"))), ("sealed twice", holds(lambda: experiments.seal(run, base + "/seal.json"))),
    ]
    return spark.createDataFrame(rows, "state string, ok boolean")


@query("p04_relabelled_scores", f"WITH {CORR}, r AS (SELECT feature, split_part(feature, '__', 2) AS source, abs(spearman) AS score, feature LIKE '%sum_qty' AS is_length FROM cor) SELECT feature, source, is_length, row_number() OVER (ORDER BY score DESC, source, feature) AS rank, CASE WHEN NOT is_length THEN row_number() OVER (PARTITION BY is_length ORDER BY score DESC, source, feature) END AS rank_without_length FROM r")
def p04(spark, sf):
    """Scores are stored with flags that no longer hold; flags and ranks are made anew from what is stored (P5 reads it)."""
    path = _scratch(spark) + "/scores"
    c = correlate.correlations(long_frame(spark, sf)).select("feature", S.column_part(F.col("feature"), 1).alias("source"), F.abs("spearman").alias("score"), F.lit(True).alias("is_length"), F.lit(1).alias("rank"))
    writers.write_parquet(c, path)
    stored = readers.read_scores(spark, path, {"feature": "string", "source": "string", "score": "double", "rank": "int"})
    listed = spark.createDataFrame([("Basic", QTY.upper())], "source string, feature string")
    return context.relabel(stored, listed).select("feature", "source", "is_length", "rank", "rank_without_length")


@query("p05_stored_scores_of_some_sources", f"WITH {CORR} SELECT feature, abs(spearman) AS score FROM cor WHERE split_part(feature, '__', 2) IN ('basic', 'edits')", d="score")
def p05(spark, sf):
    path = _scratch(spark) + "/scores"
    c = correlate.correlations(long_frame(spark, sf)).select("feature", S.column_part(F.col("feature"), 1).alias("source"), F.abs("spearman").cast("string").alias("score"))
    writers.write_parquet(c, path)
    return readers.read_scores(spark, path, {"feature": "string", "score": "double"}, ["basic", "edits"]).select("feature", "score")


@query("p08_annotated_scores", f"WITH {USAGE}, {_named_progression(70, 'pr')}, {CORR.replace(LONG + ', ', '', 1)} SELECT cor.feature, CASE WHEN cor.feature LIKE '%price%' THEN 'a price' ELSE '' END AS description, first_common, sustained_from, coalesce(status, '') AS status FROM cor LEFT JOIN pr USING (feature)", n="first_common sustained_from")
def p08(spark, sf):
    scores = correlate.correlations(long_frame(spark, sf)).select("feature", "spearman")
    told = spark.createDataFrame([(f, "a price") for f in FEATURES if "price" in f], "feature string, description string")
    return context.annotated(scores, told, describe.progression(usage(spark, sf), 70.0)).drop("spearman")


@query("p10_error_trends", f"""WITH {E03[5:E03.index("SELECT CASE GROUPING")]} SELECT level, count(*) AS texts, CASE WHEN sum(words) <> 0 THEN 100.0 * sum(errors) / sum(words) ELSE 0 END AS rate FROM r GROUP BY level""", d="rate", n="level")
def p10(spark, sf):
    rows = frame(spark, sf).where(F.col(QTY).isNotNull()).groupBy("level").agg(F.count("*").alias("TEXTS "), S.per_hundred(F.sum("accuracy__edits__total_errors"), F.sum(QTY)).alias("pooled_rate"))
    trends, why = context.error_trends(rows.withColumn("group_type", F.lit("Level")))
    if trends is None:
        raise ValueError(why)
    return trends


@query("p14_deviations_beside_metrics", f"WITH {FOLDS} SELECT model, avg(value) AS value, stddev_samp(value) AS value_standard_deviation, count(*) AS folds FROM scores GROUP BY 1", d="value value_standard_deviation")
def p14(spark, sf):
    wide = fold_scores(spark, sf).groupBy("model").agg(F.stddev_samp("value").alias("value_standard_deviation"), F.avg("value").alias("value"), F.count("*").alias("folds"))
    out = writers.with_deviations(wide, ["value"])
    assert out.columns == ["model", "value", "value_standard_deviation", "folds"]
    return out


@query("p15_contributions_by_output", f"WITH {GROUPED} SELECT output, source AS feature_name, mean_absolute AS contribution FROM grp", d="contribution")
def p15(spark, sf):
    path = _scratch(spark) + "/outputs"
    writers.write_by_output(metrics.contributions(contributions(spark, sf), "source").withColumnRenamed("source", "feature"), path)
    return spark.read.schema("feature_name string, contribution double, output string").parquet(path).select("output", "feature_name", "contribution")


@query("p20_manifest_of_tables", "SELECT * FROM (SELECT 'nation' AS name, count(*) AS n, true AS intact FROM nation UNION ALL SELECT 'region', count(*), true FROM region UNION ALL SELECT 'supplier', count(*), false FROM supplier)")
def p20(spark, sf):
    path = _scratch(spark) + "/manifest.json"
    every = {t: table(spark, sf, t) for t in ("nation", "region", "supplier")}
    writers.write_manifest(every, path)
    later = {t: df.repartition(3) if t != "supplier" else df.where("s_suppkey > 1") for t, df in every.items()}
    changed = writers.verify_manifest(later, path)
    return spark.createDataFrame([(t, df.count(), t not in changed) for t, df in every.items()], "name string, n long, intact boolean")


@query("p27_predictions_in_order", f"WITH {PREDICTED} SELECT text_id, cefr_level, predicted_cefr, row_number() OVER (ORDER BY text_id) AS place FROM predicted")
def p27(spark, sf):
    path = _scratch(spark) + "/predictions"
    predictions(spark, sf).select("text_id", "cefr_level", "predicted_cefr").repartition(5).write.parquet(path)
    # numbered by the ids themselves: a row's number in a sorted frame depends on how each of its uses is cut to ranges
    rows = readers.read_predictions(spark, path).withColumns({"one": F.lit(1), "g": F.lit(0)})
    ordered = information.running(rows, ["g"], "text_id", ["one"])
    return ordered.select("text_id", "cefr_level", "predicted_cefr", F.col("one_upto").alias("place"))


@query("l04_torn_part_files", "SELECT doc_id, lang FROM documents WHERE doc_id % 3 = 0 OR doc_id % 3 = 1 AND lang IS NOT NULL")
def l04_parts(spark, sf):
    """Part files are written, one more ends within its last row, and what is whole is merged to a table that is replaced."""
    folder = _scratch(spark)
    d = table(spark, sf, "documents").select("doc_id", "lang")
    d.where("doc_id % 3 = 1").write.option("header", True).csv(f"{folder}/parts")
    cut = d.where("doc_id % 3 = 2").agg(F.coalesce(F.max("doc_id"), F.lit(2))).first()[0]
    files.put(f"{folder}/parts/part-torn.csv", f"doc_id,lang\n{cut},e".encode())
    parts.replace_table(d.where("doc_id % 3 = 0"), f"{folder}/merged")
    found = parts.read_parts(spark, f"{folder}/parts/*.csv", "doc_id long, lang string", "doc_id,lang")
    parts.replace_table(parts.salvaged(parts.current_table(spark, f"{folder}/merged"), found, "doc_id", ["lang"]), f"{folder}/merged")
    return parts.current_table(spark, f"{folder}/merged")
