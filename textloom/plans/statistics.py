"""Queries of statistics, correlations, rankings, metrics, splits, models and text measures."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions import scalars as S
from textloom.operators import additive, bootstrap, correlate, describe, foldranks, information, metrics, relational, resample, textmeasures
from textloom.plans.registry import query
from textloom.sources.adapters import BANDS5, EDITS, FEATURES, FRAME, LONG, PREDICTED, TEXTS, edits, frame, long_frame, predictions, table, texts

LEVELS = list(range(1, 16))
QTY, ERRORS, OPEN = "complexity__basic__sum_qty", "accuracy__edits__total_errors", "accuracy__edits__open_errors"


def words(spark, sf):
    return frame(spark, sf).select("text_id", F.col(QTY).alias("words"))


@query("e01_feature_statistics", f"WITH {LONG} SELECT feature, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS sd, min(value) AS low, max(value) AS high FROM long GROUP BY feature HAVING count(value) > 0", d="mean sd low high")
def e01(spark, sf):
    return describe.feature_statistics(long_frame(spark, sf))


@query("e02_feature_statistics_by_level", f"WITH {LONG} SELECT feature, cefr_level, level, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS sd, min(value) AS low, max(value) AS high FROM long WHERE level BETWEEN 1 AND 15 GROUP BY feature, cefr_level, level HAVING count(value) > 0", d="mean sd low high", n="level")
def e02(spark, sf):
    return describe.feature_statistics(long_frame(spark, sf).where("level between 1 and 15"), "cefr_level", "level")


def error_statistics(spark, sf):
    """Error statistics of all texts, each band and each (band, level)."""
    rows = frame(spark, sf).select("cefr_level", "level", F.col(ERRORS).alias("errors"), F.col(QTY).alias("words"), F.col(OPEN).alias("open")).where("words is not null")
    return describe.error_statistics(rows, "errors", "words", "open")


E03 = f"""WITH {FRAME}, r AS (SELECT cefr_level, level, {ERRORS} AS errors, {QTY} AS words, {OPEN} AS eq FROM frame WHERE {QTY} IS NOT NULL)
SELECT CASE GROUPING(cefr_level) * 2 + GROUPING(level) WHEN 3 THEN 'overall' WHEN 1 THEN 'cefr' ELSE 'cefr_level' END AS group_type, cefr_level, level, count(*) AS texts, sum(errors) AS errors,
  CASE WHEN sum(words) <> 0 THEN 100.0 * sum(errors) / sum(words) ELSE 0 END AS pooled_rate, avg(CASE WHEN words <> 0 THEN 100.0 * errors / words ELSE 0 END) AS mean_rate,
  100.0 * count(*) FILTER (WHERE errors = 0) / count(*) AS error_free_percent, greatest(0, 1 - CASE WHEN sum(words) <> 0 THEN sum(eq) / sum(words) ELSE 0 END) AS accuracy
FROM r GROUP BY GROUPING SETS ((), (cefr_level), (cefr_level, level))"""


@query("e03_e04_error_statistics_grouping_sets", E03, d="errors pooled_rate mean_rate error_free_percent accuracy", n="level")
def e03(spark, sf):
    return error_statistics(spark, sf)


E05 = f"""WITH {TEXTS}, {EDITS}, e AS (SELECT cefr_level, error_type, count(*) AS edits, count(DISTINCT text_id) AS texts_with FROM edits JOIN texts USING (text_id) GROUP BY ALL),
t AS (SELECT cefr_level, count(*) AS texts FROM texts GROUP BY 1), r AS (SELECT *, 100.0 * CAST(texts_with AS DOUBLE) / texts AS text_percent FROM e JOIN t USING (cefr_level))
SELECT cefr_level, error_type, edits, texts_with, texts, text_percent, CAST(edits AS DOUBLE) / sum(edits) OVER (PARTITION BY cefr_level) AS edit_share,
  row_number() OVER (PARTITION BY cefr_level ORDER BY edits DESC, error_type) AS count_rank, row_number() OVER (PARTITION BY cefr_level ORDER BY text_percent DESC, error_type) AS percent_rank FROM r"""


@query("e05_f03_error_types_with_ranks", E05, d="text_percent edit_share")
def e05(spark, sf):
    return describe.error_types(edits(spark, sf), texts(spark, sf))


@query("e05_reconstructed_counts", f"WITH {FRAME} SELECT level, CAST(round_even(CAST(sum(rate * w) / 100 AS DOUBLE), 0) AS BIGINT) AS errors FROM (SELECT level, {QTY} AS w, CASE WHEN {QTY} <> 0 THEN 100.0 * {ERRORS} / {QTY} ELSE 0 END AS rate FROM frame WHERE {QTY} IS NOT NULL) GROUP BY level", n="level")
def e05b(spark, sf):
    rows = frame(spark, sf).where(F.col(QTY).isNotNull()).select("level", F.col(QTY).alias("w"), S.per_hundred(F.col(ERRORS), F.col(QTY)).alias("rate"))
    return rows.groupBy("level").agg(F.rint(F.sum(F.col("rate") * F.col("w")) / 100).cast("long").alias("errors"))


@query("e06_reconciliation", f"WITH {FRAME}, {EDITS} SELECT count(*) FILTER (WHERE a.n IS DISTINCT FROM b.n) AS mismatches, count(*) AS texts FROM (SELECT text_id, CAST({ERRORS} AS BIGINT) AS n FROM frame WHERE {ERRORS} IS NOT NULL) a FULL JOIN (SELECT text_id, count(*) FILTER (WHERE error_type LIKE 'R:%') AS n FROM edits GROUP BY 1) b USING (text_id)")
def e06(spark, sf):
    a = frame(spark, sf).where(F.col(ERRORS).isNotNull()).select(F.col("text_id").alias("a"), F.col(ERRORS).cast("long").alias("x"))
    b = edits(spark, sf).groupBy(F.col("text_id").alias("b")).agg(F.count_if(F.col("error_type").startswith("R:")).alias("y"))
    return a.join(b, F.col("a") == F.col("b"), "full_outer").agg(F.count_if(~F.col("x").eqNullSafe(F.col("y"))).alias("mismatches"), F.count("*").alias("texts"))


@query("e07_f02_patterns_with_shares", f"WITH {TEXTS}, {EDITS}, p AS (SELECT cefr_level, level, error_type, stop - start AS width, count(*) AS n, count(DISTINCT text_id) AS texts FROM edits JOIN texts USING (text_id) GROUP BY ALL) SELECT *, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY cefr_level, level, error_type) AS share FROM p", d="share", n="level width")
def e07(spark, sf):
    rows = edits(spark, sf).withColumn("width", F.col("stop") - F.col("start"))
    return describe.patterns(rows, texts(spark, sf), ["error_type", "width"], ["cefr_level", "level"], ["cefr_level", "level", "error_type"])


@query("e08_counts_with_subtotals", f"WITH {TEXTS} SELECT cefr_level, level, count(*) AS n, GROUPING(cefr_level) * 2 + GROUPING(level) AS subtotal FROM texts GROUP BY ROLLUP (cefr_level, level)", n="level subtotal")
def e08(spark, sf):
    return describe.counts_with_subtotals(texts(spark, sf))


@query("e09_error_taxonomy", f"WITH {EDITS} SELECT error_type, count(*) AS n, sum(stop - start) AS tokens FROM edits GROUP BY 1", n="tokens")
def e09(spark, sf):
    return edits(spark, sf).groupBy("error_type").agg(F.count("*").alias("n"), F.sum(F.col("stop") - F.col("start")).alias("tokens"))


@query("e10_corpus_summary", f"WITH {FRAME} SELECT count(*) AS texts, coalesce(sum({ERRORS}), 0) AS errors, coalesce(sum(CASE WHEN level > 9 THEN {ERRORS} END), 0) AS high, coalesce(avg({QTY}), 0) AS words FROM frame", d="errors high words")
def e10(spark, sf):
    zero = F.lit(0.0)
    return frame(spark, sf).agg(F.count("*").alias("texts"), F.coalesce(F.sum(ERRORS), zero).alias("errors"), F.coalesce(F.sum(F.when(F.col("level") > 9, F.col(ERRORS))), zero).alias("high"), F.coalesce(F.avg(QTY), zero).alias("words"))


COVERED = """spans AS (SELECT text_id, start, stop, max(stop) OVER (PARTITION BY text_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM edits WHERE stop > start),
cover AS (SELECT text_id, sum(greatest(0, stop - greatest(start, coalesce(before, start)))) AS covered FROM spans GROUP BY 1)"""


@query("e11_text_rollup_of_edits", f"WITH {EDITS}, {COVERED}, r AS (SELECT text_id, count(*) AS edits, count(*) FILTER (WHERE error_type LIKE 'M%') AS missing, count(*) FILTER (WHERE error_type LIKE 'U%') AS unnecessary, count(*) FILTER (WHERE error_type LIKE 'R%') AS replacement, CAST(0 AS BIGINT) AS other, count(DISTINCT error_type) AS types, sum(greatest(stop - start, 1)) AS changed FROM edits GROUP BY 1) SELECT r.*, covered FROM r JOIN cover USING (text_id)", n="changed covered")
def e11(spark, sf):
    return describe.text_rollup(edits(spark, sf))


@query("e12_covered_tokens", f"WITH {EDITS}, {COVERED} SELECT * FROM cover", n="covered")
def e12(spark, sf):
    return describe.covered_by_windows(edits(spark, sf))


CORR = f"""{LONG}, ranked AS (SELECT feature, value, level, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0::DOUBLE AS rv,
  rank() OVER (PARTITION BY feature ORDER BY level) + (count(*) OVER (PARTITION BY feature, level) - 1) / 2.0::DOUBLE AS rl FROM long WHERE value IS NOT NULL),
cor AS (SELECT feature, count(*) AS n, CASE WHEN stddev_pop(value) > 0 AND stddev_pop(level) > 0 THEN corr(value, level) END AS pearson, CASE WHEN stddev_pop(value) > 0 AND stddev_pop(level) > 0 THEN corr(rv, rl) END AS spearman FROM ranked GROUP BY feature)"""


@query("e13_e14_f01_correlations", f"WITH {CORR} SELECT * FROM cor", d="pearson spearman")
def e13(spark, sf):
    return correlate.correlations(long_frame(spark, sf))


@query("e15_correlation_labels", f"WITH {CORR} SELECT feature, abs(spearman) AS size, CASE WHEN spearman > 0 THEN 'positive' WHEN spearman < 0 THEN 'negative' ELSE 'none' END AS direction, CASE WHEN abs(spearman) < 0.2 THEN 'very weak' WHEN abs(spearman) < 0.4 THEN 'weak' WHEN abs(spearman) < 0.6 THEN 'moderate' WHEN abs(spearman) < 0.8 THEN 'strong' ELSE 'very strong' END AS strength FROM cor", d="size")
def e15(spark, sf):
    r = F.col("spearman")
    return correlate.correlations(long_frame(spark, sf)).select("feature", F.abs(r).alias("size"), S.direction(r).alias("direction"), S.strength(r).alias("strength"))


@query("e16_fisher_z", f"WITH {CORR} SELECT feature, CASE WHEN n >= 4 AND abs(pearson) < 1 THEN atanh(abs(pearson)) * sqrt(n - 3) END AS z FROM cor", d="z")
def e16(spark, sf):
    return correlate.correlations(long_frame(spark, sf)).select("feature", S.fisher_z(F.col("pearson"), F.col("n")).alias("z"))


@query("e16_fisher_p_and_f08_q")
def e16p(spark, sf):
    tests = correlate.correlations(long_frame(spark, sf)).withColumn("p", correlate.p_value(F.col("pearson"), F.col("n")))
    return correlate.benjamini_hochberg(tests)


@query("f08_benjamini_hochberg", "WITH t AS (SELECT p_partkey, CASE WHEN p_partkey % 10 > 0 THEN CAST((p_partkey * 7919) % 1009 AS DOUBLE) / 1009 END AS p FROM part), r AS (SELECT *, rank() OVER (ORDER BY p) + count(*) OVER (PARTITION BY p) - 1 AS k, count(*) OVER () AS m FROM t WHERE p IS NOT NULL) SELECT p_partkey, p, least(1.0, min(p * CAST(m AS DOUBLE) / k) OVER (ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS q FROM r UNION ALL SELECT p_partkey, p, NULL FROM t WHERE p IS NULL", d="p q")
def f08(spark, sf):
    p = ((F.col("p_partkey") * 7919) % 1009).cast("double") / F.lit(1009.0)
    return correlate.benjamini_hochberg(table(spark, sf, "part").select("p_partkey", F.when(F.col("p_partkey") % 10 > 0, p).alias("p")))


PAIRS = f"{LONG}, pairs AS (SELECT a.feature AS a, b.feature AS b, count(*) AS n, CASE WHEN stddev_pop(a.value) > 0 AND stddev_pop(b.value) > 0 THEN corr(a.value, b.value) END AS r FROM long a JOIN long b ON a.text_id = b.text_id AND a.feature < b.feature WHERE a.value IS NOT NULL AND b.value IS NOT NULL GROUP BY 1, 2)"


@query("e17_pair_correlations", f"WITH {PAIRS} SELECT * FROM pairs", d="r")
def e17(spark, sf):
    return correlate.pair_correlations(long_frame(spark, sf))


USAGE = f"""{LONG}, w AS (SELECT text_id, {QTY} AS words FROM frame), cell AS (SELECT feature, level, count(*) AS texts, count(*) FILTER (WHERE value >= 0 AND words > 0) AS valid, count(*) FILTER (WHERE value > 0 AND words > 0) AS using_,
  sum(value) FILTER (WHERE value >= 0 AND words > 0) AS s, sum(words) FILTER (WHERE value >= 0 AND words > 0) AS sw FROM long JOIN w USING (text_id) WHERE level <> 14 GROUP BY 1, 2),
spine AS (SELECT DISTINCT feature, unnest(generate_series(1, 15)) AS level FROM long), u AS (SELECT feature, level, coalesce(texts, 0) AS texts, coalesce(valid, 0) AS valid, coalesce(using_, 0) AS using_,
  CASE WHEN valid > 0 THEN 100.0 * using_ / valid END AS prevalence, CASE WHEN sw > 0 THEN s / sw END AS pooled_rate FROM spine LEFT JOIN cell USING (feature, level)),
usage AS (SELECT *, CASE WHEN texts = 0 THEN 'no_texts' WHEN texts < 100 THEN 'too_few' WHEN CAST(valid AS DOUBLE) / texts < 0.95 THEN 'too_many_missing' ELSE 'sufficient' END AS evidence FROM u)"""


def usage(spark, sf):
    return describe.usage(long_frame(spark, sf).where("level <> 14"), words(spark, sf))


@query("e18_e19_usage_by_level", f'WITH {USAGE} SELECT feature, level, texts, valid, using_ AS "using", prevalence, pooled_rate, evidence FROM usage', d="prevalence pooled_rate", n="level")
def e18(spark, sf):
    return usage(spark, sf)


def _progression(cut: float) -> str:
    return f"""p AS (SELECT feature, level, prevalence, evidence, coalesce(prevalence >= {cut}, false) AS common FROM usage),
q AS (SELECT *, bool_and(common) OVER (PARTITION BY feature ORDER BY level ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS rest, count(*) OVER (PARTITION BY feature ORDER BY level ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later, min(CASE WHEN common THEN level END) OVER (PARTITION BY feature) AS fc FROM p),
g AS (SELECT feature, min(level) FILTER (WHERE prevalence > 0) AS first_observed, min(fc) AS first_common, min(level) FILTER (WHERE common AND rest AND later >= 2) AS sustained_from, count(*) FILTER (WHERE level > fc AND NOT common) AS drops, count(*) FILTER (WHERE evidence <> 'sufficient') AS insufficient FROM q GROUP BY 1)
SELECT *, CASE WHEN first_observed IS NULL THEN 'never observed' WHEN sustained_from IS NOT NULL THEN 'sustained' WHEN first_common IS NOT NULL THEN 'common, not sustained' ELSE 'observed, not common' END AS status FROM g"""


def _named_progression(cut: float, name: str) -> str:
    body, last = _progression(cut).rsplit("\nSELECT", 1)
    return f"{body}, {name} AS (SELECT{last})"


@query("f13_progression_70", f"WITH {USAGE}, {_progression(70)}", n="first_observed first_common sustained_from drops insufficient")
def f13(spark, sf):
    return describe.progression(usage(spark, sf), 70.0)


@query("f13_progression_three_thresholds", " UNION ALL ".join(f"SELECT * FROM (WITH {USAGE}, {_progression(c)})" for c in (2, 5, 10)), n="first_observed first_common sustained_from drops insufficient")
def f13b(spark, sf):
    u = usage(spark, sf)
    a, b, c = (describe.progression(u, x) for x in (2.0, 5.0, 10.0))
    return a.unionByName(b).unionByName(c)


@query("e20_target_entropy", f"WITH {TEXTS}, c AS (SELECT level, count(*)::DOUBLE AS c FROM texts GROUP BY 1) SELECT ln(sum(c)) - sum(c * ln(c)) / sum(c) AS entropy FROM c", d="entropy")
def e20(spark, sf):
    return information.entropy(texts(spark, sf), "level")


@query("e21_nearest_neighbour_information")
def e21(spark, sf):
    return information.neighbour_information(long_frame(spark, sf))


def _gain(target: str) -> str:
    return f"""{LONG}, base AS (SELECT feature, value, CAST({target} AS DOUBLE) AS y FROM long WHERE value IS NOT NULL), cell AS (SELECT feature, value, y, count(*) AS c FROM base GROUP BY ALL),
grid AS (SELECT v.feature, v.value, k.y, coalesce(c, 0) AS c FROM (SELECT DISTINCT feature, value FROM cell) v JOIN (SELECT DISTINCT feature, y FROM cell) k USING (feature) LEFT JOIN cell ON cell.feature = v.feature AND cell.value = v.value AND cell.y = k.y),
cum AS (SELECT *, sum(c) OVER (PARTITION BY feature, y ORDER BY value)::DOUBLE AS l, sum(c) OVER (PARTITION BY feature, y)::DOUBLE AS t FROM grid),
side AS (SELECT feature, value, sum(l) AS nl, sum(t) AS n, sum(t - l) AS nr, sum(CASE WHEN l > 0 THEN l * log2(l) ELSE 0 END) AS xl, sum(CASE WHEN t > 0 THEN t * log2(t) ELSE 0 END) AS xt, sum(CASE WHEN t - l > 0 THEN (t - l) * log2(t - l) ELSE 0 END) AS xr, sum(l * y) AS sl, sum((t - l) * y) AS sr FROM cum GROUP BY 1, 2),
g AS (SELECT *, lead(value) OVER (PARTITION BY feature ORDER BY value) AS nxt, log2(n) - xt / n AS h, CASE WHEN nl > 0 THEN log2(nl) - xl / nl ELSE 0 END AS hl, CASE WHEN nr > 0 THEN log2(nr) - xr / nr ELSE 0 END AS hr FROM side),
ok AS (SELECT *, greatest(0, round(h - nl / n * hl - nr / n * hr, 12)) AS gain, (value + nxt) / 2 AS threshold FROM g WHERE nxt IS NOT NULL AND nl >= greatest(2, ceil(0.005 * n)) AND nr >= greatest(2, ceil(0.005 * n))),
best AS (SELECT * FROM ok WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY feature ORDER BY gain DESC, threshold) = 1),
ig AS (SELECT a.feature, a.n, coalesce(gain, 0) AS gain, coalesce(CASE WHEN h > 0 THEN gain / h END, 0) AS normalised, threshold, sl / nl AS low_mean, sr / nr AS high_mean FROM (SELECT feature, count(*) AS n FROM base GROUP BY 1) a LEFT JOIN best USING (feature))"""


def rounded(spark, sf):
    """The long frame with values rounded to six decimals: averages of equal sums differ in their last digits by the order of
    rows, true differences are over 1e-4."""
    return long_frame(spark, sf).withColumn("value", F.round("value", 6))


def _six(sql: str) -> str:
    """sql over values rounded to six decimals."""
    return sql.replace(LONG, LONG + ", six AS (SELECT * REPLACE (round(value, 6) AS value) FROM long)", 1).replace("FROM long WHERE value IS NOT NULL", "FROM six WHERE value IS NOT NULL").replace("FROM long LEFT JOIN edges", "FROM six LEFT JOIN edges").replace("SELECT long.*", "SELECT six.*")


@query("e22_f14_information_gain", f"WITH {_six(_gain('level'))} SELECT * FROM ig", d="gain normalised threshold low_mean high_mean")
def e22(spark, sf):
    return information.information_gain(rounded(spark, sf))


def _bins(count: int = 20) -> str:
    cuts = ", ".join(f"{k / count}" for k in range(count + 1))
    return f"""{LONG}, edges AS (SELECT feature, list_distinct(quantile_cont(value, [{cuts}])) AS e FROM long WHERE value IS NOT NULL GROUP BY 1),
binned AS (SELECT long.*, CASE WHEN value IS NULL THEN 0 ELSE len(list_filter(list_sort(e)[2:len(e) - 1], lambda x: x <= value)) + 1 END AS bin FROM long LEFT JOIN edges USING (feature)),
cell AS (SELECT feature, bin, level, count(*)::DOUBLE AS c FROM binned GROUP BY ALL),
part AS (SELECT feature, c, sum(c) OVER (PARTITION BY feature) AS n, sum(c) OVER (PARTITION BY feature, bin) AS x, sum(c) OVER (PARTITION BY feature, level) AS y FROM cell),
mi AS (SELECT feature, greatest(0, sum(c / n * ln(c * n / (x * y)))) AS mi FROM part GROUP BY 1)"""


@query("e23_binned_mutual_information", f"WITH {_six(_bins())} SELECT feature, mi FROM mi", d="mi")
def e23(spark, sf):
    return information.binned_information(rounded(spark, sf))


BAND_OF = "list_position([" + ",".join(repr(b) for b in BANDS5) + "], cefr_level)"


@query("e24_training_gain_for_bands", f"WITH {_six(_gain(BAND_OF))} SELECT feature, gain FROM ig", d="gain")
def e24(spark, sf):
    rows = rounded(spark, sf).withColumn("band", S.band_index(F.col("cefr_level")))
    return information.information_gain(rows, "band").select("feature", "gain")


RANKS = f"""{_six(_bins())}, {_six(_gain('level')).replace(_six(LONG) + ', ', '', 1).replace('cell AS', 'cell2 AS').replace('FROM cell)', 'FROM cell2)').replace('LEFT JOIN cell ON cell.feature = v.feature AND cell.value = v.value AND cell.y = k.y', 'LEFT JOIN cell2 ON cell2.feature = v.feature AND cell2.value = v.value AND cell2.y = k.y')},
ranked AS (SELECT feature, mi, gain AS ig, row_number() OVER (ORDER BY mi DESC, feature) AS mi_rank, row_number() OVER (ORDER BY gain DESC, feature) AS ig_rank FROM mi JOIN ig USING (feature))"""


@query("e25_g03_merged_ranking", f"WITH {RANKS} SELECT *, CASE WHEN mi_rank <= 3 AND ig_rank <= 3 THEN 'Both' WHEN mi_rank <= 3 THEN 'MI only' WHEN ig_rank <= 3 THEN 'IG only' ELSE 'Neither' END AS selected FROM ranked", d="mi ig")
def e25(spark, sf):
    long = rounded(spark, sf)
    return information.ranking(information.binned_information(long), information.information_gain(long), 3)


SIX = "six AS (SELECT * REPLACE (round(value, 6) AS value) FROM long)"
#: Ten separate rankings: each feature's rows once for each fold that they train, under a name of the fold's.
FOLD_RANKS = RANKS.replace(SIX, "six AS (SELECT long.* REPLACE (fold || '#' || feature AS feature, round(value, 6) AS value) FROM long JOIN (SELECT unnest(generate_series(0, 9)) AS fold) AS f ON learner_id % 10 <> fold)").replace("OVER (ORDER BY", "OVER (PARTITION BY split_part(feature, '#', 1) ORDER BY")


@query("j07_e22_e23_rankings_of_ten_folds", f"WITH {FOLD_RANKS} SELECT split_part(feature, '#', 1) AS fold, split_part(feature, '#', 2) AS feature, mi, ig, mi_rank, ig_rank, mi_rank <= 3 AS mi_selected, ig_rank <= 3 AS ig_selected FROM ranked", d="mi ig", n="fold mi_rank ig_rank")
def j07_folds(spark, sf):
    return foldranks.rankings(rounded(spark, sf).withColumn("fold", (F.col("learner_id") % 10).cast("int")), "level", 10, 3)


MATRIX = f"""{PREDICTED}, labels AS (SELECT unnest(generate_series(1, 15)) AS x), m AS (SELECT a.x AS i, b.x AS j, coalesce(n, 0)::DOUBLE AS n FROM labels a CROSS JOIN labels b LEFT JOIN (SELECT level, predicted_level, count(*) AS n FROM predicted GROUP BY 1, 2) c ON c.level = a.x AND c.predicted_level = b.x),
rows_ AS (SELECT i, sum(n) AS support FROM m GROUP BY 1), cols_ AS (SELECT j, sum(n) AS guess FROM m GROUP BY 1),
per AS (SELECT rows_.i AS label, support, CASE WHEN guess > 0 THEN d.n / guess ELSE 0 END AS precision, CASE WHEN support > 0 THEN d.n / support ELSE 0 END AS recall, CASE WHEN support + guess > 0 THEN 2 * d.n / (support + guess) ELSE 0 END AS f1, CASE WHEN support > 0 THEN d.n / support END AS accuracy FROM rows_ JOIN cols_ ON rows_.i = cols_.j JOIN m d ON d.i = rows_.i AND d.j = rows_.i)"""


def matrix(spark, sf, by=None):
    return metrics.confusion(predictions(spark, sf), "level", "predicted_level", LEVELS, by)


OVERALL = "SELECT sum(n) AS n, sum(n) FILTER (WHERE i = j) / sum(n) AS accuracy, sum(abs(i - j) * n) / sum(n) AS ordinal_mae, sum(n) FILTER (WHERE abs(i - j) <= 1) / sum(n) AS within_one, 1 - sum((i - j) * (i - j) * n) / sum((i - j) * (i - j) * rn * cn / tot) AS qwk, (SELECT avg(f1) FROM per) AS macro_f1 FROM (SELECT *, sum(n) OVER (PARTITION BY i) AS rn, sum(n) OVER (PARTITION BY j) AS cn, sum(n) OVER () AS tot FROM m)"


@query("e26_e27_class_metrics", f"WITH {MATRIX} {OVERALL}", d="accuracy ordinal_mae within_one qwk macro_f1", n="n")
def e26(spark, sf):
    return metrics.overall_scores(matrix(spark, sf), 15)


@query("e26_e30_per_label_metrics", f"WITH {MATRIX} SELECT label, support, precision, recall, f1, accuracy FROM per", d="precision recall f1 accuracy", n="label support")
def e30(spark, sf):
    return metrics.class_scores(matrix(spark, sf))


@query("e28_regression_metrics", f"WITH {PREDICTED} SELECT split, count(*) AS n, avg(abs(predicted_level_continuous - level)) AS mae, sqrt(avg(pow(predicted_level_continuous - level, 2))) AS rmse, 1 - sum(pow(predicted_level_continuous - level, 2)) / (var_pop(level) * count(*)) AS r2 FROM predicted GROUP BY split", d="mae rmse r2")
def e28(spark, sf):
    return metrics.regression_scores(predictions(spark, sf), "level", "predicted_level_continuous", ["split"])


PROBABILITY = [f"p{k}" for k in range(1, 16)]


def probabilities(spark, sf):
    raw = [((F.col("text_id") * (7 * k + 3)) % 23 + 1).cast("double") for k in range(1, 16)]
    total = sum(raw[1:], raw[0])
    return texts(spark, sf).select("text_id", "level", *[(r / total).alias(p) for r, p in zip(raw, PROBABILITY, strict=True)])


PROB = TEXTS + ", raw AS (SELECT text_id, level, " + ", ".join(f"((text_id * {7 * k + 3}) % 23 + 1)::DOUBLE AS r{k}" for k in range(1, 16)) + " FROM texts), prob AS (SELECT text_id, level, " + ", ".join(f"r{k} / ({' + '.join(f'r{i}' for i in range(1, 16))}) AS p{k}" for k in range(1, 16)) + " FROM raw), bands AS (SELECT *, " + ", ".join(f"p{3 * b + 1} + p{3 * b + 2} + p{3 * b + 3} AS b{b}" for b in range(5)) + " FROM prob)"


@query("e29_e43_band_probabilities", f"WITH {PROB} SELECT text_id, b0 AS \"probability_A1\", b4 AS \"probability_C1\", ['A1','A2','B1','B2','C1'][list_position([b0,b1,b2,b3,b4], greatest(b0,b1,b2,b3,b4))] AS band, " + " + ".join(f"{k} * p{k}" for k in range(1, 16)) + " AS expected_level FROM bands", d='"probability_A1" "probability_C1" expected_level')
def e29(spark, sf):
    return metrics.band_probabilities(probabilities(spark, sf), PROBABILITY, 3, BANDS5).select("text_id", "probability_A1", "probability_C1", "band", "expected_level")


@query("e31_confusion_percent", f"WITH {MATRIX} SELECT i AS actual, j AS predicted, n, CASE WHEN support > 0 THEN 100 * n / support ELSE 0 END AS percent FROM m JOIN rows_ USING (i)", d="percent", n="actual predicted n")
def e31(spark, sf):
    return metrics.confusion_percent(matrix(spark, sf)).select("actual", "predicted", "n", "percent")


@query("e32_band_accuracy_within_level", f"WITH {PREDICTED} SELECT level, count(*) AS n, avg(CASE WHEN predicted_cefr = cefr_level THEN 1.0 ELSE 0.0 END) AS accuracy FROM predicted GROUP BY level", d="accuracy", n="level")
def e32(spark, sf):
    p = predictions(spark, sf)
    return metrics.overall_scores(metrics.confusion(p, "cefr_level", "predicted_cefr", BANDS5, ["level"]), 5, ["level"]).select("level", "n", "accuracy")


@query("e33_subset_metrics", f"WITH {PREDICTED} SELECT count(*) AS n, avg(abs(predicted_level_continuous - level)) AS mae FROM predicted WHERE topic < 4 AND split = 'test'", d="mae")
def e33(spark, sf):
    return metrics.regression_scores(predictions(spark, sf).where("topic < 4 and split = 'test'"), "level", "predicted_level_continuous").select("n", "mae")


FOLDS = TEXTS + ", scores AS (SELECT cefr_level AS model, 'mean_level' AS metric, topic AS fold, avg(level) AS value FROM texts WHERE NOT (cefr_level = 'C1' AND topic = 7) GROUP BY ALL)"


def fold_scores(spark, sf):
    return texts(spark, sf).where("not (cefr_level = 'C1' and topic = 7)").groupBy(F.col("cefr_level").alias("model"), F.lit("mean_level").alias("metric"), F.col("topic").alias("fold")).agg(F.avg("level").alias("value"))


@query("e34_fold_summary", f"WITH {FOLDS} SELECT model, metric, avg(value) AS mean, stddev_samp(value) AS sd FROM scores GROUP BY 1, 2 HAVING count(DISTINCT fold) = 8", d="mean sd")
def e34(spark, sf):
    return metrics.fold_summary(fold_scores(spark, sf), ["model"], 8)


@query("e35_per_class_folds", f"WITH {PREDICTED} SELECT level, avg(acc) AS mean, stddev_samp(acc) AS sd FROM (SELECT level, topic, avg(CASE WHEN level = predicted_level THEN 1.0 ELSE 0 END) AS acc FROM predicted GROUP BY 1, 2) GROUP BY 1 HAVING count(DISTINCT topic) = 8", d="mean sd", n="level")
def e35(spark, sf):
    per = metrics.class_scores(matrix(spark, sf, ["topic"]), ["topic"]).where("support > 0").select(F.col("label").alias("level"), F.lit("recall").alias("metric"), F.col("topic").alias("fold"), F.col("recall").alias("value"))
    return metrics.fold_summary(per, ["level"], 8).drop("metric")


CONTRIBUTION = LONG + ", contrib AS (SELECT text_id, feature, split_part(feature, '__', 2) AS source, CASE WHEN text_id % 2 = 0 THEN 'even' ELSE 'odd' END AS output, value - 20 AS score FROM long WHERE value IS NOT NULL)"


def contributions(spark, sf):
    return long_frame(spark, sf).where("value is not null").select("text_id", "feature", S.column_part(F.col("feature"), 1).alias("source"), F.when(F.col("text_id") % 2 == 0, "even").otherwise("odd").alias("output"), (F.col("value") - 20).alias("score"))


GROUPED = CONTRIBUTION + ", grp AS (SELECT source, output, avg(abs(s)) AS mean_absolute FROM (SELECT text_id, source, output, sum(score) AS s FROM contrib GROUP BY ALL) GROUP BY ALL)"


@query("e38_group_contributions", f"WITH {GROUPED} SELECT * FROM grp", d="mean_absolute")
def e38(spark, sf):
    return metrics.contributions(contributions(spark, sf), "source")


@query("e38_feature_contributions", f"WITH {CONTRIBUTION} SELECT feature, output, avg(abs(score)) AS mean_absolute FROM contrib GROUP BY ALL", d="mean_absolute")
def e38b(spark, sf):
    return metrics.contributions(contributions(spark, sf))


@query("e36_e37_f11_contribution_shares", f"WITH {GROUPED}, every AS (SELECT * FROM grp UNION ALL SELECT source, 'overall', avg(mean_absolute) FROM grp GROUP BY 1) SELECT source, output, mean_absolute, mean_absolute / sum(mean_absolute) OVER (PARTITION BY output) AS share, row_number() OVER (PARTITION BY output ORDER BY mean_absolute DESC, source) AS rank FROM every", d="mean_absolute share")
def e36(spark, sf):
    return metrics.contribution_shares(metrics.contributions(contributions(spark, sf), "source"), "source")


IMPORTANCE = TEXTS + ", imp AS (SELECT topic AS fold, CAST(level AS VARCHAR) AS feature, sum(text_id % 101)::DOUBLE AS importance FROM texts WHERE (topic + level) % 5 > 0 GROUP BY ALL)"


@query("e39_f07_stability", f"WITH {IMPORTANCE}, r AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY importance DESC, feature) AS k FROM imp) SELECT feature, sum(importance) / 8 AS mean, sqrt(greatest(0, (sum(importance * importance) - 8 * pow(sum(importance) / 8, 2)) / 7)) AS sd, count(*) AS folds_present, avg(k) AS mean_rank, count(*) FILTER (WHERE k <= 5) AS folds_in_top FROM r GROUP BY 1", d="mean sd mean_rank")
def e39(spark, sf):
    imp = texts(spark, sf).where("(topic + level) % 5 > 0").groupBy(F.col("topic").alias("fold"), F.col("level").cast("string").alias("feature")).agg(F.sum(F.col("text_id") % 101).cast("double").alias("importance"))
    return metrics.stability(imp, 8, 5)


@query("e40_data_description", f"WITH {PREDICTED}, {FRAME[len(TEXTS) + 2:]} SELECT split, count(*) AS texts, count(DISTINCT p.learner_id) AS learners, median({QTY}) AS median_words, 100.0 * count(*) FILTER (WHERE {QTY} < 50) / count(*) AS under_50 FROM predicted p JOIN frame USING (text_id) GROUP BY split", d="median_words under_50")
def e40(spark, sf):
    rows = predictions(spark, sf).join(words(spark, sf), "text_id")
    return rows.groupBy("split").agg(F.count("*").alias("texts"), F.countDistinct("learner_id").alias("learners"), F.median("words").alias("median_words"), (100.0 * F.count_if(F.col("words") < 50) / F.count("*")).alias("under_50"))


@query("e41_e53_length_dependence", f"WITH {LONG}, w AS (SELECT text_id, {QTY} AS words FROM frame WHERE {QTY} IS NOT NULL), r AS (SELECT feature, level, rank() OVER (PARTITION BY feature, level ORDER BY value) + (count(*) OVER (PARTITION BY feature, level, value) - 1) / 2.0::DOUBLE AS a, rank() OVER (PARTITION BY feature, level ORDER BY words) + (count(*) OVER (PARTITION BY feature, level, words) - 1) / 2.0::DOUBLE AS b FROM long JOIN w USING (text_id) WHERE value IS NOT NULL), c AS (SELECT feature, level, count(*) AS n, corr(a, b) AS r FROM r GROUP BY 1, 2) SELECT feature, sum(r * n) / sum(n) AS r FROM c WHERE NOT isnan(r) GROUP BY 1 HAVING abs(sum(r * n) / sum(n)) >= 0.3", d="r")
def e41(spark, sf):
    return correlate.length_dependence(long_frame(spark, sf), words(spark, sf))


@query("e42_f09_fifths_within_level", f"WITH {FRAME}, n AS (SELECT *, row_number() OVER (PARTITION BY level ORDER BY {QTY}, text_id) AS rn, count(*) OVER (PARTITION BY level) AS n FROM frame WHERE {QTY} IS NOT NULL), f AS (SELECT *, greatest(1, ceil((rn - 1) * 5 / (n - 1)::DOUBLE)) AS fifth FROM n) SELECT level, fifth, count(*) AS texts, median({QTY}) AS median_words FROM f GROUP BY 1, 2", d="median_words", n="level fifth")
def e42(spark, sf):
    rows = metrics.fifths(frame(spark, sf).where(F.col(QTY).isNotNull()), "level", QTY, "text_id")
    return rows.groupBy("level", "fifth").agg(F.count("*").alias("texts"), F.median(QTY).alias("median_words"))


@query("e44_e45_e46_bootstrap_accuracy")
def e44(spark, sf):
    test = predictions(spark, sf).where("split = 'test'").withColumn("model", F.lit("fixed"))
    draws = bootstrap.run_draws(test, "classifier", "level", "predicted_level", LEVELS)
    return resample.interval(draws.where("metric = 'accuracy'"), "value", ["metric"])


#: Draws of a rule that SQL can follow, in place of random ones.
GIVEN = 40
MODELS = f"""{PREDICTED}, models AS (
  SELECT model, learner_id, level, x, CAST(round_even(x, 0) AS INTEGER) AS p FROM (
    SELECT m.model, learner_id, level, CASE m.model WHEN 'a' THEN predicted_level_continuous WHEN 'b' THEN greatest(1.0, predicted_level_continuous - 1.5) ELSE (predicted_level_continuous + 8) / 2 END AS x
    FROM predicted CROSS JOIN (VALUES ('a'), ('b'), ('c')) AS m(model) WHERE split = 'test')
), weights AS (
  SELECT learner_id, draw, (learner_id * 7 + draw * 5 + (learner_id * draw) % 11) % 4 AS w FROM (SELECT DISTINCT learner_id FROM models) CROSS JOIN (SELECT unnest(generate_series(0, {GIVEN - 1})) AS draw)
), r AS (SELECT model, draw, level, p, x, w::DOUBLE AS w FROM models JOIN weights USING (learner_id) WHERE w > 0)"""
DRAWS = f"""{MODELS}, cell AS (SELECT model, draw, level AS i, p AS j, sum(w) AS n FROM r GROUP BY ALL),
truth AS (SELECT model, draw, i, sum(n) AS n FROM cell GROUP BY ALL), guess AS (SELECT model, draw, j, sum(n) AS n FROM cell GROUP BY ALL),
overall AS (SELECT model, draw, sum(n) AS n, sum(n) FILTER (i = j) AS hit, sum(abs(i - j) * n) AS gap, sum(n) FILTER (abs(i - j) <= 1) AS near, sum((i - j) * (i - j) * n) AS square FROM cell GROUP BY ALL),
chance AS (SELECT truth.model, truth.draw, sum((i - j) * (i - j) * truth.n * guess.n) AS c FROM truth JOIN guess USING (model, draw) GROUP BY ALL),
f AS (SELECT model, draw, sum(f) / 15 AS f FROM (SELECT model, draw, label, 2 * sum(hit) / sum(n) AS f FROM (
  SELECT model, draw, i AS label, 0 AS hit, n FROM truth UNION ALL SELECT model, draw, j, 0, n FROM guess UNION ALL SELECT model, draw, i, n, 0 FROM cell WHERE i = j) GROUP BY ALL) GROUP BY ALL),
sums AS (SELECT model, draw, sum(w) AS n, sum(w * abs(x - level)) AS absolute, sum(w * (x - level) * (x - level)) AS square, sum(w * level) AS t, sum(w * level * level) AS tt FROM r GROUP BY ALL),
rx AS (SELECT model, draw, x, sum(c) OVER (PARTITION BY model, draw ORDER BY x) - c / 2 + 0.5 AS rank FROM (SELECT model, draw, x, sum(w) AS c FROM r GROUP BY ALL)),
ry AS (SELECT model, draw, level, sum(c) OVER (PARTITION BY model, draw ORDER BY level) - c / 2 + 0.5 AS rank FROM (SELECT model, draw, level, sum(w) AS c FROM r GROUP BY ALL)),
ranked AS (SELECT model, draw, sum(w) AS n, sum(w * rx.rank) AS a, sum(w * ry.rank) AS b, sum(w * rx.rank * rx.rank) AS aa, sum(w * ry.rank * ry.rank) AS bb, sum(w * rx.rank * ry.rank) AS ab FROM r JOIN rx USING (model, draw, x) JOIN ry USING (model, draw, level) GROUP BY ALL),
draws AS (SELECT model, draw, 'accuracy' AS metric, hit / n AS value FROM overall UNION ALL SELECT model, draw, 'ordinal_mae', gap / n FROM overall UNION ALL SELECT model, draw, 'within_one', near / n FROM overall
  UNION ALL SELECT model, draw, 'qwk', 1 - square * n / c FROM overall JOIN chance USING (model, draw) UNION ALL SELECT model, draw, 'macro_f1', f FROM f
  UNION ALL SELECT model, draw, 'mae', absolute / n FROM sums UNION ALL SELECT model, draw, 'rmse', sqrt(square / n) FROM sums UNION ALL SELECT model, draw, 'r2', 1 - square / (tt - t * t / n) FROM sums
  UNION ALL SELECT model, draw, 'spearman', (ab - a * b / n) / sqrt((aa - a * a / n) * (bb - b * b / n)) FROM ranked)"""


def models(spark, sf):
    """Test texts with predictions of three models by fixed rules."""
    x = F.col("predicted_level_continuous")
    kinds = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), c.alias("x")) for m, c in (("a", x), ("b", F.greatest(F.lit(1.0), x - 1.5)), ("c", (x + 8) / 2))]))
    return predictions(spark, sf).where("split = 'test'").select("learner_id", "level", kinds.alias("m")).select("learner_id", "level", "m.*").withColumn("p", S.rounded_level(F.col("x")))


def given_draws(spark, sf):
    """All metrics of the three models in draws whose weights follow a rule."""
    rule = bootstrap.Given(lambda ids, draws: (ids[:, None] * 7 + draws * 5 + ids[:, None] * draws % 11) % 4, GIVEN)
    rows = models(spark, sf)
    return bootstrap.run_draws(rows, "classifier", "level", "p", LEVELS, weights=rule).unionAll(bootstrap.run_draws(rows, "regressor", "level", "x", weights=rule))


@query("e44_f12_p21_metrics_of_every_draw", f"WITH {DRAWS} SELECT * FROM draws", d="value", n="draw")
def e44_draws(spark, sf):
    return given_draws(spark, sf)


@query("e45_e46_interval_of_draws", f"WITH {DRAWS} SELECT model, metric, stddev_samp(value) AS sd, quantile_cont(value, 0.025) AS low, quantile_cont(value, 0.975) AS high FROM draws GROUP BY ALL", d="sd low high")
def e45(spark, sf):
    return resample.interval(given_draws(spark, sf), "value", ["model", "metric"])


@query("e47_paired_differences", f"WITH {DRAWS} SELECT model, avg(d) AS mean, quantile_cont(d, 0.025) AS low, quantile_cont(d, 0.975) AS high, quantile_cont(d, 0.025) > 0 OR quantile_cont(d, 0.975) < 0 AS distinguishable FROM (SELECT a.model, b.value - a.value AS d FROM draws a JOIN draws b ON a.draw = b.draw AND a.metric = 'qwk' AND b.metric = 'qwk' AND b.model = 'c' AND a.model <> 'c') GROUP BY 1", d="mean low high")
def e47(spark, sf):
    return resample.paired_difference(given_draws(spark, sf).where("metric = 'qwk'"), "c")


@query("e48_gains_over_baseline", f"WITH {DRAWS} SELECT a.model, a.metric, avg(a.value - b.value) AS gain, stddev_samp(a.value - b.value) AS sd FROM draws a JOIN draws b ON a.draw = b.draw AND a.metric = b.metric AND b.model = 'a' WHERE a.model <> 'a' GROUP BY ALL", d="gain sd")
def e48(spark, sf):
    d = given_draws(spark, sf)
    base = d.where("model = 'a'").select("draw", "metric", F.col("value").alias("base"))
    return d.where("model <> 'a'").join(base, ["draw", "metric"]).groupBy("model", "metric").agg(F.avg(F.col("value") - F.col("base")).alias("gain"), F.stddev_samp(F.col("value") - F.col("base")).alias("sd"))


def fold_differences(spark, sf):
    s = fold_scores(spark, sf)
    a, b = s.where("model = 'B1'").select("fold", F.col("value").alias("x")), s.where("model = 'A2'").select("fold", F.col("value").alias("y"))
    return a.join(b, "fold").select((F.col("x") - F.col("y") - 3).alias("d"))


@query("e49_corrected_resampled_t", f"WITH {FOLDS}, d AS (SELECT a.value - b.value - 3 AS d FROM scores a JOIN scores b USING (fold) WHERE a.model = 'B1' AND b.model = 'A2') SELECT count(*) AS k, avg(d) AS mean, avg(d) / sqrt((1.0 / count(*) + 100.0 / 900) * var_samp(d)) AS t, count(*) - 1 AS df FROM d", d="mean t")
def e49(spark, sf):
    return metrics.corrected_t(fold_differences(spark, sf), 900, 100)


@query("e49_p_of_corrected_t", f"WITH {FOLDS}, d AS (SELECT a.value - b.value - 3 AS d FROM scores a JOIN scores b USING (fold) WHERE a.model = 'B1' AND b.model = 'A2'), t AS (SELECT atan(abs(avg(d) / sqrt((1.0 / count(*) + 100.0 / 900) * var_samp(d))) / sqrt(7)) AS a FROM d) SELECT 7 AS df, 1 - 2 / pi() * (a + sin(a) * (cos(a) + 2.0 / 3 * pow(cos(a), 3) + 8.0 / 15 * pow(cos(a), 5))) AS p FROM t", d="p", n="df")
def e49p(spark, sf):
    """Eight folds: for 7 degrees of freedom the tail has a closed form."""
    return metrics.corrected_t(fold_differences(spark, sf), 900, 100).select("df", metrics.t_p(F.col("t"), F.col("df")).alias("p"))


SEEN = PREDICTED + ", seen AS (SELECT CASE WHEN level % 2 = 0 THEN 'main' ELSE 'short' END AS model, CASE WHEN learner_id % 2 = 0 THEN 'first' ELSE 'second' END AS direction, CASE WHEN topic < 4 THEN 'seen' ELSE 'unseen' END AS part, avg(CASE WHEN level = predicted_level THEN 1.0 ELSE 0 END) AS value FROM predicted GROUP BY ALL)"


@query("e50_transfer_gaps", f"WITH {SEEN}, g AS (SELECT model, avg(s - u) AS gap FROM (SELECT model, direction, max(value) FILTER (WHERE part = 'seen') AS s, max(value) FILTER (WHERE part = 'unseen') AS u FROM seen GROUP BY 1, 2) GROUP BY 1) SELECT model, gap, gap - (SELECT gap FROM g WHERE model = 'main') AS extra FROM g", d="gap extra")
def e50(spark, sf):
    p = predictions(spark, sf)
    s = p.groupBy(F.when(F.col("level") % 2 == 0, "main").otherwise("short").alias("model"), F.when(F.col("learner_id") % 2 == 0, "first").otherwise("second").alias("direction"), F.when(F.col("topic") < 4, "seen").otherwise("unseen").alias("part")).agg(F.avg((F.col("level") == F.col("predicted_level")).cast("double")).alias("value"))
    return metrics.transfer_gap(s)


@query("e51_k02_baselines", f"WITH {TEXTS} SELECT (SELECT cefr_level FROM texts GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS majority, median(level) AS median FROM texts", d="median")
def e51(spark, sf):
    return metrics.baselines(texts(spark, sf), "cefr_level", "level")


@query("e52_status_histogram", f"WITH {USAGE} SELECT evidence AS status, count(*) AS n FROM usage GROUP BY 1")
def e52(spark, sf):
    return describe.histogram(usage(spark, sf), F.col("evidence"), "status")


def _pruned(least: float = 0.95) -> str:
    """A feature is kept if it is not close to one before it that is kept: feature by feature, as there are few."""
    names = list(FEATURES)
    close = [f"coalesce((SELECT abs(r) >= {least} FROM rank_pairs WHERE a = least('{x}', '{y}') AND b = greatest('{x}', '{y}')), false) AS c{i}_{j}" for j, y in enumerate(names) for i, x in enumerate(names[:j])]
    kept = ["true AS k0"] + ["NOT (" + " OR ".join(f"(k{i} AND c{i}_{j})" for i in range(j)) + f") AS k{j}" for j in range(1, len(names))]
    steps, last = [f"s_ AS (SELECT {', '.join(close)})"], "s_"
    for j, k in enumerate(kept):
        steps.append(f"s{j} AS (SELECT *, {k} FROM {last})")
        last = f"s{j}"
    return ", ".join(steps) + " " + " UNION ALL ".join(f"SELECT '{n}' AS feature, k{j} AS kept FROM {last}" for j, n in enumerate(names))


RANK_PAIRS = f"{LONG}, r AS (SELECT text_id, feature, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0::DOUBLE AS v FROM long WHERE value IS NOT NULL), rank_pairs AS (SELECT a.feature AS a, b.feature AS b, count(*) AS n, corr(a.v, b.v) AS r FROM r a JOIN r b ON a.text_id = b.text_id AND a.feature < b.feature GROUP BY 1, 2)"


@query("e54_near_duplicate_features", f"WITH {RANK_PAIRS}, {_pruned()}")
def e54(spark, sf):
    ranks = correlate.rank_values(long_frame(spark, sf))
    kept = correlate.prune_near_duplicates(correlate.pair_correlations(ranks), list(FEATURES))
    return spark.createDataFrame([(k, k in kept) for k in FEATURES], "feature string, kept boolean")


@query("e54_rank_pairs", f"WITH {LONG}, r AS (SELECT text_id, feature, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0::DOUBLE AS v FROM long WHERE value IS NOT NULL) SELECT a.feature AS a, b.feature AS b, count(*) AS n, corr(a.v, b.v) AS r FROM r a JOIN r b ON a.text_id = b.text_id AND a.feature < b.feature GROUP BY 1, 2", d="r")
def e54b(spark, sf):
    return correlate.pair_correlations(correlate.rank_values(long_frame(spark, sf)))


@query("f04_tolerant_ranks", "SELECT p_partkey::VARCHAR AS feature, (p_size % 7)::DOUBLE AS score, rank() OVER (ORDER BY p_size % 7 DESC) AS rank FROM part", d="score")
def f04(spark, sf):
    return information.tolerant_rank(table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("feature"), (F.col("p_size") % 7).cast("double").alias("score")))


@query("f05_g02_top_of_each_source", f"WITH {CORR} SELECT feature, source, abs(spearman) AS size, k FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY abs(spearman) DESC NULLS LAST, abs(pearson) DESC NULLS LAST, feature) AS k FROM (SELECT *, split_part(feature, '__', 2) AS source FROM cor)) WHERE k <= 1", d="size")
def f05(spark, sf):
    c = correlate.correlations(long_frame(spark, sf)).withColumn("source", S.column_part(F.col("feature"), 1))
    w = Window.partitionBy("source").orderBy(F.abs("spearman").desc_nulls_last(), F.abs("pearson").desc_nulls_last(), "feature")
    return c.withColumn("k", F.row_number().over(w)).where("k <= 1").select("feature", "source", F.abs("spearman").alias("size"), "k")


@query("f06_leaderboard", f"WITH {PREDICTED}, s AS (SELECT 'level' AS target, split, 'topic ' || CAST(topic AS VARCHAR) AS model, round(avg(CASE WHEN level = predicted_level THEN 1.0 ELSE 0 END), 9) AS accuracy, round(avg(CASE WHEN abs(level - predicted_level) <= 1 THEN 1.0 ELSE 0 END), 9) AS macro_f1, round(avg(abs(level - predicted_level)), 9) AS ordinal_mae FROM predicted GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY target, split ORDER BY macro_f1 DESC, accuracy DESC, ordinal_mae, model) AS rank FROM s", d="accuracy macro_f1 ordinal_mae")
def f06(spark, sf):
    gap = F.abs(F.col("level") - F.col("predicted_level"))
    s = predictions(spark, sf).groupBy(F.lit("level").alias("target"), "split", F.concat(F.lit("topic "), F.col("topic").cast("string")).alias("model")).agg(F.round(F.avg((gap == 0).cast("double")), 9).alias("accuracy"), F.round(F.avg((gap <= 1).cast("double")), 9).alias("macro_f1"), F.round(F.avg(gap), 9).alias("ordinal_mae"))
    return metrics.leaderboard(s)


@query("f10_g08_overall_ranks", f"WITH {GROUPED} SELECT source, round(sum(mean_absolute), 6) AS total, row_number() OVER (ORDER BY sum(mean_absolute) DESC, source) AS rank FROM grp GROUP BY 1 ORDER BY rank LIMIT 2", d="total")
def f10(spark, sf):
    t = metrics.contributions(contributions(spark, sf), "source").groupBy("source").agg(F.sum("mean_absolute").alias("total"))
    return t.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("total").desc(), "source"))).orderBy("rank").limit(2)


@query("f12_weighted_ranks", f"WITH {TEXTS}, c AS (SELECT level, sum(1 + topic) AS w FROM texts GROUP BY 1) SELECT level, w, sum(w) OVER (ORDER BY level) - w + (w + 1) / 2.0::DOUBLE AS rank FROM c", d="rank", n="level w")
def f12(spark, sf):
    c = texts(spark, sf).groupBy("level").agg(F.sum(1 + F.col("topic")).alias("w"))
    return c.select("level", "w", (F.sum("w").over(Window.partitionBy(F.lit(0)).orderBy("level")) - F.col("w") + (F.col("w") + 1) / 2.0).alias("rank"))


@query("g04_top_sections", f"WITH {CORR} SELECT 'positive' AS section, feature, spearman FROM (SELECT * FROM cor WHERE spearman > 0 ORDER BY spearman DESC, feature LIMIT 2) UNION ALL SELECT 'negative', feature, spearman FROM (SELECT * FROM cor WHERE spearman < 0 ORDER BY spearman, feature LIMIT 2)", d="spearman")
def g04(spark, sf):
    c = correlate.correlations(long_frame(spark, sf))
    up = c.where("spearman > 0").orderBy(F.col("spearman").desc(), "feature").limit(2).select(F.lit("positive").alias("section"), "feature", "spearman")
    return up.unionByName(c.where("spearman < 0").orderBy("spearman", "feature").limit(2).select(F.lit("negative").alias("section"), "feature", "spearman"))


@query("j01_learner_split", f"WITH {PREDICTED} SELECT text_id, learner_id, split FROM predicted")
def j01(spark, sf):
    return resample.with_split(texts(spark, sf)).select("text_id", "learner_id", "split")


@query("j02_split_validation", f"""WITH {PREDICTED}, dealt AS (SELECT *, CASE WHEN text_id % 50 = 0 THEN 'train' WHEN cefr_level = 'C1' AND split = 'test' AND text_id % 300 > 0 THEN 'validation' ELSE split END AS wrong FROM predicted)
SELECT 'learner in several splits' AS problem, count(*) AS n FROM (SELECT learner_id FROM dealt GROUP BY 1 HAVING count(DISTINCT wrong) > 1) UNION ALL SELECT 'label with under two texts', count(*) FROM (SELECT wrong, cefr_level FROM dealt GROUP BY ALL HAVING count(*) < 2) UNION ALL SELECT 'missing split', 3 - count(DISTINCT wrong) FROM dealt""")
def j02(spark, sf):
    """Splits with planted faults: some texts are dealt by themselves instead of by their learner."""
    rows = resample.with_split(texts(spark, sf))
    wrong = F.when(F.col("text_id") % 50 == 0, "train").when((F.col("cefr_level") == "C1") & (F.col("split") == "test") & (F.col("text_id") % 300 > 0), "validation").otherwise(F.col("split"))
    return resample.split_problems(rows.withColumn("split", wrong))


@query("j03_grouped_folds")
def j03(spark, sf):
    return resample.grouped_folds(resample.with_split(texts(spark, sf)).where("split <> 'test'"))


@query("j04_task_folds", f"WITH {TEXTS} SELECT DISTINCT level, topic, dense_rank() OVER (PARTITION BY level ORDER BY topic) AS fold FROM texts", n="level")
def j04(spark, sf):
    return resample.task_folds(texts(spark, sf))


@query("j05_half_task_groups", f"WITH {TEXTS}, held AS (SELECT level, topic FROM (SELECT DISTINCT level, topic, dense_rank() OVER (PARTITION BY level ORDER BY topic) AS f FROM texts) WHERE f <= 4) SELECT text_id, EXISTS (SELECT 1 FROM held h WHERE h.level = t.level AND h.topic = t.topic) AS held FROM texts t")
def j05(spark, sf):
    t = texts(spark, sf)
    held = resample.task_folds(t).where("fold <= 4").select("level", "topic")
    inside = t.join(F.broadcast(held), ["level", "topic"], "left_semi").select("text_id", F.lit(True).alias("held"))
    return inside.unionByName(t.join(F.broadcast(held), ["level", "topic"], "left_anti").select("text_id", F.lit(False).alias("held")))


def jobs(spark, sf):
    t = resample.with_split(frame(spark, sf)).where("split = 'train'")
    return t.withColumn("model", F.explode(F.array(F.lit("all"))))


@query("k01_k03_additive_classifier")
def k01(spark, sf):
    features = list(FEATURES)
    terms = additive.fit(jobs(spark, sf), features, "cefr_level", "classifier")
    test = resample.with_split(frame(spark, sf)).where("split = 'test'")
    p = additive.predict(test, features, terms)
    best = p.groupBy("text_id").agg(F.max_by("output", F.struct("probability", "output")).alias("predicted"), F.max("probability").alias("probability"))
    return test.select("text_id", "cefr_level").join(best, "text_id")


@query("k01_additive_regressor")
def k01b(spark, sf):
    terms = additive.fit(jobs(spark, sf), list(FEATURES), "level", "regressor")
    test = resample.with_split(frame(spark, sf)).where("split = 'test'")
    p = additive.predict(test, list(FEATURES), terms).select("text_id", S.clamp(F.col("score"), 1.0, 15.0).alias("p"))
    return metrics.regression_scores(test.join(p, "text_id"), "level", "p")


TERMS = [("m", "", 0, None, "value", 7.5)] + [("m", f, b, [None, float("-inf"), 3.0, 9.0][b], "value", [0.25, -1.0, 0.5, 2.0][b] * (i + 1)) for i, f in enumerate(FEATURES) for b in range(4)]
SCORES = LONG + ", part AS (SELECT text_id, feature, (CASE WHEN value IS NULL THEN 0.25 WHEN value >= 9 THEN 2.0 WHEN value >= 3 THEN 0.5 ELSE -1.0 END) * list_position([" + ", ".join(f"'{k}'" for k in FEATURES) + "], feature) AS score FROM long)"


def terms(spark):
    return spark.createDataFrame(TERMS, additive.TERMS)


@query("k03_scoring_by_lookup", f"WITH {SCORES} SELECT text_id, 7.5 + sum(score) AS score FROM part GROUP BY 1", d="score")
def k03(spark, sf):
    return additive.predict(frame(spark, sf), list(FEATURES), terms(spark)).select("text_id", "score")


@query("k04_exact_decomposition", f"WITH {SCORES} SELECT text_id, feature, score FROM part", d="score")
def k04(spark, sf):
    return additive.contributions(frame(spark, sf), list(FEATURES), terms(spark)).select("text_id", "feature", "score")


@query("k05_term_importances", f"WITH {SCORES}, i AS (SELECT feature, avg(abs(score)) AS importance FROM part GROUP BY 1) SELECT feature, importance / sum(importance) OVER () AS share, row_number() OVER (ORDER BY importance DESC, feature) AS rank FROM i", d="share")
def k05(spark, sf):
    i = additive.contributions(frame(spark, sf), list(FEATURES), terms(spark)).groupBy("feature").agg(F.avg(F.abs("score")).alias("importance"))
    w = Window.partitionBy(F.lit(0))
    return i.select("feature", (F.col("importance") / F.sum("importance").over(w)).alias("share"), F.row_number().over(w.orderBy(F.col("importance").desc(), "feature")).alias("rank"))


W = "w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: x <> '') AS w FROM documents)"


@query("l01_lexical_measures", f"WITH {W}, c AS (SELECT doc_id, len(w) AS n, len(list_distinct(w)) AS t, len(list_distinct(w[1:50])) AS z FROM w) SELECT doc_id, n AS nwords, t AS types, CASE WHEN n > 0 THEN t / n::DOUBLE END AS ttr, CASE WHEN n > 0 THEN t / sqrt(2.0 * n) END AS cttr, CASE WHEN n > 0 THEN t / sqrt(n) END AS rttr, CASE WHEN n > 1 THEN ln(t) / ln(n) END AS logttr, z AS ndwz FROM c", d="ttr cttr rttr logttr", n="nwords types ndwz")
def l01(spark, sf):
    return textmeasures.lexical(table(spark, sf, "documents"))


@query("l02_count_ratios", f"WITH {FRAME} SELECT text_id, CASE WHEN b <> 0 THEN a / b ELSE 0 END AS a_per_b FROM (SELECT text_id, {QTY} AS a, {OPEN} AS b FROM frame)", d="a_per_b")
def l02(spark, sf):
    return textmeasures.ratios(frame(spark, sf).select("text_id", F.col(QTY).alias("a"), F.col(OPEN).alias("b")), [("a", "b")]).select("text_id", "a_per_b")


L02 = """WITH t AS (SELECT doc_id, regexp_replace(text, '(?m)^\\s*([-*•]|[0-9]+[.)])\\s+', chr(10), 'g') AS t FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(t, '([.!?])\\s+', '\\1' || chr(10), 'g'), '\\n+'), lambda x: trim(x)), lambda x: x <> '') AS s FROM t),
one AS (SELECT doc_id, unnest(s) AS s, generate_subscripts(s, 1) - 1 AS sentence FROM s), n AS (SELECT doc_id, sentence, len(list_filter(regexp_split_to_array(s, '\\s+'), lambda x: x <> '')) AS n FROM one),
c AS (SELECT *, unnest(generate_series(0, greatest(n - 1, 0) // 45)) AS chunk FROM n) SELECT doc_id, sentence, chunk, least(45, n - 45 * chunk) AS words FROM c"""


@query("l02_sentence_chunks", L02, n="sentence chunk words")
def l02b(spark, sf):
    return textmeasures.chunks(table(spark, sf, "documents"))


@query("l03_counts_per_ten_thousand", f"WITH {FRAME} SELECT text_id, CASE WHEN {QTY} <> 0 THEN {ERRORS} * 10000 / {QTY} END AS errors FROM frame", d="errors")
def l03(spark, sf):
    return textmeasures.per_ten_thousand(frame(spark, sf).select("text_id", F.col(ERRORS).alias("errors"), F.col(QTY).alias("nwords")), ["errors"]).drop("nwords")


L04 = """WITH p AS (SELECT doc_id, 1 AS part, upper(lang) AS lang FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 2, CASE WHEN doc_id % 7 > 0 THEN lang || '2' END FROM documents WHERE doc_id % 5 = 0),
latest AS (SELECT doc_id, lang FROM p WHERE lang IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY part DESC) = 1)
SELECT doc_id, lang FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, lang FROM latest WHERE doc_id % 3 <> 0"""


@query("l04_incremental_merge", L04)
def l04(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang")
    parts = [d.where("doc_id % 2 = 0").withColumn("lang", F.upper("lang")), d.where("doc_id % 5 = 0").withColumn("lang", F.when(F.col("doc_id") % 7 > 0, F.concat("lang", F.lit("2"))))]
    return relational.merge_parts(d.where("doc_id % 3 = 0"), parts, "doc_id", ["lang"])


L05 = f"""WITH {W}, t AS (SELECT doc_id, len(w) AS words, ' ' || array_to_string(w, ' ') || ' ' AS t FROM w), c AS (SELECT doc_id, words, {', '.join(f"len(regexp_extract_all(t, '{p}')) AS {k}" for k, p in textmeasures.CONSTRUCTS.items())} FROM t)
SELECT doc_id, words AS word_count, {' + '.join(textmeasures.CONSTRUCTS)} AS total_annotations, {' + '.join(f'({k} > 0)::INT' for k in textmeasures.CONSTRUCTS)} AS unique_constructs, {', '.join(f'CASE WHEN words > 0 THEN 100.0 * {k} / words ELSE 0 END AS {k}' for k in textmeasures.CONSTRUCTS)} FROM c WHERE words IS NOT NULL"""


@query("l05_pattern_rates", L05, d=" ".join(textmeasures.CONSTRUCTS), n="word_count total_annotations unique_constructs")
def l05(spark, sf):
    return textmeasures.construct_rates(table(spark, sf, "documents").where("text is not null"))


@query("l06_word_edits")
def l06(spark, sf):
    d = table(spark, sf, "documents")
    pairs = d.select(F.col("doc_id").alias("text_id"), F.col("text").alias("original"), F.regexp_replace("text", r"\b(of|le|der) ", "").alias("corrected"))
    found = textmeasures.align(pairs).select("text_id", F.explode("edits").alias("e")).select("text_id", F.concat(F.col("e.operation"), F.lit(":OTHER")).alias("error_type"), "e.start", "e.stop")
    return describe.text_rollup(found)


@query("p01_strongest_of_two", f"WITH {CORR} SELECT feature, greatest(abs(pearson), abs(spearman)) AS strongest FROM cor", d="strongest")
def p01(spark, sf):
    return correlate.correlations(long_frame(spark, sf)).select("feature", F.greatest(F.abs("pearson"), F.abs("spearman")).alias("strongest"))


@query("p02_pair_length_flags", f"WITH {PAIRS} SELECT a, b, a LIKE '%basic%' OR b LIKE '%basic%' AS length FROM pairs")
def p02(spark, sf):
    listed = spark.createDataFrame([(f,) for f in FEATURES if "basic" in f], "f string")
    p = correlate.pair_correlations(long_frame(spark, sf)).select("a", "b")
    p = p.join(F.broadcast(listed.select(F.col("f").alias("x"))), F.col("a") == F.col("x"), "left").join(F.broadcast(listed.select(F.col("f").alias("y"))), F.col("b") == F.col("y"), "left")
    return p.select("a", "b", (F.col("x").isNotNull() | F.col("y").isNotNull()).alias("length"))


@query("p03_ranks_without_length", f"WITH {CORR} SELECT feature, row_number() OVER (ORDER BY abs(spearman) DESC, feature) AS rank FROM cor WHERE feature NOT LIKE '%basic%'")
def p03(spark, sf):
    c = correlate.correlations(long_frame(spark, sf)).where("feature not like '%basic%'")
    return c.select("feature", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.abs("spearman").desc(), "feature")).alias("rank"))


@query("p13_collected_reports", f"WITH {PREDICTED} SELECT split, 'level' AS target, 'accuracy' AS metric, avg(CASE WHEN level = predicted_level THEN 1.0 ELSE 0 END) AS value FROM predicted GROUP BY 1 UNION ALL SELECT split, 'cefr', 'accuracy', avg(CASE WHEN cefr_level = predicted_cefr THEN 1.0 ELSE 0 END) FROM predicted GROUP BY 1", d="value")
def p13(spark, sf):
    p = predictions(spark, sf)
    one = lambda t, a, b, labels: metrics.overall_scores(metrics.confusion(p, a, b, labels, ["split"]), len(labels), ["split"]).select("split", F.lit(t).alias("target"), F.lit("accuracy").alias("metric"), F.col("accuracy").alias("value"))
    return one("level", "level", "predicted_level", LEVELS).unionByName(one("cefr", "cefr_level", "predicted_cefr", BANDS5))


@query("p16_rescore_check", f"WITH {SCORES} SELECT 0.0 AS worst, count(DISTINCT text_id) AS texts FROM part", d="worst")
def p16(spark, sf):
    f, t = frame(spark, sf), terms(spark)
    total = additive.contributions(f, list(FEATURES), t).groupBy("text_id").agg((F.sum("score") + 7.5).alias("again"))
    return additive.predict(f, list(FEATURES), t).join(total, "text_id").agg(F.max(F.abs(F.col("score") - F.col("again"))).alias("worst"), F.countDistinct("text_id").alias("texts"))


@query("p21_weighted_pearson", f"WITH {FRAME} SELECT cefr_level, (sum(w * x * y) - sum(w * x) * sum(w * y) / sum(w)) / sqrt((sum(w * x * x) - sum(w * x) * sum(w * x) / sum(w)) * (sum(w * y * y) - sum(w * y) * sum(w * y) / sum(w))) AS r FROM (SELECT cefr_level, (1 + topic)::DOUBLE AS w, {QTY} AS x, {ERRORS} AS y FROM frame WHERE {QTY} IS NOT NULL) GROUP BY 1", d="r")
def p21(spark, sf):
    rows = frame(spark, sf).where(F.col(QTY).isNotNull()).withColumn("w", 1 + F.col("topic"))
    return resample.weighted_pearson(rows, QTY, ERRORS, "w", ["cefr_level"])


@query("p23_result_table", f"WITH {FOLDS}, s AS (SELECT model, avg(value) AS m, stddev_samp(value) AS sd FROM scores GROUP BY 1) SELECT model, m AS mean, sd FROM s", d="mean sd")
def p23(spark, sf):
    return fold_scores(spark, sf).groupBy("model").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))


@query("p24_failures_and_unpaired", "SELECT doc_id, 'failed' AS state, lang AS reason FROM documents WHERE n_chars < 200 UNION ALL SELECT doc_id, 'unpaired', NULL FROM labels WHERE quality = 0")
def p24(spark, sf):
    a = table(spark, sf, "documents").where("n_chars < 200").select("doc_id", F.lit("failed").alias("state"), F.col("lang").alias("reason"))
    b = table(spark, sf, "labels").where("quality = 0").select("doc_id", F.lit("unpaired").alias("state"))
    return a.unionByName(b, allowMissingColumns=True)
