"""Queries of experiments, streams and round trips through files."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import scalars as S
from textloom.operators import experiments, relational, resample
from textloom.plans.registry import query
from textloom.plans.relational import SHARES, _scratch, feature_flags
from textloom.sources import files, readers, writers
from textloom.sources.adapters import FEATURES, TEXTS, edits, frame, table, texts
from textloom.streaming import incremental

GRID = "SELECT f.family, k.fold FROM (VALUES ('all'), ('top_200')) AS f(family) CROSS JOIN (VALUES (0), (1), (2)) AS k(fold)"


@query("j07_g07_job_order", f"""WITH g AS ({GRID}), fits AS (SELECT t.task || '__' || a.algorithm || '__' || family || '__' || fold AS job_id, 'fit' AS kind, a.cost, CASE WHEN family = 'top_200' THEN 'ranking__' || fold END AS depends_on, family FROM g CROSS JOIN (VALUES ('level'), ('cefr')) AS t(task) CROSS JOIN (VALUES ('classifier', 9.0::DOUBLE), ('regressor', 1.0::DOUBLE)) AS a(algorithm, cost)),
base AS (SELECT t.task || '__' || a.b || '__' || k.fold AS job_id, 'baseline' AS kind, 0.0::DOUBLE AS cost, NULL AS depends_on, '' AS family FROM (VALUES ('level'), ('cefr')) AS t(task) CROSS JOIN (VALUES ('majority'), ('median')) AS a(b) CROSS JOIN (VALUES (0), (1), (2)) AS k(fold)),
jobs AS (SELECT 'ranking__' || fold AS job_id, 'ranking' AS kind, 0.5::DOUBLE AS cost, NULL AS depends_on, '' AS family FROM (VALUES (0), (1), (2)) AS k(fold) UNION ALL SELECT * FROM fits UNION ALL SELECT * FROM base)
SELECT job_id, kind, depends_on, cost, row_number() OVER (ORDER BY (kind <> 'ranking')::INT, (family <> 'top_200')::INT, cost DESC, job_id) AS place FROM jobs""", d="cost")
def j07(spark, sf):
    every = experiments.jobs(spark, ["level", "cefr"], ["classifier", "regressor"], ["all", "top_200"], 3)
    return experiments.job_order(every, ["top_200"]).select("job_id", "kind", "depends_on", "cost", "place")


@query("j06_transfer_to_unseen_tasks")
def j06(spark, sf):
    return experiments.transfer(frame(spark, sf), list(FEATURES))


def all_models(spark, sf, label: str, algorithm: str):
    """Models of the fifteen sets of features and their baseline."""
    rows = resample.with_split(frame(spark, sf).join(operation_shares(spark, sf), "text_id", "left")).where("split = 'train'")
    sets: dict[str, list[str]] = {}
    for r in relational.feature_sets(feature_flags(spark, sf)).orderBy("name", "feature").collect():
        sets.setdefault(r["name"], []).append(r["feature"])
    terms = experiments.fit_all(rows, sets, label, algorithm)
    return terms.groupBy("model").agg(F.countDistinct(F.when(F.col("feature") != "", F.col("feature"))).alias("features"), F.count("*").alias("terms"))


@query("k06_models_of_all_feature_sets")
def k06(spark, sf):
    return all_models(spark, sf, "level", "regressor")


@query("k06_classifiers_of_all_feature_sets")
def k06b(spark, sf):
    return all_models(spark, sf, "cefr_level", "classifier")


def operation_shares(spark, sf):
    """(text_id, shares of each operation among the text's edits)."""
    op = S.operation(F.col("error_type"))
    count = [(F.count_if(op == name.removeprefix("accuracy__edits__share_")) / F.count("*")).alias(name) for name in SHARES]
    return edits(spark, sf).groupBy("text_id").agg(*count)


@query("b13_a17_csv_export_and_tolerant_read", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_mktsegment FROM customer")
def b13(spark, sf):
    path = _scratch(spark) + "/customer"
    writers.write_csv(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), path)
    return readers.read_csv(spark, path, ["c_custkey", "c_mktsegment"], "drop")


EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def _stream(spark, sf):
    return spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", 100).parquet(sf)


def _done(spark, stream, mode: str):
    """The rows of a stream's query over all that is there now, through a table in the shared folder."""
    base = _scratch(spark)
    write = lambda batch, number: batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{base}/out")
    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


@query("m01_stream_running_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def m01(spark, sf):
    return _done(spark, incremental.running_counts(_stream(spark, sf), ["event_type"]), "complete")


@query("m02_stream_windowed_counts", "SELECT time_bucket(INTERVAL '1 day', ts) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def m02(spark, sf):
    w = incremental.windowed(_stream(spark, sf), "ts", ["event_type"], "1 day", "1 hour")
    return _done(spark, w, "complete").select(F.col("window.start").alias("day"), "event_type", "n")


@query("m03_stream_first_seen_keys", "SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events")
def m03(spark, sf):
    """Each user's first event of a day: a key is kept for two days after it, so state is bounded."""
    s = _stream(spark, sf).select("user_id", "ts", F.to_date("ts").alias("day"))
    return _done(spark, incremental.first_seen(s, ["user_id", "day"], "ts", "2 days"), "append").select("user_id", "day")


@query("m04_stream_rows_set_aside", "SELECT event_id, event_id % 4001 = 7 AS failed, CASE WHEN event_id % 4001 = 7 THEN 2 END AS tries FROM events", n="tries")
def m04(spark, sf):
    """Work that some rows make fail: the others' results land, and each of these rows is set aside by itself."""
    base = _scratch(spark)

    def work(rows):
        if (rows["event_id"] % 4001 == 7).any():
            raise ValueError("bad row")
        return rows[["event_id", "value"]]

    incremental.process_rows(_stream(spark, sf).select("event_id", "value"), work, "event_id long, value double", f"{base}/ok", f"{base}/failed", f"{base}/checkpoint", 2).awaitTermination()
    read = lambda name, schema: spark.read.schema(schema).option("ignoreMissingFiles", True).parquet(f"{base}/{name}")
    done = read("ok", "event_id long").select("event_id", F.lit(False).alias("failed"), F.lit(None).cast("int").alias("tries"))
    if not files.exists(f"{base}/failed"):  # no row failed
        return done
    return done.unionByName(read("failed", "event_id long, tries int").select("event_id", F.lit(True).alias("failed"), "tries"))


@query("p22_job_status", f"WITH {TEXTS}, s AS (SELECT level, count(*) AS texts, count(*) FILTER (WHERE topic < 4) AS done FROM texts GROUP BY 1) SELECT level, texts, done, CASE WHEN done = texts THEN 'done' WHEN done > 0 THEN 'running' ELSE 'waiting' END AS status FROM s", n="level")
def p22(spark, sf):
    s = texts(spark, sf).groupBy("level").agg(F.count("*").alias("texts"), F.count_if(F.col("topic") < 4).alias("done"))
    return s.withColumn("status", F.when(F.col("done") == F.col("texts"), "done").when(F.col("done") > 0, "running").otherwise("waiting"))
