"""A session with the settings that the operators expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "textloom", **settings: str) -> SparkSession:
    """UTC, ANSI and adaptive execution with splitting of skewed joins; ``settings`` override, _ standing for a dot.

    Shuffle partitions stay at the session's own setting: they are the cluster's to choose, about 128 MB of a shuffle to
    each, and adaptive execution merges those that turn out small."""
    own = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    own |= {k.replace("_", "."): v for k, v in settings.items()}
    return SparkSession.builder.appName(name).config(map=own).getOrCreate()
