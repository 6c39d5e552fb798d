"""Written summaries: lines made on the driver from small collected results."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.sources import files
from textloom.sources.writers import small

RULE = "-" * 72


def _section(title: str, lines: list[str], none: str = "none") -> list[str]:
    return ["", title, RULE, *(lines or [none])]


def feature_summary(statistics: DataFrame, by_level: DataFrame, skipped: list[str] = ()) -> list[str]:
    """Of each source: features, the least and the most values of one, features that never vary; then rows by table."""
    parts = F.split("feature", "__")
    source = F.concat_ws(" ", F.get(parts, F.lit(0)), F.get(parts, F.lit(1)))
    rows = small(statistics.groupBy(source.alias("source")).agg(F.count("*").alias("k"), F.min("n").alias("least"), F.max("n").alias("most"), F.count_if(F.col("low") == F.col("high")).alias("flat")).orderBy("source"))
    lines = [f"{r['source']}: {r['k']:,} features, values {r['least']:,} to {r['most']:,}, constant {r['flat']:,}" for r in rows]
    levels = by_level.select("level").distinct().count()
    return ["FEATURES", "=" * 72, f"Sources: {len(rows)}", f"Skipped: {', '.join(skipped) or 'none'}", *_section("BY SOURCE", lines), *_section("TABLES", [f"Feature rows: {statistics.count():,}", f"Rows by level: {by_level.count():,} at {levels} levels"])]


def error_summary(statistics: DataFrame, types: DataFrame, top: int = 20) -> list[str]:
    """Overall rates, a line for each band, and the most frequent types of all texts."""
    rows = {r["group_type"] + (r["cefr_level"] or ""): r for r in small(statistics.where("group_type <> 'cefr_level'"))}
    line = lambda r: f"{r['texts']:,} texts, {r['errors']:,.0f} errors, {r['pooled_rate']:.4f} per 100 words, {r['error_free_percent']:.2f}% without"
    bands = [f"{k.removeprefix('cefr')}: {line(r)}" for k, r in sorted(rows.items()) if k.startswith("cefr")]
    every = types.groupBy("error_type").agg(F.sum("edits").alias("n")).orderBy(F.col("n").desc(), "error_type").limit(top)
    most = [f"{i}. {r['error_type']}: {r['n']:,}" for i, r in enumerate(small(every), 1)]
    return ["ERRORS", "=" * 72, f"All: {line(rows['overall'])}", *_section("BY BAND", bands), *_section(f"TOP {top} TYPES", most, "no edits")]


def correlation_summary(tests: DataFrame, top: int = 5) -> list[str]:
    """Counts of each strength, of results that stay after false-discovery control, and the strongest each way.
    tests: (feature, spearman, strength, q)."""
    rows = small(tests.select("feature", "spearman", "strength", "q"))  # once: each use would make the correlations anew
    counts = Counter(r["strength"] or "not calculable" for r in rows)
    order = ["very strong", "strong", "moderate", "weak", "very weak", "not calculable"]
    some = sorted((r for r in rows if r["spearman"] is not None), key=lambda r: r["feature"])
    up = sorted((r for r in some if r["spearman"] > 0), key=lambda r: -r["spearman"])[:top]
    down = sorted((r for r in some if r["spearman"] < 0), key=lambda r: r["spearman"])[:top]
    show = lambda rows: [f"{i}. {r['feature']}: {r['spearman']:.4f}" for i, r in enumerate(rows, 1)]
    significant = sum(r["q"] is not None and r["q"] < 0.05 for r in rows)
    return ["CORRELATIONS WITH THE LEVEL", "=" * 72, f"Features: {sum(counts.values()):,}", *_section("STRENGTH (SPEARMAN)", [f"{k}: {counts.get(k, 0):,}" for k in order] + [f"significant: {significant:,}"]), *_section("POSITIVE", show(up)), *_section("NEGATIVE", show(down))]


def progression_summary(progressions: DataFrame, settings: dict, trends: DataFrame | None = None, note: str = "", top: int = 20) -> list[str]:
    """The settings, features by status and threshold, sustained ones and drops, and the optional error trends. The settings
    are kept beside the summary by ``context.put_settings``. progressions: with threshold."""
    main = settings["common_usage_percent"]
    every = sorted({main, *settings["comparison_thresholds"]})
    lines = [f"{name} = {value}" for name, value in sorted(settings.items())]
    counts = small(progressions.groupBy("threshold", "status").agg(F.count("*").alias("n")).orderBy("threshold", "status"))
    by = [f"{x:g}%: " + "; ".join(f"{r['status']}: {r['n']:,}" for r in counts if r["threshold"] == x) for x in every]
    own = progressions.where(F.col("threshold") == main)
    kept = small(own.where("sustained_from is not null").orderBy("sustained_from", "feature").limit(top))
    drops = small(own.where("drops > 0").orderBy("feature").limit(top))
    out = ["PROGRESSIONS", "=" * 72, *_section("SETTINGS", lines), *_section("BY THRESHOLD", by), *_section("SUSTAINED", [f"{r['feature']}: from level {r['sustained_from']}" for r in kept]), *_section("LATER DROPS", [f"{r['feature']}: common from level {r['first_common']}, below at {r['drops']}" for r in drops])]
    if note:
        out += ["", f"Error trends skipped: {note}"]
    if trends is not None:
        out += _section("ERROR TRENDS", [f"level {r['level']}: {r['rate']:.4f} errors per 100 words in {r['texts']:,} texts" for r in small(trends)])
    return out


def write_lines(lines: list[str], path: str) -> None:
    files.put(path, ("\n".join(lines) + "\n").encode())
