"""Column expressions of the analytics: casts, labels, shares, bands. All stay inside Catalyst."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The bands in order, strength thresholds, length bins, evidence limits.
BANDS = ["A1", "A2", "B1", "B2", "C1", "C2"]
STRENGTH = [(0.2, "very weak"), (0.4, "weak"), (0.6, "moderate"), (0.8, "strong")]
WORD_BINS = [50, 100, 150, 200]
MIN_TEXTS, MIN_COVERAGE = 100, 0.95
LEVELS = 15

NUMBER = r"^\s*[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?\s*$"


def ratio(a: Column, b: Column) -> Column:
    """a / b as double, null where b is 0 or either is null."""
    return F.when(b != 0, a.cast("double") / b.cast("double"))


def quoted(column: str) -> str:
    """A column's very name for select and in SQL, whatever signs it has."""
    return "`" + column.replace("`", "``") + "`"


def finite(x: Column) -> Column:
    """x where it is a finite double, else null. NaN never reaches an aggregate."""
    x = x.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def safe_number(text: Column) -> Column:
    """The finite double that a string spells, else null; Java's suffixes (1d, 1.5f) are not numbers."""
    return finite(F.when(text.rlike(NUMBER), F.trim(text).try_cast("double")))


def level(text: Column, most: int = LEVELS) -> Column:
    """An integral level from 1 to ``most``, given as text or number, else null: 3.0 is 3, 3.7 is none."""
    v = safe_number(text.cast("string"))
    return F.when(v.between(1, most) & (v == F.floor(v)), v.cast("int"))


def base_name(path: Column) -> Column:
    return F.regexp_extract(F.translate(path, "\\", "/"), r"([^/]*)$", 1)


def _found(x: Column) -> Column:
    return F.when(x != "", x)


def id_of_name(path: Column) -> Column:
    return _found(F.regexp_extract(base_name(path), r"(?i)^([^_]+)_cefr_", 1))


def band_of_name(path: Column) -> Column:
    return F.upper(_found(F.regexp_extract(base_name(path), r"(?i)_cefr_([a-c][12])(_|\.|$)", 1)))


def level_of_name(path: Column) -> Column:
    return level(_found(F.regexp_extract(base_name(path), r"(?i)_level_([0-9]+)(_|\.|$)", 1)))


def integer_id(text: Column) -> Column:
    """The long that digits spell, with an optional fraction of zeros; else null."""
    t = F.trim(text)
    return F.when(t.rlike(r"^[0-9]+([.]0+)?$"), F.regexp_extract(t, r"^([0-9]+)", 1).try_cast("long"))


def guarded_share(part: Column, whole: Column) -> Column:
    """0 for 0 of 0, part / whole where 0 <= part <= whole, else null."""
    return F.when((part == 0) & (whole == 0), F.lit(0.0)).when((whole > 0) & (part >= 0) & (part <= whole), ratio(part, whole))


def per_hundred(part: Column, whole: Column) -> Column:
    """100 part / whole, 0 where whole is 0."""
    return F.when(whole != 0, 100.0 * part.cast("double") / whole.cast("double")).otherwise(F.lit(0.0))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def direction(r: Column) -> Column:
    return F.when(r.isNull(), "not calculable").when(r > 0, "positive").when(r < 0, "negative").otherwise("none")


def strength(r: Column) -> Column:
    """The band of |r|, each from its lower limit on."""
    a = F.abs(r)
    out = F.when(r.isNull(), F.lit("not calculable"))
    return reduce(lambda c, x: c.when(a < x[0], F.lit(x[1])), STRENGTH, out).otherwise(F.lit("very strong"))


def selection(in_mi: Column, in_ig: Column) -> Column:
    return F.when(in_mi & in_ig, "Both").when(in_mi, "MI only").when(in_ig, "IG only").otherwise("Neither")


def route(task: Column, target: Column) -> Column:
    """How a model's prediction reaches the target it is scored on."""
    return F.when(task == target, "direct").when((task == "level") & (target == "cefr"), "via level").otherwise("not applicable")


def word_bin(words: Column) -> Column:
    edges = [0, *WORD_BINS]
    out = F.when(words.isNull() | (words < 0), F.lit(None).cast("string"))
    for low, high in zip(edges, WORD_BINS, strict=False):
        out = out.when(words < high, F.lit(f"{low}-{high - 1}"))
    return out.otherwise(F.lit(f"{edges[-1]}+"))


def rounded_level(x: Column, most: int = LEVELS) -> Column:
    """Clipped to the levels and rounded half to even."""
    return F.rint(clamp(x, 1.0, float(most))).cast("int")


def feature_token(name: Column) -> Column:
    """Lower case, all but letters and digits collapsed to single underscores, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]+", "_"), "^_|_$", "")


def operation(error_type: Column) -> Column:
    """By what precedes the first colon, in any case."""
    head = F.upper(F.split(error_type, ":")[0])
    return F.when(head == "M", "missing").when(head == "U", "unnecessary").when(head == "R", "replacement").otherwise("other")


def family(error_type: Column) -> Column:
    """The second of the parts between colons in capitals, whatever the operation; OTHER where it is missing or empty."""
    part = F.upper(F.get(F.split(error_type, ":"), F.lit(1)))
    return F.when(part != "", part).otherwise(F.lit("OTHER"))


def column_part(name: Column, part: int) -> Column:
    """group (0), source (1) or feature (2) of a column named group__source__feature."""
    return F.split(name, "__")[part]


def band_index(band: Column) -> Column:
    return F.array_position(F.array(*[F.lit(b) for b in BANDS]), band)


def evidence(texts: Column, valid: Column) -> Column:
    """Whether a (feature, level) cell has enough texts and coverage to be judged."""
    return F.when(texts == 0, "no_texts").when(texts < MIN_TEXTS, "too_few").when(ratio(valid, texts) < MIN_COVERAGE, "too_many_missing").otherwise("sufficient")


def split_share(key: Column, seed: int = 42) -> Column:
    """A share in [0, 1) of a key from the first 16 hex digits of sha256("seed:key"), equal in every language."""
    digest = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256), 1, 16)
    return F.conv(digest, 16, 10).cast("decimal(20,0)").cast("double") / float(1 << 64)


def split_of(key: Column, train: float = 0.70, validation: float = 0.85, seed: int = 42) -> Column:
    s = split_share(key, seed)
    return F.when(s < train, "train").when(s < validation, "validation").otherwise("test")


def covered(spans: Column) -> Column:
    """Tokens that the union of spans (structs start, stop) covers; touching spans merge and empty ones don't count."""
    ordered = F.array_sort(F.filter(spans, lambda s: s["stop"] > s["start"]))
    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(None).cast("long").alias("end"))
    return F.aggregate(
        ordered, start,
        lambda a, s: F.struct((a["total"] + F.greatest(F.lit(0).cast("long"), s["stop"].cast("long") - F.greatest(s["start"].cast("long"), F.coalesce(a["end"], s["start"].cast("long"))))).alias("total"), F.greatest(a["end"], s["stop"].cast("long")).alias("end")),
        lambda a: a["total"],
    )


def fisher_z(r: Column, n: Column) -> Column:
    """atanh(|r|) sqrt(n - 3): null for n < 4 or |r| >= 1."""
    return F.when((n >= 4) & (F.abs(r) < 1), F.atanh(F.abs(r)) * F.sqrt((n - 3).cast("double")))
