"""URL rules by a sort-merge range join over reversed-host keys (operator 10). DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of a sorted sweep's partition, and at least so many for each rule, whose boundaries every partition has.
SWEEP_ROWS, ROWS_PER_RULE = 1_000, 10
#: Rules up to which their verdicts are broadcast.
BROADCAST = 100_000


def host_of(url: Column) -> Column:
    """What follows the first :// up to / ? # or the end, with A-Z lower-cased; empty for a null or without ://."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    """The canonical key of a host: its labels from the last to the first, each as hex digits and ended by a dot, which sorts
    below any digit. The hosts below h are then exactly the keys that begin with h's, from h's on up to h's with its last
    dot raised to a slash."""
    labels = F.transform(F.reverse(F.split(host, "[.]")), lambda x: F.hex(F.encode(x, "UTF-8")))
    return F.concat(F.array_join(labels, "."), F.lit("."))


def path_key(path: Column) -> Column:
    """The hex digits of a path. Paths that begin with p are those from p's key on up to p's key and a G."""
    return F.hex(F.encode(path, "UTF-8"))


def _swept(points: DataFrame, marks: DataFrame, group: list[str], to: str) -> DataFrame:
    """points with ``to`` of the last of the marks at or before their key in their group: both are sorted by key and swept
    once. points have the columns of group, key and others; marks those of group, key and to."""
    others = [c for c in points.columns if c not in (*group, "key")]
    kind = marks.schema[to].dataType
    both = points.withColumn("mark", F.lit(1)).withColumn(to, F.lit(None).cast(kind)).unionByName(marks.withColumn("mark", F.lit(0)), allowMissingColumns=True)
    sweep = Window.partitionBy(*group).orderBy("key", "mark").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn(to, F.last(to, ignorenulls=True).over(sweep)).where("mark = 1").select(*group, "key", *others, to)


def _host_marks(hosts: DataFrame) -> DataFrame:
    """(key, stack): from key on, up to the next one, the rules' hosts in stack are those a host is or lies below.

    A host's interval begins at its key and ends beyond the last host below it. Intervals are nested or disjoint, so at a
    begin the stack is the host's own and those it lies below, and at an end the latter alone."""
    labels = F.split("host", "[.]")
    above = F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), ".")))
    stacks = hosts.select("host", above.alias("above")).join(hosts.select(F.col("host").alias("above")), "above").groupBy("host").agg(F.array_sort(F.collect_list("above")).alias("stack"))
    key = host_key(F.col("host"))
    begin = F.struct(key.alias("key"), F.col("stack"))
    end = F.struct(F.concat(F.expr("substring(key, 1, length(key) - 1)"), F.lit("/")).alias("key"), F.array_remove("stack", F.col("host")).alias("stack"))
    return stacks.withColumn("key", key).select(F.explode(F.array(begin, end)).alias("e")).select("e.key", "e.stack")


def _path_marks(rules: DataFrame) -> DataFrame:
    """(at, key, path): of the rules of the host ``at``, from key on the one of ``path`` is the innermost ('-': none). A
    rule's interval is that of the paths that begin with its own; at its end the longest shorter one goes on."""
    prefixes = F.explode(F.sequence(F.lit(0), F.length("path") - 1))
    shorter = rules.where("path <> ''").select("host", "path", prefixes.alias("n")).select("host", "path", F.expr("substring(path, 1, n)").alias("outer"))
    known = rules.select("host", F.col("path").alias("outer"), F.lit(True).alias("known"))
    parent = shorter.join(known, ["host", "outer"]).groupBy("host", "path").agg(F.max_by("outer", F.length("outer")).alias("outer"))
    key = path_key(F.col("path"))
    begin = F.struct(key.alias("key"), F.concat(F.lit("+"), "path").alias("path"))
    end = F.struct(F.concat(key, F.lit("G")).alias("key"), F.coalesce(F.concat(F.lit("+"), "outer"), F.lit("-")).alias("path"))
    return rules.select("host", "path").join(parent, ["host", "path"], "left").select(F.col("host").alias("at"), F.explode(F.array(begin, end)).alias("e")).select("at", "e.key", "e.path")


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page.

    rules: (host, path, verdict), any number. A rule fits its host and all subdomains if the url's path starts with the
    rule's; the longest (host and path together, then the longer host) wins; ``default`` where none fits. rule is host and
    path together. Pages whose keys are equal get equal verdicts; repeated rules count once, the blocking one first; a
    null url has an empty host and path and fits only a rule of an empty host, of which there is none; an empty table
    gives no rows.

    Two sorted sweeps: one over the reversed hosts finds the stack of rules' hosts that a page's host is or lies below; for
    each of these another one over the paths finds the innermost rule. Pages are salted by page_id into partitions of
    about SWEEP_ROWS or more, each of which merges its sorted keys with the sorted marks of the rules; a host with very many
    pages is so spread evenly. Only page_id and url are read.
    """
    order = Window.partitionBy("host", "path").orderBy(F.col("verdict").desc())
    rules = rules.where("host <> '' and path is not null").select("host", "path", "verdict").withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")
    known = rules.count()
    salts = max(1, -(-pages.count() // max(SWEEP_ROWS, ROWS_PER_RULE * known)))
    own = pages.select("page_id", F.col("url").cast("string").alias("url"))
    own = own.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.monotonically_increasing_id().alias("row"))
    own = own.withColumn("salt", F.pmod(F.xxhash64("page_id", "row"), F.lit(salts)).cast("int"))
    width = int(salts**0.5) + 1

    def salted(marks: DataFrame) -> DataFrame:  # in two steps: no long array of all salts
        some = marks.withColumn("high", F.explode(F.sequence(F.lit(0), F.lit(salts // width)))).withColumn("low", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
        return some.withColumn("salt", F.col("high") * width + F.col("low")).where(F.col("salt") < salts).drop("high", "low")

    chained = _swept(own.withColumn("key", host_key(F.col("host"))), salted(_host_marks(rules.select("host").distinct())), ["salt"], "stack")
    asked = chained.select("salt", "row", "page_id", "host", F.col("path").alias("url_path"), F.explode_outer("stack").alias("at"), path_key(F.col("path")).alias("key"))
    hit = _swept(asked, salted(_path_marks(rules)), ["salt", "at"], "path")
    hit = hit.withColumn("path", F.when(F.col("path").startswith("+"), F.expr("substring(path, 2)")))
    verdicts = rules.select(F.col("host").alias("at"), "path", "verdict")
    hit = hit.join(F.broadcast(verdicts) if known <= BROADCAST else verdicts, ["at", "path"], "left")
    long = F.when(F.col("path").isNotNull(), F.length("at") + F.length("path"))
    best = F.max_by(F.struct(F.concat("at", "path").alias("rule"), "verdict"), F.struct(F.coalesce(long, F.lit(-1)), F.length("at")))
    out = hit.groupBy("salt", "row").agg(F.first("page_id").alias("page_id"), F.first("host").alias("host"), F.first("url_path").alias("path"), best.alias("b"))
    return out.select("page_id", "host", "path", "b.rule", F.coalesce("b.verdict", F.lit(default)).alias("verdict"))
