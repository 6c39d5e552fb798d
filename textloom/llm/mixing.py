"""Mixing sources to target weights by Pfair scheduling of blocks (operator 5). DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.llm import _scratch

#: Documents of a block, least slots of a stretch of the schedule that one row works out, documents of a numbering bucket.
BLOCK, PERIOD, BUCKET = 16, 1000, 2_000
#: Weights are whole parts of UNIT. A source has at least one slot in LONGEST (or in ten for each source, if that is more).
UNIT, LONGEST = 1_000_000_000, 100_000
#: Slots whose choices are folded into one array at a time.
FOLD = 500
#: Sources up to which their ranks are broadcast; it changes no result.
MOST = 2_000


def rates(weights: DataFrame) -> DataFrame:
    """(source, rate): weights as whole parts of UNIT that sum to it, by largest remainders; of sources with less than a slot
    in LONGEST (or ten for each source) that much. Ties go to the smaller source name; a row for each source."""
    every = Window.partitionBy(F.lit(0))
    least = F.ceil(F.lit(UNIT) / F.greatest(F.lit(LONGEST), 10 * F.count("*").over(every))).cast("long")
    w = weights.withColumn("least", least).withColumn("tiny", F.col("weight") / F.sum("weight").over(every) * UNIT < F.col("least"))
    w = w.withColumn("free", F.lit(UNIT) - F.sum(F.when(F.col("tiny"), F.col("least")).otherwise(F.lit(0))).over(every))
    rest = F.when(~F.col("tiny"), F.col("weight"))
    w = w.withColumn("exact", F.coalesce(rest / F.sum(rest).over(every) * F.col("free"), F.lit(0.0))).withColumn("whole", F.floor("exact"))
    w = w.withColumn("left", F.col("free") - F.sum("whole").over(every))
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("tiny", (F.col("exact") - F.col("whole")).desc(), "source"))
    w = w.withColumn("rank", rank)
    rate = F.when(F.col("tiny"), F.col("least")).otherwise(F.col("whole") + (F.col("rank") <= F.col("left")).cast("long"))
    return w.select("source", rate.cast("long").alias("rate"))


def _release(nth: str, rate: str = "x.rate") -> str:
    return f"(({nth}) * unit div {rate})"


def _deadline(nth: str, rate: str = "x.rate") -> str:
    return f"((({nth}) + 1) * unit + {rate} - 1) div {rate}"


def _begun(t: str) -> str:
    """SQL of the blocks that each source has before slot t in a state from which no deadline is missed: those due by t,
    and of the blocks under way as many of the earliest deadlines as there are slots left."""
    whole, part = f"(x.rate * {t} div unit)", f"x.rate * {t} % unit > 0"
    key = f"struct({_deadline(whole)} as due, i as i)"
    under_way = f"filter(transform(s, (x, i) -> if({part}, {key}, null)), y -> y is not null)"
    last = f"get(array_sort({under_way}), cast({t} - aggregate(s, 0L, (n, x) -> n + {whole}) as int) - 1)"
    return f"transform(array({last}), last -> transform(s, (x, i) -> {whole} + if({part} and {key} <= last, 1L, 0L)))[0]"


def _parted(state: str) -> str:
    """SQL of a state of ``_step``: the blocks done of each source, as many sources to a part as there are parts about."""
    return f"""transform(sequence(0L, (size({state}) - 1L) div width), j -> struct(slice({state}, cast(j * width as int) + 1, cast(width as int)) as done,
        9223372036854775807L as due, -1 as i, -1L as wake))"""


def _step(a: str, most: str = "9223372036854775807L") -> str:
    """SQL of the state after slot t, whose ``i`` of part ``k`` is the source of its block: of the released blocks that of the
    earliest deadline, of equal ones the first source's. A part is looked through only where it gave the slot before or a
    block of it is released; so a slot takes the sum of two parts' sources and of the parts, not of all sources."""
    x = "s[cast(j * width as int) + i]"
    release, deadline = _release("d", f"{x}.rate"), _deadline("d", f"{x}.rate")
    ready = f"d < {most.replace('#', 'cast(j * width as int) + i')}"
    look = f"transform(g.done, (d, i) -> if({ready}, if({release} <= t, struct({deadline} as due, i as i, 9223372036854775807L as wake), struct(9223372036854775807L as due, i as i, {release} as wake)), struct(9223372036854775807L as due, i as i, 9223372036854775807L as wake)))"
    fresh = f"transform({a}, (g, j) -> if(g.wake <= t, transform(array({look}), l -> transform(array(array_min(l)), b -> struct(g.done as done, b.due as due, b.i as i, array_min(transform(l, y -> y.wake)) as wake))[0])[0], g))"
    return f"""transform(array({fresh}), f -> transform(array(array_min(transform(f, (g, j) -> struct(g.due as due, j as j, g.i as i)))), b -> struct(b.j as j, b.i as i,
        transform(f, (g, j) -> if(j = b.j, struct(transform(g.done, (d, i) -> if(i = b.i, d + 1, d)) as done, g.due as due, g.i as i, -1L as wake), g)) as parts, f[b.j].done[b.i] as nth))[0])[0]"""


def _edge(t: str) -> str:
    """SQL of the blocks of each source before slot t: earliest deadline first over the longest window before t."""
    since = f"greatest(0L, {t} - longest)"
    steps = f"if({t} > {since}, sequence({since}, {t} - 1), cast(array() as array<bigint>))"
    return f"aggregate({steps}, {_parted(_begun(since))}, (a, t) -> {_step('a')}.parts, a -> flatten(transform(a, g -> g.done)))"


def schedule(rate: DataFrame, slots: int | str, by: tuple[str, ...] = (), period: int = PERIOD) -> DataFrame:
    """(by, slot, source, nth, release, deadline): which block of which source has each of the first ``slots`` slots (a number
    or a column of the group's), for the sources (source, rate) of each group.

    A source's nth block is released at floor(nth / w) and due at ceil((nth + 1) / w), w its rate's part of the sum. Every
    slot has a block of earliest deadline, so no block is late, and a source's blocks before any slot t differ from w * t
    by less than one, however long the run is.

    A row works out one stretch of slots by itself. The blocks before its ends come from earliest deadline first over the
    longest window before each, begun with ``_begun``: what is released in that window is then done in its time, and what was
    released before is done, so both ends can be reached and left without a late block.
    """
    parts = rate.sparkSession.sparkContext.defaultParallelism
    own = rate.withColumn("slots", F.lit(slots).cast("long") if isinstance(slots, int) else F.col(slots).cast("long"))
    row = own.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("source", "rate"))).alias("s"), F.sum("rate").alias("unit"), F.min("rate").alias("least"), F.max("slots").alias("slots"))
    row = row.where("slots > 0").withColumn("longest", F.expr("(unit + least - 1) div least + 1")).withColumn("length", F.greatest(F.lit(period).cast("long"), "longest"))
    row = row.withColumn("width", F.ceil(F.sqrt(F.size("s"))))
    each = row.withColumn("p", F.explode(F.expr("sequence(0L, (slots - 1) div length)"))).withColumn("low", F.expr("p * length")).withColumn("high", F.expr("least((p + 1) * length, slots)"))
    each = each.drop("p", "least", "slots").repartition(parts)
    chosen = f"""transform(array(struct({_edge('low')} as done, {_edge('high')} as upto)), v -> aggregate(sequence(low, high - 1, {FOLD}L),
          struct({_parted('v.done')} as parts, cast(array() as array<struct<k: int, nth: bigint>>) as out),
          (c, t0) -> transform(array(aggregate(sequence(t0, least(t0 + {FOLD}L, high) - 1),
            struct(c.parts as parts, cast(array() as array<struct<k: int, nth: bigint>>) as out),
            (a, t) -> transform(array({_step('a.parts', 'v.upto[#]')}), b -> struct(b.parts as parts,
              concat(a.out, array(struct(cast(b.j * width as int) + b.i as k, b.nth as nth))) as out))[0])),
            f -> struct(f.parts as parts, concat(c.out, f.out) as out))[0],
          c -> c.out))[0]"""
    out = each.select(*by, "s", "unit", "low", F.posexplode(F.expr(chosen)).alias("pos", "it"))
    out = out.select(*by, (F.col("low") + F.col("pos")).alias("slot"), F.expr("s[it.k]").alias("x"), "unit", F.col("it.nth").alias("nth"))
    return out.select(*by, "slot", "x.source", "nth", F.expr(_release("nth")).alias("release"), F.expr(_deadline("nth")).alias("deadline"))


def nested_schedule(rate: DataFrame, slots: int, groups: int, period: int = PERIOD) -> DataFrame:
    """(slot, source, nth) in two levels, for callers that want a cheaper slot than ``schedule``'s; ``mix`` doesn't: sources are dealt to groups by a hash, the groups' rates
    are scheduled like sources', and so are each group's sources over the slots that it got. A source is less than two
    blocks from its weight."""
    own = rate.withColumn("group", F.pmod(F.xxhash64("source"), F.lit(groups)).cast("string"))
    outer = schedule(own.groupBy(F.col("group").alias("source")).agg(F.sum("rate").alias("rate")), slots, (), period)
    outer = outer.select(F.col("source").alias("group"), F.col("nth").alias("turn"), "slot")
    got = outer.groupBy("group").agg(F.count("*").alias("got"))
    inner = schedule(own.join(got, "group"), "got", ("group",), period).select("group", F.col("slot").alias("turn"), "source", "nth")
    return inner.join(outer, ["group", "turn"]).select("slot", "source", "nth")


def target_weights(docs: DataFrame, power: float = 0.7) -> DataFrame:
    """(source, weight): each source's number of documents to a power below 1, which raises small sources."""
    return docs.groupBy(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source")).agg(F.pow(F.count("*").cast("double"), F.lit(power)).alias("weight"))


def mix(docs: DataFrame, weights: DataFrame | None = None, block: int = BLOCK, period: int = PERIOD) -> DataFrame:
    """(doc_id, row, source, block, slot, release, deadline, offset) of every document; sorting by (slot, offset) mixes.

    A source's documents, in the order of a hash of their ids, form blocks of ``block``, scheduled by the weights' parts of
    their sum. Every document has exactly one place: nothing is dropped or repeated. Until the first source runs out, every
    source's blocks before any slot t differ from t times its rate by less than one, for any number of sources, and a rate
    from its weight by less than a part of UNIT, which is a block in a thousand million slots; blocks
    after that go by their deadlines, with room for all sources between two deadlines, so
    that slots of sources that ran out stay empty. A null source is the source ''; rows of a null doc_id go in the order of
    a hash of their number; repeated rows are rows; weights of sources without documents don't count, a source without a
    positive weight gets one block in LONGEST slots; an empty table gives no rows.

    Rows are numbered within buckets of about BUCKET documents of a source, which are ranges of the hash, and the buckets by
    their counts, so that a source with most of the rows is spread over many tasks and the order is the hash's, however
    many buckets there are. Only ids and sources are shuffled.
    """
    rows = docs.select(F.col("doc_id"), F.col("source"), F.monotonically_increasing_id().alias("row"))
    return _placed(_scratch.written(rows, "mix-ids"), weights, block, period)


def _placed(docs: DataFrame, weights: DataFrame | None, block: int, period: int) -> DataFrame:
    """``mix`` for docs of doc_id, source and row, a number that tells rows apart."""
    if weights is None:
        weights = target_weights(docs)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), "row")
    buckets = max(1, -(-own.count() // BUCKET))
    # rows without an id are told apart by their number, else they would all have one hash
    own = own.withColumn("order", F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("row")))).withColumn("bucket", F.shiftright((F.shiftright("order", 32) + (1 << 31)) * buckets, 32))
    counts = own.groupBy("source", "bucket").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("source", "bucket", before.alias("start"))
    asked = weights.groupBy("source").agg(F.max("weight").alias("weight"))
    there = counts.groupBy("source").agg(F.ceil(F.sum("n") / block).alias("blocks")).join(asked, "source", "left")
    there = there.select("source", "blocks", F.greatest(F.coalesce(F.col("weight").cast("double"), F.lit(0.0)), F.lit(1e-12)).alias("weight"))
    rate = _scratch.written(rates(there).join(there.select("source", "blocks"), "source"), "mix-rates")
    # slots until the first source runs out: at most as many as there are blocks
    sources, after = rate.select(F.count("*"), F.coalesce(F.min(F.expr(f"(blocks * {UNIT} + rate - 1) div rate")), F.lit(0))).first()
    plan = schedule(rate, after, (), period).select("source", F.col("nth").alias("block"), "slot")
    numbered = own.withColumn("i", F.row_number().over(Window.partitionBy("source", "bucket").orderBy("order", "doc_id", "row")) - 1)
    numbered = numbered.join(F.broadcast(starts) if buckets * sources <= LONGEST else starts, ["source", "bucket"])
    nth = F.col("start") + F.col("i")
    numbered = numbered.select("doc_id", "row", "source", F.floor(nth / block).cast("long").alias("block"), F.pmod(nth, F.lit(block)).cast("int").alias("offset"))
    named = rate.select("source", "rate", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("source")) - 1).alias("rank"))
    placed = numbered.join(F.broadcast(named) if sources <= MOST else named, "source").join(plan, ["source", "block"], "left").withColumn("unit", F.lit(UNIT).cast("long"))
    placed = placed.withColumn("release", F.expr(_release("block", "rate"))).withColumn("deadline", F.expr(_deadline("block", "rate")))
    # what comes later, by deadline and source, in slots of its own
    late, wide = F.col("slot").isNull(), F.lit(int(sources)).cast("long")
    slot = F.when(late, after + F.col("deadline") * wide + F.col("rank")).otherwise(F.col("slot"))
    release = F.when(late, after + F.col("release") * wide).otherwise(F.col("release"))
    deadline = F.when(late, after + (F.col("deadline") + 1) * wide).otherwise(F.col("deadline"))
    return placed.select("doc_id", "row", "source", "block", slot.alias("slot"), release.alias("release"), deadline.alias("deadline"), "offset")


def mixed(docs: DataFrame, weights: DataFrame | None = None, block: int = BLOCK, period: int = PERIOD) -> DataFrame:
    """docs, whole rows with their columns, in the order of the mix: written files in name order hold ascending places. Null
    doc_ids and sources, repeated rows and an empty table are as in ``mix``.

    Rows are numbered once, in a written table, so that a task that runs again finds the same numbers."""
    numbered = _scratch.written(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.monotonically_increasing_id().alias("row")), "mix-rows")
    places = _placed(numbered.select("doc.doc_id", "doc.source", "row"), weights, block, period).select("row", "slot", "offset")
    return numbered.join(places, "row").orderBy("slot", "offset", "row").select(*[F.col(f"doc.`{c}`") for c in docs.columns])
