"""Running sums over sorted values of few groups, without a window that has all of a group's rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Ranges between two powers of two.
STEPS = 256


def range_of(value: Column) -> Column:
    """A whole number that never falls where the value rises: sign, power of two and STEPS parts between two powers. Values
    of a group so fall into many ranges, by a rule that needs no pass over them; equal values share one."""
    size = F.least(F.abs(value.cast("double")), F.lit(1.7e308))
    power = F.floor(F.log2(size))
    # a power that rounding put one too low gives the next one's first part
    part = (power + 1100) * STEPS + F.floor((size / F.pow(F.lit(2.0), power.cast("double")) - 1) * STEPS)
    return F.when(F.isnan(value.cast("double")), F.lit(3000 * STEPS)).when(size == 0, F.lit(0)).when(value > 0, part).otherwise(-part).cast("long")


def running(cells: DataFrame, group: list[str], order: str, sums: list[str], then: list[str] = ()) -> DataFrame:
    """cells with, for each column of sums, ``<column>_upto``: its sum over the group's rows up to this one by order (and
    then the columns of ``then``; rows equal in all of them count together), and ``<column>_all``: over the whole group.

    Windows cover one range of a group's values; the sums of the ranges before are added from a row for each range."""
    keys = [*group, "_range"]
    ranged = cells.withColumn("_range", range_of(F.col(order)))
    inner = Window.partitionBy(*keys).orderBy(order, *then)
    ranged = ranged.withColumns({f"{c}_upto": F.sum(c).over(inner) for c in sums})
    total = cells.withColumn("_range", range_of(F.col(order))).groupBy(*keys).agg(*[F.sum(c).alias(f"_{c}") for c in sums])
    line, every = Window.partitionBy(*group).orderBy("_range"), Window.partitionBy(*group)
    before = total.select(*keys, *[(F.sum(f"_{c}").over(line) - F.col(f"_{c}")).alias(f"_{c}") for c in sums], *[F.sum(f"_{c}").over(every).alias(f"{c}_all") for c in sums])
    out = ranged.join(before, keys)
    return out.select(*cells.columns, *[(F.col(f"{c}_upto") + F.col(f"_{c}")).alias(f"{c}_upto") for c in sums], *[f"{c}_all" for c in sums])


def following(values: DataFrame, group: list[str], order: str, name: str) -> DataFrame:
    """Distinct values of groups with the next larger one of the group (null for the last) as ``name``."""
    keys = [*group, "_range"]
    ranged = values.withColumn("_range", range_of(F.col(order)))
    inner = Window.partitionBy(*keys).orderBy(order)
    ranged = ranged.withColumn(name, F.lead(order).over(inner))
    least = values.withColumn("_range", range_of(F.col(order))).groupBy(*keys).agg(F.min(order).alias("_least"))
    after = least.select(*keys, F.lead("_least").over(Window.partitionBy(*group).orderBy("_range")).alias("_after"))
    return ranged.join(after, keys).withColumn(name, F.coalesce(name, "_after")).select(*values.columns, name)


def neighbours(cells: DataFrame, group: list[str], order: str, column: str, k: int) -> DataFrame:
    """cells, with distinct values of ``order`` in a group, with ``near``: an array of (distance, column) of the k values before
    and the k after each in its group, in any order.

    Windows cover one range of values; only the k first and k last values of each range are also looked at across ranges,
    where all between such a value and its neighbours are of this kind."""
    keys = [*group, "_range"]
    inner, line = Window.partitionBy(*keys).orderBy(order), Window.partitionBy(*group).orderBy(order)
    back = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    names = [(f"_{side}{j}{what}", move(of, j)) for side, move in (("b", F.lag), ("a", F.lead)) for j in range(1, k + 1) for what, of in (("v", order), ("c", column))]
    ranged = cells.withColumn("_range", range_of(F.col(order)))
    ranged = ranged.withColumns({n: f.over(inner) for n, f in names} | {"_first": F.row_number().over(inner), "_last": F.row_number().over(back)})
    ends = ranged.where((F.col("_first") <= k) | (F.col("_last") <= k))
    ends = ends.select(*group, order, *[f.over(line).alias(f"{n}_") for n, f in names])
    out = ranged.join(ends, [*group, order], "left")
    both = lambda n: F.coalesce(n, f"{n}_")
    near = [F.struct(F.abs(F.col(order) - both(f"_{side}{j}v")).alias("d"), both(f"_{side}{j}c").alias("c")) for side in "ba" for j in range(1, k + 1)]
    return out.select(*cells.columns, F.filter(F.array(*near), lambda x: x["d"].isNotNull()).alias("near"))
