"""Consecutive numbers over whole tables and large groups: no task sees all rows of either."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumine.shared import cut, fresh, sized_join

#: monotonically_increasing_id() keeps the place within a partition in so many bits, the partition above them.
PLACE_BITS = 33


def numbered(df: DataFrame, order: list[Column], name: str = "n", *, per: list[str] | None = None) -> DataFrame:
    """``df`` with a long ``name``: 0, 1, 2, ... in ``order``, anew for each value of the columns ``per``.

    Rows are dealt by ranges of (per, order) and sorted; each takes its place in its partition and
    the number of rows that earlier partitions hold of its group. These counts have a row for each
    group and partition; a group of any size is spread over as many partitions as it fills. Nulls
    in ``per`` are a group. Rows that ``order`` doesn't tell apart get their numbers in any order.
    An empty table gives an empty result.
    """
    per = per or []
    place, part = fresh(df, stem="place"), fresh(df, stem="part")
    sort = [F.col(f"`{c}`").asc() for c in per] + order
    dealt = df.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn(place, F.monotonically_increasing_id())
    at = cut(dealt.withColumn(part, F.shiftright(place, PLACE_BITS)), "numbered")
    keys = [f"per{k}" for k in range(len(per))]
    held = at.groupBy(F.col(part).alias("held"), *(F.col(f"`{c}`").alias(k) for c, k in zip(per, keys))).agg(F.count("*").alias("rows"), F.min(place).alias("first"))
    before = Window.partitionBy(*keys).orderBy("held").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut(held.select("held", *keys, (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first")).alias("offset")), "offsets")
    same = reduce(lambda x, y: x & y, [at[part] == offsets["held"], *(at[f"`{c}`"].eqNullSafe(offsets[k]) for c, k in zip(per, keys))])
    found = sized_join(at, offsets, same, row_bytes=200)
    return found.select(*[at[f"`{c}`"] for c in df.columns if c != name], (at[place] + offsets["offset"]).alias(name))


def first_seen(df: DataFrame, key: str, order: list[Column], name: str = "id") -> DataFrame:
    """Each value of ``key`` once, with its place in the order in which the values come first; counts before any row moves."""
    lead = F.min(F.struct(*[c.alias(f"__o{k}") for k, c in enumerate(order)])).alias("__lead")
    return numbered(df.groupBy(key).agg(lead), [F.col("__lead").asc()], name).select(key, name)


def running_max(df: DataFrame, value: Column, order: list[Column], name: str, *, per: list[str], before: bool = True) -> DataFrame:
    """``df`` with ``name``: the largest ``value`` of the rows of its group so far in ``order``, of those before it or up to it.

    Each partition takes its own running maximum and the largest value of its group in earlier
    partitions, so that no task sees a whole group.
    """
    place, part, of = fresh(df, stem="place"), fresh(df, stem="part"), fresh(df, stem="of")
    sort = [F.col(f"`{c}`").asc() for c in per] + order
    dealt = df.withColumn(of, value).repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn(place, F.monotonically_increasing_id())
    at = cut(dealt.withColumn(part, F.shiftright(place, PLACE_BITS)), "running")
    keys = [f"per{k}" for k in range(len(per))]
    held = at.groupBy(F.col(part).alias("held"), *(F.col(f"`{c}`").alias(k) for c, k in zip(per, keys))).agg(F.max(of).alias("most"))
    earlier = Window.partitionBy(*keys).orderBy("held").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut(held.select("held", *keys, F.max("most").over(earlier).alias("earlier")), "offsets")
    own = Window.partitionBy(part, *(f"`{c}`" for c in per)).orderBy(place).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    local = at.withColumn(of, F.max(of).over(own))
    same = reduce(lambda x, y: x & y, [local[part] == offsets["held"], *(local[f"`{c}`"].eqNullSafe(offsets[k]) for c, k in zip(per, keys))])
    found = sized_join(local, offsets, same, row_bytes=200)
    return found.select(*[local[f"`{c}`"] for c in df.columns if c != name], F.greatest(local[of], offsets["earlier"]).alias(name))


def least_free(taken: DataFrame, name: str, number: str) -> DataFrame:
    """name, free: the least number from 1 on that a name doesn't hold. The k-th of its numbers is k until the first gap."""
    held = taken.where(F.col(number) >= 1).select(name, number).distinct()
    at = numbered(held, [F.col(number).asc()], "k", per=[name]).withColumn("k", F.col("k") + 1)
    gap = at.groupBy(name).agg(F.min(F.when(F.col(number) != F.col("k"), F.col("k"))).alias("gap"), (F.count("*") + 1).alias("next"))
    none = taken.select(name).distinct().join(held.select(name).distinct(), name, "left_anti").select(name, F.lit(1).cast("long").alias("free"))
    return gap.select(name, F.coalesce("gap", "next").alias("free")).unionByName(none)
