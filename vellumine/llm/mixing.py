"""Mixing sources to target weights by systematic sampling.

A share of all words is dealt to the sources by their weights. A source takes at most
``most`` times its own words; what is above goes to the others by weight, until none is
above. Within a source documents stand in the order of their sizes; each adds the
source's expected copies to a running sum that begins at one random offset, and is
emitted once for each whole number that the sum passes. So the copies of any stretch of
the order are within one of what is expected, and the words taken are within about one
largest document of the target. The offset is drawn from a seed and the source's name:
reruns agree, whatever the partitions.

Only ids, sources and sizes are shuffled. Places within a source come from
``numbering.numbered``: a source of any size is spread over tasks. Targets are filled in
rounds, each a sum over the sources; three numbers of a round come to the driver.

Cases: a null text has size 0. A null source is a source, the last one. A source without
a weight, or with a null or negative one, has target 0. Repeated rows each count. Ids
may be null or repeat; rows of the same source, size and id are alike to the order. An
empty table, or one without words, gives targets of 0. Columns beside those named aren't
carried, unless ``carry`` names them.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumine.llm.common import salted_join
from vellumine.operators.numbering import numbered
from vellumine.shared import BROADCAST_BYTES, cut, fresh

WORD = r"[^\x20\x09-\x0D]+"
#: Hex digits of the random offset: sums of offset and place stay exact in doubles.
OFFSET_DIGITS = 5


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _named(source: Column) -> Column:
    """A source as text that isn't null and sorts by code point, null last."""
    return F.coalesce(F.concat(F.lit("0"), source), F.lit("1"))


def cyclic_weights(docs: DataFrame, weights: list[int], *, source: str = "source") -> DataFrame:
    """source, weight: the sources in code point order, null last, have the weights in turn."""
    at = numbered(docs.select(_named(F.col(source)).alias("named"), F.col(source).alias("source")).distinct(), [F.col("named").asc()], "rank")
    return at.select("source", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("long").alias("weight"))


def targets(sizes: DataFrame, share: Fraction, most: int) -> DataFrame:
    """``sizes`` (named, size, weight) with the target of each source in words, exact until its last division.

    All sources begin as open. Those whose part of the open words would pass ``most`` times
    their size are full: they keep that, and the rest is dealt anew. Parts only grow, so a
    full source stays full and the rounds end.
    """
    whole = int(sizes.agg(F.sum("size")).first()[0] or 0)
    wide = lambda c: c.cast("decimal(38,0)")
    full, n_full, left, open_weight = F.lit(False), None, 0, 0
    while True:
        row = sizes.agg(F.sum(F.when(full, F.col("size"))).alias("held"), F.sum(F.when(~full, F.col("weight"))).alias("weight"), F.count_if(full).alias("n")).first()
        if row["n"] == n_full:
            break
        n_full = row["n"]
        left = share.numerator * whole - share.denominator * most * int(row["held"] or 0)
        open_weight = share.denominator * int(row["weight"] or 0)
        if not open_weight:
            break
        full = wide(F.lit(str(most * open_weight))) * wide(F.col("size")) <= wide(F.lit(str(left))) * wide(F.col("weight"))
    part = F.lit(0.0) if not open_weight else (F.lit(left) * F.col("weight")).cast("double") / F.lit(float(open_weight))
    return sizes.withColumn("target", F.when(full, (F.col("size") * most).cast("double")).otherwise(part))


def mix(docs: DataFrame, weights: DataFrame, *, share: Fraction = Fraction(3, 2), most: int = 2, seed: str = "mix", key: str = "doc_id", text: str = "text", source: str = "source", carry: tuple[str, ...] = ()) -> DataFrame:
    """Each row of ``docs``: key, size, source_size, target, copies, taken, and the columns ``carry``.

    ``weights`` has source and weight. ``share`` is the words of the mix over all words.
    """
    rows = cut(docs.select(F.col(key), _named(F.col(source)).alias("named"), words_of(F.col(text)).alias("size"), *(F.struct(*carry).alias(c) for c in ["carried"] if carry)), "sizes")
    weigh = weights.select(_named(F.col("source")).alias("named"), F.greatest(F.coalesce(F.col("weight"), F.lit(0)), F.lit(0)).cast("long").alias("weight")).groupBy("named").agg(F.max("weight").alias("weight"))
    sizes = rows.groupBy("named").agg(F.sum("size").alias("size")).join(weigh, "named", "left").withColumn("weight", F.coalesce("weight", F.lit(0)))
    filled = targets(cut(sizes, "sources"), share, most)
    offset = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), "named"), 256), 1, OFFSET_DIGITS), 16, 10).cast("double") / float(16**OFFSET_DIGITS)
    filled = filled.select("named", F.col("size").alias("source_size"), "target", F.when(F.col("size") > 0, F.col("target") / F.col("size")).otherwise(0.0).alias("rate"), offset.alias("offset"))

    placed = numbered(rows, [F.col("size").asc(), F.col(key).asc_nulls_last()], "place", per=["named"])
    few = filled.count() * 200 <= BROADCAST_BYTES
    held = placed.join(F.broadcast(filled), "named") if few else salted_join(placed, filled, "named", F.col("place"), "inner")
    passed = lambda n: F.floor(n * F.col("rate") + F.col("offset"))
    copies = F.least(passed(F.col("place") + 1) - passed(F.col("place")), F.lit(most)).cast("long")
    return held.select(key, "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), *(["carried.*"] if carry else []))


def mixed(docs: DataFrame, weights: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken. Whole rows are shuffled."""
    own = fresh(docs, stem="own")
    named = {options.get(c, d) for c, d in (("key", "doc_id"), ("text", "text"), ("source", "source"))}
    whole = docs.select(*named, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(own))
    taken = mix(whole, weights, **options, carry=(own,))
    return taken.select(F.explode(F.array_repeat(own, F.col("copies").cast("int"))).alias(own)).select(f"{own}.*")
