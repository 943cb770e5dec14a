"""Which texts contain which probes: joins on anchors, verified in place.

A word of a probe with white space on both sides is a whole word of every text that contains
the probe. The rarest such word is the probe's anchor: words of texts are joined to anchors
by equality, and only the texts that hold one are searched. Probes without such a word are
anchored by their rarest short run of characters in the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumine.shared import cut, sized_join

GRAM = 3
_WORD = r"(?<=\s)\S+(?=\s)"


def _words(text: Column) -> Column:
    return F.array_distinct(F.split(text, r"\s+"))


def _grams(text: Column, size: int) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), 1))


def _anchored(texts: DataFrame, probes: DataFrame, keys: Column, of_text: Column) -> DataFrame:
    """copy, probe: texts that hold a probe's rarest key. Keys are hashed; a clash only adds a text to search."""
    hashed = lambda c: F.transform(c, lambda k: F.xxhash64(k))
    asked = cut(probes.select("probe", F.explode(hashed(keys)).alias("key")), "asked")
    held = texts.select("copy", F.explode(hashed(of_text)).alias("key"))
    seen = cut(sized_join(held, asked.select("key").distinct(), "key", "left_semi", row_bytes=24).groupBy("key").count(), "seen")
    ranked = asked.join(seen, "key", "left").groupBy("probe").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "key")).alias("rarest"))
    anchors = cut(ranked.where("rarest.n > 0").select("probe", F.col("rarest.key").alias("key")), "anchors")
    return sized_join(held, anchors, "key", row_bytes=400).select("copy", "probe")


def containing(docs: DataFrame, probes: DataFrame, *, text: str = "text", probe: str = "probe") -> DataFrame:
    """Each row of ``docs`` with each distinct ``probe`` that its text contains. Null probes and texts contain nothing; an empty probe is in every text."""
    each = cut(probes.select(F.col(probe).alias("probe")).where("probe is not null").distinct(), "probes")
    texts = docs.where(F.col(text).isNotNull()).select(F.xxhash64(text).alias("copy"), F.col(text).alias("text"))
    inner = F.array_distinct(F.regexp_extract_all("probe", F.lit(_WORD), F.lit(0)))
    worded = each.where(F.size(inner) > 0)
    found = _anchored(texts, worded, inner, _words(F.col("text")))
    for size in range(1, GRAM + 1):
        short = each.where(F.size(inner) == 0).where(F.length("probe") == size if size < GRAM else F.length("probe") >= size)
        if not short.isEmpty():
            found = found.unionByName(_anchored(texts, short, _grams(F.col("probe"), size), _grams(F.col("text"), size)))
    hits = cut(found.distinct(), "hits")
    held = docs.withColumn("__copy", F.xxhash64(text))
    met = sized_join(held, hits, F.col("__copy") == F.col("copy"), row_bytes=400).where(F.contains(F.col(text), F.col("probe"))).drop("__copy", "copy")
    empty = docs.where(F.col(text).isNotNull()).withColumn("probe", F.lit("")) if not each.where("probe = ''").isEmpty() else None
    return met if empty is None else met.unionByName(empty)
