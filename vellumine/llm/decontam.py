"""Benchmark passages in documents by spaced seeds (DataFrame functions only).

A text is its runs of letters and digits, lower-cased. A mask looks at five of up to
eight neighbouring tokens and ignores the rest, so a seed survives substitutions at the
ignored positions. The three masks together leave no passage out that is accepted: they
hit any ten tokens of which two are changed, and any fifteen to nineteen with three.
(Twenty or more with a fifth changed hold ten with two.) Seeds of documents and benchmark
items are joined on their hashes; each hit names a diagonal (item, shift). On each diagonal
all tokens are then compared. A document leaks an item if ``IDENTITY`` of the item's tokens
agree, or if that share agrees in some stretch of ``STRETCH`` tokens.

Items under ten tokens have masks of their own: whole, or with each third of them left
out in turn where one token can be changed. Masks begin and end with a token that they
look at, so passages at either end of a document are found. Hits are keyed by the
text's hash, so copies of a text are verified alike; a collision only adds a comparison.

Cases: null texts have no tokens; documents and items without tokens leak nothing.
Null ids are kept in the output. Repeated documents and repeated items
count once. Empty tables give empty results. Columns that clash with the result's are
not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumine.llm.common import BROADCAST_BYTES, salted_join, sized_join
from vellumine.shared import cut, fresh

#: Which of neighbouring tokens each mask looks at, for items of ``LEAST`` tokens or more.
MASKS = ("111011", "11001011", "11111")
LEAST = 10
IDENTITY = 0.8
STRETCH = 13
#: Bytes that a seed takes in a broadcast table, amply.
SEED_BYTES = 120


def tokens(text: Column) -> Column:
    """Hashes of the lower-cased runs of letters and digits."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def masks_of(n: int) -> tuple[str, ...]:
    """The masks that find an item of ``n`` tokens wherever ``IDENTITY`` of them agree."""
    if n >= LEAST:
        return MASKS
    if n - IDENTITY * n < 1 - 1e-9:
        return ("1" * n,)
    cuts = [n * k // 3 for k in range(4)]
    return tuple(("1" * a + "0" * (b - a) + "1" * (n - b)).strip("0") for a, b in zip(cuts, cuts[1:]))


def _seeds(rows: DataFrame, keys: list[str], masks: list[str], pad: int) -> DataFrame:
    """keys, at, seed: every seed of the column ``seq``, which ``pad`` follows."""
    span = max(map(len, masks))
    padded = rows.select(*keys, F.size("seq").alias("n"), F.concat("seq", F.array_repeat(F.lit(pad).cast("long"), span - 1)).alias("seq"))
    windows = F.arrays_zip(*(F.slice("seq", F.lit(i + 1), F.col("n")).alias(f"t{i}") for i in range(span)))
    windows = padded.select(*keys, F.posexplode(windows).alias("at", "w"))
    picked = [F.xxhash64(F.lit(m), *(F.col("w")[f"t{i}"] for i, bit in enumerate(m) if bit == "1")) for m in masks]
    return windows.select(*keys, "at", F.explode(F.array(*picked)).alias("seed"))


def _agreement(seq: Column, item: Column, shift: Column) -> Column:
    """For each token of the item 1 if the document's token on the diagonal is the same."""
    at = F.sequence(F.lit(0), F.size(item) - 1)
    return F.transform(at, lambda i: F.when((i + shift >= 0) & (i + shift < F.size(seq)) & (F.try_element_at(seq, F.greatest(i + shift, F.lit(0)) + 1) == F.element_at(item, i + 1)), 1).otherwise(0))


def leaks(docs: DataFrame, benchmark: DataFrame, *, identity: float = IDENTITY, stretch: int = STRETCH) -> DataFrame:
    """doc_id, copy (hash of the text), item_id, matched, item_tokens, at (first token in the document).

    One row for each document and item that it leaks; of several places the best.
    """
    items = benchmark.select("item_id", tokens(F.col("text")).alias("seq")).where(F.size("seq") > 0).distinct()
    items = cut(items.withColumn("item", F.xxhash64("item_id", "seq")), "benchmark")
    short = sorted(r["n"] for r in items.where(F.size("seq") < LEAST).select(F.size("seq").alias("n")).distinct().collect())
    wanted = _seeds(items.where(F.size("seq") >= LEAST), ["item"], list(MASKS), 1)
    for n in short:
        wanted = wanted.unionByName(_seeds(items.where(F.size("seq") == n), ["item"], list(masks_of(n)), 1))
    wanted = wanted.withColumnRenamed("at", "item_at").distinct()
    masks = list(dict.fromkeys([*MASKS, *(m for n in short for m in masks_of(n))]))
    source = docs.select(F.xxhash64("text").alias("copy"), tokens(F.col("text")).alias("seq"))
    hits = _met(_seeds(source, ["copy"], masks, 0), wanted, "seed", F.col("copy"), SEED_BYTES)
    hits = cut(hits.select("copy", "item", (F.col("at") - F.col("item_at")).alias("shift")).distinct(), "seed-hits")

    # each text with hits once, its diagonals beside it
    held = docs.select(F.xxhash64("text").alias("copy"), "text")
    held = sized_join(held, hits.select("copy").distinct(), "copy", "left_semi", row_bytes=40).dropDuplicates(["copy"])
    held = sized_join(held.select("copy", tokens(F.col("text")).alias("seq")), hits, "copy", row_bytes=64)
    sized = items.agg(F.sum(F.size("seq") * 8 + 64)).first()[0] or 0
    known = items.select("item", "item_id", F.col("seq").alias("item_seq"))
    pairs = held.join(F.broadcast(known) if sized <= BROADCAST_BYTES else known, "item")
    same = pairs.withColumn("same", _agreement(F.col("seq"), F.col("item_seq"), F.col("shift"))).drop("seq")
    n = F.size("same")
    total = F.aggregate("same", F.lit(0), lambda a, x: a + x)
    starts = F.sequence(F.lit(1), F.greatest(n - (stretch - 1), F.lit(1)))
    best = F.array_max(F.transform(starts, lambda i: F.aggregate(F.slice("same", i, stretch), F.lit(0), lambda a, x: a + x)))
    judged = same.withColumns({"matched": total, "run": best, "item_tokens": n})
    leaked = judged.where((F.col("matched") >= identity * F.col("item_tokens")) | ((F.col("item_tokens") >= stretch) & (F.col("run") >= identity * stretch)))

    place = F.max(F.struct("matched", (-F.col("shift")).alias("back"))).alias("p")
    found = cut(leaked.groupBy("copy", "item", "item_id", "item_tokens").agg(place), "leaks")
    rows = _met(docs.select("doc_id", F.xxhash64("text").alias("copy")).distinct(), found, "copy", F.col("doc_id"), 64)
    return rows.select("doc_id", "copy", "item_id", F.col("p.matched").alias("matched"), "item_tokens", F.greatest(-F.col("p.back"), F.lit(0)).alias("at"))


def _met(large: DataFrame, small: DataFrame, key: str, by: Column, row_bytes: int) -> DataFrame:
    """The inner join by ``key``; beyond a broadcast the rows of a frequent key are dealt to several tasks."""
    few = small.count() * row_bytes <= BROADCAST_BYTES
    return large.join(F.broadcast(small), key) if few else salted_join(large, small, key, by, "inner", salts=8)


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, identity: float = IDENTITY, stretch: int = STRETCH) -> DataFrame:
    """The rows of ``docs`` that leak no item, with their columns."""
    copy = fresh(docs, stem="copy")
    bad = cut(leaks(docs, benchmark, identity=identity, stretch=stretch).select(F.col("copy").alias(copy)).distinct(), "leaking")
    kept = sized_join(docs.withColumn(copy, F.xxhash64("text")), bad, copy, "left_anti", row_bytes=40)
    return kept.select(*docs.columns)
