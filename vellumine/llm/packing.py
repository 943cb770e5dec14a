"""Best-fit packing of documents into training sequences, under conflicts.

A bin holds at most ``CAPACITY`` words and never two pieces of one source or of one
duplicate cluster. Bins are ordered by what is left in them. Each bin carries a bitmap
of its sources and one of its clusters; a piece looks for the tightest bin that it fits
and goes on to the next while bitmaps conflict. A longer document is cut into full
pieces, each a bin of its own, and a rest that is packed.

Rows are dealt by hash to shards of about ``SHARD_ROWS`` pieces, so one source or cluster
is spread evenly and a task's work is bounded; shards are packed apart, pieces by falling
size. Only numbers are shuffled, no text.

Cases: null and empty texts are pieces of no words and take a place in a bin. A null
source conflicts with nothing. Rows with a null doc_id are packed. Repeated rows are of
one cluster and so go to different bins. An empty table gives an empty result. Extra
columns are left out.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumine.llm.common import carried, restored
from vellumine.shared import cut

CAPACITY = 2048
SHARD_ROWS = 8192
_SHIFT = 32


def cluster_of(text: Column) -> Column:
    """A hash of the lower-cased words: copies that differ in case or white space are one cluster."""
    return F.xxhash64(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " ")))


def pack_shard(sizes: list[int], sources: list, clusters: list, capacity: int) -> list[int]:
    """The bin of each piece; pieces come in the order in which they are placed."""
    many = [s for s, n in Counter(x for x in sources if x is not None).items() if n > 1]
    source_bit = {s: 1 << i for i, s in enumerate(many)}
    cluster_bit = {c: 1 << i for i, c in enumerate(c for c, n in Counter(clusters).items() if n > 1)}
    holders: Counter = Counter()  # bins that hold a source
    left: list[int] = []  # room << _SHIFT | bin, in order
    in_source: list[int] = []
    in_cluster: list[int] = []
    placed = []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        s, c = source_bit.get(source, 0), cluster_bit.get(cluster, 0)
        at = bisect_left(left, size << _SHIFT) if holders[source] < len(in_source) or not s else len(left)
        while at < len(left) and (in_source[b := left[at] & ((1 << _SHIFT) - 1)] & s or in_cluster[b] & c):
            at += 1
        if at < len(left):
            room = (left.pop(at) >> _SHIFT) - size
        else:
            b, room = len(in_source), capacity - size
            in_source.append(0)
            in_cluster.append(0)
        in_source[b] |= s
        in_cluster[b] |= c
        if s:
            holders[source] += 1
        insort(left, room << _SHIFT | b)
        placed.append(b)
    return placed


def pack(docs: DataFrame, *, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """bin_id, doc_id, piece (from 0), first_word, n_words: each row of ``docs`` in one or more rows."""
    words = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"\S+")).cast("long")
    sized = cut(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), cluster_of(F.col(text)).alias("cluster"), words.alias("words")), "sizes")
    full = F.floor(F.col("words") / capacity).cast("int")
    rest = F.col("words") % capacity
    whole = sized.where(full > 0).select("doc_id", F.posexplode(F.sequence(F.lit(1), full)).alias("piece", "_")).select("doc_id", "piece", F.lit(capacity).cast("long").alias("n_words"))
    rests = sized.where((rest > 0) | (F.col("words") == 0)).select("doc_id", "source", "cluster", full.alias("piece"), rest.alias("n_words"))
    shards = max(1, -(-rests.count() // shard_rows))
    rests = rests.withColumn("shard", F.pmod(F.xxhash64("doc_id", "cluster", F.lit("shard")), F.lit(shards)))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["n_words", "order", "cluster"], ascending=[False, True, True], kind="stable")
        sources = [None if pd.isna(s) else s for s in part["source"]]
        bins = pack_shard(part["n_words"].tolist(), sources, part["cluster"].tolist(), capacity)
        return pd.DataFrame({"bin_id": [int(part["shard"].iloc[0]) << _SHIFT | b for b in bins], "doc_id": part["doc_id"], "piece": part["piece"], "n_words": part["n_words"]})

    rests = rests.withColumns({"order": F.col("doc_id"), "doc_id": carried("doc_id")})
    packed = restored(rests.groupBy("shard").applyInPandas(run, "bin_id long, doc_id string, piece int, n_words long"), "doc_id")
    # full pieces: negative bins, one each
    alone = whole.select((-1 - F.monotonically_increasing_id()).alias("bin_id"), "doc_id", "piece", "n_words")
    both = packed.unionByName(alone)
    return both.select("bin_id", "doc_id", "piece", (F.col("piece").cast("long") * capacity).alias("first_word"), "n_words")
