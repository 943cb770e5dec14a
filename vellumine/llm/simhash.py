"""SimHash near-duplicates with a Gray-order hierarchical index.

Fingerprints are computed in one pass, without a shuffle. Distinct fingerprints are
dealt to buckets by an exact block of their bits: two that differ in at most
``radius`` bits agree on one of ``radius + 1`` blocks. In a bucket they are sorted by
Gray rank and indexed: consecutive fingerprints form a node, whose mask holds the bits
on which all agree; masks shared by several nodes move to a parent. A search adds up
the differences along a path and leaves a whole group when the sum passes the radius.
A bucket over ``BUCKET_ROWS`` fingerprints is dealt anew by blocks of the bits that are
left, up to ``LEVELS`` times; what then agrees on so many bits is bounded in number.
Each bucket sends a spanning forest, not its pairs; distributed star contraction
joins the forests to components.

Cases: null and empty texts have fingerprint zero and are linked like any other.
Rows with a null doc_id keep their fingerprint and component, but never name one
(a component of such rows alone has a null id). Repeated rows stay. An empty table
gives an empty result. Other columns of the input are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellumine.llm.common import BROADCAST_BYTES, carried, restored, salted_join, sized_join
from vellumine.shared import cut, fresh

SEED = 42
BITS = 64
RADIUS = 2
#: Fingerprints in a bucket from which it is dealt anew.
BUCKET_ROWS = 20_000
LEVELS = 3
#: Children of a node.
FANOUT = 16
#: Pairs of query and node that are looked at together.
FRONTIER = 1 << 20
#: The near-duplicate stage: words of a shingle and least similarity.
SHINGLE, SIMILARITY = 5, 0.8
#: Its candidates: fingerprints of single words, which small changes move least, within this
#: radius, and bins and least agreement of the shingle sketches that they are held against.
STAGE_WIDTH, STAGE_RADIUS, BINS, SKETCH_LEAST = 1, 4, 64, 0.5
#: Texts that are drawn to find frequent shingles, and texts of these from which one is frequent:
#: they only set the order of shingles, and any order gives all candidates.
DRAWN, FREQUENT, MOST_FREQUENT = 20_000, 8, 1 << 20
#: Texts, and shingles in them, that a task compares with each other.
GROUP_ROWS, GROUP_SHINGLES = 1_000, 2_000_000
#: Texts of one shingle from which they are linked without a look at their sketches.
HOT_ROWS = 2_000
#: Hashes whose bits are counted together.
HASHES = 1 << 15


def _hashes(joined: bytes, width: int, seed: int) -> np.ndarray:
    """The XXH64 of each ``width``-word shingle of words joined by spaces, or of them all if there are fewer; repeats stay."""
    ends, at = [], -1
    for n in map(len, joined.split(b" ")):
        at += n + 1
        ends.append(at)
    count = max(1, len(ends) - width + 1)
    starts = [0, *(e + 1 for e in ends[: count - 1])]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, ends[min(width, len(ends)) - 1 :], strict=True)), np.uint64, count)


def fingerprint(text: str | None, width: int = 3) -> int:
    """The SimHash of the ``width``-word shingles, as an unsigned number."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    hashes = _hashes(b" ".join(words), width, SEED)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), HASHES):
        part = hashes[i : i + HASHES].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, width: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fps = np.fromiter((fingerprint(t, width) for t in b["_text"]), np.uint64, len(b)).view(np.int64)
            yield pd.DataFrame({"doc_id": b["_id"], "fp": fps})

    return restored(docs.select(carried(key).alias("_id"), F.col(text).alias("_text")).mapInPandas(run, "doc_id string, fp long"), "doc_id")


def gray_rank(fps: np.ndarray) -> np.ndarray:
    """The position of each fingerprint in the reflected Gray sequence."""
    rank = fps.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """A hierarchy over fingerprints in Gray order, one tree for each of ``groups``.

    ``levels[0]`` are the fingerprints; each level above holds, for every node, the
    bits on which all below agree that its parent does not hold already.
    """

    def __init__(self, fps: np.ndarray, groups: np.ndarray):
        order = np.lexsort((gray_rank(fps), groups))
        self.fps, self.groups, self.order = fps[order], groups[order], order
        agree, value, owner = np.full(len(fps), ~np.uint64(0)), self.fps, self.groups
        stack = [(agree, value, owner, np.arange(len(fps)), np.arange(len(fps)) + 1)]
        while len(value) and len(value) > len(np.unique(owner)):
            first = np.r_[True, owner[1:] != owner[:-1]]
            start = np.maximum.accumulate(np.where(first, np.arange(len(owner)), 0))
            cuts = np.flatnonzero(first | ((np.arange(len(owner)) - start) % FANOUT == 0))
            ends = np.r_[cuts[1:], len(owner)]
            both, some = np.bitwise_and.reduceat(value, cuts), np.bitwise_or.reduceat(value, cuts)
            agree = np.bitwise_and.reduceat(agree, cuts) & ~(both ^ some)
            value, owner = both & agree, owner[cuts]
            stack.append((agree, value, owner, cuts, ends))
        self.levels = []
        for up, (agree, value, owner, begin, end) in enumerate(stack):
            if up + 1 < len(stack):
                parents, begins, ends = stack[up + 1][0], stack[up + 1][3], stack[up + 1][4]
                held = np.repeat(parents, ends - begins)
                agree = agree & ~held
            self.levels.append((agree, value, begin, end))
        self.roots = stack[-1][2]

    def pairs(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions (i, j), i < j, of fingerprints of a group that differ in at most ``radius`` bits."""
        if not len(self.fps):
            return
        root = np.searchsorted(self.roots, self.groups)
        for at in range(0, len(self.fps), FRONTIER // 64):
            query = np.arange(at, min(at + FRONTIER // 64, len(self.fps)))
            yield from self._down(query, root[query], np.zeros(len(query), np.int64), len(self.levels) - 1, radius)

    def _down(self, query: np.ndarray, node: np.ndarray, found: np.ndarray, level: int, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        mask, value, begin, end = self.levels[level]
        found = found + np.bitwise_count((self.fps[query] ^ value[node]) & mask[node])
        keep = found <= radius
        query, node, found = query[keep], node[keep], found[keep]
        if level == 0:
            later = node > query
            yield query[later], node[later]
            return
        widths = end[node] - begin[node]
        bounds = np.r_[0, np.cumsum(widths)]
        at = 0
        while at < len(node):
            to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + FRONTIER, "right")) - 1)
            w = widths[at:to]
            child = np.repeat(begin[node[at:to]], w) + np.arange(w.sum()) - np.repeat(bounds[at:to] - bounds[at], w)
            yield from self._down(np.repeat(query[at:to], w), child, np.repeat(found[at:to], w), level - 1, radius)
            at = to


def join_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give linked positions one label, the smallest, in place."""
    while len(a):
        x, y = labels[a], labels[b]
        differ = x != y
        if not differ.any():
            return
        a, b = a[differ], b[differ]
        low, high = np.minimum(x, y)[differ], np.maximum(x, y)[differ]
        np.minimum.at(labels, high, low)
        while True:
            jumped = labels[labels]
            if (jumped == labels).all():
                break
            labels[:] = jumped


def forest(fps: np.ndarray, groups: np.ndarray, radius: int, sketches: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Edges (member, root) that span what is linked within each group.

    With ``sketches`` a link also needs ``SKETCH_LEAST`` of them to agree.
    """
    index = GrayIndex(fps, groups)
    labels = np.arange(len(fps))
    for a, b in index.pairs(radius):
        if sketches is not None:
            differ = labels[a] != labels[b]
            a, b = a[differ], b[differ]
            alike = sketch_likeness(sketches[index.order[a]], sketches[index.order[b]]) >= SKETCH_LEAST
            a, b = a[alike], b[alike]
        join_labels(labels, a, b)
    moved = labels != np.arange(len(fps))
    return index.fps[moved], index.fps[labels[moved]]


def _blocks(mask: int, parts: int) -> list[int]:
    """The bits of ``mask``, from the highest, in ``parts`` blocks of nearly equal size."""
    bits = [i for i in range(BITS - 1, -1, -1) if mask >> i & 1]
    return [sum(1 << i for i in bits[len(bits) * k // parts : len(bits) * (k + 1) // parts]) for k in range(parts)]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def linked(distinct: DataFrame, *, radius: int = RADIUS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Edges (a, b) of fingerprints that span the links among the column ``fp``, which is distinct.

    With a column ``sketch`` links are also held against the sketches.
    """
    extra = ["sketch"] if "sketch" in distinct.columns else []

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for b in batches:
            b = b if held is None else pd.concat([held, b], ignore_index=True)
            last = b.iloc[-1]
            more = ((b["path"] == last["path"]) & (b["block"] == last["block"])).to_numpy()
            held, b = b[more], b[~more]
            yield edges(b)
        if held is not None:
            yield edges(held)

    def edges(b: pd.DataFrame) -> pd.DataFrame:
        path, block = b["path"].to_numpy(), b["block"].to_numpy()
        new = np.r_[True, (path[1:] != path[:-1]) | (block[1:] != block[:-1])] if len(b) else np.zeros(0, bool)
        group = np.cumsum(new)
        alone = new & np.r_[new[1:], True] if len(b) else new
        fps = b["fp"].to_numpy(np.int64).view(np.uint64)
        sketches = _stacked(b["sketch"][~alone]) if extra else None
        child, root = forest(fps[~alone], group[~alone], radius, sketches)
        return pd.DataFrame({"a": child.view(np.int64), "b": root.view(np.int64)})

    masks = {0: 0}
    rows, found = distinct.select("fp", *extra, F.lit(0).alias("path")), None
    for level in range(LEVELS):
        dealt, next_masks = [], {}
        for path, used in masks.items():
            for k, block in enumerate(_blocks(((1 << BITS) - 1) & ~used, radius + 1)):
                next_masks[path * (radius + 1) + k + 1] = used | block
                dealt.append((path, path * (radius + 1) + k + 1, _signed(used | block)))
        masks = next_masks
        by_path: dict[int, list] = {}
        for path, new, mask in dealt:
            by_path.setdefault(path, []).append(F.struct(F.lit(new).alias("path"), F.col("fp").bitwiseAND(F.lit(mask)).alias("block")))
        choice = F.lit(None)
        for path, options in by_path.items():
            choice = F.when(F.col("path") == path, F.array(*options)).otherwise(choice)
        rows = rows.select("fp", *extra, F.explode(choice).alias("k")).select("fp", *extra, "k.path", "k.block")
        if level + 1 < LEVELS:
            large = cut(rows.groupBy("path", "block").count().where(F.col("count") > bucket_rows).select("path", "block"), "large-buckets")
            crowded = not large.isEmpty()
            small = rows.join(large, ["path", "block"], "left_anti") if crowded else rows
        else:
            crowded, small = False, rows
        part = small.repartition("path", "block").sortWithinPartitions("path", "block").mapInPandas(search, "a long, b long")
        found = part if found is None else found.unionByName(part)
        if not crowded:
            break
        rows = rows.join(large, ["path", "block"], "left_semi")
    return found.distinct()


def components(edges: DataFrame, *, name: str = "components") -> DataFrame:
    """node, root (the smallest node that it reaches) for the nodes of ``edges`` (a, b).

    Large-star and small-star steps in turn, each written to the shared folder,
    until nothing changes.
    """
    pairs = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), name)
    before = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("a", "low"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        pairs = cut(small, name)
        now = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now


def shingles(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of the ``width``-word shingles of the lower-cased words."""
    words = (text or "").lower().split()
    return np.unique(_hashes(" ".join(words).encode("utf-8", "surrogatepass"), width, 0)) if words else np.zeros(0, np.uint64)


def sketch(hashes: np.ndarray) -> bytes:
    """One-permutation MinHash: the least hash of each of ``BINS`` ranges, 16 bits of it; 0 for an empty range."""
    out = np.zeros(BINS, np.uint16)
    if len(hashes):
        bins = (hashes >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
        held, first = np.unique(bins, return_index=True)  # hashes are sorted: the first is the least
        out[held] = (hashes[first] & np.uint64(0xFFFF)).astype(np.uint16) | 1
    return out.tobytes()


def _stacked(sketches: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(sketches), np.uint16).reshape(len(sketches), BINS)


def sketch_likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The estimated Jaccard similarity, row by row; 1 for two empty sketches."""
    some = ((a != 0) | (b != 0)).sum(axis=1)
    return np.where(some > 0, ((a == b) & (a != 0)).sum(axis=1) / np.maximum(some, 1), 1.0)


def prefix(hashes: np.ndarray, frequent: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """The first of the sorted ``hashes`` in one order for all texts, ``frequent`` (sorted) ones last.

    So many that two sets of at least ``similarity`` share one of them: they have
    ``similarity`` of the larger set in common, so no more than the rest of it differs.
    """
    count = len(hashes) - int(np.ceil(similarity * len(hashes) - 1e-9)) + 1 if len(hashes) else 0
    if len(frequent) and count:
        at = np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)
        hashes = hashes[np.argsort(frequent[at] == hashes, kind="stable")]
    return hashes[:count]


def _frequent(docs: DataFrame, text: str) -> np.ndarray:
    """The sorted shingles that stand in many of some texts that are drawn, a bounded number."""
    share = min(1.0, DRAWN / max(docs.count(), 1))
    drawn = docs.select(F.col(text).alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for t in b["text"]:
                yield pd.DataFrame({"s": shingles(t).view(np.int64)})

    counts = drawn.dropDuplicates(["text"]).mapInPandas(run, "s long").groupBy("s").count().where(F.col("count") >= FREQUENT)
    found = counts.orderBy(F.desc("count"), "s").limit(MOST_FREQUENT).select("s").toPandas()["s"]
    return np.sort(found.to_numpy(np.int64).view(np.uint64))


def _similar(classes: DataFrame, similarity: float, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Edges (a, b) of fingerprints that span the links of texts that share a shingle of their prefixes.

    No two texts of ``similarity`` go without, whatever their fingerprints. Shingles with the
    same texts are looked at once; links are held against sizes and against each text's own sketch.
    The texts of a shingle that more than ``hot_rows`` share are linked to the first of them as they
    are: that only makes a group wider, and what is similar in it is decided later.
    """
    at = classes.select(F.explode("prefix").alias("shingle"), "size", "words", "fp")
    shared = cut(at.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1"), "shared-shingles")
    few, many = shared.where(F.col("n") <= hot_rows).select("shingle"), cut(shared.where(F.col("n") > hot_rows).select("shingle"), "hot-shingles")
    lists = sized_join(at, few, "shingle").groupBy("shingle").agg(F.sort_array(F.collect_list(F.struct("size", "words", "fp"))).alias("ms"))
    lists = lists.where(F.array_min("ms.fp") < F.array_max("ms.fp")).groupBy(F.xxhash64("ms").alias("bucket")).agg(F.first("ms").alias("ms"))
    rows = cut(lists, "shared-lists").select("bucket", F.explode("ms").alias("m")).select("bucket", "m.size", "m.words", "m.fp")
    rows = rows.join(classes.select("words", "sketch"), "words").select("bucket", "size", "fp", "sketch")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for b in batches:
            b = b if held is None else pd.concat([held, b], ignore_index=True)
            more = (b["bucket"] == b["bucket"].iloc[-1]).to_numpy()
            held, b = b[more], b[~more]
            yield edges(b)
        if held is not None:
            yield edges(held)

    def edges(b: pd.DataFrame) -> pd.DataFrame:
        bucket, size, fp = b["bucket"].to_numpy(), b["size"].to_numpy(), b["fp"].to_numpy()
        sketches = _stacked(b["sketch"])
        ends = np.r_[np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, len(b)] if len(b) else []
        found, start = [], 0
        for end in ends:
            found += [(fp[start + i], fp[start + j]) for i, j in _bucket_links(fp[start:end], size[start:end], sketches[start:end], similarity)]
            start = end
        return pd.DataFrame(found, columns=["a", "b"]).astype("int64").drop_duplicates()

    near = rows.repartition("bucket").sortWithinPartitions("bucket", "size").mapInPandas(search, "a long, b long")
    if not many.isEmpty():
        wide = sized_join(at, many, "shingle").select("shingle", "fp").distinct()
        low = wide.groupBy("shingle").agg(F.min("fp").alias("low"))
        near = near.unionByName(sized_join(wide, low, "shingle").select(F.col("fp").alias("a"), F.col("low").alias("b")).where("a <> b"))
    return near.distinct()


def _bucket_links(fps: np.ndarray, sizes: np.ndarray, sketches: np.ndarray, similarity: float) -> Iterator[tuple[int, int]]:
    """Positions that span the links of one bucket, by size; equal fingerprints are linked already."""
    labels = np.unique(fps, return_inverse=True)[1]
    last = np.searchsorted(similarity * sizes - 1e-9, sizes, "right")
    for i in range(len(fps) - 1):
        other = np.arange(i + 1, last[i])
        other = other[labels[other] != labels[i]]
        if len(other):
            other = other[sketch_likeness(sketches[other], sketches[i : i + 1]) >= SKETCH_LEAST]
            for label, at in zip(*np.unique(labels[other], return_index=True), strict=True):
                labels[labels == label] = labels[i]
                yield i, int(other[at])


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted arrays without repeats."""
    if not (len(a) and len(b)):
        return float(len(a) == len(b))
    both = len(a) + len(b) - len(np.union1d(a, b))
    return both / (len(a) + len(b) - both)


class _Stayers:
    """The texts of a group that stay so far; finds whether a further text is similar to one of them."""

    def __init__(self, similarity: float):
        self.similarity, self.shingles = similarity, []
        self.sizes, self.sketches = np.zeros(64, np.int64), np.zeros((64, BINS), np.uint16)

    def similar(self, size: int, own_sketch: np.ndarray, text: str | None) -> bool:
        n, least = len(self.shingles), self.similarity
        if not n:
            return False
        sizes = self.sizes[:n]
        near = np.flatnonzero(least * np.maximum(sizes, size) <= np.minimum(sizes, size) + 1e-9)
        near = near[sketch_likeness(self.sketches[near], own_sketch[None]) >= SKETCH_LEAST]
        if not len(near):
            return False
        own = shingles(text)
        return any(jaccard(self.shingles[k], own) >= least - 1e-12 for k in near)

    def add(self, size: int, own_sketch: np.ndarray, text: str | None) -> None:
        n = len(self.shingles)
        if n == len(self.sizes):
            self.sizes, self.sketches = np.resize(self.sizes, 2 * n), np.resize(self.sketches, (2 * n, BINS))
        self.sizes[n], self.sketches[n] = size, own_sketch
        self.shingles.append(shingles(text))


def _greedy(part: pd.DataFrame, similarity: float) -> np.ndarray:
    """Of rows in order whether each stays: it does unless an earlier one that stays is similar."""
    stayers, stays = _Stayers(similarity), np.zeros(len(part), bool)
    for i, row in enumerate(zip(part["size"], _stacked(part["sketch"]), part["text"], strict=True)):
        if not stayers.similar(*row):
            stayers.add(*row)
            stays[i] = True
    return stays


def _redundant(members: DataFrame, similarity: float, group_rows: int, group_shingles: int = GROUP_SHINGLES) -> DataFrame:
    """id of the ``members`` (group, id, rank, size, sketch, text) that go.

    One rule for groups of any size: in the order of rank and id a text stays unless one of
    its group that stays is similar. A group that fits a task is decided there. Of a larger
    one the first texts that fit are decided, then all others, dealt to parts, are held
    against those of them that stay; what is neither decided nor similar goes to the next
    round. So each task holds two bounded parts, and the bounds don't change what stays.
    """

    def decide(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["rank", "id"])
        return part.assign(stays=_greedy(part, similarity))[["id", "stays"]]

    def first(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["rank", "id"])
        fits = part["size"].cumsum().to_numpy() <= group_shingles
        fits[0] = True
        part = part[fits]
        return part.assign(stays=_greedy(part, similarity))

    def against(stay: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        stayers = _Stayers(similarity)
        for row in zip(stay["size"], _stacked(stay["sketch"]), stay["text"], strict=True):
            stayers.add(*row)
        gone = [i for i, *row in zip(part["id"], part["size"], _stacked(part["sketch"]), part["text"], strict=True) if stayers.similar(*row)]
        return pd.DataFrame({"id": np.array(gone, np.int64)})

    fields = "group long, id long, rank long, size int, sketch binary, text string"
    columns = ["group", "id", "rank", "size", "sketch", "text"]
    pending, gone = cut(members.select(*columns), "members"), []
    while True:
        sizes = pending.groupBy("group").agg(F.count("*").alias("n"), F.sum("size").alias("shingles"))
        large = cut(sizes.where((F.col("n") > group_rows) | ((F.col("shingles") > group_shingles) & (F.col("n") > 1))), "large-groups")
        crowded = not large.isEmpty()
        small = sized_join(pending, large.select("group"), "group", "left_anti") if crowded else pending
        gone.append(cut(small.groupBy("group").applyInPandas(decide, "id long, stays boolean").where("not stays").select("id"), "gone"))
        if not crowded:
            break
        parts = F.ceil(F.greatest(F.col("n") / group_rows, F.col("shingles") / group_shingles)).cast("int")
        rest = sized_join(pending, large.select("group", parts.alias("parts")), "group")
        order = Window.partitionBy("group").orderBy("rank", "id")
        front = rest.select(*columns).withColumn("place", F.row_number().over(order)).where(F.col("place") <= group_rows).drop("place")
        front = cut(front.groupBy("group").applyInPandas(first, f"{fields}, stays boolean"), "front")
        gone.append(front.where("not stays").select("id"))
        rest = rest.join(front.select("id"), "id", "left_anti").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
        rest = cut(rest.select(*columns, "part"), "rest")
        held = front.where("stays").select(*columns).join(large.select("group", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part")), "group")
        out = held.groupBy("group", "part").cogroup(rest.groupBy("group", "part")).applyInPandas(against, "id long")
        gone.append(cut(out, "gone"))
        pending = cut(rest.select(*columns).join(gone[-1], "id", "left_anti"), "members")
    found = gone[0]
    for more in gone[1:]:
        found = found.unionByName(more)
    return found


def keep_one(docs: DataFrame, *, radius: int = STAGE_RADIUS, similarity: float = SIMILARITY, group_rows: int = GROUP_ROWS, hot_rows: int = HOT_ROWS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, less those that are near-duplicates of a row that stays.

    Near duplicates share ``SIMILARITY`` of their five-word shingles. Candidates are fingerprints
    within ``radius`` bits by the index, whose sketches agree, and all texts that share a shingle
    of their prefixes, whatever their fingerprints; the shingles then decide.
    Of repeated rows and of equal lower-cased words the smallest doc_id stays, a null
    doc_id last; of rows that are equal in both one stays.
    """
    columns = docs.columns
    frequent = _frequent(docs, text)
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fps = np.fromiter((fingerprint(t, STAGE_WIDTH) for t in b["text"]), np.uint64, len(b)).view(np.int64)
            same, drawn, sizes, first = [], [], [], []
            for t in b["text"]:
                own = shingles(t)
                same.append(xxhash.xxh64_intdigest(" ".join((t or "").lower().split()).encode("utf-8", "surrogatepass")))
                drawn.append(sketch(own))
                sizes.append(len(own))
                first.append(prefix(own, shared.value, similarity).view(np.int64))
            yield pd.DataFrame({"doc_id": b["doc_id"], "copy": b["copy"], "fp": fps, "words": np.array(same, np.uint64).view(np.int64), "sketch": drawn, "size": sizes, "prefix": first})

    source = docs.select(carried(key).alias("doc_id"), F.xxhash64(text).alias("copy"), F.col(text).alias("text"))
    prints = cut(restored(source.mapInPandas(run, "doc_id string, copy long, fp long, words long, sketch binary, size int, prefix array<long>"), "doc_id"), "prints")
    # equal words: the smallest doc_id, and of its rows the smallest hash of the text
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "copy")).alias("m")
    repeats = cut(prints.groupBy("words").count().where("count > 1").select("words"), "repeated-words")
    alone = sized_join(prints, repeats, "words", "left_anti", row_bytes=40).select("words", "fp", "sketch", "size", "prefix", "doc_id", "copy")
    some = sized_join(prints, repeats, "words", "left_semi", row_bytes=40).groupBy("words").agg(first, *(F.first(c).alias(c) for c in ("fp", "sketch", "size", "prefix")))
    classes = alone.unionByName(cut(some.select("words", "fp", "sketch", "size", "prefix", "m.doc_id", "m.copy"), "classes"))
    # different words can have one fingerprint: the index holds it once, with its first sketch;
    # links that only the others' sketches show are among those of the prefixes
    distinct = cut(classes.groupBy("fp").agg(F.count("*").alias("n"), F.min_by("sketch", "words").alias("sketch")), "distinct-fingerprints")
    edges = linked(distinct.select("fp", "sketch"), radius=radius).unionByName(_similar(classes, similarity, hot_rows))
    roots = components(edges, name="near-components")
    of = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "n", F.coalesce("root", "fp").alias("group"))
    wide = of.groupBy("group").agg(F.sum("n").alias("n")).where("n > 1").select("group")
    rows = classes.join(of.join(wide, "group", "left_semi").select("fp", "group"), "fp").select("group", "words", "size", "sketch", F.col("doc_id").alias("_did"), F.col("copy").alias("_dcopy"))
    own = docs.select(F.col(key).cast("long").alias("_id"), F.xxhash64(text).alias("_copy"), F.col(text).alias("text"))
    texts = sized_join(own, rows, (F.col("_copy") == F.col("_dcopy")) & F.col("_id").eqNullSafe(F.col("_did"))).dropDuplicates(["words"])
    members = texts.select("group", F.col("words").alias("id"), F.coalesce("_id", F.lit((1 << 63) - 1)).alias("rank"), "size", "sketch", "text")
    gone = cut(_redundant(members, similarity, group_rows), "redundant")

    stays = classes.join(gone.select(F.col("id").alias("words")), "words", "left_anti").select(F.col("doc_id").alias("_did"), F.col("copy").alias("_dcopy"))
    own_copy, its_id, its_copy = (fresh(docs, stem=stem) for stem in ("copy", "droppedid", "droppedcopy"))
    counted = prints.groupBy("doc_id", "copy").count().select(F.col("doc_id").alias(its_id), F.col("copy").alias(its_copy), "count")
    same = (F.col(its_copy) == F.col("_dcopy")) & F.col(its_id).eqNullSafe(F.col("_did"))
    drop = cut(counted.join(stays, same, "left_anti").select(its_id, its_copy), "dropped")
    repeated = cut(counted.where(F.col("count") > 1).join(stays, same, "left_semi").select(its_id, its_copy), "repeated")
    this = (F.col(own_copy) == F.col(its_copy)) & F.col(key).cast("long").eqNullSafe(F.col(its_id))
    kept = sized_join(docs.withColumn(own_copy, F.xxhash64(text)), drop, this, "left_anti", row_bytes=48)
    if not repeated.isEmpty():
        kept = sized_join(kept, repeated, this, "left_anti", row_bytes=48).unionByName(sized_join(kept, repeated, this, "left_semi", row_bytes=48).dropDuplicates([key, own_copy]))
    return kept.select(*columns)


def near_duplicates(docs: DataFrame, *, width: int = 3, radius: int = RADIUS, key: str = "doc_id", text: str = "text", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable), one row per row of ``docs``."""
    prints = cut(fingerprints(docs, width=width, key=key, text=text), "fingerprints")
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct-fingerprints")
    roots = components(linked(distinct.select("fp"), radius=radius, bucket_rows=bucket_rows), name="fingerprint-components")
    of = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    named = of.groupBy("root").agg(F.min("low").alias("component_id"))
    few = distinct.count() * 32 <= BROADCAST_BYTES
    # one component can hold a large share of the fingerprints, and one fingerprint of the rows
    of = (of.join(F.broadcast(named), "root") if few else salted_join(of, named, "root", F.col("fp"), "inner")).select("fp", "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    met = prints.join(F.broadcast(of), "fp") if few else salted_join(prints, of, "fp", F.col("doc_id"), "inner")
    return met.select("doc_id", hexed.alias("fingerprint"), "component_id")
