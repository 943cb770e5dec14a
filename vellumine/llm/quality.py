"""Quality by an interpolated modified Kneser-Ney model of characters, counted and looked up by sharded joins.

The model is trained on all trusted text (documents labelled good). Its symbols are the
code points as they are, so no alphabet is fixed and no script is folded, and its tables
grow with the corpus. Tasks count the n-grams of order ``ORDER`` of the text that they
read; counts, continuation counts, context totals and interpolated probabilities are then
DataFrame joins on the n-grams. Nothing of the model is gathered on the driver.

To score, texts are dealt by hash to chunks of about ``CHUNK_BYTES``, compressed on the way.
Each chunk asks for its distinct n-grams once; these are joined to the model, each n-gram once
for all chunks; the answers return to their chunks, where a text's perplexity is one
look-up for each character. A document is kept if its perplexity does not exceed a quantile of
trusted texts of its language that the model has not seen: one in ``HELD_OUT`` sets thresholds
and isn't counted.

Cases: a null or empty text has no perplexity and is not kept. A null language counts
as ''; a language without trusted text takes the threshold of all trusted text. With
no trusted text at all every text that isn't empty is kept; where hashes leave one of the two
sides without text, all trusted text serves both. Short texts are smoothed
towards the mean of the trusted text by ``PRIOR`` symbols. A NUL counts as U+FFFD. Labels repeated
for one document count as trusted if any is. Repeated rows stay, equal texts are scored once.
Extra columns are kept by ``keep_good`` and left out by ``score``; names of the result win over
clashing ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumine.llm.common import salted_join, sized_join
from vellumine.shared import cut

ORDER = 5
#: Share of the held-out trusted texts of a language that stays below its threshold.
QUANTILE = 0.995
#: One in so many of the trusted texts, by hash, sets thresholds and isn't counted.
HELD_OUT = 4
#: Symbols of mean trusted text that are added to each document.
PRIOR = 64
#: Text of a chunk; of a task that counts; and characters that are looked at together.
CHUNK_BYTES, COUNT_BYTES, BLOCK = 32 << 20, 64 << 20, 1 << 19
#: N-grams that a task which counts holds before it sends them on.
HELD = 200_000
#: Chunks that ask for one n-gram are listed in rows of at most so many.
LISTED = 4096
START = "\n" * (ORDER - 1)
#: Bytes that an n-gram takes in a broadcast table.
GRAM_BYTES = 64


def trusted_ids(labels: DataFrame) -> DataFrame:
    return labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()


class Spelling:
    """Characters as numbers that are small enough for an n-gram to fit 64 bits."""

    def __init__(self, points: np.ndarray):
        self.points = np.unique(points)
        self.bits = max(1, int(len(self.points)).bit_length())
        self.fits = self.bits * ORDER <= 64
        self.number = np.zeros(int(self.points[-1]) + 1, np.uint64)
        self.number[self.points] = np.arange(len(self.points))

    def keys(self, points: np.ndarray) -> np.ndarray:
        """The n-gram that ends at each point from the ``ORDER``-th on."""
        n = len(points) - ORDER + 1
        if not self.fits:  # more than 4096 characters: the n-grams as they are
            rows = np.lib.stride_tricks.sliding_window_view(points, ORDER)
            return np.ascontiguousarray(rows.astype(">u4")).view(np.dtype((np.void, 4 * ORDER))).ravel()
        at = self.number[points]
        key = np.zeros(n, np.uint64)
        for i in range(ORDER):
            key = (key << np.uint64(self.bits)) | at[i : i + n]
        return key

    def grams(self, keys: np.ndarray) -> np.ndarray:
        """The n-grams as text."""
        if not self.fits:
            points = keys.view(">u4").reshape(-1, ORDER)
        else:
            mask = np.uint64((1 << self.bits) - 1)
            points = np.stack([self.points[((keys >> np.uint64(self.bits * (ORDER - 1 - i))) & mask).astype(np.int64)] for i in range(ORDER)], axis=1)
        return np.ascontiguousarray(points.astype("<u4")).view(f"<U{ORDER}").ravel().astype(object)

    def of(self, grams: list[str]) -> np.ndarray:
        """The keys of n-grams as text."""
        points = np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, ORDER)
        if not self.fits:
            return np.ascontiguousarray(points.astype(">u4")).view(np.dtype((np.void, 4 * ORDER))).ravel()
        key = np.zeros(len(points), np.uint64)
        for i in range(ORDER):
            key = (key << np.uint64(self.bits)) | self.number[points[:, i]]
        return key


def _points(text: str) -> np.ndarray:
    return np.frombuffer((START + text.replace("\0", "�")).encode("utf-32-le", "surrogatepass"), "<u4")


def _blocks(texts: Iterator[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Several texts at once, each preceded by the start, long ones in parts.

    Their points; whether an n-gram that begins there lies within one part; the number of each
    part's text; and where its n-grams begin among all those that do.
    """
    held: list[np.ndarray] = []
    owners: list[int] = []
    size = 0
    for k, t in enumerate(texts):
        points = _points(t)
        for a in range(0, len(points) - ORDER + 1, BLOCK):
            held.append(points[a : a + BLOCK + ORDER - 1])
            owners.append(k)
            size += len(held[-1])
            if size >= BLOCK:
                yield _joined(held, owners)
                held, owners, size = [], [], 0
    if held:
        yield _joined(held, owners)


def _joined(parts: list[np.ndarray], owners: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    points, lengths = np.concatenate(parts), np.array([len(p) for p in parts])
    valid = np.ones(len(points) - ORDER + 1, bool)
    for i in range(1, ORDER):
        valid[np.cumsum(lengths)[:-1] - i] = False
    grams = lengths - ORDER + 1
    return points, valid, np.array(owners), np.cumsum(grams) - grams


def count_grams(texts: Iterator[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(n-grams, counts) of blocks of the texts, added up while there are few enough."""
    held: dict[str, int] = {}
    for points, valid, _, _ in _blocks(texts):
        spelling = Spelling(points)
        keys, n = np.unique(spelling.keys(points)[valid], return_counts=True)
        for g, c in zip(spelling.grams(keys), n.tolist(), strict=True):
            held[g] = held.get(g, 0) + c
        if len(held) > HELD:
            yield np.array(list(held), object), np.fromiter(held.values(), np.int64, len(held))
            held.clear()
    if held:
        yield np.array(list(held), object), np.fromiter(held.values(), np.int64, len(held))


def gram_counts(trusted: DataFrame) -> DataFrame:
    """gram, n: how often each n-gram of order ``ORDER`` stands in the trusted text."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for grams, n in count_grams(t for b in batches for t in b["text"] if t):
            for i in range(0, len(grams), 200_000):
                yield pd.DataFrame({"gram": grams[i : i + 200_000], "n": n[i : i + 200_000]})

    size = trusted.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = trusted.select("text").coalesce(max(1, -(-size // COUNT_BYTES)))
    return parts.mapInPandas(count, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _discounts(counts: DataFrame) -> list[float]:
    """D1, D2 and D3+ of modified Kneser-Ney, from the counts of counts."""
    ones, twos, threes, fours = (float(x or 0) for x in counts.agg(*(F.count_if(F.col("n") == k) for k in (1, 2, 3, 4))).first())
    if not (ones and twos and threes):
        return [0.5, 1.0, 1.5]
    y = ones / (ones + 2 * twos)
    raw = (1 - 2 * y * twos / ones, 2 - 3 * y * threes / twos, 3 - 4 * y * fours / threes)
    return [min(max(d, 0.01), k + 0.9) for k, d in enumerate(raw)]


def _last(gram: str | Column, n: int) -> Column:
    """The last ``n`` of the code points of an n-gram of order n + 1 or more."""
    return F.substring(gram, -n, n) if n else F.lit("")


def train(trusted: DataFrame) -> dict[str, Any] | None:
    """By order, tables of the n-grams seen (gram, p) and of the contexts seen (context, w), and the base probability."""
    counts = {ORDER: cut(gram_counts(trusted), "grams")}
    for n in range(ORDER - 1, 0, -1):  # in how many different ways an n-gram is preceded
        counts[n] = cut(counts[n + 1].groupBy(_last("gram", n).alias("gram")).agg(F.count("*").alias("n")), "grams")
    symbols = counts[1].count()
    if not symbols:
        return None
    model: dict[str, Any] = {"base": 1.0 / (symbols + 1), "seen": {}, "weights": {}}
    for n in range(1, ORDER + 1):
        d1, d2, d3 = _discounts(counts[n])
        off = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        rows = counts[n].withColumn("context", F.substring("gram", 1, n - 1))
        total = cut(rows.groupBy("context").agg(F.sum("n").alias("total"), F.sum(off).alias("held")), "contexts")
        rows = sized_join(rows, total, "context", row_bytes=GRAM_BYTES)
        below = F.lit(model["base"])
        if n > 1:
            rows = rows.withColumn("suffix", _last("gram", n - 1))
            rows = sized_join(rows, model["seen"][n - 1].select(F.col("gram").alias("suffix"), F.col("p").alias("below")), "suffix", row_bytes=GRAM_BYTES)
            below = F.col("below")
        model["seen"][n] = cut(rows.select("gram", ((F.col("n") - off) / F.col("total") + F.col("held") / F.col("total") * below).alias("p")), "probabilities")
        model["weights"][n] = total.select("context", (F.col("held") / F.col("total")).alias("w"))
    return model


def probabilities(asked: DataFrame, model: dict[str, Any]) -> DataFrame:
    """``asked``, whose column gram is distinct or nearly so, with p: from the longest n-gram that was seen, backed off."""
    out = asked
    p = F.lit(model["base"])
    for n in range(1, ORDER + 1):
        seen = model["seen"][n].select(F.col("gram").alias(f"_g{n}"), F.col("p").alias(f"_p{n}"))
        weights = model["weights"][n].select(F.col("context").alias(f"_c{n}"), F.col("w").alias(f"_w{n}"))
        out = sized_join(out, seen, _last("gram", n) == F.col(f"_g{n}"), "left", row_bytes=GRAM_BYTES)
        out = sized_join(out, weights, F.substring("gram", ORDER - n + 1, n - 1) == F.col(f"_c{n}"), "left", row_bytes=GRAM_BYTES)
        p = F.coalesce(f"_p{n}", F.coalesce(f"_w{n}", F.lit(1.0)) * p)
    return out.select(*asked.columns, p.alias("p"))


def _pieces(docs: DataFrame, text: str, chunks: int) -> DataFrame:
    """chunk, copies, lengths, body: the distinct texts of a task for each chunk, compressed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done: set[int] = set()
        for b in batches:
            by: dict[int, list[tuple[int, bytes]]] = {}
            for chunk, copy, t in zip(b["chunk"], b["copy"], b["text"], strict=True):
                if copy not in done:
                    done.add(copy)
                    by.setdefault(chunk, []).append((copy, t.encode("utf-8", "surrogatepass")))
            press = zstandard.ZstdCompressor(level=3)
            rows = [(c, np.array([x for x, _ in v], np.int64).tobytes(), np.array([len(t) for _, t in v], np.int64).tobytes(), press.compress(b"".join(t for _, t in v))) for c, v in by.items()]
            yield pd.DataFrame(rows, columns=["chunk", "copies", "lengths", "body"])

    at = docs.where(F.col(text) != "").select(F.xxhash64(text).alias("copy"), F.col(text).alias("text"))
    return at.select(F.pmod("copy", F.lit(chunks)).cast("int").alias("chunk"), "copy", "text").mapInPandas(run, "chunk int, copies binary, lengths binary, body binary")


def _texts(pieces: pd.DataFrame) -> Iterator[tuple[int, str]]:
    """(copy, text) of a chunk's pieces, each copy once."""
    done: set[int] = set()
    for copies, lengths, body in zip(pieces["copies"], pieces["lengths"], pieces["body"], strict=True):
        lengths = np.frombuffer(lengths, np.int64)
        body = zstandard.decompress(body, max_output_size=int(lengths.sum()))
        ends = np.cumsum(lengths)
        for copy, a, b in zip(np.frombuffer(copies, np.int64).tolist(), (ends - lengths).tolist(), ends.tolist(), strict=True):
            if copy not in done:
                done.add(copy)
                yield copy, body[a:b].decode("utf-8", "surrogatepass")


def asked_grams(pieces: pd.DataFrame) -> np.ndarray:
    """The distinct n-grams of a chunk."""
    found: set[str] = set()
    for points, valid, _, _ in _blocks(t for _, t in _texts(pieces)):
        spelling = Spelling(points)
        found.update(spelling.grams(np.unique(spelling.keys(points)[valid])))
    return np.array(sorted(found), object)


def rate(pieces: pd.DataFrame, grams: list[str], logs: np.ndarray) -> pd.DataFrame:
    """copy, total (the negative log probability), n for the texts of a chunk, whose n-grams ``grams`` holds all."""
    spelling = Spelling(np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), "<u4"))
    keys = spelling.of(grams)
    order = np.argsort(keys)
    keys, logs = keys[order], logs[order]
    copies: list[int] = []

    def texts() -> Iterator[str]:
        for copy, t in _texts(pieces):
            copies.append(copy)
            yield t

    sums, sizes, of = [], [], []
    for points, valid, owners, starts in _blocks(texts()):
        found = logs[np.searchsorted(keys, spelling.keys(points)[valid])].astype(np.float64)
        sums.append(np.add.reduceat(found, starts))
        sizes.append(np.diff(np.r_[starts, len(found)]))
        of.append(owners)
    owner = np.concatenate(of)
    return pd.DataFrame({"copy": np.array(copies, np.int64), "total": -np.bincount(owner, np.concatenate(sums), len(copies)), "n": np.bincount(owner, np.concatenate(sizes), len(copies)).astype(np.int64)})


def text_scores(docs: DataFrame, model: dict[str, Any], *, text: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """copy, total, n for the distinct texts of ``docs`` that aren't empty."""
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    pieces = _pieces(docs, text, max(1, -(-size // chunk_bytes)))

    def ask(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"chunk": np.int32(part["chunk"].iloc[0]), "gram": asked_grams(part)})

    def answer(part: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        return rate(part, known["gram"].tolist(), np.log(known["p"].to_numpy()))

    asked = pieces.groupBy("chunk").applyInPandas(ask, "chunk int, gram string")
    listed = asked.groupBy("gram", F.floor(F.col("chunk") / LISTED).alias("list")).agg(F.collect_list("chunk").alias("chunks"))
    known = probabilities(listed.select("gram", "chunks"), model).select(F.explode("chunks").alias("chunk"), "gram", F.col("p").cast("float").alias("p"))
    return pieces.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInPandas(answer, "copy long, total double, n long")


def rated(docs: DataFrame, labels: DataFrame, *, quantile: float = QUANTILE) -> tuple[DataFrame | None, DataFrame | None, float | None]:
    """copy and _x (log perplexity) of the texts, _lang and _limit of the languages, and the limit of all others; None without trusted text."""
    lang = F.coalesce("lang", F.lit(""))
    trusted = sized_join(docs.select("doc_id", F.col("text").alias("text"), lang.alias("lang")), trusted_ids(labels), "doc_id", "left_semi", row_bytes=40).where("text <> ''")
    trusted = cut(trusted.select("lang", "text", F.xxhash64("text").alias("copy"), (F.pmod(F.xxhash64(F.lit("held"), "text"), F.lit(HELD_OUT)) == 0).alias("held")), "trusted")
    sides = {r["held"] for r in trusted.groupBy("held").count().collect()}
    counted, held = (trusted.where("not held"), trusted.where("held")) if len(sides) == 2 else (trusted, trusted)
    model = train(counted)
    if model is None:
        return None, None, None
    scores = cut(text_scores(docs, model), "scores")
    own = sized_join(held.select("lang", "copy"), scores, "copy", row_bytes=40)
    mean = own.agg(F.avg(F.col("total") / F.col("n"))).first()[0]
    x = ((F.col("total") + mean * PRIOR) / (F.col("n") + PRIOR)).alias("_x")
    own = cut(own.select("lang", x), "trusted-scores")
    at = F.percentile_approx("_x", quantile, 10_000)
    return scores.select(F.col("copy").alias("_copy"), x), own.groupBy("lang").agg(at.alias("_limit")).select(F.col("lang").alias("_lang"), "_limit"), own.agg(at).first()[0]


def _judged(docs: DataFrame, labels: DataFrame, quantile: float) -> DataFrame:
    """doc_id, lang, _copy, _perplexity, _threshold and _keep, one row per row of ``docs``, without its text."""
    scores, limits, overall = rated(docs, labels, quantile=quantile)
    rows = docs.select("doc_id", "lang", F.xxhash64("text").alias("_copy"), F.coalesce(F.col("text") != "", F.lit(False)).alias("_some"))
    if scores is None:
        none = F.lit(None).cast("double")
        return rows.select("doc_id", "lang", "_copy", none.alias("_perplexity"), none.alias("_threshold"), F.col("_some").alias("_keep"))
    rows = sized_join(rows.withColumn("_lang", F.coalesce("lang", F.lit(""))), limits, "_lang", "left", row_bytes=200)
    few = scores.count() * 40 <= 64 << 20
    rows = rows.join(F.broadcast(scores), "_copy", "left") if few else salted_join(rows, scores, "_copy", F.col("doc_id"))
    x, limit = F.when(F.col("_some"), F.col("_x")), F.coalesce("_limit", F.lit(overall))
    return rows.select("doc_id", "lang", "_copy", F.exp(x).alias("_perplexity"), F.exp(limit).alias("_threshold"), F.coalesce(x <= limit, F.lit(False)).alias("_keep"))


def score(docs: DataFrame, labels: DataFrame, *, quantile: float = QUANTILE) -> DataFrame:
    """doc_id, lang, perplexity, threshold, keep."""
    return _judged(docs, labels, quantile).select("doc_id", "lang", F.col("_perplexity").alias("perplexity"), F.col("_threshold").alias("threshold"), F.col("_keep").alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame, *, quantile: float = QUANTILE) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with their columns."""
    lang = F.coalesce("lang", F.lit(""))
    poor = cut(_judged(docs, labels, quantile).where("not _keep").select(F.col("_copy").alias("__copy"), F.coalesce("lang", F.lit("")).alias("__lang")).distinct(), "poor")
    return sized_join(docs, poor, (F.xxhash64("text") == F.col("__copy")) & (lang == F.col("__lang")), "left_anti", row_bytes=200).where("text <> ''").select(*docs.columns)
