"""Fill-in-the-middle arrangements of texts (SQL functions only).

A text is cut into units, runs of letters A-Z and single other code points. Two cuts drawn
from the SHA-256 of the id deal them to prefix, middle and suffix, which sentinels join
in the order prefix-suffix-middle (psm) or suffix-prefix-middle (spm); some texts stay
plain. ``restore`` finds the sentinels again and puts the parts in their order. No
sentinel can arise across the end of a part, since none begins as another ends.

Everything is a narrow projection: no row is shuffled, and a text needs memory of its own
size. Nothing depends on other rows, so reruns agree.

Cases: a null text counts as empty; an empty text, and one that holds a sentinel, stays
plain. A null id is drawn for as the empty string. Repeated rows give repeated results.
An empty table gives an empty result. Other columns aren't carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNIT = r"[A-Za-z]+|[^A-Za-z]"
# The sentinels before prefix, suffix and middle, percent of texts that are rearranged and, of these, set suffix first.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
REARRANGED, SUFFIX_FIRST = 90, 20


def draws(key: Column, seed: str) -> Column:
    """Four whole numbers under 2**32 from the SHA-256 of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)])


def restore(output: Column, form: Column) -> Column:
    """The text whose arrangement ``output`` is."""
    between = lambda start, end: F.substring(output, start, end - start)
    s, p, m = F.locate(SUFFIX, output), F.locate(PREFIX, output), F.locate(MIDDLE, output)
    skip, last = len(MIDDLE), F.length(output) + 1
    psm = F.concat(between(p + skip, s), between(m + skip, last), between(s + skip, m))
    spm = F.concat(between(p + skip, m), between(m + skip, last), between(s + skip, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def arrange(docs: DataFrame, *, seed: str = "1", key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n (units), form, prefix, middle, suffix (null if plain), output: one row per row."""
    whole = F.coalesce(F.col(text), F.lit(""))
    held = docs.select(F.col(key), whole.alias("text"), F.regexp_extract_all(whole, F.lit(UNIT), F.lit(0)).alias("units"), draws(F.col(key), seed).alias("h"))
    n = F.size("units")
    at = [F.pmod(F.col("h")[k], n + F.lit(1)).cast("int") for k in range(2)]
    plain = (n == 0) | F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE)) | (F.pmod(F.col("h")[2], F.lit(100)) >= REARRANGED)
    form = F.when(plain, "plain").when(F.pmod(F.col("h")[3], F.lit(100)) < SUFFIX_FIRST, "spm").otherwise("psm")
    cuts = held.select(key, "text", "units", n.cast("long").alias("n"), F.least(*at).alias("low"), F.greatest(*at).alias("high"), form.alias("form"))
    part = lambda start, length: F.when(F.col("form") != "plain", F.array_join(F.slice("units", start, length), ""))
    prefix, middle = part(F.lit(1), F.col("low")), part(F.col("low") + 1, F.col("high") - F.col("low"))
    parts = cuts.select(key, "text", "n", "form", prefix.alias("prefix"), middle.alias("middle"), part(F.col("high") + 1, F.col("n").cast("int")).alias("suffix"))
    before = F.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix")).when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix"))
    return parts.select(key, "n", "form", "prefix", "middle", "suffix", F.coalesce(F.concat(before, F.lit(MIDDLE), "middle"), "text").alias("output"))


def digests(arranged: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n, form, prefix_chars, middle_chars, and SHA-256 of the output and of the text restored from it."""
    sha = lambda c: F.sha2(c, 256)
    return arranged.select(key, "n", "form", *(F.length(c).cast("long").alias(f"{c}_chars") for c in ("prefix", "middle")), sha(F.col("output")).alias("output_sha256"), sha(restore(F.col("output"), F.col("form"))).alias("restored_sha256"))
