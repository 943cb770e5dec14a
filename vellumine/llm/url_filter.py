"""URL rules by host-suffix and path-prefix expressions (DataFrame functions only).

Every URL is expanded into expressions ``host suffix + directory prefix``. Their
SHA-256 digests are joined to the rules' on a short prefix of the digest; the full
digest, the host and the whole rule path are then confirmed, and the longest rule
that fits decides.

Cases: a null URL, or one without ``://``, has empty host and path, fits no rule
and gets the default verdict. A rule with a null host or verdict is ignored, a null
path counts as empty. Of equally long rules ``block`` wins. Repeated rows stay
repeated. An empty table gives an empty result. Columns of the input that clash
with the result's names are replaced; others are not carried.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules up to this many bytes of text are broadcast; beyond it both sides are shuffled.
BROADCAST_BYTES = 8 << 20
#: Hex digits of the digest that the equi-join uses.
PREFIX_DIGITS = 8
#: Copies of each rule in the shuffled join, so that a rule that a third of all URLs fit is spread.
SALTS = 32


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    host = F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    url = F.coalesce(url, F.lit(""))
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def _suffixes(host: Column, labels: int) -> Column:
    """The host's last 1, 2, ... ``labels`` labels; none for an empty host."""
    parts = F.split(host, r"\.", -1)
    n = F.least(F.size(parts), F.lit(labels))
    joined = F.transform(F.sequence(F.lit(1), n), lambda k: F.array_join(F.slice(parts, -k, k), "."))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(joined)


def _directories(path: Column, depth: int) -> Column:
    """The empty prefix and the prefixes that end with the path's first ``depth`` slashes."""
    parts = F.split(path, "/", -1)
    n = F.least(F.size(parts) - 1, F.lit(depth))
    ended = F.transform(F.sequence(F.lit(1), n), lambda k: F.concat(F.array_join(F.slice(parts, 1, k), "/"), F.lit("/")))
    return F.concat(F.array(F.lit("")), F.when(n >= 1, ended).otherwise(F.array().cast("array<string>")))


def judge_urls(pages: DataFrame, rules: DataFrame, *, url: str = "url", key: str = "page_id", default: str = "allow") -> DataFrame:
    """One row per row of ``pages``: key, host, path, rule, verdict.

    ``rules`` has host, path and verdict. A rule fits its host and all subdomains
    if the URL's path starts with the rule's path.
    """
    rules = rules.where("host is not null and verdict is not null").select("host", F.coalesce("path", F.lit("")).alias("rule_path"), "verdict").distinct()
    rules = rules.select(
        F.translate("host", string.ascii_uppercase, string.ascii_lowercase).alias("rule_host"),
        "rule_path",
        "verdict",
        F.concat("host", "rule_path").alias("rule"),
    ).withColumn("digest", F.sha2(F.concat("rule_host", F.lit("\n"), F.regexp_extract("rule_path", r"^((?s:.*/)?)", 1)), 256))
    shape = rules.agg(
        F.max(F.size(F.split("rule_host", r"\."))).alias("labels"),
        F.max(F.size(F.split("rule_path", "/"))).alias("depth"),
        F.sum(F.octet_length("rule") + 100).alias("bytes"),
    ).first()
    urls = pages.select(
        F.monotonically_increasing_id().alias("_row"),
        F.col(key).alias(key),
        host_of(F.col(url)).alias("host"),
        path_of(F.col(url)).alias("path"),
    )
    if shape["labels"] is None:
        return urls.select(key, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))

    rules = rules.withColumn("short", F.substring("digest", 1, PREFIX_DIGITS))
    pairs = F.flatten(
        F.transform(
            _suffixes(F.col("host"), shape["labels"]),
            lambda h: F.transform(_directories(F.col("path"), shape["depth"]), lambda p: F.sha2(F.concat(h, F.lit("\n"), p), 256)),
        )
    )
    asked = urls.withColumn("asked", F.explode_outer(pairs)).withColumn("short", F.substring("asked", 1, PREFIX_DIGITS))
    if shape["bytes"] <= BROADCAST_BYTES:
        keys, side = ["short"], F.broadcast(rules)
    else:
        keys = ["short", "salt"]
        side = rules.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        asked = asked.withColumn("salt", F.pmod(F.col("_row"), F.lit(SALTS)).cast("int"))
    fits = (
        (F.col("asked") == F.col("digest"))
        & ((F.col("host") == F.col("rule_host")) | F.endswith(F.col("host"), F.concat(F.lit("."), "rule_host")))
        & F.startswith(F.col("path"), F.col("rule_path"))
    )
    best = F.max(F.when(fits, F.struct(F.length("rule").alias("n"), (F.col("verdict") == "block").alias("b"), "rule", "verdict")))
    found = asked.join(side, keys, "left").groupBy("_row").agg(F.first(key).alias(key), F.first("host").alias("host"), F.first("path").alias("path"), best.alias("best"))
    return found.select(key, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
