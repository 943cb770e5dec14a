"""Joins whose small side is measured before it is broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumine.shared import BROADCAST_BYTES, cut, fresh, sized_join  # noqa: F401


def carried(key: str) -> Column:
    """A whole-number id on its way through Python: as text, since pandas turns numbers with a null among them to floats."""
    return F.col(key).cast("long").cast("string")


def restored(df: DataFrame, key: str) -> DataFrame:
    """``df`` with the id that was ``carried`` as a number again."""
    return df.withColumn(key, F.col(key).cast("long"))


def salted_join(large: DataFrame, small: DataFrame, key: str, by: Column, how: str = "left", *, salts: int = 32) -> DataFrame:
    """``large`` joined to ``small``: rows of one key are dealt by ``by`` to ``salts`` tasks, each with a copy of its partners."""
    salt = fresh(large, small, stem="salt")
    left = large.withColumn(salt, F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    right = small.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [key, salt], how).drop(salt)


def distinct_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """copy (a hash of the text), text: each text that isn't empty once. Only texts that have copies are shuffled."""
    at = docs.where(F.col(text) != "").select(F.xxhash64(text).alias("copy"), F.col(text).alias("text"))
    copied = cut(at.groupBy("copy").count().where("count > 1").select("copy"), "copied")
    alone = sized_join(at, copied, "copy", "left_anti", row_bytes=40)
    return alone.unionByName(sized_join(at, copied, "copy", "left_semi", row_bytes=40).dropDuplicates(["copy"]))
