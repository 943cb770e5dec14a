"""Rows that every operator must handle: nulls anywhere, empty and long texts, repeats, clashing columns."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "alpha beta gamma delta. " * 20_000
AWKWARD = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "a", 70),
    (1, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "a", 70),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (None, "no id here but some words all the same", "en", "b", 38),
    (None, None, None, None, None),
    (4, "   \t\n ", "fr", "b", 5),
    (5, LONG, "en", "a", len(LONG)),
    (6, "Ünïcödé 漢字 \U0001f600   text lines", None, "c", 20),
    (7, "write to jane.doe@example.com or +1 (555) 123-4567 now", "en", None, 50),
]
CLASH = "copy fp group score start end bin_id piece term entity lang_ _copy seq item_id matched keep threshold fingerprint component_id host path rule verdict html vector rank query_id".split()


def awkward(spark):
    return spark.createDataFrame(AWKWARD, DOCS)


def clashing(spark):
    df = awkward(spark)
    for c in CLASH:
        if c not in df.columns:
            from pyspark.sql import functions as F

            df = df.withColumn(c, F.lit("x"))
    return df


def labels(spark, rows=((1, 1, 0), (7, 1, 1), (None, 1, 1), (3, None, None))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def words(seed, n, stem="w"):
    import random

    r = random.Random(seed)
    return " ".join(f"{stem}{r.randrange(5000)}" for _ in range(n))
