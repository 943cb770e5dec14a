"""Leaks against every diagonal of every document and item."""

import os
import random

import numpy as np
import pytest
import regex

from tests.llm.cases import DOCS
from vellumine.llm import decontam

SF = "/root/testdata/sf0.001"
ITEMS = "item_id long, text string"


def tokens(text):
    return [t for t in regex.split(r"[^\p{L}\p{N}]+", (text or "").lower()) if t]


def brute(docs, items):
    """(doc_id, item_id, matched, tokens, at), without seeds."""
    ids, found = {}, set()
    number = lambda text: np.array([ids.setdefault(t, len(ids) + 1) for t in tokens(text)], np.int64)
    wanted = [(i, number(t)) for i, t in set(items)]
    for doc_id, text in docs:
        seq = number(text)
        for item_id, item in wanted:
            n = len(item)
            if not n or not len(seq):
                continue
            padded = np.r_[np.zeros(n - 1, np.int64), seq, np.zeros(n - 1, np.int64)]
            same = np.lib.stride_tricks.sliding_window_view(padded, n) == item
            ok = same.sum(axis=1) >= decontam.IDENTITY * n
            if n >= decontam.STRETCH:
                runs = np.lib.stride_tricks.sliding_window_view(same, decontam.STRETCH, axis=1).sum(axis=2)
                ok |= runs.max(axis=1) >= decontam.IDENTITY * decontam.STRETCH
            if ok.any():
                shift = min(np.flatnonzero(ok), key=lambda k: (-same[k].sum(), k))
                found.add((doc_id, item_id, int(same[shift].sum()), n, max(int(shift) - n + 1, 0)))
    return found


def found(spark, docs, items):
    rows = decontam.leaks(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in docs], DOCS), spark.createDataFrame(items, ITEMS)).collect()
    got = {(r["doc_id"], r["item_id"], r["matched"], r["item_tokens"], r["at"]) for r in rows}
    assert len(got) == len(rows)
    return got


@pytest.mark.parametrize("seed, vocabulary", [(1, 3), (2, 8), (3, 60)])
def test_random_texts(spark, seed, vocabulary):
    """Few words, so that passages agree by chance at every share; changed and cut copies of items besides."""
    draw = random.Random(seed)
    text = lambda n: [f"w{draw.randrange(vocabulary)}" for _ in range(n)]
    items = [text(n) for n in range(1, 31)]
    docs = [text(draw.randrange(0, 60)) for _ in range(20)]
    for item in items * 2:
        body = [t if draw.random() > 0.18 else "changed" for t in item]
        low = draw.randrange(0, len(item) // 3 + 1)
        docs.append(text(draw.randrange(0, 9)) + body[low:] + text(draw.randrange(0, 9)))
    docs = [(i, " ".join(d)) for i, d in enumerate(docs)] + [(900, None), (901, ""), (5, " ".join(docs[5]))]
    items = [(i, ", ".join(t)) for i, t in enumerate(items)]
    want = brute(docs, items)
    assert len(want) > 50
    assert found(spark, docs, items) == want


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
def test_driver_tables(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert found(spark, docs, items) == brute(docs, items)
