"""The pipeline, stage by stage, against brute force on the smallest tables."""

import os
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.cases import DOCS, words
from vellumine.llm import quality
from vellumine.llm.pii import base_spans

SF = "/root/testdata/sf0.001"


def kneser_ney(texts):
    """P(symbol | those before) by the textbook, from dictionaries."""
    order = quality.ORDER
    counts = {order: Counter()}
    for t in texts:
        s = quality.START + t.replace("\0", "\ufffd")
        counts[order].update(s[i : i + order] for i in range(len(s) - order + 1))
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    discounts, totals, ends = {}, {}, {}
    for n, c in counts.items():
        of = Counter(c.values())
        if of[1] and of[2] and of[3]:
            y = of[1] / (of[1] + 2 * of[2])
            raw = (1 - 2 * y * of[2] / of[1], 2 - 3 * y * of[3] / of[2], 3 - 4 * y * of[4] / of[3])
            discounts[n] = [min(max(d, 0.01), k + 0.9) for k, d in enumerate(raw)]
        else:
            discounts[n] = [0.5, 1.0, 1.5]
        totals[n], ends[n] = Counter(), defaultdict(list)
        for g, k in c.items():
            totals[n][g[:-1]] += k
            ends[n][g[:-1]].append(k)

    def p(gram):
        n = len(gram)
        below = 1 / (len(counts[1]) + 1) if n == 1 else p(gram[1:])
        if gram[:-1] not in totals[n]:
            return below
        d = lambda k: discounts[n][min(k, 3) - 1]
        total, k = totals[n][gram[:-1]], counts[n].get(gram, 0)
        held = sum(d(x) for x in ends[n][gram[:-1]])
        return ((k - d(k)) if k else 0) / total + held / total * below

    return p


def expected(texts, p):
    """text -> (negative log probability, symbols)"""
    out = {}
    for t in texts:
        s = quality.START + t.replace("\0", "\ufffd")
        grams = [s[i : i + quality.ORDER] for i in range(len(s) - quality.ORDER + 1)]
        out[t] = (-sum(np.log(p(g)) for g in grams), len(grams))
    return out


@pytest.mark.parametrize("chunk_bytes", [1 << 26, 200])
def test_model_against_textbook(spark, chunk_bytes):
    texts = [words(i, 40, "ab") + ". The End" for i in range(12)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCS)
    model = quality.train(docs)
    asked = [*texts, "x", "Ж漢字\0 \U0001f600 mixed abab", words(77, 300, "zz"), words(3, 9, "ab"), "x", " ", "\n\n\n\n\n\n"]
    rows = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(asked)] + [(99, "", "en", "s", 0), (98, None, "en", "s", 0)], DOCS)
    rows = rows.selectExpr("*", "xxhash64(text) as h")
    text_of = {r["h"]: r["text"] for r in rows.collect()}
    want = expected(set(asked), kneser_ney(texts))
    got = {text_of[r["copy"]]: (r["total"], r["n"]) for r in quality.text_scores(rows, model, chunk_bytes=chunk_bytes).collect()}
    assert got.keys() == want.keys()
    for t, (total, n) in want.items():
        assert got[t][1] == n and got[t][0] == pytest.approx(total, rel=1e-5)


def test_counts_of_many_characters_and_long_texts(monkeypatch):
    monkeypatch.setattr(quality, "BLOCK", 50)
    r = np.random.default_rng(3)
    wide = "".join(map(chr, r.integers(0x4E00, 0x9FFF, 9000)))
    for texts in (["abcabcabc" * 30, "b", "", "xyz\0"], [wide, wide[:700] * 2]):
        for block in (50, 1 << 21):
            monkeypatch.setattr(quality, "BLOCK", block)
            got = Counter()
            for grams, n in quality.count_grams(iter(texts)):
                got.update(dict(zip(grams.tolist(), n.tolist(), strict=True)))
            want = Counter()
            for t in texts:
                s = quality.START + t.replace("\0", "\ufffd")
                want.update(s[i : i + quality.ORDER] for i in range(len(s) - quality.ORDER + 1))
            assert got == want


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("pipeline")
    docs, kept = spark.read.parquet(f"{SF}/documents.parquet"), {"documents": spark.read.parquet(f"{SF}/documents.parquet").toPandas()}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{out}/{name}")
        docs = spark.read.parquet(f"{out}/{name}")
        kept[name] = docs.toPandas()
    return kept


needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")


@needs_tables
def test_columns_and_order(stages):
    names = list(stages["documents"].columns)
    assert all(list(stages[n].columns) == names for n, _ in corpus_pipeline.STAGES[:-1])
    sizes = [len(stages[n]) for n in ("documents", "quality", "near_duplicates", "decontamination", "personal_data")]
    assert sizes == sorted(sizes, reverse=True) and sizes[3] == sizes[4] > 0


@needs_tables
def test_near_duplicates(stages):
    texts = dict(zip(stages["quality"]["doc_id"], stages["quality"]["text"], strict=True))
    kept = set(stages["near_duplicates"]["doc_id"])
    sets = {}
    for i, t in texts.items():
        w = t.lower().split()
        sets[i] = {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    near = defaultdict(set)
    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                near[a].add(b)
                near[b].add(a)
    assert not [(a, b) for a in kept for b in near[a] if b in kept]
    assert all(near[i] & kept for i in texts if i not in kept)


@needs_tables
def test_decontamination(spark, stages):
    runs = lambda t: re.findall(r"[^\W_]+", t.lower())
    items = [runs(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]

    def leaks(text):
        w = runs(text)
        at = defaultdict(list)
        for i, x in enumerate(w):
            at[x].append(i)
        for item in items:
            for shift in {i - k for k, x in enumerate(item) for i in at[x]}:
                same = [0 <= k + shift < len(w) and w[k + shift] == x for k, x in enumerate(item)]
                if sum(same) >= 0.8 * len(item) or (len(item) >= 13 and max(sum(same[i : i + 13]) for i in range(len(item) - 12)) >= 0.8 * 13):
                    return True
        return False

    before = stages["near_duplicates"]
    assert {i for i, t in zip(before["doc_id"], before["text"], strict=True) if not leaks(t)} == set(stages["decontamination"]["doc_id"])


@needs_tables
def test_personal_data(stages):
    before = dict(zip(stages["decontamination"]["doc_id"], stages["decontamination"]["text"], strict=True))
    after = stages["personal_data"]
    assert all(len(t) == n for t, n in zip(after["text"], after["n_chars"], strict=True))
    for i, t in zip(after["doc_id"], after["text"], strict=True):
        spans = base_spans(before[i])
        assert (t == before[i]) if not spans else not any(before[i][a:b] in t for _, a, b in spans)


@needs_tables
def test_packing(stages):
    packed, docs = stages["packing"], stages["personal_data"].set_index("doc_id")
    assert packed.groupby("bin_id")["n_words"].sum().max() <= 2048
    assert (packed.groupby("doc_id")["n_words"].sum() == docs["text"].map(lambda t: len(re.findall(r"\S+", t)))).all()
    source = packed["doc_id"].map(docs["source"])
    assert (source.groupby(packed["bin_id"]).nunique() == packed.groupby("bin_id").size()).all()
