import numpy as np
import pytest
import xxhash

from tests.llm.cases import DOCS, awkward, clashing, words
from vellumine.llm import simhash


def plain(text, width=3):
    """Bit by bit, as the contract words it."""
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", "one", "One two", "A b C d e\x0b\x0cf", "É È x y z", words(1, 300), "x " * 50])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain(text)


def brute(fps, radius):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {f: find(f) for f in fps}


@pytest.mark.parametrize("bucket_rows", [20_000, 3])
def test_links_against_brute_force(spark, bucket_rows):
    r = np.random.default_rng(3)
    base = [int(x) for x in r.integers(0, 1 << 62, 40)]
    fps = sorted({f ^ (1 << int(r.integers(64))) ^ (1 << int(r.integers(64))) for f in base for _ in range(6)} | {f ^ 7 for f in base})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = simhash.linked(spark.createDataFrame([(f,) for f in signed], "fp long"), radius=2, bucket_rows=bucket_rows)
    got = {r["node"] & (2**64 - 1): r["root"] & (2**64 - 1) for r in simhash.components(edges).collect()}
    expected = brute(fps, 2)
    same = lambda m: sorted(sorted(f for f in fps if m.get(f, f) == c) for c in {m.get(f, f) for f in fps})
    assert same(got) == same(expected)


def test_gray_index_matches_scan():
    r = np.random.default_rng(5)
    fps = np.unique(r.integers(0, 1 << 16, 900).astype(np.uint64))
    groups = (fps & np.uint64(3)).astype(np.int64)
    index = simhash.GrayIndex(fps, groups)
    got = {tuple(sorted((int(index.fps[a]), int(index.fps[b])))) for x, y in index.pairs(2) for a, b in zip(x, y, strict=True)}
    want = {(int(a), int(b)) for i, a in enumerate(fps) for b in fps[i + 1 :] if (int(a) ^ int(b)).bit_count() <= 2 and a & np.uint64(3) == b & np.uint64(3)}
    assert got == want


def test_awkward_rows(spark):
    rows = simhash.near_duplicates(clashing(spark)).collect()
    assert len(rows) == awkward(spark).count()
    blank = [r for r in rows if r["fingerprint"] == "0" * 16]
    assert len(blank) == 4 and {r["component_id"] for r in blank} == {2}
    assert simhash.near_duplicates(awkward(spark).limit(0)).count() == 0


def test_same_without_broadcast(spark, monkeypatch):
    want = sorted(map(str, simhash.near_duplicates(awkward(spark)).collect()))
    monkeypatch.setattr(simhash, "BROADCAST_BYTES", 0)
    assert sorted(map(str, simhash.near_duplicates(awkward(spark)).collect())) == want


def test_keep_one(spark):
    a, b = words(1, 200), words(2, 200)
    near = " ".join([*a.split()[:150], "changed", *a.split()[151:]])
    far = " ".join([*a.split()[:100], *words(9, 100).split()])
    rows = [(5, a, "en", "s", 1), (3, near, "en", "s", 1), (9, a, "en", "s", 1), (4, b, "en", "s", 1), (8, far, "en", "s", 1), (7, a.upper(), "en", "s", 1)]
    kept = simhash.keep_one(spark.createDataFrame(rows, DOCS))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 8]


def test_keep_one_large_group(spark):
    a = words(1, 120).split()
    rows = [(i, " ".join([*a[: i % 119], f"edit{i}", *a[i % 119 + 1 :]]), "en", "s", 1) for i in range(60)]
    rows += [(1000 + i, words(100 + i, 80), "en", "s", 1) for i in range(20)]
    kept = simhash.keep_one(spark.createDataFrame(rows, DOCS), group_rows=8)
    ids = sorted(r["doc_id"] for r in kept.collect())
    assert len([i for i in ids if i < 1000]) == 1 and len([i for i in ids if i >= 1000]) == 20


def survivors(texts):
    """By the definition: in order, each text stays unless an earlier one that stays is similar."""
    stay = []
    for i, t in enumerate(texts):
        if not any(simhash.jaccard(simhash.shingles(texts[k]), simhash.shingles(t)) >= simhash.SIMILARITY for k in stay):
            stay.append(i)
    return stay


def test_one_rule_for_groups_of_any_size(spark):
    base = words(3, 400).split()
    chain = [" ".join(base[8 * i : 8 * i + 100]) for i in range(16)]  # neighbours are similar, second neighbours are not
    star = [" ".join([*base[300:380], *(f"x{k}{j}" for j in range(8))]) for k in range(8)] + [" ".join(base[300:380])]
    clique = [" ".join([*base[:150], f"y{k}"]) for k in range(12)]
    texts = chain + star + clique + [words(500 + k, 30) for k in range(6)]
    assert simhash.jaccard(*map(simhash.shingles, chain[:2])) >= 0.8 > simhash.jaccard(*map(simhash.shingles, chain[::2][:2]))
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCS)
    want = survivors(texts)
    assert len([i for i in want if i < 16]) == 8
    for group_rows in (2, 5, 200):
        assert sorted(r["doc_id"] for r in simhash.keep_one(docs, group_rows=group_rows).collect()) == want


def test_hot_shingles_only_widen_groups(spark):
    texts = [" ".join([*words(1, 40).split(), f"z{k}", *words(k + 50, 6 * (k % 3)).split()]) for k in range(24)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCS)
    assert sorted(r["doc_id"] for r in simhash.keep_one(docs, hot_rows=3).collect()) == survivors(texts)


def test_keep_one_awkward(spark):
    got = simhash.keep_one(clashing(spark)).select("doc_id", "text").collect()
    assert sorted(r["doc_id"] or 0 for r in got) == [0, 1, 2, 5, 6, 7]
    assert simhash.keep_one(awkward(spark).limit(0)).count() == 0


def test_keep_one_beyond_the_radius(spark):
    rows, pairs = [], 0
    for seed in range(400):
        a = words(seed, 60).split()
        b = [*a[:40], *words(9000 + seed, 2, "x").split(), *a[42:]] if seed % 2 else [*words(9000 + seed, 6, "x").split(), *a]
        alike = simhash.jaccard(simhash.shingles(" ".join(a)), simhash.shingles(" ".join(b)))
        apart = (simhash.fingerprint(" ".join(a), 1) ^ simhash.fingerprint(" ".join(b), 1)).bit_count()
        if alike >= 0.8 and apart > simhash.STAGE_RADIUS:
            rows += [(2 * pairs, " ".join(a), "en", "s", 1), (2 * pairs + 1, " ".join(b), "en", "s", 1)]
            pairs += 1
    assert pairs > 20
    kept = simhash.keep_one(spark.createDataFrame(rows, DOCS))
    assert sorted(r["doc_id"] for r in kept.collect()) == [2 * i for i in range(pairs)]


def test_prefixes_of_similar_sets_meet():
    r = np.random.default_rng(7)
    for n in [*range(1, 60), 200]:
        x = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64))
        frequent = np.sort(r.choice(x, len(x) // 2, replace=False))
        for gone in range(len(x)):
            for new in range(len(x) // 4 + 1):
                y = np.unique(np.r_[r.choice(x, len(x) - gone, replace=False), r.integers(0, 1 << 63, new).astype(np.uint64)])
                if simhash.jaccard(x, y) < simhash.SIMILARITY:
                    break
                assert np.isin(simhash.prefix(x, frequent), simhash.prefix(y, frequent)).any()
