"""Whitening, mixing and fill-in-the-middle: against brute force, SQL and exact round trips."""

import hashlib
import math
import os
import re
from collections import defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import cases
from vellumine.llm import fill_middle, mixing, queries, whitening

SF = "/root/testdata/sf0.001"


def oracle(name, columns, tables):
    con = duckdb.connect()
    for t, path in tables.items():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    rel = con.sql(queries.ORACLE_SQL[name])
    assert sorted(rel.columns) == sorted(columns)
    return sorted(map(str, rel.select(*columns).fetchall()))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
@pytest.mark.parametrize("name", ["op12_mixing", "op13_fill_middle"])
def test_against_sql(spark, name):
    df = queries.QUERIES[name](spark, SF)
    assert sorted(map(str, map(tuple, df.collect()))) == oracle(name, df.columns, {"documents": f"{SF}/documents.parquet"})


@pytest.mark.parametrize("name", ["op12_mixing", "op13_fill_middle"])
def test_awkward_rows_against_sql(spark, tmp_path, name):
    extra = [(8, "<P> held", "en", "a", 8), (9, "a<b P>S <S", "en", "a", 9), (-3, "é漢\U0001f600 x\r\n\x0b\x1cy", "fr", "", 3), (10, "one", "en", "a", 3)]
    docs = cases.awkward(spark).unionByName(spark.createDataFrame(extra, cases.DOCS))
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    df = queries.QUERIES[name](spark, str(tmp_path))
    assert sorted(map(str, map(tuple, df.collect()))) == oracle(name, df.columns, {"documents": f"{tmp_path}/documents.parquet/*.parquet"})


@pytest.mark.parametrize("name", ["op12_mixing", "op13_fill_middle"])
def test_empty_and_clashing(spark, tmp_path, name):
    docs = cases.clashing(spark)
    for c in ("size", "units", "h", "n", "form", "named", "weight", "target", "copies", "place", "rate", "offset", "carried", "held", "rows", "first", "__place", "__part"):
        docs = docs.withColumn(c, F.lit("x"))
    docs.write.parquet(str(tmp_path / "clash" / "documents.parquet"))
    cases.awkward(spark).write.parquet(str(tmp_path / "plain" / "documents.parquet"))
    got, plain = (queries.QUERIES[name](spark, str(tmp_path / d)) for d in ("clash", "plain"))
    assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))
    cases.awkward(spark).limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert queries.QUERIES[name](spark, str(tmp_path / "none")).collect() == []


# --- mixing


def filled(sizes, weights, share, most):
    """Targets by the rule as it is told: deal, stop those that are above, deal the excess again."""
    target, open_ = {s: Fraction(0) for s in sizes}, {s for s in sizes if weights.get(s)}
    left = share * sum(sizes.values())
    while open_ and left:
        part = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        left = Fraction(0)
        for s, p in part.items():
            target[s] += p
            if target[s] >= most * sizes[s]:
                left += target[s] - most * sizes[s]
                target[s] = Fraction(most * sizes[s])
                open_.discard(s)
    return target


def test_targets_and_words_taken(spark):
    r = np.random.default_rng(5)
    rows = []
    for s, count in (("a", 400), ("b", 3), ("c", 40), ("d", 1), (None, 60), ("e", 0), ("f", 25)):
        rows += [(len(rows) + k, " ".join(["w"] * int(r.integers(0, 30))), s) for k in range(count)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    got = mixing.mix(docs, mixing.cyclic_weights(docs, [3, 1, 2])).collect()
    sizes = defaultdict(int)
    for _, text, s in rows:
        sizes[s] += len(text.split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = filled(sizes, {s: [3, 1, 2][k % 3] for k, s in enumerate(order)}, Fraction(3, 2), 2)
    source = {i: s for i, _, s in rows}
    taken, seen = defaultdict(int), defaultdict(float)
    for row in got:
        s = source[row["doc_id"]]
        assert row["source_size"] == sizes[s] and math.isclose(row["target"], float(want[s]), rel_tol=1e-12, abs_tol=1e-9)
        assert row["taken"] <= 2 * row["size"] and row["taken"] == row["copies"] * row["size"]
        taken[s] += row["taken"]
        seen[s] = max(seen[s], row["size"])
    assert len(got) == len(rows)
    for s in sizes:
        assert abs(taken[s] - float(want[s])) <= 2 * seen[s]
    again = mixing.mix(docs.repartition(2), mixing.cyclic_weights(docs, [3, 1, 2])).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_sources_that_are_above(spark):
    docs = spark.createDataFrame([(1, "a " * 10, "s"), (2, "b " * 1000, "t"), (3, "c " * 5, "u")], "doc_id long, text string, source string")
    weights = spark.createDataFrame([("s", 100), ("t", 1), ("u", None), ("v", 7)], "source string, weight long")
    got = {r["doc_id"]: (r["target"], r["copies"]) for r in mixing.mix(docs, weights).collect()}
    assert got[1] == (20.0, 2) and got[3] == (0.0, 0)
    assert math.isclose(got[2][0], 1502.5) and got[2][1] in (1, 2)
    nothing = mixing.mix(docs.withColumn("text", F.lit(None).cast("string")), weights).collect()
    assert {(r["target"], r["taken"]) for r in nothing} == {(0.0, 0)}


def test_mixed_rows_are_whole(spark):
    docs = cases.clashing(spark).withColumn("own", F.lit(3))
    weights = mixing.cyclic_weights(docs, [3, 1, 2])
    got = mixing.mixed(docs, weights)
    assert got.columns == docs.columns
    copies = {(r["doc_id"], r["size"]): 0 for r in mixing.mix(docs, weights).collect()}
    for r in mixing.mix(docs, weights).collect():
        copies[r["doc_id"], r["size"]] += r["copies"]
    held = defaultdict(int)
    for r in got.collect():
        held[r["doc_id"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))] += 1
        assert r["own"] == 3
    assert dict(held) == {k: v for k, v in copies.items() if v}


# --- fill in the middle


def test_parts_and_round_trip(spark):
    texts = ["one two", "<", "<<S", "S><P", "a<M", "P>b", "x" * 5000, "漢<\U0001f600>", "tail<S", "", None, "<M>", "line\nline\r\x00"]
    docs = spark.createDataFrame(list(enumerate(texts * 20)), "doc_id long, text string")
    seen = set()
    for r in fill_middle.arrange(docs).withColumn("restored", fill_middle.restore(F.col("output"), F.col("form"))).collect():
        text = texts[r["doc_id"] % len(texts)] or ""
        units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
        h = [int(hashlib.sha256(f"1:{r['doc_id']}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
        low, high = sorted(x % (len(units) + 1) for x in h[:2])
        plain = not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90
        form = "plain" if plain else "spm" if h[3] % 100 < 20 else "psm"
        p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
        want = {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
        assert (r["n"], r["form"], r["output"], r["restored"]) == (len(units), form, want, text)
        assert (r["prefix"], r["middle"], r["suffix"]) == ((None,) * 3 if plain else (p, m, s))
        seen.add(form)
    assert seen == {"plain", "psm", "spm"}


def test_no_python_worker(spark):
    docs = cases.awkward(spark)
    plan = fill_middle.digests(fill_middle.arrange(docs))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


# --- whitening


def brute(vectors, k):
    """Rows of (id, component) from the whole covariance, by one dense decomposition."""
    good = [(i, np.array(v, float)) for i, v in vectors if v and all(c is not None and math.isfinite(c) for c in v)]
    x = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in good]
    fit = sorted({tuple(v) for _, v in x})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    y = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(v, sums)] for v in fit])
    values, axes = np.linalg.eigh(y.T @ y / n)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    out = []
    for i, v in x:
        d = [n * a - s for a, s in zip(v, sums)]
        w = (np.array([float(Fraction(a, n)) for a in d]) @ axes) / np.sqrt(values)
        out += [(i, c + 1, n, sum(a * a for a in d), w[c], values[c] / np.trace(y.T @ y / n)) for c in range(len(values))]
    return out


def compare(got, want, tolerance=1e-7):
    got, want = sorted(got, key=lambda r: (str(r[0]), r[3], r[1])), sorted(want, key=lambda r: (str(r[0]), r[3], r[1]))
    assert [r[:4] for r in got] == [r[:4] for r in want]
    signs = {}
    for g, w in zip(got, want):
        if abs(w[4]) > 1e-3:
            signs.setdefault(g[1], np.sign(g[4] * w[4]))
        assert abs(g[4] * signs.get(g[1], 1) - w[4]) < tolerance and abs(g[5] / w[5] - 1) < 1e-9
        assert g[6] < 1e-9


@pytest.mark.parametrize("width,rows", [(5, 60), (40, 300), (90, 700)])
def test_whitening_against_brute_force(spark, width, rows):
    r = np.random.default_rng(width)
    made = (r.standard_normal((rows, width)) * np.linspace(3, 0.5, width) + 2).round(3)
    vectors = [(int(i), [float(c) for c in v]) for i, v in enumerate(made)]
    vectors += [(7, vectors[7][1])] * 3 + [(None, vectors[1][1]), (900, None), (901, [1.0] * (width - 1) + [None]), (902, [float("nan")] * width), (903, [float("inf")] * width), (904, [])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(5)
    got = [tuple(x) for x in whitening.whiten(df).collect()]
    compare(got, brute(vectors, min(16, width)))


def test_restarts_keep_the_components(spark, monkeypatch):
    """A subspace that can't grow is started anew, and certifies the same components."""
    monkeypatch.setattr(whitening, "WIDEST", 3)
    monkeypatch.setattr(whitening, "SPARE", 4)
    r = np.random.default_rng(1)
    made = r.standard_normal((500, 60)) * (np.arange(60) * -0.06 + 4)
    vectors = [(int(i), [float(c) for c in v]) for i, v in enumerate(made)]
    got = [tuple(x) for x in whitening.whiten(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"), k=4).collect()]
    compare(got, brute(vectors, 4), 1e-6)


def test_whitening_of_few_flat_and_huge_vectors(spark):
    schema = "vec_id long, embedding array<float>, n int, component string"
    row = lambda i, v: (i, v, 1, "x")
    empty = whitening.whiten(spark.createDataFrame([], schema))
    assert empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and empty.collect() == []
    assert whitening.whiten(spark.createDataFrame([row(1, [1.0, 2.0])] * 3, schema)).collect() == []
    line = whitening.whiten(spark.createDataFrame([row(k, [float(k), 2.0 * k, 1.0]) for k in range(9)], schema)).collect()
    assert len(line) == 9 and {r["component"] for r in line} == {1} and abs(line[0]["explained"] - 1) < 1e-9
    lengths = whitening.whiten(spark.createDataFrame([row(k, [float(k % 5), float(k * k)][: 1 + k % 2]) for k in range(20)], schema)).collect()
    assert {(r["vec_id"] % 2, r["n"]) for r in lengths} == {(0, 5), (1, 10)}
    huge = whitening.whiten(spark.createDataFrame([row(1, [2.0**39]), row(2, [-(2.0**39)]), row(3, [2.0**45]), row(4, [0.0])], schema)).collect()
    assert {r["vec_id"]: r["deviation"] for r in huge} == {1: None, 2: None, 4: 0}
    assert abs(sum(r["whitened"] ** 2 for r in huge) / 3 - 1) < 1e-9


# --- contracts of the earlier operators


def test_columns_of_the_caller_stay(spark):
    from vellumine.llm import decontam, pii, simhash

    docs = cases.clashing(spark)
    for c in ("__own", "__copy", "__new", "__salt", "_kc", "_kid", "_kcopy", "__droppedid"):
        docs = docs.withColumn(c, F.lit("kept"))
    bench = spark.createDataFrame([(1, "no such passage of words at all in any of these texts today")], "item_id long, text string")
    for got in (decontam.decontaminate(docs, bench), simhash.keep_one(docs), pii.sanitise(docs), pii.sanitise(docs, limit=0)):
        assert got.columns == docs.columns
        rows = got.collect()
        assert rows and all(r[c] == "kept" for r in rows for c in ("__own", "__copy", "__new", "__salt", "_kc", "_kid", "_kcopy", "__droppedid")) and {r["_copy"] for r in rows} == {"x"}


def test_every_other_row_is_a_candidate(spark):
    from vellumine.llm import ann

    rows = [(0, [1.0, 2.0]), (0, [2.0, 1.5]), (1, [0.5, 0.5]), (1, [0.5, 0.5]), (20, [2.0, 1.5])]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect()
    want = []
    for k, (i, v) in enumerate(rows):
        if i % 20 == 0:
            near = sorted((-sum(a * b for a, b in zip(v, w)), j) for m, (j, w) in enumerate(rows) if m != k)
            want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(near)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_terms_in_any_capitals(spark):
    from vellumine.llm import pii

    texts = [f"{name} met {k} people, mail k@example.org about {name}" for name in ("İzmirli", "Xzmirli") for k in ("five", "six", "ten", "two")]
    docs = spark.createDataFrame(list(enumerate(texts + [f"nothing here {k}" for k in range(40)])), "doc_id long, text string")
    found = {r["term"] for r in pii.disclosing_terms(docs).collect()}
    assert {"xzmirli", "i̇zmirli"} <= found


def test_links_and_openings_of_unmarked_pages_stay(spark):
    from vellumine.llm import html_template

    long = "words of the article that say something about the matter at hand " * 3
    pages = [
        (1, "http://a.test/1", f"<body><p>{long}</p><p><a href=x>a paragraph that is a link</a></p><p>{long}</p></body>"),
        (2, "http://a.test/2", f"<body><p>An opening before the box.</p><div><p>{long}</p><p>{long}</p></div></body>"),
        (3, "http://b.test/3", f"<body><ul><li><a href=1>Home</a></li><li><a href=2>About</a></li></ul><div><a href=3>Only</a> <a href=4>links</a></div><p data-x=it's>Hello {long}</p><p title=\"a > b\" id=x>More</p><p class='y'>End</p></body>"),
    ]
    got = {r["page_id"]: r["text"] for r in html_template.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    plain = long.strip()
    assert got == {1: f"{plain} a paragraph that is a link {plain}", 2: f"An opening before the box. {plain} {plain}", 3: f"Hello {plain} More End"}


def test_thresholds_come_from_unseen_text(spark):
    from vellumine.llm import quality

    docs = spark.createDataFrame([(k, cases.words(k, 60), "en", "s", 1) for k in range(80)], cases.DOCS)
    marks = spark.createDataFrame([(k, 1, 0) for k in range(80)], "doc_id long, quality int, toxic int")
    held = {r["doc_id"] for r in docs.where(F.pmod(F.xxhash64(F.lit("held"), "text"), F.lit(quality.HELD_OUT)) == 0).collect()}
    rows = quality.score(docs, marks).collect()
    assert 5 < len(held) < 40 and rows[0]["threshold"] == max(r["perplexity"] for r in rows if r["doc_id"] in held)
    assert np.mean([r["perplexity"] for r in rows if r["doc_id"] in held]) > np.mean([r["perplexity"] for r in rows if r["doc_id"] not in held])
