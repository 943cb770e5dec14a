"""Trees, probes, spans, folds and numbers against brute force."""

import random
from collections import defaultdict
from html.parser import HTMLParser
from itertools import groupby

from pyspark.sql import functions as F

from vellumine.operators import folds, numbering, probes, spatial, trees


def test_numbers_of_hot_and_null_groups(spark):
    r = random.Random(1)
    rows = [(r.choice(["hot"] * 9 + ["b", None, ""]), r.randrange(40), k) for k in range(3000)]
    df = spark.createDataFrame(rows, "g string, v int, __place int").repartition(5)
    got = numbering.numbered(df, [F.col("v").asc(), F.col("__place").asc()], "n", per=["g"]).collect()
    of = defaultdict(list)
    for g, v, k in rows:
        of[g].append((v, k))
    assert {(x["g"], x["v"], x["__place"], x["n"]) for x in got} == {(g, v, k, n) for g, vs in of.items() for n, (v, k) in enumerate(sorted(vs))}
    whole = numbering.numbered(df, [F.col("__place").desc()], "v").collect()
    assert {(x["__place"], x["v"]) for x in whole} == {(k, 2999 - k) for k in range(3000)}
    assert numbering.numbered(df.limit(0), [F.col("v").asc()], "n", per=["g"]).collect() == []


def test_running_max(spark):
    r = random.Random(2)
    rows = [("hot" if k % 4 else f"g{k % 3}", k, r.randrange(100)) for k in range(2000)]
    df = spark.createDataFrame(rows, "g string, k int, v int").repartition(6)
    for before in (True, False):
        got = {x["k"]: x["m"] for x in numbering.running_max(df, F.col("v"), [F.col("k").asc()], "m", per=["g"], before=before).collect()}
        most = {}
        for g, k, v in rows:
            assert got[k] == (most.get(g) if before else max(v, most.get(g, -1)))
            most[g] = max(v, most.get(g, -1))


def test_least_free_numbers(spark):
    taken = {"a": range(1, 101), "b": [2, 3], "c": [1, 2, 4, 4, 5], "d": [0, -3], "e": [*range(1, 51), *range(52, 99)]}
    df = spark.createDataFrame([(k, v) for k, vs in taken.items() for v in vs], "name string, n long")
    assert {r["name"]: r["free"] for r in numbering.least_free(df, "name", "n").collect()} == {"a": 101, "b": 1, "c": 3, "d": 1, "e": 51}


def test_nested_tables_of_any_depth(spark):
    r = random.Random(4)
    rows, of = [], defaultdict(lambda: defaultdict(list))
    for doc in (1, 2):
        kinds = {None: "table"}
        for k in range(60):
            parent = (k - 1 if k % 2 else r.choice(list(kinds))) if k > 1 and doc == 1 else r.choice(list(kinds)) if k else None
            kind = r.choice(["table", "table", "paragraph", "image"]) if doc == 2 or k % 2 else "table"
            if kinds.get(parent) != "table":
                parent = None
            kinds[k] = kind
            rows.append((doc, k, parent, r.randrange(3) if parent is not None else None, r.randrange(3) if parent is not None else None, k, kind, r.choice(["", "x", "y\nz", None])))
            of[doc][parent].append(rows[-1])
    rows.append((1, 99, 1000, 0, 0, 0, "paragraph", "hangs on nothing"))

    def text(doc, block, pad):
        kids = defaultdict(list)
        for b in of[doc][block]:
            kids[b[3], b[4]].append(b)
        if not kids:
            return ""
        cell = {p: "\n".join(filter(None, ((text(doc, b[1], pad) if b[6] == "table" else b[7] if b[6] == "paragraph" else "") for b in sorted(v, key=lambda b: b[5])))) for p, v in kids.items()}
        wide = max(c for _, c in cell) + 1
        width = lambda row: wide if pad and any(x == row for x, _ in cell) else max((c for x, c in cell if x == row), default=-1) + 1
        return "\n".join("\t".join(cell.get((row, c), "") for c in range(width(row))) for row in range(max(x for x, _ in cell) + 1))

    df = spark.createDataFrame(rows, "doc_id int, id int, parent int, r int, c int, ord int, kind string, text string")
    for pad in (False, True):
        _, tables = trees.nested_texts(df, pad=pad)
        got = {(x["doc_id"], x["id"]): x["text"] for x in tables.collect()}
        assert got == {(b[0], b[1]): text(b[0], b[1], pad) for b in rows if b[6] == "table"}

    def walk(doc, block):
        for b in sorted(of[doc][block], key=lambda b: (b[3] or 0, b[4] or 0, b[5])):
            yield b[1]
            if b[6] == "table":
                yield from walk(doc, b[1])

    at = trees.placed(df).orderBy("doc_id", "path").collect()
    assert max(x["depth"] for x in at) >= 4
    for doc in (1, 2):
        assert [x["id"] for x in at if x["doc_id"] == doc] == list(walk(doc, None))
    assert trees.nested_texts(df.limit(0))[1].collect() == [] and trees.placed(df.limit(0)).collect() == []


def test_probes(spark):
    r = random.Random(5)
    words = ["the", "a", "Wörter", "x.y", "漢字", "--", "long-word", "\t", "q"]
    texts = [" ".join(r.choice(words) for _ in range(r.randrange(0, 30))) for _ in range(60)] * 2 + [None, "", "ab"]
    asked = ["", None, "a", "ab", "b", "ter", "the a", "e a W", " the ", "no such", "y x.", "漢", "x.y the a", "rter the a"] + [t[3:40] for t in texts[:20]]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = probes.containing(docs, spark.createDataFrame([(a,) for a in asked], "probe string")).collect()
    want = {(k, p) for k, t in enumerate(texts) if t is not None for p in set(asked) if p is not None and p in t}
    assert len(got) == len(want) and {(x["id"], x["probe"]) for x in got} == want
    plan = probes.containing(docs, spark.createDataFrame([("a b c",)], "probe string"))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_pairs_that_meet_are_found_once(spark):
    r = random.Random(6)
    box = lambda k: (k % 3, k, x := r.uniform(-300, 300), y := r.uniform(-300, 300), x + r.uniform(0, 400), y + r.uniform(0, 90))
    a, b = [box(k) for k in range(80)], [box(k) for k in range(60)]
    schema = "page int, id int, x0 double, y0 double, x1 double, y1 double"
    got = spatial.meeting(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)).collect()
    want = {(p[1], q[1]) for p in a for q in b if p[0] == q[0] and max(p[2], q[2]) <= min(p[4], q[4]) and max(p[3], q[3]) <= min(p[5], q[5])}
    assert len(got) == len(want) and {(x["a_id"], x["b_id"]) for x in got} == want


def test_spans_take_the_next_free_slot(spark):
    r = random.Random(7)
    rows = [(t, row, k, r.choice([1, 1, 1, 2, 3, 0]), r.choice([1, 1, 2, 3])) for t in range(6) for row in range(25) if row % 9 for k in range(r.randrange(1, 5))]
    want = {}
    for t in range(6):
        held = set()
        for row in range(25):
            c = 0
            for _, _, k, rs, cs in [x for x in rows if x[:2] == (t, row)]:
                while (row, c) in held:
                    c += 1
                want[t, row, k] = c
                held |= {(row + i, c + j) for i in range(max(rs, 1)) for j in range(max(cs, 1))}
                c += max(cs, 1)
    got = folds.spanned_slots(spark.createDataFrame(rows, "table_id int, r int, k int, row_span int, col_span int").repartition(4)).collect()
    assert len(got) == len(rows) and {(x["table_id"], x["r"], x["k"]): x["c"] for x in got} == want


def slots_by_hand(rows):
    want = {}
    for t, of in groupby(sorted(rows, key=lambda x: (str(x[0]), x[1:3])), key=lambda x: x[0]):
        held = set()
        for row, cells in groupby(of, key=lambda x: x[1]):
            c = 0
            for _, _, k, rs, cs in cells:
                while (row, c) in held:
                    c += 1
                want[t, row, k] = c
                held |= {(row + i, c + j) for i in range(max(rs, 1)) for j in range(max(cs, 1))}
                c += max(cs, 1)
    return want


def test_spanned_tables_are_cut_where_no_cell_reaches(spark, monkeypatch):
    """Tables of many cells are shared by tasks, with the columns that whole tables get; a null id is a table too."""
    monkeypatch.setattr(folds, "CELLS", 60, raising=False)
    monkeypatch.setattr(folds, "PIECE_ROWS", 5, raising=False)
    r = random.Random(12)
    rows = [(t, row, k, r.choice([1] * 6 + [2, 3, 0]), r.choice([1, 1, 2, 3])) for t, n in (("long", 80), (None, 50), ("", 40), ("x", 6), ("y", 9)) for row in range(n) if row % 9 for k in range(r.randrange(1, 5))]
    rows += [("held", row, k, 37 if (row, k) == (4, 1) else 1, 1) for row in range(60) for k in range(3)]  # a cell that reaches over several pieces
    schema = "table_id string, r int, k int, row_span int, col_span int"
    want = slots_by_hand(rows)
    df = spark.createDataFrame(rows, schema).repartition(4)
    got = folds.spanned_slots(df).collect()
    assert len(got) == len(rows) and {(x["table_id"], x["r"], x["k"]): x["c"] for x in got} == want
    pieces = folds._pieces(df.selectExpr("table_id", "r", "k", "greatest(row_span, 1) as rs", "greatest(col_span, 1) as cs")).select("table_id", "piece").distinct().groupBy("table_id").count().collect()
    assert dict(map(tuple, pieces))["long"] > 5 and 4 <= dict(map(tuple, pieces))["held"] < 8
    assert folds.spanned_slots(df.limit(0)).collect() == []


def test_spanned_slots_of_dealt_tables_need_no_shuffle(spark):
    rows = [(t, row, k, 1 + (row + k) % 3 // 2, 1 + k % 2) for t in range(5) for row in range(12) for k in range(3)]
    df = spark.createDataFrame(rows, "table_id int, r int, k int, row_span int, col_span int").repartition(4, "table_id")
    got = folds.spanned_slots(df)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Sort [") == 1 and "collect_list" not in plan
    assert {(x["table_id"], x["r"], x["k"]): x["c"] for x in got.collect()} == slots_by_hand(rows)


def test_trees_are_joined_in_small_tasks(spark, monkeypatch):
    r = random.Random(11)
    rows = [(d, k, (k - 1) // 3 if k else None, r.randrange(2), r.randrange(2), k, "table" if k < 20 else "paragraph", str(k)) for d in range(4) for k in range(50)]
    df = spark.createDataFrame(rows, "doc_id int, id int, parent int, r int, c int, ord int, kind string, text string")
    wanted = [sorted(map(tuple, t.collect())) for t in trees.nested_texts(df, pad=True)]
    monkeypatch.setattr(trees, "ROWS", 20)
    assert [sorted(map(tuple, t.collect())) for t in trees.nested_texts(df, pad=True)] == wanted
    assert trees.paired(df, df.select("doc_id", "id"), ["doc_id", "id"]).rdd.getNumPartitions() == 20


def test_wrap_without_a_fold(spark):
    """Text is wrapped by one match for each piece; only text that holds the mark of wide characters is folded."""
    r = random.Random(9)
    texts = ["", "\uffff", "a\uffff" * 9, "\n\r\u2028"] + ["".join(r.choice("ab漢ᄀᄁ\n\uffff"[: 6 + k % 2]) for _ in range(r.randrange(40))) for k in range(40)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for width in (1, 2, 3, 8):
        assert df.where(folds.wrap(F.col("t"), width) != folds.wrap_by_fold(F.col("t"), width)).count() == 0
    long = spark.createDataFrame([("ab漢" * 20,)], "t string")
    broken = spark.createDataFrame([("ab\uffff" * 20,)], "t string")
    assert long.select(F.size(folds.wrap(F.col("t"), 8))).first()[0] == broken.select(F.size(folds.wrap(F.col("t"), 8))).first()[0]


def test_wrap(spark):
    r = random.Random(8)
    texts = ["", None, "x" * 7, "漢" * 5 + "a"] + ["".join(r.choice("ab漢ᄀᄁ\n\U0001f600") for _ in range(r.randrange(60))) for _ in range(60)]
    got = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", folds.wrap(F.col("t"), 7).alias("p")).collect()
    for x in got:
        out, used = [""], 0
        for ch in texts[x["k"]] or "":
            w = 2 if ord(ch) > 0x1100 else 1
            if used + w > 7:
                out, used = out + [""], 0
            out[-1], used = out[-1] + ch, used + w
        assert x["p"] == out


class Runs(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.open, self.links, self.out = defaultdict(int), [], []

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.add("\n")
        if tag in folds.STYLE_TAGS:
            self.open[folds.STYLE_TAGS[tag]] += 1
        if tag == "a":
            self.links.append(dict(attrs).get("href", ""))

    def handle_endtag(self, tag):
        style = folds.STYLE_TAGS.get(tag)
        if style and self.open[style]:
            self.open[style] -= 1
        if tag == "a" and self.links:
            self.links.pop()

    def add(self, text):
        self.out.append((text, *(self.open[s] > 0 for s in folds.STYLES), (self.links[-1] if self.links else None) or None))

    handle_data = add


def test_styles_combine_at_any_depth(spark):
    r = random.Random(9)
    parts = ["<b>", "</b>", "<i>", "</i>", "<EM>", "</em>", '<a href="u?1">', "</a>", "<a href='v'>", "<del>", "</del>", "<code>", "</code>", "<br>", "<p class=x>", "</p>", "text ", "more", "<u>", "</u>", "<!-- no -->"]
    pages = ['<p>a <i>b <b>c <a href="l">d</a></b></i> e</p>'] + ["".join(r.choice(parts) for _ in range(40)) for _ in range(80)] + [None, ""]
    got = spark.createDataFrame(list(enumerate(pages)), "k int, h string").select("k", folds.inline_runs(F.col("h")).alias("r")).collect()
    for x in got:
        parser = Runs()
        parser.feed(pages[x["k"]] or "")
        parser.close()
        merged = lambda rows: [(k, "".join(t for t, *_ in g)) for k, g in groupby(rows, key=lambda q: q[1:])]
        assert merged([tuple(q) for q in x["r"]]) == merged(parser.out)
    first = next(x for x in got if x["k"] == 0)["r"]
    assert [(q["text"], q["bold"], q["italic"], q["href"]) for q in first] == [("a ", False, False, None), ("b ", False, True, None), ("c ", True, True, None), ("d", True, True, "l"), (" e", False, False, None)]


def test_components_are_not_broadcast(spark, monkeypatch):
    plans = []
    real = spatial.cut
    monkeypatch.setattr(spatial, "cut", lambda df, name="cut", **k: (plans.append((name, df._jdf.queryExecution().executedPlan().toString())), real(df, name, **k))[1])
    edges = spark.createDataFrame([(1, 1, 2), (1, 2, 3), (2, 5, 6)], "page long, a long, b long")
    nodes = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (1, 4), (2, 5), (2, 6)], "page long, id long")
    got = sorted(tuple(r) for r in spatial.components(edges, nodes).collect())
    assert got == [(1, 1, 1), (1, 2, 1), (1, 3, 1), (1, 4, 4), (2, 5, 5), (2, 6, 5)]
    assert any("Join" in plan for _, plan in plans)
    assert not any("BroadcastHashJoin" in plan for _, plan in plans)


def test_colours_need_a_hexadecimal_opacity(spark):
    from vellumine.functions.colours import hex_to_rgb

    df = spark.createDataFrame([("x1234567",), ("FF123456",), ("#123456",), ("zz123456",)], "t string")
    assert [r[0] and tuple(r[0]) for r in df.select(hex_to_rgb(F.col("t"))).collect()] == [None, (18, 52, 86), (18, 52, 86), None]


def test_fixed_offsets_hold_wide_keys(spark, tmp_path):
    from vellumine.plans import QUERIES

    keys = [(5_000_000_000, 70_000), (1, 2), (65_536, 4_294_967_296)]
    spark.createDataFrame(keys, "o_orderkey long, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    got = sorted((r["o_orderkey"], r["col"], r["width"]) for r in QUERIES["src45_fixed_offsets"](spark, str(tmp_path)).collect())
    assert got == sorted((o, c, o) for o, c in keys)
