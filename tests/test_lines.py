"""Lines of files as a data source, and files that are committed together."""

import random

import pytest
from pyspark.sql import functions as F

from vellumine.sinks import committed
from vellumine.sources.files import contents
from vellumine.sources.lines import LineReader, line_before, lines_of, read_lines
from vellumine.sources.text import delimiter_of, txt_blocks


def whole(data: bytes):
    """Lines and where they begin, by one pass over all bytes."""
    out, at = [], 0
    for line in data.replace(b"\r\n", b"\n\0").replace(b"\r", b"\n").split(b"\n"):
        start = at + (1 if line.startswith(b"\0") else 0)
        line = line.removeprefix(b"\0")
        out.append((start, line))
        at = start + len(line) + 1
    return out


def test_ranges_give_each_line_once(tmp_path, monkeypatch):
    r = random.Random(3)
    for chunk in (1, 3, 1 << 20):
        monkeypatch.setattr("vellumine.sources.lines.CHUNK", chunk)
        for _ in range(150):
            data = b"".join(r.choice([b"\n", b"\r", b"\r\n", b"a", b"bc", b" "]) for _ in range(r.randrange(0, 25)))
            place = tmp_path / "f"
            place.write_bytes(data)
            step = r.randrange(1, 9)
            with open(place, "rb") as f:
                got = [x for s in range(0, len(data) + 1, step) for x in lines_of(f, s, min(s + step, len(data) + 1))]
                assert got == whole(data)
                for (_, before), (at, _) in zip(got, got[1:]):
                    assert line_before(f, at) == before


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "utf-16", "cp949"])
def test_text_in_ranges(spark, tmp_path, encoding):
    text = "가나다 first\r\n\n\n \nsecond 문서\rthird\n" + "\n" * 40 + "last 줄\n"
    (tmp_path / "a.txt").write_bytes(text.encode(encoding))
    (tmp_path / "empty.txt").write_bytes(b"")
    want = [r["text"] for r in txt_blocks(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("ord").collect()]
    for size in (7, 64, 1 << 20):
        got = read_lines(spark, str(tmp_path), range_bytes=size, encoding=encoding if encoding == "cp949" else None)
        rows = got.orderBy("path", "at").collect()
        assert [r["text"] for r in rows if r["path"].endswith("a.txt")] == want
        assert [(r["at"], r["text"]) for r in rows if r["path"].endswith("empty.txt")] == [(0, "")]


def test_delimited_text(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x;"y;1";z\n1;2;3\n\n')
    (tmp_path / "b.tsv").write_text("p\tq,r\n")
    (tmp_path / "c.csv").write_text('k,"two\nlines, ""quoted"""\nm,n\n')
    (tmp_path / "d.md").write_text("| a | b |\n| - | - |\nplain\n")
    got = {(r["path"].rpartition("/")[2], r["at"]): r["cells"] for r in read_lines(spark, str(tmp_path), glob="[abd].*").collect()}
    assert got[("a.csv", 0)] == ["x", "y;1", "z"] and got[("a.csv", 10)] == ["1", "2", "3"] and got[("a.csv", 16)] == []
    assert got[("b.tsv", 0)] == ["p", "q,r"] and got[("d.md", 0)] == ["a", "b"] and got[("d.md", 20)] is None
    both = read_lines(spark, str(tmp_path / "c.csv"), multiline=True, range_bytes=4).orderBy("at").collect()
    assert [(r["at"], r["cells"]) for r in both[:2]] == [(0, ["k", 'two\nlines, "quoted"']), (26, ["m", "n"])]
    assert delimiter_of("a|b|c\nd|e|f\n") == "|" and delimiter_of("word") == "," and delimiter_of("a,b", "TSV") == "\t"


def test_filters_open_fewer_ranges(spark, tmp_path):
    for k in range(6):
        (tmp_path / f"f{k}.txt").write_text("".join(f"line {n}\n" for n in range(200)))
    (tmp_path / "_hidden").mkdir()
    (tmp_path / "_hidden/x.txt").write_text("no")
    load = lambda: read_lines(spark, str(tmp_path), range_bytes=512, pushdown=True)
    every = load()
    one = load().where(F.endswith("path", F.lit("f3.txt")))
    part = load().where(F.endswith("path", F.lit("f3.txt"))).where("at >= 1000 and at < 1024")
    parts = [df.rdd.getNumPartitions() for df in (every, one, part)]
    assert parts[0] >= 18 and parts[1] <= parts[0] // 5 and parts[2] == 1
    assert every.count() == 6 * 201 and one.count() == 201
    assert [r["text"] for r in part.orderBy("at").collect()] == [r["text"] for r in one.where("at + 0 >= 1000 and at + 0 < 1024").orderBy("at").collect()]
    both = read_lines(spark, str(tmp_path), range_bytes=512)  # without pushdown one load serves all filters
    few = both.where(F.endswith("path", F.lit("f3.txt")))
    assert (few.count(), both.count(), few.where("at < 5").count(), few.count()) == (201, 6 * 201, 1, 201)
    named = read_lines(spark, str(tmp_path), columns="text string")
    assert named.columns == ["text"] and named.count() == 6 * 201
    assert not LineReader({"path": str(tmp_path), "glob": "*.csv"}, every.schema).partitions()[0].value
    with pytest.raises(Exception, match="nowhere"):
        read_lines(spark, str(tmp_path / "nowhere")).collect()


def rows(spark, names, content="x"):
    return spark.createDataFrame([(n, content.encode(), f"{k:03}") for k, n in enumerate(names)], "name string, content binary, source string")


def listed(folder):
    return {p.name: p.read_text() for p in folder.iterdir()}


def test_conflict_policies(spark, tmp_path):
    out = tmp_path / "out"
    out.mkdir()
    (out / "a.md").write_text("old")
    (out / "a (2).md").write_text("old")
    report = str(tmp_path / "report")
    committed.write_files(rows(spark, ["a.md", "a.md", "b", "b"]), str(out), report=report)
    assert listed(out) == {"a.md": "old", "a (1).md": "x", "a (2).md": "old", "a (3).md": "x", "b": "x", "b (1)": "x"}
    saved = {r["source"]: r["saved"].rpartition("/")[2] for r in spark.read.json(report).collect()}
    assert saved == {"000": "a (1).md", "001": "a (3).md", "002": "b", "003": "b (1)"}
    committed.write_files(rows(spark, ["a.md", "c.md"], "new"), str(out), on_conflict="skip")
    assert listed(out)["a.md"] == "old" and listed(out)["c.md"] == "new"
    committed.write_files(rows(spark, ["a.md", "d.md"], "newer"), str(out), on_conflict="error", report=str(tmp_path / "second"))
    assert listed(out)["a.md"] == "old" and listed(out)["d.md"] == "newer"
    assert {r["source"]: r["error"] for r in spark.read.json(str(tmp_path / "second")).collect()} == {"000": "a.md exists", "001": None}
    for _ in range(2):
        committed.write_files(rows(spark, ["a.md", "a.md"], "last"), str(out), on_conflict="overwrite")
    assert listed(out)["a.md"] == "last" and listed(out)["a (1).md"] == "last" and len(listed(out)) == 8


def test_a_failing_task_leaves_nothing(spark, tmp_path):
    with pytest.raises(Exception):
        committed.write_files(rows(spark, [f"f{k}.md" for k in range(40)] + ["../evil"]).repartition(8), str(tmp_path / "out"))
    assert not list((tmp_path / "out").rglob("*")) or listed(tmp_path / "out") == {}


def test_a_task_that_runs_twice_counts_once(tmp_path):
    writer = committed.FileWriter({"path": str(tmp_path)}, False)
    made = [{"name": "a.txt", "content": b"1", "source": "s"}, {"name": "b.txt", "content": None, "source": None}]
    writer.write(iter(made))  # its message was lost with its executor
    again = writer.write(iter(made))
    assert set(p.name for p in tmp_path.iterdir()) == {committed.STAGING}
    writer.commit([again, None])
    assert listed(tmp_path) == {"a.txt": "1", "b.txt": ""}


def test_files_are_opened_by_tasks_that_know_their_names(spark, tmp_path):
    """Nothing is listed by the driver, and names that don't collide aren't kept there."""
    out, report = f"file://{tmp_path}/out", str(tmp_path / "report")
    committed.write_files(rows(spark, ["a b.md", "a b.md", "c%20.md", "empty"]).withColumn("content", F.when(F.col("name") != "empty", F.col("content"))), out, report=report)
    saved = spark.read.schema("saved string").json(report).unionByName(spark.createDataFrame([(f"{out}/gone",), (None,)], "saved string"))
    got = contents(saved, path="saved")
    assert "BinaryFile" not in got._jdf.queryExecution().executedPlan().toString()
    found = {p and p.rpartition("/")[2]: (c and bytes(c), n) for p, c, n in got.collect()}
    assert found == {"a b.md": (b"x", 1), "a b (1).md": (b"x", 1), "c%20.md": (b"x", 1), "empty": (b"", 0), "gone": (None, None), None: (None, None)}
    writer = committed.FileWriter({"path": str(tmp_path / "more")}, False)
    store, folder, _ = committed.opened(writer.folder)
    store.create_dir(folder)
    names = committed.Names(store, folder, "rename")
    for name in ("a", "b", "a"):
        (tmp_path / "more" / names.settle(name)).write_text(name)
    assert sorted(p.name for p in (tmp_path / "more").iterdir()) == ["a", "a (1)", "b"] and not names.mine
