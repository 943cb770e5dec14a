"""Engines, routes and targets of requests that are odd."""

from pyspark.sql import functions as F

from vellumine.operators import requests as rq
from vellumine.sources import formats as fm
from vellumine.sources.text import delimiter

ASKED = [(1, "hwp", "pdf"), (1, "hwp", "pdf"), (2, "doc", "md"), (3, "docx", "docx"), (4, None, "pdf"), (5, "exe", "pdf"), (6, "pdf", None), (7, "odt", "csv")]


def by_id(df, column):
    return sorted((r["id"], r[column]) for r in df.collect())


def test_odd_requests(spark):
    asked = spark.createDataFrame(ASKED, "id long, src string, dst string")
    engines = fm.engine_table(spark)
    assert dict(by_id(rq.with_engine(asked, fm.direct(engines)), "engine")) == {1: "native", 2: None, 3: None, 4: None, 5: None, 6: None, 7: "native"}
    assert dict(by_id(rq.with_engines(asked, engines), "engines")) == {1: "native>libreoffice", 2: None, 3: None, 4: None, 5: None, 6: None, 7: "native>libreoffice"}
    routes = dict(by_id(rq.with_route(asked, fm.routes(fm.engine_table(spark, ("native", "word")))), "route"))
    assert routes == {1: "hwp>pdf", 2: "doc>docx>md", 3: None, 4: None, 5: None, 6: None, 7: "odt>csv"}
    for df in (rq.with_engine(asked, fm.direct(engines)), rq.with_engines(asked, engines)):
        assert df.count() == len(ASKED) and df.limit(0).count() == 0


def test_forced_and_allowed_engines(spark):
    rows = [(1, True, None), (2, False, None), (3, None, None), (4, True, "native"), (5, False, "libreoffice"), (6, True, "excel"), (7, True, "none such")]
    asked = spark.createDataFrame([(i, "xlsx", "csv", e, f) for i, e, f in rows], "id long, src string, dst string, external boolean, forced string")
    got = dict(by_id(rq.with_usable_engines(asked, fm.engine_table(spark)), "usable"))
    assert got == {1: "native>libreoffice>excel", 2: "native", 3: "native", 4: "native", 5: "libreoffice", 6: "excel", 7: None}


def test_abilities_targets_and_sorted_formats(spark):
    files = spark.createDataFrame([(1, "a", "hwp"), (2, "a", "pdf"), (3, "a", "hwp"), (4, "b", None), (5, "c", "exe"), (6, "c", "json")], "id long, owner string, format string")
    known = {r["id"]: (r["can_read"], r["can_write"]) for r in rq.with_abilities(files, fm.formats(spark)).collect()}
    assert known == {1: (True, False), 2: (True, True), 3: (True, False), 4: (False, False), 5: (False, False), 6: (False, True)}
    targets = dict(by_id(rq.with_targets(files, fm.routes(fm.engine_table(spark, ("native",))), fm.formats(spark)), "targets"))
    assert targets[1] == "csv,docx,html,hwpx,json,md,pdf,txt,xlsx" and targets[4] is targets[5] is targets[6] is None
    assert {r["owner"]: r["formats"] for r in rq.sorted_formats(files, "owner").collect()} == {"a": "hwp,pdf", "b": None, "c": "exe,json"}
    assert rq.sorted_formats(files.limit(0), "owner").count() == 0


def test_failure_reports(spark):
    rows = [("pdf", "hwp", ["a"], True), ("doc", "md", [], False), ("doc", "md", None, True), ("doc", "hwp", None, None), ("csv", "xls", ["a", "b", "c", "d", "e"], True), ("md", "txt", None, None)]
    asked = spark.createDataFrame(rows, "src string, dst string, errors array<string>, external boolean")
    got = {(r["src"], r["dst"], r["external"]): r["t"].split("\n")[1:] for r in asked.select("*", rq.failure_text(F.col("src"), F.col("dst"), F.col("errors"), F.col("external")).alias("t")).collect()}
    install = rq.HINTS["doc"]
    assert got == {("pdf", "hwp", True): [rq.TRIED, "  a", rq.HINTS["hwp"]], ("doc", "md", False): [install], ("doc", "md", True): [], ("doc", "hwp", None): [rq.HINTS["hwp"]], ("csv", "xls", True): [rq.TRIED, "  a", "  b", "  c", "  d", install], ("md", "txt", None): []}


def test_delimiters(spark):
    rows = [(0, None, None), (1, "", "csv"), (2, "a,b", "TSV"), (3, "plain", ""), (4, "a;b\nc;d\n", "csv"), (5, '1|"x, y, z"|2', "csv"), (6, "a|b\n" * 40 + "a,b,c,d,e\n" * 400, "csv")]
    texts = spark.createDataFrame(rows, "id int, text string, ext string")
    got = {r["id"]: r["d"] for r in texts.select("id", delimiter(F.col("text"), F.col("ext")).alias("d")).collect()}
    assert got == {0: ",", 1: ",", 2: "\t", 3: ",", 4: ";", 5: "|", 6: "|"}
