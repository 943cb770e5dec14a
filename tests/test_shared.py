"""Tables that are cut pass when their scope ends."""

import os

import pytest

from vellumine.plans import conversion
from vellumine.plans import tables as grids
from vellumine.shared import checkpoint_root, cleared, cut, tasks


def tables(spark):
    root = f"{checkpoint_root(spark)}/tables".removeprefix("file:").replace("//", "/")
    return set(os.listdir(root)) if os.path.isdir(root) else set()


def test_cleared(spark):
    before = tables(spark)
    outside = cut(spark.range(3), "outside")
    with cleared(spark):
        passing = cut(spark.range(5), "passing")
        with cleared(spark):
            inner = cut(passing.where("id > 1"), "inner")
            kept = cut(inner.where("id > 2"), "kept", keep=True)
        assert passing.count() == 5
        assert {t.split("-")[0] for t in tables(spark) - before} == {"outside", "passing", "kept"}
    assert {t.split("-")[0] for t in tables(spark) - before} == {"outside", "kept"}
    assert (outside.count(), kept.count()) == (3, 2)


def test_cleared_after_an_error(spark):
    before = tables(spark)
    with pytest.raises(ValueError), cleared(spark):
        cut(spark.range(2), "passing")
        raise ValueError
    with pytest.raises(Exception, match="fails"), cleared(spark):
        cut(spark.range(2).selectExpr("raise_error('fails') as x"), "failing")
    assert tables(spark) == before


def test_tasks_grow_with_rows_not_bytes(spark, monkeypatch):
    """Cells and files are dealt by rows: small tables aren't merged into few tasks, nor is a file one task."""
    assert tasks(spark, 5, 10) == spark.sparkContext.defaultParallelism and tasks(spark, 1001, 10) == 101
    monkeypatch.setattr(grids, "ORDERS", 100)
    monkeypatch.setattr(conversion, "FILES", 20)
    small = "/root/testdata/sf0.001"
    for made, rows, each in ((grids.cells, "orders", 100), (conversion.line_blocks, "documents", 20)):
        assert made(spark, small).rdd.getNumPartitions() == tasks(spark, spark.read.parquet(f"{small}/{rows}.parquet").count(), each) > 4
