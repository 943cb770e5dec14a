"""Batches: counts as they are committed, and a cancelled batch that leaves nothing."""

import threading
import time

import pyarrow as pa
from pyspark.sql import functions as F

from vellumine.batches import Conversion
from vellumine.sinks.committed import write_files
from vellumine.sources import files


def made(tmp_path, n=12):
    (tmp_path / "in").mkdir()
    for k in range(n):
        (tmp_path / "in" / f"f{k}.md").write_text(f"# Title {k}\n\ntext\n")
    (tmp_path / "in" / "bad.docx").write_bytes(b"PK\x03\x04broken")
    return str(tmp_path / "in")


def test_progress_and_results(spark, tmp_path):
    seen, rows = [], []
    job = Conversion(files.scan(spark, made(tmp_path)), "txt", str(tmp_path / "out"), batches=3)
    for progress, saved in job:
        seen.append(progress)
        rows += saved.collect()
        assert len(list((tmp_path / "out").iterdir())) == progress.done
    last = job.progress
    assert (last.done, last.failed, last.batches, last.of, last.cancelled) == (12, 1, 3, 3, False)
    assert [p.batches for p in seen] == [1, 2, 3] and [p.done for p in seen] == sorted(p.done for p in seen)
    assert len(rows) == 13 and sum(r["error"] is not None for r in rows) == 1
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == sorted(f"f{k}.txt" for k in range(12))
    assert list(job) == []


def test_cancellation_leaves_whole_batches(spark, tmp_path):
    job = Conversion(files.scan(spark, made(tmp_path)), "txt", str(tmp_path / "out"), batches=4)
    for progress, _ in job:
        job.cancel()
    assert job.progress.cancelled and job.progress.batches == 1
    assert len(list((tmp_path / "out").iterdir())) == progress.done


def test_a_running_batch_is_interrupted(spark, tmp_path):
    @F.udf("binary")
    def slow(data):
        time.sleep(15)
        return data

    found = files.scan(spark, made(tmp_path)).withColumn("content", slow("content"))
    job = Conversion(found, "txt", str(tmp_path / "out"), batches=2)
    threading.Timer(6, job.cancel).start()
    began = time.time()
    assert list(job) == [] and time.time() - began < 40
    assert job.progress.cancelled and job.progress.batches == 0
    assert not (tmp_path / "out").exists() or not list((tmp_path / "out").iterdir())


def test_few_files_are_held_at_once(spark):
    """A batch of nested rows is read and written in pieces, not turned into Python objects as a whole."""
    long = "x" * (files.PIECE_BYTES // 4)
    batch = pa.RecordBatch.from_pydict({"k": list(range(3 * files.PIECE_ROWS + 5)), "t": [long] * 20 + ["y"] * (3 * files.PIECE_ROWS - 15)})
    got = list(files.pieces([batch, batch.slice(0, 0)]))
    assert [k for b in got for k in b["k"].to_pylist()] == batch["k"].to_pylist()
    assert all(b.num_rows <= files.PIECE_ROWS and (b.nbytes <= files.PIECE_BYTES or b.num_rows == 1) for b in got)
    seen = []

    class Rows:
        dtypes = [("k", "bigint"), ("t", "string")]

        def mapInArrow(self, each, schema):  # noqa: N802
            assert schema == "k bigint, n int"
            return each([batch])

    out = files._in_pieces(Rows(), lambda b: seen.append(b.num_rows) or {"n": [len(t) for t in b["t"].to_pylist()]}, ["k"], {"n": "int"})
    first = next(out)
    assert len(seen) == 1 and first.num_rows == seen[0] and first["n"].to_pylist() == [len(long)] * seen[0]
    assert sum(b.num_rows for b in out) + first.num_rows == batch.num_rows


def test_small_files_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    """Their bytes are few, so that Spark would merge the tasks unless their number is named."""
    given = spark.range(400).select(F.concat("id", F.lit(".txt")).alias("name"), F.lit(b"x").alias("content"), F.col("id").cast("string").alias("source"))
    dealt, ways = type(given).repartitionByRange, []
    monkeypatch.setattr(type(given), "repartitionByRange", lambda self, *by: ways.append(dealt(self, *by)) or ways[-1])
    write_files(given, str(tmp_path / "out"))
    assert len(list((tmp_path / "out").glob("*.txt"))) == 400
    assert [w.rdd.getNumPartitions() for w in ways] == [int(spark.conf.get("spark.sql.shuffle.partitions"))]
