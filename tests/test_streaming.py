"""Files that arrive between runs are converted once."""

from vellumine.sinks.office import write_docx
from vellumine.sources.office import block
from vellumine.streaming.ingest import convert_stream


def test_each_file_once(spark, tmp_path):
    source, out, seen = tmp_path / "in", tmp_path / "out", []
    source.mkdir()
    (source / "a.docx").write_bytes(write_docx([block(text="one")]))

    def run():
        convert_stream(spark, str(source), str(out), "txt", checkpoint=str(tmp_path / "ck"), on_batch=lambda df, n: seen.extend(r["path"].rpartition("/")[2] for r in df.collect())).awaitTermination(120)

    run()
    (source / "b.txt").write_text("two")
    (source / "bad.docx").write_bytes(b"PK\x03\x04")
    run()
    run()
    assert sorted(seen) == ["a.docx", "b.txt", "bad.docx"]
    got = {r["path"].rpartition("/")[2]: r for r in spark.read.parquet(str(out)).collect()}
    assert bytes(got["a.docx"]["output"]).decode() == "one\n" and got["bad.docx"]["error"] and got["b.txt"]["error"] is None
