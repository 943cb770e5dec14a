"""Files that keep arriving: each new one is converted once.

The stream's checkpoint remembers which files were taken, so a restarted run goes on where
the last one stopped; a batch is written whole or not at all.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from vellumine.sources.files import convert


def arriving(spark: SparkSession, path: str, *, glob: str | None = None, files_per_batch: int = 1000) -> DataFrame:
    """path, content, length of the files of a folder, as a stream."""
    reader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", str(files_per_batch))
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select("path", "content", "length")


def convert_stream(spark: SparkSession, path: str, out: str, target: str, *, checkpoint: str, on_batch: Callable[[DataFrame, int], None] | None = None, glob: str | None = None) -> StreamingQuery:
    """Convert what is there and stop: path, format, error, output as Parquet under ``out``, a folder for each batch.

    ``on_batch`` sees each batch's result after it is written. A batch that is run again
    after a failure replaces its folder.
    """

    def batch(rows: DataFrame, number: int) -> None:
        place = f"{out}/batch={number}"
        convert(rows, target).write.mode("overwrite").parquet(place)
        if on_batch is not None:
            on_batch(spark.read.parquet(place), number)

    return arriving(spark, path, glob=glob).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(batch).start()
