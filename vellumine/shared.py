"""Session helpers that every part of the engine uses."""

from __future__ import annotations

import os
import tempfile
import uuid
import warnings
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest side that is broadcast, by its measured rows and a bound on the bytes of a row.
BROADCAST_BYTES = 64 << 20
#: Folders of the tables that are deleted when the innermost ``cleared`` ends.
_PASSING: ContextVar[list[str] | None] = ContextVar("passing", default=None)


def checkpoint_root(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset a temporary
    folder is set once for the session, if all of Spark runs on this machine; a cluster
    without a shared folder is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not root:
        if not context.getCheckpointDir() and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = context.getCheckpointDir() or f"file://{os.path.join(tempfile.gettempdir(), 'checkpoints', uuid.uuid4().hex)}"
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(root)
    return root


def cut(df: DataFrame, name: str = "cut", *, keep: bool = False) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back.

    Lineage ends there: a lost executor costs a read, not a recomputation. Within ``cleared`` the
    table goes when that ends, but with ``keep``.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/tables/{name}-{uuid.uuid4().hex}"
    passing = _PASSING.get()
    if passing is not None and not keep:
        passing.append(path)  # before it is written: what a failed job leaves goes too
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def cleared(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables that are cut inside, also after an error; what outlasts them is cut with ``keep``.

    Only this thread's tables are known. A table that can't be deleted stays until the folder is cleared.
    """
    made: list[str] = []
    token = _PASSING.set(made)
    try:
        yield
    finally:
        _PASSING.reset(token)
        for path in made:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            try:
                where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
            except Py4JJavaError as e:
                warnings.warn(f"{path} stays: {e.java_exception}", stacklevel=2)


def fresh(*taken: DataFrame, stem: str) -> str:
    """A column name that none of the tables has."""
    names = {c.lower() for df in taken for c in df.columns}
    return next(n for n in (f"__{stem}{k or ''}" for k in range(len(names) + 1)) if n.lower() not in names)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks(spark: SparkSession, rows: int, each: int) -> int:
    """So many tasks that one has about ``each`` rows, and as many as run at once at least."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // each))


def dealt(df: DataFrame, *keys: str, each: int) -> DataFrame:
    """``df``, which is cheap to count, by ``keys`` to tasks of about ``each`` rows.

    They aren't merged by their bytes, which don't tell the work where rows are to become many, or files.
    """
    return df.repartition(tasks(df.sparkSession, df.count(), each), *keys)


def sized_join(large: DataFrame, small: DataFrame, on: str | list[str] | Column, how: str = "inner", *, row_bytes: int = 64, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``large`` joined to ``small``, which is broadcast if its rows times ``row_bytes`` fit ``limit``; else both are shuffled."""
    return large.join(F.broadcast(small) if small.count() * row_bytes <= limit else small, on, how)
