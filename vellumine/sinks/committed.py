"""Files written whole or not at all: ``df.write.format("vellumine_files").save(folder)``.

Rows are name, content and source. Each task writes its files to a folder of its own below the
target and a list of them; nothing has its final name until all tasks are done. The commit goes
through the lists one after another, settles each name by the conflict policy and moves the file
there. Files of tasks that were run twice, lost or aborted are in no list and go with the folder.

Options: on_conflict, what to do when a name is taken, by a file that was there or an earlier one of
the job: ``rename`` (the least free number is added), ``overwrite`` (files that were there are
replaced, names within the job still get numbers), ``skip`` or ``error`` (the file is left out and
reported); report, a folder for JSON lines of source, saved and error. One job writes to a
folder at a time. Any store that pyarrow opens by its address can be written.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql import datasource as ds
from pyspark.sql.types import StructType

from vellumine.sources.lines import opened

STAGING = "_staging"
POLICIES = ("rename", "overwrite", "skip", "error")


@dataclass
class Done(ds.WriterCommitMessage):
    """Where a task's files are, and its partition."""

    partition: int
    place: str


def numbered(name: str, k: int) -> str:
    stem, dot, ext = name.rpartition(".")
    return f"{stem} ({k}){dot}{ext}" if dot else f"{name} ({k})"


class FileWriter(ds.DataSourceWriter):
    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.folder = options["path"].rstrip("/")
        self.policy = options.get("on_conflict", "overwrite" if overwrite else "rename")
        if self.policy not in POLICIES:
            raise ValueError(f"on_conflict is one of {', '.join(POLICIES)}")
        self.report = options.get("report")
        self.staged = f"{self.folder}/{STAGING}/{uuid.uuid4().hex}"

    # --- in a task

    def write(self, iterator: Iterator[Row]) -> Done:
        context = TaskContext.get()
        partition = context.partitionId() if context else 0
        store, place, _ = opened(f"{self.staged}/{partition}-{uuid.uuid4().hex}")
        store.create_dir(place)
        with store.open_output_stream(f"{place}/list") as listed:
            for k, row in enumerate(iterator):
                if not row["name"] or "/" in row["name"] or "\\" in row["name"] or row["name"] in (".", ".."):
                    raise ValueError(f"no name of a file: {row['name']!r}")
                with store.open_output_stream(f"{place}/{k}") as f:
                    f.write(bytes(row["content"] or b""))
                listed.write(json.dumps([row["name"], row["source"]]).encode() + b"\n")
        return Done(partition, place)

    # --- on the driver

    def commit(self, messages: list[Done | None]) -> None:
        store, folder, _ = opened(self.folder)
        store.create_dir(folder)
        taken = Names(store, folder, self.policy)
        out = None
        if self.report:
            to, place, _ = opened(self.report)
            to.create_dir(place)
            out = to.open_output_stream(f"{place}/{uuid.uuid4().hex}.json")
        for message in sorted(filter(None, messages), key=lambda m: m.partition):
            with store.open_input_stream(f"{message.place}/list") as listed:
                for k, (name, source) in enumerate(map(json.loads, _lines(listed))):
                    final = taken.settle(name)
                    if final:
                        store.move(f"{message.place}/{k}", f"{folder}/{final}")
                    if out:
                        error = f"{name} exists" if not final and self.policy == "error" else None
                        out.write(json.dumps({"source": source, "saved": final and f"{self.folder}/{final}", "error": error}).encode() + b"\n")
        if out:
            out.close()
        self.abort(messages)

    def abort(self, messages: list[Done | None]) -> None:
        """Takes away what isn't committed, and the staging folder when no other job uses it."""
        store, place, _ = opened(self.staged)
        above = place.rpartition("/")[0]
        if store.get_file_info(place).type == fs.FileType.Directory:
            store.delete_dir(place)
        if store.get_file_info(above).type == fs.FileType.Directory and not store.get_file_info(fs.FileSelector(above)):
            store.delete_dir(above)


def _lines(stream) -> Iterator[bytes]:
    rest = b""
    while chunk := stream.read(1 << 20):
        *whole, rest = (rest + chunk).split(b"\n")
        yield from whole


class Names:
    """Final names by policy. Asks the store for each name, where the files before it have theirs already; remembers
    names that collided, and all of the job only to overwrite, when the store doesn't tell old files from the job's."""

    def __init__(self, store: fs.FileSystem, folder: str, policy: str) -> None:
        self.store, self.folder, self.policy = store, folder, policy
        self.mine: set[str] = set()
        self.next: dict[str, int] = {}

    def there(self, name: str) -> bool:
        return self.store.get_file_info(f"{self.folder}/{name}").type != fs.FileType.NotFound

    def settle(self, name: str) -> str | None:
        """The name to move to; None to leave the file out."""
        overwrite = self.policy == "overwrite"
        taken = (lambda n: n in self.mine) if overwrite else self.there
        free = not taken(name)
        if not free and not overwrite and self.policy != "rename":
            return None
        if not free:
            base, k = name, self.next.get(name, 1)
            while taken(numbered(base, k)):
                k += 1
            self.next[base], name = k + 1, numbered(base, k)
        if overwrite:
            self.mine.add(name)
        return name


class Files(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "vellumine_files"

    def schema(self) -> str:
        return "name string, content binary, source string"

    def writer(self, schema: StructType, overwrite: bool) -> FileWriter:
        return FileWriter(dict(self.options), overwrite)


def write_files(files: DataFrame, folder: str, *, on_conflict: str = "rename", report: str | None = None) -> None:
    """Write rows (name, content, source) as files of ``folder``. Names are settled in the order of source, then name."""
    files.sparkSession.dataSource.register(Files)
    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # named, so that they aren't merged: many small files are few bytes, but long work
    rows = files.select("name", "content", "source").repartitionByRange(tasks, "source", "name").sortWithinPartitions("source", "name")
    writer = rows.write.format(Files.name()).mode("append").option("on_conflict", on_conflict)
    (writer.option("report", report) if report else writer).save(folder)
