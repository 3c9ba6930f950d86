"""Files by name, in any store that Arrow opens: ranged reads in tasks, and a sink whose tasks write whole files under given names."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType


def opened(path: str):
    """(file system, path in it) of a path as Spark writes it."""
    from pyarrow import fs

    if "://" not in path:
        return fs.LocalFileSystem(), path.removeprefix("file:")
    scheme, rest = path.split("://", 1)
    if scheme == "file":
        return fs.LocalFileSystem(), rest
    return fs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + "://" + rest)


class NamedFiles(DataSource):
    """Sink for rows (name, seq, data): each name is a file of its rows' data. Rows come sorted, a name in one task."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return NamedFilesWriter(self.options["path"], overwrite)


class NamedFilesWriter(DataSourceArrowWriter):
    """A file grows under a scratch name and is renamed when it is whole, by its task. A task that runs again, or twice at a time, puts the same file in its place."""

    def __init__(self, root: str, overwrite: bool):
        self.root, self.scratch = root.rstrip("/"), f"_writing-{uuid.uuid4().hex}"
        store, at = opened(self.root)
        if overwrite:
            store.delete_dir_contents(at, missing_dir_ok=True)
        store.create_dir(f"{at}/{self.scratch}", recursive=True)

    def write(self, iterator) -> WriterCommitMessage:
        store, root = opened(self.root)
        now, out, aside = None, None, None

        def close():
            if out is not None:
                out.close()
                into = f"{root}/{now}"
                store.create_dir(into.rpartition("/")[0], recursive=True)
                store.move(aside, into)

        for batch in iterator:
            for name, data in zip(batch.column("name").to_pylist(), batch.column("data").to_pylist(), strict=True):
                if name != now:
                    close()
                    now, aside = name, f"{root}/{self.scratch}/{uuid.uuid4().hex}"
                    out = store.open_output_stream(aside)
                out.write(data)
        close()
        return WriterCommitMessage()

    def _clear(self) -> None:
        store, at = opened(self.root)
        store.delete_dir(f"{at}/{self.scratch}")

    def commit(self, messages: list) -> None:
        self._clear()

    def abort(self, messages: list) -> None:
        self._clear()


def write_named(rows: DataFrame, path: str) -> None:
    """`rows(name, seq, data)` -> files under `path`, in the order of seq; files that were there go."""
    rows.sparkSession.dataSource.register(NamedFiles)
    placed = rows.select("name", "seq", rows["data"].cast("binary").alias("data")).repartition("name").sortWithinPartitions("name", "seq")
    placed.write.format("named_files").mode("overwrite").save(path)
