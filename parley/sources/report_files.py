"""A sink that puts one text file for each row (name, text) into a folder, all or none of them.

df.select("name", "text").write.format("text_files").mode("append").option("path", uri).save() writes each task's files into a
hidden folder; the commit moves those of successful tasks to their places, an abort removes the hidden folder. Files of
the same name are replaced. uri is any that pyarrow.fs knows; executors and the driver must share it.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


@dataclass
class _Written(WriterCommitMessage):
    folder: str
    names: list[str]


def _place(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


class _Writer(DataSourceWriter):
    def __init__(self, uri: str):
        self.uri, self.hidden = uri, f".pending-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> _Written:
        store, base = _place(self.uri)
        folder, names = posixpath.join(base, self.hidden, uuid.uuid4().hex), []
        store.create_dir(folder, recursive=True)
        for row in iterator:
            name = row["name"]
            if not name or "/" in name or name.startswith("."):
                raise ValueError(f"{name!r} is no file name")
            if row["text"] is None:
                raise ValueError(f"{name} has no text")
            with store.open_output_stream(posixpath.join(folder, name)) as f:
                f.write(row["text"].encode())
            names.append(name)
        return _Written(folder, names)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, base = _place(self.uri)
        store.create_dir(base, recursive=True)
        for m in messages:
            for name in m.names if m else []:
                store.move(posixpath.join(m.folder, name), posixpath.join(base, name))
        self._clean()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clean()

    def _clean(self) -> None:
        from pyarrow import fs

        store, base = _place(self.uri)
        hidden = posixpath.join(base, self.hidden)
        if store.get_file_info(hidden).type != fs.FileType.NotFound:
            store.delete_dir(hidden)


class TextFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "text_files"

    def schema(self) -> str:
        return "name string, text string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("text_files only appends")
        return _Writer(self.options["path"])


def write(files: DataFrame, uri: str) -> None:
    """Put files (name, text) into a folder; names are distinct."""
    files.sparkSession.dataSource.register(TextFiles)
    files.select("name", "text").write.format("text_files").mode("append").option("path", uri).save()
