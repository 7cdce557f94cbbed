"""A sink for one document that is too large for a row: pieces of text, in order, as part files of one folder.

    pieces.write.format("textparts").mode("append").option("path", folder).save()

Each task writes the pieces of its partition, in their order, to a staging folder inside the target. The commit moves the
parts of the successful attempts to part-00000 and so on, in order of the partitions, and marks the end with _SUCCESS;
read one after the other they are the document. A job that fails leaves none of its parts. mode("overwrite") replaces
earlier parts, mode("append") needs a folder without parts. The folder is a local path, which all executors then have to
reach, or a URI of a store that pyarrow knows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow.fs import FileSelector, FileSystem, FileType, LocalFileSystem
from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

BUFFER_BYTES = 1 << 20


def store_and_path(folder: str) -> tuple[FileSystem, str]:
    if folder.startswith("file:"):
        return LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")
    return FileSystem.from_uri(folder) if "://" in folder else (LocalFileSystem(), folder)


def parts(folder: str) -> list[str]:
    """Paths of the parts of a committed document, in order."""
    store, path = store_and_path(folder)
    found = store.get_file_info(FileSelector(path, allow_not_found=True))
    return sorted(x.path for x in found if x.type == FileType.File and x.base_name.startswith("part-"))


@dataclass
class Part(WriterCommitMessage):
    number: int
    staged: str


class TextParts(DataSourceWriter):
    def __init__(self, folder: str, overwrite: bool):
        self.folder, self.overwrite = folder, overwrite
        self.staging = f"_staging-{uuid.uuid4().hex}"
        if not overwrite and parts(folder):
            raise ValueError(f"{folder!r} has a document already")

    def write(self, iterator: Iterator) -> Part:
        store, path = store_and_path(self.folder)
        task = TaskContext.get()
        staged = f"{path}/{self.staging}/{task.partitionId():05d}-{task.attemptNumber()}"
        store.create_dir(f"{path}/{self.staging}", recursive=True)
        with store.open_output_stream(staged, buffer_size=BUFFER_BYTES) as out:
            for row in iterator:
                out.write(row[0].encode())
        return Part(task.partitionId(), staged)

    def commit(self, messages: list) -> None:
        store, path = store_and_path(self.folder)
        if self.overwrite:
            for old in [*parts(self.folder), f"{path}/_SUCCESS"]:
                if store.get_file_info(old).type != FileType.NotFound:
                    store.delete_file(old)
        for message in sorted((m for m in messages if m), key=lambda m: m.number):
            store.move(message.staged, f"{path}/part-{message.number:05d}")
        self.abort(messages)
        store.open_output_stream(f"{path}/_SUCCESS").close()

    def abort(self, messages: list) -> None:
        """Deletes the staging folder, whatever is left in it."""
        store, path = store_and_path(self.folder)
        if store.get_file_info(f"{path}/{self.staging}").type != FileType.NotFound:
            store.delete_dir(f"{path}/{self.staging}")


class TextPartsSource(DataSource):
    @classmethod
    def name(cls):
        return "textparts"

    def writer(self, schema, overwrite: bool):
        if len(schema.fields) != 1 or schema.fields[0].dataType.simpleString() != "string":
            raise ValueError("one column of text is written")
        return TextParts(self.options["path"], overwrite)
