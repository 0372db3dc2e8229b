"""A data source that writes a file per row from the tasks and shows all of them at once, or none."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType


@dataclass
class Written(WriterCommitMessage):
    folder: str | None
    n: int


class FileWriter(DataSourceWriter):
    """Each attempt of a task writes to a folder of its own beside the target. The commit drops the folders of attempts
    that didn't count and renames the rest to the target, one rename where folders can be renamed."""

    def __init__(self, path: str, schema: StructType, overwrite: bool) -> None:
        if not {"name", "content"} <= set(schema.names):
            raise ValueError("files need the columns name and content")
        self.path, self.overwrite, self.id = re.sub("^file:/+", "/", path).rstrip("/"), overwrite, uuid.uuid4().hex
        fs, where = self._target()
        if fs.get_file_info(where).type != FileType.NotFound and not overwrite:
            raise FileExistsError(self.path)

    def _target(self) -> tuple[FileSystem, str]:
        return FileSystem.from_uri(self.path)

    def _staged(self, where: str) -> str:
        return f"{where}.writing-{self.id}"

    def write(self, iterator: Iterator[Row]) -> Written:
        fs, where = self._target()
        folder, names = f"part-{uuid.uuid4().hex}", set()
        for row in iterator:
            name, content = row["name"], row["content"]
            if not name or "/" in name or name in names:
                raise ValueError(f"a file can't be named {name!r}" if not name or "/" in name else f"two files are named {name!r}")
            if not names:
                fs.create_dir(f"{self._staged(where)}/{folder}")
            names.add(name)
            with fs.open_output_stream(f"{self._staged(where)}/{folder}/{name}") as f:
                f.write(content.encode() if isinstance(content, str) else bytes(content or b""))
        return Written(folder if names else None, len(names))

    def commit(self, messages: list[Written | None]) -> None:
        fs, where = self._target()
        staged, kept = self._staged(where), {m.folder for m in messages if m and m.folder}
        fs.create_dir(staged)
        for found in fs.get_file_info(FileSelector(staged)):
            if found.base_name not in kept:
                fs.delete_dir(found.path)
        old = None
        if fs.get_file_info(where).type != FileType.NotFound:
            old = f"{where}.old-{self.id}"
            fs.move(where, old)
        fs.move(staged, where)
        if old:
            fs.delete_dir(old)

    def abort(self, messages: list[Written | None]) -> None:
        fs, where = self._target()
        if fs.get_file_info(self._staged(where)).type != FileType.NotFound:
            fs.delete_dir(self._staged(where))


class FileSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "evispark_files"

    def writer(self, schema: StructType, overwrite: bool) -> FileWriter:
        return FileWriter(self.options["path"], schema, overwrite)


def write_files(files: DataFrame, path: str, overwrite: bool = True) -> None:
    """Rows (name, content as text or bytes) as files ``{path}/part-…/{name}``, all at once or not at all.

    Nothing passes the driver but a folder's name per task. ``path`` is a folder that tasks and driver share, of any
    file system that Arrow knows. Names are plain, without a slash; null content is an empty file. A name that repeats
    in one task is an error, one that repeats in another task stands in another part. No rows give an empty folder.
    Other columns are ignored. What was there goes if ``overwrite``, else it is an error.
    """
    files.sparkSession.dataSource.register(FileSink)
    writer = files.select("name", "content").write.format("evispark_files")
    writer.mode("overwrite" if overwrite else "append").save(path)
