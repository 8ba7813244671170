"""A sink of many small files: each row is a file of its own, named by the row."""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from .trees import opened

#: Files that are moved at a time.
MOVERS = 32


@dataclass
class Staged(WriterCommitMessage):
    """The names of a task's files, under its own staging folder."""

    folder: str
    names: list


class FileWriter(DataSourceWriter):
    """Tasks write to staging folders; files are moved to their names when all have succeeded, so a task that runs twice or is
    lost leaves nothing behind. With overwrite, files of other names in the folder go."""

    def __init__(self, options, overwrite: bool):
        self.path, self.overwrite, self.job = options["path"].rstrip("/"), overwrite, uuid.uuid4().hex

    def write(self, rows) -> Staged:
        folder, names = f"{self.path}/_staging-{self.job}/{uuid.uuid4().hex}", []
        where, at = opened(folder)
        where.create_dir(at, recursive=True)
        for row in rows:
            name, content = row[0], row[1]
            if "/" in name or name.startswith(("_", ".")):
                raise ValueError(f"not a file name: {name!r}")
            with where.open_output_stream(f"{at}/{len(names)}") as out:
                out.write(content)
            names.append(name)
        return Staged(folder, names)

    def commit(self, messages: list) -> None:
        where, root = opened(self.path)
        names = [n for m in messages if m for n in m.names]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("two rows have the same file name")
        if self.overwrite:
            from pyarrow import fs

            keep = set(names)
            for f in where.get_file_info(fs.FileSelector(root, allow_not_found=True)):
                if f.type == fs.FileType.File and f.base_name not in keep:
                    where.delete_file(f.path)
        moves = ((f"{opened(m.folder)[1]}/{k}", f"{root}/{n}") for m in messages if m for k, n in enumerate(m.names))
        with ThreadPoolExecutor(MOVERS) as pool:
            for _ in pool.map(lambda x: where.move(*x), moves):
                pass
        self._clear(where, root)

    def abort(self, messages: list) -> None:
        self._clear(*opened(self.path))

    def _clear(self, where, root: str) -> None:
        from pyarrow import fs

        at = f"{root}/_staging-{self.job}"
        if where.get_file_info(at).type == fs.FileType.Directory:
            where.delete_dir(at)


class NamedFiles(DataSource):
    """write.format("metrika_files").save(folder) of (name string, content binary)."""

    @classmethod
    def name(cls) -> str:
        return "metrika_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> FileWriter:
        return FileWriter(self.options, overwrite)


def write_files(df: DataFrame, folder: str, name: str = "name", content: str = "content", mode: str = "append") -> None:
    """A file for each row of df under the folder; text is written as UTF-8. mode: append, or overwrite, which also removes
    files that are not written again. Names must differ; their list is what the driver gets."""
    spark: SparkSession = df.sparkSession
    spark.dataSource.register(NamedFiles)
    df.select(F.col(name).alias("name"), F.col(content).cast("binary").alias("content")).write.format(NamedFiles.name()).mode(mode).save(folder)
