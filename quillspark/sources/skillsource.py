"""Skill folders as a data source: spark.read.format("skillfolder").load(path).

A partition is one pack, that is one folder below the path; a filter on the pack is pushed down, so folders of other
packs are not listed or opened. Files are opened through Arrow's file systems, so the path may be local or on any store
that Arrow knows, as long as executors reach it.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

SCHEMA = "pack string, folder string, path string, text string, extra_files array<string>"


class PackPartition(InputPartition):
    """One pack's folder."""

    def __init__(self, pack: str):
        super().__init__(pack)
        self.pack = pack


class SkillReader(DataSourceReader):
    """Reads every file of the wanted name below the packs that the filters leave."""

    def __init__(self, path: str, name: str):
        self.path, self.name, self.packs = path, name, None

    def _files(self):
        from pyarrow import fs  # noqa: PLC0415  on executors as well

        where = self.path if "://" in self.path else f"file://{self.path}" if self.path.startswith("/") else self.path
        system, root = fs.FileSystem.from_uri(where.replace("file:///", "file:/").replace("file:/", "file:///"))
        return fs, system, root.rstrip("/")

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes equalities on the pack; what it does not take is given back."""
        for f in filters:
            wanted = {f.value} if isinstance(f, EqualTo) and f.attribute == ("pack",) else set(f.value) if isinstance(f, In) and f.attribute == ("pack",) else None
            if wanted is None:
                yield f
            else:
                self.packs = wanted if self.packs is None else self.packs & wanted

    def partitions(self) -> list[PackPartition]:
        fs, system, root = self._files()
        packs = sorted(posixpath.basename(i.path) for i in system.get_file_info(fs.FileSelector(root)) if i.type == fs.FileType.Directory)
        return [PackPartition(p) for p in packs if self.packs is None or p in self.packs] or [PackPartition("")]

    def read(self, partition: PackPartition) -> Iterator[tuple]:
        if not partition.pack:
            return
        fs, system, root = self._files()
        home = f"{root}/{partition.pack}"
        files = sorted(i.path for i in system.get_file_info(fs.FileSelector(home, recursive=True)) if i.type == fs.FileType.File)
        for path in files:
            if posixpath.basename(path) != self.name:
                continue
            folder = posixpath.dirname(path)
            beside = [f[len(folder) + 1 :] for f in files if f.startswith(folder + "/") and f != path]
            with system.open_input_stream(path) as stream:
                yield partition.pack, folder[len(home) + 1 :], path, stream.read().decode("utf-8", "replace"), beside


class SkillFolder(DataSource):
    """options: path, and name of the files (SKILL.md)."""

    @classmethod
    def name(cls) -> str:
        return "skillfolder"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SkillReader:
        return SkillReader(self.options["path"], self.options.get("name", "SKILL.md"))


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, with its filters pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SkillFolder)
