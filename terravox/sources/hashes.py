"""The regular files under a folder with their hashes, as a source: files of any size, also empty ones."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import files
from .bundles import registered


@dataclass
class Paths(InputPartition):
    paths: tuple[str, ...]


class HashReader(DataSourceReader):
    def __init__(self, options):
        self.root, self.bytes = options["path"], int(options.get("bytesATask", 128 << 20))

    def partitions(self):
        """Neighbours in order of path share a task until they are bytesATask together; a larger file has one of its own."""
        store, root = files.opened(self.root)
        found = store.get_file_info(files.fs.FileSelector(root, recursive=True, allow_not_found=True))
        out, size = [[]], 0
        for x in sorted((x for x in found if x.is_file), key=lambda x: x.path):
            if out[-1] and size + x.size > self.bytes:
                out.append([])
                size = 0
            out[-1].append(x.path)
            size += x.size + 4096
        return [Paths(tuple(p)) for p in out]

    def read(self, partition) -> Iterator[tuple]:
        store, root = files.opened(self.root)
        for path in partition.paths:
            yield (path[len(root) + 1 :], *files.sha256_of(store, path))


class FileHashes(DataSource):
    """format("terravox_hashes"), options path and bytesATask."""

    @classmethod
    def name(cls):
        return "terravox_hashes"

    def schema(self):
        return "relative_path string, bytes long, sha256 string"

    def reader(self, schema):
        return HashReader(self.options)


def hashed(spark: SparkSession, root: str) -> DataFrame:
    return registered(spark, FileHashes).read.format("terravox_hashes").option("path", root).load()
