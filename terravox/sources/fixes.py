"""GPS fixes as a streaming source with offsets that can be replayed.

A log folder holds files of JSON lines that only grow. An offset is, for each file,
the bytes up to its last whole line; a micro-batch is a set of byte ranges, so a
query that restarts from its checkpoint reads the ranges it had planned again, and
each fix once. A place that was entered by hand is a stream of one fix.
"""

from __future__ import annotations

import datetime
import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType, TimestampType

from ..errors import GeoError
from . import files
from .bundles import registered

FIX = "burst_id string, ord long, latitude double, longitude double, altitude double, horizontal_accuracy double, vertical_accuracy double, ts timestamp, source string"


@dataclass
class Lines(InputPartition):
    path: str
    begin: int
    end: int


def _value(kind, x):
    if x is None:
        return None
    if isinstance(kind, TimestampType):
        return datetime.datetime.fromisoformat(x.replace("Z", "+00:00"))
    return {"string": str, "double": float, "long": int, "bigint": int}[kind.simpleString()](x)


def parsed(line: bytes, schema: StructType) -> tuple:
    """A line's fields, nulls where they are absent; a line that is no record is a row of nulls."""
    try:
        row = json.loads(line)
        return tuple(_value(f.dataType, row.get(f.name)) for f in schema)
    except (ValueError, AttributeError, TypeError):
        return (None,) * len(schema.fields)


class LogReader(DataSourceStreamReader):
    def __init__(self, options, schema):
        self.root, self.schema, self.suffix = options["path"], schema, options.get("suffix", ".jsonl")

    def initialOffset(self):  # noqa: N802
        return {}

    def latestOffset(self):  # noqa: N802
        store, root = files.opened(self.root)
        found = store.get_file_info(files.fs.FileSelector(root, recursive=True, allow_not_found=True))
        return {x.path[len(root) + 1 :]: self.whole(store, x) for x in sorted(found, key=lambda x: x.path) if x.is_file and x.path.endswith(self.suffix)}

    def whole(self, store, info) -> int:
        """Bytes up to the last line that has ended, sought from behind."""
        with store.open_input_file(info.path) as f:
            at = info.size
            while at > 0:
                begin = max(0, at - files.CHUNK)
                f.seek(begin)
                cut = f.read(at - begin).rfind(b"\n")
                if cut >= 0:
                    return begin + cut + 1
                at = begin
        return 0

    def partitions(self, start, end):
        return [Lines(name, start.get(name, 0), to) for name, to in sorted(end.items()) if to > start.get(name, 0)]

    def read(self, partition) -> Iterator[tuple]:
        store, root = files.opened(self.root)
        with store.open_input_file(f"{root}/{partition.path}") as f:
            if f.size() < partition.end:
                raise GeoError(f"log is shorter than it was: {partition.path}")
            f.seek(partition.begin)
            left, rest = partition.end - partition.begin, b""
            while left > 0:
                part = f.read(min(left, files.CHUNK))
                left -= len(part)
                *lines, rest = (rest + part).split(b"\n")
                yield from (parsed(line, self.schema) for line in lines if line.strip())


class ManualReader(DataSourceStreamReader):
    """One fix, then nothing."""

    def __init__(self, fix: str, schema):
        self.fix, self.schema = fix, schema

    def initialOffset(self):  # noqa: N802
        return {"given": 0}

    def latestOffset(self):  # noqa: N802
        return {"given": 1}

    def partitions(self, start, end):
        return [Lines("", start["given"], end["given"])] if end["given"] > start["given"] else []

    def read(self, partition) -> Iterator[tuple]:
        yield parsed(self.fix.encode(), self.schema)


class Fixes(DataSource):
    """format("terravox_fixes"): option path, a folder of logs (named by their suffix), or option fix, one fix as JSON."""

    @classmethod
    def name(cls):
        return "terravox_fixes"

    def schema(self):
        return FIX

    def streamReader(self, schema):  # noqa: N802
        if ("path" in self.options) == ("fix" in self.options):
            raise GeoError("a fix stream needs a path or a fix")
        return ManualReader(self.options["fix"], schema) if "fix" in self.options else LogReader(self.options, schema)



def from_logs(spark: SparkSession, folder: str, suffix: str = ".jsonl") -> DataFrame:
    """Fixes of the logs under folder as they grow."""
    return registered(spark, Fixes).readStream.format("terravox_fixes").option("path", folder).option("suffix", suffix).load()


def by_hand(spark: SparkSession, fix: dict) -> DataFrame:
    """The stream of one fix that was entered by hand."""
    return registered(spark, Fixes).readStream.format("terravox_fixes").option("fix", json.dumps(fix)).load()
