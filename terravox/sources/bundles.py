"""The store of findings as a Spark source and sink.

A store is a folder of findings, FND-<id>, each with its manifest, scans, seals and
exports. `write_items` puts rows (finding_id, scan_id, kind, item_id, content) in
place: every task attempt writes into a folder of its own under _staging, and only
the job's commit moves them to where they belong, a new scan's folder at once, else
a scan's own record last, so that a scan is seen whole or not at all. A failed attempt removes its folder, an
aborted job all of them. A commit is refused as a whole, before anything is moved,
where a scan is sealed, a finding is not there, a file comes twice or a seal is not
the next one of its chain.

`read_items` plans one task for a file of a named scan, else one for some findings:
conditions on finding_id, scan_id and kind reach the planning, so nothing else is
opened. `load_mesh` reads one scan's mesh by ranges of records.

Files are opened by the tasks themselves, on any file system that pyarrow knows (see `files`).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, WriterCommitMessage

from ..errors import StoreError
from ..sessions import own_session
from . import files

#: Where an item of a kind lies in its finding's folder.
PLACES = {
    "finding": "finding.json",
    "seal": "seals/chain.jsonl",
    "scan": "scans/{scan}/scan.json",
    "mesh": "scans/{scan}/mesh.ply",
    "cloud": "scans/{scan}/depth/cloud.bin",
    "measurements": "scans/{scan}/measurements.json",
    "specimen": "scans/{scan}/specimens/{item}.ply",
    "media": "scans/{scan}/media/{item}.json",
    "sealed": "scans/{scan}/.sealed",
}
ITEMS = "finding_id string, scan_id string, kind string, item_id string, bytes long, content binary"
STAGING = "_staging"
#: Threads of a commit.
MOVERS = 16


def folder(finding: str) -> str:
    return f"FND-{finding}"


def place(kind: str, scan: str | None, item: str | None) -> str:
    """The path of an item in its finding's folder; names that would leave it are refused."""
    if kind not in PLACES:
        raise StoreError(f"unknown kind {kind}")
    path = PLACES[kind]
    for name, value in (("{scan}", scan), ("{item}", item)):
        if name in path and (not value or "/" in value or value.startswith(".")):
            raise StoreError(f"{kind} needs a name, not {value!r}")
        path = path.replace(name, value or "")
    return path


def _scan(path: str) -> str:
    """The folder of the scan that a path lies in."""
    return "/".join(path.split("/")[:3])


def _each(pool: ThreadPoolExecutor, do, items) -> list:
    """do(item) of all items in order, by runs of them, as a future for each would take longer than most calls."""
    items = list(items)
    step = 1 + len(items) // (8 * MOVERS)
    return [x for done in pool.map(lambda i: [do(x) for x in items[i : i + step]], range(0, len(items), step)) for x in done]


@dataclass
class Staged(WriterCommitMessage):
    attempt: str
    paths: list[str] = field(default_factory=list)  # in the store, staged under the attempt's folder
    seals: dict[str, tuple[int, int]] = field(default_factory=dict)  # of each finding the first new seal's place and their number


class ItemWriter(DataSourceWriter):
    def __init__(self, root: str):
        self.root, self.job = root, uuid.uuid4().hex

    def write(self, iterator) -> Staged:
        store, root = files.opened(self.root)
        out = Staged(f"{STAGING}/{self.job}/{uuid.uuid4().hex}")
        chains: dict[str, list[tuple[int, bytes]]] = {}
        try:
            for row in iterator:
                if not row.finding_id or "/" in row.finding_id:
                    raise StoreError(f"no finding {row.finding_id!r}")
                if row.kind == "seal":
                    chains.setdefault(row.finding_id, []).append((int(row.item_id), bytes(row.content)))
                    continue
                path = f"{folder(row.finding_id)}/{place(row.kind, row.scan_id, row.item_id)}"
                files.write_whole(store, f"{root}/{out.attempt}/{path}", bytes(row.content or b""))
                out.paths.append(path)
            for finding, lines in chains.items():
                out.seals[finding] = self.chained(store, root, out, finding, sorted(lines))
        except BaseException:
            files.removed(store, f"{root}/{out.attempt}")
            raise
        return out

    def chained(self, store, root, out: Staged, finding: str, lines: list[tuple[int, bytes]]) -> tuple[int, int]:
        """Stages the finding's chain with the lines behind it."""
        path = f"{folder(finding)}/{PLACES['seal']}"
        old = files.read_all(store, f"{root}/{path}") if files.exists(store, f"{root}/{path}") else b""
        at = old.count(b"\n")
        if [i for i, _ in lines] != list(range(at, at + len(lines))):
            raise StoreError(f"seal out of place in {finding}: the next is {at}")
        files.write_whole(store, f"{root}/{out.attempt}/{path}", old, *(x + b"\n" for _, x in lines))
        out.paths.append(path)
        return at, len(lines)

    def commit(self, messages) -> None:
        store, root = files.opened(self.root)
        staged = [m for m in messages if m is not None]
        with ThreadPoolExecutor(MOVERS) as pool:
            try:
                whence = self.checked(store, root, staged, pool)
            except BaseException:
                self.abort(messages)
                raise
            moves = self.together(store, root, whence, pool)
            _each(pool, lambda p: store.create_dir(f"{root}/{p}", recursive=True), {files.parent(p) for p in moves})
            # A scan's own record shows it, and its marker ends it: both come after all else.
            late = lambda p: (p.endswith("/finding.json"), p.endswith("/scan.json"), p.endswith("/.sealed"))
            for stage in sorted({late(p) for p in moves}):
                _each(pool, lambda p: store.move(f"{root}/{moves[p]}/{p}", f"{root}/{p}"), (p for p in moves if late(p) == stage))
        self.abort(messages)

    def together(self, store, root, whence: dict[str, str], pool) -> dict[str, str]:
        """whence, but for the files of a new scan that one task has staged their folder alone: it is moved whole, at once, on file systems that can."""
        if store.type_name not in ("local", "hdfs"):
            return whence
        scans: dict[str, set[str]] = {}
        for p, attempt in whence.items():
            if "/scans/" in p:
                scans.setdefault(_scan(p), set()).add(attempt)
        there = _each(pool, lambda s: files.exists(store, f"{root}/{s}"), scans)
        new = {s: scans[s].pop() for s, old in zip(scans, there, strict=True) if not old and len(scans[s]) == 1}
        return {p: a for p, a in whence.items() if "/scans/" not in p or _scan(p) not in new} | new

    def checked(self, store, root, staged: list[Staged], pool) -> dict[str, str]:
        """Where each path is staged; refuses what must not be written."""
        whence: dict[str, str] = {}
        for m in staged:
            for p in m.paths:
                if p in whence:
                    raise StoreError(f"written twice: {p}")
                whence[p] = m.attempt

        def place_of_seals(seal):
            finding, (at, _) = seal
            path = f"{root}/{folder(finding)}/{PLACES['seal']}"
            if (files.read_all(store, path).count(b"\n") if files.exists(store, path) else 0) != at:
                raise StoreError(f"seal out of place in {finding}")

        def unsealed(scan):
            if files.exists(store, f"{root}/{scan}/.sealed"):
                raise StoreError(f"sealed: {scan}")

        def has_finding(finding):
            if f"{finding}/finding.json" not in whence and not files.exists(store, f"{root}/{finding}/finding.json"):
                raise StoreError(f"finding not found: {finding}")

        _each(pool, place_of_seals, [x for m in staged for x in m.seals.items()])
        _each(pool, unsealed, {_scan(p) for p in whence if "/scans/" in p})
        _each(pool, has_finding, {p.split("/")[0] for p in whence})
        return whence

    def abort(self, messages) -> None:
        store, root = files.opened(self.root)
        files.removed(store, f"{root}/{STAGING}/{self.job}")


@dataclass
class Findings(InputPartition):
    names: tuple[str, ...]


class ItemReader(DataSourceReader):
    """Rows of ITEMS; conditions on finding_id, scan_id and kind are answered by the planning and the listing."""

    def __init__(self, options):
        self.root, self.at_once, self.wanted = options["path"], int(options.get("findingsATask", 64)), {}

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute in (("finding_id",), ("scan_id",), ("kind",)):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                name = f.attribute[0]
                self.wanted[name] = self.wanted.get(name, values) & values
            else:
                yield f

    def partitions(self):
        store, root = files.opened(self.root)
        if "finding_id" in self.wanted:
            names = sorted(n for n in self.wanted["finding_id"] if n and files.exists(store, f"{root}/{folder(n)}"))
        else:
            names = sorted(x.base_name.removeprefix("FND-") for x in store.get_file_info(files.fs.FileSelector(root)) if x.base_name.startswith("FND-")) if files.exists(store, root) else []
        step = 1 if "finding_id" in self.wanted else self.at_once
        return [Findings(tuple(names[i : i + step])) for i in range(0, len(names), step)] or [Findings(())]

    def read(self, partition) -> Iterator[tuple]:
        store, root = files.opened(self.root)
        for name in partition.names:
            base = f"{root}/{folder(name)}"
            scans = self.wanted.get("scan_id")
            if scans is None:
                found = store.get_file_info(files.fs.FileSelector(base, recursive=True))
            else:
                found = [x for s in sorted(s for s in scans if s) for x in store.get_file_info(files.fs.FileSelector(f"{base}/scans/{s}", allow_not_found=True, recursive=True))]
            for x in found:
                parts = x.path[len(base) + 1 :].split("/")
                known = kind_of(parts) if x.is_file else None
                if known is None or ("kind" in self.wanted and known[0] not in self.wanted["kind"]):
                    continue
                yield (name, parts[1] if parts[0] == "scans" else None, *known, x.size, files.read_all(store, x.path))


def kind_of(parts: list[str]) -> tuple[str, str | None] | None:
    """Kind and item of a path in a finding's folder; none for what is no item."""
    for kind, path in PLACES.items():
        form = path.split("/")
        if len(form) != len(parts):
            continue
        item, fits = None, True
        for want, got in zip(form, parts, strict=True):
            if want == "{scan}":
                continue
            if "{item}" in want:
                end = want.removeprefix("{item}")
                fits &= got.endswith(end)
                item = got.removesuffix(end)
            else:
                fits &= got == want
        if fits:
            return kind, item
    return None


class Bundles(DataSource):
    """format("terravox_bundles"), option path: the store's folder."""

    @classmethod
    def name(cls):
        return "terravox_bundles"

    def schema(self):
        return ITEMS

    def reader(self, schema):
        return ItemReader(self.options)

    def writer(self, schema, overwrite):
        return ItemWriter(self.options["path"])


class PlannedBundles(Bundles):
    """The same source under a name that only sessions with filter pushdown know."""

    @classmethod
    def name(cls):
        return "terravox_bundles_planned"


def registered(spark: SparkSession, source: type[DataSource]) -> SparkSession:
    """spark, in which the source is known and which is the active session until another is: Spark looks a source's name up in the active one, so nothing may stand between this and load() or save()."""
    getattr(spark._jvm, spark._jsparkSession.getClass().getName()).setActiveSession(spark._jsparkSession)
    try:
        spark.dataSource.register(source)
    except AnalysisException as e:
        if "DATA_SOURCE_ALREADY_EXISTS" not in str(e):
            raise
    return spark


def write_items(items: DataFrame, root: str) -> None:
    """Puts items(finding_id, scan_id, kind, item_id, content) in place, all or none.

    Dealt by scan, so that a new scan's folder is moved whole; a finding's own items and seals, whose item_id is their
    place, are one task's too. The tasks are as many as a shuffle's partitions, however few bytes the items have:
    what takes time is their number.
    """
    rows = items.select("finding_id", "scan_id", "kind", F.col("item_id").cast("string").alias("item_id"), F.octet_length("content").cast("long").alias("bytes"), "content")
    parts = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    writer = rows.repartition(parts, "finding_id", "scan_id").write.format("terravox_bundles").option("path", root).mode("append")
    registered(items.sparkSession, Bundles)
    writer.save()


def read_items(spark: SparkSession, root: str) -> DataFrame:
    """The items of a store, in a session in which filters reach Python sources."""
    own = registered(own_session(spark, {"spark.sql.python.filterPushdown.enabled": "true"}), PlannedBundles)
    return own.read.format("terravox_bundles_planned").option("path", root).load()


# ------------------------------------------------------------ one mesh by ranges

#: Records that one task reads of a mesh.
RECORDS = 1 << 20
_VERTEX, _FACE = np.dtype(("<f4", 3)), np.dtype([("n", "u1"), ("v", "<i4", 3)])
MESH_PARTS = {"vertices": "vid long, x double, y double, z double", "faces": "fid long, a long, b long, c long"}


def mesh_layout(store, path: str) -> tuple[int, int, int]:
    """Length of the header, number of vertices and of faces of a mesh file whose size fits them."""
    with store.open_input_file(path) as f:
        head = f.read(4096)
    end = head.find(b"end_header\n")
    lines = head[: max(0, end)].decode("ascii", "replace").split("\n")
    count = {w[1]: int(w[2]) for w in (x.split() for x in lines) if len(w) == 3 and w[0] == "element" and w[2].isdigit()}
    if end < 0 or lines[:2] != ["ply", "format binary_little_endian 1.0"] or count.keys() != {"vertex", "face"}:
        raise StoreError(f"bundle corrupt: {path}")
    begin, nv, nf = end + 11, count["vertex"], count["face"]
    if store.get_file_info(path).size != begin + 12 * nv + 13 * nf:
        raise StoreError(f"bundle corrupt: {path}")
    return begin, nv, nf


@dataclass
class Range(InputPartition):
    offset: int
    first: int
    n: int


class MeshReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.part, self.records = options["path"], options.get("part", "vertices"), int(options.get("records", RECORDS))

    def partitions(self):
        begin, nv, nf = mesh_layout(*files.opened(self.path))
        at, n, size = (begin, nv, 12) if self.part == "vertices" else (begin + 12 * nv, nf, 13)
        return [Range(at + size * i, i, min(self.records, n - i)) for i in range(0, n, self.records)] or [Range(0, 0, 0)]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        store, path = files.opened(self.path)
        kind = _VERTEX if self.part == "vertices" else _FACE
        with store.open_input_file(path) as f:
            f.seek(partition.offset)
            for i in range(0, partition.n, 1 << 16):
                n = min(1 << 16, partition.n - i)
                rows = np.frombuffer(f.read(kind.itemsize * n), kind)
                ids = pa.array(np.arange(partition.first + i, partition.first + i + n))
                if kind is _FACE:
                    if (rows["n"] != 3).any():
                        raise StoreError(f"bundle corrupt: {self.path}")
                    rows, names = rows["v"].astype(np.int64), ("fid", "a", "b", "c")
                else:
                    rows, names = rows.astype(float), ("vid", "x", "y", "z")
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(np.ascontiguousarray(rows[:, k])) for k in range(3))], names=names)


class MeshFile(DataSource):
    """format("terravox_mesh"), options path, part (vertices or faces) and records: a mesh file by ranges of its records."""

    @classmethod
    def name(cls):
        return "terravox_mesh"

    def schema(self):
        return MESH_PARTS[self.options.get("part", "vertices")]

    def reader(self, schema):
        return MeshReader(self.options)


def read_mesh(spark: SparkSession, path: str, records: int = RECORDS) -> tuple[DataFrame, DataFrame]:
    """Vertices (vid, x, y, z) and faces (fid, a, b, c) of one mesh file, a task for each range of records."""
    return tuple(registered(spark, MeshFile).read.format("terravox_mesh").option("path", path).option("part", part).option("records", records).load() for part in MESH_PARTS)


def load_mesh(spark: SparkSession, root: str, finding: str, scan: str, records: int = RECORDS) -> tuple[DataFrame, DataFrame]:
    """The mesh of one scan; StoreError `scan not found` or `bundle corrupt`, by its header alone."""
    store, base = files.opened(root)
    inside = f"{folder(finding)}/{place('mesh', scan, None)}"
    if not files.exists(store, f"{base}/{inside}"):
        raise StoreError(f"scan not found: {scan}")
    mesh_layout(store, f"{base}/{inside}")
    return read_mesh(spark, f"{root.rstrip('/')}/{inside}", records)


# ------------------------------------------------- one large file from many tasks


@dataclass
class Parts(WriterCommitMessage):
    attempt: str
    parts: list[tuple[int, int, str]] = field(default_factory=list)  # place of the first record, bytes, path


class RecordWriter(DataSourceWriter):
    """Rows (place, content): content is put at its place's order; a commit joins the parts into one file, a chunk in memory at a time."""

    def __init__(self, path: str, size: int | None):
        self.path, self.size, self.job = path, size, uuid.uuid4().hex

    @property
    def staging(self) -> str:
        return f"{files.opened(self.path)[1]}.{STAGING}-{self.job}"

    def write(self, iterator) -> Parts:
        store, _ = files.opened(self.path)
        out = Parts(f"{self.staging}/{uuid.uuid4().hex}")
        sink = None
        try:
            for row in iterator:
                if sink is None or row.place < last:
                    if sink is not None:
                        sink.close()
                    path = f"{out.attempt}/{len(out.parts)}"
                    store.create_dir(out.attempt, recursive=True)
                    sink = store.open_output_stream(path)
                    out.parts.append((row.place, 0, path))
                last = row.place
                first, size, path = out.parts[-1]
                out.parts[-1] = first, size + sink.write(bytes(row.content)), path
            if sink is not None:
                sink.close()
        except BaseException:
            files.removed(store, out.attempt)
            raise
        return out

    def commit(self, messages) -> None:
        store, path = files.opened(self.path)
        parts = sorted(p for m in messages if m is not None for p in m.parts)
        total = sum(n for _, n, _ in parts)
        try:
            if self.size is not None and total != self.size:
                raise StoreError(f"{total} bytes of {self.size} for {self.path}")
            whole = f"{self.staging}/whole"
            store.create_dir(self.staging, recursive=True)
            with store.open_output_stream(whole) as out:
                for _, _, part in parts:
                    with store.open_input_stream(part) as f:
                        while chunk := f.read(8 * files.CHUNK):
                            out.write(chunk)
            store.create_dir(files.parent(path), recursive=True)
            store.move(whole, path)
        finally:
            self.abort(messages)

    def abort(self, messages) -> None:
        files.removed(files.opened(self.path)[0], self.staging)


class Records(DataSource):
    """format("terravox_records"), options path and size (the file's bytes, checked)."""

    @classmethod
    def name(cls):
        return "terravox_records"

    def schema(self):
        return "place long, content binary"

    def writer(self, schema, overwrite):
        size = self.options.get("size")
        return RecordWriter(self.options["path"], None if size is None else int(size))


def write_parts(parts: DataFrame, path: str, size: int | None = None) -> None:
    """One file of rows (place, content): each partition's rows ascend and no two partitions' places overlap."""
    writer = parts.write.format("terravox_records").option("path", path).mode("append")
    writer = writer if size is None else writer.option("size", str(size))
    registered(parts.sparkSession, Records)
    writer.save()


def packed(rows: DataFrame, pack) -> DataFrame:
    """Parts of rows (place, ...): dealt by ranges of place, each Arrow batch of them as the bytes that pack(batch) gives."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(0, 1), pa.array([pack(batch)], pa.binary())], names=["place", "content"])

    dealt = rows.withColumn("place", F.col("place").cast("long")).select("place", *(c for c in rows.columns if c != "place"))
    return dealt.repartitionByRange("place").sortWithinPartitions("place").mapInArrow(run, "place long, content binary")


def head(spark: SparkSession, content: bytes) -> DataFrame:
    """The part before all others."""
    return spark.createDataFrame([(-1, bytearray(content))], "place long, content binary").coalesce(1)
