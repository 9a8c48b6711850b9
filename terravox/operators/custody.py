"""Manifests, hash chains and their verification, as joins and windows."""

from __future__ import annotations

import hashlib
import hmac
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..errors import CustodyError
from ..functions import canonical as C
from ..sources.hashes import hashed


def is_content(path):
    """Whether a bundle's file is under the manifest: not the seals, the marker or the note."""
    return ~path.startswith("seals/") & ~path.isin(".sealed", "VERIFY.txt")


def files(spark: SparkSession, root: str) -> DataFrame:
    """relative_path, bytes, sha256 of every regular file under root; a task feeds a file to the hash a mebibyte at a time, so it may be of any size."""
    return hashed(spark, root)


def manifest(found: DataFrame) -> DataFrame:
    return found.filter(is_content(F.col("relative_path")))


def root_hash(entries: DataFrame, by: str) -> DataFrame:
    """SHA-256 of the canonical JSON of each bundle's manifest, its entries ordered by path.

    A hash runs over its text from end to end, so a bundle is one task, but
    entries are fed to it batch by batch: no bundle is ever one row.
    """
    entry = F.struct("relative_path", "bytes", "sha256")
    quoted = F.to_json(F.struct(F.col("e.relative_path").alias("p")))
    text = F.concat(F.lit('{"bytes":'), F.col("e.bytes").cast("string"), F.lit(',"relativePath":'), F.expr("substring(q, 6, length(q) - 6)"), F.lit(',"sha256":"'), F.col("e.sha256"), F.lit('"}'))
    rows = entries.select(by, entry.alias("e")).withColumn("q", quoted).select(F.col(by).alias("bundle"), F.col("e.relative_path").alias("p"), text.alias("t"))
    kind = entries.schema[by].dataType
    out = T.StructType([T.StructField(by, kind), T.StructField("root_hash", T.StringType()), T.StructField("entries", T.LongType())])
    return rows.repartition("bundle").sortWithinPartitions("bundle", "p", "t").mapInArrow(_digests(pa.schema([pa.field(f.name, to_arrow_type(f.dataType)) for f in out])), out)


def _digests(schema: pa.Schema):
    """Digests and counts of rows (bundle, path, entry) that come bundle by bundle, in order."""

    def row(bundle, sha, fed, n):
        sha.update(b"]" if fed else b"[]")
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((bundle, sha.hexdigest(), n), schema, strict=True)], schema=schema)

    def run(batches):
        here, sha, fed, n = None, None, False, 0
        for batch in batches:
            for bundle, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if sha is None or bundle != here:
                    if sha is not None:
                        yield row(here, sha, fed, n)
                    here, sha, fed, n = bundle, hashlib.sha256(), False, 0
                n += 1
                if text is not None:
                    sha.update((b"," if fed else b"[") + text.encode())
                    fed = True
        if sha is not None:
            yield row(here, sha, fed, n)

    return run


def chain_links(seals: DataFrame, by: str, order: str, own: str = "seal_hash", previous: str = "prev_hash") -> DataFrame:
    """seals with `link`: ok, broken, or unexpected where the first has a predecessor."""
    before = F.lag(own).over(Window.partitionBy(by).orderBy(order))
    first = F.row_number().over(Window.partitionBy(by).orderBy(order)) == 1
    bad = F.when(first & F.col(previous).isNotNull(), "unexpected").when(~first & ~F.col(previous).eqNullSafe(before), "broken")
    return seals.withColumn("link", F.coalesce(bad, F.lit("ok")))


def file_faults(declared: DataFrame, found: DataFrame, by: str = "bundle_id") -> DataFrame:
    """Per bundle the missing, changed and undeclared files."""
    d = declared.select(by, "relative_path", F.col("sha256").alias("was"))
    f = found.select(by, "relative_path", F.col("sha256").alias("is"))
    both = d.join(f, [by, "relative_path"], "left")
    off = both.select(by, "relative_path", F.when(F.col("is").isNull(), "missing").when(F.col("is") != F.col("was"), "changed").alias("fault")).filter("fault is not null")
    extra = f.join(d, [by, "relative_path"], "left_anti").select(by, "relative_path", F.lit("undeclared").alias("fault"))
    return off.unionByName(extra)


def chain_faults(seals: DataFrame, declared: DataFrame, found: DataFrame, by: str, order: str) -> DataFrame:
    """by, fault, at: of all bundles the seals off their place or their predecessor (link, index) and the files missing, changed and undeclared.

    seals(by, order, seal_hash, prev_hash), declared and found(by, relative_path, sha256): one query for any number of bundles.
    """
    place = F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1
    linked = chain_links(seals, by, order).withColumn("place", place)
    off = F.array_compact(F.array(F.when(F.col("link") != "ok", "link"), F.when(F.col("place") != F.col(order), "index")))
    return linked.select(by, F.explode(off).alias("fault"), F.col(order).cast("string").alias("at")).unionByName(file_faults(declared, found, by).select(by, "fault", F.col("relative_path").alias("at")))


def monotonic_deltas(events: DataFrame, by: str, ts: str, order: str) -> DataFrame:
    """Seconds since the one before, null for the first."""
    t = F.unix_micros(F.col(ts).cast("timestamp"))
    return events.withColumn("delta", (t - F.lag(t).over(Window.partitionBy(by).orderBy(ts, order))) / 1e6)


class Signer(Protocol):
    key_id: str

    def sign(self, payload: bytes) -> bytes: ...

    def verify(self, payload: bytes, signature: bytes) -> bool: ...


class HmacSigner:
    """Shared-key signer; another signature scheme plugs in by the same two methods."""

    def __init__(self, key: bytes):
        self.key, self.key_id = key, hashlib.sha256(key).hexdigest()[:32]

    def sign(self, payload: bytes) -> bytes:
        return hmac.new(self.key, payload, hashlib.sha256).digest()

    def verify(self, payload: bytes, signature: bytes) -> bool:
        return hmac.compare_digest(self.sign(payload), signature)


def payload(root: str, ms: int, author: str) -> bytes:
    return f"{root}|{ms}|{author}".encode()


def payload_text(root, ms, author):
    """The signed text of seals, as a column."""
    return F.concat_ws("|", root, ms.cast("string"), author)


def signatures(seals: DataFrame, signer: Signer) -> DataFrame:
    """seals(text, ...) with `signature`, as hex text."""
    return _signed(seals.withColumn("signature", F.lit("")), lambda text, _: signer.sign(text.encode()).hex(), "signature", T.StringType())


def signature_checks(seals: DataFrame, signer: Signer) -> DataFrame:
    """seals(text, signature, ...) with `genuine`; a signature that is no hex text is not."""

    def check(text, signature):
        try:
            return text is not None and signer.verify(text.encode(), bytes.fromhex(signature))
        except (ValueError, TypeError):
            return False

    return _signed(seals.withColumn("genuine", F.lit(False)), check, "genuine", T.BooleanType())


def _signed(rows: DataFrame, fn, name: str, kind: T.DataType) -> DataFrame:
    """rows with column `name` filled by fn(text, signature), a batch at a time where the rows lie."""
    at, text, signature = (rows.columns.index(c) if c in rows.columns else None for c in (name, "text", "signature"))
    kind_ = to_arrow_type(kind)

    def run(batches):
        for batch in batches:
            texts, given = batch.column(text).to_pylist(), batch.column(signature).to_pylist()
            columns = [pa.array([fn(t, g) for t, g in zip(texts, given, strict=True)], kind_) if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return rows.mapInArrow(run, rows.schema)


def verified_chains(seals: DataFrame, declared: DataFrame, found: DataFrame, signer: Signer, by: str, order: str) -> DataFrame:
    """by, fault, at of all bundles: links, places and files as `chain_faults`, seals with a false signature, and the root where the last seal's is not that of the declared files.

    seals(by, order, seal_hash, prev_hash, root_hash, ms, author, signature), declared(by, relative_path, bytes, sha256), found(by, relative_path, sha256).
    """
    text = payload_text(F.col("root_hash"), F.col("ms"), F.col("author"))
    false = signature_checks(seals.select(by, F.col(order).alias("at"), text.alias("text"), "signature"), signer).filter("not genuine")
    last = seals.groupBy(by).agg(F.max_by("root_hash", order).alias("sealed"), F.max(order).alias("at"))
    roots = last.join(root_hash(declared, by), by, "left").filter(~F.col("sealed").eqNullSafe(F.col("root_hash")))
    out = chain_faults(seals, declared, found, by, order)
    for rows, fault in ((false, "signature"), (roots, "root hash")):
        out = out.unionByName(rows.select(by, F.lit(fault).alias("fault"), F.col("at").cast("string").alias("at")))
    return out


def seal(entries: list[dict], author: str, ms: int, previous: dict | None, signer: Signer) -> dict:
    """The seal of one bundle's manifest entries, linked to the previous seal."""
    ordered = sorted(entries, key=lambda e: e["relativePath"])
    root = C.digest(ordered)
    out = {"index": previous["index"] + 1 if previous else 0, "rootHash": root, "manifest": ordered, "author": author, "wallClockMs": ms, "deviceKeyID": signer.key_id, "signature": signer.sign(payload(root, ms, author)).hex()}
    if previous:
        out |= {"prevSealHash": C.digest(previous), "monotonicDelta": (ms - previous["wallClockMs"]) / 1000}
    return out


def verify(seals: list[dict], found: dict[str, str], signer: Signer, expected: int | None = None) -> list[str]:
    """Faults of one bundle's chain (its seals are few) against its files' hashes by path."""
    if not seals:
        raise CustodyError("no chain")
    faults = []
    for i, s in enumerate(seals):
        if s["index"] != i:
            faults.append(f"index {i}")
        if s.get("prevSealHash") != (C.digest(seals[i - 1]) if i else None):
            faults.append(f"link {i}")
        if not signer.verify(payload(s["rootHash"], s["wallClockMs"], s["author"]), bytes.fromhex(s["signature"])):
            faults.append(f"signature {i}")
    last = {e["relativePath"]: e["sha256"] for e in seals[-1]["manifest"]}
    faults += [f"missing {p}" for p in sorted(last.keys() - found.keys())] + [f"changed {p}" for p in sorted(last.keys() & found.keys()) if last[p] != found[p]] + [f"undeclared {p}" for p in sorted(found.keys() - last.keys())]
    if not faults and C.digest(seals[-1]["manifest"]) != seals[-1]["rootHash"]:
        faults.append("root hash")
    if expected is not None and len(seals) != expected:
        faults.append(f"expected {expected} seals")
    return faults
