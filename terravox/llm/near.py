"""Exact verification of similar sets inside buckets, and connected components.

Buckets say which sets may be similar; here every pair within a bucket is
decided by its exact Jaccard similarity. A bucket of any size is taken whole: it
is dealt into blocks, and each pair of blocks is a group of its own, bounded by
two blocks. Pairs are never rows. Signatures go to the groups first (`plausible`),
and only sets that have a partner by them follow (`verified`). A group yields one
row for each of its sets that has a partner: the least set it is connected with there, and how many
partners it has that no earlier bucket has counted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.mesh import in_rounds
from .common import bounded_batches, hashed_words, in_chunks, shingle_hashes, tidied, utf8_list

#: Sets in a block.
BLOCK = 256


def minhashes(runs: np.ndarray, at: np.ndarray, coordinates: int) -> np.ndarray:
    """(sets, coordinates): the least of each set's runs under each of the fixed hash functions; sets must not be empty."""
    odd = (np.arange(1, coordinates + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(0x632BE59BD9B4E019)) | np.uint64(1)
    out = np.empty((len(at) - 1, coordinates), np.int32)
    for i, a in enumerate(odd):
        h = (runs ^ (runs >> np.uint64(31))) * a
        h ^= h >> np.uint64(33)
        h *= np.uint64(0xFF51AFD7ED558CCD)
        h >>= np.uint64(32)
        out[:, i] = np.minimum.reduceat(h, at[:-1]).astype(np.uint32).view(np.int32)
    return out


def shingle_sets(rows: DataFrame, width: int = 5) -> DataFrame:
    """sid, shingles (sorted distinct 64-bit hashes) of rows (sid, text); one row a sid."""

    def run(batches):
        for batch in batches:
            texts = utf8_list(batch.column(1))
            for lo, hi in in_chunks(texts):
                h, _, _, first = hashed_words(texts[lo:hi])
                runs, at = shingle_hashes(h, first, width)
                sets = [np.unique(runs[a:b]).tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(sets, pa.binary())], names=["sid", "shingles"])

    return bounded_batches(rows).select("sid", "text").mapInArrow(tidied(run), "sid binary, shingles binary").groupBy("sid").agg(F.first("shingles").alias("shingles"))


def intersections(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of all pairs' intersections."""
    m = len(sets)
    if m <= 6:
        out = np.zeros((m, m), np.int64)
        for i in range(m):
            for j in range(i):
                both = np.concatenate((sets[i], sets[j]))
                both.sort()
                out[i, j] = out[j, i] = np.count_nonzero(both[1:] == both[:-1])
        return out
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    new = np.concatenate(([True], values[1:] != values[:-1]))
    column = np.cumsum(new) - 1
    often = np.bincount(column) >= 2
    keep = often[column]
    column = (np.cumsum(often) - 1)[column[keep]]
    owner = owner[keep]
    out = np.zeros((m, m), np.float32)
    total = int(often.sum())
    for lo in range(0, total, columns):
        a, b = np.searchsorted(column, (lo, lo + columns))
        part = np.zeros((m, min(columns, total - lo)), np.float32)
        part[owner[a:b], column[a:b] - lo] = 1
        out += part @ part.T
    return np.rint(out).astype(np.int64)


def similar(sets: list[np.ndarray], least: float) -> np.ndarray:
    """Which pairs have a Jaccard similarity of `least` or more."""
    n = np.array([len(s) for s in sets], np.int64)
    both = intersections(sets)
    out = both >= least * (n[:, None] + n[None, :] - both) - 1e-9
    np.fill_diagonal(out, False)
    return out & (both > 0)


def roots(links: np.ndarray) -> np.ndarray:
    """For each set the first set it is connected with."""
    m = len(links)
    root = np.full(m, -1)
    for i in range(m):
        if root[i] < 0:
            root[i], todo = i, [i]
            while todo:
                near = np.flatnonzero(links[todo.pop()] & (root < 0))
                root[near] = i
                todo += near.tolist()
    return root


def dealt(leaves: DataFrame) -> DataFrame:
    """Leaves (bucket, sid, ...) with their block among as many as the bucket needs."""
    nb = leaves.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("nb"))
    return leaves.join(nb, "bucket").withColumn("own", F.pmod(F.xxhash64("sid"), F.col("nb")).cast("int"))


def by_block_pair(blocks: DataFrame, *columns: str) -> DataFrame:
    """Each row in every pair of blocks that its own is in; a pair of blocks lies in one task, in a row."""
    spread = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    spread = spread.select("bucket", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), *columns)
    return spread.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi", "sid")


def plausible(leaves: DataFrame, signatures: DataFrame, agree: int) -> DataFrame:
    """The leaves (bucket, sid) that have a partner in their bucket with `agree` equal coordinates or more; signatures (sid, sig)."""
    spread = by_block_pair(dealt(leaves.select("bucket", "sid")).join(signatures, "sid"), "sid", "sig")

    def run(batches):
        here, parts = None, []

        def hits():
            sids, sigs = [x for p in parts for x in p[0]], np.concatenate([p[1] for p in parts])
            if len(sids) < 2:
                return []
            equal = np.zeros((len(sids), len(sids)), np.int16)
            for c in sigs.T:
                equal += c[:, None] == c[None, :]
            np.fill_diagonal(equal, 0)
            return [(here[0], sids[i]) for i in np.flatnonzero((equal >= agree).any(1)).tolist()]

        for batch in batches:
            keys = np.column_stack([batch.column(i).to_numpy() for i in range(3)])
            sids, sigs = batch.column(3).to_pylist(), batch.column(4).flatten().to_numpy().reshape(len(keys), -1)
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            out = []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a < b:
                    if tuple(keys[a].tolist()) != here:
                        out += hits() if parts else []
                        here, parts = tuple(keys[a].tolist()), []
                    parts.append((sids[a:b], sigs[a:b]))
            yield _members(out)
        if parts:
            yield _members(hits())

    return bounded_batches(spread).mapInArrow(tidied(run), "bucket long, sid binary").distinct()


def _members(rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["bucket", "sid"])


def verified(leaves: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """sid, root, links over leaves (bucket, sid) of sets (sid, shingles).

    links sums to the number of distinct partners of a sid: a pair that several
    buckets hold counts in the first of them.
    """
    # Every bucket a set is in, for the question which bucket of a pair's is the first.
    every = leaves.groupBy("sid").agg(F.sort_array(F.collect_set("bucket")).alias("buckets"))
    spread = by_block_pair(dealt(leaves.select("bucket", "sid")).join(sets.join(every, "sid"), "sid"), "own", "sid", "shingles", "buckets")

    def decide(bucket, lo, hi, members):
        sids, own, sets_, buckets = zip(*members, strict=True)
        links = similar([np.frombuffer(s, np.uint64) for s in sets_], least)
        if not links.any():
            return []
        names = sorted({b for bs in buckets for b in bs if b < bucket})
        at = {b: i for i, b in enumerate(names)}
        before = np.zeros((len(sids), len(names)), np.float32)
        for i, bs in enumerate(buckets):
            before[i, [at[b] for b in bs if b < bucket]] = 1
        fresh = links & ((before @ before.T) == 0) if names else links
        own = np.array(own)
        if lo != hi:  # pairs within one block are counted where that block meets itself
            fresh = fresh & (own[:, None] != own[None, :])
        root, count = roots(links), fresh.sum(1)
        return [(sids[i], sids[root[i]], int(count[i])) for i in np.flatnonzero(links.any(1))]

    def run(batches):
        here, members, out = None, [], []
        for batch in batches:
            for bucket, lo, hi, own, sid, shingles, buckets in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (bucket, lo, hi) != here:
                    if len(members) > 1:
                        out += decide(*here, members)
                    here, members = (bucket, lo, hi), []
                    if len(out) > 4096:
                        yield _edges(out)
                        out = []
                members.append((sid, own, shingles, buckets))
        if len(members) > 1:
            out += decide(*here, members)
        if out:
            yield _edges(out)

    return bounded_batches(spread).mapInArrow(tidied(run), "sid binary, root binary, links long")


def _edges(rows) -> pa.RecordBatch:
    a, b, n = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(n, pa.int64())], names=["sid", "root", "links"])


def sized(paths: DataFrame) -> DataFrame:
    """Paths (bucket, sid, ...) of two sets or more, with their size."""
    sizes = paths.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    return paths.join(sizes, "bucket")


def distinct_leaves(leaves: DataFrame) -> DataFrame:
    """Of buckets that hold the same sets, one."""
    print_ = leaves.groupBy("bucket").agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(sid))").alias("x"), F.expr("bit_xor(xxhash64(sid, 1))").alias("y"))
    one = print_.groupBy("n", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket")
    return leaves.join(one, "bucket", "left_semi")


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, component (its least node) of the graph with these edges, as a written table."""
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
    return in_rounds(both.select(F.explode(F.array("u", "v")).alias("node")).distinct(), both)
