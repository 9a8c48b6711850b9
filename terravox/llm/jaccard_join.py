"""N-gram Jaccard join by chosen paths.

A text is the set of its five-word runs; texts of similarity 0.8 or more are
linked. Each set is embedded as the tokens (coordinate, MinHash value). A run of
the join samples tokens: sets that share one go down the same path. A path of
few sets is a leaf, whose pairs are decided exactly. A larger one is split again
on tokens sampled for that path. Where a sample hardly splits a path (most of
its sets are like one another), and where the depth is used up, the whole path
is a leaf too, however large; its pairs are decided block by block, so nothing
is capped. With `branches` tokens at each node a pair of similarity s survives
a node with probability 1-(1-s)**branches about; runs, each over coordinates of
its own, repeat until the chance of missing a pair at the threshold is below
1-recall (see `runs_needed`). In a leaf, whole signatures are compared first: a
pair with fewer than `AGREE` equal coordinates of `COORDINATES` is not compared
further, which a pair at the threshold meets with a chance of 2e-6.

Copies of one text are one set. Defined results: a null text counts as empty;
empty texts are copies of one another and link with nothing; a text of one to
four words is one run of them all; repeated rows are copies; other columns are
not read. class_id is the least doc_id of the group (null if all are null).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import near
from .common import bounded_batches, drop_scratch, few, hashed_words, in_chunks, shingle_hashes, stored, text_key, text_or_empty, tidied, utf8_list

COORDINATES = 24
#: Coordinates that two signatures must share.
AGREE = 9


def runs_needed(similarity: float, recall: float, branches: int = 3, depth: int = 6) -> int:
    """Runs after which a pair at the threshold is missed with a chance below 1-recall, at the greatest depth."""
    miss = 0.0
    for _ in range(depth):
        miss = (1 - similarity * (1 - miss)) ** branches
    runs, left = 1, miss
    while left > 1 - recall:
        runs, left = runs + 1, left * miss
    return runs


def signatures(docs: DataFrame, width: int = 5, coordinates: int = COORDINATES) -> DataFrame:
    """doc_id, sid, sig of every row of docs; sig is null for a text without words."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("sid", T.BinaryType()), T.StructField("sig", T.ArrayType(T.IntegerType()))])

    def run(batches):
        for batch in batches:
            texts = utf8_list(batch.column(2))
            for lo, hi in in_chunks(texts):
                h, _, _, first = hashed_words(texts[lo:hi])
                runs, at = shingle_hashes(h, first, width)
                some = (at[1:] > at[:-1]).nonzero()[0]
                sig = [None] * (hi - lo)
                if len(some):
                    starts = at[:-1][some]
                    values = near.minhashes(runs, np.append(starts, len(runs)), coordinates)
                    for i, v in zip(some.tolist(), values, strict=True):
                        sig[i] = v
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(sig, pa.list_(pa.int32()))], names=[f.name for f in schema])

    return bounded_batches(docs).select(F.col("doc_id").cast("long"), text_key().alias("sid"), text_or_empty().alias("text")).mapInArrow(tidied(run), schema)


def row_key(doc_id, sid):
    """Stands for a document: its id with its text. Copies with ids of their own have keys of their own."""
    return F.unhex(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("-")), F.lit(":"), F.hex(sid))))


def chosen_paths(reps: DataFrame, runs: int, branches: int = 3, small: int = 64, depth: int = 6, unsplit: float = 0.5) -> DataFrame:
    """Leaves (bucket, sid) over reps (sid, sig), as a written table."""
    own = COORDINATES // runs  # of each run
    if own < branches:
        raise ValueError("more runs than coordinates")
    starts = F.array(*(F.lit(r * own + j) for r in range(runs) for j in range(branches)))
    first = reps.select("sid", "sig", F.explode(starts).alias("at")).select(F.xxhash64("at", F.element_at("sig", F.col("at") + 1)).alias("bucket"), "sid", F.expr(f"at div {own}").cast("int").alias("run"))
    made = [stored(near.sized(first), "paths")]
    leaves, open_ = made[0].filter(F.col("size") <= small).select("bucket", "sid"), made[0].filter(F.col("size") > small)
    for d in range(1, depth):
        if open_.limit(1).count() == 0:
            break
        # The run's coordinates in an order of the path's own: `branches` of them from a drawn one on, by an odd step.
        turn = F.xxhash64("bucket", F.lit(d))
        at = (F.col("run") * own + F.pmod(turn + F.col("j") * (1 + 2 * F.pmod(F.shiftright(turn, 8), F.lit(own // 2))), F.lit(own))).cast("int")
        child = open_.join(reps, "sid").select("run", F.col("bucket").alias("parent"), F.col("size").alias("parent_size"), "sid", "sig", F.explode(F.sequence(F.lit(0), F.lit(branches - 1))).alias("j"), "bucket")
        child = child.select("run", "parent", "parent_size", "sid", F.xxhash64("bucket", at, F.element_at("sig", at + 1)).alias("bucket"))
        child = stored(near.sized(child), "paths")
        stuck = stored(child.filter(F.col("size") > F.greatest(F.lit(small), F.col("parent_size") * unsplit)).select(F.col("parent").alias("bucket")).distinct(), "stuck")
        made += [child, stuck]
        leaves = leaves.unionByName(open_.join(stuck, "bucket", "left_semi").select("bucket", "sid"))
        child = child.join(stuck.select(F.col("bucket").alias("parent")), "parent", "left_anti").select("run", "bucket", "sid", "size")
        leaves = leaves.unionByName(child.filter(F.col("size") <= small).select("bucket", "sid"))
        open_ = child.filter(F.col("size") > small)
    out = stored(leaves.unionByName(open_.select("bucket", "sid")).distinct(), "leaves")
    for table in made:
        drop_scratch(table)
    return out


def joined(docs: DataFrame, similarity: float = 0.8, width: int = 5, recall: float = 0.9999) -> tuple[DataFrame, DataFrame]:
    """(rows: doc_id, sid of every row of docs; groups: sid, doc_id (least), n_copies, n_links, class_id)."""
    sigs = stored(signatures(docs, width), "signatures")
    reps = stored(sigs.groupBy("sid").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n_copies"), F.first("sig").alias("sig")), "reps")
    some = reps.filter("sig is not null").select("sid", "sig")
    paths = chosen_paths(some, runs_needed(similarity, recall))
    leaves = stored(near.distinct_leaves(paths), "leaves")
    likely = stored(near.plausible(leaves, some, AGREE), "likely")
    likely_one = stored(near.distinct_leaves(likely), "likely")
    # One row for each wanted text: the copy with the least id. The id is part of the key, so copies don't meet in one task.
    wanted = likely_one.select("sid").distinct().join(reps.select("sid", "doc_id"), "sid")
    wanted = stored(wanted.select(row_key(F.col("doc_id"), F.col("sid")).alias("k")), "wanted")
    texts = few(docs.select(row_key(F.col("doc_id").cast("long"), text_key()).alias("k"), text_key().alias("sid"), text_or_empty().alias("text")), wanted, ["k"], "left_semi")
    edges = stored(near.verified(likely_one, near.shingle_sets(texts, width), similarity), "links")
    for table in (paths, leaves, likely, likely_one, wanted):
        drop_scratch(table)
    label = near.components(edges, "sid", "root")
    links = edges.groupBy("sid").agg(F.sum("links").alias("n_links"))
    linked = label.select(F.col("node").alias("sid"), "component").join(links, "sid", "left").join(reps.select("sid", "doc_id"), "sid")
    least = linked.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "sid")).alias("m")).select("component", F.col("m.doc_id").alias("class_id"), F.col("m.sid").alias("first_sid"))
    linked = linked.join(least, "component").select("sid", F.coalesce("n_links", F.lit(0)).alias("n_links"), "class_id", (F.col("sid") == F.col("first_sid")).alias("stays"), F.lit(True).alias("linked"))
    groups = reps.drop("sig").join(linked, "sid", "left").withColumn("class_id", F.when(F.col("linked"), F.col("class_id")).otherwise(F.col("doc_id")))
    groups = groups.withColumn("n_links", F.coalesce("n_links", F.lit(0)).cast("long")).withColumn("stays", F.coalesce("stays", F.lit(True))).drop("linked")
    groups = stored(groups, "groups")
    for table in (edges, label, reps):
        drop_scratch(table)
    return sigs.drop("sig"), groups


def jaccard_classes(docs: DataFrame, similarity: float = 0.8, width: int = 5) -> DataFrame:
    """doc_id, class_id, n_links (other texts linked with this one), n_copies of every row of docs."""
    rows, groups = joined(docs, similarity, width)
    return rows.join(groups.select("sid", "class_id", "n_links", "n_copies"), "sid").select("doc_id", "class_id", "n_links", "n_copies")


def one_of_each(docs: DataFrame, similarity: float = 0.8, width: int = 5) -> DataFrame:
    """The rows of docs, with all columns, less all but one of each class: the one with the least doc_id (then text hash) stays."""
    rows, groups = joined(docs, similarity, width)
    own = groups.select("sid", "stays", F.col("doc_id").alias("first_id"))
    each = rows.join(own, "sid").select(row_key(F.col("doc_id"), F.col("sid")).alias("k"), (F.col("stays") & F.col("doc_id").eqNullSafe(F.col("first_id"))).alias("stays"))
    # Keys whose rows go, and those of a staying row that is there more than once.
    tagged = stored(each.groupBy("k", "stays").agg(F.count("*").alias("n")).filter("not stays or n > 1").select("k", "stays"), "tagged")
    keyed = few(docs.select(F.struct("*").alias("row"), row_key(F.col("doc_id").cast("long"), text_key()).alias("k")), tagged, ["k"], "left")
    once = keyed.filter("stays is null").select("row")
    repeated = keyed.filter("stays").groupBy("k").agg(F.first("row").alias("row")).select("row")
    return once.unionByName(repeated).select("row.*")
