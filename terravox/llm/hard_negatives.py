"""Hard-negative mining by threshold joins over partial inverted indexes.

Anchors (a bounded block of them at a time, broadcast) meet all rows where these
lie; no vector is shuffled. Each batch of rows becomes an inverted index: for each
dimension the rows that hold it, where a row's first dimensions are left out
as long as their norm times the greatest anchor's stays under the least threshold,
so no pair at or over its threshold lacks an indexed dimension. Partial scores are
accumulated from the last dimension down; a pair is dropped once its partial score
and the norms of what remains on either side stay under the anchor's threshold. What
is left is scored exactly, in whole numbers.

Thresholds are lowered round by round: first for the positives (an anchor is done
when five rows of its label reach the threshold, or when the threshold is gone),
then for the negatives, whose windows [lowest, highest] are set by each positive's
score (a window is done when it is full above the threshold, or the threshold is
at its lower end). A round is one job over all rows for the anchors that are not done;
each task gives back its own best rows of each window only, so the result is the
same as that of scoring every pair.

Defined results: rows with a null vec_id, label or vector, or with a null or
non-finite component take no part; vectors of different length are filled up with zeros; an
anchor's own id is never among its rows; a vec_id that stands more than once is
as many rows, but one anchor (the least row); a pair's score must be under 2**53,
or the query fails; without anchors, or without rows of another label, there are no rows; extra columns play no part.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_scratch, stored

#: Dimensions whose postings are one list, after which pairs are pruned; a pair of FEW left is scored at once; rows and anchors that are scored together.
CHUNK, FEW, ROWS, ANCHORS = 16, 16, 4096, 256
#: A window's ends, in hundredths of the positive's score.
LOWEST, HIGHEST = 30, 90


def usable(rows: DataFrame, dims_scale: int = 256) -> DataFrame:
    """vec_id, label, v (whole numbers) of the rows that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    kept = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.transform("embedding", lambda x: F.floor(x.cast("double") * dims_scale).cast("double")).alias("v"))


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors as rows, filled up with zeros to the longest."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out


def wide(x: np.ndarray, dims: int) -> np.ndarray:
    return x if x.shape[1] == dims else np.hstack((x, np.zeros((len(x), dims - x.shape[1]))))


@dataclass
class Index:
    """Postings of a batch of rows: for each CHUNK of dimensions the rows that have some of them in the index, and their values there (0 where they have not)."""

    rows: np.ndarray
    norms: np.ndarray  # of each row's dimensions before each one
    first: np.ndarray  # each row's first dimension in the index
    postings: list[tuple[np.ndarray, np.ndarray]]


def norms_before(x: np.ndarray) -> np.ndarray:
    """Of each row the norm of its first 0, 1, 2, ... dimensions, never too small."""
    return np.sqrt(np.concatenate((np.zeros((len(x), 1)), np.cumsum(x**2, axis=1)), axis=1)) * (1 + 1e-12)


def indexed(rows: np.ndarray, least: float, longest: float) -> Index:
    """Leaves each row's first dimensions out while their norm times `longest` is under the threshold `least`."""
    norms = norms_before(rows)
    out = (norms[:, 1:] * longest < least).sum(1)
    held = (rows != 0) & (np.arange(rows.shape[1]) >= out[:, None])
    lists = []
    for d in range(0, rows.shape[1], CHUNK):
        at = np.flatnonzero(held[:, d : d + CHUNK].any(1))
        lists.append((at, np.where(held[at, d : d + CHUNK], rows[at, d : d + CHUNK], 0).T))
    return Index(rows, norms, out, lists)


def reaching(index: Index, anchors: np.ndarray, thresholds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs (anchor, row, score) whose score is at or over the anchor's threshold; no threshold is under the index's."""
    n, dims = index.rows.shape
    partial, left = np.zeros((len(anchors), n)), norms_before(anchors)
    below, least = int(index.first.max(initial=0)), thresholds[:, None]
    alive = np.ones((len(anchors), n), bool)
    for d in range((dims - 1) // CHUNK * CHUNK, -1, -CHUNK):
        at, values = index.postings[d // CHUNK]
        if len(at) == n:
            partial += anchors[:, d : d + CHUNK] @ values
        elif len(at):
            partial[:, at] += anchors[:, d : d + CHUNK] @ values
        if d >= below:
            alive &= partial + left[:, d, None] * index.norms[:, d] >= least
            if alive.sum() * FEW < alive.size:
                break  # few enough to be scored one by one
    else:
        alive &= partial + left[:, index.first] * index.norms[np.arange(n), index.first] >= least
    a, r = np.nonzero(alive)
    keep = [np.zeros(0, np.int64)] * 2, np.zeros(0)
    parts = []
    for i in range(0, len(a), 1 << 16):
        score = np.einsum("ij,ij->i", anchors[a[i : i + (1 << 16)]], index.rows[r[i : i + (1 << 16)]])
        ok = score >= thresholds[a[i : i + (1 << 16)]]
        parts.append((a[i : i + (1 << 16)][ok], r[i : i + (1 << 16)][ok], score[ok]))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (*keep[0], keep[1])


@dataclass
class Windows:
    """What a round looks for: of the rows with the anchor's label, or of all others, the `most` first with a score in [low, high]; in order of anchor."""

    anchors: np.ndarray  # vectors
    ids: np.ndarray
    labels: np.ndarray
    same: bool
    most: int
    anchor: np.ndarray  # of each window, as a place in `anchors`
    positive: np.ndarray  # of each window: place among the anchor's positives, id, score
    low: np.ndarray
    high: np.ndarray
    last: np.ndarray  # whether low is the window's own end

    def thresholds(self) -> np.ndarray:
        out = np.full(len(self.ids), np.inf)
        np.minimum.at(out, self.anchor, self.low)
        return out


def first_of(window: np.ndarray, score: np.ndarray, row: np.ndarray, most: int) -> np.ndarray:
    """Places of each window's first rows: higher scores, then smaller ids."""
    order = np.lexsort((row, -score, window))
    w = window[order]
    begin = np.concatenate(([True], w[1:] != w[:-1])) if len(w) else np.zeros(0, bool)
    place = np.arange(len(w)) - np.maximum.accumulate(np.where(begin, np.arange(len(w)), 0)) if len(w) else np.zeros(0, np.int64)
    return order[place < most]


def found(rows: DataFrame, windows: Windows) -> DataFrame:
    """anchor_id, place, positive_id, positive_score, last, score, vec_id: the first rows of each window in each task."""
    shared = rows.sparkSession.sparkContext.broadcast(windows)  # `at_once` anchors at most

    def run(batches):
        w = shared.value
        t = w.thresholds()
        sought = np.flatnonzero(np.isfinite(t) | (t == -np.inf))
        starts = np.searchsorted(w.anchor, np.arange(len(w.ids) + 1))
        best = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        for batch in batches:
            all_ids, all_labels, all_rows = batch.column(0).to_numpy(), batch.column(1).to_numpy(), matrix(batch.column(2))
            dims = max(all_rows.shape[1], w.anchors.shape[1])
            anchors = wide(w.anchors, dims)
            longest = float(np.sqrt((anchors**2).sum(1)).max(initial=0))
            for i in range(0, len(all_ids), ROWS):
                ids, labels, x = all_ids[i : i + ROWS], all_labels[i : i + ROWS], wide(all_rows[i : i + ROWS], dims)
                if longest * np.sqrt((x**2).sum(1)).max(initial=0) >= 2.0**53:
                    raise ValueError("a score is beyond 2**53")
                index = indexed(x, t[sought].min(initial=np.inf), longest)
                for j in range(0, len(sought), ANCHORS):
                    here = sought[j : j + ANCHORS]
                    a, r, s = reaching(index, anchors[here], t[here])
                    a = here[a]
                    ok = ((w.labels[a] == labels[r]) == w.same) & (w.ids[a] != ids[r])
                    a, r, s = a[ok], r[ok], s[ok]
                    n = starts[a + 1] - starts[a]
                    pair = np.repeat(np.arange(len(a)), n)
                    win = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n) + starts[a][pair]
                    fits = (s[pair] >= w.low[win]) & (s[pair] <= w.high[win])
                    pair, win = pair[fits], win[fits]
                    both = np.concatenate((best[0], win)), np.concatenate((best[1], s[pair])), np.concatenate((best[2], ids[r[pair]]))
                    at = first_of(*both, w.most)
                    best = tuple(x[at] for x in both)
        win, score, row = best
        columns = w.ids[w.anchor[win]], w.positive[win, 0], w.positive[win, 1], w.positive[win, 2], w.last[win], score.astype(np.int64), row
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=NAMES)

    return rows.mapInArrow(run, "anchor_id long, place long, positive_id long, positive_score long, last boolean, score long, vec_id long")


NAMES = ["anchor_id", "place", "positive_id", "positive_score", "last", "score", "vec_id"]


def merged(parts: DataFrame, most: int) -> DataFrame:
    """The first rows of each window over all tasks, with `rank` and the window's number of rows `n`."""
    key = Window.partitionBy("anchor_id", "place")
    ranked = parts.withColumn("rank", F.row_number().over(key.orderBy(F.desc("score"), "vec_id"))).filter(F.col("rank") <= most)
    return ranked.withColumn("n", F.count("*").over(key))


def positives(rows: DataFrame, anchors: tuple[np.ndarray, np.ndarray, np.ndarray], longest: float, most: int) -> np.ndarray:
    """(anchor, place, vec_id, score) of the `most` first rows of each anchor's label, as places, ids and scores."""
    ids, labels, v = anchors
    lengths = np.sqrt((v**2).sum(1))
    at, got = np.arange(len(ids)), []
    for share in (0.5, 0.25, 0.0, -np.inf):
        low = np.floor(lengths[at] * longest * share) if share > -np.inf else np.full(len(at), -np.inf)
        w = Windows(v[at], ids[at], labels[at], True, most, np.arange(len(at)), np.zeros((len(at), 3), np.int64), low, np.full(len(at), np.inf), np.full(len(at), share == -np.inf))
        out = merged(found(rows, w), most).filter("n >= %d or last" % most).select("anchor_id", "rank", "vec_id", "score").toPandas()  # `most` rows an anchor
        place = np.searchsorted(ids, out["anchor_id"].to_numpy())
        got.append(np.column_stack((place, out["rank"], out["vec_id"], out["score"])).astype(np.int64))
        at = np.setdiff1d(at, place)
        if not len(at):
            break
    return np.concatenate(got)


def negatives(rows: DataFrame, anchors: tuple[np.ndarray, np.ndarray, np.ndarray], pos: np.ndarray, most: int) -> list[DataFrame]:
    """Written tables of the rows of all windows of the anchors' positives."""
    ids, labels, v = anchors
    pos = pos[np.lexsort((pos[:, 1], pos[:, 0]))]
    score = pos[:, 3]
    low, high = -((-LOWEST * score) // 100), HIGHEST * score // 100
    pos, low, high, score = (x[low <= high] for x in (pos, low, high, score))
    out = []
    for share in (0.75, 0.5, 0.0):
        if not len(pos):
            break
        t = np.maximum(low, np.ceil(score * share).astype(np.int64))
        w = Windows(v, ids, labels, False, most, pos[:, 0], pos[:, 1:], t.astype(float), high.astype(float), t == low)
        table = stored(merged(found(rows, w), most), "negatives")
        out.append(table.filter((F.col("n") >= most) | F.col("last")))
        full = {(r.anchor_id, r.place) for r in table.filter(F.col("n") >= most).select("anchor_id", "place").distinct().collect()}  # the windows of these anchors
        open_ = np.array([t[i] > low[i] and (ids[p[0]], p[1]) not in full for i, p in enumerate(pos)], bool)
        pos, low, high, score = (x[open_] for x in (pos, low, high, score))
    return out


def hard_negatives(embeddings: DataFrame, every: int = 100, n_positives: int = 5, n_negatives: int = 10, at_once: int = 1 << 14) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of the anchors, the rows whose vec_id is divisible by `every`; `at_once` anchors are broadcast together."""
    spark = embeddings.sparkSession
    rows = usable(embeddings)
    heads = rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("x")).select("vec_id", "x.*")
    longest = rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("n")).first().n
    n = 0 if longest is None else heads.count()
    parts = []
    blocks = -(-n // at_once)
    heads = stored(heads.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(max(1, blocks)))), "anchors") if n else heads
    for block in range(blocks):
        t = heads.filter(F.col("block") == block).orderBy("vec_id").toArrow()
        anchors = t["vec_id"].to_numpy(), t["label"].to_numpy(), matrix(t["v"].combine_chunks())
        if len(anchors[0]):
            parts += negatives(rows, anchors, positives(rows, anchors, float(np.sqrt(longest)), n_positives), n_negatives)
    if n:
        drop_scratch(heads)
    if not parts:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
