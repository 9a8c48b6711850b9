"""Substring dedup: paragraphs by MinHash banding.

A paragraph is a line of a text. Equal paragraphs are one set. Paragraphs of
`least` words or more get a MinHash signature; bands and rows are tuned so that a
pair at the threshold collides in a band with the wanted chance, and a pair of
unlike ones seldom. Colliding paragraphs are verified by exact Jaccard similarity
of five-word runs (`near.verified`). Components of what is verified are the
clusters: each keeps its first occurrence, and the others are removed.

What was copied into the middle of another line, or over several, is found by
windows: every text gives overlapping windows of `WINDOW` words, which heed neither
lines nor punctuation. A window is taken where its hash is the least of `REACH`
neighbouring windows, so equal words give equal windows: a run of n words
that stands twice has windows over n - 2 * (REACH - 1) of its words at least, 31
of 51, without a gap. Two windows of so few words are at the threshold only
if all their five-word runs are equal, so windows match by equality.

An occurrence is reported only where the clustered words of a text make up a
passage of `passage` words or more, with gaps of less than `gap` words.

Rows are narrow: texts are read again, but never shuffled, to fetch the
passages' words; only texts with candidates are.

Defined results: null and wordless texts hold no paragraph; lines under `least`
words count by equality alone; occurrences within one text count as repeats;
repeated rows are copies of one another; offsets are bytes of the UTF-8 text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import near
from .common import bounded_batches, drop_scratch, few, hashed_words, in_chunks, mix64, shingle_hashes, stored, text_or_empty, tidied, utf8_list


def tune(similarity: float, recall: float, unlike: float = 0.2, false: float = 0.1) -> tuple[int, int]:
    """(bands, rows): the fewest rows, and of them the fewest bands, that let a pair at the threshold collide with chance `recall`, and one of similarity `unlike` with chance `false` at most."""
    rows = bands = 1
    while True:
        while 1 - (1 - similarity**rows) ** bands < recall:
            bands += 1
        if 1 - (1 - unlike**rows) ** bands <= false:
            return bands, rows
        rows += 1


#: Stands for a null doc_id.
NO_ID = -(1 << 63)

_UNITS = T.StructType(
    [
        T.StructField("d", T.LongType()),
        T.StructField("tk", T.LongType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("words", T.IntegerType()),
        T.StructField("first_word", T.IntegerType()),
        T.StructField("unit", T.LongType()),
        T.StructField("unit2", T.LongType()),
        T.StructField("bands", T.ArrayType(T.LongType())),
    ]
)


#: Words of a window, and of how many neighbouring windows the one with the least hash is taken.
WINDOW = REACH = 11

_WINDOWS = "d long, tk long, start int, end int, first_word int, unit long"


def windows(docs: DataFrame) -> DataFrame:
    """The windows of docs (d, tk, text): place and hash."""

    def run(batches):
        for batch in batches:
            texts = utf8_list(batch.column(2))
            for lo, hi in in_chunks(texts):
                text, start, end, first, unit = _windows(texts[lo:hi])
                take = pa.array(text + lo)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), *(pa.array(x, pa.int32()) for x in (start, end, first)), pa.array(unit.view(np.int64))], names=["d", "tk", "start", "end", "first_word", "unit"])

    return bounded_batches(docs).select("d", "tk", "text").mapInArrow(tidied(run), _WINDOWS)


def _windows(texts: list[bytes]):
    h, start, end, first = hashed_words(texts)
    runs, at = shingle_hashes(h, first, WINDOW)
    owner = np.repeat(np.arange(len(texts)), np.diff(at))
    if len(runs) < REACH:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.view(np.uint64)
    # The last of the least, of every REACH windows that are all of one text.
    least = np.arange(REACH - 1, len(runs)) - np.argmin(np.lib.stride_tricks.sliding_window_view(runs, REACH)[:, ::-1], axis=1)
    pick = np.unique(least[owner[REACH - 1 :] == owner[: len(owner) - REACH + 1]])
    text = owner[pick]
    nth = pick - at[:-1][text]
    word = first[:-1][text] + nth
    return text, start[word], end[word + WINDOW - 1], nth, runs[pick]


def paragraphs(docs: DataFrame, bands: int, rows: int, least: int, width: int = 5) -> DataFrame:
    """The lines of docs (d, tk, text): place, hash and, where they have `least` words, bands."""

    def run(batches):
        for batch in batches:
            texts = utf8_list(batch.column(2))
            for lo, hi in in_chunks(texts):
                text, start, end, words, first, unit, unit2, keys = _units(texts[lo:hi], bands, rows, least, width)
                take = pa.array(text + lo)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), *(pa.array(x, pa.int32()) for x in (start, end, words, first)), pa.array(unit.view(np.int64)), pa.array(unit2.view(np.int64)), pa.array(keys, pa.list_(pa.int64()))], names=[f.name for f in _UNITS])

    return bounded_batches(docs).select("d", "tk", "text").mapInArrow(tidied(run), _UNITS)


def _units(texts: list[bytes], bands: int, rows: int, least: int, width: int):
    h, start, end, first = hashed_words(texts)
    if not len(h):
        none = np.zeros(0, np.int64)
        return none, none, none, none, none, none.view(np.uint64), none.view(np.uint64), []
    counts = np.diff(first)
    owner = np.repeat(np.arange(len(counts)), counts)
    # A word begins a line if it begins its text or a line break stands before it.
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    sizes = np.array([len(t) + 1 for t in texts])
    begins = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    a, e = start + begins[owner], end + begins[owner]
    breaks = np.concatenate(([0], np.cumsum(buf == 10)))
    line = np.ones(len(h), bool)
    line[1:] = breaks[a[1:]] > breaks[e[:-1]]

    lines = np.append(np.flatnonzero(line), len(h))
    n = np.diff(lines)
    keys: list = [None] * len(n)
    runs, at = shingle_hashes(h, lines, width)
    some = np.flatnonzero(n >= least)
    if len(some):
        pick = np.concatenate([np.arange(at[i], at[i + 1]) for i in some])
        of = np.concatenate(([0], np.cumsum(at[some + 1] - at[some])))
        sig = near.minhashes(runs[pick], of, bands * rows).astype(np.int64).view(np.uint64).reshape(len(some), bands, rows)
        band = np.zeros((len(some), bands), np.uint64) + np.arange(1, bands + 1, dtype=np.uint64)
        for r in range(rows):
            band = mix64(band * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, r])
        for i, b in zip(some.tolist(), band.view(np.int64), strict=True):
            keys[i] = b
    return _rows(h, start, end, first, owner, lines, keys)


def _rows(h, start, end, first, owner, cut, keys):
    a, b = cut[:-1], cut[1:]
    n = b - a
    # Order counts: a word's hash is mixed with its place in the unit.
    place = np.arange(len(h)) - np.repeat(a, n)
    x = mix64(h + (place.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    unit = np.bitwise_xor.reduceat(x, a)
    unit2 = mix64(np.add.reduceat(x, a) ^ n.astype(np.uint64))
    return owner[a], start[a], end[b - 1], n, a - first[owner[a]], unit, unit2, keys


def repeated_passages(docs: DataFrame, similarity: float = 0.8, width: int = 5, recall: float = 0.999, least: int = 20, passage: int = 30, gap: int = 8) -> DataFrame:
    """doc_id, start, end, n_words, class_id, removed: a row for each repeated passage of docs.

    Passages are within one text; start and end are bytes. A passage is removed
    unless all of its paragraphs are the first of their clusters.
    """
    bands, rows = tune(similarity, recall)
    source = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("d"), F.xxhash64(text_or_empty()).alias("tk"), text_or_empty().alias("text"))
    units = stored(paragraphs(source, bands, rows, least, width), "units")
    # Equal paragraphs are one set: its first occurrence, how many there are and, of lines, the bands.
    sets = units.groupBy("unit", "unit2").agg(F.min(F.struct("d", "tk", "start", "end")).alias("first"), F.count("*").alias("n"), F.max("bands").alias("bands")).filter("n > 1 or bands is not null")
    sets = stored(sets.withColumn("sid", F.unhex(F.concat(F.lpad(F.hex("unit"), 16, "0"), F.lpad(F.hex("unit2"), 16, "0")))), "sets")
    keyed = sets.filter("bands is not null").select("sid", F.explode(F.array_distinct("bands")).alias("bucket"))
    met = stored(near.sized(keyed).select("bucket", "sid"), "met")
    leaves = stored(near.distinct_leaves(met), "leaves")
    wanted = leaves.select("sid").distinct().join(sets.select("sid", "first"), "sid").groupBy("first.d", "first.tk").agg(F.collect_list(F.struct("sid", "first.start", "first.end")).alias("ps"))
    wanted = stored(wanted, "wanted")
    texts = few(source, wanted, ["d", "tk"])
    texts = texts.select(F.encode("text", "UTF-8").alias("b"), F.explode("ps").alias("p"))
    texts = texts.select("p.sid", F.expr("decode(substring(b, p.start + 1, p.end - p.start), 'UTF-8')").alias("text"))
    edges = stored(near.verified(leaves, near.shingle_sets(texts, width), similarity), "links")
    label = near.components(edges, "sid", "root")
    # Cluster of each paragraph that occurs twice or is like another one.
    named = sets.select("unit", "unit2", "sid", "first", "n").join(label.withColumnRenamed("node", "sid"), "sid", "left").filter("n > 1 or component is not null")
    named = stored(named.select("unit", "unit2", "first", F.coalesce("component", "sid").alias("component")), "named")
    keep = named.groupBy("component").agg(F.min("first").alias("keep"))
    clusters = stored(named.join(keep, "component").select("unit", "unit2", "keep"), "clusters")
    for table in (sets, met, leaves, wanted, edges, label, named):
        drop_scratch(table)
    hit = stored(units.select("d", "tk", "start", "end", "words", "first_word", "unit", "unit2").join(clusters, ["unit", "unit2"]), "hit")
    drop_scratch(units)
    drop_scratch(clusters)
    # Windows are many, and most stand once: their hashes are counted alone, and they are cut anew for the join.
    twice = stored(windows(source).groupBy("unit").count().filter("count > 1").select("unit"), "twice")
    within = stored(windows(source).join(twice.hint("merge"), "unit").withColumn("words", F.lit(WINDOW)), "windows")
    drop_scratch(twice)
    # A table of its own, so that the join's hot windows can be split.
    firsts = stored(within.groupBy("unit").agg(F.min(F.struct("d", "tk", "start", "end")).alias("keep")), "firsts")
    within = within.join(firsts.hint("merge"), "unit")
    hit = hit.drop("unit", "unit2").withColumn("win", F.lit(False)).unionByName(within.drop("unit").withColumn("win", F.lit(True)))
    return _passages(hit, passage, gap)


def _runs(hit: DataFrame, by: list[str], gap: int) -> DataFrame:
    """hit with `run`, new where `gap` words or more are not clustered, and the words that each row adds to it."""
    ordered = Window.partitionBy(*by).orderBy("first_word", F.desc("words"))
    last = F.col("first_word") + F.col("words")
    runs = hit.withColumn("before", F.max(last).over(ordered.rowsBetween(Window.unboundedPreceding, -1)))
    runs = runs.withColumn("new", (F.col("before").isNull() | (F.col("first_word") - F.col("before") >= gap)).cast("int"))
    fresh = F.greatest(F.lit(0), last - F.greatest(F.col("first_word"), F.coalesce("before", F.lit(0))))
    return runs.withColumn("fresh", fresh).withColumn("run", F.sum("new").over(ordered)).drop("before", "new")


def _passages(hit: DataFrame, passage: int, gap: int) -> DataFrame:
    """Joins neighbouring clustered paragraphs and windows of a text to passages.

    Neighbouring lines stay or go together, with the windows inside
    them. Other windows go where they are not the first of their cluster and make
    up a passage with what goes beside them; fewer words stay with what is around.
    """
    # A repeated row brings its paragraphs again; `row` numbers the copies of one place.
    # All windows below are within a text, so one shuffle serves them.
    numbered = hit.repartition("d", "tk").withColumn("row", F.row_number().over(Window.partitionBy("d", "tk", "start", "end", "win").orderBy(F.lit(0))))
    own = (F.col("keep.d") == F.col("d")) & (F.col("keep.tk") == F.col("tk")) & (F.col("keep.start") == F.col("start")) & (F.col("row") == 1)
    last = F.col("first_word") + F.col("words")
    text = ["d", "tk", "row"]
    lines = _runs(numbered.withColumn("own", own), [*text, "win"], gap)
    whole = Window.partitionBy(*text, "win", "run")
    lines = lines.withColumn("around", F.when(~F.col("win"), F.struct(F.max(last).over(whole).alias("last"), F.max(~F.col("own")).over(whole).alias("go"))))
    # The line run that began last, before or with a window.
    lines = lines.withColumn("around", F.max("around").over(Window.partitionBy(*text).orderBy("first_word", "win", F.desc("words")).rowsBetween(Window.unboundedPreceding, 0)))
    go = F.when(~F.col("win") | (F.col("around.last") >= last), F.col("around.go")).otherwise(~F.col("own"))
    parts = _runs(lines.withColumn("go", go).drop("around", "run", "fresh"), [*text, "go"], gap)
    parts = parts.withColumn("go", F.col("go") & (F.sum("fresh").over(Window.partitionBy(*text, "go", "run")) >= passage))
    runs = _runs(parts.drop("run", "fresh"), [*text, "go"], gap)
    kept = F.coalesce(F.min(F.when(~F.col("win"), F.col("keep.d"))), F.mode("keep.d", True))
    out = runs.groupBy(*text, "go", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("fresh").cast("long").alias("n_words"), kept.alias("class_id"))
    real = lambda c: F.nullif(F.col(c), F.lit(NO_ID)).alias(c if c != "d" else "doc_id")
    return out.filter(F.col("n_words") >= passage).select(real("d"), "start", "end", "n_words", real("class_id"), F.col("go").alias("removed"))
