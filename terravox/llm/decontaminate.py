"""Benchmark decontamination over a distributed positional inverted index.

One pass over the texts writes the index: postings (key, position, term) of the
benchmark's terms in every document, and a last posting that holds the number of
its words. How often a term occurs says how rare it is. Of every benchmark window
the rarest two positions are its anchors. Offset-adjusted, a posting of an anchor
lies on a diagonal (document position less item position), and a phrase puts all
its anchors on one diagonal: intersecting the lists is one grouping by (document,
item, diagonal), of which those with two anchors or more stay. Each candidate is
then compared with the document word by word, in the index: every word of the item
is looked up at its place on the diagonal, so matches are exact and no text is
read again. Anchors that fall near one another, but not on one diagonal, are
proximity matches; they are counted beside the exact ones, and `matches` gives the places of both.

All of it is DataFrame operations. Benchmark-side tables are broadcast by Spark
only while their files are below its broadcast threshold; beyond it the same
joins shuffle, and skewed terms are split by adaptive execution. Keys of candidates
are broadcast only when counted few enough.
Documents are told apart by (doc_id, text hash): repeated rows share their
postings and each get the result.

Defined results: a null or wordless text has no words, hits or items and is
clean; an item without words has no window; null item ids are written as empty;
an empty benchmark leaves every document clean. Columns of docs are told from
those made here by a struct around them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import few, stored, text_key

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WINDOW = 13


def words_of(text: Column) -> Column:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased; null has none."""
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    # Only the first and the last part can be empty.
    return F.array_remove(parts, "")


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """item (hash of the words), words, ids: items of equal words are one."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("id"), words_of(F.col("text")).alias("words")).filter("size(words) > 0")
    return rows.groupBy("words").agg(F.array_sort(F.collect_set("id")).alias("ids")).select(F.md5(F.array_join("words", " ")).alias("item"), "words", "ids")


#: A term that no text holds: its posting stands behind a document's words.
END = "\0"


def index_of(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """term, key, pos, doc_id: where docs (doc_id, key, text) hold the given terms (term), and END behind each row's words."""
    every = terms.unionByName(docs.sparkSession.range(1).select(F.lit(END).alias("term")))
    return docs.select("doc_id", "key", F.posexplode(F.array_append(words_of(F.col("text")), F.lit(END))).alias("pos", "term")).join(every, "term", "left_semi")


def frequencies(index: DataFrame, terms: DataFrame) -> DataFrame:
    """term, df: how often each of the terms occurs."""
    found = index.groupBy("term").agg(F.count("*").alias("df"))
    return terms.join(found, "term", "left").select("term", F.coalesce("df", F.lit(0)).alias("df"))


def anchors(items: DataFrame, frequencies: DataFrame, window: int = WINDOW) -> DataFrame:
    """item, p, term: the two rarest positions of every window (one, if the item is one word)."""
    at = items.select("item", F.size("words").alias("n"), F.posexplode("words").alias("p", "term")).join(frequencies, "term")
    starts = F.sequence(F.greatest(F.lit(0), F.col("p") - window + 1), F.greatest(F.lit(0), F.least(F.col("p"), F.col("n") - window)))
    ranked = at.withColumn("start", F.explode(starts)).withColumn("rank", F.row_number().over(Window.partitionBy("item", "start").orderBy("df", "term", "p")))
    return ranked.filter("rank <= 2").select("item", "p", "term").distinct()


def diagonals(index: DataFrame, anchor: DataFrame) -> DataFrame:
    """key, item, diag, ps: where offset-adjusted lists meet."""
    return index.join(anchor, "term").groupBy("key", "item", (F.col("pos") - F.col("p")).alias("diag")).agg(F.collect_set("p").alias("ps"))


def candidates(met: DataFrame, items: DataFrame) -> DataFrame:
    """key, item, diag with as many anchors as a phrase must have."""
    return met.join(items.select("item", F.size("words").alias("n")), "item").filter(F.size("ps") >= F.least(F.lit(2), F.col("n"))).select("key", "item", "diag")


def proximity_matches(met: DataFrame, items: DataFrame, slack: int = 5, least: int = 2) -> DataFrame:
    """key, item, diag, n: items of which `least` anchors or more (the anchor, of a one-word item) lie within `slack` words of one diagonal."""
    near = met.withColumn("block", F.explode(F.array(F.floor(F.col("diag") / slack), F.floor(F.col("diag") / slack) + 1))).select("key", "item", "diag", "block", F.explode("ps").alias("p"))
    hit = near.groupBy("key", "item", "block").agg(F.size(F.collect_set("p")).alias("n"), F.min("diag").alias("diag")).join(items.select("item", F.size("words").alias("of")), "item")
    hit = hit.filter(F.col("n") >= F.least(F.lit(least), F.col("of"))).groupBy("key", "item").agg(F.max(F.struct("n", (-F.col("diag")).alias("back"))).alias("best"))
    return hit.select("key", "item", (-F.col("best.back")).alias("diag"), F.col("best.n").alias("n"))


def keyed(docs: DataFrame) -> DataFrame:
    """docs as `row`, with doc_id, key and text: rows of one id and text are one document."""
    id_ = F.col("doc_id").cast("long")
    key = F.unhex(F.md5(F.concat(F.coalesce(id_.cast("string"), F.lit("-")), F.lit(":"), F.hex(text_key()))))
    return docs.select(F.struct("*").alias("row"), id_.alias("doc_id"), key.alias("key"), "text")


def verified(index: DataFrame, found: DataFrame, items: DataFrame, window: int) -> DataFrame:
    """key, item, start, n: where candidates (key, item, diag) hold whole windows, by the postings; start is a document position."""
    words = items.select("item", F.size("words").alias("of"), F.posexplode("words").alias("p", "term"))
    need = found.join(words, "item").select("key", "item", "diag", "of", "p", "term", (F.col("diag") + F.col("p")).alias("pos"))
    keys = stored(found.select("key").distinct(), "candidate-keys")
    have = few(index.select("key", "pos", "term"), keys, ["key"], "left_semi").distinct()
    same = need.join(have, ["key", "pos", "term"], "left_semi").groupBy("key", "item", "diag", "of").agg(F.array_sort(F.collect_list("p")).alias("ps"))
    length = f"least({window}, of)"
    starts = f"filter(sequence(0, size(ps) - {length}), i -> ps[i + {length} - 1] - ps[i] = {length} - 1)"
    whole = same.filter(f"size(ps) >= {length}").select("key", "item", F.expr(length).alias("n"), "diag", F.expr(f"explode(transform({starts}, i -> ps[i]))").alias("s"))
    return whole.select("key", "item", (F.col("diag") + F.col("s")).alias("start"), "n")


def searched(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(index, items, places of whole windows, diagonals), written tables."""
    items = stored(benchmark_items(benchmark), "items")
    terms = stored(items.select(F.explode("words").alias("term")).distinct(), "terms")
    index = stored(index_of(keyed(docs), terms), "index")
    anchor = stored(anchors(items, frequencies(index, terms), window), "anchors")
    met = stored(diagonals(index.select("term", "key", "pos"), anchor), "diagonals")
    return index, items, stored(verified(index, stored(candidates(met, items), "candidates"), items, window), "places"), met


def found_in(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(rows: doc_id, key, n_words of every row of docs; hits: key, n_hit, items, n_near of those with any), written tables."""
    index, items, places, met = searched(docs, benchmark, window)
    words = places.select("key", F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("pos")).distinct().groupBy("key").agg(F.count("*").alias("n_hit"))
    ids = places.select("key", "item").distinct().join(items.select("item", "ids"), "item").select("key", F.explode("ids").alias("id")).groupBy("key").agg(F.array_sort(F.collect_set("id")).alias("items"))
    near = proximity_matches(met, items).groupBy("key").agg(F.count("*").alias("n_near"))
    hits = stored(near.join(words.join(ids, "key"), "key", "full"), "hits")
    return index.filter(F.col("term") == END).select("doc_id", "key", F.col("pos").cast("long").alias("n_words")), hits


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slack: int = 5, least: int = 2) -> DataFrame:
    """doc_id, item_id, kind, start, n: every place of a whole window (kind exact; start is its first word in the document, n its words) and every item near by (kind near; start is where the item would begin, n its anchors there).

    Rows of one id and text are one document; items of equal words are told by each of their ids.
    """
    index, items, places, met = searched(docs.select("doc_id", "text"), benchmark, window)
    names = index.filter(F.col("term") == END).select("doc_id", "key").distinct()
    exact = places.select("key", "item", F.lit("exact").alias("kind"), F.col("start").cast("long").alias("start"), F.col("n").cast("long").alias("n")).distinct()
    near = proximity_matches(met, items, slack, least).select("key", "item", F.lit("near").alias("kind"), F.col("diag").cast("long").alias("start"), F.col("n").cast("long").alias("n"))
    return exact.unionByName(near).join(items.select("item", "ids"), "item").join(names, "key").select("doc_id", F.explode("ids").alias("item_id"), "kind", "start", "n")


def judged(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, key, n_words, n_hit, items, n_near, contaminated of every row of docs."""
    rows, hits = found_in(docs, benchmark, window)
    out = few(rows, hits, ["key"], "left")
    out = out.withColumn("n_hit", F.coalesce("n_hit", F.lit(0)).cast("long")).withColumn("n_near", F.coalesce("n_near", F.lit(0)).cast("long")).withColumn("items", F.coalesce("items", F.expr("cast(array() as array<string>)")))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and n_near (items with a proximity match) of every row of docs."""
    return judged(docs.select("doc_id", "text"), benchmark, window).select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated", "n_near")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs that are not contaminated, with all their columns."""
    bad = stored(judged(docs.select("doc_id", "text"), benchmark, window).filter("contaminated").select("key").distinct(), "contaminated")
    return few(keyed(docs).select("row", "key"), bad, ["key"], "left_anti").select("row.*")
