"""URL filters: host and path rules, then a character language-model ratio.

URLs that a rule decides are the training data: those it allows are the
accepted class, those it blocks the rejected one. Each class has a
variable-order Markov model over a small alphabet: Witten-Bell smoothing mixes
every context with the next shorter one, and contexts seen fewer than
`least_seen` times are left to the shorter one. A URL that no rule decides is
blocked when the mean over its characters of log(accepted / rejected) is below a
threshold, calibrated on three sixteenths of the training URLs, which the models never saw.

Everything is DataFrame operations. One pass counts the grams of all URLs
(aggregated before the shuffle), giving at most 40**4 rows; from these the
models and one score for each gram are derived. That bounded table is the only
broadcast. A second pass sums each URL's gram scores.

Defined results: a null URL or one without `://` has empty host and path and is
scored as it is (null as empty); repeated rows each give a row; with one class
or none in training, the ratio is 0 for every URL and the threshold 0, so all is
allowed; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: (verdict, host, path) in the order of the contract.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))

#: Symbol 0 begins, symbol 1 ends a URL, the last stands for all other characters; digits count as one.
ALPHABET = "^$abcdefghijklmnopqrstuvwxyz0./-_:?=&#%~"
ORDER = 3
_A_TO_Z, _a_to_z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _A_TO_Z, _a_to_z)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, or nulls."""
    text = verdict = None
    for what, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text = F.when(fits, h + p) if text is None else text.when(fits, h + p)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    return text, verdict


def symbols(url: Column) -> Column:
    """The URL over the alphabet, with its end and the begins that the first contexts need."""
    low = F.translate(F.coalesce(url, F.lit("")), _A_TO_Z + "123456789", _a_to_z + "0" * 9)
    return F.concat(F.lit("^" * ORDER), F.regexp_replace(low, r"[^a-z0./\-_:?=&#%]", "~"), F.lit("$"))


def grams(pages: DataFrame) -> DataFrame:
    """A row for each character of each URL: `gram`, the character with the ORDER before it."""
    return pages.withColumn("s", symbols(F.col("url"))).withColumn("i", F.explode(F.sequence(F.lit(1), F.length("s") - ORDER))).withColumn("gram", F.expr(f"substring(s, i, {ORDER + 1})")).drop("s", "i")


def gram_scores(counts: DataFrame, least_seen: int) -> DataFrame:
    """gram, llr of every gram in counts (gram, a, r): log of its last character's odds, accepted over rejected, after the rest."""
    out = counts.withColumn("c", F.substring("gram", ORDER + 1, 1)).withColumn("pa", F.lit(1.0 / (len(ALPHABET) - 1))).withColumn("pr", F.lit(1.0 / (len(ALPHABET) - 1)))
    for k in range(ORDER + 1):
        ctx = F.substring("gram", ORDER + 1 - k, k) if k else F.lit("")
        level = counts.select(ctx.alias("ctx"), F.substring("gram", ORDER + 1, 1).alias("c"), "a", "r").groupBy("ctx", "c").agg(F.sum("a").alias("na"), F.sum("r").alias("nr"))
        seen = level.groupBy("ctx").agg(F.sum("na").alias("ta"), F.sum("nr").alias("tr"), F.sum((F.col("na") > 0).cast("long")).alias("da"), F.sum((F.col("nr") > 0).cast("long")).alias("dr")).filter(F.col("ta") + F.col("tr") >= least_seen)
        out = out.withColumn("ctx", ctx).join(level, ["ctx", "c"], "left").join(seen, "ctx", "left")
        for x in "ar":
            n, t, d, p = (F.col(y + x) for y in ("n", "t", "d", "p"))
            out = out.withColumn("p" + x, F.when(t > 0, (n + d * p) / (t + d)).otherwise(p))
        out = out.select("gram", "c", "pa", "pr")
    return out.select("gram", (F.log("pa") - F.log("pr")).alias("llr"))


def held_back(url: Column) -> Column:
    """Three sixteenths of the URLs calibrate the threshold and train no model."""
    return F.substring(F.md5(F.coalesce(url, F.lit(""))), 1, 1) < "3"


def url_verdicts(pages: DataFrame, rules=RULES, least_seen: int = 8) -> DataFrame:
    """page_id, host, path, rule, verdict, llr of every row of pages."""
    base = pages.select("page_id", "url").withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    text, verdict = rule_of(F.col("host"), F.col("path"), rules)
    base = base.withColumn("rule", text).withColumn("ruled", verdict)
    held = held_back(F.col("url"))
    learn = base.select("url", (F.col("ruled") == "allow").alias("a"), (F.col("ruled") == "block").alias("r"), held.alias("held"))
    one = lambda c: F.sum((F.coalesce(F.col(c), F.lit(False)) & ~F.col("held")).cast("long")).alias(c)
    counts = stored(grams(learn).groupBy("gram").agg(one("a"), one("r")), "url-grams")
    classes = counts.agg(F.sum("a"), F.sum("r")).first()
    scores = stored(gram_scores(counts, least_seen), "url-scores")
    if not all(classes):
        scores = scores.withColumn("llr", F.lit(0.0))
    # The row's own number keeps repeated rows apart, and a URL with a third of all rows is no hot key.
    rows = base.withColumn("row", F.monotonically_increasing_id()).withColumn("held", held)
    keys = ["row", "page_id", "host", "path", "rule", "ruled", "held"]
    scored = grams(rows).join(F.broadcast(scores), "gram").groupBy(*keys).agg(F.round(F.avg("llr"), 6).alias("llr"))
    scored = stored(scored.drop("row"), "url-scored")
    cut = threshold(scored.filter("held and ruled is not null").select("llr", (F.col("ruled") == "allow").alias("good")))
    method = F.when(F.col("llr") >= F.lit(cut), "allow").otherwise("block")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "llr")


def threshold(scored: DataFrame) -> float:
    """The hundredth that best parts good from bad, each class weighing the same; the least in size among equals."""
    bins = scored.groupBy(F.greatest(F.lit(-1000), F.least(F.lit(1000), F.floor(F.col("llr") * 100))).alias("b")).agg(F.sum(F.col("good").cast("long")).alias("g"), F.sum((~F.col("good")).cast("long")).alias("n"))
    upto = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # over at most 2,001 rows
    every = Window.partitionBy()
    split = bins.select(((F.col("b") + 1) / 100.0).alias("cut"), F.sum("g").over(upto).alias("gb"), F.sum("n").over(upto).alias("nb"), F.sum("g").over(every).alias("gt"), F.sum("n").over(every).alias("nt"))
    best = split.filter("gt > 0 and nt > 0").orderBy(F.desc(F.round((F.col("nb") / F.col("nt")) - (F.col("gb") / F.col("gt")), 9)), F.abs("cut"), "cut").first()
    return float(best.cut) if best else 0.0
