"""Findings and their scans: summaries are always derived from what is stored."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import StoreError
from ..sources import bundles
from .mesh import dropped, scratch


def summaries(findings: DataFrame, scans: DataFrame) -> DataFrame:
    """Findings with the number of their scans and of the sealed ones."""
    n = scans.groupBy("finding_id").agg(F.count("*").alias("scan_count"), F.sum(F.col("sealed").cast("long")).alias("sealed_count"))
    return findings.join(n, "finding_id", "left").fillna(0, ["scan_count", "sealed_count"])


def listing(summary: DataFrame) -> DataFrame:
    return summary.orderBy(F.desc("created_at"), "finding_id")


FINDING = "findingID string, siteID string, title string, expeditionCode string, schemaVersion int, createdAt string, _bad string"


def rebuilt_index(spark: SparkSession, root: str) -> DataFrame:
    """Findings and their scan counts read from a store's folders; unreadable manifests are skipped."""
    found = bundles.read_items(spark, root).filter(F.col("kind").isin("finding", "scan"))
    text = F.max(F.when(F.col("kind") == "finding", F.decode("content", "UTF-8")))
    each = found.groupBy("finding_id").agg(text.alias("text"), F.count_if(F.col("kind") == "scan").alias("scan_count"))
    parsed = each.select(F.from_json("text", FINDING, {"columnNameOfCorruptRecord": "_bad"}).alias("f"), "scan_count")
    return parsed.filter("f._bad is null and f.findingID is not null").select("f.findingID", "f.title", "f.createdAt", "scan_count")


def lineage(scans: DataFrame) -> DataFrame:
    """scan_id, root, depth along parent_scan_id, at any depth.

    Pointers double: each round a scan takes over its ancestor's ancestor, so a chain
    of n takes log2(n) written rounds. A scan whose chain ends at one that is not
    there has no row; a cycle is refused.
    """
    first = scans.select("scan_id", F.coalesce("parent_scan_id", "scan_id").alias("up"), F.col("parent_scan_id").isNotNull().cast("long").alias("depth"), F.col("parent_scan_id").isNull().alias("done"))
    step, left = scratch(first, "lineage"), None
    while True:
        open_ = step.filter(~F.col("done")).count()
        if not open_:
            return step.select("scan_id", F.col("up").alias("root"), "depth")
        if open_ == left:
            raise StoreError("cycle in lineage")
        left = open_
        above = step.select(F.col("scan_id").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"), F.col("done").alias("top"))
        moved = step.filter(~F.col("done")).join(above, "up").select("scan_id", F.col("next").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), F.col("top").alias("done"))
        new = scratch(step.filter("done").unionByName(moved), "lineage")
        dropped(step)
        step = new
