"""Sessions of an operator's own, so that no setting of the caller's changes."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def own_session(spark: SparkSession, settings: dict[str, str]) -> SparkSession:
    """A session beside spark's, with its settings and these."""
    own = spark.newSession()
    for key, value in (spark.conf.getAll | settings).items():
        if spark.conf.isModifiable(key):
            own.conf.set(key, value)
    return own


#: Bytes of stored tables for which a shuffle has one partition more; adaptive execution joins small ones to those of `MOST`.
EACH, MOST = 4 << 20, "16m"


def measured_session(spark: SparkSession, tables: str, dealt: bool = False) -> SparkSession:
    """A session for queries over a folder of Parquet tables: joins broadcast a side only once its rows have been measured, and shuffles have more partitions as the tables grow.

    Before a run a side's size is guessed from its files, and rows that an explode adds
    are not in the guess, so that a few megabytes of meshes would be broadcast as gigabytes of corners.
    dealt: the tables hold many small meshes, which stay in the tasks that they are dealt to: a
    join on (mesh, vertex) of two sides that are dealt by mesh alike shuffles neither.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(tables).select("length")
    stored = files.agg(F.sum("length")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), stored // EACH)
    most = spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None) or spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    stay = {"spark.sql.requireAllClusterKeysForCoPartition": "false"} if dealt else {}
    return own_session(spark, stay | {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": most, "spark.sql.shuffle.partitions": str(parts), "spark.sql.adaptive.advisoryPartitionSizeInBytes": MOST})
