"""Streams: the GPS gate row by row, bursts by session, seals as they are appended.

The batch operators are used unchanged where state is not needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.positioning import gated

FIX = "burst_id string, ord int, latitude double, longitude double, altitude double, horizontal_accuracy double, vertical_accuracy double, ts timestamp, source string"


def fixes(spark: SparkSession, folder: str) -> DataFrame:
    """Fixes from JSON-line files as they arrive."""
    return spark.readStream.schema(FIX).json(folder)


def gate(stream: DataFrame, most_horizontal: float = 10.0) -> DataFrame:
    return gated(stream, most_horizontal)


def bursts(stream: DataFrame, gap: str = "30 seconds", late: str = "2 minutes") -> DataFrame:
    """Weighted mean place of each session of accepted fixes; state leaves with the watermark."""
    ok = gated(stream).filter("accepted").withWatermark("ts", late)
    w = 1.0 / (F.col("horizontal_accuracy") * F.col("horizontal_accuracy"))
    mean = lambda c: (F.sum(w * F.col(c)) / F.sum(w)).alias(c)
    return ok.groupBy("burst_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"), mean("latitude"), mean("longitude"), mean("altitude"))


def seals(spark: SparkSession, folder: str) -> DataFrame:
    """Seals as lines are added to chain files under folder."""
    return spark.readStream.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").schema("index int, rootHash string, prevSealHash string, author string, wallClockMs long").json(folder)


def chain_faults(stream: DataFrame, by: str = "bundle_id", late: str = "10 minutes") -> DataFrame:
    """Per bundle, with state, each seal's link: ok, broken (its predecessor's hash is not the one before) or repeated. stream: bundle_id, index, own, previous, ts.

    Seals may come out of order: one waits in the state for those before it. Once the
    watermark (`late` behind the newest ts) has passed a bundle's newest seal, what waits is
    given, a gap before a seal being a broken link. The state of a bundle is its
    place, a hash, its newest time and what waits. A seal behind the watermark is dropped.
    """
    import json

    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def check(key, batches, state: GroupState):
        place, last, newest, waiting = state.get if state.exists else (0, None, 0, "[]")
        held = {w[0]: w for w in json.loads(waiting)}
        out = []
        if not state.hasTimedOut:
            for pdf in batches:
                newest = max([newest, *(int(t.timestamp() * 1000) for t in pdf["ts"])])
                for index, own, previous in zip(pdf["index"], pdf["own"], pdf["previous"], strict=True):
                    if index < place or index in held:
                        out.append((key[0], int(index), "repeated"))
                    else:
                        held[int(index)] = [int(index), own, None if pd.isna(previous) else previous]
        for index in sorted(held):
            if index != place and not state.hasTimedOut:
                break
            _, own, previous = held.pop(index)
            out.append((key[0], index, "ok" if index == place and previous == last else "broken"))
            place, last = index + 1, own
        state.update((place, last, newest, json.dumps([held[i] for i in sorted(held)])))
        if held:
            state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame(out, columns=[by, "index", "link"])

    return stream.withWatermark("ts", late).groupBy(by).applyInPandasWithState(check, f"{by} string, index int, link string", "place int, last string, newest long, waiting string", "append", GroupStateTimeout.EventTimeTimeout)
