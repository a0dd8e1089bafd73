"""Incremental matching as streams: an extension, as batch matching has no streams of its own."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timed(df: DataFrame) -> DataFrame:
    """df with ts as a time stamp that a watermark takes, whatever kind of time stamp it is."""
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def match_new_labels(stream: DataFrame, target: DataFrame) -> DataFrame:
    """(entity1, entity2, ts) as labels (iri, label, ts) arrive: a stream-static join on the label without case."""
    known = target.select(F.lower("label").alias("k"), F.col("iri").alias("entity2")).distinct()
    return stream.withColumn("k", F.lower("label")).join(known, "k").select(F.col("iri").alias("entity1"), "entity2", "ts")


def first_matches(matches: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each pair once within the time that late rows may take."""
    return timed(matches).withWatermark("ts", late).dropDuplicatesWithinWatermark(["entity1", "entity2"])


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """(start, event_type, n, total) per tumbling or sliding window."""
    at = F.window("ts", width, slide) if slide else F.window("ts", width)
    return timed(events).withWatermark("ts", late).groupBy(at.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, start, end, n) of runs of a user's events with no gap longer than that."""
    return timed(events).withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def running_best(scored: DataFrame) -> DataFrame:
    """(entity1, entity2, score) each time a source class gets a better target than all before, as state per class."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        best = state.get[0] if state.exists else float("-inf")
        found = None
        for b in batches:
            for other, score in zip(b["entity2"], b["score"], strict=True):
                if score > best:
                    best, found = score, other
        state.update((best,))
        if found is not None:
            yield pd.DataFrame({"entity1": [key[0]], "entity2": [found], "score": [best]})

    return scored.groupBy("entity1").applyInPandasWithState(step, "entity1 string, entity2 string, score double", "best double", "update", "NoTimeout")
