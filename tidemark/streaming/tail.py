"""The long tail of a stream of interactions: items that one user alone has met, with every entry and exit."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CHANGES = "item_id bigint, version int, in_tail boolean"
#: The user that an item was met by first, whether others followed, and the number of changes.
STATE = "user bigint, many boolean, version int"


def tail_changes(events: DataFrame, delay: str = "1 day", keep_days: int | None = None) -> DataFrame:
    """item_id, version (from 1) and in_tail whenever an item enters the long tail (its first user) or leaves it (a second one).

    events: user_id, item_id, ts. The state of an item is one user and a flag, whatever the number of its users and events, so the order
    of arrival doesn't matter. keep_days: items without an event for so long, by the watermark of ts, are forgotten and, where they were in it, leave the
    tail; None keeps them.
    """
    if events.isStreaming:
        events = events.withWatermark("ts", delay)

    def step(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        user, many, version = state.get if state.exists else (None, False, 0)
        changes = []
        if state.hasTimedOut:
            if not many:
                changes.append((key[0], version + 1, False))
            state.remove()
        else:
            latest = None
            for frame in frames:
                if frame.empty:
                    continue
                latest = frame["ts"].max() if latest is None else max(latest, frame["ts"].max())
                if many:
                    continue
                found = frame["user_id"].unique()
                if user is None:
                    user, version = int(found[0]), version + 1
                    changes.append((key[0], version, True))
                if (found != user).any():
                    many, version = True, version + 1
                    changes.append((key[0], version, False))
            state.update((user, many, version))
            if keep_days is not None and latest is not None:
                due = int(latest.timestamp() * 1000) + keep_days * 86_400_000
                state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(changes, columns=["item_id", "version", "in_tail"])

    timeout = GroupStateTimeout.NoTimeout if keep_days is None else GroupStateTimeout.EventTimeTimeout
    known = events.where("user_id is not null and item_id is not null").select("user_id", "item_id", "ts")
    return known.groupBy("item_id").applyInPandasWithState(step, CHANGES, STATE, "append", timeout)


def tail_now(changes: DataFrame) -> DataFrame:
    """item_id of the items whose last change was an entry."""
    return changes.groupBy("item_id").agg(F.max_by("in_tail", "version").alias("in_tail")).where("in_tail").select("item_id")


def streamed_tail(spark: SparkSession, events: DataFrame, folder: str, **options) -> DataFrame:
    """The long tail after all events that a stream has now; folder keeps the changes and the stream's checkpoint, so that a further call goes on from there."""
    query = tail_changes(events, **options).writeStream.format("parquet").option("path", f"{folder}/changes").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return tail_now(spark.read.parquet(f"{folder}/changes"))
