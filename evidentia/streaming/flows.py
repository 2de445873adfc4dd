"""Structured Streaming flows: capture, windows, deletion talk, stalls."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.sources.scratch import kept


def capture(turns: DataFrame, path: str, checkpoint: str, tombstones_path: str | None = None):
    """Append a stream of turns to Parquet exactly once: known ids and forgotten ids leave in each batch."""
    spark = turns.sparkSession

    def land(batch: DataFrame, number: int) -> None:
        fresh = batch.dropDuplicates(["turn_id"])
        try:
            known = spark.read.schema("turn_id string").parquet(path)
        except Exception as error:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(error):
                raise
            known = None
        if known is not None:
            fresh = fresh.join(known, "turn_id", "left_anti")
        if tombstones_path:
            fresh = fresh.join(spark.read.schema("id string").parquet(tombstones_path).withColumnRenamed("id", "turn_id"), "turn_id", "left_anti")
        fresh.write.mode("append").parquet(path)

    return turns.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def deduplicated(turns: DataFrame) -> DataFrame:
    return turns.dropDuplicates(["turn_id"])


def event_windows(events: DataFrame, *, every: str = "1 day", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Count and sum of events(ts, event_type, value) by window; later than the watermark is dropped."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    window = F.window("ts", every, slide) if slide else F.window("ts", every)
    return timed.groupBy(window.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def event_sessions(events: DataFrame, *, gap: str = "12 hours", late: str = "1 day") -> DataFrame:
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "user_id", "n")


QUIET_OUT = "session_id string, turn_id string, action string"
QUIET_STATE = "signal_at timestamp, quiet boolean, open string"


def deletion_talk(key, frames: Iterator[pd.DataFrame], state, window_minutes: int = 30) -> Iterator[pd.DataFrame]:
    """For applyInPandasWithState over rows(session_id, turn_id, role, at, position, is_forget_call).

    A call to forget removes the exchange since the user's last turn, or since a call of the last
    window_minutes; replies after it are skipped until the user speaks. Actions: keep, skip, forget.
    """
    signal, quiet, open_turns = state.get if state.exists else (None, False, "")
    held = [tuple(x.split("\t")) for x in open_turns.split("\n") if x]  # (turn_id, at) that a later call may remove
    rows = pd.concat(list(frames)).sort_values(["position"], kind="stable")
    out = []
    for r in rows.itertuples():
        if r.is_forget_call:
            again = signal is not None and (r.at - signal).total_seconds() <= window_minutes * 60
            since = signal if again else None
            for turn, at in held:
                if since is None or pd.Timestamp(at) >= since:
                    out.append((r.session_id, turn, "forget"))
            held, signal, quiet = [], r.at, True
        elif quiet and r.role == "assistant":
            out.append((r.session_id, r.turn_id, "skip"))
        else:
            if r.role == "user":
                recent = signal is not None and (r.at - signal).total_seconds() <= window_minutes * 60
                held, quiet = (held if recent else []), False
            held.append((r.turn_id, str(r.at)))
            out.append((r.session_id, r.turn_id, "keep"))
    state.update((signal, quiet, "\n".join("\t".join(x) for x in held)))
    yield pd.DataFrame(out, columns=["session_id", "turn_id", "action"])


def watch_deletions(rows: DataFrame) -> DataFrame:
    return rows.groupBy("session_id").applyInPandasWithState(deletion_talk, QUIET_OUT, QUIET_STATE, "append", "NoTimeout")


def drain_outbox(outbox: DataFrame, send, sent_path: str) -> int:
    """Send what waits, oldest first, and note it; a failed send leaves it for the next time. How many were sent.

    What waits is checkpointed first: the rows that are sent are those that are noted, whatever arrives
    meanwhile. A run that stops between sending and noting sends them again, so receivers know rows by id.
    """
    spark = outbox.sparkSession
    try:
        outbox = outbox.join(spark.read.schema("id string").parquet(sent_path), "id", "left_anti")
    except Exception as error:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(error):
            raise
    waiting = kept(outbox)
    found = waiting.count()
    if found:
        send(waiting.orderBy("written_at"))
        waiting.select("id").write.mode("append").parquet(sent_path)
    return found
