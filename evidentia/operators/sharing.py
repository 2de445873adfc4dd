"""Deletion with tombstones, and merging the logs of several devices."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidentia.sources.scratch import kept


def find(rows: DataFrame, phrase: str) -> DataFrame:
    return rows.filter(F.contains("content", F.lit(phrase)))


def cascade(doomed: DataFrame, promotions: DataFrame) -> DataFrame:
    """Ids to forget: the doomed ones and the memories promoted from them (turn_id, memory_id)."""
    follow = promotions.join(doomed.select(F.col("id").alias("turn_id")), "turn_id", "left_semi").select(F.col("memory_id").alias("id"))
    return doomed.select("id").unionByName(follow).distinct()


def erase(rows: DataFrame, tombstones: DataFrame, key: str) -> DataFrame:
    return rows.join(tombstones.select(F.col("id").alias(key)), key, "left_anti")


def merge_log(lines: DataFrame, tombstones: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(records that land, tombstones) of log lines(kind, id, device, written_at, record).

    Of lines of one id the first written lands; forgets of the batch apply after all of them.
    """
    dead = lines.filter("kind = 'forget'").select("id").distinct()
    if tombstones is not None:
        dead = dead.unionByName(tombstones.select("id")).distinct()
    order = Window.partitionBy("id").orderBy("written_at", "device")
    first = lines.filter("kind <> 'forget'").withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")
    return first.join(dead, "id", "left_anti"), dead


def land_pending(arrived: DataFrame, known_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records whose supersedes target is known or lands itself, and those that wait.

    Targets form chains; a record waits if its chain ends in an unknown id. Missing targets are found
    first and waiting spreads down the chains until nothing changes. Each round starts from a checkpoint of the newly
    waiting ids, so plans don't nest.
    """
    targets = arrived.select("id", "supersedes")
    have = arrived.select("id").unionByName(known_ids.select("id")).distinct()
    new = kept(targets.filter("supersedes IS NOT NULL").join(have.select(F.col("id").alias("supersedes")), "supersedes", "left_anti").select("id"))
    waiting = new
    while not new.isEmpty():
        new = kept(targets.join(new.select(F.col("id").alias("supersedes")), "supersedes", "left_semi").select("id").join(waiting, "id", "left_anti"))
        waiting = kept(waiting.unionByName(new))
    return arrived.join(waiting, "id", "left_anti"), arrived.join(waiting, "id", "left_semi")


def lacking(local: DataFrame, lines: DataFrame) -> DataFrame:
    """Local records that the log has neither as a record nor as a forget."""
    return local.join(lines.select("id").distinct(), "id", "left_anti")


def in_project(rows: DataFrame, root: str) -> DataFrame:
    return rows.filter((F.col("cwd") == root) | F.col("cwd").startswith(root + "/"))


def devices(lines: DataFrame) -> DataFrame:
    return lines.select("device").distinct()


def retry_delay(attempts: str = "attempts"):
    """Seconds until a failed delivery is tried again."""
    return F.least(F.lit(3600.0), 60 * F.pow(F.lit(2.0), F.least(F.col(attempts), F.lit(6))))
