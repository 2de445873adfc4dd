"""Temporal state: latest observations, certified intervals, freshness."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidentia.sources.scratch import kept


def latest_observation(observations: DataFrame, queries: DataFrame, keys: list[str], *, max_age_seconds: float | None = None) -> DataFrame:
    """As-of join: the last observation(keys, observed_at, value) at or before each query(query_id, keys, as_of).

    Both sides are put in one sequence by time, and the last value is carried on to the queries, so no
    query meets more than its own place in the sequence. Different values at one time conflict.
    """
    once = observations.groupBy(*keys, "observed_at").agg(F.min("value").alias("value"), F.countDistinct("value").alias("n"))
    o = once.select(*keys, F.col("observed_at").alias("at"), F.lit(0).alias("kind"), F.struct("observed_at", "value", "n").alias("seen"), F.lit(None).cast(queries.schema["query_id"].dataType).alias("query_id"))
    q = queries.select(*keys, F.col("as_of").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(o.schema["seen"].dataType).alias("seen"), "query_id")
    order = Window.partitionBy(*keys).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    rows = o.unionByName(q).withColumn("last", F.last("seen", ignorenulls=True).over(order)).filter("kind = 1")
    age = (F.unix_micros(F.col("at").cast("timestamp")) - F.unix_micros(F.col("last.observed_at").cast("timestamp"))) / 1e6
    fresh = F.lit("UNSPECIFIED") if max_age_seconds is None else F.when(age <= max_age_seconds, "FRESH").otherwise("STALE")
    status = F.when(F.col("last").isNull() | (F.col("last.n") > 1), "UNKNOWN").otherwise("OBSERVED")
    reason = F.when(F.col("last").isNull(), "NO_OBSERVATION_AS_OF").when(F.col("last.n") > 1, "CONFLICTING_OBSERVATIONS")
    known = F.col("status") == "OBSERVED"
    out = rows.select("query_id", *keys, status.alias("status"), reason.alias("reason"), F.col("last.value").alias("value"), F.col("last.observed_at").alias("observed_at"), age.alias("age_seconds"), fresh.alias("freshness"))
    return out.withColumns({c: F.when(known, F.col(c)) for c in ("value", "observed_at", "age_seconds", "freshness")})


def intervals(changes: DataFrame, keys: list[str], at: str = "observed_at") -> DataFrame:
    """valid_from, valid_to of each change: until the next one of the key."""
    return changes.withColumn("valid_from", F.col(at)).withColumn("valid_to", F.lead(at).over(Window.partitionBy(*keys).orderBy(at, "evidence_id")))


def _islands(records: DataFrame, keys: list[str]) -> DataFrame:
    """keys, value, valid_from, valid_to: records of one value that overlap or touch are one; empty ones leave."""
    rows = records.filter("valid_to IS NULL OR valid_from < valid_to")
    for key in keys:
        rows = rows.filter(F.col(key).isNotNull())
    before = Window.partitionBy(*keys, "value").orderBy("valid_from").rowsBetween(Window.unboundedPreceding, -1)
    open_before = F.coalesce(F.bool_or(F.col("valid_to").isNull()).over(before), F.lit(False))
    starts = F.when(open_before | (F.max("valid_to").over(before) >= F.col("valid_from")), 0).otherwise(1)
    upto = Window.partitionBy(*keys, "value").orderBy("valid_from").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_s", starts).withColumn("_i", F.sum("_s").over(upto))
    ended = F.when(F.bool_or(F.col("valid_to").isNull()), F.lit(None)).otherwise(F.max("valid_to"))
    return rows.groupBy(*keys, "value", "_i").agg(F.min("valid_from").alias("valid_from"), ended.alias("valid_to")).drop("_i")


def state_as_of(records: DataFrame, queries: DataFrame, keys: list[str]) -> DataFrame:
    """The value of the records(keys, valid_from, valid_to, value) that hold at as_of: start included, end not.

    A sweep: each key's starts, ends and questions are put into one sequence by time, and running sums say at a question
    how many values hold and, where it is one, which. No record, or several values, is UNKNOWN.
    """
    held = kept(_islands(records, keys))
    numbered = held.select(*keys, "value").distinct().withColumn("_id", F.row_number().over(Window.partitionBy(*keys).orderBy("value")))
    rows = kept(held.join(numbered, [*keys, "value"]))
    kind = queries.schema["query_id"].dataType
    event = lambda at, sign: rows.filter(F.col(at).isNotNull()).select(*keys, F.col(at).alias("_at"), F.lit(0).alias("_asks"), F.lit(sign).alias("_n"), (sign * F.col("_id")).cast("long").alias("_sum"), F.lit(None).cast(kind).alias("query_id"))
    asked = queries.select(*keys, F.col("as_of").alias("_at"), F.lit(1).alias("_asks"), F.lit(0).alias("_n"), F.lit(0).cast("long").alias("_sum"), "query_id")
    upto = Window.partitionBy(*keys).orderBy("_at", "_asks").rowsBetween(Window.unboundedPreceding, 0)
    line = event("valid_from", 1).unionByName(event("valid_to", -1)).unionByName(asked)
    found = line.withColumns({"_held": F.sum("_n").over(upto), "_which": F.sum("_sum").over(upto)}).filter("_asks = 1")
    found = found.join(numbered.select(*keys, F.col("_id").alias("_which"), F.lit(1).cast("long").alias("_held"), "value"), [*keys, "_which", "_held"], "left")
    ok = F.col("_held") == 1
    reason = F.when(F.col("_held") == 0, "NO_CERTIFIED_VALID_STATE").when(F.col("_held") > 1, "CONFLICTING_VALID_STATES")
    return found.select("query_id", *keys, F.when(ok, "ANSWER").otherwise("UNKNOWN").alias("status"), reason.alias("reason"), F.when(ok, F.col("value")).alias("value"))


def contradicted(answers: DataFrame, observations: DataFrame, records: DataFrame, keys: list[str]) -> DataFrame:
    """Answers vetoed by an observation of another value inside the interval that gave them."""
    span = records.select(*keys, "valid_from", "valid_to", "value")
    bad = observations.select(*keys, "observed_at", F.col("value").alias("_seen")).join(span, keys).filter((F.col("valid_from") <= F.col("observed_at")) & (F.col("valid_to").isNull() | (F.col("observed_at") < F.col("valid_to"))) & (F.col("_seen") != F.col("value")))
    veto = bad.select(*keys, "value").distinct().withColumn("_veto", F.lit(True))
    j = answers.join(veto, [*keys, "value"], "left")
    return j.withColumn("status", F.when(F.col("_veto"), "UNKNOWN").otherwise(F.col("status"))).withColumn("reason", F.when(F.col("_veto"), "OBSERVATION_CONTRADICTS_VALID_STATE").otherwise(F.col("reason"))).drop("_veto")
