"""Mixing sources to target weights.

Every document gets a pseudo-random key from its id. Within a source the key space is cut into
equal ranges; each range is sorted on its own and a running word count over the ranges gives every
document its place in the source's stream. A source's budget is cut exactly at that place, after
as many whole epochs as the budget holds.

Defined cases: null text has size 0; a null source is a source of its own and comes last; rows that
share an id and a size are interchangeable; a source without words gets target 0; very long
texts are counted whole and cut like others; extra columns are not read by mix and kept by mixed_rows,
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, fresh, materialise

#: Hex digits of the key that name a range: 16**3 ranges a source.
RANGE_DIGITS = 3


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """source, source_size, target: share of all words by weight, at most `most` times a source's words.

    Sources are ordered by code point, null last, and take the weights in turn. Sources at their
    limit pass their excess on by weight: with sources sorted by limit / weight the ones at their
    limit are a prefix, so the level is found from running sums, without iteration.
    """
    w = F.array(*[F.lit(float(x)) for x in weights])
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = totals.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("weight", F.element_at(w, (F.col("place") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("limit", F.lit(float(most)) * F.col("source_size"))
    by_level = Window.orderBy(F.col("limit") / F.col("weight"), "place")
    everything = Window.partitionBy()
    ranked = (
        ranked.withColumn("level", F.col("limit") / F.col("weight"))
        .withColumn("limit_before", F.sum("limit").over(by_level) - F.col("limit"))
        .withColumn("weight_from", F.sum("weight").over(everything) - F.sum("weight").over(by_level) + F.col("weight"))
        .withColumn("all_words", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("tried", (F.col("all_words") - F.col("limit_before")) / F.col("weight_from"))
    )
    # the first source, by level, whose limit is not reached sets the common level of all that follow
    ranked = ranked.withColumn("common", F.min(F.when(F.col("tried") < F.col("level"), F.struct("level", "place", "tried"))).over(everything)["tried"])
    target = F.when(F.col("common").isNull(), F.col("limit")).otherwise(F.least("limit", F.col("common") * F.col("weight")))
    return ranked.select("source", "source_size", F.round(target, 6).alias("target"))


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: str = "mix") -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of docs(doc_id, text, source)."""
    sizes = docs.select(
        "doc_id",
        "source",
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("key"),
    )
    sizes = materialise(sizes, "sizes").withColumn("range", F.substring("key", 1, RANGE_DIGITS))
    targets = materialise(source_targets(sizes, weights, share, most), "targets")
    ranges = sizes.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    upto = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.withColumn("start", F.coalesce(F.sum("range_size").over(upto), F.lit(0)))
    starts = starts.alias("r").join(targets.alias("t"), F.expr("r.source <=> t.source"))
    starts = starts.select("r.source", "range", "start", "source_size", "target")
    within = Window.partitionBy("source", "range").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sizes.withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0)))
    joined = placed.alias("p").join(starts.alias("s"), F.expr("p.source <=> s.source AND p.range = s.range"))
    budget = F.least(F.floor(F.col("target") + 0.5), F.floor(F.lit(float(most)) * F.col("source_size")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(0)
    rest = F.col("budget") - F.col("epochs") * F.col("source_size")
    cut = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("start") - F.col("before")))
    return (
        joined.withColumn("budget", budget)
        .withColumn("epochs", epochs)
        .select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + cut).cast("long").alias("taken"))
    )


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """docs' rows, each as many times as the mix takes it, with docs' columns.

    A document that a cut goes through is taken whole. Rows that share an id appear equally often.
    Documents without words take no part of a budget and leave.
    """
    found = mix(docs, **options)
    own, often, copy = fresh(docs, "_id", "_times", "_copy")
    times = F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(0)
    times = found.groupBy(F.col("doc_id").alias(own)).agg(F.ceil(F.sum(times) / F.count(F.lit(1))).cast("int").alias(often))
    times = materialise(times.filter(F.col(often) > 0), "times").hint("shuffle_hash")
    rows = docs.join(times, docs["doc_id"].eqNullSafe(times[own]))
    return rows.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(often)))).select(*[docs[c] for c in docs.columns])


def op2_mixing(spark, sf_dir):
    from .common import table

    return mix(table(spark, sf_dir, "documents"))


SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS key FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS place FROM totals),
weighed AS (SELECT *, CASE place % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
                   2.0::DOUBLE * source_size AS lim FROM ranked),
tried AS (
  SELECT *, lim / weight AS level,
    (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - (sum(lim) OVER w - lim)) / (sum(weight) OVER () - sum(weight) OVER w + weight) AS tried
  FROM weighed WINDOW w AS (ORDER BY lim / weight, place ROWS UNBOUNDED PRECEDING)),
common AS (SELECT arg_min(tried, level) AS common FROM tried WHERE tried < level),
targets AS (
  SELECT source, source_size,
    round(CASE WHEN (SELECT common FROM common) IS NULL THEN lim ELSE least(lim, (SELECT common FROM common) * weight) END, 6) AS target
  FROM tried),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
    least(floor(t.target + 0.5), floor(2.0 * t.source_size))::BIGINT AS budget,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
cut AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM placed)
SELECT doc_id, size, source_size, target,
  (epochs * size + greatest(0, least(size, budget - epochs * source_size - before)))::BIGINT AS taken
FROM cut
"""
