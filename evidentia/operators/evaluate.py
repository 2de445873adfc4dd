"""Retrieval evaluation: recall, coverage, nDCG, reciprocal rank, paired tests, weights."""

from __future__ import annotations

from functools import reduce
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType


def summary(results: DataFrame, ks: tuple[int, ...] = (5, 10)) -> DataFrame:
    """By type and overall, for results(query_id, type, relevant, found, first_rank, tokens)."""
    at = [F.avg((F.coalesce("first_rank", F.lit(1 << 30)) <= k).cast("double")).alias(f"recall_any_{k}") for k in ks]
    rows = results.groupingSets([[F.col("type")], []], F.col("type")).agg(
        F.count(F.lit(1)).alias("questions"),
        F.avg((F.col("found") == F.col("relevant")).cast("double")).alias("question_recall"),
        (F.sum("found") / F.sum("relevant")).alias("turn_coverage"),
        F.median("tokens").alias("median_tokens"),
        *at,
    )
    return rows.withColumn("type", F.coalesce("type", F.lit("all")))


def ndcg(ranked: DataFrame, judged: DataFrame, k: int = 10) -> DataFrame:
    """query_id, ndcg for ranked(query_id, doc, place) and judged(query_id, doc, gain)."""
    discount = lambda p: F.log2(p + 1.0)
    got = ranked.filter(F.col("place") <= k).join(judged, ["query_id", "doc"]).groupBy("query_id").agg(F.sum(F.col("gain") / discount(F.col("place"))).alias("dcg"))
    order = Window.partitionBy("query_id").orderBy(F.desc("gain"))
    best = judged.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k).groupBy("query_id").agg(F.sum(F.col("gain") / discount(F.col("n"))).alias("ideal"))
    return best.join(got, "query_id", "left").select("query_id", F.when(F.col("ideal") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("ideal")).otherwise(0.0).alias("ndcg"))


def recall_at(ranked: DataFrame, judged: DataFrame, k: int = 100) -> DataFrame:
    """query_id, recall: the share of a question's relevant docs (gain above 0) among the first k; questions without any leave."""
    relevant = judged.filter("gain > 0").select("query_id", "doc").distinct()
    first = ranked.filter(F.col("place") <= k).select("query_id", "doc").distinct().withColumn("_hit", F.lit(1))
    met = relevant.join(first, ["query_id", "doc"], "left")
    return met.groupBy("query_id").agg((F.count("_hit") / F.count(F.lit(1))).alias("recall"))


def first_hits(ranked: DataFrame, relevant: DataFrame) -> DataFrame:
    """query_id, first_rank, reciprocal for ranked(query_id, doc, place) and relevant(query_id, doc)."""
    hit = ranked.join(relevant, ["query_id", "doc"], "left_semi").groupBy("query_id").agg(F.min("place").alias("first_rank"))
    return relevant.select("query_id").distinct().join(hit, "query_id", "left").withColumn("reciprocal", F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0)))


def pool_ceiling(ranked: DataFrame, relevant: DataFrame, sizes: tuple[int, ...]) -> DataFrame:
    """Share of questions with a relevant row among the first n, for each n."""
    first = first_hits(ranked, relevant)
    cols = [F.struct(F.lit(n).alias("pool"), F.avg(F.coalesce(F.col("first_rank") <= n, F.lit(False)).cast("double")).alias("ceiling")) for n in sizes]
    return first.agg(F.array(*cols).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def mcnemar(left: DataFrame, right: DataFrame) -> float:
    """Exact two-sided p of two systems' results(query_id, ok); only two counts reach the driver."""
    j = left.select("query_id", F.col("ok").alias("a")).join(right.select("query_id", F.col("ok").alias("b")), "query_id")
    b, c = j.agg(F.count_if(F.col("a") & ~F.col("b")), F.count_if(~F.col("a") & F.col("b"))).first()
    n, k = b + c, min(b, c)
    return 1.0 if n == 0 else min(1.0, 2 * sum(comb(n, i) for i in range(k + 1)) / 2**n)


def stratified_sample(rows: DataFrame, by: str, n: int, key: str = "query_id") -> DataFrame:
    """The n rows of smallest hash of each stratum: the same at every run."""
    order = Window.partitionBy(by).orderBy(F.sha2(F.col(key).cast("string"), 256))
    return rows.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= n).drop("_n")


def half(key: str = "query_id"):
    """0 or 1 by hash."""
    return F.conv(F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 2), 16, 10).cast("int") % 2


def fit_weights(features: DataFrame, names: list[str], *, steps: int = 400, rate: float = 0.5, decay: float = 1e-4) -> dict[str, float]:
    """Pairwise logistic weights from features(query_id, relevant, names…).

    Each step sums gradients over all pairs of a question in Spark-side groups; pairs are formed inside
    a question's own pool only.
    """

    def pairs(frame):
        x, y = frame[names].to_numpy(float), frame["relevant"].to_numpy(bool)
        d = (x[y][:, None] - x[~y][None]).reshape(-1, len(names))
        import pandas as pd

        return pd.DataFrame(d, columns=names)

    diffs = features.groupBy("query_id").applyInPandas(pairs, ", ".join(f"{n} double" for n in names)).cache()
    total = max(diffs.count(), 1)
    w = np.zeros(len(names))
    score = lambda w: reduce(lambda a, b: a + b, [F.lit(float(v)) * F.col(n) for v, n in zip(w, names, strict=True)])
    for _ in range(steps):
        pull = 1 / (1 + F.exp(score(w)))
        grad = np.array(diffs.agg(*[F.sum(pull * F.col(n)) for n in names]).first(), dtype=float)
        w = w + rate * (np.nan_to_num(grad) / total - decay * w)
    diffs.unpersist()
    return dict(zip(names, w.tolist(), strict=True))


#: Seeds and cues of one question that meet in a group, on average.
SEEDS, CUES = 8192, 1024


def cue_coverage(cues: DataFrame, seeds: DataFrame) -> DataFrame:
    """query_id, coverage: mean over cues(query_id, cue_id, v) of the best cosine with one of the question's seeds(query_id, v).

    A question without seeds has coverage 0. Seeds of a question are dealt into slots and its cues into chunks, equal rows once; each slot meets
    each chunk as a product of matrices, and only a cue's best of each slot leaves it.
    """
    count = lambda rows, most, name: rows.groupBy("query_id").agg(F.ceil(F.count(F.lit(1)) / most).alias(name))
    slots, chunks = count(seeds, SEEDS, "_slots"), count(cues, CUES, "_chunks")
    dealt = lambda n, *by: F.pmod(F.xxhash64(*by), n)
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    given = seeds.select("query_id", "v").distinct().join(chunks, "query_id").join(slots, "query_id")
    # new names: cues and seeds may be of one table
    given = given.select(F.col("query_id").alias("_query"), dealt(F.col("_slots"), "v").alias("_at"), F.col("v").alias("_v"), each(F.col("_chunks")).alias("_part"))
    one = lambda name: F.coalesce(name, F.lit(1).cast("long"))
    asked = cues.select("query_id", "cue_id", "v").distinct().join(chunks, "query_id", "left").join(slots, "query_id", "left")
    asked = asked.select("query_id", "cue_id", "v", dealt(one("_chunks"), "cue_id", "v").alias("_chunk"), each(one("_slots")).alias("_slot"))
    found = StructType([StructField(c, cues.schema[c].dataType) for c in ("query_id", "cue_id")] + [StructField("best", DoubleType())])
    near = given.groupBy("_query", "_at", "_part").cogroup(asked.groupBy("query_id", "_slot", "_chunk")).applyInArrow(_nearest, found).groupBy("query_id", "cue_id").agg(F.max("best").alias("best"))
    return near.groupBy("query_id").agg(F.avg(F.coalesce("best", F.lit(0.0))).alias("coverage"))


def _units(v: pa.Array) -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    """Lengths of vectors, -1 for none and for those with a null; their norms; and by length, their unit vectors."""
    lengths = pc.list_value_length(v).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    holes = pc.list_parent_indices(v).filter(pc.is_null(pc.list_flatten(v)))
    lengths[holes.to_numpy(zero_copy_only=False)] = -1
    norms, units = np.full(len(lengths), np.nan), {}
    for n in np.unique(lengths[lengths >= 0]).tolist():
        rows = np.flatnonzero(lengths == n)
        m = v.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), n)
        norms[rows] = np.sqrt((m * m).sum(axis=1))
        with np.errstate(invalid="ignore"):
            units[n] = m / np.where(norms[rows] == 0, 1, norms[rows])[:, None]
    return lengths, norms, units


def _nearest(given: pa.Table, asked: pa.Table) -> pa.Table:
    """query_id, cue_id, best: as cosine() has it; none where no seed compares."""
    column = lambda t, name: pa.concat_arrays(t.column(name).chunks) if t.num_rows else pa.array([], pa.list_(pa.float64()))
    (seed_n, seed_norm, seed), (cue_n, cue_norm, cue) = _units(column(given, "_v")), _units(column(asked, "v"))
    best = np.full(len(cue_n), -np.inf)
    for n, unit in cue.items():
        rows = np.flatnonzero(cue_n == n)
        if n in seed:
            with np.errstate(invalid="ignore"):
                best[rows] = np.concatenate([(unit[i : i + 256] @ seed[n].T).max(axis=1) for i in range(0, len(rows), 256)])
        # of unlike lengths, a norm of 0 makes the cosine 0
        other, size = seed_norm[(seed_n != n) & (seed_n >= 0)], cue_norm[rows]
        zero = (size == 0) & np.isfinite(other).any() | np.isfinite(size) & (other == 0).any()
        best[rows[zero]] = np.maximum(best[rows[zero]], 0.0)
    if len(seed_n):
        nothing = (cue_n < 0) | (seed_n < 0).any()
        best[nothing] = np.maximum(best[nothing], 0.0)
    return pa.table({"query_id": asked.column("query_id"), "cue_id": asked.column("cue_id"), "best": pa.array(best, mask=np.isneginf(best))})


def threshold_sweep(results: DataFrame, thresholds: list[float]) -> DataFrame:
    """threshold, vague_hit5, exact_hit5, control_false for results(style, expected, coverage, hit5, answered).

    expected: the question has an answer. Below the threshold a question counts as unanswered; each row
    meets the thresholds in place, and a group without rows has rate 0.
    """
    rows = results.withColumn("threshold", F.explode(F.array(*[F.lit(float(x)) for x in thresholds])))
    passed = F.col("coverage") >= F.col("threshold")
    rate = lambda group, test: F.coalesce(F.avg(F.when(group, (passed & test).cast("double"))), F.lit(0.0))
    styled = lambda s: F.col("expected") & (F.col("style") == s)
    return rows.groupBy("threshold").agg(
        rate(styled("VAGUE"), F.col("hit5")).alias("vague_hit5"), rate(styled("EXACT"), F.col("hit5")).alias("exact_hit5"), rate(~F.col("expected"), F.col("answered")).alias("control_false")
    )


def separation(results: DataFrame) -> DataFrame:
    """Least, largest and mean coverage of vague, exact and control questions."""
    group = F.when(~F.col("expected"), "control").otherwise(F.lower("style")).alias("style")
    return results.groupBy(group).agg(F.round(F.min("coverage"), 4).alias("least"), F.round(F.max("coverage"), 4).alias("most"), F.round(F.avg("coverage"), 4).alias("mean"))


def index_quality(expected: DataFrame, returned: DataFrame) -> DataFrame:
    """entity_key, expected, returned, recall, precision for both tables (entity_key, memory_id)."""
    both = expected.select("entity_key", "memory_id", F.lit(1).alias("e")).distinct().join(returned.select("entity_key", "memory_id", F.lit(1).alias("r")).distinct(), ["entity_key", "memory_id"], "full_outer")
    out = both.groupBy("entity_key").agg(F.count("e").alias("expected"), F.count("r").alias("returned"), F.count(F.col("e") + F.col("r")).alias("hit")).filter("expected > 0")
    return out.select("entity_key", "expected", "returned", (F.col("hit") / F.col("expected")).alias("recall"), (F.col("hit") / F.greatest("returned", F.lit(1))).alias("precision"))
