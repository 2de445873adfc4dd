"""Rank fusion, the learned linear re-ranker, episode caps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions.text import STOP_WORDS, bag, query_terms
from evidentia.sources.scratch import kept

CONSTANT = 60
#: Learned weights.
WEIGHTS = {"meaning": 1.637, "words": 0.816, "similarity": 0.536, "both": -0.225, "overlap": 1.016, "rare_overlap": 1.092, "prefix_overlap": 1.171, "session_hits": 0.515, "session_best": 0.76}


def fuse(lists: DataFrame, limit: int) -> DataFrame:
    """Reciprocal rank fusion of lists(query_id, list_no, turn_id, rank from 0); ties keep the order first seen."""
    fused = lists.groupBy("query_id", "turn_id").agg(F.sum(1 / (CONSTANT + F.col("rank"))).alias("score"), F.min(F.struct("list_no", "rank")).alias("seen"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "seen.list_no", "seen.rank")
    return fused.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit).drop("seen")


def features(queries: DataFrame, meaning: DataFrame, words: DataFrame, turns: DataFrame) -> DataFrame:
    """The re-ranker's features for the pool of both lists.

    queries(query_id, query); meaning(query_id, turn_id, rank, similarity); words(query_id, turn_id,
    rank); turns(turn_id, session_id, content). All statistics are those of a question's pool. Asked words meet the
    words of the pool's own turns by turn and first two characters, so no turn is searched word by word.
    """
    m = meaning.select("query_id", "turn_id", F.col("rank").alias("m_rank"), "similarity")
    w = words.select("query_id", "turn_id", F.col("rank").alias("w_rank"))
    both = kept(m.join(w, ["query_id", "turn_id"], "full_outer"))
    ids = both.select("turn_id").distinct()
    held = kept(turns.join(ids, "turn_id", "left_semi").select("turn_id", "session_id", bag(F.col("content")).alias("bag")))
    head = F.substring("term", 1, 2).alias("head")
    said = held.select("turn_id", F.explode("bag").alias("term")).select("turn_id", F.col("term").alias("word"), head)
    asked = kept(queries.select("query_id", F.explode(F.filter(query_terms(F.col("query")), lambda t: ~t.isin(STOP_WORDS))).alias("term")))
    pool = both.join(held.select("turn_id", "session_id"), "turn_id")
    wanted = pool.select("query_id", "turn_id").join(asked, "query_id").select("query_id", "turn_id", "term", head)
    met = wanted.join(said, ["turn_id", "head"]).filter(F.col("word").startswith(F.col("term"))).groupBy("query_id", "turn_id", "term").agg(F.max(F.col("word") == F.col("term")).alias("exact"))
    met = kept(met.withColumn("found", F.col("exact") | F.col("term").rlike(r"[^\x00-\x7F]")))
    sizes = pool.groupBy("query_id").agg(F.count(F.lit(1)).alias("pool"))
    df = met.filter("found").groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("df"))
    rare = asked.join(sizes, "query_id").join(df, ["query_id", "term"], "left").withColumn("rare", F.log((F.col("pool") + 1) / (F.coalesce("df", F.lit(0)) + 0.5))).select("query_id", "term", "rare")
    whole = rare.groupBy("query_id").agg(F.count(F.lit(1)).alias("asked"), F.sum("rare").alias("total"))
    found = F.when(F.col("found"), F.lit(1))
    own = met.join(rare, ["query_id", "term"]).groupBy("query_id", "turn_id").agg(F.count(found).alias("n_found"), F.count(F.lit(1)).alias("n_prefix"), F.sum(F.when(F.col("found"), F.col("rare"))).alias("found_rare"))
    rows = pool.join(own, ["query_id", "turn_id"], "left").join(whole, "query_id", "left")
    share = F.greatest(F.coalesce("asked", F.lit(0)), F.lit(1))
    count = lambda c: F.coalesce(c, F.lit(0))
    per_session = Window.partitionBy("query_id", "session_id")
    return rows.select(
        "query_id",
        "turn_id",
        "m_rank",
        "w_rank",
        F.coalesce(CONSTANT / (CONSTANT + F.col("m_rank")), F.lit(0.0)).alias("meaning"),
        F.coalesce(CONSTANT / (CONSTANT + F.col("w_rank")), F.lit(0.0)).alias("words"),
        F.coalesce("similarity", F.lit(0.0)).alias("similarity"),
        (F.col("m_rank").isNotNull() & F.col("w_rank").isNotNull()).cast("double").alias("both"),
        (count("n_found") / share).alias("overlap"),
        (F.coalesce("found_rare", F.lit(0.0)) / F.when(F.coalesce("total", F.lit(0.0)) == 0, 1.0).otherwise(F.col("total"))).alias("rare_overlap"),
        (count("n_prefix") / share).alias("prefix_overlap"),
        F.log(F.count(F.lit(1)).over(per_session).cast("double")).alias("session_hits"),
        F.max(F.coalesce("similarity", F.lit(0.0))).over(per_session).alias("session_best"),
    )


def rerank(feature_rows: DataFrame, limit: int, weights: dict[str, float] | None = None) -> DataFrame:
    """Order each question's pool by the weighted sum of features; ties keep meaning hits first, by rank."""
    weights = WEIGHTS if weights is None else weights
    score = sum((F.lit(w) * F.col(name) for name, w in weights.items()), F.lit(0.0))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), F.col("m_rank").asc_nulls_last(), F.col("w_rank").asc_nulls_last(), "turn_id")
    return feature_rows.withColumn("score", score).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)


def episode_lift(scored: DataFrame, top: int = 2, cap: int | None = None) -> DataFrame:
    """Adds the sum of the best `top` scores of each episode; with cap, keeps that many rows of an episode."""
    order = Window.partitionBy("query_id", "episode").orderBy(F.desc("score"), "turn_id")
    ranked = scored.withColumn("_n", F.row_number().over(order))
    lift = F.sum(F.when(F.col("_n") <= top, F.col("score"))).over(Window.partitionBy("query_id", "episode"))
    ranked = ranked.withColumn("lift", lift)
    return (ranked if cap is None else ranked.filter(F.col("_n") <= cap)).drop("_n")


def session_ranking(hits: DataFrame) -> DataFrame:
    """Sessions by their best piece, with the adaptive number to keep: at least 16, else 1.5 times the root of all."""
    best = hits.groupBy("query_id", "session_id").agg(F.max("similarity").alias("best"))
    per = Window.partitionBy("query_id")
    keep = F.greatest(F.lit(16), F.ceil(1.5 * F.sqrt(F.count(F.lit(1)).over(per))))
    place = F.row_number().over(per.orderBy(F.desc(F.round("best", 9)), "session_id"))
    return best.withColumn("keep", keep).withColumn("place", place).filter("place <= keep")
