"""Meaning search: exact cosine top-k, best piece of a turn, and the vector cache."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, IntegralType

from evidentia.functions.text import sentences_at
from evidentia.sources.generations import Generations
from evidentia.sources.scratch import kept


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, 0 if one is zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0))


def normalised(a: Column) -> Column:
    norm = F.sqrt(dot(a, a))
    return F.when(norm > 0, F.transform(a, lambda x: x / norm)).otherwise(a)


def hashing_embedder(dims: int = 64):
    """A deterministic stand-in for a model: words hashed to signed dimensions and counted, so cosines are exact in SQL too."""

    @F.pandas_udf(ArrayType(FloatType()))
    def embed(texts: pd.Series) -> pd.Series:
        out, known = [], {}
        for text in texts:
            v = np.zeros(dims, dtype=np.float32)
            for word in re.split("[ \t\n\x0b\f\r]+", (text or "").lower()):
                if not word:
                    continue
                if (at := known.get(word)) is None:
                    h = hashlib.md5(word.encode("utf-8", "replace"), usedforsecurity=False).hexdigest()
                    at = known[word] = int(h[:6], 16) % dims, 1.0 if h[6] >= "8" else -1.0
                v[at[0]] += at[1]
            out.append(v.tolist())
        return pd.Series(out)

    return embed


def top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, similarity, place: exact cosine of vectors(vec_id, embedding) for queries(query_id, embedding).

    Blocks of vectors meet blocks of questions by a keyed join and leave their k best; a window picks the k best of those. Rows without a
    vector, or with one of another length than the question's, are not found. Ties go to the lower vec_id (as a text, if it is one).
    """
    whole = isinstance(vectors.schema["vec_id"].dataType, IntegralType)
    rows = vectors.select(F.col("vec_id").alias("turn_id"), (F.col("vec_id") if whole else F.lit(0)).alias("revision"), F.lit(0).alias("start"), "embedding")
    return best_groups(rows, queries, k).select("query_id", F.col("turn_id").alias("vec_id"), "similarity", "place")


def best_groups(vectors: DataFrame, queries: DataFrame, k: int | None = None) -> DataFrame:
    """query_id, turn_id, revision, start, similarity: the best piece of each turn, exactly; with k, of the k best turns, and place.

    vectors(turn_id, revision, start, embedding) are scanned like those of top_k: a turn among the k best of all
    is among those of the task that holds its best piece. Similarities are rounded to nine places; ties
    go to the lower revision, then start, then turn as text. Without k the rows are questions times turns, and leave as they are found.
    """
    from evidentia.operators.recall_index import best_pieces, similar_blocks, vector_blocks

    kinds = {c: vectors.schema[c].dataType for c in ("turn_id", "revision", "start")}
    if k is None:
        hits = best_pieces(vectors.select(*kinds, "embedding"), queries)
        return hits.select("query_id", *[F.col(c).cast(kind).alias(c) for c, kind in kinds.items()], "similarity")
    hits = similar_blocks(vector_blocks(vectors.select(*kinds, "embedding")), queries, limit=k, roles=False)
    return hits.select("query_id", *[F.col(c).cast(kind).alias(c) for c, kind in kinds.items()], "similarity", "place")


def best_piece(hits: DataFrame) -> DataFrame:
    """Of hits(query_id, turn_id, revision, start, similarity): the best piece of each turn."""
    order = Window.partitionBy("query_id", "turn_id").orderBy(F.desc("similarity"), "revision", "start")
    return hits.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def missing(pieces: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """Pieces whose key the cache(key, embedding) lacks, with the key."""
    keyed = pieces.withColumn("key", F.sha2(F.concat(F.lit(model + "‖"), F.col("piece")), 256))
    return keyed.join(cache, "key", "left_anti").dropDuplicates(["key"])


def warm(pieces: DataFrame, cache_path: str, embed, model: str) -> None:
    """Embed the pieces that are missing and append them to the Parquet cache."""
    spark = pieces.sparkSession
    cache = spark.read.schema("key string, embedding array<float>").parquet(cache_path)
    missing(pieces, cache, model).select("key", embed("piece").alias("embedding")).write.mode("append").parquet(cache_path)


#: Fixed values of a cache's check: texts embedded again, the fewest that say anything, and the least cosine.
SAMPLE, FEWEST, LEAST_COSINE = 16, 4, 0.9


def sampled(pieces: DataFrame, cache: DataFrame, model: str, sample: int = SAMPLE) -> DataFrame:
    """key, piece, cached: of the pieces whose vector is cached, those with the smallest seeded hashes of their key; at most `sample` rows."""
    keyed = pieces.select("piece", F.sha2(F.concat(F.lit(model + "‖"), F.col("piece")), 256).alias("key")).dropDuplicates(["key"])
    return keyed.join(cache.select("key", F.col("embedding").alias("cached")), "key").orderBy(F.xxhash64("key", F.lit("sample")), "key").limit(sample)


def wrong_in_cache(pieces: DataFrame, cache: DataFrame, embed, model: str, sample: int = SAMPLE) -> DataFrame:
    """key, cosine, nearest, wrong: a sample of cached vectors beside vectors made anew.

    A vector is right if its cosine with the new one of its text is at least 0.9 (a NaN is not) and no other sampled vector is
    nearer to that. The second test finds vectors dealt to other texts where a model puts all texts close together.
    """
    picked = kept(sampled(pieces, cache, model, sample).withColumn("fresh", embed("piece")))
    pairs = picked.select("key", F.col("fresh").alias("embedding"))
    number = picked.select("key", F.col("cached").alias("embedding"))
    nearest = top_k(number.withColumnRenamed("key", "vec_id").filter(~F.exists("embedding", F.isnan)), pairs.withColumnRenamed("key", "query_id"), 1)
    own = picked.select("key", cosine(F.col("fresh"), F.col("cached")).alias("cosine"))
    out = own.join(nearest.select(F.col("query_id").alias("key"), F.col("vec_id").alias("nearest")), "key", "left")
    right = F.coalesce((F.col("cosine") >= LEAST_COSINE) & ~F.isnan("cosine") & (F.col("nearest") == F.col("key")), F.lit(False))
    return out.withColumn("wrong", ~right)


def cache_is_wrong(pieces: DataFrame, cache: DataFrame, embed, model: str, sample: int = SAMPLE) -> bool:
    """Whether more than half of the sample is wrong; a sample of fewer than four says nothing."""
    row = wrong_in_cache(pieces, cache, embed, model, sample).agg(F.count(F.lit(1)).alias("n"), F.count_if("wrong").alias("wrong")).first()
    return row.n >= FEWEST and row.wrong > row.n // 2


class VectorCache:
    """Vectors by key below a folder, in generations: appended, verified, and cleared as a whole behind one pointer."""

    SHAPE = "key string, embedding array<float>"

    def __init__(self, spark, path: str, embed, model: str):
        self.spark, self.embed, self.model, self.store = spark, embed, model, Generations(spark, path)

    @property
    def generation(self) -> int:
        return self.store.state()["generation"]

    def read(self) -> DataFrame:
        return self.store.read(self.store.state()["segments"], "vectors", self.SHAPE)

    def warm(self, pieces: DataFrame) -> int:
        """Embed the pieces(piece) that are missing and append them; how many there were."""
        state = self.store.state()
        new = kept(missing(pieces, self.read(), self.model).select("key", self.embed("piece").alias("embedding")))
        found = new.count()
        if found:
            name = self.store.segment()
            self.store.write(new, name, "vectors")
            self.store.commit(state, segments=[*state["segments"], name])
        return found

    def merge(self) -> None:
        """One segment of all; of a key that two writers appended, one vector."""
        state = self.store.state()
        name = self.store.segment()
        self.store.write(self.read().dropDuplicates(["key"]), name, "vectors")
        self.store.commit(state, segments=[name])

    def clear(self) -> None:
        state = self.store.state()
        self.store.commit(state, generation=state["generation"] + 1, segments=[])

    def verify(self, pieces: DataFrame, sample: int = SAMPLE) -> bool:
        """Clear the cache if it is wrong, and say whether it was."""
        wrong = cache_is_wrong(pieces, self.read(), self.embed, self.model, sample)
        if wrong:
            self.clear()
        return wrong


# ---- sentences ---------------------------------------------------------------------------------

#: Characters before a sentence that are shown with it, and of the stretch in all.
BEFORE, SHOWN = 150, 500


def sentence_rows(turns: DataFrame, embed) -> DataFrame:
    """turns' columns but content, with start and embedding of every sentence: a finer level than pieces."""
    cut = turns.withColumn("_s", F.explode(sentences_at("content")))
    return cut.select(*[c for c in turns.columns if c != "content"], F.col("_s.start").alias("start"), embed(F.col("_s.sentence")).alias("embedding"))


def best_sentences(turns: DataFrame, queries: DataFrame, embed, k: int = 100) -> DataFrame:
    """query_id, turn_id, place, similarity, start, text: turns by their best sentence, shown from 150 characters before it.

    turns(turn_id, revision, content); of equal sentences the lower revision, then the earlier.
    """
    rows = sentence_rows(turns.select("turn_id", "revision", "content"), embed)
    hits = best_groups(rows, queries, k).join(turns.select("turn_id", "content"), "turn_id")
    start = F.greatest(F.lit(0), F.col("start") - BEFORE)
    return hits.select("query_id", "turn_id", "place", "similarity", start.alias("start"), F.substring(F.col("content"), start + 1, F.lit(SHOWN)).alias("text"))
