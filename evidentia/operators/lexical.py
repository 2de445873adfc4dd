"""Word search for a batch of questions: BM25 over prefix terms, and scoring by stems."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions.text import stem
from evidentia.operators.recall_index import held_blocks, search_blocks, word_blocks

def search(turns: DataFrame, queries: DataFrame, *, limit: int = 100) -> DataFrame:
    """query_id, turn_id, score, place: the best turns of each question, smaller scores first.

    turns(turn_id, content, and optionally session_id, scope, role, happened_at, revision) are put into blocks of
    postings once, which are scored as those of a stored index are (recall_index). Frequencies count all words with an asked
    prefix. Conditions of queries (scopes, since, until) apply after scoring and before the limit. turn_id is a text.
    """
    return search_blocks(held_blocks(word_blocks(turns)), queries, limit=limit)


#: Words without weight in the stemmed scoring.
FUNCTION_WORDS = (
    "a an the i my me you your to of in on for and or is was were did do does have has had "
    "what how many much when which who where with at by from that this it be am are"
).split()


def stemmed_tokens(text: Column) -> Column:
    words = F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0), lambda w: ~w.isin(FUNCTION_WORDS))
    return F.transform(words, stem)


def stemmed_scores(docs: DataFrame, queries: DataFrame, *, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """query_id, doc_id, score of docs(doc_id, text) that share a stem with queries(query_id, query); idf is ln(1 + (n - df + 0.5) / (df + 0.5)).

    Sizes and frequencies are of all docs; only the terms asked for meet postings.
    """
    words = docs.select("doc_id", stemmed_tokens(F.col("text")).alias("w"))
    sizes = words.select("doc_id", F.size("w").alias("size"))
    whole = sizes.agg(F.count(F.lit(1)).alias("n_docs"), F.greatest(F.avg("size"), F.lit(1e-9)).alias("mean"))
    asked = queries.select("query_id", F.explode(F.array_distinct(stemmed_tokens(F.col("query")))).alias("term"))
    post = words.select("doc_id", F.size("w").alias("size"), F.explode("w").alias("term")).groupBy("term", "doc_id", "size").agg(F.count(F.lit(1)).alias("tf"))
    df = post.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    hit = asked.join(post, "term").join(df, "term").join(F.broadcast(whole))  # one row of totals
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("size") / F.col("mean")))
    return hit.groupBy("query_id", "doc_id").agg(F.sum(part).alias("score"))
