"""Gather: curated memories and turns for a batch of requests, in all its branches.

A request may name scopes, a time from which and one until which turns count, ask for what is recent, ask about what the
assistant said, or name days around which something happened. Word and meaning search come from an index
(recall_index.RecallIndex, or blocks made for one batch); the rest are joins on request and turn.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions.text import entity_key
from evidentia.operators import blocks as bl
from evidentia.operators import ranking
from evidentia.operators.memories import current
from evidentia.operators.recall_index import RecallIndex, search_blocks, similar_blocks
from evidentia.operators.turns import around_window
from evidentia.sources.scratch import kept

#: Candidates of each list; characters of a piece and of an assistant's answer; turns looked at for a name.
POOL, PIECE, ANSWER, NAMED_TURNS, INSIDE = 100, 500, 3000, 50, 20
#: Scores of an identity in the question, a word in the body, a word beside an identity.
IDENTITY, BODY, BESIDE = 100, 12, 20
MOST_MEMORIES = 50
MEMORY = "block long, ids array<string>, effective array<long>, revisions array<long>, scopes array<string>, bodies array<string>, identities array<array<string>>"


@dataclass
class Blocks:
    """Searches over blocks made for one batch, as RecallIndex has them over stored ones."""

    words: DataFrame
    vectors: DataFrame

    def search(self, queries: DataFrame, limit: int, **options: bool) -> DataFrame:
        return search_blocks(self.words, queries, limit=limit, **options)

    def similar(self, queries: DataFrame, limit: int | None, **options: bool) -> DataFrame:
        return similar_blocks(self.vectors, queries, limit=limit, **options)


# ---- curated memories --------------------------------------------------------------------------


def newest_facts(memories: DataFrame) -> DataFrame:
    """Memories without a fact, and of each (scope, fact) the newest."""
    order = Window.partitionBy("scope", "fact").orderBy(F.desc("effective_at"), F.desc("known_at"), F.desc("memory_id"))
    keyed = memories.filter("fact IS NOT NULL").withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")
    return memories.filter("fact IS NULL").unionByName(keyed)


def _memory_blocks(batches):
    from evidentia.operators.recall_index import _numbered

    numbers, shape = _numbered(), bl.arrow_schema(MEMORY)
    for batch in batches:
        if batch.num_rows:
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip([[next(numbers)], *[[batch.column(i).to_pylist()] for i in range(6)]], shape, strict=True)], schema=shape)


def _parts_of(word: str) -> set[str]:
    return {word[i:j] for i in range(len(word)) for j in range(i + 1, len(word) + 1)}


def _memory_scores(limit: int):
    best = {kind: bl.Best(limit) for kind in ("words", "named", "recent")}

    def take(pair: dict) -> None:
        ids, n = pair["ids"], len(pair["ids"])
        bodies = pa.array(pair["bodies"], pa.string())
        counts = np.array([len(x) for x in pair["identities"]], dtype=np.int64)
        owner = np.repeat(np.arange(n), counts)
        flat = pa.array([x for own in pair["identities"] for x in own], pa.string()).dictionary_encode()
        names, code = flat.dictionary.to_pylist(), flat.indices.to_numpy(zero_copy_only=False)
        number = {name: i for i, name in enumerate(names)}
        texts = flat.dictionary
        inside: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def word(w: str) -> tuple[np.ndarray, np.ndarray]:
            """Memories whose body holds the word; those with an identity that holds it or is held by it."""
            if w not in inside:
                body = pc.match_substring(bodies, w).to_numpy(zero_copy_only=False).astype(bool)
                hit = np.zeros(len(names), dtype=bool)
                if len(names):
                    hit = pc.match_substring(texts, w).to_numpy(zero_copy_only=False).astype(bool)
                    hit[[number[p] for p in _parts_of(w) if p in number]] = True
                beside = np.zeros(n, dtype=bool)
                beside[owner[hit[code]]] = True
                inside[w] = body, beside
            return inside[w]

        scopes, effective = np.array(pair["scopes"], dtype=object), np.array(pair["effective"], dtype=np.int64)
        for i, query in enumerate(pair["q_query_id"]):
            asked = pair["q_asked"][i] or ""
            mask = np.ones(n, dtype=bool)
            if pair["q_scopes"][i]:
                mask &= np.isin(scopes, pair["q_scopes"][i])
            if pair["q_since"][i] is not None:
                mask &= effective >= pair["q_since"][i]
            held = np.array([bool(name) and name in asked for name in names], dtype=bool) if names else np.zeros(0, bool)
            named = np.bincount(owner[held[code]], minlength=n) if len(code) else np.zeros(n, np.int64)
            score = IDENTITY * named
            for w in dict.fromkeys(x for x in asked.split() if len(x) >= 2):
                body, beside = word(w)
                score = score + np.where(body, BODY, np.where(beside, BESIDE, 0))
            row = lambda j: (int(score[j]), ids[j], [x for x in pair["identities"][j] if x and x in asked])
            if pair["q_recent"][i]:
                key = lambda j: (-int(effective[j]), -pair["revisions"][j], *row(j))
                newest = np.lexsort((-np.array(pair["revisions"]), -effective))
                newest = newest[mask[newest]]
                best["recent"].offer(query, [key(j) for j in newest[:limit]])
                best["named"].offer(query, [key(j) for j in newest[named[newest] > 0][:limit]])
            else:
                hits = np.flatnonzero(mask & (score > 0))
                hits = hits[np.lexsort((-np.array(pair["revisions"])[hits], -score[hits]))][:limit]
                best["words"].offer(query, [(-int(score[j]), -pair["revisions"][j], *row(j)) for j in hits])

    return take, lambda: [(q, kind, k[0], k[1], k[2], k[3], k[4]) for kind, held in best.items() for q, keys in held.held.items() for k in keys]


def recall_memories(memories: DataFrame, queries: DataFrame, *, as_of=None, knowledge_cutoff=None, limit: int = 8, meaning: tuple[DataFrame, DataFrame] | None = None, floor: float = 0.2, margin: float = 0.1) -> DataFrame:
    """query_id, memory_id, score, named, place: curated memories for queries(query_id, query, and optionally scopes, since, recent).

    memories(memory_id, scope, effective_at, known_at, revision, title, tags, entities, memory_type, content, fact,
    supersedes): those in effect and known that none supersedes, of a fact the newest. Ranked by score, then revision; where
    recent, the newest of those that the question names, or of all. meaning is (pieces of memories: turn_id, revision, start,
    embedding; query_id, embedding) for questions of which no word matched. The memories are scored in blocks
    against blocks of questions.
    """
    limit = min(limit, MOST_MEMORIES)
    seen = newest_facts(current(memories, as_of=as_of, knowledge_cutoff=knowledge_cutoff))
    plain = lambda c: F.coalesce(entity_key(c), F.lit(""))
    identity = F.transform(F.concat(F.array("title"), F.coalesce("tags", F.array().cast("array<string>")), F.coalesce("entities", F.array().cast("array<string>"))), plain)
    rows = seen.select(F.col("memory_id").cast("string").alias("id"), F.unix_micros(F.col("effective_at").cast("timestamp")).alias("effective"), F.col("revision").cast("long").alias("revision"), F.col("scope").cast("string").alias("scope"), plain(F.concat_ws(" ", "scope", "memory_type", "content")).alias("body"), identity.alias("identity"))
    held = rows.mapInArrow(_memory_blocks, MEMORY)
    optional = lambda c, kind: F.col(c).cast(kind) if c in queries.columns else F.lit(None).cast(kind)
    since = F.unix_micros(optional("since", "timestamp"))
    asked = queries.select("query_id", plain(F.col("query")).alias("asked"), optional("scopes", "array<string>").alias("scopes"), since.alias("since"), F.coalesce(optional("recent", "boolean"), F.lit(False)).alias("recent"))
    questions, n = bl.deal(asked, ["query_id", "asked", "scopes", "since", "recent"])
    kind = queries.schema["query_id"].dataType.simpleString()
    found = kept(bl.each(bl.pairs(held, kept(questions), n), lambda: _memory_scores(limit), f"query_id {kind}, kind string, first long, second long, score long, memory_id string, names array<string>"))
    named = found.filter("kind = 'named'").select("query_id").distinct().withColumn("_named", F.lit(True))
    rows = found.join(named, "query_id", "left").filter("kind = 'words' OR (kind = 'named') OR (kind = 'recent' AND _named IS NULL)")
    order = Window.partitionBy("query_id").orderBy("first", "second", "memory_id")
    out = rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit).select("query_id", "memory_id", "score", "names", "place")
    if meaning is None:
        return out
    from evidentia.operators.vectors import best_groups

    out = kept(out)
    recent = asked.filter("recent").select("query_id")
    silent = meaning[1].join(out, "query_id", "left_anti").join(recent, "query_id", "left_anti")
    close = best_groups(meaning[0].join(rows_ids(seen), "turn_id", "left_semi"), silent, limit).filter(F.col("similarity") >= floor)
    close = close.withColumn("_best", F.max("similarity").over(Window.partitionBy("query_id"))).filter(F.col("similarity") >= F.col("_best") - margin)
    return out.unionByName(close.select("query_id", F.col("turn_id").cast("string").alias("memory_id"), F.lit(0).cast("long").alias("score"), F.array().cast("array<string>").alias("names"), "place"))


def rows_ids(memories: DataFrame) -> DataFrame:
    return memories.select(F.col("memory_id").alias("turn_id"))


# ---- turns -------------------------------------------------------------------------------------

_REQUEST = {"scopes": "array<string>", "since": "timestamp", "until": "timestamp", "recent": "boolean", "about_assistant": "boolean", "around": "string"}


def requests_of(queries: DataFrame) -> DataFrame:
    """queries(query_id, query, embedding) with every column that a request may have; absent says nothing."""
    have = set(queries.columns)
    out = queries.select("query_id", "query", "embedding", *[(F.col(c).cast(k) if c in have else F.lit(None).cast(k)).alias(c) for c, k in _REQUEST.items()])
    window = around_window(F.col("around"))
    out = out.withColumn("span_since", window["since"].cast("timestamp")).withColumn("span_until", window["until"].cast("timestamp"))
    return out.withColumn("recent", F.coalesce("recent", F.lit(False)))


def _ranked(rows: DataFrame, *order: Column) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)) - 1)


def latest_turns(turns: DataFrame, asked: DataFrame, limit: int) -> DataFrame:
    """query_id, turn_id, rank: each request's newest turns under its scopes, since and until (inclusive).

    Turns are dealt, by scope and for requests without scopes, into buckets, and put in one sequence by time with
    the requests' ends; a request takes the last `limit` places before its end in each bucket, and the best of these. No
    bucket holds more than its share of a scope.
    """
    buckets = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    key = lambda scope: F.concat(F.lit("s"), scope)
    ends = asked.select("query_id", "until", F.explode(F.coalesce(F.transform(F.array_distinct("scopes"), key), F.array(F.lit("*")))).alias("key"))
    rows = turns.select("turn_id", "happened_at", "revision", F.explode(F.array(key(F.col("scope")), F.lit("*"))).alias("key")).filter("key IS NOT NULL")
    rows = rows.join(ends.select("key").distinct(), "key", "left_semi").withColumn("bucket", F.pmod(F.xxhash64("turn_id"), F.lit(buckets)).cast("int"))
    ends = ends.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    last = F.to_timestamp(F.lit("9999-12-31"))
    kinds = {c: turns.schema[c].dataType for c in ("turn_id", "happened_at", "revision")}
    marks = ends.select("key", "bucket", F.coalesce(F.col("until"), last).cast(kinds["happened_at"]).alias("happened_at"), F.lit(1).alias("mark"), F.lit(None).cast(kinds["revision"]).alias("revision"), F.lit(None).cast(kinds["turn_id"]).alias("turn_id"), "query_id")
    line = rows.select("key", "bucket", "happened_at", F.lit(0).alias("mark"), "revision", "turn_id", F.lit(None).cast(asked.schema["query_id"].dataType).alias("query_id")).unionByName(marks)
    order = Window.partitionBy("key", "bucket").orderBy("happened_at", "mark", "revision", "turn_id").rowsBetween(Window.unboundedPreceding, 0)
    line = kept(line.withColumn("n", F.count(F.when(F.col("mark") == 0, 1)).over(order)))
    wanted = line.filter("mark = 1 AND n > 0").select("query_id", "key", "bucket", F.explode(F.sequence(F.greatest(F.lit(1).cast("long"), F.col("n") - limit + 1), "n")).alias("n"))
    met = wanted.join(line.filter("mark = 0").select("key", "bucket", "n", "turn_id", "happened_at", "revision"), ["key", "bucket", "n"])
    met = met.join(asked.select("query_id", "since"), "query_id").filter(F.col("since").isNull() | (F.col("happened_at") >= F.col("since")))
    return _ranked(met, F.desc("happened_at"), F.desc("revision"), F.col("turn_id")).filter(F.col("rank") < limit).select("query_id", "turn_id", "rank")


def gather_turns(index: RecallIndex | Blocks, turns: DataFrame, queries: DataFrame, *, names: DataFrame | None = None, limit: int = 8, pool: int = POOL, weights: dict[str, float] | None = None) -> DataFrame:
    """query_id, turn_id, place, start, n_chars, branch: the turns that answer each request, and which stretch of them is shown.

    turns(turn_id, session_id, scope, role, happened_at, revision, content); queries(query_id, query, embedding) may have
    scopes, since, until, recent, about_assistant, around (a day, or "a..b"). names(query_id, name): what memories of a
    recent request are named.

    recent: the newest turns, of those that word search finds for the names if there are any. Else word and meaning
    search, re-ranked; with `around`, the same searches inside the days lead and lists are fused. The stretch is the
    piece that matched by meaning, else the start; with about_assistant, the assistant's turns are shown up to ANSWER characters.
    """
    asked = kept(requests_of(queries))
    about = turns.select("turn_id", "session_id", "scope", "role", "happened_at", "revision", F.length("content").alias("_chars"))
    parts = []
    late = asked.filter("recent")
    if not late.isEmpty():
        if names is not None:
            called = names.groupBy("query_id").agg(F.concat_ws(" ", F.sort_array(F.collect_set("name"))).alias("called"))
            called = late.join(called.filter("called <> ''"), "query_id")
            hits = index.search(called.select("query_id", F.col("called").alias("query"), "scopes", "until"), NAMED_TURNS).select("query_id", "turn_id")
            hits = hits.join(late.select("query_id", "since"), "query_id").join(about, "turn_id").filter(F.col("since").isNull() | (F.col("happened_at") >= F.col("since")))
            hits = _ranked(hits, F.desc("happened_at"), F.desc("revision"), F.col("turn_id")).filter(F.col("rank") < limit)
            parts.append(hits.select("query_id", "turn_id", "rank", F.lit(0).alias("start"), F.lit("NAMED").alias("branch")))
            late = late.join(called.select("query_id"), "query_id", "left_anti")
        newest = latest_turns(turns, late, min(limit, NAMED_TURNS))
        parts.append(newest.select("query_id", "turn_id", "rank", F.lit(0).alias("start"), F.lit("LATEST").alias("branch")))
    rest = asked.filter("NOT recent")
    if not rest.isEmpty():
        parts += _searched(index, about, turns, kept(rest), max(limit, pool), limit, weights)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    out = out.join(about, "turn_id").join(asked.select("query_id", "until", "about_assistant"), "query_id")
    out = out.filter(F.col("until").isNull() | (F.col("happened_at") <= F.col("until")))
    whole = F.coalesce(F.col("about_assistant") & (F.col("role") == "assistant"), F.lit(False))
    recent = F.col("branch").isin("NAMED", "LATEST")
    shown = F.when(whole & ~recent, ANSWER).when(recent, F.col("_chars")).otherwise(PIECE)
    start = F.when(whole, 0).otherwise(F.col("start"))
    out = out.withColumn("start", start).withColumn("n_chars", F.least(shown, F.col("_chars") - F.col("start")))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return out.select("query_id", "turn_id", place.alias("place"), "start", "n_chars", "branch")


def _searched(index, about: DataFrame, turns: DataFrame, asked: DataFrame, pool: int, limit: int, weights) -> list[DataFrame]:
    since = asked.select("query_id", "since", "span_since", "span_until")
    words = index.search(asked.select("query_id", "query", "scopes", "until"), pool).select("query_id", "turn_id", F.col("place").alias("_place"))
    words = words.join(since, "query_id").join(about.select("turn_id", "happened_at"), "turn_id").filter(F.col("since").isNull() | (F.col("happened_at") >= F.col("since")))
    words = kept(_ranked(words, F.col("_place")).select("query_id", "turn_id", "rank", "happened_at", "span_since", "span_until"))
    near = ["query_id", "embedding", "scopes", "since", "until", "about_assistant"]
    similar = index.similar(asked.select(near), pool)
    meaning = kept(similar.select("query_id", "turn_id", (F.col("place") - 1).alias("rank"), F.round("similarity", 4).alias("similarity"), "start"))
    dated = asked.filter("span_since IS NOT NULL")
    plain = asked.filter("span_since IS NULL")
    parts = []
    if not plain.isEmpty():
        only = lambda rows: rows.join(plain.select("query_id"), "query_id", "left_semi")
        best = ranking.rerank(ranking.features(plain.select("query_id", "query"), only(meaning), only(words), turns), limit, weights)
        parts.append(best.select("query_id", "turn_id", (F.col("place") - 1).alias("rank")).join(meaning.select("query_id", "turn_id", "start"), ["query_id", "turn_id"], "left").withColumn("branch", F.lit("RANKED")))
    if not dated.isEmpty():
        until = F.when(F.col("until").isNull(), F.col("span_until")).otherwise(F.least("span_until", "until"))
        inside = index.similar(dated.select("query_id", "embedding", "scopes", F.col("span_since").alias("since"), until.alias("until"), "about_assistant"), max(limit, INSIDE))
        inside = kept(inside.select("query_id", "turn_id", (F.col("place") - 1).alias("rank"), "start"))
        within = words.filter((F.col("happened_at") >= F.col("span_since")) & (F.col("happened_at") < F.col("span_until")))
        within = kept(_ranked(within.drop("rank").join(words.select("query_id", "turn_id", F.col("rank").alias("_rank")), ["query_id", "turn_id"]), F.col("_rank")).select("query_id", "turn_id", "rank"))
        only = lambda rows: rows.join(dated.select("query_id"), "query_id", "left_semi").select("query_id", "turn_id", "rank")
        lists = None
        for number, rows in enumerate((inside, within, only(meaning), only(words))):
            rows = rows.select("query_id", F.lit(number).alias("list_no"), "turn_id", "rank")
            lists = rows if lists is None else lists.unionByName(rows)
        fused = ranking.fuse(lists, limit).select("query_id", "turn_id", (F.col("place") - 1).alias("rank"))
        # the first list that has a turn says which stretch of it is shown; word hits show the start
        first = inside.select("query_id", "turn_id", F.col("start").alias("_inside"))
        fused = fused.join(first, ["query_id", "turn_id"], "left").join(within.select("query_id", "turn_id", F.lit(0).alias("_within")), ["query_id", "turn_id"], "left").join(meaning.select("query_id", "turn_id", F.col("start").alias("_meaning")), ["query_id", "turn_id"], "left")
        parts.append(fused.select("query_id", "turn_id", "rank", F.coalesce("_inside", "_within", "_meaning").alias("start"), F.lit("AROUND").alias("branch")))
    return [p.withColumn("start", F.coalesce("start", F.lit(0))) for p in parts]


def shown(found: DataFrame, turns: DataFrame) -> DataFrame:
    """found with the turns' columns; content is the stretch to show."""
    stretch = F.substring(F.col("content"), F.col("start") + 1, F.col("n_chars"))
    return found.join(turns, "turn_id").withColumn("content", stretch)
