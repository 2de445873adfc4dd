"""The stored index: search by words and by meaning, kept up to date by segments."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.operators import blocks as bl
from evidentia.operators import recall_index as ri
from evidentia.operators import vectors
from evidentia.sources.generations import Conflict, Generations

WORDS = "alpha alphabet beta bet gamma gamm été etat Straße 모임 모임에 run running 42 x1".split()
TURN = "turn_id string, session_id string, scope string, role string, happened_at timestamp, revision long, content string"


def turn_rows(n, seed=1):
    import datetime

    rng = random.Random(seed)
    start = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
    rows = []
    for i in range(n):
        text = " ".join(rng.choices(WORDS, [1 / (j + 1) for j in range(len(WORDS))], k=rng.randint(0, 30)))
        rows.append((f"t{i:04d}", f"s{i % 9}", f"p{i % 3}", rng.choice(["user", "assistant", "document"]), None if i % 17 == 0 else start + datetime.timedelta(hours=rng.randint(0, 90)), i + 1, None if i % 23 == 0 else text))
    return rows


def asked(spark, filters=True):
    import datetime

    at = lambda h: datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc) + datetime.timedelta(hours=h)
    rows = [(0, "alph run", None, None, None, None), (1, "gam été 42", ["p1"], None, None, True), (2, "모임은 bet", None, at(20), at(60), False), (3, "unheard", None, None, None, None), (4, None, None, None, None, None), (5, "straße x1 et", ["p0", "p2"], None, at(70), None)]
    shape = "query_id long, query string, scopes array<string>, since timestamp, until timestamp, about_assistant boolean"
    frame = spark.createDataFrame(rows, shape)
    return frame if filters else frame.select("query_id", "query")


def plain_search(spark, rows, queries, limit, roles):
    """BM25 over prefixes, in Python, of Spark's own tokens."""
    from evidentia.functions.text import query_terms, tokens

    frame = spark.createDataFrame(rows, TURN)
    words = {r.turn_id: r.w or [] for r in frame.select("turn_id", tokens(F.coalesce("content", F.lit(""))).alias("w")).collect()}
    by = {r[0]: r for r in rows}
    n, mean = len(rows), sum(map(len, words.values())) / len(rows)
    out = []
    for q in queries.withColumn("p", query_terms(F.col("query"))).collect():
        scored = []
        for i, own in words.items():
            score = 0.0
            for p in q.p or []:
                df = sum(any(w.startswith(p) for w in x) for x in words.values())
                tf = sum(w.startswith(p) for w in own)
                if tf:
                    score += max(1e-6, math.log((n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(own) / mean))
            r, f = by[i], q.asDict()
            stamp = r[4].replace(tzinfo=None) if r[4] else None
            if score <= 0 or (f.get("scopes") and r[2] not in f["scopes"]):
                continue
            if (f.get("since") and not (stamp and stamp >= f["since"])) or (f.get("until") and stamp and stamp > f["until"]):
                continue
            if roles and not f.get("about_assistant") and r[3] == "assistant":
                continue
            scored.append((-round(score, 9), -(stamp.timestamp() if stamp else -1e18), -r[5], i))
        out += [(q.query_id, key[3], place, round(key[0], 6)) for place, key in enumerate(sorted(scored)[:limit], 1)]
    return out


@pytest.mark.parametrize(("limit", "roles", "filters", "dealt"), [(5, False, False, False), (7, True, True, True), (1000, False, True, False)])
def test_search_equals_plain_bm25(spark, monkeypatch, limit, roles, filters, dealt):
    if dealt:  # several question blocks, none broadcast
        monkeypatch.setattr(bl, "QUESTIONS", 2)
        monkeypatch.setattr(bl, "SENT", 0)
    rows, queries = turn_rows(160), asked(spark, filters)
    frame = spark.createDataFrame(rows, TURN).repartition(3)
    with ri.block_rows(spark, 20):
        held = ri.kept(ri.word_blocks(frame))
    got = ri.search_blocks(held, queries, limit=limit, roles=roles).collect()
    assert sorted((r.query_id, r.turn_id, r.place, round(r.score, 6)) for r in got) == sorted(plain_search(spark, rows, queries, limit, roles))


def test_similar_equals_plain_cosine(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(120, 8)).round(1)
    v[5] = v[11]
    v[7] = 0
    rows = turn_rows(40)
    pieces = [(*rows[i // 3][:6], i % 3 * 500, None if i == 9 else v[i].tolist()) for i in range(120)]
    shape = TURN.replace("content string", "start int, embedding array<float>")
    queries = asked(spark).withColumn("embedding", F.when(F.col("query_id") < 5, F.array(*[F.col("query_id") * 0.1 + j for j in range(8)]).cast("array<float>")))
    with ri.block_rows(spark, 16):
        held = ri.kept(ri.vector_blocks(spark.createDataFrame(pieces, shape).repartition(4)))
    want = []
    for q in queries.collect():
        if q.embedding is None:
            continue
        e, best = np.array(q.embedding, np.float64), {}
        for p in pieces:
            if p[7] is None or (q.scopes and p[2] not in q.scopes) or (not q.about_assistant and p[3] == "assistant"):
                continue
            stamp = p[4].replace(tzinfo=None) if p[4] else None
            if (q.since and not (stamp and stamp >= q.since)) or (q.until and stamp and stamp >= q.until):
                continue
            x = np.array(p[7], np.float32).astype(np.float64)
            s = round(float(x @ e / max(np.linalg.norm(x) * np.linalg.norm(e), 1e-300)), 9)
            best[p[0]] = min(best.get(p[0], (2,)), (-s, p[5], p[6], p[0]))
        want += [(q.query_id, k[3], k[2], place) for place, k in enumerate(sorted(best.values())[:6], 1)]
    got = ri.similar_blocks(held, queries, limit=6).collect()
    assert sorted((r.query_id, r.turn_id, r.start, r.place) for r in got) == sorted(want)
    assert ri.similar_blocks(held, queries, limit=None).filter("query_id = 0").count() == len({p[0] for p in pieces if p[3] != "assistant"})


def found(index, queries):
    embedded = queries.withColumn("embedding", vectors.hashing_embedder()(F.coalesce("query", F.lit(""))))
    words = sorted((r.query_id, r.turn_id, r.place, round(r.score, 6)) for r in index.search(queries, limit=8).collect())
    meaning = sorted((r.query_id, r.turn_id, r.place, r.start) for r in index.similar(embedded, limit=8).collect())
    return words, meaning


def test_index_of_many_syncs_equals_one(spark, tmp_path):
    rows, queries, embed = turn_rows(120), asked(spark), vectors.hashing_embedder()
    frame = lambda some: spark.createDataFrame(some, TURN)
    once = ri.RecallIndex(spark, "file://" + str(tmp_path / "once"), embed)
    assert once.sync(frame(rows)) == "ADDED" and once.sync(frame(rows)) == "UNCHANGED"
    want = found(once, queries)
    grown = ri.RecallIndex(spark, "file://" + str(tmp_path / "grown"), embed)
    for upto in (50, 51, 120):
        assert grown.sync(frame(rows[:upto])) == "ADDED"
    assert len(grown.state()["segments"]) == 3 and found(grown, queries) == want
    assert grown.compact() == "COMPACTED" and len(grown.state()["segments"]) == 1 and found(grown, queries) == want
    # forgotten turns: marked, then gone from the segments, as in an index that never had them
    left = [r for r in rows if int(r[0][1:]) % 5]
    gone = spark.createDataFrame([(r[0],) for r in rows if int(r[0][1:]) % 5 == 0] + [("unknown",)], "turn_id string")
    assert grown.forget(gone) == 24 and grown.forget(gone) == 0
    bare = ri.RecallIndex(spark, "file://" + str(tmp_path / "bare"), embed)
    bare.sync(frame(left))
    want = found(bare, queries)
    assert found(grown, queries) == want and grown.sync(frame(left)) == "UNCHANGED"
    assert grown.compact() == "COMPACTED" and grown.compact() == "UNCHANGED" and found(grown, queries) == want
    # rows that vanished without a word: the count shows it, and a new generation is built
    generation = once.state()["generation"]
    assert once.sync(frame(left)) == "REBUILT" and once.state()["generation"] == generation + 1 and found(once, queries) == want
    assert once.sync(frame([])) == "REBUILT" and found(once, queries) == ([], [])


def test_another_model_rebuilds(spark, tmp_path):
    rows, path = turn_rows(30), "file://" + str(tmp_path / "x")
    index = ri.RecallIndex(spark, path, vectors.hashing_embedder(), "a")
    index.sync(spark.createDataFrame(rows, TURN))
    assert ri.RecallIndex(spark, path, vectors.hashing_embedder(32), "b").sync(spark.createDataFrame(rows, TURN)) == "REBUILT"


def test_readers_never_see_half_a_generation(spark, tmp_path, monkeypatch):
    rows, queries = turn_rows(60), asked(spark)
    index = ri.RecallIndex(spark, "file://" + str(tmp_path / "x"), vectors.hashing_embedder())
    index.sync(spark.createDataFrame(rows[:40], TURN))
    before, state = found(index, queries), index.state()
    write = index.store.write

    def dies(frame, segment, table):
        write(frame, segment, table)
        if table == "words":
            raise RuntimeError("lost")

    for change in (lambda: index.sync(spark.createDataFrame(rows, TURN)), index.compact, lambda: index._rebuild(spark.createDataFrame(rows[:3], TURN), state)):
        monkeypatch.setattr(index.store, "write", dies)
        if change != index.compact:
            with pytest.raises(RuntimeError):
                change()
        assert index.state() == state and found(index, queries) == before
    monkeypatch.setattr(index.store, "write", write)
    assert index.sync(spark.createDataFrame(rows, TURN)) == "ADDED" and len(index.store.vacuum()) == 2
    with pytest.raises(Conflict):
        index.store.commit(state, turns=1)
    index.compact()
    index.sync(spark.createDataFrame(rows, TURN))
    assert len(index.store.vacuum(keep=1)) == 2 and found(index, queries)[0]


def test_pointer_of_nothing(spark, tmp_path):
    store = Generations(spark, "file://" + str(tmp_path / "none"))
    assert store.state()["version"] == 0 and store.versions() == []
    index = ri.RecallIndex(spark, "file://" + str(tmp_path / "none"), vectors.hashing_embedder())
    assert found(index, asked(spark)) == ([], []) and index.compact() == "UNCHANGED"


def test_plan_is_free_of_the_number_of_questions(spark):
    held = ri.held_blocks(ri.word_blocks(spark.createDataFrame(turn_rows(30), TURN)))
    size = lambda n: len(ri.search_blocks(held, spark.range(n).select(F.col("id").alias("query_id"), F.lit("alpha").alias("query")), limit=3)._jdf.queryExecution().optimizedPlan().toString().splitlines())
    assert size(bl.QUESTIONS * 2) == size(bl.QUESTIONS * 8)
