"""State intake, passages, sentence vectors, the vector cache, packets for messages, links without pairs, dates, sweeps."""

import datetime
import hashlib
import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.functions import canonical, dates
from evidentia.functions.text import sentences_at
from evidentia.operators import graph, inject, passages, recall, recall_index, state, state_intake, vectors


def test_canonical_json_equals_pythons(spark):
    texts = ["plain", 'a "quote" \\ and /', "línea\n\t\r\b\f", "\x00\x01\x0b\x0e\x1f\x7f", "\\u000B \\\x0b \\\\\x0b", "모임 𝒳", "", None]
    rows = [(t, i, i % 2 == 0, [t or "x", "b"]) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "zeta string, alpha long, mid boolean, list array<string>")
    got = frame.select(canonical.canonical_json({c: F.col(c) for c in frame.columns}).alias("j"), canonical.fingerprint_of(frame.schema, frame.columns).alias("h")).collect()
    for r, (z, a, m, x) in zip(got, rows, strict=True):
        want = json.dumps({"zeta": z, "alpha": a, "mid": m, "list": x}, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)
        assert r.j == want and r.h == hashlib.sha256(want.encode()).hexdigest()
    with pytest.raises(TypeError):
        canonical.fingerprint_of(spark.createDataFrame([(1.5,)], "x double").schema, ["x"])


def claim(**changes):
    base = {"kind": "OBSERVATION", "turn_id": "t1", "support_quote": "Ana lives in Oslo now", "subject_text": "Ana", "value_text": "Oslo", "time_kind": "SESSION_OBSERVATION", "known_at": "2024-05-02T10:00"}
    return base | changes


def sha(c):
    return hashlib.sha256(json.dumps(c, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


SPANS = {"c": (0, 21, "Ana lives in Oslo now"), "s": (0, 3, "Ana"), "v": (13, 17, "Oslo"), "far": (30, 34, "Oslo"), "t": (18, 21, "now"), "at": (5, 21, "2024-05-01T08:00")}


def run_intake(spark, cases):
    """cases: (candidate, grant changes or None, source changes, span ids by which to mark a foreign span)."""
    candidates, grants, spans, sources = [], [], [], []
    for i, (c, g, s) in enumerate(cases):
        candidates.append((i, *[c[k] for k in state_intake._CLAIM]))
        if g is not None:
            grant = {"candidate_sha256": sha(c), "memory_id": "m", "source_id": "s1", "entity_id": "e", "relation": "LOCATED_AT", "context_span_id": f"{i}c", "subject_span_id": f"{i}s", "value_span_id": f"{i}v", "time_span_id": None, "semantics_attestation_id": "a", "identity_attestation_id": "b", "valid_from": None, "observed_at": "2024-05-02T09:00", "observation_attestation_id": "o"} | {k: f"{i}{v}" if k.endswith("span_id") and v else v for k, v in g.items()}
            grants.append((i, *grant.values()))
        role = s.pop("role", "user")
        spans += [(f"{i}{n}", "m", "s1", "t1", role, a, b, text) for n, (a, b, text) in SPANS.items()]
        source = {"memory_id": "m", "source_id": "s1", "session_timestamp": "2024-05-02T09:00"} | s
        sources.append((i, *source.values()))
    texts = lambda names: ", ".join(f"{n} string" for n in names)
    names = "candidate_sha256 memory_id source_id entity_id relation context_span_id subject_span_id value_span_id time_span_id semantics_attestation_id identity_attestation_id valid_from observed_at observation_attestation_id".split()
    out = state_intake.compile_intake(
        spark.createDataFrame(candidates, "candidate_id long, " + texts(state_intake._CLAIM)),
        spark.createDataFrame(grants, "candidate_id long, " + texts(names)),
        spark.createDataFrame(spans, "span_id string, memory_id string, session_id string, source_turn_id string, source_role string, start int, end int, text string"),
        spark.createDataFrame(sources, "candidate_id long, memory_id string, source_id string, session_timestamp string"),
    )
    return [r for r in sorted(out.collect(), key=lambda r: r.candidate_id)]


def test_state_intake_gathers_every_reason(spark):
    change = {"kind": "STATE_CHANGE", "time_kind": None}
    cases = {
        (): (claim(), {}, {}),
        ("CHANGE",): (claim(**change), {"time_span_id": "at", "valid_from": "2024-05-01T08:00"}, {}),
        ("INTENTION_DOES_NOT_MUTATE_STATE",): (claim(kind="PLAN"), {}, {}),
        ("EXPLICIT_RECORD_TARGET_AND_REVISION_REQUIRED",): (claim(kind="CORRECTION"), {}, {}),
        ("UNSUPPORTED_OR_AMBIGUOUS_MODE",): (claim(kind=None), {}, {}),
        ("TRUSTED_SOURCE_SEMANTIC_IDENTITY_GRANT_REQUIRED",): (claim(), None, {}),
        ("CANDIDATE_GRANT_MISMATCH",): (claim(), {"candidate_sha256": "0"}, {}),
        ("SOURCE_SCOPE_GRANT_MISMATCH",): (claim(), {}, {"memory_id": "other"}),
        ("ENTITY_ID_REQUIRED", "IDENTITY_ATTESTATION_ID_REQUIRED", "SEMANTICS_ATTESTATION_ID_REQUIRED"): (claim(), {"entity_id": " ", "semantics_attestation_id": None, "identity_attestation_id": ""}, {}),
        ("UNSUPPORTED_STATE_RELATION",): (claim(), {"relation": "KNOWS"}, {}),
        ("MULTI_VALUE_EXECUTOR_REQUIRED",): (claim(), {"relation": "LIVES_AT"}, {}),
        ("SOURCE_SPAN_NOT_RESTORABLE",): (claim(), {"value_span_id": "nowhere"}, {}),
        ("SPAN_SOURCE_ROLE_SCOPE_MISMATCH",): (claim(), {}, {"role": "assistant"}),
        ("CONTEXT_CLAIM_MISMATCH",): (claim(support_quote="Ana lives"), {}, {}),
        ("ATOM_OUTSIDE_CLAIM_CONTEXT",): (claim(), {"value_span_id": "far"}, {}),
        ("ATOM_CANDIDATE_MISMATCH",): (claim(value_text=None), {}, {}),
        ("INVALID_KNOWLEDGE_TIMESTAMP",): (claim(known_at="yesterday"), {}, {}),
        ("LITERAL_VALID_INSTANT_REQUIRED",): (claim(**change), {"time_span_id": "t", "valid_from": "2024-05-01T08:00"}, {}),
        ("LITERAL_VALID_INSTANT_REQUIRED", "VALID_TIME_UNRESOLVED"): (claim(**change), {}, {}),
        ("STATE_CHANGE_AFTER_RECORDING",): (claim(known_at="2024-04-30T10:00", **change), {"time_span_id": "at", "valid_from": "2024-05-01T08:00"}, {}),
        ("CURRENT_SOURCE_OBSERVATION_BINDING_REQUIRED",): (claim(), {"observation_attestation_id": None}, {}),
        ("CURRENT_SOURCE_OBSERVATION_BINDING_REQUIRED", "OBSERVATION_TIME_UNRESOLVED"): (claim(), {"observed_at": "noon"}, {}),
        ("OBSERVATION_AFTER_RECORDING",): (claim(known_at="2024-05-02T08:00"), {}, {}),
    }
    got = run_intake(spark, list(cases.values()))
    for r, (want, (c, _, _)) in zip(got, cases.items(), strict=True):
        if want in ((), ("CHANGE",)):
            assert r.disposition == "READY_FOR_TRUSTED_APPEND" and r.reasons == [], r
            at = "2024-05-01T08:00" if want else None
            seen = None if want else "2024-05-02T09:00"
            assert r.event.evidence_id == "state_" + sha({"candidate": c, "source_id": "s1", "memory_id": "m", "relation": "LOCATED_AT", "entity_id": "e", "value": "Oslo", "valid_from": at, "observed_at": seen})
            assert (r.event.object_text, r.event.subject_name, r.event.state_valid_from, r.event.observed_at) == ("Oslo", "Ana", at, seen)
        else:
            assert tuple(r.reasons) == want and r.event is None, (r, want)
            assert r.disposition == {"PLAN": "CONTROL_EVIDENCE_ONLY", "CORRECTION": "TARGET_REVIEW_REQUIRED"}.get(c["kind"], "HOLD")


def embed_of(text):
    v = np.zeros(64)
    for w in re.split("[ \t\n\x0b\f\r]+", text.lower()):
        if w:
            h = hashlib.md5(w.encode()).hexdigest()
            v[int(h[:6], 16) % 64] += 1 if h[6] >= "8" else -1
    return v


def near(a, b):
    n = np.linalg.norm(a) * np.linalg.norm(b)
    return round(float(a @ b / n), 9) if n else 0.0


def test_evidence_passages_equal_a_plain_reading(spark):
    rng = random.Random(4)
    words = "bag skin cream price bought paid store euro gift red blue city trip train".split()
    say = lambda n: " ".join(rng.choices(words, k=n))
    questions = [(q, f"{say(4)} bag {q}", ["Bag", "red_gift", "city trip", None, " ", "skin", "train"][: q + 1]) for q in range(4)] + [(9, "nothing here", None)]
    sessions, turns, events = [], [], []
    for q in range(4):
        for s in range(5):
            said = [(f"TURN_{i}", say(rng.choice([0, 3, 200]))) for i in range(6)]
            sessions.append((q, f"q{q}s{s}", f"2024-0{rng.randint(1, 9)}-01", "\n".join(f"{i} [user]: {t}" for i, t in said)))
            turns += [(f"q{q}s{s}", i, t) for i, t in said]
        for e in range(30):
            events.append((q, q * 100 + e, f"q{q}s{rng.randint(0, 5)}", [f"TURN_{rng.randint(0, 7)}" for _ in range(rng.randint(0, 3))], say(3)))
    frame = spark.createDataFrame
    got = passages.evidence_passages(
        frame(questions, "query_id long, question string, entities array<string>"),
        frame(sessions, "query_id long, session_id string, session_date string, content string"),
        frame(events, "query_id long, event_id long, session_id string, source_turn_ids array<string>, text string"),
        frame(turns, "session_id string, turn_id string, text string"),
        vectors.hashing_embedder(),
    ).collect()
    text_of = {(s, t): x.strip() for s, t, x in turns}
    want = []
    for q, question, entities in questions:
        mine = [e for e in events if e[0] == q]
        views = [question] + [v for v in (str(e).replace("_", " ").strip() for e in entities or [] if e is not None) if v and v.lower() not in question.lower()]
        rank = lambda view, own: sorted(own, key=lambda e: (-near(embed_of(view), embed_of(e[4])), e[1]))  # noqa: E731, B023
        chosen = rank(question, mine)[:20]
        for view in views[1:4]:
            chosen += [e for e in rank(view, mine)[:5] if e not in chosen]
        found, seen = [], set()
        date = {s[1]: s[2] for s in sessions if s[0] == q}
        for e in chosen:
            for t in e[3]:
                if text_of.get((e[2], t)) and (e[2], t) not in seen and e[2] in date:
                    seen.add((e[2], t))
                    found.append((date[e[2]], 0, len(found), e[2], t, text_of[e[2], t][:500]))
        cut = [(s[1], i, s[3][i : i + 600]) for s in sessions if s[0] == q for i in range(0, max(1, len(s[3]) - 600 + 300), 300) if s[3][i : i + 600].strip()]
        best = sorted(cut, key=lambda c: (-near(embed_of(question), embed_of(c[2])), c[0], c[1]))[:3]
        found += [(date[s], 1, n, s, None, text) for n, (s, _, text) in enumerate(best)]
        want += [(q, place, x[3], x[0], x[4], x[5]) for place, x in enumerate(sorted(found, key=lambda x: x[:3]), 1)]
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, want)) and len(want) > 40


def test_sentence_offsets_equal_pythons(spark):
    texts = ["  First sentence here!  Second one is longer? short. Über die Brücke 𝒳 gehen wir.\nNew line, no end", "...!", "", None, "x" * 400 + ". Another sentence stands here", "?leading marks then a sentence"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in frame.select("t", sentences_at("t").alias("s")).collect():
        want = [(m.start(), m.group().strip()[:300]) for m in re.finditer(r"[^.!?\n]+[.!?]*", r.t or "") if len(m.group().strip()) >= 15]
        assert [(x.start, x.sentence) for x in r.s] == want


def test_best_sentences_show_what_stands_before(spark):
    rng = random.Random(7)
    words = "alpha beta gamma delta epsilon zeta".split()
    text = lambda: " ".join(" ".join(rng.choices(words, k=rng.randint(2, 9))) + rng.choice([".", "!", "?\n", ""]) for _ in range(30))
    turns = [(f"t{i}", i, text()) for i in range(25)] + [("none", 99, None)]
    asked = [(q, " ".join(rng.choices(words, k=3))) for q in range(4)]
    embed = vectors.hashing_embedder()
    queries = spark.createDataFrame(asked, "query_id long, query string").withColumn("embedding", embed("query"))
    got = vectors.best_sentences(spark.createDataFrame(turns, "turn_id string, revision long, content string"), queries, embed, k=7).collect()
    want = []
    for q, query in asked:
        best = {}
        for t, revision, content in turns:
            for m in re.finditer(r"[^.!?\n]+[.!?]*", content or ""):
                if len(m.group().strip()) >= 15:
                    key = (-near(embed_of(query), embed_of(m.group().strip()[:300])), revision, m.start(), t)
                    best[t] = min(best.get(t, (2,)), key)
        for place, key in enumerate(sorted(best.values())[:7], 1):
            start = max(0, key[2] - 150)
            want.append((q, key[3], place, start, dict((t, c) for t, _, c in turns)[key[3]][start : start + 500]))
    assert sorted((r.query_id, r.turn_id, r.place, r.start, r.text) for r in got) == sorted(want)


def test_a_wrong_vector_cache_is_caught(spark, tmp_path):
    embed, model = vectors.hashing_embedder(), "m"
    pieces = spark.createDataFrame([(f"piece {i} {'abcdefgh'[i % 8] * 3} {i * 7}",) for i in range(60)], "piece string")
    cache = vectors.VectorCache(spark, "file://" + str(tmp_path / "cache"), embed, model)
    assert not cache.verify(pieces) and cache.warm(pieces) == 60 and cache.warm(pieces) == 0
    assert not cache.verify(pieces) and cache.generation == 0
    rows = [(r.key, list(r.embedding)) for r in cache.read().orderBy("key").collect()]
    shape = vectors.VectorCache.SHAPE
    shuffled = spark.createDataFrame([(k, rows[i - 1][1]) for i, (k, _) in enumerate(rows)], shape)
    nan = spark.createDataFrame([(k, [float("nan")] * 64) for k, _ in rows], shape)
    close = spark.createDataFrame([(k, [x + 50.0 for x in rows[i - 1][1]]) for i, (k, _) in enumerate(rows)], shape)
    noise = spark.createDataFrame([(k, [x * 1.02 + 0.01 for x in v]) for k, v in rows], shape)
    wrong = lambda c, e=embed: vectors.cache_is_wrong(pieces, c, e, model)
    assert wrong(shuffled) and wrong(nan) and not wrong(noise)

    # a model that puts all texts close together: cosines are above 0.9 also for another text's vector
    shifted = lambda c: F.transform(embed(c), lambda x: x + 50.0)
    assert wrong(close, shifted) and not wrong(spark.createDataFrame([(k, [x + 50.0 for x in v]) for k, v in rows], shape), shifted)
    assert not wrong(shuffled.limit(3))  # too few say nothing
    name = cache.store.segment()
    cache.store.write(shuffled, name, "vectors")
    cache.store.commit(cache.store.state(), segments=[name])
    assert cache.verify(pieces) and cache.generation == 1 and cache.read().count() == 0
    assert cache.warm(pieces) == 60 and not cache.verify(pieces)
    cache.merge()
    assert cache.read().count() == 60


TURN = "turn_id string, session_id string, scope string, role string, happened_at timestamp, revision long, content string, client string, source_path string"


def test_packets_of_a_stream_equal_those_of_a_batch(spark, tmp_path):
    start = datetime.datetime(2024, 3, 1, tzinfo=datetime.timezone.utc)
    turns = [(f"t{i}", f"s{i % 4}", "p", "user" if i % 3 else "assistant", start + datetime.timedelta(hours=i), i, f"note {i} about {'garden' if i % 5 else 'boat'} number {i}", "c", f"/x/y/{i % 4}.jsonl") for i in range(40)]
    embed = vectors.hashing_embedder()
    frame = spark.createDataFrame(turns, TURN)
    index = recall_index.RecallIndex(spark, "file://" + str(tmp_path / "index"), embed)
    index.sync(frame)
    messages = [(1, "what about the boat"), (2, "note  5 about boat\nnumber 5"), (3, "  "), (4, "garden " * 400 + "boat"), (5, None)]
    now = F.to_timestamp(F.lit("2024-04-01 12:30:00"))
    rows = spark.createDataFrame(messages, "message_id long, text string")
    batch = {r.message_id: r.packet for r in inject.packets(rows, index, frame, embed, now=now).collect()}
    assert sorted(batch) == [1, 2, 4]
    assert all(p.startswith(inject.HEADER + "Now: 2024-04-01 12:30\n\n") and len(p) <= len(inject.HEADER) + 25 + inject.CHARS for p in batch.values())
    assert "note 5 about boat number 5" not in batch[2] and "Source: c / " in batch[1] and "/x/y/" not in batch[1]
    assert batch[1].count("[conversation") <= inject.LIMIT
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    inject.answer_messages(stream, index, lambda: frame, embed, str(tmp_path / "out"), str(tmp_path / "state"), now=now).trigger(availableNow=True).start().awaitTermination()
    assert {r.message_id: r.packet for r in spark.read.parquet(str(tmp_path / "out")).collect()} == batch


ENGRAM = "engram_id long, scope string, happened_at timestamp, terms array<string>, revision long, strength double"


def engram_rows(n, seed=2):
    rng, start = random.Random(seed), datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
    terms = [f"w{i}" for i in range(9)]
    out = []
    for i in range(n):
        own = ["w0", "w1", "w2"] if i % 3 == 0 else rng.sample(terms, rng.randint(0, 5))
        out.append((i, f"s{i % 2}", start + datetime.timedelta(hours=3 * i), own, i, i / n))
    return out


def plain_links(rows, most=4, least=2):
    out = []
    for e in rows:
        met = [(-len(set(e[3]) & set(o[3])), -o[4], o[0]) for o in rows if o[1] == e[1] and o[4] < e[4] and len(set(e[3]) & set(o[3])) >= least]
        one = [(e[0], t, "SHARED_CUE", min(0.75, 0.2 + 0.1 * -n)) for n, _, t in sorted(met)[:most]]
        before = [o for o in rows if o[1] == e[1] and (o[2], o[4]) < (e[2], e[4])]
        one += [(e[0], max(before, key=lambda o: (o[2], o[4]))[0], "TEMPORAL", 0.3)] if before else []
        out += one + [(t, s, r, w) for s, t, r, w in one]
    return sorted((s, t, r, round(w, 9)) for s, t, r, w in out)


def test_links_equal_all_pairs(spark):
    rows = engram_rows(90)
    got = lambda frame: sorted((r.source, r.target, r.relation, round(r.weight, 9)) for r in frame.collect())
    assert got(graph.auto_links(spark.createDataFrame(rows, ENGRAM), most=4)) == plain_links(rows)
    for least in (1, 3):
        assert got(graph.auto_links(spark.createDataFrame(rows, ENGRAM), most=4, least_overlap=least)) == plain_links(rows, least=least)


def test_engram_index_of_many_syncs_equals_one(spark, tmp_path):
    rows = engram_rows(60)
    frame = lambda some: spark.createDataFrame(some, ENGRAM)
    index = graph.EngramIndex(spark, "file://" + str(tmp_path / "e"), most=4)
    found = lambda: sorted((r.source, r.target, r.relation, round(r.weight, 9)) for r in index.links().collect())
    for upto in (25, 26, 60):
        assert index.sync(frame(rows[:upto])) == "ADDED" and found() == plain_links(rows[:upto])
    assert index.sync(frame(rows)) == "UNCHANGED" and len(index.state()["segments"]) == 3
    index.compact()
    assert len(index.state()["segments"]) == 1 and found() == plain_links(rows) and index.sync(frame(rows)) == "UNCHANGED"
    assert index.sync(frame(rows[:40])) == "REBUILT" and found() == plain_links(rows[:40])
    late = (70, "s0", rows[3][2], ["w0", "w1"], 70, 0.5)
    assert index.sync(frame([*rows[:40], late])) == "REBUILT" and found() == plain_links([*rows[:40], late])


def test_recalled_nodes_have_paths_and_strength(spark):
    edges = spark.createDataFrame([(1, 2, "X", 0.9), (2, 3, "Y", 0.8), (1, 4, "X", 0.5), (9, 9, "Z", 1.0)], "source long, target long, relation string, weight double")
    start = spark.createDataFrame([("q", 1, 1.0)], "query_id string, engram_id long, activation double")
    strengths = spark.createDataFrame([(1, 0.1), (2, 0.1), (3, 0.9), (4, 0.2)], "engram_id long, strength double")
    state_rows = graph.activate(start, edges, hops=2)
    got = {r.engram_id: r for r in graph.recalled(state_rows, strengths).collect()}
    by_strength = sorted(got, key=lambda i: -(got[i].activation * (0.5 + got[i].strength)))
    assert [i for i in sorted(got, key=lambda i: got[i].place)] == by_strength and got[1].place == 1
    assert [(p["from"], p["to"], p["relation"]) for p in got[3].path] == [(1, 2, "X"), (2, 3, "Y")] and got[1].path == []
    assert len(graph.recalled(state_rows, strengths, limit=2).collect()) == 2


def test_concept_coverage_gates_by_one_seed_or_by_all(spark):
    engrams = spark.createDataFrame([(1, ["a", "x"]), (2, ["b"])], "engram_id long, terms array<string>")
    start = spark.createDataFrame([("q", 1, 0.9), ("q", 2, 0.8), ("r", 1, 0.9)], "query_id string, engram_id long, activation double")
    cues = spark.createDataFrame([("q", ["a", "b"]), ("r", [])], "query_id string, cues array<string>")
    coverage = graph.concept_coverage(start, engrams, cues)
    assert [tuple(r) for r in coverage.collect()] == [("q", 0.5, 1.0)]
    count = lambda least, mode: {r.query_id for r in graph.covered(start, coverage, least, mode).collect()}
    assert count(0.6, "single") == {"r"} and count(0.6, "union") == {"q", "r"} and count(0.5, "single") == {"q", "r"}


def test_nested_offsets_and_months(spark):
    said = {"two weeks before 3 days after 2023-05-28": "2023-05-17", "a day after two days before a week after 2023-05-28": "2023-06-03", "sept 3": None, "sep 3": "2023-09-03", "three weeks before 2023-05-28": "2023-05-07", "2 days before nothing": None, "": None, "one day before a day before a day before a day before 2023-05-28": "2023-05-24"}
    rows = spark.createDataFrame(list(said), "string").toDF("p")
    got = {r.p: str(r.s.start) if r.s else None for r in rows.select("p", dates.resolve(F.col("p"), F.lit("2023-06-01").cast("date")).alias("s")).collect()}
    assert got == said


def test_state_sweep_equals_a_plain_reading(spark):
    rng = random.Random(9)
    at = lambda d: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=d)
    records = [(rng.choice("ab"), a, None if rng.random() < 0.1 else a + rng.randint(0, 9), rng.choice(["x", "y", "z"])) for a in (rng.randint(0, 300) for _ in range(60))]
    queries = [(i, rng.choice(["a", "b", "c", None]), rng.randint(-5, 320)) for i in range(200)]
    got = {r.query_id: (r.status, r.reason, r.value) for r in state.state_as_of(
        spark.createDataFrame([(k, at(a), None if b is None else at(b), v) for k, a, b, v in records], "k string, valid_from timestamp_ntz, valid_to timestamp_ntz, value string"),
        spark.createDataFrame([(i, k, at(d)) for i, k, d in queries], "query_id long, k string, as_of timestamp_ntz"), ["k"]).collect()}
    for i, k, d in queries:
        held = {v for key, a, b, v in records if key == k and a <= d and (b is None or d < b)}
        want = ("ANSWER", None, next(iter(held))) if len(held) == 1 else ("UNKNOWN", "CONFLICTING_VALID_STATES" if held else "NO_CERTIFIED_VALID_STATE", None)
        assert got[i] == want
    assert len({x[0:2] for x in got.values()}) == 3


def test_memories_by_meaning_only_where_no_word_matches(spark):
    day = datetime.datetime(2024, 1, 1)
    shape = "memory_id long, scope string, effective_at timestamp_ntz, known_at timestamp_ntz, revision long, title string, tags array<string>, entities array<string>, memory_type string, content string, fact string, supersedes long"
    rows = [(i, "s", day, day, i, t, [], [], "FACT", c, None, None) for i, (t, c) in enumerate([("dog", "a golden retriever"), ("city", "lives in oslo"), ("pet", "retriever breed golden")])]
    memories = spark.createDataFrame(rows, shape)
    embed = vectors.hashing_embedder()
    asked = spark.createDataFrame([(1, "oslo"), (2, "quite unheard")], "query_id long, query string")
    pieces = memories.select(F.col("memory_id").alias("turn_id"), F.col("revision"), F.lit(0).alias("start"), embed("content").alias("embedding"))
    vector = asked.withColumn("query", F.lit("golden retriever")).select("query_id", embed("query").alias("embedding"))
    got = {(r.query_id, r.memory_id) for r in recall.recall_memories(memories, asked, meaning=(pieces, vector), floor=0.2, margin=0.1).collect()}
    assert (1, "1") in got and {m for q, m in got if q == 1} == {"1"} and {m for q, m in got if q == 2} <= {"0", "2"} and (2, "0") in got
