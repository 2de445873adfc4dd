"""Queries that do the whole job where the ones with SQL hold a smaller one; small cases and brute force."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.functions import security
from evidentia.operators import graph, vectors
from evidentia.queries import QUERIES
from evidentia.sources import tables

WORDS = "amber birch cedar delta ember fjord grove heath islet juniper karst lagoon maple".split()


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """Documents of one topic word each, and questions whose ninth word and later name the topic."""
    d = str(tmp_path_factory.mktemp("small"))
    docs = [(i, f"{WORDS[i % 13]} " * 40, "en", f"s{i}", 0) for i in range(130)] + [(500, "filler words here " * 40 + "zenith quartz", "en", "s", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    asked = [(1, "one two three four five six seven eight zenith quartz"), (41, "amber"), (60, "lagoon")]
    spark.createDataFrame(asked, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def brute_groups(pieces, asked):
    unit = lambda x: np.array(x) / max(np.linalg.norm(x), 1e-300)
    out = {}
    for q, e in asked:
        best = {}
        for turn, revision, start, v in pieces:
            key = (-round(float(unit(e) @ unit(v)), 9), revision, start)
            best[turn] = min(best.get(turn, key), key)
        out[q] = sorted((key, turn) for turn, key in best.items())
    return out


def test_best_groups_equal_brute_force_over_blocks_and_batches(spark):
    rng = np.random.default_rng(5)
    pieces = [(i // 4, i // 4, i % 4 * 500, [float(x) for x in rng.integers(-1, 2, 3)]) for i in range(400)]
    asked = [(q, [float(x) for x in rng.integers(-1, 2, 3) + 0.5]) for q in range(7)]
    v = spark.createDataFrame(pieces, "turn_id long, revision long, start int, embedding array<double>").repartition(5)
    q = spark.createDataFrame(asked, "query_id long, embedding array<double>")
    want = brute_groups(pieces, asked)
    for k in (None, 10):
        got = {}
        for r in vectors.best_groups(v, q, k).collect():
            got.setdefault(r.query_id, []).append(((-r.similarity, r.revision, r.start), r.turn_id))
        assert {x: sorted(y) for x, y in got.items()} == {x: y[:k] for x, y in want.items()}


def test_best_groups_without_k_neither_gather_nor_shuffle_what_they_find(spark, monkeypatch):
    rng = np.random.default_rng(6)
    row = lambda i, turn: (turn, i % 3, i % 5 * 500, [float(x) for x in rng.integers(-1, 2, 3)])
    pieces, asked = [row(i, i // 7) for i in range(2500)], [(q, [float(x) for x in rng.integers(-1, 2, 3) + 0.5]) for q in range(70)]
    q = spark.createDataFrame(asked, "query_id long, embedding array<double>")
    shape = "turn_id long, revision long, start int, embedding array<double>"
    plan = vectors.best_groups(spark.createDataFrame(pieces, shape), q)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "MapInArrow" in plan
    monkeypatch.setattr("evidentia.operators.recall_index.ASKED", 30)  # several question blocks, met by a shuffled join
    # a turn of more pieces than a block has is found as well, once
    pieces += [row(i, 9999) for i in range(1500)] + [row(i, None) for i in range(5)]
    got = vectors.best_groups(spark.createDataFrame(pieces, shape).repartition(5), q)
    found = {}
    for r in got.collect():
        found.setdefault(r.query_id, []).append(((-r.similarity, r.revision, r.start), -1 if r.turn_id is None else r.turn_id))
    assert {x: sorted(y) for x, y in found.items()} == brute_groups([(-1 if p[0] is None else p[0], *p[1:]) for p in pieces], asked)


def test_gather_finds_by_meaning_and_by_late_words(spark, small):
    packets = {r.query_id: r.context for r in QUERIES["gather"](spark, small).collect()}
    assert "zenith quartz" in packets[1]
    assert "amber amber" in packets[41] and "lagoon lagoon" in packets[60]
    bodies = [part.split("\n")[1] for part in packets[41].split("\n\n")]
    assert all(b.startswith("amber amber") for b in bodies[:10])


def test_gather_meaning_list_is_the_cosine_of_embedded_pieces(spark, small):
    from evidentia.catalogue import _whole_pool

    _, _, meaning, words = _whole_pool(spark, small)
    rows = meaning.filter("query_id = 41").orderBy("rank").collect()
    assert len(rows) == 100 and [r.turn_id for r in rows[:10]] == [f"document-{13 * i}" for i in range(10)] and rows[0].similarity == 1.0
    assert words.filter("query_id = 41").count() == 10


def test_vector_searches_ask_every_fiftieth_row(spark, tmp_path):
    rng = np.random.default_rng(7)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(13000)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    e = np.array([v for _, v in rows], dtype=np.float32).astype(np.float64)
    e /= np.linalg.norm(e, axis=1, keepdims=True)
    asked = list(range(0, 13000, 50))  # 260: more than a block
    sim = np.round(e[asked] @ e.T, 9)
    got = {}
    for r in QUERIES["cosine_topk"](spark, str(tmp_path)).collect():
        got.setdefault(r.query_id, []).append((r.place, r.vec_id))
    assert {q: [v for _, v in sorted(x)] for q, x in got.items()} == {q: list(np.lexsort((np.arange(13000), -sim[i]))[:20]) for i, q in enumerate(asked)}
    best = QUERIES["best_piece_per_turn"](spark, str(tmp_path))
    assert best.count() == 260 * 3250
    starts = sim.reshape(260, 3250, 4).argmax(2) * 500
    assert all(r.start == starts[r.query_id // 50, r.turn_id] for r in best.filter("turn_id % 97 = 0").collect())
    for r in QUERIES["session_ranking"](spark, str(tmp_path)).filter("place = 1").collect():
        assert r.session_id == int(sim[r.query_id // 50].argmax()) % 90


def test_regions_reach_their_fixed_point_and_small_ones_join(spark):
    # a chain takes many rounds: each node goes with its heavier, higher neighbour
    chain = [(i, i + 1, 1.0 + i) for i in range(9)]
    nodes = spark.createDataFrame([(i,) for i in range(10)], "node long")
    links = spark.createDataFrame(chain, "a long, b long, weight double")
    label = {i: i for i in range(10)}
    for _ in range(12):
        new = {}
        for n in label:
            votes = {}
            for a, b, w in chain:
                for x, y in ((a, b), (b, a)):
                    if x == n:
                        votes[label[y]] = votes.get(label[y], 0) + w
            new[n] = max(votes.items(), key=lambda v: (v[1], v[0]))[0]
        label, old = new, label
        if label == old:
            break
    got = graph.regions(nodes, links)
    assert {r.node: r.label for r in got.collect()} == label
    assert {r.node: r.label for r in graph.regions(nodes, links, rounds=2).collect()} != label
    # 13 regions of sizes 15 to 3: all but the 12 largest join over two rounds
    labels = [(100 * k + i, 100 * k) for k in range(13) for i in range(15 - k)]
    ties = [(1200, 300, 1.0), (1200, 400, 2.0), (1201, 1200, 5.0)]
    merged = {r.node: r.label for r in graph.merge_small(spark.createDataFrame(labels, "node long, label long"), spark.createDataFrame(ties, "a long, b long, weight double")).collect()}
    assert merged == {**dict(labels), 1200: 400, 1201: 400}


def test_region_topics_name_the_regions_themselves(spark):
    rows = {r.label for r in QUERIES["region_topics"](spark, "/root/testdata/sf0.001").collect()}
    assert rows and rows <= {r.label for r in QUERIES["merged_regions"](spark, "/root/testdata/sf0.001").collect()}


SAID = [
    "nothing to hide", "password: hunter2!", "token=abcdef123456", 'secret = "a b c"', "the password is stored", "the pin is 4711", "비밀번호는 ab12!",
    "id 900101-1234567.", "id 1900101-1234567", "card 4111 1111 1111 1111", "card 4111 1111 1111 1112", "sk-ant-abcdefghijklmnop1234", "mypassword: x1", "postgres://me:pw@host/db", "token: str", "비밀번호: ab12",
]


def luhn(card):
    n = [int(x) for x in re.sub("[ -]", "", card)][::-1]
    return sum(n[::2] + [x * 2 - 9 * (x > 4) for x in n[1::2]]) % 10 == 0


def test_secret_kinds_are_those_of_python(spark, tmp_path):
    spark.createDataFrame(list(enumerate(SAID)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = {i: [name for name, p, _ in security.RULES if re.search(p, s)] + ["card"] * any(map(luhn, re.findall(security.CARD, s))) for i, s in enumerate(SAID)}
    got = {r.doc_id: [k for k in r.kinds.split(",") if k] for r in QUERIES["secret_kinds"](spark, str(tmp_path)).collect()}
    assert got == want
    assert {k for x in got.values() for k in x} >= {"quoted_value", "named_value", "password", "password_said", "password_said_ko", "id_number", "card"}


@pytest.mark.parametrize("name", ["word_search_bm25", "rerank_linear"])
def test_words_after_the_eighth_are_searched(spark, small, name):
    rows = QUERIES[name](spark, small).filter("query_id = 1 AND place = 1").collect()
    assert [r.turn_id for r in rows] == ["document-500"]


def test_turns_are_searched_by_words_after_the_eighth(spark, small):
    turns = [(1, 0, "user", "unrelated talk"), (1, 1, "assistant", "the zenith of it"), (2, 0, "user", "more talk")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{small}/conversations.parquet")
    assert [r.turn_id for r in QUERIES["word_search_turns"](spark, small).filter("query_id = 1").collect()] == ["1-1"]


def test_activation_follows_the_sixth_to_twelfth_edge(spark, tmp_path):
    # the seed has seven later engrams of one scope that share two terms with it and not its query word
    rows = [(1, "small zeta yota", "b", "kind", 10)] + [(i, "zeta yota", "b", f"own{i}", 10) for i in range(2, 9)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    got = {r.engram_id for r in QUERIES["activation_2hop"](spark, str(tmp_path)).filter("query_id = 0").collect()}
    edges = graph.auto_links(tables.engrams(spark, str(tmp_path)))
    assert edges.filter("source = 1").count() == 8
    one = graph.activate(spark.createDataFrame([(0, 1, 1.0)], "query_id int, engram_id long, activation double"), edges, hops=1, fanout=12)
    assert {r.engram_id for r in one.collect()} == got == set(range(1, 9))
    direct = {r.engram_id: r.activation for r in one.collect()}
    whole = {r.engram_id: r.activation for r in QUERIES["activation_2hop"](spark, str(tmp_path)).filter("query_id = 0").collect()}
    seed = graph.seeds(tables.engrams(spark, str(tmp_path)), spark.sql("SELECT 0 AS query_id, array('small', 'ring', 'economy') AS terms")).first().activation
    assert all(whole[i] >= round(seed * direct[i], 6) - 1e-6 for i in range(2, 9))
