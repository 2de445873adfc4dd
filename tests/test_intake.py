"""Cases of intake, code and views that the registered queries do not reach."""

import math

from pyspark.sql import functions as F

from evidentia.functions import code
from evidentia.operators import evaluate, graph, intake, lexical


def test_context_names_what_is_wrong(spark):
    rows = spark.createDataFrame(
        [
            (1, {"goal": "ship it", "commit": "abc"}),
            (2, {"goal": "x" * 2001, "commit": "y" * 301}),
            (3, {"mood": "fine"}),
            (4, {"goal": "password: hunter2hunter2"}),
            (5, {}),
            (6, None),
            (7, {"goal": None, "commit": None}),
        ],
        "id int, context map<string,string>",
    )
    got = {r.id: r.e for r in rows.select("id", intake.clean_context(F.col("context"), ["goal"], ["commit"]).alias("e")).collect()}
    assert got[1] == got[5] == got[6] == got[7] == []
    assert sorted(got[2]) == ["CONTEXT_COMMIT: ids and links only, not text", "CONTEXT_GOAL_TOO_LONG"]
    assert got[3] == ["CONTEXT_FIELD mood"]
    assert got[4] and all(e.startswith("SECRET_IN_CONTEXT: ") for e in got[4])


def test_promotion_adds_nothing_twice(spark):
    turns = spark.createDataFrame([("a", "p", "user", "이건 기억해", 1), ("b", "p", "user", "hello", 2), ("c", "p", "assistant", "기억해", 3), ("d", "p", None, None, 4)], "turn_id string, scope string, role string, content string, happened_at int")
    made, audit = intake.promote(turns)
    assert [r.related for r in made.collect()] == ["conversation-turn:a"]
    assert {r.turn_id: r.disposition for r in audit.collect()} == {"a": "PROMOTED", "b": "EVIDENCE_ONLY", "c": "EVIDENCE_ONLY", "d": "EVIDENCE_ONLY"}
    again, nothing = intake.promote(turns, audit)
    assert again.isEmpty() and nothing.isEmpty()


def test_keyword_memories_spare_what_was_asked_for(spark):
    tag = intake.TAG
    rows = spark.createDataFrame([(1, "FACT", [tag]), (2, "DECISION", [tag]), (3, "DECISION", ["mine"])], "memory_id int, memory_type string, tags array<string>")
    assert [r.id for r in intake.keyword_memories(rows).collect()] == [2]


def test_scrubbing_keeps_the_length_in_bytes(spark):
    lines = spark.createDataFrame([("a", "기억 x"), ("b", "stay"), ("c", None)], "id string, value string")
    dead = spark.createDataFrame([("a",), ("a",), ("c",)], "id string")
    assert {r.id: r.value for r in intake.scrubbed(lines, dead).collect()} == {"a": " " * len("기억 x".encode()), "b": "stay", "c": None}


def test_moving_projects_can_be_repeated(spark):
    rows = spark.createDataFrame([(1, "p"), (2, "p"), (3, "q")], "checkpoint_id int, project string")
    target = spark.createDataFrame([(1,)], "checkpoint_id int")
    projects = spark.createDataFrame([("p",)], "project string")
    moved = intake.move(rows, target, projects)
    assert [r.checkpoint_id for r in moved.collect()] == [2]
    assert intake.move(rows, target.unionByName(moved.select("checkpoint_id")), projects).isEmpty()


def test_entities_without_a_name_have_no_id(spark):
    rows = spark.createDataFrame([("PERSON", "Ann Lee!"), ("PERSON", " ann  LEE"), ("NONE", "x"), ("PERSON", "..."), ("PERSON", None)], "kind string, name string")
    ids = [r.i for r in rows.select(intake.entity_id(F.col("kind"), F.col("name")).alias("i")).collect()]
    assert ids[0] == ids[1] and ids[0].startswith("entity_") and ids[2:] == [None, None, None]


def test_symbols_nested_broken_and_empty_files(spark):
    old = "import os\n\nclass A:\n    def f(self):\n        def g():\n            return 1\n        return g\n"
    files = [("a.py", old, old.replace("return 1", "return 2")), ("b.py", "def (", "def ("), ("c.py", "x = (", "x = ((") , ("d.txt", "one", "two"), ("e.py", None, "def new():\n    pass\n"), ("f.py", old, old)]
    got = {r.path: r for r in code.changed_files(spark.createDataFrame(files, "path string, before string, after string")).collect()}
    named = {p: [(s.side, s.name) for s in r.symbols] for p, r in got.items()}
    assert named["a.py"] == [(side, n) for side in ("BEFORE", "AFTER") for n in ("A", "A.f", "A.f.g")]
    assert named["b.py"] == named["d.txt"] == named["f.py"] == []
    assert named["c.py"] == [("AFTER", "<module>")]
    assert named["e.py"] == [("AFTER", "new")]
    assert got["f.py"].diff == "" and got["d.txt"].diff == "--- a/d.txt\n+++ b/d.txt\n@@ -1 +1 @@\n-one+two"


def test_coverage_of_questions_without_seeds(spark):
    cues = spark.createDataFrame([(1, 1, [1.0, 0.0]), (1, 2, [0.0, 1.0]), (2, 1, [1.0, 0.0])], "query_id int, cue_id int, v array<double>")
    seeds = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 1.0])], "query_id int, v array<double>")
    got = {r.query_id: r.coverage for r in evaluate.cue_coverage(cues, seeds).collect()}
    assert math.isclose(got[1], (1 + 0.5**0.5) / 2) and got[2] == 0.0


def test_coverage_by_matrices_equals_cosines_pair_by_pair(spark, monkeypatch):
    import numpy as np

    from evidentia.operators.vectors import cosine

    rng = np.random.default_rng(4)
    odd = [None, [0.0, 0.0, 0.0], [1.0, None, 2.0], [1.0, 2.0], [0.0, 0.0], [], [float("nan"), 1.0, 1.0]]
    vector = lambda sign: [float(x) for x in sign * rng.random(3)]
    seeds = [(1, vector(1)) for _ in range(300)] + [(1, [1.0, 1.0, 1.0])] * 50 + [(2, vector(1)) for _ in range(40)]
    seeds += [(3 + i, x) for i, x in enumerate(odd)] + [(3 + i, vector(1)) for i in range(7)] + [(20, [1.0, 2.0]), (21, [0.0, 0.0]), (None, vector(1))]
    cues = [(1, i, vector(1)) for i in range(90)] + [(2, i, vector(-1)) for i in range(40)] + [(2, 0, vector(1)), (30, 1, vector(1)), (None, 1, vector(1))]
    cues += [(3 + i, j, x) for i in range(7) for j, x in enumerate([vector(-1), *odd[:-1]])] + [(q, 100, x) for q, x in zip((1, 20, 20, 21), (odd[-1], vector(-1), [0.0, 0.0, 0.0], vector(-1)), strict=True)]
    c = spark.createDataFrame(cues, "query_id int, cue_id int, v array<double>").repartition(3)
    s = spark.createDataFrame(seeds, "query_id int, v array<double>").repartition(3)
    pairs = c.join(s.withColumnRenamed("v", "s"), "query_id", "left").groupBy("query_id", "cue_id").agg(F.max(cosine(F.col("v"), F.col("s"))).alias("best"))
    want = {r[0]: r[1] for r in pairs.groupBy("query_id").agg(F.avg(F.coalesce("best", F.lit(0.0)))).collect()}
    monkeypatch.setattr(evaluate, "SEEDS", 64)  # several slots and chunks
    monkeypatch.setattr(evaluate, "CUES", 16)
    out = evaluate.cue_coverage(c, s)
    got = {r.query_id: r.coverage for r in out.collect()}
    assert got.keys() == want.keys() and np.allclose(list(got.values()), [want[q] for q in got], rtol=0, atol=1e-12, equal_nan=True)
    one = s.withColumn("cue_id", F.monotonically_increasing_id()).filter("query_id = 1").localCheckpoint()  # cues and seeds of one table
    assert [r.query_id for r in evaluate.cue_coverage(one.filter("cue_id % 5 = 0"), one.select("query_id", "v")).filter("abs(coverage - 1) < 1e-9").collect()] == [1]
    assert "zip_with" not in out._jdf.queryExecution().optimizedPlan().toString()  # cues times seeds are no rows


def test_stemmed_scores_of_tiny_and_empty_corpora(spark):
    docs = spark.createDataFrame([(1, "walked dogs dogs"), (2, "the of"), (3, None)], "doc_id int, text string")
    asked = spark.createDataFrame([(1, "walking a dog"), (2, ""), (3, None)], "query_id int, query string")
    got = {(r.query_id, r.doc_id): r.score for r in lexical.stemmed_scores(docs, asked).collect()}
    assert set(got) == {(1, 1)} and got[(1, 1)] > 0
    assert lexical.stemmed_scores(docs.limit(0), asked).isEmpty()


def test_region_chain_is_labelled_merged_and_counted(spark):
    nodes = spark.range(1, 9).select(F.col("id").alias("node"))
    links = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (3, 1, 1.0), (4, 5, 1.0), (5, 6, 1.0), (6, 4, 1.0), (7, 1, 0.2)], "a long, b long, weight double")
    labels = graph.merge_small(graph.regions(nodes, links), links, largest=2)
    by = {r.node: r.label for r in labels.collect()}
    assert by[1] == by[2] == by[3] == by[7] and by[4] == by[5] == by[6] and by[8] == 8
    assert [r.n for r in graph.largest_regions(labels, 2).collect()] == [4, 3]
