"""Cases of what earlier questions teach that the registered queries do not reach."""

import math

from pyspark.sql import functions as F

from evidentia.operators import learned


def test_features_of_a_turn_used_before(spark):
    pool = spark.createDataFrame([("q", "s:1", "s", 1), ("q", "s:2", "s", 2), ("q", "t:9", "t", 9)], "query_id string, turn_id string, session_id string, number int")
    asked = spark.createDataFrame([("q", "Where is the red bicycle?")], "query_id string, question string")
    past = spark.createDataFrame([("s:1", "s", 1, "a red bicycle"), ("s:1", "s", 1, "red"), ("x:1", "x", 1, None)], "turn_id string, session_id string, number int, question string")
    got = {r.turn_id: r for r in learned.history_features(pool, asked, past).collect()}
    assert got["s:1"].used_before == math.log1p(2) and got["s:1"].term_link == math.log1p(3) and got["s:1"].near_used == 0
    assert got["s:2"].used_before == 0 and got["s:2"].session_used == math.log1p(2) and got["s:2"].near_used == 1
    assert (got["t:9"].session_used, got["t:9"].near_used, got["t:9"].term_link) == (0, 0, 0)
    assert learned.history_features(pool, asked, past.limit(0)).filter("used_before + session_used + near_used + term_link = 0").count() == 3


def test_reply_draws_on_the_rarest_words_first_shown_of_ties(spark):
    texts = ["common zebra quokka", "common zebra quokka", "common", None] + ["common filler"] * 60
    corpus = spark.createDataFrame([("o", x) for x in texts], "owner string, text string")
    shown = spark.createDataFrame([("q", f"t{i}", i, x) for i, x in enumerate(texts[:4])], "query_id string, turn_id string, place int, text string")
    replies = spark.createDataFrame([("q", "o", "common things?", "a zebra and a quokka, common"), ("r", "o", None, None)], "query_id string, owner string, question string, reply string")
    (got,) = learned.used_by_reply(replies, shown, corpus).collect()
    assert got.turn_id == "t0" and abs(got.weight - 2 * math.log(64 / 3)) < 1e-5
    assert learned.used_by_reply(replies, shown, corpus, least=got.weight + 1).count() == 0


def test_distractors_count_a_session_once_across_spans(spark):
    rows = [(f"s{i % 40}", i, 10) for i in range(120)]
    sessions = spark.createDataFrame(rows, "session_id string, place long, size long")
    got = sorted((r.place, r.session_id, r.before) for r in learned.distractors(sessions, 255, span=7).collect())
    assert got == [(i, f"s{i}", 10 * i) for i in range(26)]


def test_last_said_takes_the_moment_itself_and_no_other_session(spark):
    turns = spark.sql("SELECT * FROM VALUES ('a', 'user', timestamp_ntz'2024-01-01 10:00:00'), ('a', 'assistant', timestamp_ntz'2024-01-01 10:05:00'), ('b', 'user', timestamp_ntz'2024-01-01 09:00:00') AS t(session_id, role, happened_at)")
    asks = spark.sql("SELECT * FROM VALUES (1, 'a', timestamp_ntz'2024-01-01 10:00:00'), (2, 'a', timestamp_ntz'2024-01-01 09:59:59'), (3, 'b', timestamp_ntz'2024-01-02 00:00:00'), (4, 'none', timestamp_ntz'2024-01-02 00:00:00') AS t(id, session_id, at)")
    got = {r.id: r.x for r in learned.last_said(turns, asks).select("id", F.date_format("last_at", "HH").alias("x")).collect()}
    assert got == {1: "10", 2: None, 3: "09", 4: None}


def test_turn_texts_of_a_session_with_a_header(spark):
    content = "SESSION_ID: 1\nSESSION_DATE: 2024-01-01\nTURN_1 [User]: hi\nTURN_2 is no label\n\nturn_2 [assistant]:  two\nlines \nTURN_3 [user]: "
    rows = spark.createDataFrame([("s", content), ("e", ""), ("n", None)], "session_id string, content string")
    got = [(r.turn_id, r.role, r.text) for r in learned.turn_texts(rows).collect()]
    assert got == [("TURN_1", "user", "hi\nTURN_2 is no label"), ("turn_2", "assistant", "two\nlines"), ("TURN_3", "user", "")]
    assert learned.turn_texts(rows, "assistant").count() == 1


def test_project_is_absent_only_if_all_ledgers_answer(spark):
    projects = spark.createDataFrame([(1,), (2,)], "project int")
    rows = spark.createDataFrame([("own", 1), ("own", 1), ("team", 1), ("far", 2)], "ledger string, project int")
    ledgers = spark.createDataFrame([("own", True), ("team", True), ("far", False)], "ledger string, reachable boolean")
    assert sorted(tuple(r) for r in learned.located(projects, ledgers, rows).collect()) == [(1, "found", 2), (2, "unknown", 0)]
    assert sorted(tuple(r) for r in learned.located(projects, ledgers.filter("reachable"), rows).collect()) == [(1, "found", 2), (2, "absent", 0)]
