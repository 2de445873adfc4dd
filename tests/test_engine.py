"""Unit cases of the recall engine."""

import json

from pyspark.sql import functions as F

from evidentia.functions import classify, dates, security
from evidentia.functions import text as tx
from evidentia.operators import evaluate, graph, memories, packing, sharing, turns, vectors
from evidentia.plans import typed
from evidentia.sources import transcripts
from evidentia.streaming import flows


def one(spark, column, **values):
    names = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], names).select(column.alias("x")).first()["x"]


def test_redaction(spark):
    say = "password: hunter2! and sk-ant-abcdefghijklmnop1234, card 4111 1111 1111 1111, not 4111 1111 1111 1112; token = \"a b c\""
    clean = one(spark, security.redact(F.col("t")), t=say)
    assert "hunter2" not in clean and "sk-ant" not in clean and "1111 1111 1111 1111" not in clean and "1111 1112" in clean and "a b c" not in clean
    assert one(spark, security.redact(F.col("t")), t="the password is stored in the vault") == "the password is stored in the vault"
    assert one(spark, security.redact(F.col("t")), t="url postgres://me:pw@host/db") == "url postgres://me:[REDACTED]@host/db"
    tokens = lambda t: one(spark, security.random_tokens(F.col("t")), t=t)
    assert tokens("see aB3xK9mQ2zR7wL5pT8vN, CamelCaseNamesAreWords12Here") == ["aB3xK9mQ2zR7wL5pT8vN"]
    assert tokens("123e4567-e89b-12d3-a456-426614174000 " + "ab12" * 10 + " short1A") == []
    assert one(spark, security.redact(F.col("t")), t="see aB3xK9mQ2zR7wL5pT8vN!") == "see [REDACTED_SECRET]!"
    assert one(spark, security.redact(F.col("t")), t="id 9-4111111111111111 card 4111111111111111") == "id 9-4111111111111111 card [REDACTED_CARD]"


def test_sealed_lines(spark):
    df = spark.createDataFrame([("line", "0123456789abcdef", "fedcba9876543210")], "t string, k string, other string")
    sealed = df.withColumn("s", security.seal(F.col("t"), F.col("k")))
    r = sealed.select(security.unseal(F.col("s"), F.col("k")).alias("ok"), security.unseal(F.col("s"), F.col("other")).alias("no")).first()
    assert r.ok == "line" and r.no is None


def test_sections():
    got = tx.sections_of("intro\n# A\ntext\n```\n# not a heading\n```\n## B\nmore\n# C\n" + "x\n\n" * 3)
    assert [h for h, _ in got] == ["", "A", "A > B", "C"]
    assert [h for h, _ in tx.sections_of("## X\na\n## Y\nb")] == ["X", "Y"]
    assert [h for h, _ in tx.sections_of("# A\na\n### B\nb\n### D ##\nd\n## E\ne")] == ["A", "A > B", "A > D", "A > E"]
    assert all(len(b) <= 20 for _, b in tx.sections_of("# A\n" + "word word\n\n" * 30, 20))


def test_nfkc(spark):
    assert spark.createDataFrame([("Ｆｕｌｌ ＷＩＤＴＨ-ß",)], "t string").select(tx.nfkc("t")).first()[0] == "full width ss"


def test_supersession_is_relative_to_what_is_visible(spark):
    rows = spark.createDataFrame([(1, "s", 1, 1, None), (2, "s", 2, 9, 1)], "memory_id long, scope string, effective_at long, known_at long, supersedes long")
    assert [r.memory_id for r in memories.current(rows, knowledge_cutoff=5).collect()] == [1]
    assert [r.memory_id for r in memories.current(rows).collect()] == [2]


def test_packing_limits(spark):
    rows = spark.createDataFrame([("q", i, ("conversation", "EPISODE", "s", "t", "title", "body " * n, "c", "a/b\\c.md")) for i, n in enumerate([10, 400, 3])], "query_id string, place int, item struct<kind:string,class:string,scope:string,at:string,title:string,content:string,source_type:string,source_ref:string>")
    r = packing.pack(rows, 400, short_sources=True).first()
    assert r.used_chars <= 400 and r.selected_items == 2 and r.context.endswith("Source: c / c.md") and "…[TRUNCATED]" in r.context


def test_activation_reaches_two_hops(spark):
    edges = spark.createDataFrame([(1, 2, "EXPLICIT", 1.0), (2, 3, "EXPLICIT", 1.0)], "source long, target long, relation string, weight double")
    start = spark.createDataFrame([("q", 1, 1.0)], "query_id string, engram_id long, activation double")
    got = {r.engram_id: r for r in graph.activate(start, edges, hops=2).collect()}
    assert abs(got[2].activation - 0.65) < 1e-9 and abs(got[3].activation - 0.65 * 0.65**2) < 1e-9 and got[3].parent == 2 and got[3].hop == 2


def test_pending_links(spark):
    e = spark.createDataFrame([(1, [2]), (2, [9])], "engram_id long, related array<long>")
    ready, pending = graph.explicit_links(e)
    assert [r.source for r in ready.collect()] == [1] and [r.target for r in pending.collect()] == [9]


def test_forget_then_import_again(spark):
    lines = spark.createDataFrame([("turn", "a", 0, 1), ("turn", "b", 0, 2), ("forget", "a", 1, 3)], "kind string, id string, device int, written_at int")
    landed, dead = sharing.merge_log(lines)
    assert [r.id for r in landed.collect()] == ["b"]
    assert sharing.merge_log(lines.filter("kind = 'turn'"), dead)[0].count() == 1


def test_chain_waits_for_its_target(spark):
    rows = spark.createDataFrame([(1, None), (2, 1), (3, 99), (4, 3)], "id long, supersedes long")
    ready, waiting = sharing.land_pending(rows, spark.createDataFrame([], "id long"))
    assert {r.id for r in ready.collect()} == {1, 2} and {r.id for r in waiting.collect()} == {3, 4}
    assert sharing.land_pending(rows, spark.createDataFrame([(99,)], "id long"))[1].count() == 0


def test_typed_guards(spark):
    e = spark.createDataFrame([(1, "a", 1.0, "u", 1), (1, "b", 2.0, "v", 1), (2, "a", 1.0, "u", 1), (2, "b", 3.0, "u", 1)], "k int, evidence_id string, numeric_value double, unit string, t int")
    assert {r.k: r.status for r in typed.sum_values(e, ["k"]).collect()} == {1: "UNKNOWN", 2: "ANSWER"}
    assert all(r.reason == "TIE" for r in typed.extreme(e, ["k"], "numeric_value", "t").collect())
    loop = {"operator": "COUNT", "use": ["a"], "operands": [{"name": "a", "after": "b"}, {"name": "b", "before": "a"}]}
    assert typed.audit_plan(loop) == ["CYCLIC_TIME_REFERENCE"]
    assert all(r.status == "UNKNOWN" for r in typed.compile_plan(loop, e, ["k"]).collect())


def test_date_phrases(spark):
    sunday = spark.createDataFrame([("last weekend",), ("jan 3",), ("two weeks ago",)], "p string").withColumn("a", F.lit("2023-05-28").cast("date"))
    got = [tuple(map(str, r.x)) for r in sunday.select(dates.resolve(F.col("p"), F.col("a")).alias("x")).collect()]
    assert got == [("2023-05-20", "2023-05-21"), ("2023-01-03", "2023-01-03"), ("2023-05-14", "2023-05-14")]


def test_router(spark):
    assert one(spark, classify.decide_recall(F.col("q"), "never"), q="how many").mode == "SKIP"
    assert one(spark, classify.durable(F.lit("user"), F.col("q")), q="우리 프로젝트의 목표는 속도다").category == "PROJECT_PRINCIPLE"


def test_mcnemar(spark):
    a = spark.createDataFrame([(i, i < 8) for i in range(10)], "query_id int, ok boolean")
    b = spark.createDataFrame([(i, i < 2) for i in range(10)], "query_id int, ok boolean")
    assert abs(evaluate.mcnemar(a, b) - 2 / 2**6) < 1e-12


def test_weights_prefer_the_telling_feature(spark):
    rows = [(q, i == 0, 1.0 if i == 0 else 0.0, float(i % 2)) for q in range(5) for i in range(4)]
    w = evaluate.fit_weights(spark.createDataFrame(rows, "query_id int, relevant boolean, good double, noise double"), ["good", "noise"], steps=5)
    assert w["good"] > abs(w["noise"])


def test_vector_cache_embeds_only_what_is_missing(spark, tmp_path):
    path = str(tmp_path / "cache")
    pieces = spark.createDataFrame([("a b",), ("c",), ("a b",)], "piece string")
    spark.createDataFrame([], "key string, embedding array<float>").write.parquet(path)
    embed = vectors.hashing_embedder(8)
    vectors.warm(pieces, path, embed, "m")
    vectors.warm(pieces, path, embed, "m")
    assert spark.read.parquet(path).count() == 2


def test_transcript_formats(spark, tmp_path):
    lines = [
        {"type": "user", "uuid": "1", "timestamp": "2024-01-01T10:00:00Z", "message": {"content": "hello token=abcdef123456"}},
        {"type": "assistant", "uuid": "2", "timestamp": "2024-01-01T10:01:00Z", "message": {"content": [{"type": "text", "text": "hi"}, {"type": "tool_use", "name": "x"}]}},
        {"type": "user", "uuid": "3", "isSidechain": True, "message": {"content": "side"}},
        {"type": "attachment", "attachment": {"type": "queued_command", "commandMode": "prompt", "prompt": "queued"}},
    ]
    (tmp_path / "s1.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\nnot json\n")
    got = transcripts.to_turns(transcripts.format_b(transcripts.lines(spark, str(tmp_path))), "b").collect()
    assert sorted((r.role, r.content) for r in got) == [("assistant", "hi"), ("user", "hello token=[REDACTED]"), ("user", "queued")]
    d = [{"role": "user", "message": {"content": [{"type": "text", "text": "<timestamp>Sunday, Oct 18, 2026, 2:46 PM (UTC+9)</timestamp><user_query> ask </user_query>"}]}}, {"role": "assistant", "message": {"content": [{"type": "text", "text": "answer"}]}}]
    folder = tmp_path / "d"
    folder.mkdir()
    (folder / "s2.jsonl").write_text("\n".join(map(json.dumps, d)) + "\n")
    got = transcripts.format_d(transcripts.lines(spark, str(folder))).orderBy("source_ordinal").collect()
    assert [(r.role, r.content) for r in got] == [("user", "ask"), ("assistant", "answer")] and got[1].said_at.startswith("2026-10-18T05:46")


def test_captured_stream_is_idempotent(spark, tmp_path):
    turns_df = spark.createDataFrame([("t1", "a"), ("t2", "b"), ("t1", "a")], "turn_id string, content string")
    turns_df.write.parquet(str(tmp_path / "in"))
    for run in ("one", "two"):
        stream = spark.readStream.schema(turns_df.schema).parquet(str(tmp_path / "in"))
        flows.capture(stream, str(tmp_path / "out"), str(tmp_path / run)).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_around_window(spark):
    assert one(spark, turns.around_window(F.col("w")), w="someday") is None
    w = one(spark, turns.around_window(F.col("w")), w="2024-01-10")
    assert str(w.since)[:10] == "2024-01-03" and str(w.until)[:10] == "2024-01-18"


def test_lines_have_byte_offsets_and_are_complete(spark, tmp_path):
    (tmp_path / "f.jsonl").write_bytes("é1\r\n\nlast\ntorn".encode())
    (tmp_path / "g.jsonl").write_text("x\n" * 50)
    want = {("f.jsonl", 0), ("f.jsonl", 5), ("f.jsonl", 6)} | {("g.jsonl", 2 * i) for i in range(50)}
    for size in ("7", "1000000"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        got = {(r.path.rsplit("/", 1)[1], r.offset) for r in transcripts.lines(spark, str(tmp_path)).collect()}
        assert got == want
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    stream = transcripts.lines(spark, str(tmp_path), stream=True).writeStream.format("memory").queryName("seen_lines").trigger(availableNow=True).start()
    stream.awaitTermination()
    assert {(r.path.rsplit("/", 1)[1], r.offset) for r in spark.table("seen_lines").collect()} == want


def test_a_text_may_start_like_an_array(spark, tmp_path):
    said = ["[ok] please do it", "[1]", [{"type": "text", "text": "[x]"}], [{"type": "image"}], "[INST] {"]
    (tmp_path / "s.jsonl").write_text("".join(json.dumps({"type": "user", "uuid": str(i), "message": {"content": c}}) + "\n" for i, c in enumerate(said)))
    got = {r.record_id: r.content for r in transcripts.format_b(transcripts.lines(spark, str(tmp_path))).collect()}
    assert got == {"0": "[ok] please do it", "1": "[1]", "2": "[x]", "3": "", "4": "[INST] {"}


def test_workspace_leaves_files_with_nul(spark, tmp_path):
    (tmp_path / "a.py").write_bytes(b"x = 1")
    (tmp_path / "b.py").write_bytes(bytes([0x10, 0x01, 0x00]) + b"x")
    (tmp_path / "c.py").write_bytes(b"p0p0" + bytes([0x50, 0x05]))
    assert sorted(r.path.rsplit("/", 1)[1] for r in transcripts.workspace(spark, str(tmp_path)).collect()) == ["a.py", "c.py"]


def test_preconditions_are_contained_phrases(spark):
    plans = spark.createDataFrame([(1, "cat"), (2, "Dog, house"), (3, "!!"), (4, "Engineer Manager"), (5, "x")], "plan_id int, phrase string")
    events = spark.createDataFrame([("Concatenate the dog-house",), (None,), ("Engineer",)], "object_text string")
    assert sorted(r.plan_id for r in classify.missing_preconditions(plans, events).collect()) == [4, 5]


def test_stem(spark):
    words = "running graduated boxes cats bake king used loves".split()
    assert one(spark, F.array_join(F.transform(F.split("t", " "), tx.stem), " "), t=" ".join(words)) == "runn graduat box cats bake king used lov"


def test_recent_prefers_named(spark):
    rows = spark.createDataFrame([(i, i, int(i in (2, 3))) for i in range(9)], "memory_id int, effective_at int, named int")
    assert [r.memory_id for r in memories.recent(rows, 3).collect()] == [3, 2]
    assert [r.memory_id for r in memories.recent(rows.filter("named = 0"), 3).collect()] == [8, 7, 6]
