"""Query catalogue, sixth part: state intake, passages, sentences, recalled engrams, bounds, clocks and keys."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from evidentia.catalogue import SQL as SEARCH_SQL
from evidentia.catalogue import TURNS, _edges
from evidentia.functions import dates, security
from evidentia.functions import text as tx
from evidentia.operators import evaluate, graph, history, learned, passages, state_intake, turns as tn, vectors
from evidentia.sources import tables as t

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def vector_sql(name: str, keys: str, source: str, text: str) -> str:
    """CTEs name (keys, d, x) and name_n (keys, n): the hashing embedder's counts of a text by dimension, and their length."""
    return f"""{name} AS (SELECT {keys}, ('0x' || h[1:6])::INT % 64 AS d, sum(CASE WHEN h[7] >= '8' THEN 1.0::DOUBLE ELSE -1 END) AS x FROM (SELECT {keys}, md5(w) AS h FROM (SELECT {keys}, unnest(string_split_regex(lower({text}), '[ \\t\\n\\x0b\\f\\r]+')) AS w FROM {source}) WHERE w <> '') GROUP BY ALL),
{name}_n AS (SELECT {keys}, sqrt(sum(x * x)) AS n FROM {name} GROUP BY ALL)"""


# ---- state intake ------------------------------------------------------------------------------

_INTAKE = """b AS (SELECT conv_id * 100 + turn AS id, conv_id, turn, role, conv_id || '-' || turn AS turn_id, '2024-03-' || lpad((conv_id % 28 + 1)::VARCHAR, 2, '0') || 'T' || lpad(turn::VARCHAR, 2, '0') || ':30' AS stamp, text FROM conversations),
s AS (SELECT *, stamp || ' ' || text AS said FROM b),
c AS (SELECT *, CASE id % 11 WHEN 0 THEN 'PLAN' WHEN 1 THEN 'CORRECTION' WHEN 2 THEN 'WISH' ELSE CASE WHEN id % 2 = 0 THEN 'OBSERVATION' ELSE 'STATE_CHANGE' END END AS kind,
  substring(said, 1, CASE WHEN id % 13 = 5 THEN 40 ELSE 90 END) AS support_quote, substring(said, 18, 20) AS subject_text, CASE WHEN id % 17 <> 3 THEN substring(said, 40, 20) END AS value_text,
  CASE WHEN id % 5 <> 4 THEN 'SESSION_OBSERVATION' END AS time_kind, CASE WHEN id % 19 = 7 THEN '2024-01-01T00:00' WHEN id % 23 = 9 THEN 'soon' ELSE stamp[1:11] || lpad((turn + 1)::VARCHAR, 2, '0') || ':45' END AS known_at FROM s),
f AS (SELECT *, sha256(to_json({'kind': kind, 'known_at': known_at, 'subject_text': subject_text, 'support_quote': support_quote, 'time_kind': time_kind, 'turn_id': turn_id, 'value_text': value_text})::VARCHAR) AS sha FROM c),
g AS (SELECT *, id % 29 <> 4 AS granted, CASE WHEN id % 31 = 6 THEN 'x' ELSE sha END AS g_sha, CASE WHEN id % 37 = 8 THEN '' ELSE 'e' || conv_id END AS entity_id,
  CASE WHEN id % 41 = 0 THEN 'KNOWS' WHEN id % 12 = 1 THEN 'LIVES_AT' ELSE (['LOCATED_AT', 'PRIMARY_RESIDENCE', 'PRIMARY_WORKPLACE', 'PRIMARY_VEHICLE_TYPE'])[id % 4 + 1] END AS relation,
  id % 47 <> 11 AS has_value, id % 43 = 10 AS far_value, kind = 'STATE_CHANGE' AND id % 3 <> 0 AS has_time, CASE WHEN id % 53 = 12 THEN 'Monday' ELSE stamp END AS valid_from,
  CASE WHEN id % 59 = 13 THEN 'later' ELSE stamp END AS session_timestamp, id % 61 <> 14 AS same_source FROM f),
x AS (SELECT *, substring(said, 1, 90) AS c_text, substring(said, 21, 6) AS s_text, CASE WHEN far_value THEN substring(said, 96, 5) ELSE substring(said, 46, 7) END AS v_text, role <> 'user' AS foreign_role, try_strptime(known_at, '%Y-%m-%dT%H:%M') AS rec, try_strptime(valid_from, '%Y-%m-%dT%H:%M') AS val, try_strptime(stamp, '%Y-%m-%dT%H:%M') AS obs FROM g),
r AS (SELECT *, list_sort(list_distinct(list_filter([
  CASE WHEN g_sha <> sha THEN 'CANDIDATE_GRANT_MISMATCH' END, CASE WHEN NOT same_source THEN 'SOURCE_SCOPE_GRANT_MISMATCH' END, CASE WHEN entity_id = '' THEN 'ENTITY_ID_REQUIRED' END,
  CASE WHEN relation = 'KNOWS' THEN 'UNSUPPORTED_STATE_RELATION' END, CASE WHEN relation = 'LIVES_AT' THEN 'MULTI_VALUE_EXECUTOR_REQUIRED' END, CASE WHEN NOT has_value THEN 'SOURCE_SPAN_NOT_RESTORABLE' END,
  CASE WHEN foreign_role THEN 'SPAN_SOURCE_ROLE_SCOPE_MISMATCH' END, CASE WHEN c_text <> support_quote THEN 'CONTEXT_CLAIM_MISMATCH' END, CASE WHEN has_value AND far_value THEN 'ATOM_OUTSIDE_CLAIM_CONTEXT' END,
  CASE WHEN NOT contains(subject_text, s_text) OR (has_value AND NOT contains(coalesce(value_text, ''), v_text)) THEN 'ATOM_CANDIDATE_MISMATCH' END, CASE WHEN rec IS NULL THEN 'INVALID_KNOWLEDGE_TIMESTAMP' END,
  CASE WHEN kind = 'STATE_CHANGE' AND (NOT has_time OR valid_from <> stamp) THEN 'LITERAL_VALID_INSTANT_REQUIRED' END, CASE WHEN kind = 'STATE_CHANGE' AND val IS NULL THEN 'VALID_TIME_UNRESOLVED' END, CASE WHEN kind = 'STATE_CHANGE' AND val > rec THEN 'STATE_CHANGE_AFTER_RECORDING' END,
  CASE WHEN kind = 'OBSERVATION' AND (time_kind IS NULL OR session_timestamp <> stamp) THEN 'CURRENT_SOURCE_OBSERVATION_BINDING_REQUIRED' END, CASE WHEN kind = 'OBSERVATION' AND obs > rec THEN 'OBSERVATION_AFTER_RECORDING' END], lambda v: v IS NOT NULL))) AS held FROM x),
d AS (SELECT *, CASE WHEN kind = 'PLAN' THEN 'CONTROL_EVIDENCE_ONLY' WHEN kind = 'CORRECTION' THEN 'TARGET_REVIEW_REQUIRED' WHEN kind = 'WISH' OR NOT granted OR len(held) > 0 THEN 'HOLD' ELSE 'READY_FOR_TRUSTED_APPEND' END AS disposition FROM r)"""


@query("state_intake", f"""WITH {_INTAKE} SELECT id AS candidate_id, disposition,
  CASE WHEN kind = 'PLAN' THEN 'INTENTION_DOES_NOT_MUTATE_STATE' WHEN kind = 'CORRECTION' THEN 'EXPLICIT_RECORD_TARGET_AND_REVISION_REQUIRED' WHEN kind = 'WISH' THEN 'UNSUPPORTED_OR_AMBIGUOUS_MODE' WHEN NOT granted THEN 'TRUSTED_SOURCE_SEMANTIC_IDENTITY_GRANT_REQUIRED' ELSE array_to_string(held, ',') END AS reasons,
  CASE WHEN disposition = 'READY_FOR_TRUSTED_APPEND' THEN 'state_' || sha256(to_json({{'candidate': {{'kind': kind, 'known_at': known_at, 'subject_text': subject_text, 'support_quote': support_quote, 'time_kind': time_kind, 'turn_id': turn_id, 'value_text': value_text}},
    'entity_id': entity_id, 'memory_id': 'm' || (conv_id % 4), 'observed_at': CASE WHEN kind = 'OBSERVATION' THEN stamp END, 'relation': relation, 'source_id': conv_id::VARCHAR, 'valid_from': CASE WHEN kind = 'STATE_CHANGE' THEN valid_from END, 'value': v_text}})::VARCHAR) END AS evidence_id,
  CASE WHEN disposition = 'READY_FOR_TRUSTED_APPEND' THEN v_text END AS object_text FROM d""")
def state_intake_query(spark, d):
    """Every conversation turn as a candidate whose grant, spans and source are made from it, some of them wrong by a rule on its id."""
    base = t.read(spark, d, "conversations")
    i = F.col("id")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    rows = base.select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "conv_id", "turn", "role", F.concat_ws("-", "conv_id", "turn").alias("turn_id"), F.concat(F.lit("2024-03-"), two(F.col("conv_id") % 28 + 1), F.lit("T"), two(F.col("turn")), F.lit(":30")).alias("stamp"), "text")
    rows = rows.withColumn("said", F.concat(F.col("stamp"), F.lit(" "), F.col("text")))
    part = lambda a, n: F.substring("said", a, n)
    rows = rows.withColumns(
        {
            "kind": F.when(i % 11 == 0, "PLAN").when(i % 11 == 1, "CORRECTION").when(i % 11 == 2, "WISH").when(i % 2 == 0, "OBSERVATION").otherwise("STATE_CHANGE"),
            "support_quote": F.when(i % 13 == 5, part(1, 40)).otherwise(part(1, 90)),
            "subject_text": part(18, 20),
            "value_text": F.when(i % 17 != 3, part(40, 20)),
            "time_kind": F.when(i % 5 != 4, "SESSION_OBSERVATION"),
            "known_at": F.when(i % 19 == 7, "2024-01-01T00:00").when(i % 23 == 9, "soon").otherwise(F.concat(F.left("stamp", F.lit(11)), two(F.col("turn") + 1), F.lit(":45"))),
        }
    )
    candidates = rows.select(i.alias("candidate_id"), *state_intake._CLAIM)
    memory, source = F.concat(F.lit("m"), F.col("conv_id") % 4), F.col("conv_id").cast("string")
    at = lambda name: F.concat(i.cast("string"), F.lit(name))
    single = F.try_element_at(F.array(*map(F.lit, state_intake.SINGLE)), (i % 4 + 1).cast("int"))
    grants = rows.filter(i % 29 != 4).select(
        i.alias("candidate_id"),
        F.when(i % 31 == 6, "x").otherwise(state_intake.claim_fingerprint()).alias("candidate_sha256"),
        memory.alias("memory_id"),
        source.alias("source_id"),
        F.when(i % 37 == 8, "").otherwise(F.concat(F.lit("e"), source)).alias("entity_id"),
        F.when(i % 41 == 0, "KNOWS").when(i % 12 == 1, "LIVES_AT").otherwise(single).alias("relation"),
        at("c").alias("context_span_id"),
        at("s").alias("subject_span_id"),
        F.when(i % 47 == 11, "none").otherwise(at("v")).alias("value_span_id"),
        F.when((F.col("kind") == "STATE_CHANGE") & (i % 3 != 0), at("t")).alias("time_span_id"),
        F.lit("semantics").alias("semantics_attestation_id"),
        F.lit("identity").alias("identity_attestation_id"),
        F.when(i % 53 == 12, "Monday").otherwise(F.col("stamp")).alias("valid_from"),
        F.col("stamp").alias("observed_at"),
        F.lit("seen").alias("observation_attestation_id"),
    )
    span = lambda name, a, n: F.struct(at(name).alias("span_id"), F.lit(a).alias("start"), F.lit(a + n).alias("end"), part(a + 1, n).alias("text"))
    value = F.when(i % 43 == 10, span("v", 95, 5)).otherwise(span("v", 45, 7))
    spans = rows.select(memory.alias("memory_id"), source.alias("session_id"), F.col("turn_id").alias("source_turn_id"), F.col("role").alias("source_role"), F.explode(F.array(span("c", 0, 90), span("s", 20, 6), value, span("t", 0, 16))).alias("x")).select("memory_id", "session_id", "source_turn_id", "source_role", "x.*")
    sources = rows.select(i.alias("candidate_id"), F.when(i % 61 == 14, "other").otherwise(memory).alias("memory_id"), source.alias("source_id"), F.when(i % 59 == 13, "later").otherwise(F.col("stamp")).alias("session_timestamp"))
    out = state_intake.compile_intake(candidates, grants, spans, sources)
    return out.select("candidate_id", "disposition", F.array_join("reasons", ",").alias("reasons"), F.col("event.evidence_id").alias("evidence_id"), F.col("event.object_text").alias("object_text"))


# ---- passages and sentences --------------------------------------------------------------------

_PASSAGES = f"""qs AS (SELECT item_id AS query_id, text AS question, list_filter([CASE WHEN item_id % 2 = 0 THEN 'add_to_cart click' END, CASE WHEN item_id % 3 = 0 THEN 'purchase' END, split_part(text, ' ', 2), CASE WHEN item_id % 5 < 3 THEN 'page_view' END], lambda e: e IS NOT NULL) AS entities FROM benchmark),
vw AS (SELECT query_id, ([question] || list_filter(list_transform(entities, lambda e: trim(replace(e, '_', ' '))), lambda e: e <> '' AND NOT contains(lower(question), lower(e))))[1:4] AS vs FROM qs),
views AS (SELECT query_id, i - 1 AS view_no, vs[i] AS view FROM (SELECT query_id, vs, unnest(range(1, len(vs) + 1)) AS i FROM vw)),
ev AS (SELECT event_id % 40 AS query_id, event_id, (event_id % 40 + 40 * (event_id // 40 % 3))::VARCHAR AS session_id, [event_id % 5, event_id % 7] AS cites, trim(event_type || ' ' || props || ' ' || value) AS told FROM events),
{vector_sql("vv", "query_id, view_no", "views", "view")}, {vector_sql("ee", "query_id, event_id", "ev", "told")},
vd AS (SELECT query_id, view_no, event_id, sum(vv.x * ee.x) AS dot FROM vv JOIN ee USING (query_id, d) GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id, view_no ORDER BY similarity DESC, event_id) - 1 AS rank FROM (SELECT v.query_id, v.view_no, e.event_id, round(CASE WHEN vn.n > 0 AND en.n > 0 THEN coalesce(dot, 0) / (vn.n * en.n) ELSE 0 END, 9) AS similarity
  FROM views v JOIN ev e USING (query_id) LEFT JOIN vv_n vn USING (query_id, view_no) LEFT JOIN ee_n en ON en.query_id = v.query_id AND en.event_id = e.event_id LEFT JOIN vd ON vd.query_id = v.query_id AND vd.view_no = v.view_no AND vd.event_id = e.event_id)),
ch AS (SELECT query_id, event_id, row_number() OVER (PARTITION BY query_id ORDER BY first, event_id) AS place FROM (SELECT query_id, event_id, min((view_no, rank)) AS first FROM rk WHERE rank < CASE WHEN view_no = 0 THEN 20 ELSE 5 END GROUP BY ALL)),
ct AS (SELECT query_id, session_id, turn, min((place, nth)) AS first FROM (SELECT ch.query_id, ch.place, ev.session_id, unnest([1, 2]) AS nth, unnest(cites) AS turn FROM ch JOIN ev USING (query_id, event_id)) GROUP BY ALL),
tx AS (SELECT conv_id::VARCHAR AS session_id, turn, trim(text) AS text FROM conversations WHERE text <> ''),
se AS (SELECT conv_id % 40 AS query_id, conv_id::VARCHAR AS session_id, strftime(TIMESTAMP '2024-01-01' + to_days((conv_id * 7 % 50)::INT), '%Y-%m-%d') AS session_date, string_agg('TURN_' || turn || ' [' || role || ']: ' || text, chr(10) ORDER BY turn) AS content FROM conversations GROUP BY conv_id),
an AS (SELECT ct.query_id, 0 AS kind, row_number() OVER (PARTITION BY ct.query_id ORDER BY first) AS place, session_id, 'TURN_' || turn AS turn_id, substring(text, 1, 500) AS text FROM ct JOIN tx USING (session_id, turn)),
wn AS (SELECT query_id, session_id, s AS start, substring(content, s + 1, 600) AS text FROM (SELECT *, unnest(range(0, greatest(len(content), 1), 300)) AS s FROM se) WHERE s < greatest(1, len(content) - 300) AND len(trim(substring(content, s + 1, 600))) > 0),
{vector_sql("ww", "query_id, session_id, start", "wn", "text")},
wd AS (SELECT query_id, session_id, start, sum(vv.x * ww.x) AS dot FROM vv JOIN ww USING (query_id, d) WHERE view_no = 0 GROUP BY ALL),
nr AS (SELECT query_id, 1 AS kind, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, session_id, start) AS place, session_id, NULL AS turn_id, text FROM (SELECT w.query_id, w.session_id, w.start, w.text, round(CASE WHEN wnn.n > 0 AND vn.n > 0 THEN coalesce(dot, 0) / (wnn.n * vn.n) ELSE 0 END, 9) AS similarity
  FROM wn w JOIN (SELECT query_id FROM qs) USING (query_id) LEFT JOIN ww_n wnn USING (query_id, session_id, start) LEFT JOIN vv_n vn ON vn.query_id = w.query_id AND vn.view_no = 0 LEFT JOIN wd ON wd.query_id = w.query_id AND wd.session_id = w.session_id AND wd.start = w.start)),
al AS (SELECT * FROM an UNION ALL SELECT * FROM nr WHERE place <= 3)"""


@query("evidence_passages", f"""WITH {_PASSAGES} SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY session_date, kind, place) AS place, session_id, session_date, turn_id, text FROM al JOIN se USING (query_id, session_id)""")
def evidence_passages(spark, d):
    """Benchmark items ask the conversations and events of their number; each event cites two turns of a conversation."""
    i, e, c = F.col("item_id"), F.col("event_id"), F.col("conv_id")
    entities = F.array_compact(F.array(F.when(i % 2 == 0, "add_to_cart click"), F.when(i % 3 == 0, "purchase"), F.split_part("text", F.lit(" "), F.lit(2)), F.when(i % 5 < 3, "page_view")))
    questions = t.read(spark, d, "benchmark").select(i.alias("query_id"), F.col("text").alias("question"), entities.alias("entities"))
    name = lambda n: F.concat(F.lit("TURN_"), n.cast("string"))
    session = (e % 40 + 40 * F.expr("event_id div 40 % 3")).cast("string")
    events = t.read(spark, d, "events").select((e % 40).alias("query_id"), "event_id", session.alias("session_id"), F.array(name(e % 5), name(e % 7)).alias("source_turn_ids"), passages.event_text(F.col("event_type"), F.col("props"), F.col("value").cast("string")).alias("text"))
    said = t.read(spark, d, "conversations")
    turns = said.select(c.cast("string").alias("session_id"), name(F.col("turn")).alias("turn_id"), "text")
    block = F.concat(name(F.col("turn")), F.lit(" ["), F.col("role"), F.lit("]: "), F.col("text"))
    held = said.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", block.alias("b")))).alias("bs"))
    day = F.date_format(F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(cast(conv_id * 7 % 50 as int), 0, 0, 0)"), "yyyy-MM-dd")
    sessions = held.select((c % 40).alias("query_id"), c.cast("string").alias("session_id"), day.alias("session_date"), F.array_join("bs.b", "\n").alias("content"))
    return passages.evidence_passages(questions, sessions, events, turns, vectors.hashing_embedder())


@query("sentence_turns", f"""WITH {TURNS}, q AS (SELECT item_id AS query_id, text AS query FROM benchmark),
tiles AS (SELECT turn_id, revision, content, i, ts[i] AS tile FROM (SELECT turn_id, revision, content, ts, unnest(range(1, len(ts) + 1)) AS i FROM (SELECT *, regexp_extract_all(content, '[^.!?\\n]+[.!?]*|[.!?\\n]+') AS ts FROM turns))),
placed AS (SELECT *, coalesce(sum(len(tile)) OVER (PARTITION BY turn_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM tiles),
st AS (SELECT turn_id, revision, start, substring(trim(tile, ' ' || chr(9) || chr(11) || chr(12) || chr(13) || chr(160)), 1, 300) AS sentence FROM placed WHERE tile[1] NOT IN ('.', '!', '?', chr(10)) AND len(trim(tile, ' ' || chr(9) || chr(11) || chr(12) || chr(13) || chr(160))) >= 15),
{vector_sql("ss", "turn_id, start", "st", "sentence")}, {vector_sql("qq", "query_id", "q", "query")},
dots AS (SELECT query_id, turn_id, start, sum(ss.x * qq.x) AS dot FROM qq JOIN ss USING (d) GROUP BY ALL),
sm AS (SELECT q.query_id, st.turn_id, st.revision, st.start, round(CASE WHEN sn.n > 0 AND qn.n > 0 THEN coalesce(dot, 0) / (sn.n * qn.n) ELSE 0 END, 9) AS similarity FROM q CROSS JOIN st LEFT JOIN ss_n sn USING (turn_id, start) LEFT JOIN qq_n qn USING (query_id) LEFT JOIN dots ON dots.query_id = q.query_id AND dots.turn_id = st.turn_id AND dots.start = st.start),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, revision, start, turn_id) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id, turn_id ORDER BY similarity DESC, start) AS n FROM sm) WHERE n = 1)
SELECT query_id, turn_id, place, greatest(0, b.start - 150)::BIGINT AS start, len(substring(content, greatest(0, b.start - 150)::BIGINT + 1, 500)) AS n_chars FROM b JOIN turns USING (turn_id) WHERE place <= 20""")
def sentence_turns(spark, d):
    embed, asked = vectors.hashing_embedder(), t.questions(spark, d)
    found = vectors.best_sentences(t.turns(spark, d), asked.select("query_id", embed("query").alias("embedding")), embed, k=20)
    return found.select("query_id", "turn_id", "place", F.col("start").cast("long").alias("start"), F.length("text").cast("long").alias("n_chars"))


# ---- engrams -----------------------------------------------------------------------------------


@query("engrams_recalled", SEARCH_SQL["activation_2hop"].replace("SELECT query_id, engram_id, round(a, 6) AS activation FROM (SELECT *, row_number()", "SELECT query_id, engram_id, round(a, 6) AS activation, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(a * (0.5 + p_size / 100.0::DOUBLE), 12) DESC, engram_id) AS place FROM (SELECT *, row_number()").replace("FROM m2) WHERE n <= 40", "FROM m2) JOIN part ON p_partkey = engram_id WHERE n <= 40) WHERE place <= 8"))
def engrams_recalled(spark, d):
    """The two questions' activated engrams by activation and strength; paths are held by tests."""
    asked = spark.sql("SELECT * FROM VALUES (0, array('small', 'ring', 'economy')), (1, array('red', 'widget', 'small')) v(query_id, terms)")
    engrams = t.engrams(spark, d)
    state = graph.activate(graph.seeds(engrams, asked, limit=12), _edges(spark, d), hops=2, fanout=12, max_nodes=40)
    return graph.recalled(state, engrams, limit=8).select("query_id", "engram_id", F.round("activation", 6).alias("activation"), "place")


# ---- bounds, clocks, keys ----------------------------------------------------------------------


@query("turns_between", f"""WITH {TURNS}, w AS (SELECT * FROM (VALUES ('a', TIMESTAMP '2024-01-20 00:03:00', TIMESTAMP '2024-02-10 00:02:00'), ('b', NULL, TIMESTAMP '2024-01-15'), ('c', TIMESTAMP '2024-03-01', NULL)) v(bound, since, until))
SELECT bound, turn_id, (until IS NULL OR happened_at < until) AS by_meaning FROM w JOIN turns ON (since IS NULL OR happened_at >= since) AND (until IS NULL OR happened_at <= until)""")
def turns_between(spark, d):
    """Turns inside three pairs of bounds; word search takes the end in, meaning search leaves it out."""
    turns, out = t.turns(spark, d), None
    at = lambda s: None if s is None else F.lit(s).cast("timestamp_ntz")
    for name, since, until in (("a", "2024-01-20 00:03:00", "2024-02-10 00:02:00"), ("b", None, "2024-01-15 00:00:00"), ("c", "2024-03-01 00:00:00", None)):
        words = tn.between(turns, at(since), at(until)).select(F.lit(name).alias("bound"), "turn_id")
        meaning = tn.between(turns, at(since), at(until), until_inclusive=False).select("turn_id", F.lit(True).alias("_in"))
        rows = words.join(meaning, "turn_id", "left").select("bound", "turn_id", F.coalesce("_in", F.lit(False)).alias("by_meaning"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("bounds_widened", """WITH o AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d 13:05:00') WHEN 2 THEN 'last ' || strftime(o_orderdate, '%Y') ELSE NULL END AS b, o_orderdate FROM orders)
SELECT o_orderkey, strftime(CASE WHEN o_orderkey % 4 = 0 THEN o_orderdate WHEN o_orderkey % 4 = 1 THEN o_orderdate + INTERVAL '13 hours 5 minutes' END, '%Y-%m-%d %H:%M:%S') AS since, strftime(CASE WHEN o_orderkey % 4 = 0 THEN o_orderdate + INTERVAL '23 hours 59 minutes 59 seconds' WHEN o_orderkey % 4 = 1 THEN o_orderdate + INTERVAL '13 hours 5 minutes' END, '%Y-%m-%d %H:%M:%S') AS until FROM o""")
def bounds_widened(spark, d):
    day, k = F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_orderkey")
    text = F.when(k % 4 == 0, day).when(k % 4 == 1, F.concat(day, F.lit(" 13:05:00"))).when(k % 4 == 2, F.concat(F.lit("last "), F.year("o_orderdate")))
    shown = lambda end: F.date_format(dates.widen(text, end=end), "yyyy-MM-dd HH:mm:ss")
    return t.read(spark, d, "orders").select("o_orderkey", shown(False).alias("since"), shown(True).alias("until"))


@query("clocks_read", """WITH e AS (SELECT event_id, event_id % 2 = 0 AS utc, CASE WHEN event_id % 5 = 4 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') END || CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'Z' ELSE '+02:00' END AS said, ts FROM events)
SELECT event_id, strftime(CASE WHEN event_id % 5 <> 4 AND ((event_id % 3 <> 0) = utc) THEN date_trunc('second', ts) - CASE WHEN event_id % 3 = 2 THEN INTERVAL '2 hours' ELSE INTERVAL '0 hours' END END, '%Y-%m-%d %H:%M:%S') AS moment FROM e""")
def clocks_read(spark, d):
    e = F.col("event_id")
    stamp = F.when(e % 5 == 4, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    said = F.concat(stamp, F.when(e % 3 == 0, "").when(e % 3 == 1, "Z").otherwise("+02:00"))
    clock = F.when(e % 2 == 0, "UTC").otherwise("SOURCE_LOCAL")
    return t.read(spark, d, "events").select("event_id", F.date_format(dates.clocked(said, clock), "yyyy-MM-dd HH:mm:ss").alias("moment"))


@query("dates_enriched", """WITH o AS (SELECT o_orderkey, o_orderdate::DATE AS d, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 7 - 3 END AS n, CASE WHEN o_orderkey % 5 = 1 THEN o_orderdate::DATE - 400 END AS v FROM orders)
SELECT o_orderkey, strftime(coalesce(v, CASE WHEN n IS NOT NULL THEN d + n::INT WHEN o_orderkey % 2 = 0 THEN d - 1 END), '%Y-%m-%d') AS date_value, strftime(CASE WHEN v IS NULL THEN CASE WHEN n IS NOT NULL THEN d + n::INT WHEN o_orderkey % 2 = 0 THEN d - 1 END END, '%Y-%m-%d') AS date_end FROM o""")
def dates_enriched(spark, d):
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    rows = t.read(spark, d, "orders").select("o_orderkey", day.alias("session_date"), F.when(k % 3 == 0, (k % 7 - 3).cast("int")).alias("time_offset_count"), F.lit("day").alias("time_offset_unit"), F.when(k % 2 == 0, "the day yesterday, I think").alias("effective_time_text"), F.when(k % 5 == 1, F.date_sub(day, 400)).alias("date_value"), F.lit(None).cast("date").alias("date_end"))
    out = dates.enrich(rows)
    return out.select("o_orderkey", F.date_format("date_value", "yyyy-MM-dd").alias("date_value"), F.date_format("date_end", "yyyy-MM-dd").alias("date_end"))


@query("fact_keys", """SELECT p_partkey, trim(regexp_replace(lower(p_brand || '--' || p_name), '[^\\p{L}\\p{N}_]+', ' ', 'g')) || '|' || trim(regexp_replace(lower(' ' || p_type || '!'), '[^\\p{L}\\p{N}_]+', ' ', 'g')) AS fact, regexp_replace(replace(CASE WHEN p_partkey % 2 = 0 THEN 'C:' || chr(92) || p_name || chr(92) || p_partkey || '.md' ELSE '/x/' || p_name || '/' || p_partkey || '.md' END, chr(92), '/'), '^.*/', '') AS file FROM part""")
def fact_keys(spark, d):
    k = F.col("p_partkey")
    path = F.when(k % 2 == 0, F.concat_ws("\\", F.lit("C:"), "p_name", F.concat(k, F.lit(".md")))).otherwise(F.concat_ws("/", F.lit("/x"), "p_name", F.concat(k, F.lit(".md"))))
    return t.read(spark, d, "part").select("p_partkey", tx.fact_key(F.concat_ws("--", "p_brand", "p_name"), F.concat(F.lit(" "), "p_type", F.lit("!"))).alias("fact"), tx.file_name(path).alias("file"))


@query("previews", """SELECT event_id, regexp_replace(regexp_replace(said, '[^ \\t\\n\\r\\f\\x0b]*[0-9@][^ \\t\\n\\r\\f\\x0b]*', '■', 'g'), '"[^"\\n]*"|''[^''\\n]*''', '■', 'g') AS preview FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_type || ' by user' || user_id || ' says "' || event_type || '" now' WHEN 1 THEN 'mail ' || event_type || '@site.org about it' ELSE 'plain ' || event_type END AS said FROM events)""".replace("""'"[^"\\n]*"|''[^''\\n]*''', '■'""", """'"[^"\\n]*"', '"■"'"""))
def previews(spark, d):
    e, kind = F.col("event_id"), F.col("event_type")
    said = F.when(e % 3 == 0, F.concat(kind, F.lit(" by user"), F.col("user_id"), F.lit(' says "'), kind, F.lit('" now'))).when(e % 3 == 1, F.concat(F.lit("mail "), kind, F.lit("@site.org about it"))).otherwise(F.concat(F.lit("plain "), kind))
    return t.read(spark, d, "events").select("event_id", security.preview(said).alias("preview"))


# ---- evaluation, repair, ledgers -----------------------------------------------------------------


@query("recall_at_100", """WITH r AS (SELECT event_id % 25 AS query_id, event_id AS doc, row_number() OVER (PARTITION BY event_id % 25 ORDER BY md5(event_id::VARCHAR)) AS place FROM events),
j AS (SELECT event_id % 25 AS query_id, event_id AS doc, (event_type = 'purchase')::INT + (value > 90)::INT AS gain FROM events)
SELECT query_id, round(avg((place <= 100)::INT), 9) AS recall FROM j JOIN r USING (query_id, doc) WHERE gain > 0 GROUP BY query_id""")
def recall_at_100(spark, d):
    e = t.read(spark, d, "events").withColumn("query_id", F.col("event_id") % 25).withColumnRenamed("event_id", "doc")
    ranked = e.select("query_id", "doc", F.row_number().over(Window.partitionBy("query_id").orderBy(F.md5(F.col("doc").cast("string")))).alias("place"))
    gain = (F.col("event_type") == "purchase").cast("int") + (F.col("value") > 90).cast("int")
    return evaluate.recall_at(ranked, e.select("query_id", "doc", gain.alias("gain"))).select("query_id", F.round("recall", 9).alias("recall"))


@query("deletions_repaired", """WITH c AS (SELECT l_orderkey * 10 + l_linenumber AS change_id, l_suppkey % 20 AS project_id, 'f' || (l_partkey % 400) AS file_path, CASE WHEN l_linenumber % 3 = 0 THEN 'DELETED' ELSE 'MODIFIED' END AS change_kind, l_orderkey * 10 + l_linenumber AS revision FROM lineitem),
p AS (SELECT DISTINCT p_partkey % 20 AS project_id, 'f' || (p_partkey % 400) AS file_path FROM part WHERE p_size > 20),
w AS (SELECT change_id FROM (SELECT *, max(revision) OVER (PARTITION BY project_id, file_path) AS last FROM c) JOIN p USING (project_id, file_path) WHERE revision = last AND change_kind = 'DELETED')
SELECT project_id, count(*) AS changes, count(*) FILTER (change_kind = 'DELETED') AS deletions FROM c WHERE change_id NOT IN (SELECT change_id FROM w) GROUP BY project_id""")
def deletions_repaired(spark, d):
    key, file = F.col("l_orderkey") * 10 + F.col("l_linenumber"), lambda c: F.concat(F.lit("f"), F.col(c) % 400)
    changes = t.read(spark, d, "lineitem").select(key.alias("change_id"), (F.col("l_suppkey") % 20).alias("project_id"), file("l_partkey").alias("file_path"), F.when(F.col("l_linenumber") % 3 == 0, "DELETED").otherwise("MODIFIED").alias("change_kind"), key.alias("revision"))
    present = t.read(spark, d, "part").filter("p_size > 20").select((F.col("p_partkey") % 20).alias("project_id"), file("p_partkey").alias("file_path"))
    left, _ = history.repaired(changes, present)
    return left.groupBy("project_id").agg(F.count(F.lit(1)).alias("changes"), F.count_if(F.col("change_kind") == "DELETED").alias("deletions"))


_LEDGERS = """l AS (SELECT n_nationkey AS ledger, n_regionkey * 100 - n_nationkey AS rank, n_nationkey % 6 <> 2 AS reachable FROM nation),
r AS (SELECT c_nationkey AS ledger, c_custkey % 37 AS project, c_custkey // 3 AS row_id, c_name AS said FROM customer)"""


def _ledgers(spark, d):
    n = F.col("n_nationkey")
    ledgers = t.read(spark, d, "nation").select(n.alias("ledger"), (F.col("n_regionkey") * 100 - n).alias("rank"), (n % 6 != 2).alias("reachable"))
    return ledgers, t.read(spark, d, "customer").select(F.col("c_nationkey").alias("ledger"), (F.col("c_custkey") % 37).alias("project"), F.expr("c_custkey div 3").alias("row_id"), F.col("c_name").alias("said"))


@query("ledger_chosen", f"""WITH {_LEDGERS}, p AS (SELECT DISTINCT s_suppkey % 41 AS project FROM supplier), h AS (SELECT project, arg_min(ledger, (rank, ledger)) AS ledger FROM r JOIN l USING (ledger) WHERE reachable GROUP BY 1)
SELECT p.project, CASE WHEN h.ledger IS NOT NULL THEN 'found' WHEN (SELECT bool_or(NOT reachable) FROM l) THEN 'unknown' ELSE 'absent' END AS status, h.ledger FROM p LEFT JOIN h USING (project)""")
def ledger_chosen(spark, d):
    ledgers, rows = _ledgers(spark, d)
    return learned.chosen_ledgers(t.read(spark, d, "supplier").select((F.col("s_suppkey") % 41).alias("project")).distinct(), ledgers, rows)


@query("ledgers_fan_in", f"""WITH {_LEDGERS}, o AS (SELECT r.*, row_number() OVER (PARTITION BY row_id ORDER BY rank, ledger, said) AS n, count(*) OVER (PARTITION BY row_id) AS copies FROM r JOIN l USING (ledger) WHERE reachable)
SELECT row_id, ledger, copies FROM o WHERE n = 1""")
def ledgers_fan_in(spark, d):
    ledgers, rows = _ledgers(spark, d)
    return learned.fan_in(ledgers, rows).select("row_id", "ledger", "copies")
