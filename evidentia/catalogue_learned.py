"""Query catalogue, fourth part: what earlier questions teach, serialised sessions, timelines, ledgers."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.catalogue import TURNS
from evidentia.functions.text import STOP_WORDS
from evidentia.operators import learned
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


def terms_sql(x: str) -> str:
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return rf"list_distinct(list_filter(regexp_extract_all(lower(coalesce({x}, '')), '[\p{{L}}\p{{N}}]{{2,}}'), lambda w: w NOT IN ({stop})))"


# A question is a conversation's first turn and its candidates are that conversation's turns and the next one's;
# every third assistant turn was used by an answer before.
@query("history_features", f"""WITH {TURNS},
asked AS (SELECT session_id AS query_id, content AS question FROM turns WHERE source_ordinal = 0),
pool AS (SELECT q.query_id, t.turn_id, t.session_id, t.source_ordinal AS number FROM asked q JOIN turns t ON t.session_id::BIGINT - q.query_id::BIGINT IN (0, 1)),
learned AS (SELECT t.turn_id, t.session_id, t.source_ordinal AS number, q.question FROM turns t JOIN asked q ON q.query_id = t.session_id WHERE t.role = 'assistant' AND t.revision % 3 = 0),
u AS (SELECT turn_id, count(*) AS n FROM learned GROUP BY 1), s AS (SELECT session_id, count(*) AS n FROM learned GROUP BY 1),
near AS (SELECT DISTINCT session_id, number + x AS number FROM learned, (SELECT unnest([-2, -1, 1, 2]) AS x)),
links AS (SELECT turn_id, term, count(*) AS n FROM (SELECT turn_id, unnest({terms_sql('question')}) AS term FROM learned) GROUP BY 1, 2),
linked AS (SELECT query_id, turn_id, sum(n) AS n FROM (SELECT query_id, unnest({terms_sql('question')}) AS term FROM asked) JOIN pool USING (query_id) JOIN links USING (turn_id, term) GROUP BY 1, 2)
SELECT p.query_id, p.turn_id, round(ln(1 + coalesce(u.n, 0)), 6) AS used_before, round(ln(1 + coalesce(s.n, 0)), 6) AS session_used, (near.number IS NOT NULL)::INT::DOUBLE AS near_used, round(ln(1 + coalesce(linked.n, 0)), 6) AS term_link
FROM pool p LEFT JOIN u USING (turn_id) LEFT JOIN s ON s.session_id = p.session_id LEFT JOIN near ON near.session_id = p.session_id AND near.number = p.number LEFT JOIN linked ON linked.query_id = p.query_id AND linked.turn_id = p.turn_id""")
def history_features(spark, d):
    turns = t.turns(spark, d).select("turn_id", "session_id", F.col("source_ordinal").alias("number"), "role", "content", "revision")
    asked = turns.filter("number = 0").select(F.col("session_id").alias("query_id"), F.col("content").alias("question"))
    meets = asked.select("query_id", F.explode(F.array("query_id", (F.col("query_id").cast("long") + 1).cast("string"))).alias("session_id"))
    pool = meets.join(turns, "session_id").select("query_id", "turn_id", "session_id", "number")
    used = turns.filter("role = 'assistant' AND revision % 3 = 0").join(asked.withColumnRenamed("query_id", "session_id"), "session_id").select("turn_id", "session_id", "number", "question")
    names = ["used_before", "session_used", "near_used", "term_link"]
    return learned.history_features(pool, asked, used).select("query_id", "turn_id", *[F.round(n, 6).alias(n) for n in names])


@query("used_by_reply", f"""WITH {TURNS},
ends AS (SELECT session_id, arg_min(coalesce(content, ''), source_ordinal) AS question, arg_max(coalesce(content, ''), source_ordinal) AS reply, max(source_ordinal) AS final FROM turns GROUP BY 1),
r AS (SELECT session_id, term, ln(n / (1 + count(*))) AS rare FROM (SELECT session_id, unnest({terms_sql('content')}) AS term FROM turns) JOIN (SELECT session_id, count(*) AS n FROM turns GROUP BY 1) USING (session_id) GROUP BY session_id, term, n),
said AS (SELECT session_id, unnest(list_filter({terms_sql('reply')}, lambda x: NOT list_contains({terms_sql('question')}, x))) AS term FROM ends),
shown AS (SELECT session_id, turn_id, source_ordinal AS place, unnest({terms_sql('content')}) AS term FROM turns JOIN ends USING (session_id) WHERE source_ordinal < final),
w AS (SELECT session_id, turn_id, place, round(sum(rare), 6) AS weight FROM said JOIN shown USING (session_id, term) JOIN r USING (session_id, term) GROUP BY 1, 2, 3)
SELECT session_id AS query_id, turn_id, weight FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY weight DESC, place) AS n FROM w) WHERE n = 1 AND weight >= 4""")
def used_by_reply(spark, d):
    turns = t.turns(spark, d).withColumn("content", F.coalesce("content", F.lit("")))
    ends = turns.groupBy("session_id").agg(F.min_by("content", "source_ordinal").alias("question"), F.max_by("content", "source_ordinal").alias("reply"), F.max("source_ordinal").alias("final"))
    replies = ends.select(F.col("session_id").alias("query_id"), F.col("session_id").alias("owner"), "question", "reply")
    shown = turns.join(ends.select("session_id", "final"), "session_id").filter("source_ordinal < final").select(F.col("session_id").alias("query_id"), "turn_id", F.col("source_ordinal").alias("place"), F.col("content").alias("text"))
    return learned.used_by_reply(replies, shown, turns.select(F.col("session_id").alias("owner"), F.col("content").alias("text")))


@query("distractor_growth", """WITH f AS (SELECT md5(coalesce(text, '')) AS session_id, min(doc_id) AS place, length(coalesce(text, ''))::BIGINT AS size FROM documents GROUP BY 1, 3),
r AS (SELECT *, (sum(size) OVER (ORDER BY place) - size)::BIGINT AS before FROM f) SELECT * FROM r WHERE before < 400000""")
def distractor_growth(spark, d):
    text = F.coalesce("text", F.lit(""))
    sessions = t.read(spark, d, "documents").select(F.md5(text).alias("session_id"), F.col("doc_id").alias("place"), F.length(text).cast("long").alias("size"))
    return learned.distractors(sessions, 400_000, span=100)


@query("last_user_turn", f"""WITH {TURNS}, m AS (SELECT session_id, turn_id, happened_at - INTERVAL 30 SECOND AS at FROM turns)
SELECT m.turn_id, (SELECT max(happened_at) FROM turns t WHERE t.session_id = m.session_id AND t.role = 'user' AND t.happened_at <= m.at)::VARCHAR AS last_at FROM m""")
def last_user_turn(spark, d):
    turns = t.turns(spark, d)
    moments = turns.select("session_id", "turn_id", (F.col("happened_at") - F.expr("INTERVAL 30 SECOND")).alias("at"))
    return learned.last_said(turns, moments).select("turn_id", F.date_format("last_at", "yyyy-MM-dd HH:mm:ss").alias("last_at"))


@query("serialised_turns", rf"""WITH {TURNS} SELECT session_id, 'TURN_' || source_ordinal AS turn_id, regexp_replace(coalesce(content, ''), '^\s+|\s+$', '', 'g') AS text FROM turns WHERE role = 'assistant'""")
def serialised_turns(spark, d):
    return learned.turn_texts(learned.serialised(t.turns(spark, d)), "assistant").drop("role")


EVENTS = """ev AS (SELECT o_custkey AS query_id, o_orderkey AS event_id, CASE WHEN o_orderkey % 3 = 0 THEN '' WHEN o_orderkey % 3 = 1 THEN strftime(o_orderdate, '%Y-%m-%d') END AS date_value,
  CASE WHEN o_orderkey % 7 > 0 THEN strftime(o_orderdate, '%Y-%m') END AS session_date, CASE WHEN o_orderkey % 5 > 0 THEN o_orderpriority ELSE '' END AS object_text, 'order ' || o_orderstatus AS relation_detail, CASE WHEN o_orderkey % 4 > 0 THEN o_totalprice END AS numeric_value FROM orders)"""


def _events(spark, d):
    k = F.col("o_orderkey")
    return t.read(spark, d, "orders").select(
        F.col("o_custkey").alias("query_id"),
        k.alias("event_id"),
        F.when(k % 3 == 0, "").when(k % 3 == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("date_value"),
        F.when(k % 7 > 0, F.date_format("o_orderdate", "yyyy-MM")).alias("session_date"),
        F.when(k % 5 > 0, F.col("o_orderpriority")).otherwise("").alias("object_text"),
        F.concat(F.lit("order "), "o_orderstatus").alias("relation_detail"),
        F.when(k % 4 > 0, F.col("o_totalprice")).alias("numeric_value"),
    )


@query("dated_timeline", f"""WITH {EVENTS}, f AS (SELECT query_id, event_id, coalesce(nullif(date_value, ''), nullif(session_date, '')) AS date, coalesce(nullif(object_text, ''), relation_detail)[:120] AS fact FROM ev)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY date, event_id) AS place, date, fact FROM f WHERE date IS NOT NULL""")
def dated_timeline(spark, d):
    return learned.dated_timeline(_events(spark, d)).withColumn("place", F.col("place").cast("long"))


@query("stored_totals", f"""WITH {EVENTS}, s AS (SELECT *, (lower(object_text || ' ' || relation_detail) LIKE '%urgent%')::INT + (lower(object_text || ' ' || relation_detail) LIKE '%medium%')::INT + (lower(object_text || ' ' || relation_detail) LIKE '%' || lower(c_mktsegment) || '%')::INT AS score FROM ev JOIN customer ON c_custkey = query_id WHERE numeric_value IS NOT NULL),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, event_id) AS best FROM s WHERE score > 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(session_date, ''), best) AS place, session_date, numeric_value AS value, count(*) OVER (PARTITION BY query_id) = 1 AS sole FROM b WHERE best <= 5""")
def stored_totals(spark, d):
    asked = t.read(spark, d, "customer").select(F.col("c_custkey").alias("query_id"), F.concat(F.lit("How many urgent, in the last months medium "), "c_mktsegment", F.lit("?")).alias("question"))
    return learned.stored_totals(asked, _events(spark, d)).withColumn("place", F.col("place").cast("long"))


@query("located_projects", """WITH s AS (SELECT DISTINCT o_custkey, o_orderpriority FROM orders WHERE o_orderpriority <> '5-LOW'), c AS (SELECT o_custkey, count(*) AS copies FROM s GROUP BY 1)
SELECT c_custkey AS project, CASE WHEN copies > 0 THEN 'found' ELSE 'unknown' END AS status, coalesce(copies, 0) AS copies FROM customer LEFT JOIN c ON o_custkey = c_custkey""")
def located_projects(spark, d):
    orders = t.read(spark, d, "orders").select(F.col("o_orderpriority").alias("ledger"), F.col("o_custkey").alias("project"))
    ledgers = orders.select("ledger").distinct().withColumn("reachable", F.col("ledger") != "5-LOW")
    return learned.located(t.read(spark, d, "customer").select(F.col("c_custkey").alias("project")), ledgers, orders)
