"""Query catalogue, fifth part: gather in all its branches, memories recalled for many questions, and what is built on them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from evidentia.catalogue import MEANING_SQL, POOL, RERANK_SQL, TURNS, _BM25, _blocks, _embedded
from evidentia.operators import recall
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


#: What each benchmark item asks for, by a rule on its id: scopes, times, recent, the assistant's words, days around.
REQUESTS = """q AS (SELECT item_id AS query_id, text AS query,
  CASE item_id % 4 WHEN 1 THEN ['p0', 'p2'] WHEN 2 THEN ['p1'] END AS scopes,
  CASE WHEN item_id % 5 = 1 THEN TIMESTAMP '2024-01-01' + to_days((item_id % 30)::INT) END AS since,
  CASE WHEN item_id % 3 = 2 THEN TIMESTAMP '2024-02-20' + to_days((item_id % 40)::INT) END AS until,
  item_id % 4 = 3 AS recent, item_id % 6 = 4 AS about_assistant,
  CASE WHEN item_id % 8 IN (2, 5) THEN TIMESTAMP '2024-01-01' + to_days((item_id * 3 % 100)::INT) END AS around_day FROM benchmark)"""


def requests(spark, d):
    at = lambda day, n: F.expr(f"timestamp_ntz'{day}' + make_dt_interval(cast({n} as int), 0, 0, 0)").cast("timestamp")
    day = F.date_format(at("2024-01-01", "item_id * 3 % 100"), "yyyy-MM-dd")
    i = F.col("item_id")
    rows = t.read(spark, d, "benchmark").select(
        i.alias("query_id"),
        F.col("text").alias("query"),
        F.when(i % 4 == 1, F.array(F.lit("p0"), F.lit("p2"))).when(i % 4 == 2, F.array(F.lit("p1"))).alias("scopes"),
        F.when(i % 5 == 1, at("2024-01-01", "item_id % 30")).alias("since"),
        F.when(i % 3 == 2, at("2024-02-20", "item_id % 40")).alias("until"),
        (i % 4 == 3).alias("recent"),
        (i % 6 == 4).alias("about_assistant"),
        F.when(i % 8 == 2, day).when(i % 8 == 5, F.concat(day, F.lit(".."), day)).alias("around"),
    )
    return _embedded(rows)


def named(spark, d):
    """Of every second recent request, the word that a memory's title is: its first of four letters or more."""
    first = F.try_element_at(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), 0), F.lit(1))
    return t.read(spark, d, "benchmark").filter("item_id % 8 = 3").select(F.col("item_id").alias("query_id"), first.alias("name")).filter("name IS NOT NULL")


LIMIT = 12
_NEWEST = "ORDER BY round(score, 9), happened_at DESC, revision DESC, turn_id"


@query("gather_turns", f"""WITH {TURNS}, {REQUESTS}, {_BM25}, {MEANING_SQL},
hits_w AS (SELECT s.query_id, t.*, score, row_number() OVER (PARTITION BY s.query_id {_NEWEST}) AS place FROM s JOIN turns t USING (turn_id) JOIN q USING (query_id)
  WHERE (scopes IS NULL OR list_contains(scopes, scope)) AND (until IS NULL OR happened_at <= until)),
wl AS (SELECT h.query_id, turn_id, happened_at, row_number() OVER (PARTITION BY h.query_id ORDER BY place) - 1 AS w_rank FROM hits_w h JOIN q USING (query_id) WHERE place <= {POOL} AND (since IS NULL OR happened_at >= since)),
ok AS (SELECT x.query_id, x.turn_id, x.start, x.similarity, t.revision, t.happened_at, q.since, q.until, around_day FROM sims x JOIN turns t USING (turn_id) JOIN q USING (query_id)
  WHERE (scopes IS NULL OR list_contains(scopes, scope)) AND (about_assistant OR role IN ('user', 'document'))),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, turn_id ORDER BY similarity DESC, start) AS n FROM ok) WHERE n = 1),
ml AS (SELECT query_id, turn_id, start, round(similarity, 4) AS similarity, m_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, revision, start, turn_id) - 1 AS m_rank FROM best
  WHERE (since IS NULL OR happened_at >= since) AND (until IS NULL OR happened_at < until)) WHERE m_rank < {POOL}),
plain AS (SELECT query_id FROM q WHERE NOT recent AND around_day IS NULL), dated AS (SELECT query_id, around_day - to_days(7) AS a, around_day + to_days(8) AS b FROM q WHERE NOT recent AND around_day IS NOT NULL),
words_l AS (SELECT query_id, turn_id, w_rank FROM wl JOIN plain USING (query_id)), mean_l AS (SELECT query_id, turn_id, m_rank, similarity FROM ml JOIN plain USING (query_id)),
{RERANK_SQL},
inside AS (SELECT * FROM (SELECT best.query_id, turn_id, start, row_number() OVER (PARTITION BY best.query_id ORDER BY similarity DESC, revision, start, turn_id) - 1 AS rank FROM best JOIN dated USING (query_id)
  WHERE happened_at >= a AND happened_at < least(b, coalesce(until, b))) WHERE rank < 20),
within_l AS (SELECT wl.query_id, turn_id, row_number() OVER (PARTITION BY wl.query_id ORDER BY w_rank) - 1 AS rank FROM wl JOIN dated USING (query_id) WHERE happened_at >= a AND happened_at < b),
lists AS (SELECT query_id, 0 AS list_no, turn_id, rank FROM inside UNION ALL SELECT query_id, 1, turn_id, rank FROM within_l UNION ALL SELECT query_id, 2, turn_id, m_rank FROM ml JOIN dated USING (query_id) UNION ALL SELECT query_id, 3, turn_id, w_rank FROM wl JOIN dated USING (query_id)),
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, seen) AS place FROM (SELECT query_id, turn_id, sum(1.0::DOUBLE / (60 + rank)) AS score, min((list_no, rank)) AS seen FROM lists GROUP BY ALL)),
nm AS (SELECT item_id AS query_id, regexp_extract_all(lower(text), '[a-z]{{4,}}')[1] AS name FROM benchmark WHERE item_id % 8 = 3 AND len(regexp_extract_all(lower(text), '[a-z]{{4,}}')) > 0),
nhits AS (SELECT query_id, turn_id, sum(tf) AS tf FROM nm JOIN post ON starts_with(term, strip_accents(name)) GROUP BY ALL),
nidf AS (SELECT query_id, greatest(1e-6::DOUBLE, ln(((SELECT count(*) FROM n) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE))) AS idf FROM nhits GROUP BY 1),
ns AS (SELECT query_id, turn_id, -(idf * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / (SELECT avg(len) FROM n)))) AS score FROM nhits JOIN nidf USING (query_id) JOIN n USING (turn_id)),
nfound AS (SELECT query_id, turn_id, happened_at, revision FROM (SELECT ns.query_id, t.*, row_number() OVER (PARTITION BY ns.query_id {_NEWEST}) AS place FROM ns JOIN turns t USING (turn_id) JOIN q USING (query_id)
  WHERE (scopes IS NULL OR list_contains(scopes, scope)) AND (until IS NULL OR happened_at <= until)) WHERE place <= 50),
newest AS (SELECT f.query_id, turn_id, row_number() OVER (PARTITION BY f.query_id ORDER BY happened_at DESC, revision DESC, turn_id) AS place, 'NAMED' AS branch FROM nfound f JOIN q USING (query_id) WHERE since IS NULL OR happened_at >= since
  UNION ALL SELECT q.query_id, turn_id, row_number() OVER (PARTITION BY q.query_id ORDER BY happened_at DESC, revision DESC, turn_id), 'LATEST' FROM q CROSS JOIN turns WHERE recent AND q.query_id NOT IN (SELECT query_id FROM nm)
    AND (scopes IS NULL OR list_contains(scopes, scope)) AND (since IS NULL OR happened_at >= since) AND (until IS NULL OR happened_at <= until)),
u AS (SELECT query_id, turn_id, place, coalesce(ml.start, 0) AS start, 'RANKED' AS branch FROM reranked LEFT JOIN ml USING (query_id, turn_id) WHERE place <= {LIMIT}
  UNION ALL SELECT f.query_id, f.turn_id, f.place, coalesce(i.start, CASE WHEN w.turn_id IS NOT NULL THEN 0 END, m.start, 0), 'AROUND' FROM fused f LEFT JOIN inside i ON i.query_id = f.query_id AND i.turn_id = f.turn_id LEFT JOIN within_l w ON w.query_id = f.query_id AND w.turn_id = f.turn_id LEFT JOIN ml m ON m.query_id = f.query_id AND m.turn_id = f.turn_id WHERE f.place <= {LIMIT}
  UNION ALL SELECT query_id, turn_id, place, 0, branch FROM newest WHERE place <= {LIMIT}),
v AS (SELECT u.*, t.role, len(t.content) AS chars, branch IN ('NAMED', 'LATEST') AS late, coalesce(about_assistant AND role = 'assistant', false) AS whole FROM u JOIN turns t USING (turn_id) JOIN q USING (query_id) WHERE until IS NULL OR happened_at <= until)
SELECT query_id, turn_id, row_number() OVER (PARTITION BY query_id ORDER BY place) AS place, CASE WHEN whole THEN 0 ELSE start END AS start,
  least(CASE WHEN whole AND NOT late THEN 3000 WHEN late THEN chars ELSE 500 END, chars - CASE WHEN whole THEN 0 ELSE start END) AS n_chars, branch FROM v""")
def gather_turns(spark, d):
    turns = t.turns(spark, d)
    return recall.gather_turns(_blocks(turns), turns, requests(spark, d), names=named(spark, d), limit=LIMIT)


_PLAIN = lambda c: f"trim(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'))"


@query("recall_memories", f"""WITH mem AS (SELECT p_partkey AS memory_id, 's' || (p_partkey % 3) AS scope, TIMESTAMP '2024-01-01' + to_days((p_partkey % 400)::INT) AS effective_at, TIMESTAMP '2024-01-01' + to_days((p_partkey % 400 + p_partkey % 3)::INT) AS known_at,
  p_name AS title, p_brand AS tag, p_type || ' ' || p_size AS content, CASE WHEN p_partkey % 2 = 0 THEN p_name || '|' || p_size END AS fact, CASE WHEN p_partkey % 5 = 0 THEN p_partkey - 3 END AS supersedes FROM part),
seen AS (SELECT * FROM mem WHERE effective_at <= TIMESTAMP '2024-10-01' AND known_at <= TIMESTAMP '2024-10-01'),
cur AS (SELECT * FROM seen WHERE memory_id NOT IN (SELECT supersedes FROM seen WHERE supersedes IS NOT NULL)),
facts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scope, fact ORDER BY effective_at DESC, known_at DESC, memory_id DESC) AS n FROM cur) WHERE fact IS NULL OR n = 1),
m AS (SELECT *, [{_PLAIN("title")}, {_PLAIN("tag")}] AS identity, {_PLAIN("scope || ' FACT ' || content")} AS body FROM facts),
names AS (SELECT p_name, row_number() OVER (ORDER BY p_name) AS query_id FROM (SELECT DISTINCT p_name FROM part)),
q AS (SELECT query_id, {_PLAIN("'Show the ' || p_name || ' of Brand ' || (query_id % 25 + 1) || ', economy?'")} AS asked, CASE WHEN query_id % 5 = 3 THEN ['s1'] END AS scopes, CASE WHEN query_id % 4 = 2 THEN TIMESTAMP '2024-03-01' END AS since, query_id % 3 = 1 AS recent FROM names),
w AS (SELECT *, list_distinct(list_filter(string_split(asked, ' '), lambda x: len(x) >= 2)) AS words FROM q),
hit AS (SELECT w.query_id, m.memory_id, m.effective_at, w.recent, len(list_filter(m.identity, lambda i: i <> '' AND contains(w.asked, i))) AS named,
    coalesce(list_sum(list_transform(w.words, lambda x: CASE WHEN contains(m.body, x) THEN 12 WHEN len(list_filter(m.identity, lambda i: i <> '' AND (contains(i, x) OR contains(x, i)))) > 0 THEN 20 ELSE 0 END)), 0) AS part
  FROM w CROSS JOIN m WHERE (w.scopes IS NULL OR list_contains(w.scopes, m.scope)) AND (w.since IS NULL OR m.effective_at >= w.since)),
sc AS (SELECT *, (named * 100 + part)::BIGINT AS score, max(named) OVER (PARTITION BY query_id) AS any_named FROM hit),
r AS (SELECT *, CASE WHEN recent THEN row_number() OVER (PARTITION BY query_id ORDER BY (any_named > 0 AND named = 0), effective_at DESC, memory_id DESC) ELSE row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id DESC) END AS place FROM sc)
SELECT query_id, memory_id, score, named::BIGINT AS named, place FROM r WHERE place <= 10 AND (CASE WHEN recent THEN any_named = 0 OR named > 0 ELSE score > 0 END)""")
def recall_memories(spark, d):
    """Parts as memories, asked for by their names: words, names, scopes, since and recent, for all questions at once."""
    part = t.read(spark, d, "part")
    day = lambda n: F.expr(f"timestamp_ntz'2024-01-01' + make_dt_interval(cast({n} as int), 0, 0, 0)")
    key = F.col("p_partkey")
    memories = part.select(
        key.alias("memory_id"), F.concat(F.lit("s"), key % 3).alias("scope"), day("p_partkey % 400").alias("effective_at"), day("p_partkey % 400 + p_partkey % 3").alias("known_at"), key.alias("revision"), F.col("p_name").alias("title"),
        F.array("p_brand").alias("tags"), F.lit(None).cast("array<string>").alias("entities"), F.lit("FACT").alias("memory_type"), F.concat_ws(" ", "p_type", "p_size").alias("content"), F.when(key % 2 == 0, F.concat_ws("|", "p_name", "p_size")).alias("fact"), F.when(key % 5 == 0, key - 3).alias("supersedes"),
    )
    # the names are numbered in one task: at most one row a distinct name
    names = part.select("p_name").distinct().withColumn("query_id", F.row_number().over(Window.orderBy("p_name")).cast("long"))
    i = F.col("query_id")
    asked = names.select(i, F.concat(F.lit("Show the "), "p_name", F.lit(" of Brand "), (i % 25 + 1).cast("string"), F.lit(", economy?")).alias("query"), F.when(i % 5 == 3, F.array(F.lit("s1"))).alias("scopes"), F.when(i % 4 == 2, F.to_timestamp(F.lit("2024-03-01"))).alias("since"), (i % 3 == 1).alias("recent"))
    at = F.lit("2024-10-01").cast("timestamp_ntz")
    out = recall.recall_memories(memories, asked, as_of=at, knowledge_cutoff=at, limit=10)
    return out.select("query_id", F.col("memory_id").cast("long").alias("memory_id"), "score", F.size("names").cast("long").alias("named"), F.col("place").cast("long").alias("place"))
