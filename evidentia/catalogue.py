"""Query catalogue: turns, memories, search, fusion, packing and graph, each with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from evidentia.functions import text as tx
from evidentia.operators import graph, lexical, memories as mem, packing, ranking, recall, recall_index, turns as tn, vectors
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


def stamp(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


TURNS = """turns AS (SELECT conv_id || '-' || turn AS turn_id, 'c' || (conv_id % 3) AS client, conv_id::VARCHAR AS session_id, 'p' || (conv_id % 4) AS scope,
  TIMESTAMP '2024-01-01' + to_days(conv_id::INT) + to_minutes(turn) AS happened_at, role, text AS content, 'conv-' || conv_id AS source_path,
  turn AS source_ordinal, conv_id * 1000 + turn AS revision FROM conversations)"""
MEMORIES = """mem AS (SELECT o_orderkey AS memory_id, o_orderpriority AS scope, o_orderdate AS effective_at, o_orderdate + to_days((o_orderkey % 5)::INT) AS known_at,
  o_orderstatus AS title, o_totalprice AS amount, o_custkey || '|' || lower(o_orderstatus) AS fact,
  CASE WHEN o_orderkey % 3 = 0 THEN lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) END AS supersedes FROM orders)"""
AS_OF = "1998-06-30 00:00:00"


# ---- turns -----------------------------------------------------------------------------------


@query("turns_dedup", "SELECT 'document-' || arg_min(doc_id, doc_id) AS turn_id FROM documents GROUP BY lang, text")
def turns_dedup(spark, d):
    return tn.drop_duplicates(t.document_turns(spark, d), ["scope", "content"]).select("turn_id")


@query("turns_collisions", "SELECT source || '-' || (doc_id % 50) AS turn_id, count(DISTINCT text) AS contents FROM documents GROUP BY 1 HAVING count(DISTINCT text) > 1")
def turns_collisions(spark, d):
    docs = t.read(spark, d, "documents")
    return tn.collisions(docs.select(F.concat_ws("-", "source", F.col("doc_id") % 50).alias("turn_id"), F.sha2("text", 256).alias("raw_sha256")))


@query("turns_latest_by_scope", f"""WITH {TURNS} SELECT turn_id, scope, place FROM (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY happened_at DESC, revision DESC) AS place FROM turns) WHERE place <= 10""")
def turns_latest_by_scope(spark, d):
    return tn.latest(t.turns(spark, d), 10, per="scope").select("turn_id", "scope", "place")


@query("turns_around", f"""WITH {TURNS}, n AS (SELECT *, row_number() OVER (PARTITION BY source_path ORDER BY source_ordinal) AS n FROM turns)
SELECT c.source_path, c.source_ordinal AS cited_ordinal, n.turn_id, n.n - c.n AS "offset" FROM n c JOIN n ON c.source_path = n.source_path AND n.n BETWEEN c.n - 2 AND c.n + 4 WHERE c.source_ordinal = 2""")
def turns_around(spark, d):
    turns = t.turns(spark, d)
    return tn.around(turns, turns.filter("source_ordinal = 2")).select("source_path", "cited_ordinal", "turn_id", F.col("offset").cast("long").alias("offset"))


@query("turns_neighbours", f"""WITH {TURNS} SELECT turn_id, lag(role, 1) OVER w AS role_before1, lead(role, 1) OVER w AS role_after1, lag(role, 2) OVER w AS role_before2, lead(role, 2) OVER w AS role_after2
FROM turns WINDOW w AS (PARTITION BY session_id ORDER BY source_ordinal)""")
def turns_neighbours(spark, d):
    return tn.neighbours(t.turns(spark, d), "role").select("turn_id", "role_before1", "role_after1", "role_before2", "role_after2")


@query("turns_in_window", f"""WITH {TURNS} SELECT turn_id, role FROM turns WHERE happened_at >= TIMESTAMP '2024-02-03' AND happened_at < TIMESTAMP '2024-02-20' AND scope IN ('p0', 'p2') AND role <> 'assistant'""")
def turns_in_window(spark, d):
    turns = t.turns(spark, d).filter("scope IN ('p0', 'p2')").filter("role <> 'assistant'")
    window = tn.around_window(F.lit("2024-02-10..2024-02-12"))
    rows = turns.withColumn("w", window)
    return rows.filter((F.col("happened_at") >= F.col("w.since")) & (F.col("happened_at") < F.col("w.until"))).select("turn_id", "role")


@query("stall_detector", """WITH e AS (SELECT *, sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM events),
s AS (SELECT user_id, run, count(*) FILTER (event_type <> 'purchase') AS idle FROM e GROUP BY ALL)
SELECT user_id AS source, max(idle) AS longest_idle, max(idle) >= 20 AS stalled FROM s GROUP BY user_id""")
def stall_detector(spark, d):
    e = t.read(spark, d, "events").select(F.col("user_id").alias("source"), F.col("ts").alias("at"), F.col("event_id").alias("row_id"), (F.col("event_type") == "purchase").alias("is_turn"))
    return tn.stalls(e, 20)


# ---- memories --------------------------------------------------------------------------------


@query("bitemporal_memories", f"""WITH {MEMORIES}, seen AS (SELECT * FROM mem WHERE effective_at <= TIMESTAMP '{AS_OF}' AND known_at <= TIMESTAMP '{AS_OF}' AND scope IN ('1-URGENT', '5-LOW'))
SELECT memory_id, scope, fact FROM seen WHERE memory_id NOT IN (SELECT supersedes FROM seen WHERE supersedes IS NOT NULL)""")
def bitemporal_memories(spark, d):
    at = F.lit(AS_OF).cast("timestamp_ntz")
    return mem.current(t.memories(spark, d), scopes=["1-URGENT", "5-LOW"], as_of=at, knowledge_cutoff=at).select("memory_id", "scope", "fact")


@query("superseded_flags", f"""WITH {MEMORIES}, seen AS (SELECT * FROM mem WHERE effective_at <= TIMESTAMP '{AS_OF}'), gone AS (SELECT supersedes, min(memory_id) AS superseded_by FROM seen WHERE supersedes IS NOT NULL GROUP BY 1)
SELECT memory_id, superseded_by, superseded_by IS NOT NULL AS superseded FROM seen LEFT JOIN gone ON gone.supersedes = memory_id""")
def superseded_flags(spark, d):
    return mem.superseded_flags(t.memories(spark, d), as_of=F.lit(AS_OF).cast("timestamp_ntz")).select("memory_id", "superseded_by", "superseded")


@query("facts_current", f"""WITH {MEMORIES}, r AS (SELECT *, row_number() OVER (PARTITION BY scope, fact ORDER BY effective_at DESC, known_at DESC, memory_id DESC) AS n FROM mem)
SELECT scope, fact, max(memory_id) FILTER (n = 1) AS memory_id, count(*) FILTER (n BETWEEN 2 AND 6) AS n_earlier, coalesce(string_agg(memory_id, ',' ORDER BY n) FILTER (n BETWEEN 2 AND 6), '') AS earlier FROM r GROUP BY scope, fact""")
def facts_current(spark, d):
    rows = t.memories(spark, d).withColumn("content", F.col("memory_id").cast("string"))
    out = mem.current_facts(rows)
    return out.select("scope", "fact", "memory_id", F.size("earlier").cast("long").alias("n_earlier"), F.array_join("earlier", ",").alias("earlier"))


RECALL = "small red ring economy brand 7 promo"


@query("curated_recall_scores", """WITH m AS (SELECT p_partkey AS memory_id, [lower(p_name), trim(regexp_replace(lower(p_brand), '[^a-z0-9_]+', ' ', 'g'))] AS identity, lower(p_type) || ' ' || p_size AS body FROM part),
w AS (SELECT unnest(['small', 'red', 'ring', 'economy', 'brand', 'promo']) AS w)
SELECT memory_id, named, (named * 100 + (SELECT sum(CASE WHEN contains(body, w) THEN 12 WHEN len(list_filter(identity, lambda i: len(i) > 0 AND (contains(i, w) OR contains(w, i)))) > 0 THEN 20 ELSE 0 END) FROM w))::BIGINT AS score
FROM (SELECT *, len(list_filter(identity, lambda i: len(i) > 0 AND contains('small red ring economy brand 7 promo', i))) AS named FROM m)""")
def curated_recall_scores(spark, d):
    part = t.read(spark, d, "part")
    m = part.select(F.col("p_partkey").alias("memory_id"), F.array(F.lower("p_name"), tx.entity_key(F.col("p_brand"))).alias("identity"), F.concat_ws(" ", F.lower("p_type"), "p_size").alias("body"))
    return mem.recall_scores(m, RECALL).select("memory_id", F.col("named").cast("long").alias("named"), "score")


@query("curated_recall_recent", f"""WITH {MEMORIES} SELECT memory_id FROM mem WHERE title = 'F' ORDER BY effective_at DESC, memory_id DESC LIMIT 25""")
def curated_recall_recent(spark, d):
    m = t.memories(spark, d).withColumn("identity", F.array(F.lower("title"))).withColumn("body", F.lit(""))
    return mem.recent(mem.recall_scores(m, "f"), 25).select("memory_id")


@query("meaning_fallback", """WITH r AS (SELECT c_nationkey AS query_id, c_custkey AS id, CASE WHEN c_nationkey % 2 = 0 AND c_custkey % 7 = 0 THEN 12 ELSE 0 END AS score, round(abs(c_acctbal) / 10000, 6) AS similarity FROM customer),
f AS (SELECT * FROM r WHERE query_id NOT IN (SELECT query_id FROM r WHERE score > 0) AND similarity >= 0.2)
SELECT query_id, id FROM (SELECT *, max(similarity) OVER (PARTITION BY query_id) AS best FROM f) WHERE similarity >= best - 0.1::DOUBLE""")
def meaning_fallback(spark, d):
    c = t.read(spark, d, "customer")
    rows = c.select(F.col("c_nationkey").alias("query_id"), F.col("c_custkey").alias("id"), F.when((F.col("c_nationkey") % 2 == 0) & (F.col("c_custkey") % 7 == 0), 12).otherwise(0).alias("score"), F.round(F.abs("c_acctbal") / 10000, 6).alias("similarity"))
    return mem.meaning_fallback(rows).select("query_id", "id")


@query("default_profiles", """WITH m AS (SELECT event_id, upper(event_type) || CASE event_id % 8 WHEN 0 THEN '_PREFERENCE' WHEN 1 THEN '_ACTION' WHEN 2 THEN '_CODE_STATE' WHEN 3 THEN '_PROJECT_NOTE' WHEN 4 THEN '_FACT' ELSE '' END AS kind,
  CASE event_id % 5 WHEN 0 THEN 'Web page' WHEN 1 THEN 'git commit' WHEN 2 THEN 'a file' WHEN 3 THEN 'manual' ELSE '' END AS src FROM events),
c AS (SELECT event_id, CASE WHEN contains(kind, 'PREFERENCE') THEN 'PREFERENCE' WHEN contains(kind, 'DECISION') THEN 'DECISION' WHEN contains(kind, 'TASK') OR contains(kind, 'ACTION') THEN 'TASK' WHEN contains(kind, 'FILE') OR contains(kind, 'DOCUMENT') OR contains(kind, 'CODE') THEN 'ARTIFACT'
  WHEN contains(kind, 'RELATION') THEN 'RELATION' WHEN contains(kind, 'STATE') THEN 'STATE' WHEN contains(kind, 'SUMMARY') THEN 'SUMMARY' WHEN contains(kind, 'FACT') THEN 'FACT' WHEN contains(kind, 'PROJECT') THEN 'STATE' ELSE 'EPISODE' END AS memory_class,
  CASE WHEN contains(lower(src), 'git') THEN 'CODE' WHEN contains(lower(src), 'file') THEN 'FILE' WHEN contains(lower(src), 'web') THEN 'WEB' WHEN contains(lower(src), 'manual') THEN 'MANUAL' ELSE 'OTHER' END AS modality FROM m)
SELECT *, CASE WHEN memory_class IN ('FACT', 'PREFERENCE', 'DECISION', 'STATE', 'SUMMARY') THEN 'DURABLE' ELSE 'EPISODIC' END AS retention FROM c""")
def default_profiles(spark, d):
    e = t.read(spark, d, "events")
    pick = lambda by, n, names: F.try_element_at(F.array(*map(F.lit, names)), (F.col(by) % n + 1).cast("int"))
    kind = F.concat(F.upper("event_type"), pick("event_id", 8, ["_PREFERENCE", "_ACTION", "_CODE_STATE", "_PROJECT_NOTE", "_FACT", "", "", ""]))
    source = pick("event_id", 5, ["Web page", "git commit", "a file", "manual", ""])
    return e.select("event_id", mem.default_profile(kind, source).alias("p")).select("event_id", "p.memory_class", "p.modality", "p.retention")


@query("memory_validation", f"""WITH {MEMORIES}, v AS (SELECT *, CASE WHEN memory_id % 11 = 0 THEN 3000000000 ELSE supersedes END AS target FROM mem)
SELECT v.memory_id, concat_ws(',', CASE WHEN v.target IS NOT NULL AND k.memory_id IS NULL THEN 'SUPERSEDES_UNKNOWN' END, CASE WHEN k.scope <> v.scope THEN 'SUPERSEDES_OTHER_SCOPE' END) AS errors
FROM v LEFT JOIN mem k ON k.memory_id = v.target""")
def memory_validation(spark, d):
    m = t.memories(spark, d)
    rows = m.withColumn("supersedes", F.when(F.col("memory_id") % 11 == 0, F.lit(3000000000)).otherwise(F.col("supersedes")))
    return mem.validate(rows, m).select("memory_id", F.array_join("errors", ",").alias("errors"))


# ---- text ------------------------------------------------------------------------------------


_NOUNS = ["모임", "콩이", "서울", "부산", "프로젝트"]
_PARTICLES = ", ".join(f"'{w}'" for w in tx.PARTICLES)
_LONGEST = "|".join(sorted(tx.PARTICLES, key=len, reverse=True))


@query("query_terms_particles", f"""WITH a AS (SELECT item_id AS id, lower(substring(text, 1, 80) || ' ' || ({_NOUNS})[item_id % 5 + 1] || ([{_PARTICLES}])[item_id % {len(tx.PARTICLES)} + 1] || ' ' || split_part(text, ' ', 1) || ([{_PARTICLES}])[item_id * 7 % {len(tx.PARTICLES)} + 1]) AS q FROM benchmark),
w AS (SELECT id, unnest(regexp_extract_all(q, '[\\p{{L}}\\p{{N}}]+')) AS word FROM a),
r AS (SELECT id, word, unnest(regexp_extract_all(word, '[가-힣]+|[^가-힣]+')) AS run FROM w)
SELECT id, string_agg(term, ' ' ORDER BY term) AS terms FROM (SELECT DISTINCT id, regexp_replace(run, '^([가-힣]{{2,}}?)(?:{_LONGEST})$', '\\1') AS term FROM r WHERE NOT (run IN ({_PARTICLES}) AND run <> word)) WHERE len(term) >= 2 GROUP BY id""")
def query_terms_particles(spark, d):
    """Each benchmark item's start with a Korean noun and a foreign word behind it, both with a particle."""
    i, n = F.col("item_id"), len(tx.PARTICLES)
    pick = lambda names, k: F.try_element_at(F.array(*map(F.lit, names)), (k + 1).cast("int"))
    q = F.concat(F.substring("text", 1, 80), F.lit(" "), pick(_NOUNS, i % 5), pick(tx.PARTICLES, i % n), F.lit(" "), F.split_part("text", F.lit(" "), F.lit(1)), pick(tx.PARTICLES, i * 7 % n))
    return t.read(spark, d, "benchmark").select(i.alias("id"), F.array_join(F.array_sort(tx.query_terms(q)), " ").alias("terms"))


@query("pieces_500", """SELECT doc_id, s AS start, substring(text, s + 1, 500) AS piece FROM (SELECT doc_id, text, unnest(range(0, greatest(len(text), 1), 500)) AS s FROM documents) WHERE len(trim(substring(text, s + 1, 500))) > 0""")
def pieces_500(spark, d):
    p = t.read(spark, d, "documents").select("doc_id", F.explode(tx.pieces(F.col("text"))).alias("p"))
    return p.select("doc_id", F.col("p.start").cast("long").alias("start"), "p.piece")


@query("windows_600_300", f"""WITH {TURNS} SELECT turn_id, s AS start, len(substring(content, s + 1, 600)) AS n FROM (SELECT turn_id, content, unnest(range(0, greatest(len(content), 1), 300)) AS s FROM turns) WHERE len(trim(substring(content, s + 1, 600))) > 0""")
def windows_600_300(spark, d):
    p = t.turns(spark, d).select("turn_id", F.explode(tx.pieces(F.col("content"), 600, 300)).alias("p"))
    return p.select("turn_id", F.col("p.start").cast("long").alias("start"), F.length("p.piece").cast("long").alias("n"))


@query("turn_projection", f"""WITH {TURNS} SELECT turn_id, substring(string_split(content, chr(10))[1], 1, 80) AS title, len(substring(content, 1, CASE WHEN role = 'assistant' THEN 3000 ELSE 500 END)) AS excerpt_chars, ceil(len(content) / 4.0)::BIGINT AS tokens FROM turns""")
def turn_projection(spark, d):
    c = F.col("content")
    return t.turns(spark, d).select("turn_id", tx.title(c).alias("title"), F.length(tx.excerpt(F.col("role"), c)).cast("long").alias("excerpt_chars"), tx.token_estimate(F.length(c)).cast("long").alias("tokens"))


_STOP = ", ".join(f"'{w}'" for w in tx.STOP_WORDS)


@query("bag_of_words", f"""SELECT doc_id, len(list_distinct(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]{{2,}}'), lambda w: w NOT IN ({_STOP})))) AS n FROM documents""")
def bag_of_words(spark, d):
    return t.read(spark, d, "documents").select("doc_id", F.size(tx.bag(F.col("text"))).cast("long").alias("n"))


# ---- search ----------------------------------------------------------------------------------

_QUESTIONS = """q AS (SELECT item_id AS query_id, text AS query FROM benchmark)"""
_BM25 = """w AS (SELECT turn_id, unnest(regexp_extract_all(lower(strip_accents(content)), '[\\p{L}\\p{N}]+')) AS term FROM turns),
n AS (SELECT turn_id, len(regexp_extract_all(lower(strip_accents(content)), '[\\p{L}\\p{N}]+')) AS len FROM turns),
post AS (SELECT turn_id, term, count(*) AS tf FROM w GROUP BY ALL),
asked AS (SELECT DISTINCT query_id, unnest(list_filter(regexp_extract_all(lower(query), '[\\p{L}\\p{N}]+'), lambda x: len(x) >= 2)) AS prefix FROM q),
vocab AS (SELECT DISTINCT term FROM post),
words AS (SELECT prefix, term FROM (SELECT DISTINCT prefix FROM asked) p JOIN vocab ON starts_with(term, prefix)),
hits AS (SELECT prefix, turn_id, sum(tf) AS tf FROM words JOIN post USING (term) GROUP BY ALL),
df AS (SELECT prefix, greatest(1e-6::DOUBLE, ln(((SELECT count(*) FROM n) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE))) AS idf FROM hits GROUP BY prefix),
s AS (SELECT query_id, turn_id, -sum(idf * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / (SELECT avg(len) FROM n)))) AS score FROM asked JOIN hits USING (prefix) JOIN df USING (prefix) JOIN n USING (turn_id) GROUP BY ALL)"""


@query("word_search_turns", f"""WITH {TURNS}, {_QUESTIONS}, {_BM25}
SELECT query_id, turn_id, round(score, 6) AS score, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9), happened_at DESC, revision DESC, turn_id) AS place FROM s JOIN turns USING (turn_id)) WHERE place <= 20""")
def word_search_turns(spark, d):
    found = lexical.search(t.turns(spark, d), t.questions(spark, d), limit=20)
    return found.select("query_id", "turn_id", F.round("score", 6).alias("score"), "place")


DOC_TURNS = "turns AS (SELECT 'document-' || doc_id AS turn_id, source AS session_id, lang AS scope, text AS content, doc_id AS revision FROM documents)"


@query("word_search_bm25", f"""WITH {DOC_TURNS}, {_QUESTIONS}, {_BM25}
SELECT query_id, turn_id, round(score, 6) AS score, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9), revision DESC, turn_id) AS place FROM s JOIN turns USING (turn_id)) WHERE place <= 20""")
def word_search_bm25(spark, d):
    found = lexical.search(t.document_turns(spark, d), t.questions(spark, d), limit=20)
    return found.select("query_id", "turn_id", F.round("score", 6).alias("score"), "place")


def _asked_vectors(v):
    """Every row whose id is divisible by 50 as a question."""
    return v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@query("cosine_topk", """WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS similarity,
  round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9) AS s9 FROM embeddings q JOIN embeddings v ON q.vec_id % 50 = 0)
SELECT query_id, vec_id, similarity, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s9 DESC, vec_id) AS place FROM s) WHERE place <= 20""")
def cosine_topk(spark, d):
    v = t.read(spark, d, "embeddings")
    return vectors.top_k(v, _asked_vectors(v), 20).select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), "place")


@query("best_piece_per_turn", """WITH s AS (SELECT q.vec_id AS query_id, v.vec_id // 4 AS turn_id, v.vec_id % 4 * 500 AS start, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9) AS similarity FROM embeddings q JOIN embeddings v ON q.vec_id % 50 = 0)
SELECT query_id, turn_id, start FROM (SELECT *, row_number() OVER (PARTITION BY query_id, turn_id ORDER BY similarity DESC, start) AS n FROM s) WHERE n = 1""")
def best_piece_per_turn(spark, d):
    v = t.read(spark, d, "embeddings")
    pieces = v.select(F.expr("vec_id div 4").alias("turn_id"), F.expr("vec_id div 4").alias("revision"), (F.col("vec_id") % 4 * 500).alias("start"), "embedding")
    return vectors.best_groups(pieces, _asked_vectors(v)).select("query_id", "turn_id", "start")


_LISTS = """l AS (SELECT o_custkey % 40 AS query_id, 0 AS list_no, o_orderkey % 300 AS turn_id, row_number() OVER (PARTITION BY o_custkey % 40 ORDER BY max(o_totalprice) DESC, o_orderkey % 300) - 1 AS rank FROM orders GROUP BY 1, 2, 3
  UNION ALL SELECT o_custkey % 40, 1, o_orderkey % 300, row_number() OVER (PARTITION BY o_custkey % 40 ORDER BY max(o_orderdate) DESC, o_orderkey % 300) - 1 FROM orders GROUP BY 1, 2, 3)"""


@query("rrf_fusion", f"""WITH {_LISTS}, f AS (SELECT query_id, turn_id, sum(1.0::DOUBLE / (60 + rank)) AS score, min((list_no, rank)) AS seen FROM l WHERE rank < 100 GROUP BY ALL)
SELECT query_id, turn_id, round(score, 9) AS score, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, seen) AS place FROM f) WHERE place <= 30""")
def rrf_fusion(spark, d):
    o = t.read(spark, d, "orders").select((F.col("o_custkey") % 40).alias("query_id"), (F.col("o_orderkey") % 300).alias("turn_id"), "o_totalprice", "o_orderdate")

    def ranked(no, column):
        best = o.groupBy("query_id", "turn_id").agg(F.max(column).alias("v"))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("v"), "turn_id")) - 1
        return best.select("query_id", F.lit(no).alias("list_no"), "turn_id", rank.alias("rank")).filter("rank < 100")

    fused = ranking.fuse(ranked(0, "o_totalprice").unionByName(ranked(1, "o_orderdate")), 30)
    return fused.select("query_id", "turn_id", F.round("score", 9).alias("score"), "place")


POOL = 100


def _document_pieces(turns):
    """Pieces of 500 characters with their vectors."""
    return recall_index.turn_pieces(turns, vectors.hashing_embedder())


def _blocks(turns) -> recall.Blocks:
    """Word and vector blocks of turns, made once for a batch."""
    return recall.Blocks(recall_index.held_blocks(recall_index.word_blocks(turns)), recall_index.held_blocks(recall_index.vector_blocks(_document_pieces(turns))))


def _embedded(asked):
    return asked.withColumn("embedding", vectors.hashing_embedder()(F.col("query")))


def _whole_pool(spark, d):
    """Two ranked lists of document turns for every whole question: POOL turns by words, and POOL by their best piece's cosine."""
    turns, asked = t.document_turns(spark, d), t.questions(spark, d)
    index = _blocks(turns)
    words = index.search(asked, POOL).select("query_id", "turn_id", (F.col("place") - 1).alias("rank"))
    hits = index.similar(_embedded(asked), POOL)
    meaning = hits.select("query_id", "turn_id", (F.col("place") - 1).alias("rank"), F.round("similarity", 4).alias("similarity"), "start")
    return turns, asked, meaning, words


_W = ranking.WEIGHTS

#: From words_l(query_id, turn_id, w_rank), mean_l(query_id, turn_id, m_rank, similarity), q and turns to sc, the pool's scores.
RERANK_SQL = f"""pool AS (SELECT coalesce(m.query_id, w.query_id) AS query_id, coalesce(m.turn_id, w.turn_id) AS turn_id, m_rank, w_rank, similarity FROM mean_l m FULL JOIN words_l w ON m.query_id = w.query_id AND m.turn_id = w.turn_id),
ask2 AS (SELECT query_id, list_filter(list_distinct(list_filter(regexp_extract_all(lower(query), '[\\p{{L}}\\p{{N}}]+'), lambda x: len(x) >= 2)), lambda x: x NOT IN ({_STOP})) AS asked FROM q),
bags AS (SELECT turn_id, session_id, list_distinct(list_filter(regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}]{{2,}}'), lambda x: x NOT IN ({_STOP}))) AS bag FROM turns WHERE turn_id IN (SELECT turn_id FROM pool)),
p2 AS (SELECT p.*, a.asked, b.session_id, b.bag, list_filter(a.asked, lambda x: list_contains(b.bag, x) OR (regexp_matches(x, '[^\\x00-\\x7F]') AND len(list_filter(b.bag, lambda y: starts_with(y, x))) > 0)) AS found FROM pool p JOIN ask2 a USING (query_id) JOIN bags b USING (turn_id)),
psize AS (SELECT query_id, count(*) AS n FROM p2 GROUP BY 1),
dfx AS (SELECT query_id, term, count(*) AS df FROM (SELECT query_id, unnest(found) AS term FROM p2) GROUP BY ALL),
rare AS (SELECT a.query_id, a.term, ln((n + 1) / (coalesce(df, 0) + 0.5::DOUBLE)) AS r FROM (SELECT query_id, unnest(asked) AS term FROM ask2) a JOIN psize USING (query_id) LEFT JOIN dfx USING (query_id, term)),
tot AS (SELECT query_id, sum(r) AS total FROM rare GROUP BY 1),
fr AS (SELECT x.query_id, x.turn_id, sum(r) AS fr FROM (SELECT query_id, turn_id, unnest(found) AS term FROM p2) x JOIN rare USING (query_id, term) GROUP BY ALL),
feat AS (SELECT p2.*, coalesce(60.0 / (60 + m_rank), 0) AS meaning, coalesce(60.0 / (60 + w_rank), 0) AS words, coalesce(similarity, 0) AS sim0, (m_rank IS NOT NULL AND w_rank IS NOT NULL)::INT AS both_l,
  len(found)::DOUBLE / greatest(len(asked), 1) AS overlap, coalesce(fr, 0) / (CASE WHEN coalesce(total, 0) = 0 THEN 1 ELSE total END) AS rare_overlap,
  len(list_filter(asked, lambda x: len(list_filter(bag, lambda y: starts_with(y, x))) > 0))::DOUBLE / greatest(len(asked), 1) AS prefix_overlap,
  ln(count(*) OVER (PARTITION BY query_id, session_id)) AS session_hits, max(coalesce(similarity, 0)) OVER (PARTITION BY query_id, session_id) AS session_best FROM p2 LEFT JOIN tot USING (query_id) LEFT JOIN fr USING (query_id, turn_id)),
sc AS (SELECT *, {_W["meaning"]}::DOUBLE * meaning + {_W["words"]}::DOUBLE * words + {_W["similarity"]}::DOUBLE * sim0 + {_W["both"]}::DOUBLE * both_l + {_W["overlap"]}::DOUBLE * overlap + {_W["rare_overlap"]}::DOUBLE * rare_overlap + {_W["prefix_overlap"]}::DOUBLE * prefix_overlap + {_W["session_hits"]}::DOUBLE * session_hits + {_W["session_best"]}::DOUBLE * session_best AS score2 FROM feat),
reranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score2, 9) DESC, m_rank NULLS LAST, w_rank NULLS LAST, turn_id) AS place FROM sc)"""

#: From q and turns to sims: similarity of every question and 500-character piece under the hashing embedder.
MEANING_SQL = """pcs AS (SELECT turn_id, s AS start, substring(content, s + 1, 500) AS piece FROM (SELECT turn_id, content, unnest(range(0, greatest(len(content), 1), 500)) AS s FROM turns) WHERE len(trim(substring(content, s + 1, 500))) > 0),
pw AS (SELECT turn_id, start, md5(w) AS h FROM (SELECT turn_id, start, unnest(string_split_regex(lower(piece), '[ \\t\\n\\x0b\\f\\r]+')) AS w FROM pcs) WHERE w <> ''),
pv AS (SELECT turn_id, start, ('0x' || h[1:6])::INT % 64 AS d, sum(CASE WHEN h[7] >= '8' THEN 1.0::DOUBLE ELSE -1 END) AS x FROM pw GROUP BY ALL),
pn AS (SELECT turn_id, start, sqrt(sum(x * x)) AS n FROM pv GROUP BY ALL),
qw AS (SELECT query_id, md5(w) AS h FROM (SELECT query_id, unnest(string_split_regex(lower(query), '[ \\t\\n\\x0b\\f\\r]+')) AS w FROM q) WHERE w <> ''),
qv AS (SELECT query_id, ('0x' || h[1:6])::INT % 64 AS d, sum(CASE WHEN h[7] >= '8' THEN 1.0::DOUBLE ELSE -1 END) AS x FROM qw GROUP BY ALL),
qn AS (SELECT query_id, sqrt(sum(x * x)) AS n FROM qv GROUP BY ALL),
dots AS (SELECT query_id, turn_id, start, sum(pv.x * qv.x) AS dot FROM qv JOIN pv USING (d) GROUP BY ALL),
sims AS (SELECT q.query_id, pcs.turn_id, pcs.start, round(CASE WHEN pn.n > 0 AND qn.n > 0 THEN coalesce(dot, 0) / (pn.n * qn.n) ELSE 0 END, 9) AS similarity
  FROM q CROSS JOIN pcs LEFT JOIN pn USING (turn_id, start) LEFT JOIN qn USING (query_id) LEFT JOIN dots ON dots.query_id = q.query_id AND dots.turn_id = pcs.turn_id AND dots.start = pcs.start)"""


@query("rerank_formula", f"""WITH {DOC_TURNS}, {_QUESTIONS}, {_BM25},
words_l AS (SELECT query_id, turn_id, place - 1 AS w_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9), revision DESC, turn_id) AS place FROM s JOIN turns USING (turn_id)) WHERE place <= 20),
sim AS (SELECT a.vec_id AS query_id, 'document-' || v.vec_id AS turn_id, v.vec_id AS id, round(list_cosine_similarity(a.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9) AS similarity FROM embeddings a JOIN q ON q.query_id = a.vec_id CROSS JOIN (SELECT * FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents)) v),
mean_l AS (SELECT query_id, turn_id, m_rank, round(similarity, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) - 1 AS m_rank FROM sim) WHERE m_rank < 20),
{RERANK_SQL}
SELECT query_id, turn_id, round(score2, 6) AS score, place FROM reranked WHERE place <= 15""")
def rerank_formula(spark, d):
    """The weights on word hits and the cosines of given vectors: a document's is that of its id, a question's that of its."""
    turns, asked, v = t.document_turns(spark, d), t.questions(spark, d), t.read(spark, d, "embeddings")
    words = lexical.search(turns, asked, limit=20).select("query_id", "turn_id", (F.col("place") - 1).alias("rank"))
    held = v.join(turns.select(F.col("revision").alias("vec_id")), "vec_id", "left_semi")
    hits = vectors.top_k(held, v.select(F.col("vec_id").alias("query_id"), "embedding").join(asked.select("query_id"), "query_id", "left_semi"), 20)
    meaning = hits.select("query_id", F.concat(F.lit("document-"), F.col("vec_id")).alias("turn_id"), (F.col("place") - 1).alias("rank"), F.round("similarity", 6).alias("similarity"))
    out = ranking.rerank(ranking.features(asked, meaning, words, turns), 15)
    return out.select("query_id", "turn_id", F.round("score", 6).alias("score"), "place")


@query("rerank_linear", f"""WITH {DOC_TURNS}, {_QUESTIONS}, {_BM25}, {MEANING_SQL},
words_l AS (SELECT query_id, turn_id, place - 1 AS w_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9), revision DESC, turn_id) AS place FROM s JOIN turns USING (turn_id)) WHERE place <= {POOL}),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id, turn_id ORDER BY similarity DESC, start) AS n FROM sims),
mean_l AS (SELECT query_id, turn_id, m_rank, round(similarity, 4) AS similarity FROM (SELECT best.*, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, revision, start, turn_id) - 1 AS m_rank FROM best JOIN turns USING (turn_id) WHERE n = 1) WHERE m_rank < {POOL}),
{RERANK_SQL}
SELECT query_id, turn_id, round(score2, 6) AS score, place FROM reranked WHERE place <= 15""")
def rerank_linear(spark, d):
    turns, asked, meaning, words = _whole_pool(spark, d)
    out = ranking.rerank(ranking.features(asked, meaning, words, turns), 15)
    return out.select("query_id", "turn_id", F.round("score", 6).alias("score"), "place")


@query("session_ranking", """WITH s AS (SELECT q.vec_id AS query_id, v.vec_id % 90 AS session_id, max(round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9)) AS best FROM embeddings q JOIN embeddings v ON q.vec_id % 50 = 0 GROUP BY ALL)
SELECT query_id, session_id, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY best DESC, session_id) AS place, count(*) OVER (PARTITION BY query_id) AS n FROM s) WHERE place <= greatest(16, ceil(1.5 * sqrt(n)))""")
def session_ranking(spark, d):
    v = t.read(spark, d, "embeddings")
    pieces = v.select((F.col("vec_id") % 90).alias("turn_id"), F.lit(0).alias("revision"), F.lit(0).alias("start"), "embedding")
    hits = vectors.best_groups(pieces, _asked_vectors(v)).select("query_id", F.col("turn_id").alias("session_id"), "similarity")
    return ranking.session_ranking(hits).select("query_id", "session_id", "place")


@query("episode_lift", """WITH s AS (SELECT event_type AS query_id, user_id AS episode, event_id AS turn_id, value AS score FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY query_id, episode ORDER BY score DESC, turn_id) AS n FROM s)
SELECT query_id, episode, turn_id, round(lift, 4) AS lift FROM (SELECT *, sum(score) FILTER (n <= 2) OVER (PARTITION BY query_id, episode) AS lift FROM r) WHERE n <= 3""")
def episode_lift(spark, d):
    e = t.read(spark, d, "events").select(F.col("event_type").alias("query_id"), F.col("user_id").alias("episode"), F.col("event_id").alias("turn_id"), F.col("value").alias("score"))
    return ranking.episode_lift(e, cap=3).select("query_id", "episode", "turn_id", F.round("lift", 4).alias("lift"))


# ---- packing ---------------------------------------------------------------------------------


def _pack_items(spark, d):
    turns = t.turns(spark, d)
    item = F.struct(F.lit("conversation").alias("kind"), F.lit("EPISODE").alias("class"), "scope", F.date_format("happened_at", "yyyy-MM-dd HH:mm").alias("at"), tx.title(F.col("content")).alias("title"), "content", F.col("client").alias("source_type"), F.col("source_path").alias("source_ref"))
    return turns.select(F.col("session_id").alias("query_id"), item.alias("item"), F.col("source_ordinal").alias("place"), "turn_id")


@query("context_pack", f"""WITH RECURSIVE {TURNS}, i AS (SELECT session_id AS query_id, row_number() OVER (PARTITION BY session_id ORDER BY source_ordinal) AS n, content AS body,
  len('[conversation | EPISODE | ' || scope || ' | ' || strftime(happened_at, '%Y-%m-%d %H:%M') || ']') + 1 AS head, len(chr(10) || 'Source: ' || client || ' / ' || source_path) AS foot FROM turns),
f AS (SELECT query_id, 0::BIGINT AS n, 0::BIGINT AS used, 0::BIGINT AS items, false AS stop FROM i GROUP BY query_id
  UNION ALL SELECT f.query_id, i.n,
    CASE WHEN f.stop OR 1500 - f.used - g.gap <= i.head + i.foot + 16 THEN f.used WHEN i.head + len(i.body) + i.foot > 1500 - f.used - g.gap THEN f.used + g.gap + i.head + i.foot + greatest(0, 1500 - f.used - g.gap - i.head - i.foot - 15) + 12 ELSE f.used + g.gap + i.head + len(i.body) + i.foot END,
    CASE WHEN f.stop OR 1500 - f.used - g.gap <= i.head + i.foot + 16 THEN f.items ELSE f.items + 1 END,
    f.stop OR (1500 - f.used - g.gap > i.head + i.foot + 16 AND i.head + len(i.body) + i.foot > 1500 - f.used - g.gap)
  FROM f JOIN i ON i.query_id = f.query_id AND i.n = f.n + 1, LATERAL (SELECT CASE WHEN f.items > 0 THEN 2 ELSE 0 END AS gap) g)
SELECT query_id, arg_max(used, n)::BIGINT AS used_chars, arg_max(items, n)::BIGINT AS selected_items, (max(n) - arg_max(items, n))::BIGINT AS omitted_items FROM f GROUP BY query_id""")
def context_pack(spark, d):
    items = _pack_items(spark, d)
    return packing.pack(items, 1500).select("query_id", *[F.col(c).cast("long").alias(c) for c in ("used_chars", "selected_items", "omitted_items")])


@query("pack_candidates", """WITH m AS (SELECT o_custkey AS query_id, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place, 200 AS n FROM orders WHERE o_orderkey % 3 = 0),
t AS (SELECT o_custkey AS query_id, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place FROM orders WHERE o_orderkey % 3 <> 0),
cited AS (SELECT query_id, o_orderkey + 1 AS turn_id FROM m WHERE o_orderkey % 2 = 0),
tt AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place) AS n FROM t WHERE (query_id, o_orderkey) NOT IN (SELECT query_id, turn_id FROM cited)),
b AS (SELECT query_id, 'm' || o_orderkey AS id, CASE WHEN sum(n + 121) OVER (PARTITION BY query_id ORDER BY place) <= 1500 // 4 THEN 0 ELSE 2 END AS rank, place FROM m
  UNION ALL SELECT query_id, 't' || o_orderkey, 1, n FROM tt WHERE n <= 10 OR query_id NOT IN (SELECT query_id FROM cited))
SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY rank, place) AS place FROM b""")
def pack_candidates(spark, d):
    o = t.read(spark, d, "orders").select(F.col("o_custkey").alias("query_id"), "o_orderkey")
    item = lambda kind, n: F.struct(*[F.lit("x").alias(c) for c in ("kind", "class", "scope", "at", "title")], F.repeat(F.lit("y"), F.lit(n)).alias("content"), F.concat(F.lit(kind), F.col("o_orderkey")).alias("source_type"), F.lit("x").alias("source_ref"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("o_orderkey")).alias("place")
    cites = F.when(F.col("o_orderkey") % 2 == 0, F.array(F.col("o_orderkey") + 1)).otherwise(F.array().cast("array<bigint>")).alias("from_turns")
    m = o.filter("o_orderkey % 3 = 0").select("query_id", place, item("m", 200).alias("item"), cites)
    turns = o.filter("o_orderkey % 3 <> 0").select("query_id", place, item("t", 10).alias("item"), F.col("o_orderkey").alias("turn_id"))
    return packing.candidates(m, turns, 1500).select("query_id", F.col("item.source_type").alias("id"), "place")


# ---- graph -----------------------------------------------------------------------------------

ENGRAMS = """eng AS (SELECT p_partkey AS engram_id, p_brand AS scope, TIMESTAMP '2024-01-01' + to_minutes(p_partkey) AS happened_at, list_distinct(list_filter(regexp_extract_all(lower(p_name || ' ' || p_type), '[a-z0-9]+'), lambda w: len(w) >= 2)) AS terms, p_partkey AS revision FROM part),
wd AS (SELECT engram_id, scope, revision, unnest(terms) AS term FROM eng),
ov AS (SELECT a.engram_id, b.engram_id AS target, b.revision AS tr, count(*) AS overlap FROM wd a JOIN wd b ON a.scope = b.scope AND a.term = b.term AND b.revision < a.revision GROUP BY ALL HAVING count(*) >= 2),
cue AS (SELECT engram_id AS source, target, 'SHARED_CUE' AS relation, least(0.75, 0.2 + 0.1 * overlap)::DOUBLE AS weight FROM (SELECT *, row_number() OVER (PARTITION BY engram_id ORDER BY overlap DESC, tr DESC) AS n FROM ov) WHERE n <= 12),
one AS (SELECT * FROM cue UNION ALL SELECT engram_id, prev, 'TEMPORAL', 0.3 FROM (SELECT engram_id, lag(engram_id) OVER (PARTITION BY scope ORDER BY happened_at, revision) AS prev FROM eng) WHERE prev IS NOT NULL),
links AS (SELECT * FROM one UNION ALL SELECT target, source, relation, weight FROM one),
edges AS (SELECT source, target, relation, max(weight) AS weight, count(*) AS evidence_count FROM links GROUP BY ALL)"""


def _edges(spark, d):
    links = graph.auto_links(t.engrams(spark, d)).withColumn("at", F.lit("2024-01-01"))
    empty = spark.createDataFrame([], "source bigint, target bigint, relation string, weight double, evidence_count bigint, reinforced_at string")
    return graph.upsert(empty, links)


@query("engram_autolinks", f"WITH {ENGRAMS} SELECT source, target, relation, round(weight, 6) AS weight FROM links")
def engram_autolinks(spark, d):
    return graph.auto_links(t.engrams(spark, d)).withColumn("weight", F.round("weight", 6))


@query("edges_upsert", f"WITH {ENGRAMS} SELECT source, target, relation, round(weight, 6) AS weight, evidence_count FROM edges")
def edges_upsert(spark, d):
    return _edges(spark, d).select("source", "target", "relation", F.round("weight", 6).alias("weight"), "evidence_count")


@query("activation_2hop", f"""WITH {ENGRAMS}, q AS (SELECT * FROM (VALUES (0, 'small'), (0, 'ring'), (0, 'economy'), (1, 'red'), (1, 'widget'), (1, 'small')) v(query_id, term)),
hit AS (SELECT query_id, engram_id, least(1.0, 0.55 + count(*) / sqrt((3.0::DOUBLE * max(len(terms))))) AS a FROM q JOIN wd USING (term) JOIN eng USING (engram_id) GROUP BY ALL),
s0 AS (SELECT query_id, engram_id, a FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY a DESC, engram_id) AS n FROM hit) WHERE n <= 12),
fan AS (SELECT source, target, weight FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY weight DESC, target, relation) AS n FROM edges) WHERE n <= 12),
g1 AS (SELECT query_id, target AS engram_id, 1 - product(1 - a * weight * 0.65::DOUBLE) AS a FROM s0 JOIN fan ON fan.source = s0.engram_id GROUP BY ALL),
m1 AS (SELECT coalesce(s.query_id, g.query_id) AS query_id, coalesce(s.engram_id, g.engram_id) AS engram_id, greatest(coalesce(s.a, 0), coalesce(g.a, 0)) AS a, g.a IS NOT NULL AS touched FROM s0 s FULL JOIN g1 g ON s.query_id = g.query_id AND s.engram_id = g.engram_id),
s1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(a, 12) DESC, engram_id) AS n FROM m1) WHERE n <= 40),
g2 AS (SELECT query_id, target AS engram_id, 1 - product(1 - a * weight * 0.4225::DOUBLE) AS a FROM s1 JOIN fan ON fan.source = s1.engram_id WHERE touched GROUP BY ALL),
m2 AS (SELECT coalesce(s.query_id, g.query_id) AS query_id, coalesce(s.engram_id, g.engram_id) AS engram_id, greatest(coalesce(s.a, 0), coalesce(g.a, 0)) AS a FROM s1 s FULL JOIN g2 g ON s.query_id = g.query_id AND s.engram_id = g.engram_id)
SELECT query_id, engram_id, round(a, 6) AS activation FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(a, 12) DESC, engram_id) AS n FROM m2) WHERE n <= 40""")
def activation_2hop(spark, d):
    asked = spark.sql("SELECT * FROM VALUES (0, array('small', 'ring', 'economy')), (1, array('red', 'widget', 'small')) v(query_id, terms)")
    start = graph.seeds(t.engrams(spark, d), asked, limit=12)
    return graph.activate(start, _edges(spark, d), hops=2, fanout=12, max_nodes=40).select("query_id", "engram_id", F.round("activation", 6).alias("activation"))


@query("view_edges_topk", f"""WITH {ENGRAMS}, c AS (SELECT source, target, weight FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY weight DESC, evidence_count DESC, target) AS n FROM edges WHERE relation = 'SHARED_CUE') WHERE n <= 3
  UNION ALL SELECT source, target, weight FROM edges WHERE relation <> 'SHARED_CUE')
SELECT least(source, target) AS a, greatest(source, target) AS b, round(max(weight), 6) AS weight FROM c WHERE source <> target GROUP BY 1, 2""")
def view_edges_topk(spark, d):
    return graph.view_edges(_edges(spark, d)).withColumn("weight", F.round("weight", 6))


_ROUND = """l{n} AS MATERIALIZED (SELECT nodes.node, coalesce(w.label, l.label) AS label FROM nodes JOIN l{p} l USING (node) LEFT JOIN (SELECT a AS node, max({{'w': w, 'label': label}}).label AS label FROM (SELECT a, label, round(sum(weight), 9) AS w FROM both_ JOIN l{p} ON b = node GROUP BY ALL) GROUP BY a) w USING (node))"""


@query("label_regions", f"""WITH {ENGRAMS}, c AS (SELECT source, target, weight FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY weight DESC, evidence_count DESC, target) AS n FROM edges WHERE relation = 'SHARED_CUE') WHERE n <= 3
  UNION ALL SELECT source, target, weight FROM edges WHERE relation <> 'SHARED_CUE'),
v AS (SELECT least(source, target) AS a, greatest(source, target) AS b, max(weight) AS weight FROM c WHERE source <> target GROUP BY 1, 2),
both_ AS MATERIALIZED (SELECT * FROM v UNION ALL SELECT b, a, weight FROM v), nodes AS (SELECT p_partkey AS node FROM part), l0 AS (SELECT node, node AS label FROM nodes),
{', '.join(_ROUND.format(n=n, p=n - 1) for n in range(1, 13))} SELECT node, label FROM l12""")
def label_regions(spark, d):
    nodes = t.read(spark, d, "part").select(F.col("p_partkey").alias("node"))
    return graph.regions(nodes, graph.view_edges(_edges(spark, d)))


@query("merged_regions")
def merged_regions(spark, d):
    nodes = t.read(spark, d, "part").select(F.col("p_partkey").alias("node"))
    links = graph.view_edges(_edges(spark, d))
    return graph.merge_small(graph.regions(nodes, links), links)


@query("region_topics")
def region_topics(spark, d):
    terms = t.engrams(spark, d).select(F.col("engram_id").alias("node"), F.explode("terms").alias("term"))
    return graph.region_topics(merged_regions(spark, d), terms).withColumn("score", F.round("score", 6))


@query("scope_topics", f"""WITH {ENGRAMS}, n AS (SELECT scope AS label, term, count(*) AS n FROM wd WHERE len(term) > 1 AND NOT regexp_matches(term, '[0-9]') GROUP BY ALL HAVING count(*) > 1), df AS (SELECT term, count(*) AS df FROM wd GROUP BY 1)
SELECT label, term, round(score, 6) AS score, place FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(score, 9) DESC, term) AS place FROM (SELECT label, term, n * ln((SELECT count(*) FROM eng)::DOUBLE / df) AS score FROM n JOIN df USING (term))) WHERE place <= 3""")
def scope_topics(spark, d):
    e = t.engrams(spark, d)
    terms = e.select(F.col("engram_id").alias("node"), F.explode("terms").alias("term"))
    return graph.region_topics(e.select(F.col("engram_id").alias("node"), F.col("scope").alias("label")), terms).withColumn("score", F.round("score", 6))
