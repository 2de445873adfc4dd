"""Query catalogue, third part: intake checks, promotion, profiles, views, coverage, code symbols."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.catalogue import MEMORIES, TURNS
from evidentia.functions import code, text as tx
from evidentia.operators import evaluate, graph, intake, lexical, memories as mem, turns as tn
from evidentia.plans import typed
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


def key_sql(x: str) -> str:
    return rf"trim(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}_]+', ' ', 'g'))"


# ---- ids and arguments -----------------------------------------------------------------------


@query("entity_ids", f"""SELECT p_partkey, 'entity_' || substr(sha256(p_type || '::' || {key_sql('p_name')}), 1, 16) AS shared_id,
  'entity_' || substr(sha256(p_partkey || '::' || p_type || '::' || {key_sql('p_brand')}), 1, 20) AS own_id FROM part""")
def entity_ids(spark, d):
    own = intake.entity_id(F.col("p_type"), F.col("p_brand"), owner=F.col("p_partkey").cast("string"))
    return t.read(spark, d, "part").select("p_partkey", intake.entity_id(F.col("p_type"), F.col("p_name")).alias("shared_id"), own.alias("own_id"))


@query("engram_ids", """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'conversation:' || c_custkey WHEN 1 THEN 'memory:' || c_custkey WHEN 2 THEN 'development:' || c_custkey ELSE 'memory:' || c_custkey END AS engram_id FROM customer""")
def engram_ids(spark, d):
    kind = F.element_at(F.array(*[F.lit(x) for x in ("conversation-turn:", "memory:", "development:", "")]), (F.col("c_custkey") % 4 + 1).cast("int"))
    return t.read(spark, d, "customer").select("c_custkey", intake.engram_of(F.concat(kind, F.col("c_custkey").cast("string"))).alias("engram_id"))


@query("unsafe_arguments", """SELECT page_id, regexp_matches(url, '[\"''`$;&|<>%^!\\r\\n]') AS unsafe FROM pages""")
def unsafe_arguments(spark, d):
    return t.read(spark, d, "pages").select("page_id", intake.unsafe_argument(F.col("url")).alias("unsafe"))


# ---- what extraction brings ------------------------------------------------------------------


@query("alias_cues", r"""WITH c AS (SELECT c_custkey, ['plan', 'abstain', 'other'][CASE WHEN c_custkey % 11 = 0 THEN 3 WHEN c_custkey % 5 = 0 THEN 2 ELSE 1 END] AS status,
  CASE WHEN c_custkey % 10 = 0 THEN [] ELSE [c_mktsegment, lower(c_mktsegment), 'nation  ' || c_nationkey, ' Group ' || (c_custkey % 3)] || CASE WHEN c_custkey % 7 = 0 THEN ['x'] WHEN c_custkey % 4 = 0 THEN ['one more'] ELSE [] END END AS cues FROM customer WHERE c_mktsegment IS NOT NULL),
f AS (SELECT *, list_transform(cues, lambda c: trim(regexp_replace(c, '\s+', ' ', 'g'))) AS folded FROM c),
u AS (SELECT *, list_filter(folded, lambda c, i: list_position(list_transform(folded, lambda x: lower(x)), lower(c)) = i) AS once FROM f),
e AS (SELECT *, CASE WHEN status = 'other' THEN 'INVALID_ALIAS_SCHEMA' WHEN status = 'abstain' AND len(cues) > 0 THEN 'ABSTAIN_ALIAS_HAS_CUES' WHEN status = 'plan' AND len(list_filter(folded, lambda c: len(c) NOT BETWEEN 2 AND 80)) > 0 THEN 'INVALID_ALIAS_CUE' WHEN status = 'plan' AND len(once) < 3 THEN 'INSUFFICIENT_DISTINCT_ALIAS_CUES' END AS error FROM u)
SELECT c_custkey, error, CASE WHEN error IS NULL THEN array_to_string(once, ',') END AS cues FROM e""")
def alias_cues(spark, d):
    k = F.col("c_custkey")
    more = F.when(k % 7 == 0, F.array(F.lit("x"))).when(k % 4 == 0, F.array(F.lit("one more"))).otherwise(F.array().cast("array<string>"))
    cues = F.concat(F.array("c_mktsegment", F.lower("c_mktsegment"), F.concat(F.lit("nation  "), "c_nationkey"), F.concat(F.lit(" Group "), k % 3)), more)
    status = F.when(k % 11 == 0, "other").when(k % 5 == 0, "abstain").otherwise("plan")
    plans = t.read(spark, d, "customer").filter("c_mktsegment IS NOT NULL").select("c_custkey", status.alias("status"), F.when(k % 10 == 0, F.array().cast("array<string>")).otherwise(cues).alias("alias_cues"))
    return intake.alias_cues(plans).select("c_custkey", "error", F.array_join("cues", ",").alias("cues"))


_SAID = f"""{TURNS}, said AS (SELECT turn_id, session_id, content, revision, source_ordinal AS turn, {key_sql('content')} AS said, string_split({key_sql('content')}, ' ') AS w FROM turns WHERE content IS NOT NULL AND content <> '')"""


def _said(spark, d):
    turns = t.turns(spark, d).filter("content IS NOT NULL AND content <> ''")
    return turns.withColumn("w", F.split(tx.entity_key(F.col("content")), " "))


@query("tags_grounded", f"""WITH {_SAID}, e AS (SELECT turn_id AS event_id, session_id, turn_id, CASE WHEN turn % 2 = 0 THEN w[1] ELSE '' END AS name, list_slice(w, 1, 2) || ['absent alias'] AS aliases, list_slice(w, 3, 3) || ['absent_tag'] AS tags FROM said),
a AS (SELECT e.event_id, list_filter(e.aliases, lambda x: contains(s.said, x)) AS found FROM e JOIN said s USING (turn_id)),
g AS (SELECT e.event_id, u.tag, string_agg(s.turn_id, ',' ORDER BY s.turn_id) AS places FROM e, UNNEST(e.tags) u(tag), said s WHERE s.session_id = e.session_id AND contains(s.said, replace(u.tag, '_', ' ')) AND (s.turn_id = e.turn_id OR e.name = '' OR contains(s.said, e.name)) GROUP BY ALL)
SELECT event_id, array_to_string(found, ',') AS aliases, coalesce(tag, '') AS tags, coalesce(places, '') AS tag_turns FROM a LEFT JOIN g USING (event_id)""")
def tags_grounded(spark, d):
    said = _said(spark, d)
    events = said.select(
        F.col("turn_id").alias("event_id"),
        "session_id",
        F.array("turn_id").alias("cited"),
        F.when(F.col("source_ordinal") % 2 == 0, F.col("w")[0]).otherwise("").alias("name"),
        F.concat(F.slice("w", 1, 2), F.array(F.lit("absent alias"))).alias("object_aliases"),
        F.concat(F.slice("w", 3, 1), F.array(F.lit("absent_tag"))).alias("category_tags"),
    )
    out = intake.grounded(events, said)
    tag = F.coalesce(F.try_element_at("tags", F.lit(1)), F.lit(""))
    return out.select("event_id", F.array_join("aliases", ",").alias("aliases"), tag.alias("tags"), F.coalesce(F.array_join(F.try_element_at("tag_turns", tag), ","), F.lit("")).alias("tag_turns"))


@query("participants_grounded", f"""WITH {_SAID}, p AS (SELECT turn_id AS event_id, session_id || '-' || (turn + (revision % 3 = 0)::INT) AS at, turn_id, substr(content, 1, 20) AS quote, w[1] AS name, revision FROM said)
SELECT event_id, p.at = p.turn_id AND revision % 5 <> 0 AND revision % 7 <> 0 AND trim(quote) <> '' AND name <> '' AND contains(' ' || {key_sql('quote')} || ' ', ' ' || name || ' ') AS valid FROM p""")
def participants_grounded(spark, d):
    said = _said(spark, d)
    r = F.col("revision")
    rows = said.select(
        F.col("turn_id").alias("event_id"),
        F.col("turn_id").alias("memory_id"),
        "session_id",
        F.array("turn_id").alias("cited"),
        F.concat("session_id", F.lit("-"), F.col("source_ordinal") + (r % 3 == 0).cast("int")).alias("turn_id"),
        F.substring("content", 1, 20).alias("quote"),
        F.col("w")[0].alias("name"),
        F.when(r % 5 == 0, "NOBODY").otherwise("ACTOR").alias("role"),
        F.when(r % 7 == 0, "NONE").otherwise("PERSON").alias("entity_type"),
    )
    return intake.participants(rows, said, ["ACTOR"], ["PERSON", "NONE"]).select("event_id", "valid")


@query("money_units", """SELECT event_id, CASE WHEN event_id % 3 <> 0 AND event_id % 5 <> 0 AND event_id % 7 <> 0 AND value >= 0 THEN ['$', '£', '€'][event_id % 3 + 1] END AS recovered_unit FROM events WHERE value IS NOT NULL""")
def money_units(spark, d):
    e, k = t.read(spark, d, "events").filter("value IS NOT NULL"), F.col("event_id")
    symbol = F.element_at(F.array(F.lit("$"), F.lit("£"), F.lit("€")), (k % 3 + 1).cast("int"))
    price = F.col("value").cast("string")
    content = F.concat(F.lit("it cost "), symbol, price, F.when(k % 5 == 0, F.concat(F.lit(", not ¥ or $ but £"), price, F.lit(" or $"), price)).otherwise("."))
    turns = e.select(F.col("user_id").alias("session_id"), k.alias("turn_id"), content.alias("content"))
    events = e.select(k, F.col("user_id").alias("session_id"), F.array(k).alias("cited"), F.when(k % 7 == 0, "NUMBER").otherwise("MONEY").alias("value_type"), F.when(k % 3 == 0, "EUR").alias("unit"), F.col("value").alias("numeric_value"))
    return intake.money_units(events, turns).select("event_id", "recovered_unit")


# ---- benchmark instances ---------------------------------------------------------------------


def _instances(spark, d):
    c = t.read(spark, d, "conversations")
    marked = (F.col("conv_id") * 7 + F.col("turn")) % 5 == 0
    turn = F.struct("turn", "role", F.col("text").alias("content"), marked.alias("has_answer"))
    s = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns")).withColumn("q", F.floor(F.col("conv_id") / 3))
    i = s.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("conv_id", "turns"))).alias("s"))
    days = F.transform("s", lambda x: F.concat(F.lit("2024/01/0"), x["conv_id"] % 9 + 1))
    return i.select(
        F.col("q").alias("question_id"),
        F.when(F.col("q") % 5 == 0, "odd").otherwise("multi-session").alias("question_type"),
        F.when(F.col("q") % 7 == 0, "soon").otherwise("2024/02/01").alias("question_date"),
        F.when(F.col("q") % 6 == 0, F.slice(days, 2, 1000)).otherwise(days).alias("haystack_dates"),
        F.transform("s", lambda x: x["conv_id"].cast("string")).alias("haystack_session_ids"),
        F.transform("s", lambda x: x["turns"]).alias("haystack_sessions"),
    )


@query("instance_errors", """WITH i AS (SELECT conv_id // 3 AS q, bool_or(role IS NULL OR role NOT IN ('user', 'assistant')) AS bad, bool_or(text IS NULL) AS void FROM conversations GROUP BY 1)
SELECT q AS question_id, array_to_string(list_filter([CASE WHEN q % 5 = 0 THEN 'unknown question_type: odd' END, CASE WHEN q % 7 = 0 THEN 'bad question_date' END, CASE WHEN q % 6 = 0 THEN 'parallel session lengths differ' END, CASE WHEN q % 6 <> 0 AND bad THEN 'bad role' END, CASE WHEN q % 6 <> 0 AND void THEN 'turn content is not text' END], lambda x: x IS NOT NULL), '; ') AS errors FROM i""")
def instance_errors(spark, d):
    return intake.instance_errors(_instances(spark, d), ["multi-session"]).select("question_id", F.array_join("errors", "; ").alias("errors"))


@query("evidence_sessions", "SELECT DISTINCT conv_id // 3 AS question_id, conv_id::VARCHAR AS session_id FROM conversations WHERE (conv_id * 7 + turn) % 5 = 0")
def evidence_sessions(spark, d):
    return intake.evidence_sessions(_instances(spark, d))


# ---- promotion, indexing, deletion -----------------------------------------------------------


@query("promotion", f"""WITH {TURNS}, n AS (SELECT *, content || CASE WHEN source_ordinal % 4 = 0 THEN ' 기억해' ELSE '' END AS said FROM turns WHERE revision % 3 <> 0 AND content IS NOT NULL)
SELECT turn_id, 'FACT: ' || substr(said, 1, 80) AS title, 'conversation-turn:' || turn_id || '#chars=0-' || len(said) AS source_ref, 0.85::DOUBLE AS importance FROM n WHERE role = 'user' AND source_ordinal % 4 = 0 AND NOT contains(said, '[REDACTED')""")
def promotion(spark, d):
    turns = t.turns(spark, d).filter("content IS NOT NULL").withColumn("content", F.concat("content", F.when(F.col("source_ordinal") % 4 == 0, " 기억해").otherwise("")))
    made, _ = intake.promote(turns, turns.filter("revision % 3 = 0"))
    return made.select(F.replace("related", F.lit("conversation-turn:"), F.lit("")).alias("turn_id"), "title", "source_ref", "importance")


@query("unindexed_sources", f"""WITH {TURNS} SELECT 'conversation:' || turn_id AS engram_id FROM turns WHERE revision % 4 <> 1""")
def unindexed_sources(spark, d):
    turns = t.turns(spark, d)
    done = turns.filter("revision % 4 = 1").select(F.concat(F.lit("conversation:"), "turn_id").alias("engram_id"))
    return intake.unindexed(turns, done, "conversation", "turn_id").select("engram_id")


@query("erase_by_hash", f"""WITH {TURNS} SELECT turn_id AS id FROM turns WHERE client = 'c1' AND role = 'user' AND content IN (SELECT content FROM turns WHERE revision % 5 = 0)""")
def erase_by_hash(spark, d):
    turns = t.turns(spark, d)
    return intake.doomed_by_hash(turns, turns.filter("revision % 5 = 0"), "c1")


@query("scrubbed_lines", f"""WITH {TURNS} SELECT turn_id AS id, strlen(content) AS bytes, source_ordinal % 2 = 0 OR trim(content, ' ') = '' AS blank FROM turns WHERE content IS NOT NULL""")
def scrubbed_lines(spark, d):
    lines = t.turns(spark, d).filter("content IS NOT NULL").select(F.col("turn_id").alias("id"), F.col("content").alias("value"), "source_ordinal")
    out = intake.scrubbed(lines, lines.filter("source_ordinal % 2 = 0"))
    return out.select("id", F.octet_length("value").cast("long").alias("bytes"), (F.trim("value") == "").alias("blank"))


# ---- views -----------------------------------------------------------------------------------


@query("memory_profiles", f"""WITH {MEMORIES} SELECT memory_id, CASE WHEN memory_id % 2 = 0 THEN 'STATE' WHEN memory_id % 3 = 0 THEN 'DECISION' ELSE 'EPISODE' END AS memory_class,
  CASE WHEN memory_id % 2 = 0 THEN 'CODE' ELSE 'MANUAL' END AS modality, CASE WHEN memory_id % 2 = 0 THEN 0.9 WHEN memory_id % 3 = 0 THEN 0.7 ELSE 0.5 END::DOUBLE AS importance FROM mem""")
def memory_profiles(spark, d):
    m = t.memories(spark, d)
    kind = F.when(F.col("memory_id") % 3 == 0, "user_decision").otherwise("note")
    stored = m.filter("memory_id % 2 = 0").select("memory_id", F.lit("STATE").alias("memory_class"), F.lit("CODE").alias("modality"), F.lit("DURABLE").alias("retention"), F.lit(0.9).alias("importance"), F.lit(1.0).alias("confidence"))
    out = mem.with_profiles(m.withColumn("memory_type", kind).withColumn("source_type", F.lit("manual")), stored)
    return out.select("memory_id", "memory_class", "modality", "importance")


@query("view_nodes", rf"""WITH {TURNS}, {MEMORIES} SELECT 'conversation:' || turn_id AS id, role, substr(trim(regexp_replace(content, '\s+', ' ', 'g')), 1, 160) AS "text" FROM turns
UNION ALL SELECT 'memory:' || memory_id, '', title || ': ' || amount::VARCHAR FROM mem""")
def view_nodes(spark, d):
    turns, memories = t.turns(spark, d), t.memories(spark, d)
    said = turns.select(F.concat(F.lit("conversation:"), "turn_id").alias("engram_id"), F.lit("CONVERSATION").alias("source_kind"), F.col("turn_id").alias("source_id"), "scope", "happened_at")
    held = memories.select(F.concat(F.lit("memory:"), F.col("memory_id").cast("string")).alias("engram_id"), F.lit("LOCAL_MEMORY").alias("source_kind"), F.col("memory_id").cast("string").alias("source_id"), "scope", F.col("effective_at").alias("happened_at"))
    return graph.view_nodes(said.unionByName(held), turns, memories).select("id", "role", "text")


@query("largest_regions", "SELECT p_brand AS label, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, min(p_partkey) LIMIT 12")
def largest_regions(spark, d):
    return graph.largest_regions(t.read(spark, d, "part").select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("label")))


# ---- turns -----------------------------------------------------------------------------------


@query("role_mask", f"""WITH {TURNS} SELECT turn_id FROM turns WHERE role IN ('user', 'document') OR session_id::INT % 4 = 0""")
def role_mask(spark, d):
    return tn.searchable(t.turns(spark, d), F.col("session_id").cast("int") % 4 == 0).select("turn_id")


@query("echo_suppressed", rf"""WITH {TURNS}, q AS (SELECT session_id, trim(regexp_replace(content, '\s+', ' ', 'g')) AS said FROM turns WHERE source_ordinal = 0)
SELECT turn_id FROM turns JOIN q USING (session_id) WHERE coalesce(trim(regexp_replace(content, '\s+', ' ', 'g')) <> said, true)""")
def echo_suppressed(spark, d):
    turns = t.turns(spark, d)
    asked = turns.filter("source_ordinal = 0").select(F.col("session_id").alias("query_id"), F.col("content").alias("query"))
    return tn.without_echoes(turns.withColumnRenamed("session_id", "query_id"), asked).select("turn_id")


@query("pending_vectors", f"""WITH {TURNS} SELECT turn_id, role FROM turns WHERE revision % 5 <> 2 AND role IN ('user', 'assistant', 'document') ORDER BY role = 'assistant', happened_at DESC, turn_id LIMIT 100""")
def pending_vectors(spark, d):
    turns = t.turns(spark, d)
    return tn.to_embed(turns, turns.filter("revision % 5 = 2"), 100).select("turn_id", "role")


@query("total_questions", r"""SELECT conv_id, turn, regexp_matches(lower(CASE WHEN turn % 3 = 0 THEN 'How MANY of ' ELSE 'some of ' END || text), '\b(how many|how much|total|in all|altogether|combined|sum of)\b') AS asks_total FROM conversations WHERE text IS NOT NULL""")
def total_questions(spark, d):
    said = F.concat(F.when(F.col("turn") % 3 == 0, "How MANY of ").otherwise("some of "), "text")
    return t.read(spark, d, "conversations").filter("text IS NOT NULL").select("conv_id", "turn", tn.asks_total(said).alias("asks_total"))


@query("participant_postings", """SELECT l_orderkey AS event_id FROM lineitem WHERE l_partkey % 100 < 40 INTERSECT SELECT l_orderkey FROM lineitem WHERE l_suppkey IN (0, 1, 2, 3, 4) INTERSECT SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'""")
def participant_postings(spark, d):
    lines = t.read(spark, d, "lineitem")
    part = lines.select(F.col("l_orderkey").alias("event_id"), F.lit("part").alias("role"), (F.col("l_partkey") % 100).alias("entity_id"))
    seller = lines.select(F.col("l_orderkey").alias("event_id"), F.lit("seller").alias("role"), F.col("l_suppkey").alias("entity_id"))
    final = t.read(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("event_id"))
    return typed.bound_events(part.unionByName(seller), [("part", list(range(40))), ("seller", list(range(5)))], final)


# ---- evaluation ------------------------------------------------------------------------------

_SWEEP = """r AS (SELECT CASE WHEN event_id % 3 = 0 THEN 'EXACT' ELSE 'VAGUE' END AS style, event_id % 4 <> 0 AS expected, (event_id * 37 % 101) / 100.0::DOUBLE AS coverage, event_id % 5 < 3 AS hit5, event_id % 6 <> 0 AS answered FROM events)"""


def _graded(spark, d):
    k = F.col("event_id")
    return t.read(spark, d, "events").select(F.when(k % 3 == 0, "EXACT").otherwise("VAGUE").alias("style"), (k % 4 != 0).alias("expected"), (k * 37 % 101 / 100.0).alias("coverage"), (k % 5 < 3).alias("hit5"), (k % 6 != 0).alias("answered"))


@query("coverage_sweep", f"""WITH {_SWEEP}, h AS (SELECT unnest([0.2, 0.35, 0.5, 0.65, 0.85])::DOUBLE AS threshold), m AS (SELECT * FROM r, h)
SELECT threshold, round(avg((coverage >= threshold AND hit5)::INT) FILTER (expected AND style = 'VAGUE'), 9) AS vague_hit5, round(avg((coverage >= threshold AND hit5)::INT) FILTER (expected AND style = 'EXACT'), 9) AS exact_hit5, round(avg((coverage >= threshold AND answered)::INT) FILTER (NOT expected), 9) AS control_false FROM m GROUP BY 1""")
def coverage_sweep(spark, d):
    out = evaluate.threshold_sweep(_graded(spark, d), [0.2, 0.35, 0.5, 0.65, 0.85])
    return out.select("threshold", *[F.round(c, 9).alias(c) for c in ("vague_hit5", "exact_hit5", "control_false")])


@query("coverage_separation", f"""WITH {_SWEEP} SELECT CASE WHEN NOT expected THEN 'control' ELSE lower(style) END AS style, min(coverage) AS least, max(coverage) AS most, round(avg(coverage), 4) AS mean FROM r GROUP BY 1""")
def coverage_separation(spark, d):
    return evaluate.separation(_graded(spark, d))


@query("cue_coverage", """WITH c AS (SELECT label AS q, vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT label AS q, embedding::DOUBLE[] AS v FROM embeddings),
b AS (SELECT c.q, c.vec_id, max(list_cosine_similarity(c.v, s.v)) AS best FROM c JOIN s USING (q) WHERE true GROUP BY ALL) SELECT q AS query_id, round(avg(best), 6) AS coverage FROM b GROUP BY q""")
def cue_coverage(spark, d):
    e = t.read(spark, d, "embeddings").select(F.col("label").alias("query_id"), F.col("vec_id").alias("cue_id"), F.col("embedding").cast("array<double>").alias("v"))
    return evaluate.cue_coverage(e.filter("cue_id % 50 = 0"), e.select("query_id", "v")).select("query_id", F.round("coverage", 6).alias("coverage"))


@query("entity_index_quality", f"""WITH x AS (SELECT DISTINCT {key_sql('p_brand')} AS entity_key, l_orderkey AS memory_id FROM lineitem JOIN part ON l_partkey = p_partkey), g AS (SELECT entity_key, memory_id FROM x WHERE memory_id % 10 <> 3 UNION SELECT entity_key, -memory_id - 1 FROM x WHERE memory_id % 4 = 1),
b AS (SELECT entity_key, x.memory_id AS e, g.memory_id AS r FROM x FULL JOIN g USING (entity_key, memory_id))
SELECT entity_key, count(e) AS expected, count(r) AS returned, round(count(e + r) / count(e), 9) AS recall, round(count(e + r) / greatest(count(r), 1), 9) AS "precision" FROM b GROUP BY 1 HAVING count(e) > 0""")
def entity_index_quality(spark, d):
    truth = t.entity_rows(spark, d).select(tx.entity_key(F.col("entity")).alias("entity_key"), "memory_id").distinct()
    extra = truth.filter("memory_id % 4 = 1").select("entity_key", (-F.col("memory_id") - 1).alias("memory_id"))
    out = evaluate.index_quality(truth, truth.filter("memory_id % 10 <> 3").unionByName(extra))
    return out.select("entity_key", "expected", "returned", F.round("recall", 9).alias("recall"), F.round("precision", 9).alias("precision"))


_STEM = """CASE WHEN len(w) > 4 THEN CASE WHEN ends_with(w, 'ing') THEN w[:-4] WHEN ends_with(w, 'ed') OR ends_with(w, 'es') THEN w[:-3] WHEN ends_with(w, 's') OR ends_with(w, 'e') THEN w[:-2] ELSE w END ELSE w END"""
_FUNCTION_WORDS = ", ".join(f"'{w}'" for w in lexical.FUNCTION_WORDS)


@query("stemmed_scores", f"""WITH w AS (SELECT p_partkey AS doc_id, unnest(regexp_extract_all(lower(p_name || ' ' || p_type || ' ' || p_brand), '[a-z0-9]+')) AS w FROM part),
s AS (SELECT doc_id, {_STEM} AS term FROM w WHERE w NOT IN ({_FUNCTION_WORDS})), z AS (SELECT doc_id, count(*) AS size FROM s GROUP BY 1), a AS (SELECT count(*) AS n, avg(size) AS mean FROM z),
p AS (SELECT term, doc_id, count(*) AS tf FROM s GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
qw AS (SELECT DISTINCT c_mktsegment AS query_id, unnest(regexp_extract_all(lower('the cold standards of ' || c_mktsegment || ' and economies'), '[a-z0-9]+')) AS w FROM customer), q AS (SELECT DISTINCT query_id, {_STEM} AS term FROM qw WHERE w NOT IN ({_FUNCTION_WORDS}))
SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * size / mean))), 6) AS score FROM q JOIN p USING (term) JOIN f USING (term) JOIN z USING (doc_id), a GROUP BY ALL""")
def stemmed_scores(spark, d):
    docs = t.read(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("text"))
    asked = t.read(spark, d, "customer").select(F.col("c_mktsegment").alias("query_id")).distinct().withColumn("query", F.concat(F.lit("the cold standards of "), "query_id", F.lit(" and economies")))
    return lexical.stemmed_scores(docs, asked).select("query_id", "doc_id", F.round("score", 6).alias("score"))


# ---- code ------------------------------------------------------------------------------------


@query("code_symbols", """SELECT 'src/' || p_partkey || '.py' AS path, CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'BEFORE Part,BEFORE Part.size,AFTER Part,AFTER Part.size' WHEN 2 THEN 'BEFORE label,AFTER label' ELSE 'AFTER <module>' END AS touched FROM part""")
def code_symbols(spark, d):
    k = F.col("p_partkey")
    text = lambda size, label, top: F.concat(F.lit("class Part:\n    def size(self):\n        return "), size, F.lit("\n\n\ndef label():\n    return '"), label, F.lit("'\n\n\n"), top, F.lit("\n"))
    size, label, top = F.col("p_size").cast("string"), F.col("p_name"), F.lit("LIMIT = 1")
    new = text(F.when(k % 4 == 1, F.concat(size, F.lit("0"))).otherwise(size), F.when(k % 4 == 2, F.concat(label, F.lit("!"))).otherwise(label), F.when(k % 4 == 3, "LIMIT = 2").otherwise(top))
    files = t.read(spark, d, "part").select(F.concat(F.lit("src/"), k, F.lit(".py")).alias("path"), text(size, label, top).alias("before"), new.alias("after"))
    touched = F.transform("symbols", lambda s: F.concat(s["side"], F.lit(" "), s["name"]))
    return code.changed_files(files).select("path", F.array_join(touched, ",").alias("touched"))
