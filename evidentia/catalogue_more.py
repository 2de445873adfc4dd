"""Query catalogue, second part: history, sharing, typed plans, state, dates, gates, evaluation, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidentia.catalogue import MEMORIES, TURNS, _QUESTIONS, _whole_pool
from evidentia.functions import classify, dates, security, text as tx
from evidentia.operators import evaluate, history, packing, ranking, sharing, state
from evidentia.plans import typed
from evidentia.sources import tables as t
from evidentia.sources.scratch import shared_dir
from evidentia.streaming import flows

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def day(c, name=None):
    return F.date_format(c, "yyyy-MM-dd").alias(name or c)


# ---- entities, code, documents ---------------------------------------------------------------

ENTITIES = f"{MEMORIES}, ent AS (SELECT DISTINCT l_orderkey AS memory_id, p_brand AS entity FROM lineitem JOIN part ON l_partkey = p_partkey)"
_KEY = "trim(regexp_replace(lower(entity), '[^a-z0-9_]+', ' ', 'g'))"


@query("entity_catalogue", f"""WITH {ENTITIES} SELECT {_KEY} AS entity_key, min(entity) AS label, count(*) AS memories, strftime(max(effective_at), '%Y-%m-%d') AS last_at FROM ent JOIN mem USING (memory_id) GROUP BY 1""")
def entity_catalogue(spark, d):
    rows = t.entity_rows(spark, d).join(t.memories(spark, d).select("memory_id", "effective_at"), "memory_id")
    return history.entity_catalogue(rows).withColumn("last_at", day("last_at"))


@query("entity_timeline", f"""WITH {ENTITIES} SELECT memory_id, {_KEY} AS entity_key, strftime(effective_at, '%Y-%m-%d') AS effective_at, memory_id IN (SELECT supersedes FROM mem WHERE supersedes IS NOT NULL) AS superseded FROM ent JOIN mem USING (memory_id) WHERE contains({_KEY}, 'brand 1')""")
def entity_timeline(spark, d):
    return history.entity_timeline(t.entity_rows(spark, d), t.memories(spark, d), "Brand 1").select("memory_id", "entity_key", day("effective_at"), "superseded")


SNAPSHOTS = """b AS (SELECT 'src/' || p_partkey || '.py' AS path, sha256(p_name || '|' || p_size) AS sha FROM part WHERE p_partkey % 10 <> 0),
a AS (SELECT 'src/' || p_partkey || '.py' AS path, sha256(p_name || '|' || (p_size + (p_partkey % 4 = 0)::INT)) AS sha FROM part WHERE p_partkey % 10 <> 1)"""


@query("manifest_diff", f"""WITH {SNAPSHOTS} SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'ADDED' WHEN a.path IS NULL THEN 'DELETED' ELSE 'MODIFIED' END AS change, b.sha AS before_sha, a.sha AS after_sha FROM b FULL JOIN a ON a.path = b.path WHERE a.sha IS DISTINCT FROM b.sha""")
def manifest_diff(spark, d):
    return history.manifest_diff(*t.snapshots(spark, d))


def _changes(spark, d):
    return t.read(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("change_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("revision"), F.concat(F.lit("p"), F.col("l_suppkey") % 7).alias("project_id"), F.concat(F.lit("pkg/m"), F.col("l_partkey") % 50, F.lit(".py")).alias("file_path"), F.col("l_returnflag").alias("change_kind"), F.col("l_shipdate").alias("happened_at"), F.col("l_partkey").alias("part")
    )


CHANGES = """ch AS (SELECT l_orderkey * 10 + l_linenumber AS change_id, l_orderkey * 10 + l_linenumber AS revision, 'p' || (l_suppkey % 7) AS project_id, 'pkg/m' || (l_partkey % 50) || '.py' AS file_path, l_returnflag AS change_kind, l_shipdate AS happened_at, l_partkey AS part FROM lineitem)"""


@query("code_activity", f"""WITH {CHANGES} SELECT change_id, file_path FROM ch WHERE (file_path = 'm7.py' OR ends_with(file_path, '/m7.py')) AND change_kind = 'R' AND happened_at >= TIMESTAMP '1996-01-01' AND happened_at <= TIMESTAMP '1999-12-31'""")
def code_activity(spark, d):
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    return history.code_activity(_changes(spark, d), path="m7.py", kind="R", since=at("1996-01-01"), until=at("1999-12-31"), limit=None).select("change_id", "file_path")


@query("code_by_symbol", f"""WITH {CHANGES} SELECT change_id FROM ch WHERE project_id = 'p3' AND change_id IN (SELECT change_id FROM ch JOIN part ON p_partkey = ch.part WHERE contains(p_name, 'ring'))""")
def code_by_symbol(spark, d):
    ch = _changes(spark, d)
    part = t.read(spark, d, "part").select(F.col("p_partkey").alias("part"), F.col("p_name").alias("symbol_name"))
    symbols = ch.join(part, "part").select("change_id", "symbol_name")
    return history.code_activity(ch, project="p3", symbol="ring", symbols=symbols, limit=None).select("change_id")


@query("code_newest", f"""WITH {CHANGES} SELECT DISTINCT project_id, file_path, change_id FROM (SELECT *, max(revision) OVER (PARTITION BY project_id, file_path) AS last FROM ch) WHERE revision = last""")
def code_newest(spark, d):
    return history.newest_changes(_changes(spark, d)).select("project_id", "file_path", "change_id").distinct()


@query("docs_sections")
def docs_sections(spark, d):
    docs = t.document_turns(spark, d).withColumn("content", F.regexp_replace("content", r"(?m)^(\S+)\.$", "# $1"))
    return history.document_sections(docs)


def _sections(spark, d, shift):
    docs = t.read(spark, d, "documents").select("doc_id", F.col("source").alias("path"), F.posexplode(F.split("text", "\n")).alias("n", "body"))
    return docs.filter(f"(doc_id + n) % 9 <> {shift}").select("path", F.sha2("body", 256).alias("body_sha")).distinct()


@query("docs_replaced", """WITH s AS (SELECT source AS path, doc_id, unnest(string_split(text, chr(10))) AS body, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents),
o AS (SELECT DISTINCT path, sha256(body) AS body_sha FROM s WHERE (doc_id + n) % 9 <> 0), w AS (SELECT DISTINCT path, sha256(body) AS body_sha FROM s WHERE (doc_id + n) % 9 <> 1)
SELECT * FROM o EXCEPT SELECT * FROM w""")
def docs_replaced(spark, d):
    return history.replaced_sections(_sections(spark, d, 0), _sections(spark, d, 1))


# ---- secrets ---------------------------------------------------------------------------------

_PLAIN = [(n, p) for n, p, _ in security.RULES if "(?!" not in p and "(?=" not in p and "(?<" not in p and "\\2" not in p]


@query("secret_kinds_plain", "SELECT doc_id, concat_ws(',', " + ", ".join(f"CASE WHEN regexp_matches(text, '{p.replace(chr(39), chr(39) * 2)}') THEN '{n}' END" for n, p in _PLAIN) + ") AS kinds FROM documents")
def secret_kinds_plain(spark, d):
    names = F.array(*[F.lit(n) for n, _ in _PLAIN])
    return t.read(spark, d, "documents").select("doc_id", F.array_join(F.filter(security.secret_kinds(F.col("text")), lambda k: F.array_contains(names, k)), ",").alias("kinds"))


@query("secret_kinds")
def secret_kinds(spark, d):
    return t.read(spark, d, "documents").select("doc_id", F.array_join(security.secret_kinds(F.col("text")), ",").alias("kinds"))


@query("redaction")
def redaction(spark, d):
    docs = t.read(spark, d, "documents").select("doc_id", "text", security.redact(F.col("text")).alias("clean"))
    return docs.select("doc_id", security.redaction_count(F.col("text"), F.col("clean")).alias("masks"), "clean")


@query("random_tokens")
def random_tokens(spark, d):
    return t.read(spark, d, "documents").select("doc_id", F.explode(security.random_tokens("text")).alias("token"))


@query("character_entropy", """WITH c AS (SELECT event_id, unnest(string_split(props, '')) AS c FROM events), n AS (SELECT event_id, c, count(*)::DOUBLE AS n FROM c WHERE c <> '' GROUP BY ALL)
SELECT event_id, round(-sum(n / total * log2(n / total)), 6) AS entropy FROM (SELECT *, sum(n) OVER (PARTITION BY event_id) AS total FROM n) GROUP BY 1""")
def character_entropy(spark, d):
    return t.read(spark, d, "events").select("event_id", F.round(security.entropy(F.col("props")), 6).alias("entropy"))


# ---- deletion and sharing --------------------------------------------------------------------


@query("forget_cascade", f"""WITH {TURNS}, doomed AS (SELECT turn_id AS id FROM turns WHERE contains(content, 'eauou')), promo AS (SELECT turn_id, 'memory-' || revision AS memory_id FROM turns WHERE source_ordinal % 2 = 0),
dead AS (SELECT id FROM doomed UNION SELECT memory_id FROM promo WHERE turn_id IN (SELECT id FROM doomed))
SELECT turn_id AS id FROM turns WHERE turn_id NOT IN (SELECT id FROM dead) UNION ALL SELECT memory_id FROM promo WHERE memory_id NOT IN (SELECT id FROM dead)""")
def forget_cascade(spark, d):
    turns = t.turns(spark, d)
    promo = turns.filter("source_ordinal % 2 = 0").select("turn_id", F.concat(F.lit("memory-"), F.col("revision")).alias("memory_id"))
    dead = sharing.cascade(sharing.find(turns, "eauou").select(F.col("turn_id").alias("id")), promo)
    return sharing.erase(turns, dead, "turn_id").select(F.col("turn_id").alias("id")).unionByName(sharing.erase(promo, dead, "memory_id").select(F.col("memory_id").alias("id")))


def _log(spark, d):
    e = t.read(spark, d, "events")
    kind = F.when(F.col("event_id") % 10 == 0, "forget").when(F.col("event_id") % 2 == 0, "memory").otherwise("turn")
    ident = F.when(F.col("event_id") % 10 == 0, F.col("event_id") - 10).otherwise(F.col("event_id") % 4000)
    return e.select(kind.alias("kind"), ident.alias("id"), (F.col("user_id") % 3).alias("device"), F.col("ts").alias("written_at"), "event_id", F.when(F.col("event_id") % 7 == 0, F.col("event_id") % 4000 + 100).alias("supersedes"))


LOG = """log AS (SELECT CASE WHEN event_id % 10 = 0 THEN 'forget' WHEN event_id % 2 = 0 THEN 'memory' ELSE 'turn' END AS kind, CASE WHEN event_id % 10 = 0 THEN event_id - 10 ELSE event_id % 4000 END AS id, user_id % 3 AS device, ts AS written_at, event_id,
  CASE WHEN event_id % 7 = 0 THEN event_id % 4000 + 100 END AS supersedes FROM events),
landed AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY written_at, device) AS n FROM log WHERE kind <> 'forget') WHERE n = 1 AND id NOT IN (SELECT id FROM log WHERE kind = 'forget'))"""


@query("log_merge", f"WITH {LOG} SELECT id, event_id, device FROM landed")
def log_merge(spark, d):
    return sharing.merge_log(_log(spark, d))[0].select("id", "event_id", "device")


@query("log_pending", f"""WITH RECURSIVE {LOG}, w AS (SELECT id FROM landed WHERE supersedes IS NOT NULL AND supersedes NOT IN (SELECT id FROM landed) UNION SELECT l.id FROM landed l JOIN w ON l.supersedes = w.id)
SELECT id, id IN (SELECT id FROM w) AS waits FROM landed""")
def log_pending(spark, d):
    landed = sharing.merge_log(_log(spark, d))[0]
    ready, waiting = sharing.land_pending(landed, spark.createDataFrame([], "id bigint"))
    return ready.select("id", F.lit(False).alias("waits")).unionByName(waiting.select("id", F.lit(True).alias("waits")))


@query("log_lacking", f"WITH {LOG} SELECT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT id FROM log)")
def log_lacking(spark, d):
    return sharing.lacking(t.read(spark, d, "orders").select(F.col("o_orderkey").alias("id")), _log(spark, d))


@query("log_devices", "SELECT DISTINCT user_id % 3 AS device FROM events")
def log_devices(spark, d):
    return sharing.devices(_log(spark, d))


@query("project_export", """SELECT page_id FROM pages WHERE regexp_replace(url, '^https?://', '') = 'm.ththth.example.net/en' OR starts_with(regexp_replace(url, '^https?://', ''), 'm.ththth.example.net/en/')""")
def project_export(spark, d):
    pages = t.read(spark, d, "pages").withColumn("cwd", F.regexp_replace("url", "^https?://", ""))
    return sharing.in_project(pages, "m.ththth.example.net/en").select("page_id")


@query("retry_delays", "SELECT DISTINCT p_size AS attempts, least(3600.0, 60 * pow(2, least(p_size, 6)))::DOUBLE AS delay FROM part")
def retry_delays(spark, d):
    return t.read(spark, d, "part").select(F.col("p_size").alias("attempts")).distinct().withColumn("delay", sharing.retry_delay())


# ---- ledger ----------------------------------------------------------------------------------


def _checkpoints(spark, d):
    c = t.read(spark, d, "customer")
    status = F.when(F.col("c_custkey") % 11 == 0, "retracted").when(F.col("c_custkey") % 13 == 0, "draft").otherwise("published")
    return c.select(F.col("c_nationkey").alias("project"), F.col("c_custkey").alias("checkpoint_id"), F.col("c_custkey").alias("stamp"), status.alias("status"), F.when(F.col("c_custkey") % 7 == 0, F.col("c_custkey") - 25).alias("supersedes"))


LEDGER = """led AS (SELECT c_nationkey AS project, c_custkey AS checkpoint_id, c_custkey AS stamp, CASE WHEN c_custkey % 11 = 0 THEN 'retracted' WHEN c_custkey % 13 = 0 THEN 'draft' ELSE 'published' END AS status, CASE WHEN c_custkey % 7 = 0 THEN c_custkey - 25 END AS supersedes FROM customer)"""


@query("ledger_timeline", f"""WITH {LEDGER} SELECT project, checkpoint_id, place, checkpoint_id IN (SELECT supersedes FROM led WHERE status = 'published' AND supersedes IS NOT NULL) AS superseded
FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY stamp DESC, checkpoint_id DESC) AS place FROM led WHERE status = 'published') WHERE place <= 10""")
def ledger_timeline(spark, d):
    return history.ledger_timeline(_checkpoints(spark, d), limit=10).select("project", "checkpoint_id", "place", "superseded")


@query("ledger_projects", f"WITH {LEDGER} SELECT project, count(*) FILTER (status = 'published') AS published, count(*) FILTER (status = 'retracted') AS retracted, max(stamp) FILTER (status = 'published') AS last_published FROM led GROUP BY 1")
def ledger_projects(spark, d):
    return history.ledger_projects(_checkpoints(spark, d))


@query("ledger_audit", "SELECT o_orderkey AS audit_id, coalesce(c_name, o_custkey::VARCHAR) AS who FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 5 <> 0) ON c_custkey = o_custkey")
def ledger_audit(spark, d):
    audit = t.read(spark, d, "orders").select(F.col("o_orderkey").alias("audit_id"), F.col("o_custkey").alias("member"))
    accounts = t.read(spark, d, "customer").filter("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("member"), F.col("c_name").alias("name"))
    return history.ledger_audit(audit, accounts).select("audit_id", "who")


def _access(spark, d):
    s = t.read(spark, d, "supplier")
    role = F.try_element_at(F.array(*map(F.lit, history.ROLES)), (F.col("s_suppkey") % 3 + 1).cast("int"))
    return s.select(F.col("s_nationkey").alias("project"), (F.col("s_suppkey") % 10).alias("member"), role.alias("role"))


ACCESS = "acc AS (SELECT s_nationkey AS project, s_suppkey % 10 AS member, (['viewer', 'editor', 'owner'])[s_suppkey % 3 + 1] AS role FROM supplier)"


@query("ledger_access", f"WITH {LEDGER}, {ACCESS} SELECT checkpoint_id, project FROM led WHERE project IN (SELECT project FROM acc WHERE member = 4 AND role IN ('editor', 'owner'))")
def ledger_access(spark, d):
    return history.accessible(_checkpoints(spark, d), _access(spark, d), 4, "editor").select("checkpoint_id", "project")


@query("ledger_sole_owned", f"WITH {ACCESS} SELECT DISTINCT project FROM acc WHERE role = 'owner' AND member = 5 AND project NOT IN (SELECT project FROM acc WHERE role = 'owner' AND member <> 5)")
def ledger_sole_owned(spark, d):
    return history.sole_owned(_access(spark, d), 5).distinct()


@query("bind_projects", """WITH f AS (SELECT DISTINCT regexp_replace(url, '[?#].*$', '') AS cwd FROM pages), b AS (SELECT DISTINCT regexp_extract(url, '^https?://[^/?#]+') AS root, length(regexp_extract(url, '^https?://[^/?#]+')) AS project FROM pages UNION SELECT DISTINCT regexp_extract(url, '^https?://[^/?#]+/[a-z]+'), -1 FROM pages WHERE regexp_extract(url, '^https?://[^/?#]+/[a-z]+') <> '')
SELECT cwd, arg_max(project, len(root))::BIGINT AS project FROM f JOIN b ON cwd = root OR starts_with(cwd, root || '/') GROUP BY cwd""")
def bind_projects(spark, d):
    pages = t.read(spark, d, "pages")
    host, folder = F.regexp_extract("url", "^https?://[^/?#]+", 0), F.regexp_extract("url", "^https?://[^/?#]+/[a-z]+", 0)
    roots = pages.select(host.alias("root"), F.length(host).cast("long").alias("project")).unionByName(pages.select(folder.alias("root"), F.lit(-1).cast("long").alias("project")).filter("root <> ''")).distinct()
    return history.bind_projects(pages.select(F.regexp_replace("url", "[?#].*$", "").alias("cwd")).distinct(), roots)


# ---- typed plans -----------------------------------------------------------------------------


def _typed(spark, d):
    return t.typed_events(spark, d).withColumn("unit", F.when(F.col("entity_id") % 5 == 0, F.concat(F.lit("u"), F.col("evidence_id") % 2)).otherwise(F.lit("u")))


TYPED = "te AS (SELECT event_id AS evidence_id, user_id AS entity_id, event_type AS relation, value AS numeric_value, (props::JSON->>'k')::BIGINT AS object_id, ts AS observed_at, CASE WHEN user_id % 5 = 0 THEN 'u' || (event_id % 2) ELSE 'u' END AS unit FROM events)"


@query("typed_count_distinct", f"""WITH {TYPED}, c AS (SELECT DISTINCT user_id AS entity_id, user_id % 3 <> 0 AS complete FROM events), n AS (SELECT entity_id, count(DISTINCT object_id) AS n FROM te WHERE relation = 'purchase' GROUP BY 1)
SELECT entity_id, CASE WHEN complete AND coalesce(n, 0) > 0 THEN 'ANSWER' ELSE 'UNKNOWN' END AS status, CASE WHEN complete AND coalesce(n, 0) > 0 THEN n END AS value, CASE WHEN NOT complete THEN 'SCOPE_NOT_CERTIFIED' WHEN coalesce(n, 0) = 0 THEN 'ZERO_NOT_CERTIFIED' END AS reason FROM c LEFT JOIN n USING (entity_id)""")
def typed_count_distinct(spark, d):
    e = _typed(spark, d)
    scope = e.select("entity_id", (F.col("entity_id") % 3 != 0).alias("complete")).distinct()
    return typed.count_distinct(typed.candidates(e, relations=["purchase"]), ["entity_id"], "object_id", certified=scope)


@query("typed_sum_units", f"""WITH {TYPED} SELECT entity_id, CASE WHEN count(DISTINCT unit) = 1 THEN min(unit) END AS unit, CASE WHEN count(DISTINCT unit) = 1 THEN 'ANSWER' ELSE 'UNKNOWN' END AS status, CASE WHEN count(DISTINCT unit) = 1 THEN round(sum(numeric_value), 4) END AS value, CASE WHEN count(DISTINCT unit) > 1 THEN 'MIXED_UNITS' END AS reason FROM te WHERE relation = 'purchase' GROUP BY 1""")
def typed_sum_units(spark, d):
    return typed.sum_values(typed.candidates(_typed(spark, d), relations=["purchase"]), ["entity_id"]).withColumn("value", F.round("value", 4))


@query("typed_latest", f"""WITH {TYPED} SELECT entity_id, relation, round(arg_max(numeric_value, observed_at), 4) AS newest, round(arg_min(numeric_value, observed_at), 4) AS oldest FROM te GROUP BY 1, 2""")
def typed_latest(spark, d):
    e, by = _typed(spark, d), ["entity_id", "relation"]
    newest = typed.extreme(e, by, "numeric_value", "observed_at").select(*by, F.round("value", 4).alias("newest"))
    return newest.join(typed.extreme(e, by, "numeric_value", "observed_at", newest=False).select(*by, F.round("value", 4).alias("oldest")), by)


@query("typed_lookup", f"""WITH {TYPED} SELECT entity_id, CASE WHEN count(*) = 1 THEN 'ANSWER' ELSE 'UNKNOWN' END AS status, CASE WHEN count(*) = 1 THEN min(numeric_value) END AS value, CASE WHEN count(*) <> 1 THEN 'NOT_UNIQUE' END AS reason FROM te WHERE relation = 'signup' AND object_id < 10 GROUP BY 1""")
def typed_lookup(spark, d):
    return typed.lookup(_typed(spark, d).filter("relation = 'signup' AND object_id < 10"), ["entity_id"], "numeric_value")


_SUMS = """s AS (SELECT entity_id, relation, CASE WHEN count(DISTINCT unit) = 1 THEN sum(numeric_value) END AS v, CASE WHEN count(DISTINCT unit) = 1 THEN min(unit) END AS u FROM te GROUP BY 1, 2),
j AS (SELECT p.entity_id, CASE WHEN p.v IS NOT NULL AND c.v IS NOT NULL AND p.u = c.u THEN p.v - c.v END AS diff FROM s p JOIN s c USING (entity_id) WHERE p.relation = 'purchase' AND c.relation = 'click')"""


def _plan(kind):
    return {"operator": kind, "use": ["bought", "clicked"], "operands": [{"name": "bought", "filters": {"relations": ["purchase"]}}, {"name": "clicked", "filters": {"relations": ["click"]}}, {"name": "unused", "filters": {"relations": ["view"]}}]}


@query("typed_subtract", f"WITH {TYPED}, {_SUMS} SELECT entity_id, CASE WHEN diff IS NULL THEN 'UNKNOWN' ELSE 'ANSWER' END AS status, round(diff, 4) AS value FROM j")
def typed_subtract(spark, d):
    return typed.compile_plan(_plan("SUBTRACT"), _typed(spark, d), ["entity_id"]).select("entity_id", "status", F.round("value", 4).alias("value"))


@query("typed_compare", f"WITH {TYPED}, {_SUMS} SELECT entity_id, CASE WHEN diff > 0 THEN 'GREATER' WHEN diff < 0 THEN 'LESS' WHEN diff = 0 THEN 'EQUAL' END AS value FROM j")
def typed_compare(spark, d):
    return typed.compile_plan(_plan("COMPARE"), _typed(spark, d), ["entity_id"]).select("entity_id", "value")


@query("typed_relative", f"""WITH {TYPED}, r AS (SELECT entity_id, min(observed_at) AS t0 FROM te WHERE relation = 'signup' AND object_id < 20 GROUP BY 1 HAVING count(*) = 1)
SELECT entity_id, 'ANSWER' AS status, count(DISTINCT evidence_id) AS value FROM te JOIN r USING (entity_id) WHERE relation = 'view' AND observed_at > t0 GROUP BY 1""")
def typed_relative(spark, d):
    e = _typed(spark, d).withColumn("relation", F.when((F.col("relation") == "signup") & (F.col("object_id") < 20), "first_signup").otherwise(F.col("relation")))
    plan = {"operator": "COUNT", "use": ["seen"], "operands": [{"name": "seen", "filters": {"relations": ["view"]}, "after": "start"}, {"name": "start", "filters": {"relations": ["first_signup"]}}]}
    return typed.compile_plan(plan, e, ["entity_id"]).select("entity_id", "status", "value")


@query("typed_reject_reasons", f"""WITH {TYPED} SELECT CASE WHEN relation NOT IN ('view', 'click') THEN 'RELATION' WHEN entity_id NOT IN (1, 2, 3, 5, 8) THEN 'ENTITY' ELSE 'ACCEPTED' END AS reason, count(*) AS n FROM te GROUP BY 1""")
def typed_reject_reasons(spark, d):
    return typed.reject_reasons(_typed(spark, d), relations=["view", "click"], entities=[1, 2, 3, 5, 8])


@query("typed_list", f"WITH {TYPED} SELECT entity_id, array_to_string(list_sort(list(DISTINCT object_id)), ',') AS objects FROM te WHERE relation = 'error' GROUP BY 1")
def typed_list(spark, d):
    out = typed.list_values(typed.candidates(_typed(spark, d), relations=["error"]), ["entity_id"], "object_id")
    return out.select("entity_id", F.array_join("values", ",").alias("objects"))


@query("typed_date_diff", f"WITH {MEMORIES} SELECT memory_id, round(epoch(known_at - effective_at) / 3600.0, 6)::DOUBLE AS hours, round(epoch(known_at - effective_at) / 604800.0, 6)::DOUBLE AS weeks FROM mem")
def typed_date_diff(spark, d):
    diff = lambda unit: F.round(typed.date_diff(F.col("effective_at"), F.col("known_at"), unit), 6).alias(unit)
    return t.memories(spark, d).select("memory_id", diff("hours"), diff("weeks"))


@query("typed_total", """WITH i AS (SELECT o_custkey AS k, lower(trim(o_orderstatus)) AS label, o_orderdate::DATE AS day, CASE WHEN o_custkey % 4 <> 0 THEN o_totalprice END AS amount, CASE WHEN o_custkey % 6 = 0 THEN 100.0::DOUBLE END AS stated FROM orders),
o AS (SELECT k, label, day, max(amount) AS amount, max(stated) AS stated FROM i GROUP BY ALL)
SELECT k, round(CASE WHEN max(stated) IS NOT NULL THEN max(stated) WHEN count(*) = count(amount) THEN sum(amount) ELSE count(*) END, 2)::DOUBLE AS value, CASE WHEN max(stated) IS NOT NULL THEN 'STATED' WHEN count(*) = count(amount) THEN 'SUM' ELSE 'COUNT' END AS basis FROM o GROUP BY k""")
def typed_total(spark, d):
    o = t.read(spark, d, "orders")
    items = o.select(F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("label"), F.col("o_orderdate").alias("at"), F.when(F.col("o_custkey") % 4 != 0, F.col("o_totalprice")).alias("amount"), F.when(F.col("o_custkey") % 6 == 0, F.lit(100.0)).alias("stated"))
    return typed.aggregate_total(items, ["k"]).withColumn("value", F.round("value", 2))


@query("typed_largest_group", """WITH g AS (SELECT o_custkey AS k, o_orderpriority AS p, sum(o_totalprice) AS total FROM orders GROUP BY ALL) SELECT k, p AS winner, round(total, 2) AS total FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY round(total, 6) DESC, p DESC) AS n FROM g) WHERE n = 1""")
def typed_largest_group(spark, d):
    o = t.read(spark, d, "orders").withColumnRenamed("o_custkey", "k")
    return typed.largest_group(o, ["k"], "o_orderpriority", "o_totalprice").withColumn("total", F.round("total", 2))


# ---- state -----------------------------------------------------------------------------------


def _asked(spark, d):
    users = t.read(spark, d, "events").select(F.col("user_id").alias("entity_id")).distinct()
    days = F.explode(F.array(*[F.lit(f"2024-01-{x:02d} 12:00:00").cast("timestamp_ntz") for x in (2, 9, 16, 23, 30)])).alias("as_of")
    return users.select("entity_id", days).withColumn("query_id", F.concat_ws("@", F.col("entity_id"), F.date_format("as_of", "dd")))


ASKED = "ask AS (SELECT entity_id || '@' || strftime(as_of, '%d') AS query_id, entity_id, as_of FROM (SELECT DISTINCT user_id AS entity_id FROM events), (SELECT unnest([TIMESTAMP '2024-01-02 12:00:00', TIMESTAMP '2024-01-09 12:00:00', TIMESTAMP '2024-01-16 12:00:00', TIMESTAMP '2024-01-23 12:00:00', TIMESTAMP '2024-01-30 12:00:00']) AS as_of))"


@query("latest_observation", f"""WITH {ASKED}, o AS (SELECT user_id AS entity_id, ts, value FROM events WHERE event_type = 'view')
SELECT query_id, CASE WHEN o.ts IS NULL THEN 'UNKNOWN' ELSE 'OBSERVED' END AS status, CASE WHEN o.ts IS NULL THEN 'NO_OBSERVATION_AS_OF' END AS reason, o.value, CASE WHEN o.ts IS NOT NULL THEN CASE WHEN epoch(as_of - o.ts) <= 86400 THEN 'FRESH' ELSE 'STALE' END END AS freshness FROM ask ASOF LEFT JOIN o ON ask.entity_id = o.entity_id AND o.ts <= ask.as_of""")
def latest_observation(spark, d):
    o = t.typed_events(spark, d).filter("relation = 'view'").select("entity_id", "observed_at", F.col("numeric_value").alias("value"))
    return state.latest_observation(o, _asked(spark, d), ["entity_id"], max_age_seconds=86400).select("query_id", "status", "reason", "value", "freshness")


@query("state_as_of", f"""WITH {ASKED}, r AS (SELECT user_id AS entity_id, event_type AS value, ts AS valid_from, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS valid_to FROM events)
SELECT query_id, CASE WHEN count(DISTINCT value) = 1 THEN 'ANSWER' ELSE 'UNKNOWN' END AS status, CASE WHEN count(DISTINCT value) = 1 THEN min(value) END AS value FROM ask LEFT JOIN r ON ask.entity_id = r.entity_id AND valid_from <= as_of AND (valid_to IS NULL OR as_of < valid_to) GROUP BY 1""")
def state_as_of(spark, d):
    records = state.intervals(t.typed_events(spark, d), ["entity_id"]).withColumn("value", F.col("relation"))
    return state.state_as_of(records, _asked(spark, d), ["entity_id"]).select("query_id", "status", "value")


# ---- dates -----------------------------------------------------------------------------------

PHRASES = ["today", "yesterday", "tomorrow", "3 days ago", "two weeks ago", "last tuesday", "sunday", "last weekend", "this weekend", "last week", "this week", "last month", "this month", "last year", "this year", "in 2019", "past 10 days", "march 3", "2021-04-05", "in february", "three weeks before 2023-05-28", "two days after march 3", "sometime soon"]


def _anchors(spark, d):
    return t.read(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("anchor")).distinct()


_A = "SELECT DISTINCT o_orderdate::DATE AS a FROM orders"
_WD = "(isodow(a) - 1)"
_MON = f"(a - {_WD}::INT)"


@query("date_phrases", f"""WITH a AS ({_A}), p AS (
SELECT a, 'today' AS phrase, a AS s, a AS e FROM a UNION ALL SELECT a, 'yesterday', a - 1, a - 1 FROM a UNION ALL SELECT a, 'tomorrow', a + 1, a + 1 FROM a
UNION ALL SELECT a, '3 days ago', a - 3, a - 3 FROM a UNION ALL SELECT a, 'two weeks ago', a - 14, a - 14 FROM a
UNION ALL SELECT a, 'last tuesday', a - (CASE WHEN ({_WD} - 1 + 7) % 7 = 0 THEN 7 ELSE ({_WD} - 1 + 7) % 7 END)::INT, a - (CASE WHEN ({_WD} - 1 + 7) % 7 = 0 THEN 7 ELSE ({_WD} - 1 + 7) % 7 END)::INT FROM a
UNION ALL SELECT a, 'sunday', a - (({_WD} - 6 + 7) % 7)::INT, a - (({_WD} - 6 + 7) % 7)::INT FROM a
UNION ALL SELECT a, 'last weekend', a - (CASE {_WD} WHEN 5 THEN 7 WHEN 6 THEN 8 ELSE {_WD} + 2 END)::INT, a - (CASE {_WD} WHEN 5 THEN 7 WHEN 6 THEN 8 ELSE {_WD} + 2 END)::INT + 1 FROM a
UNION ALL SELECT a, 'this weekend', a + ((5 - {_WD} + 7) % 7)::INT, a + ((5 - {_WD} + 7) % 7)::INT + 1 FROM a
UNION ALL SELECT a, 'last week', {_MON} - 7, {_MON} - 1 FROM a UNION ALL SELECT a, 'this week', {_MON}, {_MON} + 6 FROM a
UNION ALL SELECT a, 'last month', (date_trunc('month', a) - INTERVAL 1 MONTH)::DATE, (date_trunc('month', a)::DATE - 1) FROM a UNION ALL SELECT a, 'this month', date_trunc('month', a)::DATE, last_day(a) FROM a
UNION ALL SELECT a, 'last year', make_date(year(a) - 1, 1, 1), make_date(year(a) - 1, 12, 31) FROM a UNION ALL SELECT a, 'this year', make_date(year(a), 1, 1), make_date(year(a), 12, 31) FROM a
UNION ALL SELECT a, 'in 2019', DATE '2019-01-01', DATE '2019-12-31' FROM a UNION ALL SELECT a, 'past 10 days', a - 10, a FROM a
UNION ALL SELECT a, '2021-04-05', DATE '2021-04-05', DATE '2021-04-05' FROM a UNION ALL SELECT a, 'three weeks before 2023-05-28', DATE '2023-05-07', DATE '2023-05-07' FROM a UNION ALL SELECT a, 'sometime soon', NULL, NULL FROM a
UNION ALL SELECT a, n.phrase, n.d + n.k, n.d + n.k FROM a, LATERAL (SELECT x.phrase, x.k, (SELECT arg_min(y.d, abs(y.d - a) * 10 + y.i) FROM (SELECT i, make_date(year(a) + i - 1, 3, 3) AS d FROM range(0, 3) r(i)) y) AS d FROM (VALUES ('march 3', 0), ('two days after march 3', 2)) x(phrase, k)) n
UNION ALL SELECT a, 'in february', date_trunc('month', n.d)::DATE, last_day(n.d) FROM a, LATERAL (SELECT (SELECT arg_min(y.d, abs(y.d - a) * 10 + y.i) FROM (SELECT i, make_date(year(a) + i - 1, 2, 15) AS d FROM range(0, 3) r(i)) y) AS d) n)
SELECT strftime(a, '%Y-%m-%d') AS anchor, phrase, strftime(s, '%Y-%m-%d') AS start, strftime(e, '%Y-%m-%d') AS "end" FROM p""")
def date_phrases(spark, d):
    rows = _anchors(spark, d).withColumn("phrase", F.explode(F.array(*map(F.lit, PHRASES))))
    rows = rows.withColumn("span", dates.resolve(F.col("phrase"), F.col("anchor")))
    return rows.select(day("anchor"), "phrase", day("span.start", "start"), day("span.end", "end"))


@query("date_offsets", f"""WITH a AS ({_A}), o AS (SELECT a, n, u FROM a, (SELECT unnest([-3, -1, 0, 2])::INT AS n), (SELECT unnest(['day', 'week', 'weekend', 'month', 'year']) AS u)),
r AS (SELECT a, n, u, CASE u WHEN 'day' THEN a + n WHEN 'week' THEN ({_MON} + n * 7) WHEN 'weekend' THEN (a - (({_WD} - 5 + 7) % 7)::INT + n * 7 + CASE WHEN {_WD} < 5 THEN 7 ELSE 0 END) WHEN 'month' THEN date_trunc('month', a + to_months(n))::DATE ELSE make_date(year(a) + n, 1, 1) END AS s FROM o)
SELECT strftime(a, '%Y-%m-%d') AS anchor, n, u, strftime(s, '%Y-%m-%d') AS start, strftime(CASE u WHEN 'day' THEN s WHEN 'week' THEN s + 6 WHEN 'weekend' THEN s + 1 WHEN 'month' THEN last_day(s) ELSE make_date(year(s), 12, 31) END, '%Y-%m-%d') AS "end" FROM r""")
def date_offsets(spark, d):
    rows = _anchors(spark, d).withColumn("n", F.explode(F.array(*map(F.lit, (-3, -1, 0, 2))))).withColumn("u", F.explode(F.array(*map(F.lit, ("day", "week", "weekend", "month", "year")))))
    rows = rows.withColumn("span", dates.from_offset(F.col("n"), F.col("u"), F.col("anchor")))
    return rows.select(day("anchor"), "n", "u", day("span.start", "start"), day("span.end", "end"))


# ---- routers and gates -----------------------------------------------------------------------

#: What follows a benchmark item, by its number: cues of both kinds in two languages, and nothing.
_ASKS = ["", " how many dogs do I have", " print hello", " What did we decide yesterday?", " 언제부터 그랬지", " 우리 프로젝트 문서", " as of March, who led?", " resume"]
_ASKS_SQL = "[" + ", ".join("'" + x + "'" for x in _ASKS) + "]"
_POLICIES = ["auto", "auto", "auto", "NEVER", "always", "sometimes"]


@query("recall_router", f"""WITH {TURNS}, a AS (SELECT 'item-' || item_id AS id, text || {_ASKS_SQL}[item_id % 8 + 1] AS said, (['auto', 'auto', 'auto', 'NEVER', 'always', 'sometimes'])[item_id // 8 % 6 + 1] AS policy FROM benchmark
  UNION ALL SELECT turn_id, CASE WHEN source_ordinal = 5 THEN '  ' ELSE content END, 'auto' FROM turns)
SELECT id, CASE WHEN len(trim(coalesce(said, ''))) = 0 OR lower(policy) NOT IN ('auto', 'always', 'never') THEN 'ERROR' WHEN lower(policy) = 'never' THEN 'SKIP' WHEN lower(policy) = 'always' THEN 'SEARCH' WHEN regexp_matches(said, '{classify.EXECUTE_CUES}') THEN 'EXECUTE' WHEN regexp_matches(said, '{classify.SEARCH_CUES}') THEN 'SEARCH' ELSE 'SKIP' END AS mode FROM a""")
def recall_router(spark, d):
    """Benchmark items with a cue behind them under several policies, and conversation turns as they are."""
    i = F.col("item_id")
    pick = lambda names, n: F.try_element_at(F.array(*map(F.lit, names)), (n + 1).cast("int"))
    items = t.read(spark, d, "benchmark").select(F.concat(F.lit("item-"), i).alias("id"), F.concat("text", pick(_ASKS, i % 8)).alias("said"), pick(_POLICIES, F.expr("item_id div 8 % 6")).alias("policy"))
    turns = t.turns(spark, d).select(F.col("turn_id").alias("id"), F.when(F.col("source_ordinal") == 5, "  ").otherwise(F.col("content")).alias("said"), F.lit("auto").alias("policy"))
    return items.unionByName(turns).select("id", classify.decide_recall(F.col("said"), F.col("policy"))["mode"].alias("mode"))


@query("durable_turns", f"""WITH {TURNS} SELECT CASE WHEN role <> 'user' THEN 'NON_USER_TURN' WHEN len(trim(content)) = 0 THEN 'EMPTY_TURN' WHEN contains(content, '[REDACTED') THEN 'REDACTED_CONTENT_REQUIRES_REVIEW' WHEN len(trim(content)) > 2000 THEN 'LONG_CONTENT_REQUIRES_REVIEW' WHEN ends_with(trim(content), '?') THEN 'CURRENT_OR_GENERAL_QUESTION' ELSE 'NO_EXPLICIT_DURABLE_SIGNAL' END AS reason, count(*) AS n FROM turns GROUP BY 1""")
def durable_turns(spark, d):
    return t.turns(spark, d).select(classify.durable(F.col("role"), F.col("content"))["reason"].alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("event_gate", f"""WITH {TURNS}, rp AS (SELECT turn_id, role FROM turns), e AS (SELECT event_id AS evidence_id, user_id % 100 || '-' || (event_id % 6) AS turn_id, CASE WHEN event_id % 3 = 0 THEN 'The User' ELSE 'shop' END AS subject, (['NUMBER', 'MONEY', 'DATE', 'ENTITY'])[event_id % 4 + 1] AS vt, CASE WHEN event_id % 5 <> 0 THEN value END AS nv FROM events)
SELECT evidence_id, CASE WHEN role IS NULL THEN 'QUARANTINE' WHEN subject = 'The User' AND role <> 'user' THEN 'QUARANTINE' WHEN (vt IN ('NUMBER', 'MONEY') AND nv IS NULL) OR vt IN ('MONEY', 'DATE') THEN 'EVIDENCE_ONLY' ELSE 'PERSIST' END AS decision FROM e LEFT JOIN rp USING (turn_id)""")
def event_gate(spark, d):
    null = lambda k: F.lit(None).cast(k)
    e = t.read(spark, d, "events").select(
        F.col("event_id").alias("evidence_id"), F.array(F.concat_ws("-", F.col("user_id") % 100, F.col("event_id") % 6)).alias("source_turn_ids"), F.when(F.col("event_id") % 3 == 0, "The User").otherwise("shop").alias("subject"),
        F.try_element_at(F.array(*map(F.lit, ("NUMBER", "MONEY", "DATE", "ENTITY"))), (F.col("event_id") % 4 + 1).cast("int")).alias("value_type"), F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("numeric_value"),
        null("double").alias("numeric_min"), null("double").alias("numeric_max"), F.lit("x").alias("object_text"), null("string").alias("unit"), null("string").alias("date_value"), null("boolean").alias("boolean_value"),
    )
    return classify.gate(e, t.turns(spark, d)).select("evidence_id", "decision")


@query("number_grounding", """SELECT event_id, array_to_string(list_filter(list_distinct(regexp_extract_all('k ' || event_id || ' and 1,500', '\\d+(?:,\\d{3})*(?:\\.\\d+)?')), lambda x: replace(x, ',', '') NOT IN (SELECT '1500') AND NOT list_contains(regexp_extract_all(props, '\\d+'), x)), ',') AS ungrounded FROM events""".replace("replace(x, ',', '') NOT IN (SELECT '1500')", "x NOT IN ('1,500', '1500')"))
def number_grounding(spark, d):
    e = t.read(spark, d, "events")
    answer = F.concat(F.lit("k "), F.col("event_id"), F.lit(" and 1,500"))
    return e.select("event_id", F.array_join(classify.ungrounded_numbers(answer, F.array("props", F.lit("about 1500 of them"))), ",").alias("ungrounded"))


@query("assistant_history_questions", f"WITH {_QUESTIONS} SELECT query_id, query_id % 3 = 0 AS about FROM q")
def assistant_history_questions(spark, d):
    q = t.questions(spark, d).withColumn("query", F.when(F.col("query_id") % 3 == 0, F.concat(F.col("query"), F.lit(" that You Recommended"))).otherwise(F.col("query")))
    return q.select("query_id", classify.asks_assistant(F.col("query")).alias("about"))


# ---- evaluation ------------------------------------------------------------------------------


def _results(spark, d):
    docs, labels = t.read(spark, d, "documents"), t.read(spark, d, "labels")
    j = docs.join(labels, "doc_id")
    return j.select(F.col("doc_id").alias("query_id"), F.col("lang").alias("type"), F.lit(1).alias("relevant"), F.col("quality").alias("found"), F.when(F.col("quality") == 1, F.col("doc_id") % 12 + 1).alias("first_rank"), (F.col("doc_id") % 1000).alias("tokens"))


@query("retrieval_eval", """WITH r AS (SELECT lang AS type, 1 AS relevant, quality AS found, CASE WHEN quality = 1 THEN doc_id % 12 + 1 END AS first_rank, doc_id % 1000 AS tokens FROM documents JOIN labels USING (doc_id))
SELECT coalesce(type, 'all') AS type, count(*) AS questions, round(avg((found = relevant)::INT), 6) AS question_recall, round(sum(found) / sum(relevant), 6) AS turn_coverage, median(tokens) AS median_tokens,
round(avg((coalesce(first_rank, 999) <= 5)::INT), 6) AS recall_any_5, round(avg((coalesce(first_rank, 999) <= 10)::INT), 6) AS recall_any_10 FROM r GROUP BY GROUPING SETS ((type), ())""")
def retrieval_eval(spark, d):
    out = evaluate.summary(_results(spark, d))
    return out.select("type", "questions", "median_tokens", *[F.round(c, 6).alias(c) for c in ("question_recall", "turn_coverage", "recall_any_5", "recall_any_10")])


def _judged(spark, d):
    j = t.read(spark, d, "documents").join(t.read(spark, d, "labels"), "doc_id").select(F.col("source").alias("query_id"), F.col("doc_id").alias("doc"), (F.col("quality") + F.col("toxic")).alias("gain"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.crc32(F.col("doc").cast("string")), "doc"))
    return j, j.withColumn("place", place).select("query_id", "doc", "place")


RANKED = """j AS (SELECT source AS query_id, doc_id AS doc, quality + toxic AS gain FROM documents JOIN labels USING (doc_id)), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY md5(doc::VARCHAR), doc) AS place, row_number() OVER (PARTITION BY query_id ORDER BY gain DESC) AS best FROM j)"""


def _judged_md5(spark, d):
    j = _judged(spark, d)[0]
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.md5(F.col("doc").cast("string")), "doc"))
    return j, j.withColumn("place", place).select("query_id", "doc", "place")


@query("ndcg", f"WITH {RANKED} SELECT query_id, round(CASE WHEN sum(gain / log2(best + 1)) FILTER (best <= 10) > 0 THEN coalesce(sum(gain / log2(place + 1)) FILTER (place <= 10), 0) / sum(gain / log2(best + 1)) FILTER (best <= 10) ELSE 0 END, 6)::DOUBLE AS ndcg FROM k GROUP BY 1")
def ndcg(spark, d):
    judged, ranked = _judged_md5(spark, d)
    return evaluate.ndcg(ranked, judged).withColumn("ndcg", F.round("ndcg", 6))


@query("mrr", f"WITH {RANKED} SELECT query_id, min(place) FILTER (gain = 2) AS first_rank, round(coalesce(1.0 / min(place) FILTER (gain = 2), 0), 6)::DOUBLE AS reciprocal FROM k GROUP BY 1 HAVING count(*) FILTER (gain = 2) > 0")
def mrr(spark, d):
    judged, ranked = _judged_md5(spark, d)
    return evaluate.first_hits(ranked, judged.filter("gain = 2")).select("query_id", F.col("first_rank").cast("long").alias("first_rank"), F.round("reciprocal", 6).alias("reciprocal"))


@query("pool_ceiling", f"WITH {RANKED}, f AS (SELECT query_id, min(place) FILTER (gain = 2) AS r FROM k GROUP BY 1 HAVING count(*) FILTER (gain = 2) > 0) SELECT pool, round(avg((r <= pool)::INT), 6) AS ceiling FROM f, (SELECT unnest([1, 3, 5, 10])::INT AS pool) GROUP BY 1")
def pool_ceiling(spark, d):
    judged, ranked = _judged_md5(spark, d)
    return evaluate.pool_ceiling(ranked, judged.filter("gain = 2"), (1, 3, 5, 10)).withColumn("ceiling", F.round("ceiling", 6))


@query("stratified_sample", "SELECT lang, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY sha256(doc_id::VARCHAR)) AS n FROM documents) WHERE n <= 20")
def stratified_sample(spark, d):
    return evaluate.stratified_sample(t.read(spark, d, "documents"), "lang", 20, "doc_id").select("lang", "doc_id")


@query("question_halves", "SELECT item_id, (('0x' || substr(sha256(item_id::VARCHAR), 1, 2))::INT) % 2 AS half FROM benchmark")
def question_halves(spark, d):
    return t.read(spark, d, "benchmark").select("item_id", evaluate.half("item_id").alias("half"))


# ---- streams ---------------------------------------------------------------------------------


def _stage(spark: SparkSession, rows: DataFrame, name: str) -> tuple[str, str]:
    """A folder with the rows as stream input, and one for a checkpoint."""
    path = f"{shared_dir(spark)}/streams/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(f"{path}/in")
    return f"{path}/in", path


def _run(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    spark = stream.sparkSession
    out = f"{path}/out"
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@query("stream_turns", f"WITH {TURNS} SELECT turn_id, role FROM turns")
def stream_turns(spark, d):
    turns = t.turns(spark, d).select("turn_id", "role")
    source, path = _stage(spark, turns.unionByName(turns), "turns")
    return _run(flows.deduplicated(spark.readStream.schema(turns.schema).parquet(source)), path)


@query("stream_event_windows", """SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def stream_event_windows(spark, d):
    # a later event of no counted kind moves the watermark past the last window
    e = t.read(spark, d, "events").select("ts", "event_type", "value")
    flush = spark.sql("SELECT timestamp_ntz'2100-01-01' AS ts, '~' AS event_type, 0.0D AS value")
    source, path = _stage(spark, e, "events")
    flush.write.mode("append").parquet(source)
    out = _run(flows.event_windows(spark.readStream.schema(e.schema).option("maxFilesPerTrigger", "1").option("latestFirst", "false").parquet(source), late="3650 days"), path)
    return out.filter("event_type <> '~'").select(F.date_format("start", "yyyy-MM-dd").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("stream_forget_state")
def stream_forget_state(spark, d):
    turns = t.turns(spark, d)
    rows = turns.select("session_id", "turn_id", "role", F.col("happened_at").cast("timestamp").alias("at"), F.col("source_ordinal").alias("position"), ((F.col("revision") % 7 == 3) & (F.col("role") == "assistant")).alias("is_forget_call"))
    source, path = _stage(spark, rows, "forget")
    return _run(flows.watch_deletions(spark.readStream.schema(rows.schema).parquet(source)), path)


# ---- the whole read path ---------------------------------------------------------------------


@query("gather")
def gather(spark, d):
    """Word and meaning hits of every whole question over the documents, re-ranked and packed by the piece that matched."""
    turns, asked, meaning, words = _whole_pool(spark, d)
    best = ranking.rerank(ranking.features(asked, meaning, words, turns), 20).select("query_id", "turn_id", "place")
    best = best.join(meaning.select("query_id", "turn_id", "start"), ["query_id", "turn_id"], "left").join(turns, "turn_id")
    piece = F.substring("content", F.coalesce("start", F.lit(0)) + 1, F.lit(500))
    item = F.struct(F.lit("document").alias("kind"), F.lit("EPISODE").alias("class"), F.col("scope").alias("scope"), F.lit("").alias("at"), tx.title(F.col("content")).alias("title"), piece.alias("content"), F.lit("document").alias("source_type"), F.col("session_id").alias("source_ref"))
    return packing.pack(best.select("query_id", item.alias("item"), "place"), 6000)
