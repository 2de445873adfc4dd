"""Checks and clean-up of what is to be stored: entity ids, aliases, tags, participants, units, contexts, promotion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions.classify import durable
from evidentia.functions.security import secret_kinds
from evidentia.functions.text import entity_key


def unsafe_argument(argument: Column) -> Column:
    """True where a path or name holds a character that a shell could act on."""
    # fixed value: the characters
    return F.coalesce(argument.rlike(r"[\"'`$;&|<>%^!\r\n\x00]"), F.lit(False))


def engram_of(source_id: Column) -> Column:
    """The engram id that a source id stands for; an id without a kind is a memory's."""
    turn = source_id.startswith("conversation-turn:")
    named = source_id.startswith("memory:") | source_id.startswith("conversation:") | source_id.startswith("development:")
    return F.when(turn, F.concat(F.lit("conversation:"), F.substring(source_id, 19, 2**30))).when(named, source_id).otherwise(F.concat(F.lit("memory:"), source_id))


def entity_id(kind: Column, name: Column, *, owner: Column | None = None) -> Column:
    """entity_ and a hash of kind and normalised name (16 hex digits), or of owner, kind and name (20).

    Null where the name has no letters, or the kind is NONE and no owner is given.
    """
    key = entity_key(name)
    if owner is None:
        identity, digits = F.concat_ws("::", F.coalesce(kind, F.lit("OTHER")), key), 16
    else:
        identity, digits = F.concat_ws("::", owner, kind, key), 20
    known = (F.length(key) > 0) & (F.lit(True) if owner is not None else ~F.coalesce(kind == "NONE", F.lit(False)))
    return F.when(known, F.concat(F.lit("entity_"), F.substring(F.sha2(identity, 256), 1, digits)))


def alias_cues(plans: DataFrame, least: int = 3, shortest: int = 2, longest: int = 80) -> DataFrame:
    """Adds cues (white space folded, distinct without regard to case, first spelling kept) and error to plans(status, alias_cues)."""
    folded = F.transform("alias_cues", lambda c: F.trim(F.regexp_replace(c, r"\s+", " ")))
    lower = F.transform(folded, lambda c: F.lower(c))
    cues = F.filter(folded, lambda c, i: F.array_position(lower, F.lower(c)) == i + 1)
    wrong = F.exists(folded, lambda c: c.isNull() | ~F.length(c).between(shortest, longest))
    error = (
        F.when(~F.coalesce(F.col("status").isin("plan", "abstain"), F.lit(False)) | F.col("alias_cues").isNull(), "INVALID_ALIAS_SCHEMA")
        .when((F.col("status") == "abstain") & (F.size("alias_cues") > 0), "ABSTAIN_ALIAS_HAS_CUES")
        .when((F.col("status") == "plan") & wrong, "INVALID_ALIAS_CUE")
        .when((F.col("status") == "plan") & (F.size(cues) < least), "INSUFFICIENT_DISTINCT_ALIAS_CUES")
    )
    return plans.withColumn("error", error).withColumn("cues", F.when(F.col("error").isNull(), cues))


def grounded(events: DataFrame, turns: DataFrame) -> DataFrame:
    """Adds aliases, tags and tag_turns to events(event_id, session_id, cited, name, object_aliases, category_tags).

    An alias stays where a cited turn of turns(session_id, turn_id, content) holds it. A tag stays where a
    turn holds it, also as a plural: a cited one, or any of the session that holds the event's name.
    Words and turns meet by session, so no event meets another session's turns.
    """
    norm = turns.select("session_id", "turn_id", entity_key(F.col("content")).alias("said"))
    asked = events.select(
        "event_id",
        "session_id",
        "cited",
        entity_key(F.coalesce("name", F.lit(""))).alias("name"),
        F.explode(
            F.concat(
                F.transform(F.coalesce("object_aliases", F.array().cast("array<string>")), lambda a: F.struct(F.lit("alias").alias("kind"), a.alias("word"), entity_key(a).alias("term"))),
                F.transform(F.coalesce("category_tags", F.array().cast("array<string>")), lambda a: F.struct(F.lit("tag").alias("kind"), a.alias("word"), entity_key(F.translate(a, "_", " ")).alias("term"))),
            )
        ).alias("w"),
    )
    met = asked.join(norm, "session_id").filter(F.col("said").contains(F.col("w.term")))
    cites = F.array_contains("cited", F.col("turn_id"))
    same = (F.col("name") == "") | F.col("said").contains(F.col("name"))
    met = met.filter(cites | ((F.col("w.kind") == "tag") & same))
    per_word = met.groupBy("event_id", "w").agg(F.sort_array(F.collect_set("turn_id")).alias("found"))
    kept = per_word.groupBy("event_id").agg(F.collect_list(F.struct("w.kind", "w.word", "found")).alias("_kept"))
    out = events.join(kept, "event_id", "left")
    words = lambda kind: F.array_distinct(F.transform(F.filter("_kept", lambda k: k["kind"] == kind), lambda k: k["word"]))
    stay = lambda column, kind: F.coalesce(F.filter(F.col(column), lambda a: F.array_contains(F.coalesce(words(kind), F.array().cast("array<string>")), a)), F.array().cast("array<string>"))
    tag_turns = F.map_from_entries(F.transform(F.filter("_kept", lambda k: k["kind"] == "tag"), lambda k: F.struct(k["word"], k["found"])))
    return out.withColumn("aliases", stay("object_aliases", "alias")).withColumn("tags", stay("category_tags", "tag")).withColumn("tag_turns", tag_turns).drop("_kept")


def participants(rows: DataFrame, turns: DataFrame, roles: list[str], kinds: list[str]) -> DataFrame:
    """Adds valid and entity_id to rows(memory_id, session_id, cited, turn_id, quote, name, role, entity_type).

    Valid: the turn is cited and holds the quote, the quote holds the name as whole words, role and type
    are known ones.
    """
    said = turns.select("session_id", "turn_id", F.col("content").alias("_said"))
    key = entity_key(F.col("name"))
    whole = F.concat(F.lit(" "), entity_key(F.col("quote")), F.lit(" ")).contains(F.concat(F.lit(" "), key, F.lit(" ")))
    ok = F.array_contains("cited", F.col("turn_id")) & (F.length(F.trim("quote")) > 0) & F.col("_said").contains(F.col("quote")) & (F.length(key) > 0) & whole
    ok = ok & F.col("role").isin(roles) & F.col("entity_type").isin([k for k in kinds if k != "NONE"])
    out = rows.join(said, ["session_id", "turn_id"], "left").withColumn("valid", F.coalesce(ok, F.lit(False))).drop("_said")
    return out.withColumn("entity_id", F.when(F.col("valid"), entity_id(F.col("entity_type"), F.col("name"), owner=F.col("memory_id").cast("string"))))


def money_units(events: DataFrame, turns: DataFrame) -> DataFrame:
    """Adds recovered_unit to events(event_id, session_id, cited, value_type, unit, numeric_value).

    The one currency symbol that stands beside the same number in the cited turns; null where there are
    two, none, a unit already, or no money. Numbers are compared as decimals.
    """
    number = r"(?<![\w$])([$£€])\s*(\d[\d,]*(?:\.\d+)?)(?!\d|\.\d)"  # fixed value
    open_ = events.filter("value_type = 'MONEY' AND coalesce(unit, '') = '' AND numeric_value IS NOT NULL")
    found = turns.select("session_id", "turn_id", F.explode(F.regexp_extract_all("content", F.lit(number), 0)).alias("hit"))
    found = found.select("session_id", "turn_id", F.substring("hit", 1, 1).alias("symbol"), F.translate(F.regexp_extract("hit", r"\d.*", 0), ",", "").try_cast("decimal(38,10)").alias("number"))
    met = open_.select("event_id", "session_id", F.explode("cited").alias("turn_id"), F.col("numeric_value").cast("string").try_cast("decimal(38,10)").alias("number")).join(found, ["session_id", "turn_id", "number"])
    one = met.groupBy("event_id").agg(F.min("symbol").alias("low"), F.max("symbol").alias("high")).select("event_id", F.when(F.col("low") == F.col("high"), F.col("low")).alias("recovered_unit"))
    return events.join(one, "event_id", "left")


def clean_context(context: Column, texts: list[str], links: list[str], most: int = 2000, longest_link: int = 300) -> Column:
    """array<string> of what is wrong with a context map<string, string>: unknown fields, long texts or links, secrets."""
    key = lambda k: F.upper(k)
    length = lambda v: F.length(F.trim(F.coalesce(v, F.lit(""))))
    wrong = lambda k, v: (
        F.when(k.isin(links) & (length(v) > longest_link), F.concat(F.lit("CONTEXT_"), key(k), F.lit(": ids and links only, not text")))
        .when(k.isin(texts) & (length(v) > most), F.concat(F.lit("CONTEXT_"), key(k), F.lit("_TOO_LONG")))
        .when(~k.isin(texts + links), F.concat(F.lit("CONTEXT_FIELD "), k))
    )
    errors = F.array_compact(F.transform(F.map_entries(context), lambda e: wrong(e["key"], e["value"])))
    secret = F.transform(secret_kinds(F.array_join(F.map_values(context), "\n")), lambda s: F.concat(F.lit("SECRET_IN_CONTEXT: "), s))
    return F.when(F.cardinality(context) > 0, F.concat(errors, secret)).otherwise(F.array().cast("array<string>"))


def instance_errors(instances: DataFrame, types: list[str]) -> DataFrame:
    """Adds errors to instances(question_type, question_date, haystack_dates, haystack_session_ids, haystack_sessions).

    haystack_sessions is array<array<struct<role, content, has_answer>>>. Sessions are looked at only
    where the three lists are equally long.
    """
    dated = lambda c: F.coalesce(F.try_to_timestamp(F.substring(c, 1, 10), F.lit("yyyy/MM/dd")), F.try_to_timestamp(F.substring(c, 1, 10), F.lit("yyyy-MM-dd")))
    n = F.size("haystack_dates")
    parallel = (n == F.size("haystack_session_ids")) & (n == F.size("haystack_sessions"))
    turns = F.flatten("haystack_sessions")
    required = ["question_type", "question_date", "haystack_dates", "haystack_session_ids", "haystack_sessions"]
    gone = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in required]))
    checks = [
        F.when(~F.col("question_type").isin(types), F.concat(F.lit("unknown question_type: "), "question_type")),
        F.when(dated(F.col("question_date")).isNull(), F.lit("bad question_date")),
        F.when(~parallel, F.lit("parallel session lengths differ")),
        F.when(parallel & F.exists("haystack_dates", lambda d: dated(d).isNull()), F.lit("bad haystack date")),
        F.when(parallel & F.exists("haystack_sessions", lambda s: s.isNull()), F.lit("session is not a list")),
        F.when(parallel & F.exists(turns, lambda u: ~F.coalesce(u["role"].isin("user", "assistant"), F.lit(False))), F.lit("bad role")),
        F.when(parallel & F.exists(turns, lambda u: u["content"].isNull()), F.lit("turn content is not text")),
    ]
    missing = F.array(F.concat(F.lit("missing fields: "), F.array_join(gone, ", ")))
    return instances.withColumn("errors", F.when(F.size(gone) > 0, missing).otherwise(F.array_compact(F.array(*checks))))


def evidence_sessions(instances: DataFrame) -> DataFrame:
    """question_id, session_id: sessions in which some turn is marked as holding the answer."""
    one = instances.select("question_id", F.explode(F.arrays_zip("haystack_session_ids", "haystack_sessions")).alias("s"))
    marked = F.exists("s.haystack_sessions", lambda u: F.coalesce(u["has_answer"], F.lit(False)))
    return one.filter(marked).select("question_id", F.col("s.haystack_session_ids").alias("session_id")).distinct()


def unaudited(turns: DataFrame, audit: DataFrame) -> DataFrame:
    """Turns that promotion has not looked at."""
    return turns.join(audit.select("turn_id"), "turn_id", "left_anti")


def unindexed(rows: DataFrame, engrams: DataFrame, kind: str, key: str) -> DataFrame:
    """Rows with their engram_id, where no engram of the id is there yet."""
    named = rows.withColumn("engram_id", F.concat(F.lit(kind + ":"), F.col(key)))
    return named.join(engrams.select("engram_id"), "engram_id", "left_anti")


#: The class of memory that each promoted category becomes, and the automatic tag.
PROMOTED = {"PREFERENCE": "PREFERENCE", "DECISION": "DECISION", "FACT": "FACT", "PROJECT_PRINCIPLE": "STATE"}
TAG = "automatic-semantic-memory"


def promote(turns: DataFrame, audit: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(memories, audit rows) of turns(turn_id, scope, role, content, happened_at) not audited before.

    A turn that the gate calls durable becomes a memory whose id is a hash of turn and category, so a
    second run over the same turns adds nothing. Append both results to their tables.
    """
    new = turns if audit is None else unaudited(turns, audit)
    told = new.withColumn("_d", durable(F.col("role"), F.col("content"))).select("*", "_d.*").drop("_d")
    memory_id = F.concat(F.lit("semantic-"), F.substring(F.sha2(F.concat("turn_id", F.lit("\0"), "category"), 256), 1, 32))
    told = told.withColumn("memory_id", F.when(F.col("category").isNotNull(), memory_id))
    kind = F.coalesce(F.create_map(*[F.lit(x) for kv in PROMOTED.items() for x in kv])[F.col("category")], F.lit("FACT"))
    memories = told.filter("memory_id IS NOT NULL").select(
        "memory_id",
        "scope",
        F.col("category").alias("memory_type"),
        kind.alias("memory_class"),
        F.lit("CONVERSATION").alias("modality"),
        F.lit("DURABLE").alias("retention"),
        F.when(F.col("reason") == "EXPLICIT_REMEMBER_REQUEST", 0.85).otherwise(0.75).alias("importance"),
        F.lit(1.0).alias("confidence"),
        F.concat("category", F.lit(": "), F.substring("content", 1, 80)).alias("title"),
        "content",
        F.col("happened_at").alias("effective_at"),
        F.array("category", F.lit(TAG)).alias("tags"),
        F.concat(F.lit("conversation-turn:"), "turn_id").alias("related"),
        F.concat(F.lit("conversation-turn:"), "turn_id", F.lit("#chars=0-"), F.length("content").cast("string")).alias("source_ref"),
    )
    fingerprint = F.sha2(F.concat_ws("\0", "turn_id", "role", "content"), 256)
    disposition = F.when(F.col("memory_id").isNotNull(), "PROMOTED").otherwise("EVIDENCE_ONLY")
    return memories, told.select("turn_id", disposition.alias("disposition"), "reason", "memory_id", fingerprint.alias("source_fingerprint"))


def keyword_memories(memories: DataFrame) -> DataFrame:
    """id of automatic memories that no one asked for: all but facts. What promote() made, to be erased."""
    return memories.filter((F.col("memory_type") != "FACT") & F.array_contains("tags", TAG)).select(F.col("memory_id").alias("id"))


def doomed_by_hash(turns: DataFrame, hashes: DataFrame, client: str) -> DataFrame:
    """id of the client's user turns whose stored text has one of hashes(raw_sha256)."""
    own = turns.filter((F.col("client") == client) & (F.col("role") == "user"))
    return own.join(hashes.select("raw_sha256"), "raw_sha256", "left_semi").select(F.col("turn_id").alias("id"))


def scrubbed(lines: DataFrame, doomed: DataFrame) -> DataFrame:
    """lines(id, value) whose id is doomed are blanked in place: spaces, as many as there were bytes."""
    dead = doomed.select("id", F.lit(True).alias("_dead")).distinct()
    blank = F.repeat(F.lit(" "), F.octet_length("value"))
    return lines.join(dead, "id", "left").withColumn("value", F.when(F.col("_dead"), blank).otherwise(F.col("value"))).drop("_dead")


def move(rows: DataFrame, target: DataFrame, projects: DataFrame, key: str = "checkpoint_id") -> DataFrame:
    """Rows of the projects that the target ledger lacks; append them in stamp order and the move can be repeated."""
    return rows.join(projects.select("project"), "project", "left_semi").join(target.select(key), key, "left_anti")
