"""Routers and gates: when to recall, what is durable, what may be stored as a typed event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cues of the recall router, English and Korean.
EXECUTE_CUES = r"(?i)(?:몇\s*(?:개|번|명)|한\s*번도|없(?:었|는|나)|당시|그때|현재\s*상태|언제부터|언제까지|기준으로|count|how many|as of|at that time|never|none)"
SEARCH_CUES = r"(?i)(?:기억|전에|예전에|어제|지난|이전|아까|저번|우리|내가|내\s|나의|했던|하던|수정|작성|결정|취향|약속|대화|세션|프로젝트|문서|파일|작업|remember|previous|earlier|yesterday|last\s|my\s|we\s|our\s|resume)"
#: Patterns of durable statements.
REMEMBER = r"(?:기억해|기억해줘|잊지 ?마|계속 기억)"
QUESTION = r"(?:뭐야|무엇|왜|어떻게|해줘|봐줘|고쳐줘|수정해줘|리뷰해줘)\s*[?？\\]*$"
PROJECT = r"(?:프로젝트|제품|서비스).{0,40}(?:목표|방향|원칙|목적)"
DECISION = r"(?:앞으로|하기로|결정(?:했|한다|함)|채택(?:했|한다|함)|고정(?:하자|한다|함)|방향.{0,20}(?:잡|가자|간다))"
PREFERENCE = r"(?:선호|좋아(?:해|한다|함)|싫어(?:해|한다|함)|원해|원한다|했으면)"
SELF = r"(?:나는|난|내가|내 |앞으로|항상)"
#: Questions about what the assistant said.
ASSISTANT = (
    r"\byou (?:mentioned|said|recommended|suggested|told|gave|provided|listed|shared|proposed|named|advised)\b"
    r"|\byou were referring to\b|\bwhat did you (?:mention|say|recommend|suggest|tell)\b|\b(?:our|the) previous (?:chat|conversation|discussion)\b"
)


def decide_recall(query: Column, policy: Column | str = "auto") -> Column:
    """struct<mode, reason>: whether to skip, search or execute."""
    policy = F.lower(F.lit(policy) if isinstance(policy, str) else policy)
    say = lambda mode, reason: F.struct(F.lit(mode).alias("mode"), F.lit(reason).alias("reason"))
    return (
        F.when(F.coalesce(F.length(F.trim(query)), F.lit(0)) == 0, say("ERROR", "CONTEXT_QUERY_REQUIRED"))
        .when(~policy.isin("auto", "always", "never"), say("ERROR", "INVALID_RECALL_POLICY"))
        .when(policy == "never", say("SKIP", "RECALL_DISABLED_BY_CALLER"))
        .when(policy == "always", say("SEARCH", "RECALL_REQUIRED_BY_CALLER"))
        .when(query.rlike(EXECUTE_CUES), say("EXECUTE", "TEMPORAL_OR_COMPLETE_SCOPE_CUE"))
        .when(query.rlike(SEARCH_CUES), say("SEARCH", "PERSONAL_HISTORY_CUE"))
        .otherwise(say("SKIP", "NO_PERSONAL_MEMORY_CUE"))
    )


def durable(role: Column, content: Column) -> Column:
    """struct<category, reason> of a turn: a category only for explicit durable statements of the user."""
    text = F.trim(content)
    say = lambda category, reason: F.struct(F.lit(category).cast("string").alias("category"), F.lit(reason).alias("reason"))
    return (
        F.when(role != "user", say(None, "NON_USER_TURN"))
        .when(F.length(text) == 0, say(None, "EMPTY_TURN"))
        .when(text.contains("[REDACTED"), say(None, "REDACTED_CONTENT_REQUIRES_REVIEW"))
        .when((F.length(text) > 2000) & ~text.rlike(REMEMBER), say(None, "LONG_CONTENT_REQUIRES_REVIEW"))
        .when(text.rlike(REMEMBER), say("FACT", "EXPLICIT_REMEMBER_REQUEST"))
        .when(text.rlike(QUESTION) | text.rlike("[?？]$"), say(None, "CURRENT_OR_GENERAL_QUESTION"))
        .when(text.rlike(PROJECT), say("PROJECT_PRINCIPLE", "EXPLICIT_PROJECT_PRINCIPLE"))
        .when(text.rlike(DECISION), say("DECISION", "EXPLICIT_DURABLE_DECISION"))
        .when(text.rlike(PREFERENCE) & text.rlike(SELF), say("PREFERENCE", "EXPLICIT_USER_PREFERENCE"))
        .otherwise(say(None, "NO_EXPLICIT_DURABLE_SIGNAL"))
    )


def asks_assistant(question: Column) -> Column:
    return F.lower(question).rlike(ASSISTANT)


def value_issues(e: dict[str, Column]) -> Column:
    """What keeps an event's typed value from being usable; e maps field names to columns."""
    say = lambda test, name: F.when(F.coalesce(test, F.lit(False)), F.lit(name))
    kind = e["value_type"]
    number = kind.isin("NUMBER", "MONEY", "DURATION")
    scalar, low, high = e["numeric_value"].isNotNull(), e["numeric_min"].isNotNull(), e["numeric_max"].isNotNull()
    return F.array_compact(
        F.array(
            say(kind.isin("ENTITY", "TEXT") & (F.coalesce(F.length(e["object_text"]), F.lit(0)) == 0), "MISSING_OBJECT_TEXT"),
            say(number & ~scalar & (low != high), "INCOMPLETE_NUMERIC_VALUE"),
            say(number & ~scalar & ~low & ~high, "MISSING_NUMERIC_VALUE"),
            say(number & low & high, "RANGE_VALUE_UNSUPPORTED_BY_SCALAR_ALGEBRA"),
            say(kind.isin("MONEY", "DURATION") & (F.coalesce(F.length(e["unit"]), F.lit(0)) == 0), "MISSING_UNIT"),
            say((kind == "DATE") & e["date_value"].isNull(), "MISSING_DATE_VALUE"),
            say((kind == "BOOLEAN") & e["boolean_value"].isNull(), "MISSING_BOOLEAN_VALUE"),
        )
    )


def role_play(turns: DataFrame) -> DataFrame:
    """Turns of each session from the user's request to be played on."""
    start = F.max((F.col("role") == "user") & F.lower("content").contains("respond as the user")).over(Window.partitionBy("session_id").orderBy("source_ordinal").rowsBetween(Window.unboundedPreceding, -1))
    return turns.withColumn("role_play", F.coalesce(start, F.lit(False)))


def gate(events: DataFrame, turns: DataFrame) -> DataFrame:
    """decision and reasons of events(evidence_id, source_turn_ids, subject, value fields) against their turns."""
    cited = events.select("evidence_id", F.explode_outer("source_turn_ids").alias("turn_id")).join(role_play(turns).select("turn_id", "role", "role_play"), "turn_id", "left")
    per = cited.groupBy("evidence_id").agg(F.count_if(F.col("role").isNull()).alias("missing"), F.min(F.coalesce("role_play", F.lit(False))).alias("played"), F.max(F.coalesce(F.col("role") == "user", F.lit(False))).alias("by_user"))
    j = events.join(per, "evidence_id").withColumn("issues", value_issues({c: F.col(c) for c in ("value_type", "numeric_value", "numeric_min", "numeric_max", "object_text", "unit", "date_value", "boolean_value")}))
    quarantine = (
        F.when(F.col("missing") > 0, "INVALID_SOURCE_PROVENANCE")
        .when(F.col("played"), "EXPLICIT_ROLE_PLAY_BLOCK")
        .when(F.lower(F.trim("subject")).isin("user", "the user") & ~F.col("by_user"), "UNSUPPORTED_USER_ATTRIBUTION")
    )
    decision = F.when(quarantine.isNotNull(), "QUARANTINE").when(F.size("issues") > 0, "EVIDENCE_ONLY").otherwise("PERSIST")
    return j.select("evidence_id", decision.alias("decision"), F.when(quarantine.isNotNull(), F.array(quarantine)).otherwise(F.col("issues")).alias("reasons"))


def ungrounded_numbers(answer: Column, evidence: Column) -> Column:
    """Numbers of an answer that occur in none of the evidence."""
    numbers = lambda t: F.transform(F.regexp_extract_all(t, F.lit(r"\d+(?:,\d{3})*(?:\.\d+)?"), 0), lambda n: F.replace(n, F.lit(","), F.lit("")))
    return F.array_except(numbers(answer), F.flatten(F.transform(evidence, numbers)))


def missing_preconditions(plans: DataFrame, events: DataFrame) -> DataFrame:
    """plans(plan_id, phrase) whose phrase occurs in no event's object_text, both reduced to lower-case words and single spaces.

    A phrase may be inside a longer word; one without a word is missing nowhere. Phrases meet events
    by their first three characters (or fewer, if shorter), not all pairs.
    """
    plain = lambda c: F.array_join(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), 0), " ")
    asked = plans.select("plan_id", plain(F.col("phrase")).alias("wanted")).filter("wanted <> ''").withColumn("gram", F.left("wanted", F.lit(3)))
    said = events.select(plain(F.col("object_text")).alias("said")).distinct()
    grams = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length("said"), F.lit(1))), lambda i: F.substring(F.col("said"), i, F.lit(n)))
    met = said.select("said", F.explode(F.array_distinct(F.concat(*[grams(n) for n in (1, 2, 3)]))).alias("gram"))
    found = asked.join(met, "gram").filter(F.contains("said", "wanted")).select("plan_id").distinct()
    return plans.join(asked.select("plan_id"), "plan_id", "left_semi").join(found, "plan_id", "left_anti")
