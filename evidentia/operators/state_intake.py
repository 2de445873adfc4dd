"""Intake of states: a reviewed grant binds a candidate to spans of its source; every reason to hold it is gathered.

candidates(candidate_id, kind, turn_id, support_quote, subject_text, value_text, time_kind, known_at), grants(candidate_id,
candidate_sha256, memory_id, source_id, entity_id, relation, context_span_id, subject_span_id, value_span_id, time_span_id,
semantics_attestation_id, identity_attestation_id, valid_from, observed_at, observation_attestation_id), spans(span_id,
memory_id, session_id, source_turn_id, source_role, start, end, text), sources(candidate_id, memory_id, source_id,
session_timestamp). A candidate has at most one grant and one source, a span id names one span.

The four spans of a grant meet the table of spans in one join. Nothing here proves what a text means: that is what the
attestations named in a grant stand for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions.canonical import fingerprint, nested
from evidentia.functions.dates import clocked

#: The contract's version, and which relations have one value at a time or several.
VERSION = "state-relations-v1"
SINGLE = ["LOCATED_AT", "PRIMARY_RESIDENCE", "PRIMARY_WORKPLACE", "PRIMARY_VEHICLE_TYPE"]
MULTI = ["LIVES_AT", "WORKS_AT", "USES_VEHICLE_TYPE", "OWNS_VEHICLE_TYPE", "HAS_POSSESSION"]
_SPANS = ("context", "subject", "value", "time")
_CLAIM = ["kind", "known_at", "subject_text", "support_quote", "time_kind", "turn_id", "value_text"]


def claim_fingerprint(of: str = "") -> Column:
    """What a grant's candidate_sha256 must be."""
    return fingerprint({name: F.col(of + name) for name in _CLAIM})


def compile_intake(candidates: DataFrame, grants: DataFrame, spans: DataFrame, sources: DataFrame, *, clock: str = "SOURCE_LOCAL") -> DataFrame:
    """candidate_id, disposition, reasons (sorted, distinct), event (null unless READY_FOR_TRUSTED_APPEND)."""
    g = grants.select("candidate_id", F.struct(*[c for c in grants.columns if c != "candidate_id"]).alias("g"))
    wanted = grants.select("candidate_id", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"{n}_span_id").alias("span_id")) for n in _SPANS])).alias("w")).select("candidate_id", "w.*").filter("span_id IS NOT NULL")
    found = wanted.join(spans, "span_id").groupBy("candidate_id").agg(F.map_from_entries(F.collect_list(F.struct("name", F.struct("span_id", "memory_id", "session_id", "source_turn_id", "source_role", "start", "end", "text")))).alias("spans"))
    s = sources.select("candidate_id", F.struct("memory_id", "source_id", "session_timestamp").alias("s"))
    rows = candidates.join(g, "candidate_id", "left").join(found, "candidate_id", "left").join(s, "candidate_id", "left")
    grant, source = F.col("g"), F.col("s")
    span = {n: F.try_element_at("spans", F.lit(n)) for n in _SPANS}
    named = {n: grant[f"{n}_span_id"].isNotNull() if n == "time" else F.lit(True) for n in _SPANS}
    same = lambda a, b: a.eqNullSafe(b)
    say = lambda test, name: F.when(F.coalesce(test, F.lit(False)), F.lit(name))
    blank = lambda c: F.coalesce(F.length(F.trim(c)), F.lit(0)) == 0
    recorded, valid, observed = clocked(F.col("known_at"), F.lit(clock)), clocked(grant["valid_from"], F.lit(clock)), clocked(grant["observed_at"], F.lit(clock))
    change = F.col("kind") == "STATE_CHANGE"

    def placed(n: str) -> Column:
        x = span[n]
        return x.isNotNull() & ~(same(x["memory_id"], grant["memory_id"]) & same(x["session_id"], grant["source_id"]) & same(x["source_turn_id"], F.col("turn_id")) & same(x["source_role"], F.lit("user")))

    context = span["context"]
    outside = lambda x: context.isNotNull() & x.isNotNull() & ~((context["start"] <= x["start"]) & (x["start"] < x["end"]) & (x["end"] <= context["end"]))
    absent_from = lambda n: context.isNotNull() & span[n].isNotNull() & ~F.contains(F.coalesce(F.col(f"{n}_text"), F.lit("")), span[n]["text"])
    reasons = [
        say(~same(grant["candidate_sha256"], claim_fingerprint()), "CANDIDATE_GRANT_MISMATCH"),
        say(~(same(grant["memory_id"], source["memory_id"]) & same(grant["source_id"], source["source_id"])), "SOURCE_SCOPE_GRANT_MISMATCH"),
        *[say(blank(grant[n]), f"{n.upper()}_REQUIRED") for n in ("entity_id", "semantics_attestation_id", "identity_attestation_id")],
        say(~F.coalesce(grant["relation"].isin(SINGLE + MULTI), F.lit(False)), "UNSUPPORTED_STATE_RELATION"),
        say(grant["relation"].isin(MULTI), "MULTI_VALUE_EXECUTOR_REQUIRED"),
        *[say(named[n] & span[n].isNull(), "SOURCE_SPAN_NOT_RESTORABLE") for n in _SPANS],
        *[say(placed(n), "SPAN_SOURCE_ROLE_SCOPE_MISMATCH") for n in _SPANS],
        say(context.isNotNull() & ~same(context["text"], F.col("support_quote")), "CONTEXT_CLAIM_MISMATCH"),
        *[say(outside(span[n]), "ATOM_OUTSIDE_CLAIM_CONTEXT") for n in ("subject", "value", "time")],
        *[say(absent_from(n), "ATOM_CANDIDATE_MISMATCH") for n in ("subject", "value")],
        say(recorded.isNull(), "INVALID_KNOWLEDGE_TIMESTAMP"),
        say(change & ~same(span["time"]["text"], grant["valid_from"]) | (change & span["time"].isNull()), "LITERAL_VALID_INSTANT_REQUIRED"),
        say(change & valid.isNull(), "VALID_TIME_UNRESOLVED"),
        say(change & (valid > recorded), "STATE_CHANGE_AFTER_RECORDING"),
        say(~change & (~same(F.col("time_kind"), F.lit("SESSION_OBSERVATION")) | (F.coalesce(grant["observation_attestation_id"], F.lit("")) == "") | ~same(grant["observed_at"], source["session_timestamp"])), "CURRENT_SOURCE_OBSERVATION_BINDING_REQUIRED"),
        say(~change & observed.isNull(), "OBSERVATION_TIME_UNRESOLVED"),
        say(~change & (observed > recorded), "OBSERVATION_AFTER_RECORDING"),
    ]
    held = F.array_sort(F.array_distinct(F.array_compact(F.array(*reasons))))
    says = lambda disposition, why: F.struct(disposition.alias("disposition"), why.alias("reasons"))
    one = lambda disposition, why: says(F.lit(disposition), F.array(F.lit(why)))
    out = (
        F.when(F.col("kind").isin("PLAN", "PLAN_CANCEL"), one("CONTROL_EVIDENCE_ONLY", "INTENTION_DOES_NOT_MUTATE_STATE"))
        .when(F.col("kind") == "CORRECTION", one("TARGET_REVIEW_REQUIRED", "EXPLICIT_RECORD_TARGET_AND_REVISION_REQUIRED"))
        .when(~F.coalesce(F.col("kind").isin("OBSERVATION", "STATE_CHANGE"), F.lit(False)), one("HOLD", "UNSUPPORTED_OR_AMBIGUOUS_MODE"))
        .when(grant.isNull(), one("HOLD", "TRUSTED_SOURCE_SEMANTIC_IDENTITY_GRANT_REQUIRED"))
        .otherwise(says(F.when(F.size(held) > 0, "HOLD").otherwise("READY_FOR_TRUSTED_APPEND"), held))
    )
    valid_from, observed_at = F.when(change, grant["valid_from"]), F.when(~change, grant["observed_at"])
    evidence = fingerprint({"candidate": nested({n: F.col(n) for n in _CLAIM}), "source_id": grant["source_id"], "memory_id": grant["memory_id"], "relation": grant["relation"], "entity_id": grant["entity_id"], "value": span["value"]["text"], "valid_from": valid_from, "observed_at": observed_at})
    event = F.struct(
        grant["memory_id"].alias("memory_id"),
        F.concat(F.lit("state_"), evidence).alias("evidence_id"),
        grant["relation"].alias("relation"),
        span["value"]["text"].alias("object_text"),
        F.lit("ASSERTED").alias("fact_mode"),
        F.col("kind").alias("state_kind"),
        F.array(F.col("turn_id")).alias("source_turn_ids"),
        F.col("known_at").alias("recorded_at"),
        grant["entity_id"].alias("subject_id"),
        span["subject"]["text"].alias("subject_name"),
        valid_from.alias("state_valid_from"),
        observed_at.alias("observed_at"),
        F.lit(VERSION).alias("contract_version"),
        grant["semantics_attestation_id"].alias("semantics_attestation_id"),
        grant["identity_attestation_id"].alias("identity_attestation_id"),
        F.transform_values("spans", lambda _, x: x["span_id"]).alias("source_span_ids"),
    )
    rows = rows.withColumn("_out", out)
    return rows.select("candidate_id", "_out.disposition", "_out.reasons", F.when(F.col("_out.disposition") == "READY_FOR_TRUSTED_APPEND", event).alias("event"))
