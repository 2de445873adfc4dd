"""Typed plans with selectors, time references and certificates, for all groups of events at once.

A plan is {operator, operands, ...}. An operand names filters (those of typed.candidates), time_start and time_end_exclusive
(ISO texts), time_relation with time_reference_operand, selector (ALL, UNIQUE, LATEST, EARLIEST), value_field (NUMERIC_VALUE,
DATE_VALUE, OBJECT_TEXT, EVENT_COUNT) and unit. Every operand is summed up once for each group; a group's answer then is an
expression over these few rows, so a plan costs one shuffle an operand, whatever its events. A group that breaks a
rule is UNKNOWN with the first reason, in the order in which operands are resolved.

COUNT, and SUM over ALL, answer only where certificates(by..., operand) say that the operand's scope is complete. Evidence
comes as rows, not as lists, since a count's evidence may be as large as the group.
"""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.plans.typed import SECONDS, candidates

SELECTORS = ("ALL", "UNIQUE", "LATEST", "EARLIEST")
FIELDS = {"NUMERIC_VALUE": "numeric_value", "DATE_VALUE": "at", "OBJECT_TEXT": "object_text", "EVENT_COUNT": "evidence_id"}
KEYS = {"CANONICAL_ENTITY_ID": "entity_id", "OCCURRENCE_ID": "occurrence_id", "OBJECT_TEXT": "object_text", "EVENT_ID": "evidence_id"}
BINARY, UNARY = ("SUBTRACT", "DATE_DIFF", "COMPARE"), ("LATEST", "EARLIEST", "LOOKUP")
_RELATIONS = {"BEFORE": lambda a, b: a < b, "AFTER": lambda a, b: a > b, "ON_OR_BEFORE": lambda a, b: a <= b, "ON_OR_AFTER": lambda a, b: a >= b}


def _bound(text: str | None) -> datetime | None:
    try:
        return datetime.fromisoformat(text) if text else None
    except ValueError:
        return None


def problem(plan: dict) -> str | None:
    """What is wrong with a plan before any event is seen."""
    operands, operator = plan.get("operands", []), plan.get("operator")
    names = [o.get("name") for o in operands]
    if not operands or None in names or len(set(names)) != len(names):
        return "INVALID_OPERAND_NAMES"
    for o in operands:
        if o.get("selector", "ALL") not in SELECTORS:
            return "INVALID_SELECTOR"
        if o.get("value_field", "NUMERIC_VALUE") not in FIELDS:
            return "INVALID_VALUE_FIELD"
        if o.get("time_relation", "ANY") not in ("ANY", *_RELATIONS):
            return f"{o['name']}:UNSUPPORTED_TIME_RELATION"
        start, end = (_bound(o.get(k)) for k in ("time_start", "time_end_exclusive"))
        if (o.get("time_start") and start is None) or (o.get("time_end_exclusive") and end is None):
            return f"{o['name']}:INVALID_TIME_BOUND"
        if start and end and start >= end:
            return f"{o['name']}:INVALID_TIME_RANGE"
        if o.get("time_reference_operand") not in (None, *names):
            return f"{o['name']}:UNKNOWN_TIME_REFERENCE"
    if operator in UNARY and (plan.get("result_operand") or (names[0] if len(names) == 1 else None)) not in names:
        return "RESULT_OPERAND_UNSPECIFIED"
    if _ordered(plan) is None:
        return "CYCLIC_TIME_REFERENCE"
    if operator == "COUNT":
        if plan.get("aggregate_operand") not in names:
            return "COUNT_OPERAND_UNSPECIFIED"
        if next(o for o in operands if o["name"] == plan["aggregate_operand"]).get("distinct_by") not in KEYS:
            return "COUNT_DISTINCT_KEY_UNSPECIFIED"
    if operator in BINARY and len(names) != 2:
        return "BINARY_VALUES_MISSING_OR_NON_UNIQUE"
    return None if operator in ("COUNT", "SUM", *UNARY, *BINARY) else "UNSUPPORTED_OPERATOR"


def _active(plan: dict) -> list[dict]:
    """Operands that the answer needs: of a unary plan the result's, required ones, and what these refer to."""
    by = {o["name"]: o for o in plan["operands"]}
    if plan["operator"] not in UNARY:
        return list(by.values())
    todo = [plan.get("result_operand") or next(iter(by)), *(n for n, o in by.items() if o.get("required"))]
    seen: set[str] = set()
    while todo:
        if (name := todo.pop()) not in seen:
            seen.add(name)
            todo += [r for r in [by[name].get("time_reference_operand")] if r]
    return [o for n, o in by.items() if n in seen]


def _ordered(plan: dict) -> list[dict] | None:
    """Active operands, references first; None if they refer in a circle."""
    left, out = _active(plan), []
    while left:
        ready = [o for o in left if o.get("time_reference_operand") not in {x["name"] for x in left}]
        if not ready:
            return None
        out += ready
        left = [o for o in left if o not in ready]
    return out


def _say(pairs: list[tuple[Column, str]]) -> Column:
    return F.coalesce(*[F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for test, name in pairs], F.lit(None).cast("string"))


class _Operand:
    """An operand's rows and, for each group, its summary: n, reason and what operators need."""

    def __init__(self, spec: dict, events: DataFrame, by: list[str], keys: DataFrame, reference: _Operand | None):
        self.name, self.spec = spec["name"], spec
        rows = candidates(events, **spec.get("filters", {}))
        start, end = (_bound(spec.get(k)) for k in ("time_start", "time_end_exclusive"))
        relation = spec.get("time_relation", "ANY")
        timed = start is not None or end is not None or relation != "ANY"
        if relation != "ANY":
            at = keys.select(*by).join(reference.summary.select(*by, "n", "at"), by, "left") if reference else keys.select(*by, F.lit(0).alias("n"), F.lit(None).cast("timestamp").alias("at"))
            self.boundary = at.select(*by, F.when(F.col("n") == 1, F.col("at")).alias("_boundary"))
            rows = rows.join(self.boundary, by)
        inside = [F.lit(True)]
        inside += [F.col("at") >= F.lit(start)] if start else []
        inside += [F.col("at") < F.lit(end)] if end else []
        inside += [_RELATIONS[relation](F.col("at"), F.col("_boundary"))] if relation != "ANY" else []
        # rows without a time stay to be counted; a group that has one where a time is asked for is unknown
        rows = rows.withColumn("_undated", F.col("at").isNull()).filter(F.col("_undated") | reduce(lambda a, b: a & b, inside))
        selector = spec.get("selector", "ALL")
        if selector in ("LATEST", "EARLIEST"):
            edge = rows.groupBy(*by).agg((F.max if selector == "LATEST" else F.min)("at").alias("_edge"))
            rows = rows.join(edge, by).filter(F.col("_undated") | (F.col("at") == F.col("_edge")))
        field = FIELDS[spec.get("value_field", "NUMERIC_VALUE")]
        rows = rows.withColumn("value", F.col(field))
        bad = F.col("value").isNull()
        if spec.get("unit"):
            bad = bad | ~F.coalesce(F.lower("unit") == spec["unit"].lower(), F.lit(False))
        self.rows = rows
        key = KEYS.get(spec.get("distinct_by"), "evidence_id")
        key = F.lower(F.trim(F.col(key))) if key == "object_text" else F.col(key)
        some = rows.groupBy(*by).agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if("_undated").alias("undated"),
            F.count_if(bad).alias("bad"),
            F.max("at").alias("at"),
            F.min("value").alias("low"),
            F.max("value").alias("high"),
            F.countDistinct("value").alias("values"),
            F.min("unit").alias("unit"),
            F.countDistinct(F.coalesce("unit", F.lit(""))).alias("units"),
            F.countDistinct(key).alias("distinct"),
            F.count_if(key.isNull()).alias("blank"),
            F.min("at").alias("first"),
            F.max_by("value", F.struct("at", "value")).alias("newest"),
            F.min_by("value", F.struct("at", "value")).alias("oldest"),
            *([F.sum("numeric_value").alias("sum")] if field == "numeric_value" else [F.lit(None).cast("double").alias("sum")]),
        )
        edges = rows.join(some.select(*by, F.col("at").alias("_last"), F.col("first").alias("_first")), by).groupBy(*by).agg(
            F.countDistinct(F.when(F.col("at") == F.col("_last"), F.col("value"))).alias("ties_last"), F.countDistinct(F.when(F.col("at") == F.col("_first"), F.col("value"))).alias("ties_first")
        )
        whole = keys.select(*by).join(some, by, "left").join(edges, by, "left").withColumn("n", F.coalesce("n", F.lit(0)))
        undated = F.col("undated") > 0
        tests = [(undated, "MATCHING_EVENT_TIME_UNRESOLVED")] if timed else []
        if relation != "ANY":
            whole = whole.join(self.boundary, by, "left")
            tests.insert(0, (F.col("_boundary").isNull(), "TIME_REFERENCE_MISSING_OR_NON_UNIQUE"))
        if selector in ("LATEST", "EARLIEST"):
            tests += [(undated, "SELECTION_TIME_UNRESOLVED"), (F.col("n") > 1, "SELECTION_TIE")]
        if selector == "UNIQUE":
            tests.append((F.col("n") != 1, "MISSING_OR_NON_UNIQUE"))
        tests.append((F.col("bad") > 0, "VALUE_OR_UNIT_UNRESOLVED"))
        self.summary = whole.withColumn("reason", _say([(t, f"{self.name}:{n}") for t, n in tests]))


def execute(plan: dict, events: DataFrame, by: list[str], certificates: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(answers: by..., status, value, text, unit, reason; evidence: by..., operand, evidence_id of the answers).

    events(by..., evidence_id, at (when it happened, null if unknown), numeric_value, unit, object_text, and what filters and
    distinct_by need). value is a number, text what is none. Groups are those of events.
    """
    keys = events.select(*by).distinct()
    nothing = keys.limit(0).select(*by, F.lit("").alias("operand"), F.lit(None).cast(events.schema["evidence_id"].dataType).alias("evidence_id"))
    if wrong := problem(plan):
        empty = {"value": "double", "text": "string", "unit": "string"}
        return keys.select(*by, F.lit("UNKNOWN").alias("status"), *[F.lit(None).cast(k).alias(c) for c, k in empty.items()], F.lit(wrong).alias("reason")), nothing
    built: dict[str, _Operand] = {}
    for spec in _ordered(plan):
        built[spec["name"]] = _Operand(spec, events, by, keys, built.get(spec.get("time_reference_operand")))
    names = [o["name"] for o in _active(plan)]
    rows = keys
    for i, name in enumerate(built):
        fields = F.struct(*[c for c in built[name].summary.columns if c not in by]).alias(f"_o{i}")
        rows = rows.join(built[name].summary.select(*by, fields), by)
        held = certificates.filter(F.col("operand") == name).select(*by).distinct() if certificates is not None else keys.limit(0)
        rows = rows.join(held.withColumn(f"_c{i}", F.lit(True)), by, "left")
    at = {name: F.col(f"_o{i}") for i, name in enumerate(built)}
    certified = {name: F.coalesce(F.col(f"_c{i}"), F.lit(False)) for i, name in enumerate(built)}
    operator, tests = plan["operator"], []
    number, text, unit = F.lit(None).cast("double"), F.lit(None).cast("string"), F.lit(None).cast("string")
    none = reduce(lambda a, b: a | b, [at[n]["n"] == 0 for n in names])
    scope = plan.get("index_scope_required", False)
    if operator == "COUNT":
        o = plan["aggregate_operand"]
        used = [o]
        tests = [(~certified[o], "COUNT_SCOPE_NOT_CERTIFIED"), (at[o]["blank"] > 0, "COUNT_DISTINCT_KEY_MISSING")]
        if plan.get("empty_result") != "ZERO_IF_COMPLETE":
            tests.append((at[o]["n"] == 0, "EMPTY_RESULT_UNKNOWN"))
        number = F.coalesce(at[o]["distinct"], F.lit(0)).cast("double")
    else:
        if scope:
            tests.append((~reduce(lambda a, b: a & b, [certified[n] for n in names]), "INDEX_SCOPE_NOT_CERTIFIED"))
        if operator == "SUM":
            loose = [~certified[o["name"]] for o in plan["operands"] if o.get("selector", "ALL") == "ALL"]
            tests += [(reduce(lambda a, b: a | b, loose), "SUM_SCOPE_NOT_CERTIFIED")] if loose else []
        tests.append((none, "MISSING_OPERATOR_VALUE"))
    if operator in BINARY:
        used = names
        a, b = at[names[0]], at[names[1]]
        tests.append(((a["n"] != 1) | (b["n"] != 1), "BINARY_VALUES_MISSING_OR_NON_UNIQUE"))
        if operator == "DATE_DIFF":
            tests.append((a["at"].isNull() | b["at"].isNull(), "VALUE_OR_UNIT_UNRESOLVED"))
            size = (plan.get("result_unit") or "days").lower()
            number, unit = (F.unix_micros(b["at"].cast("timestamp")) - F.unix_micros(a["at"].cast("timestamp"))) / 1e6 / SECONDS[size], F.lit(size)
        else:
            tests.append((~a["unit"].eqNullSafe(b["unit"]), "OPERANDS_DIFFER"))
            difference, unit = a["low"].cast("double") - b["low"].cast("double"), a["unit"]
            if operator == "SUBTRACT":
                number = difference
            else:
                text, unit = F.when(difference > 0, "GREATER").when(difference < 0, "LESS").otherwise("EQUAL"), F.lit(None).cast("string")
    elif operator == "SUM":
        used = names
        units = reduce(lambda a, b: a & b, [(at[n]["units"] == 1) & at[n]["unit"].eqNullSafe(at[names[0]]["unit"]) for n in names])
        tests.append((~units, "MIXED_UNITS"))
        number, unit = reduce(lambda a, b: a + b, [at[n]["sum"].cast("double") for n in names]), at[names[0]]["unit"]
    elif operator in UNARY:
        o = plan.get("result_operand") or names[0]
        used, s = [o], at[o]
        picked = {"LOOKUP": "low", "LATEST": "newest", "EARLIEST": "oldest"}[operator]
        if operator == "LOOKUP":
            tests.append((s["values"] != 1, "NOT_UNIQUE"))
        else:
            tests += [(s["undated"] > 0, "UNDATED_CANDIDATE"), (s["ties_last" if operator == "LATEST" else "ties_first"] > 1, "TIE")]
        numeric = built[o].spec.get("value_field", "NUMERIC_VALUE") == "NUMERIC_VALUE"
        number, text = (s[picked].cast("double"), text) if numeric else (number, s[picked].cast("string"))
        unit = F.when(s["units"] == 1, s["unit"]) if numeric else unit
    first = [at[n]["reason"] for n in built]
    reason = F.coalesce(*first, _say(tests))
    ok = reason.isNull()
    answers = rows.select(*by, F.when(ok, "ANSWER").otherwise("UNKNOWN").alias("status"), F.when(ok, number).alias("value"), F.when(ok, text).alias("text"), F.when(ok, unit).alias("unit"), reason.alias("reason"))
    good, evidence = answers.filter("status = 'ANSWER'").select(*by), nothing
    for n in used:
        found = built[n].rows
        if operator in ("LATEST", "EARLIEST"):
            edge = built[n].summary.select(*by, F.col("at" if operator == "LATEST" else "first").alias("_at"))
            found = found.join(edge, by).filter(F.col("at") == F.col("_at"))
        evidence = evidence.unionByName(found.join(good, by, "left_semi").select(*by, F.lit(n).alias("operand"), "evidence_id").distinct())
    return answers, evidence
