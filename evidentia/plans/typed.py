"""Typed plans over event tables: operators that answer only when their guards hold.

Every operator gives rows {status, value, reason}: ANSWER with a value, or UNKNOWN with
the reason; plans.execute gives evidence too. compile_plan turns a plan (a dict) into DataFrame operations; operands that nothing uses
are never built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SECONDS = {"seconds": 1.0, "hours": 3600.0, "days": 86400.0, "weeks": 604800.0}


def candidates(events: DataFrame, *, relations: list[str] | None = None, roles: list[str] | None = None, modes: list[str] | None = None, entities: list | None = None, detail: str | None = None, category: str | None = None) -> DataFrame:
    """Events that pass all filters; columns that a filter needs must be there."""
    tests = filter_tests(events, relations=relations, roles=roles, modes=modes, entities=entities, detail=detail, category=category)
    for test in tests.values():
        events = events.filter(test)
    return events


def filter_tests(events: DataFrame, *, relations=None, roles=None, modes=None, entities=None, detail=None, category=None) -> dict[str, Column]:
    tests = {}
    if relations:
        tests["RELATION"] = F.col("relation").isin(relations)
    if roles:
        tests["SOURCE_SCOPE"] = F.arrays_overlap("source_roles", F.array(*map(F.lit, roles)))
    if modes:
        tests["FACT_MODE"] = F.col("fact_mode").isin(modes)
    if entities:
        tests["ENTITY"] = F.col("entity_id").isin(entities)
    if detail:
        tests["DETAIL"] = F.contains(F.lower("object_text"), F.lit(detail.lower()))
    if category:
        tests["CATEGORY"] = F.array_contains("category_tags", category)
    return tests


def reject_reasons(events: DataFrame, **filters) -> DataFrame:
    """How many events each filter is the first to reject."""
    reason = F.lit("ACCEPTED")
    for name, test in reversed(filter_tests(events, **filters).items()):
        reason = F.when(~F.coalesce(test, F.lit(False)), name).otherwise(reason)
    return events.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def _answer(ok: Column, value: Column, reason: Column) -> list[Column]:
    return [F.when(ok, "ANSWER").otherwise("UNKNOWN").alias("status"), F.when(ok, value).alias("value"), F.when(~ok, reason).alias("reason")]


def count_distinct(events: DataFrame, by: list[str], key: str, *, certified: DataFrame | None = None, zero_if_complete: bool = False) -> DataFrame:
    """Distinct keys per group; with certified(by…, complete) an uncertified group is UNKNOWN, and zero needs zero_if_complete."""
    counted = events.groupBy(*by).agg(F.countDistinct(key).alias("n"))
    if certified is None:
        return counted.select(*by, *_answer(F.col("n") > 0, F.col("n"), F.lit("NO_ROWS")))
    rows = certified.join(counted, by, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    ok = F.col("complete") & ((F.col("n") > 0) | F.lit(zero_if_complete))
    return rows.select(*by, *_answer(ok, F.col("n"), F.when(~F.col("complete"), "SCOPE_NOT_CERTIFIED").otherwise("ZERO_NOT_CERTIFIED")))


def sum_values(events: DataFrame, by: list[str], value: str = "numeric_value", unit: str = "unit") -> DataFrame:
    """Sums per group where all rows have a value and one unit."""
    g = events.groupBy(*by).agg(F.sum(value).alias("s"), F.countDistinct(F.coalesce(unit, F.lit(""))).alias("units"), F.count_if(F.col(value).isNull()).alias("blank"), F.min(unit).alias("unit"))
    ok = (F.col("units") == 1) & (F.col("blank") == 0)
    return g.select(*by, F.when(ok, F.col("unit")).alias("unit"), *_answer(ok, F.col("s"), F.when(F.col("blank") > 0, "VALUE_MISSING").otherwise("MIXED_UNITS")))


def extreme(events: DataFrame, by: list[str], value: str, time: str, *, newest: bool = True) -> DataFrame:
    """The value at the newest or oldest time; undated rows and ties between values are UNKNOWN."""
    edge = (F.max if newest else F.min)(time).over(Window.partitionBy(*by))
    undated = F.count_if(F.col(time).isNull()).over(Window.partitionBy(*by))
    at = events.withColumn("_edge", edge).withColumn("_undated", undated).filter(F.col(time).isNull() | (F.col(time) == F.col("_edge")))
    g = at.groupBy(*by).agg(F.max("_undated").alias("undated"), F.min(F.when(F.col(time).isNotNull(), F.col(value))).alias("v"), F.countDistinct(F.when(F.col(time).isNotNull(), F.col(value))).alias("n"), F.max("_edge").alias("at"))
    ok = (F.col("undated") == 0) & (F.col("n") == 1)
    return g.select(*by, "at", *_answer(ok, F.col("v"), F.when(F.col("undated") > 0, "UNDATED_CANDIDATE").otherwise("TIE")))


def lookup(events: DataFrame, by: list[str], value: str) -> DataFrame:
    g = events.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("v"))
    return g.select(*by, *_answer(F.col("n") == 1, F.col("v"), F.lit("NOT_UNIQUE")))


def list_values(events: DataFrame, by: list[str], value: str) -> DataFrame:
    return events.groupBy(*by).agg(F.sort_array(F.collect_set(value)).alias("values"))


def subtract(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """left - right of two answers with one unit."""
    r = right.select(*by, F.col("value").alias("_v"), F.col("unit").alias("_u"), F.col("status").alias("_s"))
    j = left.join(r, by)
    ok = (F.col("status") == "ANSWER") & (F.col("_s") == "ANSWER") & F.col("unit").eqNullSafe(F.col("_u"))
    return j.select(*by, "unit", *_answer(ok, F.col("value") - F.col("_v"), F.lit("OPERANDS_DIFFER")))


def compare(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    d = subtract(left, right, by)
    word = F.when(F.col("value") > 0, "GREATER").when(F.col("value") < 0, "LESS").otherwise("EQUAL")
    return d.withColumn("value", F.when(F.col("status") == "ANSWER", word))


def date_diff(earlier: Column, later: Column, unit: str) -> Column:
    micros = F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))
    return micros / 1e6 / SECONDS[unit]


def relative_to(events: DataFrame, reference: DataFrame, by: list[str], time: str, *, before: bool) -> DataFrame:
    """Events before or after the group's one reference time; groups without exactly one have none."""
    ref = reference.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.min(time).alias("_at")).filter("_n = 1")
    j = events.join(ref, by)
    return j.filter(F.col(time) < F.col("_at") if before else F.col(time) > F.col("_at")).drop("_n", "_at")


def aggregate_total(items: DataFrame, by: list[str]) -> DataFrame:
    """Stated total if there is one, else the sum of amounts if all have one, else the number of items.

    items(label, at, amount, stated): a label counts once a date.
    """
    key = F.struct(F.lower(F.trim("label")).alias("label"), F.to_date("at").alias("day"))
    once = items.withColumn("_key", key).groupBy(*by, "_key").agg(F.max("amount").alias("amount"), F.max("stated").alias("stated"))
    g = once.groupBy(*by).agg(F.max("stated").alias("stated"), F.sum("amount").alias("total"), F.count_if(F.col("amount").isNull()).alias("blank"), F.count(F.lit(1)).alias("n"))
    value = F.coalesce("stated", F.when(F.col("blank") == 0, F.col("total")), F.col("n").cast("double"))
    basis = F.when(F.col("stated").isNotNull(), "STATED").when(F.col("blank") == 0, "SUM").otherwise("COUNT")
    return g.select(*by, value.alias("value"), basis.alias("basis"))


def largest_group(items: DataFrame, by: list[str], label: str, amount: str, *, time: str | None = None, since=None, until=None) -> DataFrame:
    """The label with the largest total, and that total; with time, of items from since on and before until."""
    if time is not None:
        items = items.filter((F.col(time) >= since) if since is not None else F.lit(True)).filter((F.col(time) < until) if until is not None else F.lit(True))
    g = items.groupBy(*by, label).agg(F.sum(amount).alias("total"))
    return g.groupBy(*by).agg(F.max_by(label, F.struct(F.round("total", 6), label)).alias("winner"), F.max("total").alias("total"))


def audit_plan(plan: dict) -> list[str]:
    """Structural violations of a plan."""
    found, names = [], [o.get("name") for o in plan.get("operands", [])]
    if plan.get("operator") not in {"LOOKUP", "LATEST", "EARLIEST", "COUNT", "SUM", "SUBTRACT", "COMPARE", "LIST"}:
        found.append("UNKNOWN_OPERATOR")
    if len(set(names)) != len(names) or None in names:
        found.append("OPERAND_NAMES")
    needs = 2 if plan.get("operator") in {"SUBTRACT", "COMPARE"} else 1
    if len(plan.get("use", [])) != needs or not set(plan.get("use", [])) <= set(names):
        found.append("OPERAND_REFERENCES")
    refs = {o.get("name"): o.get("before") or o.get("after") for o in plan.get("operands", [])}
    for name in names:
        seen, at = set(), name
        while at is not None and at not in seen:
            seen.add(at)
            at = refs.get(at)
        if at is not None:
            found.append("CYCLIC_TIME_REFERENCE")
            break
    return found


def compile_plan(plan: dict, events: DataFrame, by: list[str]) -> DataFrame:
    """The answer rows of {operator, use: [names], operands: [{name, filters, before/after}], key?, value?}."""
    if problems := audit_plan(plan):
        keys = events.select(*by).distinct()
        return keys.select(*by, F.lit("UNKNOWN").alias("status"), F.lit(None).cast("double").alias("value"), F.lit(problems[0]).alias("reason"))
    specs, built = {o["name"]: o for o in plan["operands"]}, {}

    def operand(name: str) -> DataFrame:
        if name not in built:
            spec = specs[name]
            rows = candidates(events, **spec.get("filters", {}))
            for side in ("before", "after"):
                if spec.get(side):
                    rows = relative_to(rows, operand(spec[side]), by, plan.get("time", "observed_at"), before=side == "before")
            built[name] = rows
        return built[name]

    value, time = plan.get("value", "numeric_value"), plan.get("time", "observed_at")
    rows = [operand(n) for n in plan["use"]]
    kind = plan["operator"]
    if kind == "COUNT":
        return count_distinct(rows[0], by, plan.get("key", "evidence_id"), certified=plan.get("certified"), zero_if_complete=plan.get("zero_if_complete", False))
    if kind == "SUM":
        return sum_values(rows[0], by, value, plan.get("unit", "unit")).drop("unit")
    if kind in ("LATEST", "EARLIEST"):
        return extreme(rows[0], by, value, time, newest=kind == "LATEST").drop("at")
    if kind == "LOOKUP":
        return lookup(rows[0], by, value)
    if kind == "LIST":
        return list_values(rows[0], by, value)
    sums = [sum_values(r, by, value, plan.get("unit", "unit")) for r in rows]
    return (subtract if kind == "SUBTRACT" else compare)(*sums, by).drop("unit")


def bound_events(participants: DataFrame, bindings: list[tuple[str, list]], event_ids: DataFrame | None = None) -> DataFrame:
    """event_id of events that hold one of the entities in each (role, entities), and are among event_ids if given.

    participants(event_id, role, entity_id). One semi-join a binding.
    """
    found = event_ids.select("event_id").distinct() if event_ids is not None else None
    for role, entities in bindings:
        hit = participants.filter((F.col("role") == role) & F.col("entity_id").isin(entities)).select("event_id").distinct()
        found = hit if found is None else found.join(hit, "event_id", "left_semi")
    if found is None:
        raise ValueError("a binding or event_ids is needed")
    return found
