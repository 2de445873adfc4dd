"""Dates: relative phrases and structured offsets to (start, end), clocks and bounds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Days of a counted unit, number words, names.
UNIT_DAYS = {"day": 1, "week": 7, "month": 30, "year": 365}
NUMBERS = {"a": 1, "an": 1, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6}
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
WEEKDAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]

_COUNT = r"(\d+|a|an|one|two|three|four|five|six)"


def _days(n: Column | int) -> Column:
    return n if isinstance(n, Column) else F.lit(n)


def _span(start: Column, end: Column | None = None) -> Column:
    return F.struct(start.alias("start"), (start if end is None else end).alias("end"))


def _pick(text: Column, table: dict[str, int]) -> Column:
    out = F.lit(None).cast("int")
    for name, value in table.items():
        out = F.when(text == name, value).otherwise(out)
    return out


def _int(text: Column) -> Column:
    return F.when(text.rlike(r"^\d{1,6}$"), text.try_cast("int"))


def _number(text: Column) -> Column:
    return F.coalesce(_int(text), _pick(text, NUMBERS))


def _month_names() -> dict[str, int]:
    return {name: i for i, m in enumerate(MONTHS, 1) for name in (m, m[:3])}


def _date(year: Column, month: Column, day: Column) -> Column:
    """The date, or null where there is none; checked first, as failed conversions are slow."""
    inside = F.day(F.last_day(F.make_date(year, month, F.lit(1))))
    return F.when(month.between(1, 12), F.when(day.between(1, inside), F.make_date(year, month, day)))


def _nearest_year(anchor: Column, month: Column, day: Column) -> Column:
    """The date with this month and day that is nearest to the anchor, of three years."""
    tries = [_date(F.year(anchor) + k, month, day) for k in (-1, 0, 1)]
    ranked = F.array_compact(F.array(*[F.when(t.isNotNull(), F.struct(F.abs(F.datediff(t, anchor)).alias("gap"), t.alias("date"))) for t in tries]))
    return F.try_element_at(F.array_sort(ranked), F.lit(1))["date"]


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


#: The phrases that are read.
_ISO = r"(\d{4})[/-](\d{1,2})[/-](\d{1,2})"
_NAMED = r"\b([a-z]{3,9})\s+(\d{1,2})(?:st|nd|rd|th)?\b"
_AGO = r"\b" + _COUNT + r"\s+(day|week|month|year)s?\s+ago\b"
_WEEK_DAY = r"\b(last|this|next)?\s*(" + "|".join(WEEKDAYS) + r")\b"
_IN_YEAR = r"\bin\s+((?:19|20)\d{2})\b"
_PAST = r"\b(?:past|last)\s+(\d+)\s*(?:-\s*\d+\s*)?(day|week|month|year)s?\b"
_IN_MONTH = r"\bin\s+([a-z]{3,9})\b"


def _parts(text: Column) -> Column:
    """What the patterns find in a phrase, as numbers."""
    get = lambda p, g=1: F.regexp_extract(text, p, g)
    return F.struct(
        text.alias("text"),
        text.rlike(r"\b(last|this|next|ago|yesterday|today|tonight|tomorrow|past)\b").alias("relative"),
        *[_int(get(_ISO, g)).alias(f"iso{g}") for g in (1, 2, 3)],
        _pick(get(_NAMED), _month_names()).alias("month"),
        _int(get(_NAMED, 2)).alias("day"),
        (_number(get(_AGO)) * _pick(get(_AGO, 2), UNIT_DAYS)).alias("ago"),
        get(_WEEK_DAY).alias("which"),
        _pick(get(_WEEK_DAY, 2), {d: i for i, d in enumerate(WEEKDAYS)}).alias("weekday"),
        _int(get(_IN_YEAR)).alias("year"),
        (_int(get(_PAST)) * _pick(get(_PAST, 2), UNIT_DAYS)).alias("past"),
        _pick(get(_IN_MONTH), _month_names()).alias("in_month"),
    )


def _rules(p: Column, anchor: Column) -> Column:
    text, weekday = p["text"], F.weekday(anchor)
    has = lambda pattern: text.rlike(pattern)
    monday, month = F.date_sub(anchor, weekday), F.trunc(anchor, "month")
    delta = F.pmod(weekday - p["weekday"], 7)
    delta = F.when((p["which"] == "last") & (delta == 0), 7).otherwise(delta)
    to_saturday = F.pmod(weekday - 5, 7)
    last_saturday = F.date_sub(anchor, F.when(to_saturday == 0, 7).otherwise(to_saturday) + F.when(weekday == 6, 7).otherwise(0))
    this_saturday = F.date_add(anchor, F.pmod(5 - weekday, 7))
    year_of = lambda y: _span(F.make_date(y, F.lit(1), F.lit(1)), F.make_date(y, F.lit(12), F.lit(31)))
    one = lambda d: F.when(d.isNotNull(), _span(d))
    return (
        F.when(~p["relative"] & p["iso1"].isNotNull(), _let(_date(p["iso1"], p["iso2"], p["iso3"]), one))
        .when(~p["relative"] & p["month"].isNotNull(), _let(_nearest_year(anchor, p["month"], p["day"]), one))
        .when(has(r"\btoday\b|\bthis morning\b|\btonight\b|\bjust now\b"), _span(anchor))
        .when(has(r"\byesterday\b"), _span(F.date_sub(anchor, 1)))
        .when(has(r"\btomorrow\b"), _span(F.date_add(anchor, 1)))
        .when(p["ago"].isNotNull(), _span(F.date_sub(anchor, p["ago"])))
        .when(p["weekday"].isNotNull(), _span(F.date_sub(anchor, delta)))
        .when(has(r"\blast weekend\b"), _span(last_saturday, F.date_add(last_saturday, 1)))
        .when(has(r"\bthis weekend\b"), _span(this_saturday, F.date_add(this_saturday, 1)))
        .when(has(r"\blast week\b"), _span(F.date_sub(monday, 7), F.date_sub(monday, 1)))
        .when(has(r"\bthis week\b"), _span(monday, F.date_add(monday, 6)))
        .when(has(r"\blast month\b"), _span(F.add_months(month, -1).cast("date"), F.date_sub(month, 1)))
        .when(has(r"\bthis month\b"), _span(month, F.last_day(anchor)))
        .when(has(r"\blast year\b"), year_of(F.year(anchor) - 1))
        .when(has(r"\bthis year\b"), year_of(F.year(anchor)))
        .when(p["year"].isNotNull(), year_of(p["year"]))
        .when(p["past"].isNotNull(), _span(F.date_sub(anchor, p["past"]), anchor))
        .when(p["in_month"].isNotNull(), _let(_nearest_year(anchor, p["in_month"], F.lit(15)), lambda d: F.when(d.isNotNull(), _span(F.trunc(d, "month"), F.last_day(d)))))
    )


def _simple(text: Column, anchor: Column) -> Column:
    """Resolve a phrase without a "before/after a date" part."""
    return _let(_parts(text), lambda p: _rules(p, anchor))


#: How many offsets may stand one inside the other ("two weeks before 3 days after ...").
NESTED = 4


def resolve(phrase: Column, anchor: Column) -> Column:
    """struct<start, end> of a time phrase said on the anchor date; null where it can't be pinned.

    What follows "two weeks before" is a phrase itself, and may begin with such an offset again, up to NESTED times.
    """
    offset = r"\b" + _COUNT + r"\s+(day|week|month|year)s?\s+(before|prior to|after|later than)\b(.*)"
    texts = [F.lower(F.trim(phrase))]
    for _ in range(NESTED):
        texts.append(F.regexp_extract(texts[-1], offset, 4))
    def reading(t: Column) -> Column:
        """What a text says by itself, and the days that its offset moves what follows."""
        sign = F.when(F.regexp_extract(t, offset, 3).isin("before", "prior to"), -1).otherwise(1)
        steps = _number(F.regexp_extract(t, offset, 1)) * _pick(F.regexp_extract(t, offset, 2), UNIT_DAYS)
        return F.struct(_simple(t, anchor).alias("span"), (sign * steps).cast("int").alias("move"))

    # all texts through one lambda, so the rules are planned once; empty texts stand at the end only
    readings = F.reverse(F.transform(F.filter(F.array(*texts), lambda t: t != ""), reading))
    moved = lambda inner, r: F.when(r["move"].isNotNull() & inner["start"].isNotNull(), _span(F.date_add(inner["start"], r["move"]))).otherwise(r["span"])
    return F.aggregate(readings, F.lit(None).cast("struct<start:date,end:date>"), moved)


def from_offset(count: Column, unit: Column, anchor: Column) -> Column:
    """struct<start, end> of a counted offset in days, weeks, weekends, months or years; null without a count or an anchor."""
    n = count.cast("int")
    monday = F.date_add(F.date_sub(anchor, F.weekday(anchor)), n * 7)
    saturday = F.date_add(F.date_sub(anchor, F.pmod(F.weekday(anchor) - 5, 7)), n * 7 + F.when(F.weekday(anchor) < 5, 7).otherwise(0))
    month = F.trunc(F.add_months(anchor, n), "month")
    year = F.year(anchor) + n
    span = (
        F.when(unit == "day", _span(F.date_add(anchor, n)))
        .when(unit == "week", _span(monday, F.date_add(monday, 6)))
        .when(unit == "weekend", _span(saturday, F.date_add(saturday, 1)))
        .when(unit == "month", _span(month, F.last_day(month)))
        .when(unit == "year", _span(F.make_date(year, F.lit(1), F.lit(1)), F.make_date(year, F.lit(12), F.lit(31))))
    )
    return F.when(n.isNotNull() & anchor.isNotNull(), span)


def enrich(events, count="time_offset_count", unit="time_offset_unit", phrase="effective_time_text", anchor="session_date"):
    """Fill date_value and date_end where the event has none: from the offset, else from the phrase."""
    span = F.coalesce(from_offset(F.col(count), F.col(unit), F.col(anchor)), resolve(F.col(phrase), F.col(anchor)))
    out = events.withColumn("_span", F.when(F.col("date_value").isNull(), span))
    return out.withColumn("date_end", F.coalesce("date_end", "_span.end")).withColumn("date_value", F.coalesce("date_value", "_span.start")).drop("_span")


def widen(bound: Column, *, end: bool) -> Column:
    """A timestamp from text; a bare date stands for the start, or for the end, of its day."""
    bare = bound.rlike(r"^\d{4}-\d{2}-\d{2}$")
    at = F.try_to_timestamp(bound)
    return F.when(bare & F.lit(end), at + F.expr("interval '23:59:59.999999' hour to second")).otherwise(at)


def clocked(text: Column, clock: Column) -> Column:
    """A timestamp whose text has a zone exactly if its clock is UTC; null otherwise."""
    zoned = text.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    ok = text.contains("T") & (zoned == (clock == "UTC"))
    return F.when(ok, F.try_to_timestamp(text))
