"""Bounded context packets: a greedy character budget as a fold over each question's candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions.text import file_name

NOTE_TURNS = 10
MARK = "…[TRUNCATED]"


def candidates(memories: DataFrame, turns: DataFrame, budget: int, *, order: str = "relevance") -> DataFrame:
    """query_id, item, place of all candidates in packing order.

    memories and turns have query_id, place and item, a struct<kind, class, scope, at, title, content,
    source_type, source_ref>; memories also from_turns, turns also turn_id. Turns that a memory
    cites leave; with any cited, NOTE_TURNS stay. Memories lead while their running length is within a
    quarter of the budget.
    """
    cited = memories.select("query_id", F.explode("from_turns").alias("turn_id")).distinct()
    noted = cited.groupBy("query_id").agg(F.lit(True).alias("_noted"))
    left = turns.join(cited, ["query_id", "turn_id"], "left_anti").join(noted, "query_id", "left")
    left = left.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy("place"))).filter(F.col("_noted").isNull() | (F.col("_n") <= NOTE_TURNS))
    run = Window.partitionBy("query_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    lead = F.sum(F.length("item.content") + F.length("item.title") + 120).over(run) <= budget // 4
    m = memories.select("query_id", "item", "place", F.when(lead, 0).otherwise(2).alias("rank"))
    both = m.unionByName(left.select("query_id", "item", F.col("_n").alias("place"), F.lit(1).alias("rank")))
    by = [F.desc("item.at"), "rank", "place"] if order == "time" else ["rank", "place"]
    return both.select("query_id", "item", F.row_number().over(Window.partitionBy("query_id").orderBy(*by)).alias("place"))


def _section(item: Column, short_sources: bool) -> tuple[Column, Column]:
    title = F.when(item["content"].startswith(item["title"]), "").otherwise(item["title"])
    head = F.concat(F.lit("["), F.concat_ws(" | ", item["kind"], item["class"], item["scope"], item["at"]), F.lit("] "), title)
    ref = file_name(item["source_ref"]) if short_sources else item["source_ref"]
    return F.concat(F.rtrim(head), F.lit("\n")), F.concat(F.lit("\nSource: "), item["source_type"], F.lit(" / "), ref)


def pack(items: DataFrame, budget: int = 6000, *, short_sources: bool = False, bare: bool = False) -> DataFrame:
    """query_id, context, used_chars, estimated_tokens, selected_items, omitted_items for items(query_id, item, place).

    An item that leaves no room for its header, footer and 16 characters is skipped; one that does not
    fit whole is cut, marked, and ends the packet. With bare, sections are bodies only.
    """
    listed = items.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "item"))), lambda x: x["item"]).alias("items"))
    parts = listed.withColumn("parts", F.transform("items", lambda i: F.struct(*([F.lit("").alias("head"), F.lit("").alias("foot")] if bare else [c.alias(n) for c, n in zip(_section(i, short_sources), ("head", "foot"), strict=True)]), i["content"].alias("body"))))
    start = F.struct(F.lit(0).alias("used"), F.lit(False).alias("stop"), F.array().cast("array<string>").alias("out"))

    def add(acc: Column, p: Column) -> Column:
        gap = F.when(F.size(acc["out"]) > 0, 2).otherwise(0)
        room = F.lit(budget) - acc["used"] - gap
        frame = F.length(p["head"]) + F.length(p["foot"])
        skip = acc["stop"] | (room <= frame + 16)
        cut = frame + F.length(p["body"]) > room
        body = F.when(cut, F.concat(F.substring(p["body"], F.lit(1), F.greatest(F.lit(0), room - frame - 15)), F.lit(MARK))).otherwise(p["body"])
        section = F.concat(p["head"], body, p["foot"])
        taken = F.struct((acc["used"] + gap + F.length(section)).alias("used"), cut.alias("stop"), F.concat(acc["out"], F.array(section)).alias("out"))
        return F.when(skip, acc).otherwise(taken)

    done = parts.withColumn("done", F.aggregate("parts", start, add))
    context = F.array_join("done.out", "\n\n")
    return done.select(
        "query_id",
        context.alias("context"),
        F.length(context).alias("used_chars"),
        F.ceil(F.length(context) / 4).cast("int").alias("estimated_tokens"),
        F.size("done.out").alias("selected_items"),
        (F.size("items") - F.size("done.out")).alias("omitted_items"),
        F.when(F.size("done.out") > 0, "KNOWN").otherwise("UNKNOWN").alias("status"),
    )
