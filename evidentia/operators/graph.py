"""Association graph: automatic links, upserts, bounded spreading activation, view edges, regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidentia.sources.generations import Generations
from evidentia.sources.scratch import kept

SHARED, NEXT, EXPLICIT = "SHARED_CUE", "TEMPORAL", "EXPLICIT"
DECAY = 0.65


def _term_sets(engrams: DataFrame, common: int | None) -> DataFrame:
    """engram_id, scope, revision, terms (distinct, in order), set_id: engrams of one scope with the same terms share it."""
    if common is not None:
        words = engrams.select("engram_id", "scope", F.explode("terms").alias("term"))
        few = words.groupBy("scope", "term").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= common)
        left = words.join(few.drop("n"), ["scope", "term"], "left_semi").groupBy("engram_id").agg(F.collect_set("term").alias("terms"))
        engrams = engrams.select("engram_id", "scope", "revision").join(left, "engram_id")
    terms = F.array_sort(F.array_distinct("terms"))
    return engrams.select("engram_id", "scope", "revision", terms.alias("terms")).withColumn("set_id", F.md5(F.array_join("terms", "\u0000")))


def _set_pairs(sets: DataFrame, least: int) -> DataFrame:
    """scope, set_id, other, overlap: ordered pairs of sets(scope, set_id, terms) that share at least `least` terms, each with itself too.

    Terms go by how many sets hold them, rarest first; of two sets that share so many terms, each without its
    least - 1 most common ones, one term is still shared, so only these are joined. The overlap is counted from the sets.
    """
    words = sets.select("scope", "set_id", F.size("terms").alias("n"), F.explode("terms").alias("term"))
    held = words.groupBy("scope", "term").agg(F.count(F.lit(1)).alias("df"))
    rare = Window.partitionBy("scope", "set_id").orderBy("df", "term")
    first = words.join(held, ["scope", "term"]).withColumn("_n", F.row_number().over(rare)).filter(F.col("_n") <= F.col("n") - (least - 1)).select("scope", "term", "set_id")
    pairs = first.join(first.withColumnRenamed("set_id", "other"), ["scope", "term"]).select("scope", "set_id", "other").distinct()
    terms = sets.select("scope", "set_id", "terms")
    both = pairs.join(terms, ["scope", "set_id"]).join(terms.withColumnsRenamed({"set_id": "other", "terms": "_terms"}), ["scope", "other"])
    return both.select("scope", "set_id", "other", F.size(F.array_intersect("terms", "_terms")).alias("overlap")).filter(F.col("overlap") >= least)


def shared_cues(engrams: DataFrame, *, most: int, least_overlap: int, common: int | None = None, new: DataFrame | None = None) -> DataFrame:
    """engram_id, target, overlap: of each engram (or of new(engram_id)) the `most` earlier ones of its scope that share most terms, newest first.

    Engrams with the same terms are one set, and sets are compared, not engrams. A set's members are numbered by revision; an
    engram's place in that sequence says how many came before it, and only the last `most` of these are fetched, and
    none from sets whose overlap others with more have already filled.
    """
    base = kept(_term_sets(engrams, common))
    pairs = _set_pairs(base.select("scope", "set_id", "terms").distinct(), least_overlap)
    asking = base if new is None else base.join(new.select("engram_id"), "engram_id", "left_semi")
    marks = asking.select("engram_id", "scope", "set_id", "revision").join(pairs, ["scope", "set_id"]).select("scope", F.col("other").alias("set_id"), "revision", F.lit(0).alias("member"), "engram_id", "overlap")
    members = base.select("scope", "set_id", "revision", F.lit(1).alias("member"), "engram_id", F.lit(None).cast("int").alias("overlap"))
    order = Window.partitionBy("scope", "set_id").orderBy("revision", "member").rowsBetween(Window.unboundedPreceding, 0)
    line = kept(marks.unionByName(members).withColumn("n", F.sum("member").over(order)))
    counted = line.filter("member = 0 AND n > 0")
    richer = Window.partitionBy("engram_id").orderBy(F.desc("overlap")).rangeBetween(Window.unboundedPreceding, -1)
    counted = counted.withColumn("_before", F.coalesce(F.sum(F.least("n", F.lit(most))).over(richer), F.lit(0))).filter(F.col("_before") < most)
    wanted = counted.select("scope", "set_id", F.col("engram_id").alias("source"), "overlap", F.explode(F.sequence(F.greatest(F.lit(1).cast("long"), F.col("n") - most + 1), "n")).alias("n"))
    met = wanted.join(line.filter("member = 1").select("scope", "set_id", "n", F.col("engram_id").alias("target"), F.col("revision").alias("target_revision")), ["scope", "set_id", "n"])
    best = Window.partitionBy("source").orderBy(F.desc("overlap"), F.desc("target_revision"))
    return met.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= most).select(F.col("source").alias("engram_id"), "target", "overlap")


def previous_in_time(engrams: DataFrame) -> DataFrame:
    """engram_id, target: the engram of the scope that comes just before, by happened_at and revision.

    Within a day by a window, and a day's first takes the last of the scope's nearest earlier day, so no task orders a whole scope.
    """
    rows = engrams.select("engram_id", "scope", "happened_at", "revision", F.date_trunc("day", F.col("happened_at").cast("timestamp")).alias("day"))
    inside = Window.partitionBy("scope", "day").orderBy("happened_at", "revision")
    rows = rows.withColumn("target", F.lag("engram_id").over(inside))
    last = rows.groupBy("scope", "day").agg(F.max_by("engram_id", F.struct("happened_at", "revision")).alias("last"))
    carried = last.select("scope", "day", F.lag("last").over(Window.partitionBy("scope").orderBy("day")).alias("before"))
    same = rows["scope"].eqNullSafe(carried["scope"]) & rows["day"].eqNullSafe(carried["day"])
    return rows.join(carried, same).select("engram_id", F.coalesce("target", "before").alias("target")).filter("target IS NOT NULL")


def auto_links(engrams: DataFrame, *, most: int = 12, least_overlap: int = 2, common: int | None = None, new: DataFrame | None = None) -> DataFrame:
    """source, target, relation, weight: links to earlier engrams of the scope, written both ways.

    engrams(engram_id, scope, happened_at, terms, revision). The `most` earlier engrams sharing most
    terms get weight min(0.75, 0.2 + 0.1 overlap); the predecessor in time gets 0.3. Terms held by more than `common`
    engrams of a scope are no cues (None: all count). With new(engram_id) only these are linked to what came before.
    """
    cue = shared_cues(engrams, most=most, least_overlap=least_overlap, common=common, new=new)
    cue = cue.select(F.col("engram_id").alias("source"), "target", F.lit(SHARED).alias("relation"), F.least(F.lit(0.75), 0.2 + 0.1 * F.col("overlap")).alias("weight"))
    time = previous_in_time(engrams)
    time = time if new is None else time.join(new.select("engram_id"), "engram_id", "left_semi")
    one = kept(cue.unionByName(time.select(F.col("engram_id").alias("source"), "target", F.lit(NEXT).alias("relation"), F.lit(0.3).alias("weight"))))
    return one.unionByName(one.select(F.col("target").alias("source"), F.col("source").alias("target"), "relation", "weight"))


class EngramIndex:
    """Engrams and their links below a folder, kept up to date by segments of the engrams whose revision is new.

    Links lead to what came before, so a sync links only the new engrams. If an engram is new but older in time than one
    of its scope that is indexed, or the table lost rows, the index is rebuilt as a new generation.
    """

    ENGRAMS = "engram_id {id}, scope string, happened_at timestamp, terms array<string>, revision long"
    LINKS = "source {id}, target {id}, relation string, weight double"

    def __init__(self, spark, path: str, id_type: str = "bigint", **options):
        self.spark, self.store, self.options = spark, Generations(spark, path), options
        self.engram_shape, self.link_shape = self.ENGRAMS.format(id=id_type), self.LINKS.format(id=id_type)

    def state(self) -> dict:
        return {"last": -1, "engrams": 0} | self.store.state()

    def engrams(self) -> DataFrame:
        return self.store.read(self.state()["segments"], "engrams", self.engram_shape)

    def links(self) -> DataFrame:
        return self.store.read(self.state()["segments"], "links", self.link_shape)

    def edges(self) -> DataFrame:
        """The links of all segments, merged."""
        links = self.links()
        return links.groupBy("source", "target", "relation").agg(F.max("weight").alias("weight"), F.count(F.lit(1)).alias("evidence_count"))

    def sync(self, engrams: DataFrame) -> str:
        """UNCHANGED, ADDED or REBUILT."""
        state = self.state()
        rows = engrams.select("engram_id", F.col("scope").cast("string").alias("scope"), F.col("happened_at").cast("timestamp").alias("happened_at"), "terms", F.col("revision").cast("long").alias("revision"))
        new = rows.filter(F.col("revision") > state["last"])
        count = rows.count()
        arrived = new.agg(F.count(F.lit(1)).alias("n"), F.max("revision").alias("last")).first()
        if not arrived.n and count == state["engrams"]:
            return "UNCHANGED"
        newest = self.engrams().groupBy("scope").agg(F.max("happened_at").alias("_newest"))
        late = state["engrams"] > 0 and not new.join(newest, "scope").filter(F.col("happened_at") < F.col("_newest")).isEmpty()
        if late or state["engrams"] + arrived.n != count:
            name = self._segment(rows, None)
            last = rows.agg(F.max("revision")).first()[0]
            self.store.commit(state, generation=state["generation"] + 1, segments=[name], last=-1 if last is None else last, engrams=count)
            return "REBUILT"
        name = self._segment(self.engrams().unionByName(new), new) if state["engrams"] else self._segment(new, None)
        self.store.commit(state, segments=[*state["segments"], name], last=arrived.last, engrams=count)
        return "ADDED"

    def _segment(self, rows: DataFrame, new: DataFrame | None) -> str:
        name = self.store.segment()
        self.store.write(rows if new is None else new, name, "engrams")
        self.store.write(auto_links(rows, new=new, **self.options), name, "links")
        return name

    def compact(self) -> None:
        """One segment of all."""
        state = self.state()
        name = self.store.segment()
        self.store.write(self.engrams(), name, "engrams")
        self.store.write(self.links(), name, "links")
        self.store.commit(state, generation=state["generation"] + 1, segments=[name])


def explicit_links(engrams: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links that engrams(engram_id, related) name: those whose target is there, and those that wait for it."""
    named = engrams.select(F.col("engram_id").alias("source"), F.explode("related").alias("target"), F.lit(EXPLICIT).alias("relation"), F.lit(1.0).alias("weight"))
    ids = engrams.select(F.col("engram_id").alias("target"))
    return named.join(ids, "target", "left_semi"), named.join(ids, "target", "left_anti")


def upsert(edges: DataFrame, links: DataFrame) -> DataFrame:
    """edges(source, target, relation, weight, evidence_count, reinforced_at) with links(…, at) added."""
    new = links.select("source", "target", "relation", "weight", F.lit(1).cast("long").alias("evidence_count"), F.col("at").alias("reinforced_at"))
    return edges.unionByName(new).groupBy("source", "target", "relation").agg(F.max("weight").alias("weight"), F.sum("evidence_count").alias("evidence_count"), F.max("reinforced_at").alias("reinforced_at"))


def seeds(engrams: DataFrame, queries: DataFrame, *, limit: int = 12, minimum_coverage: float = 0.0) -> DataFrame:
    """query_id, engram_id, activation, coverage for queries(query_id, terms): engrams sharing terms exactly.

    Activation is min(1, 0.55 + overlap / sqrt(|query| |engram|)). Questions whose best seed covers a
    smaller share of the terms than minimum_coverage have no seeds.
    """
    asked = queries.select("query_id", F.size("terms").alias("n_query"), F.explode("terms").alias("term"))
    words = engrams.select("engram_id", F.size("terms").alias("n_engram"), F.explode("terms").alias("term"))
    hit = asked.join(words, "term").groupBy("query_id", "engram_id", "n_query", "n_engram").agg(F.count(F.lit(1)).alias("overlap"))
    hit = hit.withColumn("activation", F.least(F.lit(1.0), 0.55 + F.col("overlap") / F.sqrt(F.col("n_query") * F.col("n_engram"))))
    hit = hit.withColumn("coverage", F.max(F.col("overlap") / F.col("n_query")).over(Window.partitionBy("query_id"))).filter(F.col("coverage") >= minimum_coverage)
    order = Window.partitionBy("query_id").orderBy(F.desc("activation"), "engram_id")
    return hit.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= limit).select("query_id", "engram_id", "activation", "coverage")


def activate(start: DataFrame, edges: DataFrame, *, hops: int = 2, fanout: int = 10, max_nodes: int = 100, scope: DataFrame | None = None) -> DataFrame:
    """query_id, engram_id, activation, hop, and parent, relation and weight of the edge it was reached by, after bounded spreading.

    Every hop takes the `fanout` heaviest edges of each frontier node (counted before scope(engram_id)
    filters targets), adds activation * weight * DECAY**hop as noisy-or per target, keeps the larger of
    old and new, prunes to max_nodes and goes on from what was touched and kept. Each hop reads its
    start from a checkpoint, so a lost executor costs one hop.
    """
    state = start.select("query_id", "engram_id", "activation", F.lit(0).alias("hop"), F.lit(None).cast(start.schema["engram_id"].dataType).alias("parent"), F.lit(None).cast("string").alias("relation"), F.lit(None).cast("double").alias("weight"))
    heavy = Window.partitionBy("source").orderBy(F.desc("weight"), "target", "relation")
    fan = edges.withColumn("_n", F.row_number().over(heavy)).filter(F.col("_n") <= fanout).select("source", "target", "relation", "weight")
    if scope is not None:
        fan = fan.join(scope.select(F.col("engram_id").alias("target")), "target", "left_semi")
    frontier = state
    for hop in range(1, hops + 1):
        sent = frontier.drop("relation", "weight").join(fan, F.col("engram_id") == fan["source"]).select("query_id", F.col("target").alias("engram_id"), F.struct(F.col("source").alias("parent"), "relation", "weight").alias("edge"), (F.col("activation") * F.col("weight") * DECAY**hop).alias("c"))
        got = sent.groupBy("query_id", "engram_id").agg((1 - F.product(1 - F.col("c"))).alias("new"), F.max_by("edge", F.struct("c", -F.col("edge.parent"))).alias("via"), F.max("c").alias("best"))
        merged = state.join(got, ["query_id", "engram_id"], "full_outer")
        better = F.col("activation").isNull() | (F.col("best") > F.col("activation"))
        merged = merged.select(
            "query_id",
            "engram_id",
            F.greatest("activation", "new").alias("activation"),
            F.coalesce("hop", F.lit(hop)).alias("hop"),
            *[F.when(F.col("new").isNotNull() & better, F.col("via")[c]).otherwise(F.col(c)).alias(c) for c in ("parent", "relation", "weight")],
            F.col("new").isNotNull().alias("touched"),
        )
        order = Window.partitionBy("query_id").orderBy(F.desc(F.round("activation", 12)), "engram_id")
        merged = merged.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= max_nodes).drop("_n")
        if hop < hops:
            merged = kept(merged)
        state, frontier = merged.drop("touched"), merged.filter("touched").drop("touched")
    return state


def concept_coverage(start: DataFrame, engrams: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, single, union: of a question's cues(array), the share that its best seed has, and the share that its seeds have together."""
    cues = queries.select("query_id", F.explode(F.array_distinct("cues")).alias("term"))
    n = cues.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    words = engrams.select("engram_id", F.explode(F.array_distinct("terms")).alias("term"))
    hit = start.select("query_id", "engram_id").join(cues, "query_id").join(words, ["engram_id", "term"])
    one = hit.groupBy("query_id", "engram_id").agg(F.count(F.lit(1)).alias("own")).groupBy("query_id").agg(F.max("own").alias("own"))
    every = hit.select("query_id", "term").distinct().groupBy("query_id").agg(F.count(F.lit(1)).alias("all"))
    share = lambda c: F.coalesce(F.col(c) / F.col("n"), F.lit(0.0))
    return n.join(one, "query_id", "left").join(every, "query_id", "left").select("query_id", share("own").alias("single"), share("all").alias("union"))


def covered(start: DataFrame, coverage: DataFrame, least: float, mode: str = "single") -> DataFrame:
    """Seeds of questions whose cues are covered enough, by one seed or by all; questions without cues keep theirs."""
    if mode not in ("single", "union"):
        raise ValueError("mode is single or union")
    poor = coverage.filter(F.col(mode) < least).select("query_id")
    return start.join(poor, "query_id", "left_anti")


def recalled(state: DataFrame, engrams: DataFrame, *, limit: int = 8, hops: int = 2) -> DataFrame:
    """query_id, place, engram_id, activation, strength, path: the best by activation times 0.5 + strength, with the edges that led there.

    path is an array of (from, to, relation, weight) from a seed on; it begins later where a node on the way was pruned.
    """
    strong = state.join(engrams.select("engram_id", "strength"), "engram_id")
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round(F.col("activation") * (0.5 + F.col("strength")), 12)), "engram_id")
    best = strong.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit).select("query_id", "place", "engram_id", "activation", "strength")
    ids = state.schema["engram_id"].dataType.simpleString()
    out = best.withColumn("_at", F.col("engram_id")).withColumn("path", F.array().cast(f"array<struct<from:{ids},to:{ids},relation:string,weight:double>>"))
    steps = kept(state.filter("parent IS NOT NULL").select("query_id", F.col("engram_id").alias("_at"), "parent", "relation", "weight"))
    for _ in range(hops):
        met = out.join(steps, ["query_id", "_at"], "left")
        again = F.exists("path", lambda p: p["to"] == F.col("_at"))
        goes = F.col("parent").isNotNull() & ~again
        step = F.struct(F.col("parent").alias("from"), F.col("_at").alias("to"), "relation", "weight")
        out = met.select("query_id", "place", "engram_id", "activation", "strength", F.when(goes, F.col("parent")).alias("_at"), F.when(goes, F.concat(F.array(step), F.col("path"))).otherwise(F.col("path")).alias("path"))
    return out.drop("_at")


def view_edges(edges: DataFrame, per_source: int = 3) -> DataFrame:
    """Unordered pairs to draw: of shared-cue edges the heaviest few of each source, all of the others."""
    cue = edges.filter(F.col("relation") == SHARED)
    order = Window.partitionBy("source").orderBy(F.desc("weight"), F.desc("evidence_count"), "target")
    cue = cue.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= per_source).drop("_n")
    both = cue.unionByName(edges.filter(F.col("relation") != SHARED)).filter("source <> target")
    pair = both.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"), "weight")
    return pair.groupBy("a", "b").agg(F.max("weight").alias("weight"))


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select("a", "b", "weight").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))


def _winners(both: DataFrame, label: DataFrame) -> DataFrame:
    """node, won: the label with most weight among a node's neighbours, ties to the larger."""
    votes = both.join(label, both["b"] == label["node"]).groupBy("a", "label").agg(F.sum("weight").alias("w"))
    best = votes.groupBy("a").agg(F.max(F.struct(F.round("w", 9).alias("w"), "label")).alias("best"))
    return best.select(F.col("a").alias("node"), F.col("best.label").alias("won"))


def regions(nodes: DataFrame, links: DataFrame, *, rounds: int = 12) -> DataFrame:
    """node, label by synchronous label propagation over links(a, b, weight): the label with most weight, ties to the larger.

    Ends where nothing changes, or after `rounds`.
    """
    both = kept(_both_ways(links))
    label = nodes.select("node", F.col("node").alias("label"))
    for _ in range(rounds):
        step = kept(label.join(_winners(both, label), "node", "left").select("node", "label", F.coalesce("won", "label").alias("new")))
        label = step.select("node", F.col("new").alias("label"))
        if step.filter("new <> label").isEmpty():
            break
    return label


def merge_small(labels: DataFrame, links: DataFrame, *, largest: int = 12, rounds: int = 6) -> DataFrame:
    """node, label: nodes outside the `largest` regions join the one of these that they are most linked to, round by round.

    Regions of one size go by their smallest node; ties between votes go to the larger label.
    """
    both, label = kept(_both_ways(links)), kept(labels.select("node", "label"))
    size = label.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("first"))
    top = kept(size.orderBy(F.desc("n"), "first").limit(largest).select("label"))
    for _ in range(rounds):
        won = _winners(both, label.join(F.broadcast(top), "label", "left_semi"))
        inside = F.broadcast(top.select("label", F.lit(True).alias("inside")))
        step = label.join(inside, "label", "left").join(won, "node", "left")
        step = kept(step.select("node", "label", F.when(F.col("inside"), F.col("label")).otherwise(F.coalesce("won", "label")).alias("new")))
        label = step.select("node", F.col("new").alias("label"))
        if step.filter("new <> label").isEmpty():
            break
    return label


def region_topics(labels: DataFrame, terms: DataFrame, top: int = 3) -> DataFrame:
    """The words most particular to each region: n ln(N / df), for words seen twice there and without digits."""
    n = labels.agg(F.count(F.lit(1)).alias("all_nodes"))
    df = terms.groupBy("term").agg(F.countDistinct("node").alias("df"))
    local = terms.join(labels, "node").groupBy("label", "term").agg(F.countDistinct("node").alias("n")).filter((F.col("n") > 1) & (F.length("term") > 1) & ~F.col("term").rlike(r"\d"))
    scored = local.join(df, "term").crossJoin(n).withColumn("score", F.col("n") * F.log(F.col("all_nodes") / F.col("df")))
    order = Window.partitionBy("label").orderBy(F.desc(F.round("score", 9)), "term")
    return scored.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top).select("label", "term", "score", "place")


def view_nodes(engrams: DataFrame, turns: DataFrame, memories: DataFrame, limit: int | None = None) -> DataFrame:
    """id, kind, scope, at, role, text of engrams(engram_id, source_kind, source_id, scope, happened_at), with what they stand for.

    Each source table is joined by its own kind of engram only; an engram without its source has no text.
    """
    said = turns.select(F.lit("CONVERSATION").alias("source_kind"), F.col("turn_id").alias("source_id"), "role", F.col("content").alias("text"))
    kept_ = memories.select(F.lit("LOCAL_MEMORY").alias("source_kind"), F.col("memory_id").cast("string").alias("source_id"), F.lit("").alias("role"), F.concat("title", F.lit(": "), "content").alias("text"))
    out = engrams.filter("source_kind <> 'DEVELOPMENT_EVENT'").join(said.unionByName(kept_), ["source_kind", "source_id"], "left")
    text = F.substring(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")), 1, 160)
    out = out.select(F.col("engram_id").alias("id"), F.col("source_kind").alias("kind"), "scope", F.col("happened_at").alias("at"), F.coalesce("role", F.lit("")).alias("role"), text.alias("text"))
    return out if limit is None else out.orderBy(F.desc("at"), "id").limit(limit)


def largest_regions(labels: DataFrame, top: int = 12) -> DataFrame:
    """label, n of the regions with most nodes; of one size, that of the smallest node first."""
    return labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("_first")).orderBy(F.desc("n"), "_first").limit(top).drop("_first")
