r"""Quality rules: base counts and distribution divergence, with Spark expressions only.

A document's histogram of character classes and its histogram of common words (one bin a word, one for
all others) are held against the reference of the document's own language: the summed histograms of
all the language's documents that pass the base rules. The distance is the Jensen-Shannon distance
(base 2, 0 to 1). A document fails if one of its two distances is over its limit. A short text's
histogram is far from any reference by chance alone, so the word limit grows by WORD_NOISE over the
square root of the number of words, and documents under MIN_WORDS words are not judged by distance (they fail
the base rules). References are rows, one a language; a language is judged once its reference has
MIN_REFERENCE_WORDS words.

Repeated windows are found by a 64-bit hash of their three words.

Defined cases: null text has no words and fails the base rules; documents without a language, or of
one without a reference, are judged by the base rules alone; rows repeated are judged alike and each
feeds its reference; very long texts are counted whole; extra columns are not read; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, materialise

MIN_WORDS = 50
MIN_REFERENCE_WORDS = 1000
CHAR_LIMIT = 0.25
WORD_LIMIT = 0.15
WORD_NOISE = 1.9

#: Frequent function words of four languages; a word of several languages is one bin.
COMMON_WORDS = {
    "en": "the of and to in a is that for it as was with be by on not he from are this his at an or",
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il avec",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus",
    "es": "de la que el en y los del se las por un para con no una su al lo como más pero sus le ya",
}
#: The bin of what is in no other; no word has a space.
OTHER = " "
BINS = sorted({w for words in COMMON_WORDS.values() for w in words.split()})
#: Java regular expressions of the character classes; what is in none of them is counted together.
CHAR_CLASSES = {"lower": "[a-z]", "upper": "[A-Z]", "digit": "[0-9]", "stop": "[.,;:?'\"()\\-]", "symbol": "[!#*$%&|<>@^~_=+/\\\\{}\\[\\]`]", "space": "[\\x20\\x09-\\x0D]"}


def _count(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern + "+", ""))


def _repeats(words: Column) -> Column:
    """Words in 3-word windows found twice or more: windows sorted by hash, equal neighbours, then the union of their words."""
    n = F.size(words)
    window = lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("at"))
    windows = F.when(n >= 3, F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), window)))
    return windows


def _repeated_at(windows: Column) -> Column:
    same = lambda x, i: F.coalesce(F.get(windows, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(windows, i + 1)["h"] == x["h"], F.lit(False))
    return F.sort_array(F.transform(F.filter(windows, same), lambda x: x["at"]))


def _covered(at: Column) -> Column:
    step = F.transform(at, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - p, F.lit(3))))
    return F.coalesce(F.aggregate(step, F.lit(0), lambda a, x: a + x), F.lit(0))


def counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, the base counts, base_failed, chars and common (histograms) of docs(doc_id, text, lang)."""
    df = docs.select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text"))
    df = df.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), 0))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD))
    df = df.select("*", _repeats(F.col("words")).alias("windows"), lines.alias("lines"), F.filter(F.transform("words", F.lower), lambda w: w.isin(BINS)).alias("known"))
    df = df.withColumn("at", _repeated_at(F.col("windows")))
    n_words = F.size("words").cast("long")
    classes = [_count(F.col("text"), p).cast("double") for p in CHAR_CLASSES.values()]
    distinct = F.array_distinct("known")
    often = F.transform(distinct, lambda w: (F.size("known") - F.size(F.array_remove("known", w))).cast("double"))
    df = df.select(
        "doc_id",
        "lang",
        n_words.alias("n_words"),
        F.length("text").cast("double").alias("n_chars"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _covered(F.col("at")).cast("long").alias("n_repeat_words"),
        F.array(*classes).alias("chars"),
        F.struct(distinct.alias("words"), often.alias("often")).alias("common"),
        F.size("known").cast("double").alias("n_known"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    summed = F.aggregate("chars", F.lit(0.0), lambda a, x: a + x)
    names = F.array(*[F.lit(x) for x in (*CHAR_CLASSES, OTHER)])
    chars = F.map_from_arrays(names, F.concat("chars", F.array(F.greatest(F.lit(0.0), F.col("n_chars") - summed))))
    common = F.map_from_arrays(F.concat("common.words", F.array(F.lit(OTHER))), F.concat("common.often", F.array(F.col("n_words") - F.col("n_known"))))
    return df.withColumn("chars", chars).withColumn("common", common).withColumn("base_failed", failed).drop("n_chars", "n_known")


def references(stats: DataFrame) -> DataFrame:
    """lang, ref_chars, ref_common: summed histograms of each language with enough words, as shares by bin."""
    good = stats.filter("NOT base_failed AND lang IS NOT NULL")
    entries = lambda name: F.transform(F.map_entries(name), lambda e: F.struct(F.lit(name).alias("hist"), e["key"].alias("bin"), e["value"].alias("x")))
    sums = good.select("lang", F.inline(F.concat(entries("chars"), entries("common")))).groupBy("lang", "hist", "bin").agg(F.sum("x").alias("x"))
    grouped = sums.groupBy("lang").agg(*[F.collect_list(F.when(F.col("hist") == k, F.struct("bin", "x"))).alias(k) for k in ("chars", "common")])
    total = lambda entries: F.aggregate(entries, F.lit(0.0), lambda a, e: a + e["x"])
    shares = lambda k: F.map_from_entries(F.transform(k, lambda e: F.struct(e["bin"], (e["x"] / total(F.col(k)))))).alias(f"ref_{k}")
    return grouped.filter(total(F.col("common")) >= MIN_REFERENCE_WORDS).select("lang", shares("chars"), shares("common"))


def js_distance(hist: Column, reference: Column) -> Column:
    """Jensen-Shannon distance of a histogram (counts by bin) and shares by bin; 1 for an empty histogram.

    Bins that the histogram lacks add their share each, so only its own bins are visited.
    """
    part = lambda a, b: F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)
    mass = F.aggregate(F.map_values(hist), F.lit(0.0), lambda a, x: a + x)
    both = lambda m: F.transform(F.map_entries(hist), lambda e: F.struct((e["value"] / m).alias("p"), F.coalesce(F.try_element_at(reference, e["key"]), F.lit(0.0)).alias("q")))
    twice = lambda m: F.aggregate(both(m), F.lit(1.0), lambda a, e: a + part(e["p"], e["q"]) + part(e["q"], e["p"]) - e["q"])
    return F.transform(F.array(mass), lambda m: F.when(m > 0, F.sqrt(F.greatest(F.lit(0.0), twice(m) / 2))).otherwise(1.0))[0]


def judge(docs: DataFrame, char_limit: float = CHAR_LIMIT, word_limit: float = WORD_LIMIT, word_noise: float = WORD_NOISE) -> DataFrame:
    """The base counts, base_failed, kept, and char_distance and word_distance to the language's reference (null without one)."""
    stats = materialise(counts(docs), "rule_counts")
    refs = materialise(references(stats), "references")  # one row a language; joined, at any number of them
    out = stats.join(refs, "lang", "left")
    out = out.withColumn("char_distance", F.when(F.col("ref_chars").isNotNull() & ~F.col("base_failed"), js_distance(F.col("chars"), F.col("ref_chars"))))
    out = out.withColumn("word_distance", F.when(F.col("ref_chars").isNotNull() & ~F.col("base_failed"), js_distance(F.col("common"), F.col("ref_common"))))
    far = (F.col("char_distance") > char_limit) | (F.col("word_distance") > word_limit + word_noise / F.sqrt("n_words"))
    return out.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & ~F.coalesce(far, F.lit(False))).alias("kept"),
        "char_distance",
        "word_distance",
    )


def op7_quality_rules(spark, sf_dir):
    from .common import table

    return judge(table(spark, sf_dir, "documents")).drop("char_distance", "word_distance")
