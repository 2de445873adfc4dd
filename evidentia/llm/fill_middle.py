r"""Fill-in-middle transformation, in Spark SQL expressions only.

A text is cut into units ([A-Za-z]+ or one other code point). Four numbers from the hex sha256 of seed and
doc_id give the two cuts, whether the text is rearranged, and how: psm is <P>prefix<S>suffix<M>middle and spm
<S>suffix<P>prefix<M>middle. Texts that are empty or already hold a mark stay plain, so that the marks of an
output are its own: a mark starts with < and ends with > and holds neither inside, so pieces side by side with
marks make no new one, and the output split at its marks gives the pieces back.

Defined cases: null text counts as empty and is plain with n = 0; a null id is hashed as an empty one; repeated
rows come out alike; very long texts are cut whole; extra columns are kept by arranged, whatever their names, and
not read; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, text_or_empty

UNIT = "[A-Za-z]+|[^A-Za-z]"
#: Marks of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
ANY_MARK = "<[PSM]>"
#: Of 100 texts, so many are rearranged, and of 100 of these so many with the suffix first.
RATE, SUFFIX_FIRST = 90, 20


def numbers(doc_id: Column, seed: str = "1") -> Column:
    """The first four 8-digit groups of the seeded sha256, as an array of longs."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)])


def arranged(docs: DataFrame, seed: str = "1", rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """docs(doc_id, text) with fim: struct(n, form, prefix_chars, middle_chars, output)."""
    whole, cut, part, name = fresh(docs, "_whole", "_cut", "_part", "fim")
    text = text_or_empty(docs)
    h = numbers(F.col("doc_id"), seed)
    units = F.regexp_extract_all(text, F.lit(UNIT), F.lit(0))
    # inline pins what is computed once for a row, so no later expression repeats it
    once = docs.select("*", F.explode(F.array(F.struct(text.alias("text"), units.alias("units"), h.alias("h")))).alias(whole))
    w = F.col(whole)
    n = F.size(w["units"])
    at = lambda i: F.pmod(w["h"][i], (n + 1).cast("long")).cast("int")
    plain = (w["text"] == "") | w["text"].rlike(ANY_MARK) | (w["h"][2] % 100 >= rate)
    form = F.when(plain, "plain").when(w["h"][3] % 100 < suffix_first, "spm").otherwise("psm")
    cuts = once.select("*", F.explode(F.array(F.struct(n.alias("n"), form.alias("form"), F.least(at(0), at(1)).alias("a"), F.greatest(at(0), at(1)).alias("b")))).alias(cut))
    c = F.col(cut)
    piece = lambda start, end: F.array_join(F.slice(w["units"], start + F.lit(1), end - start), "")
    pieces = F.struct(piece(F.lit(0), c["a"]).alias("prefix"), piece(c["a"], c["b"]).alias("middle"), piece(c["b"], c["n"]).alias("suffix"))
    moved = F.when(c["form"] != "plain", pieces)
    made = cuts.select("*", F.explode(F.array(moved)).alias(part))
    p = F.col(part)
    output = (
        F.when(c["form"] == "psm", F.concat(F.lit(PREFIX), p["prefix"], F.lit(SUFFIX), p["suffix"], F.lit(MIDDLE), p["middle"]))
        .when(c["form"] == "spm", F.concat(F.lit(SUFFIX), p["suffix"], F.lit(PREFIX), p["prefix"], F.lit(MIDDLE), p["middle"]))
        .otherwise(w["text"])
    )
    result = F.struct(c["n"].cast("long").alias("n"), c["form"].alias("form"), F.length(p["prefix"]).cast("long").alias("prefix_chars"), F.length(p["middle"]).cast("long").alias("middle_chars"), output.alias("output"))
    return made.select(*[F.col(f"`{x}`") for x in docs.columns], result.alias(name))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from, read from the output and its form."""
    pieces = F.split(output, ANY_MARK)
    return (
        F.when(form == "psm", F.concat(pieces[1], pieces[3], pieces[2]))
        .when(form == "spm", F.concat(pieces[2], pieces[3], pieces[1]))
        .otherwise(output)
    )


def op13_fill_middle(spark, sf_dir):
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = arranged(docs).select("doc_id", F.explode(F.array("fim")).alias("fim")).select("doc_id", "fim.*")
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS x,
         regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units FROM documents),
h AS (
  SELECT doc_id, text, units, len(units) AS n, ('0x' || x[1:8])::BIGINT AS h1, ('0x' || x[9:16])::BIGINT AS h2,
         ('0x' || x[17:24])::BIGINT AS h3, ('0x' || x[25:32])::BIGINT AS h4 FROM t),
c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM h),
p AS (
  SELECT doc_id, n, form, text, CASE WHEN form <> 'plain' THEN array_to_string(units[1:a], '') END AS prefix,
    CASE WHEN form <> 'plain' THEN array_to_string(units[a + 1:b], '') END AS middle,
    CASE WHEN form <> 'plain' THEN array_to_string(units[b + 1:], '') END AS suffix FROM c),
o AS (
  SELECT *, CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                      WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE text END AS output FROM p),
r AS (SELECT *, string_split_regex(output, '<[PSM]>') AS q FROM o)
SELECT doc_id, n, form, length(prefix) AS prefix_chars, length(middle) AS middle_chars, sha256(output) AS output_sha256,
  sha256(CASE form WHEN 'psm' THEN q[2] || q[4] || q[3] WHEN 'spm' THEN q[3] || q[4] || q[2] ELSE output END) AS restored_sha256
FROM r
"""
