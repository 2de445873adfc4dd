"""Line deduplication over a whole corpus.

Lines are exploded once and normalised (ASCII white space off both ends, A-Z lower-cased). Of each key of at
least SHORTEST code points only (document, place, 128-bit hash) is kept, in a scratch table. Documents are
counted per hash after partial sums; hashes of at least OFTEN documents meet the lines again, and every
document gets the places of the lines that it loses. The text itself is shuffled once, to meet these places, and
the rest of its lines is put together in order from the stretches between them.

A hash with more than 1/HOT of all lines would meet in one task. There are fewer than HOT of these, so they
are sent to all tasks, whatever the size of the corpus; all other hashes are joined by shuffle.

Defined cases: null text is one empty line, as empty text is; rows that share a doc_id are one document in
the count and each is returned with its own lines; rows without an id are together one document, which is never
the largest; a line that a document repeats counts once and goes or stays as a whole; very long texts are
handled whole, in time in proportion to their lines; extra columns are not read by dedup and kept by
cleaned, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialise, temporary, text_or_empty

SHORTEST = 40
OFTEN = 5
#: Hashes with more than this part of all lines are joined by broadcast: fewer than HOT rows.
HOT = 1000

#: The white space that is stripped, and the letters that are lower-cased.
BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A-Z lower-cased and other letters as they are."""
    bare = F.btrim(line, F.lit(BLANKS))
    plain = F.octet_length(bare) == F.length(bare)  # lower() is that rule where every character is ASCII
    return F.when(plain, F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def marks(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """doc_id, text_key, place, hash of every line whose key is long enough; text_key tells rows of one id apart."""
    text = text_or_empty(docs)
    rows = docs.select("doc_id", F.unhex(F.md5(text)).alias("text_key"), F.posexplode(lines(text)).alias("place", "line"))
    rows = rows.select("doc_id", "text_key", "place", line_key(F.col("line")).alias("key")).filter(F.length("key") >= shortest)
    return rows.select("doc_id", "text_key", "place", F.unhex(F.md5("key")).alias("hash"))


def frequent(found: DataFrame, often: int = OFTEN) -> DataFrame:
    """hash, last (the largest doc_id with it) and n_lines of hashes found in enough documents."""
    once = found.groupBy("hash", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    counted = once.groupBy("hash").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last"), F.sum("n").alias("n_lines"))
    return counted.filter(F.col("n_docs") >= often).drop("n_docs")


def lost_lines(found: DataFrame, often: int = OFTEN) -> DataFrame:
    """doc_id, text_key, places: for every text that loses lines, where they stand, in order."""
    known = materialise(frequent(found, often), "frequent")
    total = found.count()
    hot = F.col("n_lines") * HOT > total
    goes = (F.col("doc_id") < F.col("last")) | F.col("doc_id").isNull()
    few = F.broadcast(known.filter(hot).select("hash", "last"))  # under HOT rows: each has over 1/HOT of all lines
    many = known.filter(~hot).select("hash", "last")
    # neither list holds the other's hashes, so the lines of hot hashes are dealt to no shuffle of theirs
    rest = found.join(few.select("hash"), "hash", "left_anti").hint("shuffle_hash")
    gone = found.join(few, "hash").filter(goes).drop("last").unionByName(rest.join(many, "hash").filter(goes).drop("last"))
    return gone.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set("place")).alias("places"))


def without(all_lines: Column, places: Column) -> Column:
    """The lines but for those at places (from 0, in order), joined again: stretches between places, in linear time."""
    starts = F.concat(F.array(F.lit(-1)), places)
    ends = F.concat(places, F.array(F.size(all_lines)))
    stretch = F.zip_with(starts, ends, lambda a, b: F.slice(all_lines, a + F.lit(2), b - a - F.lit(1)))
    return F.array_join(F.flatten(stretch), "\n")


def dedup(docs: DataFrame, shortest: int = SHORTEST, often: int = OFTEN) -> DataFrame:
    """doc_id, n_lines, n_dropped and text without the lines that many documents share, for every row of docs(doc_id, text)."""
    return _dedup(docs.select("doc_id", text_or_empty(docs).alias("text")), shortest, often).select(
        "doc_id", F.col("_n").cast("long").alias("n_lines"), F.col("_lost").cast("long").alias("n_dropped"), F.col("_left").alias("text")
    )


def cleaned(docs: DataFrame, shortest: int = SHORTEST, often: int = OFTEN) -> DataFrame:
    """docs with its columns and shared lines gone from text; a null text stays null."""
    n, lost, left = fresh(docs, "_n", "_lost", "_left")
    out = _dedup(docs, shortest, often, (n, lost, left))
    text = F.when(F.col("text").isNotNull(), F.col(left)).alias("text")
    return out.select(*[text if c == "text" else F.col(f"`{c}`") for c in docs.columns])


def _dedup(docs: DataFrame, shortest: int, often: int, names=("_n", "_lost", "_left")) -> DataFrame:
    spark = docs.sparkSession
    with temporary(spark) as keep:
        found = materialise(marks(docs, shortest), "marks")
        lost = materialise(lost_lines(found, often), "lost")
        keep(lost)
    own_id, own_key, places = fresh(docs, "_id", "_key", "_places")
    lost = lost.toDF(own_id, own_key, places)
    text = text_or_empty(docs)
    met = docs.join(lost.hint("shuffle_hash"), docs["doc_id"].eqNullSafe(lost[own_id]) & (F.unhex(F.md5(text)) == lost[own_key]), "left")
    n, gone, left = names
    whole = F.coalesce(F.col("text"), F.lit(""))
    out = met.withColumn(n, F.size(lines(whole))).withColumn(gone, F.coalesce(F.size(places), F.lit(0)))
    return out.withColumn(left, F.when(F.col(places).isNull(), whole).otherwise(without(lines(whole), F.col(places)))).drop(own_id, own_key, places)


def op12_line_dedup(spark, sf_dir):
    from .common import table

    found = dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = r"""
WITH l AS (
  SELECT d.doc_id, row_no, u.place, u.line,
         translate(trim(u.line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, row_number() OVER () AS row_no, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents) d,
       LATERAL (SELECT unnest(ls) AS line, generate_subscripts(ls, 1) AS place) u),
k AS (
  SELECT key, max(doc_id) AS last FROM l WHERE length(key) >= 40 GROUP BY key
  HAVING count(DISTINCT doc_id) + max(CASE WHEN doc_id IS NULL THEN 1 ELSE 0 END) >= 5),
m AS (SELECT l.*, k.key IS NOT NULL AND (l.doc_id IS NULL OR l.doc_id <> k.last) AS gone FROM l LEFT JOIN k USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY row_no, doc_id
"""
