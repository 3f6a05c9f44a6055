"""Line dedup (operator 7), DataFrame functions only.

Lines are exploded, normalised and hashed; one aggregation per hash finds the
smallest and the largest document that holds it (more than one document: they
differ), combining before the shuffle, so that a line that most documents
share costs a task one row per partition. Repeats are stored before the join
with all lines, so adaptive execution can split a line that many documents
share. Hashes of lines to drop go back to
their documents by position, where the text is put together again from the
lines that stay, in order. Texts are moved at most once, exploded lines never.

A line is known by 96 bits (xxhash64 and murmur3 of its key).

Cases: a null or empty text is one empty line; documents are told apart by
id, so a row that is repeated with its id counts as one document, and rows
with a null id take no part and keep all lines; equal lines of one document
stay or go together (ties: the smallest id keeps them); lines of any length are
hashed whole, and a very long text is one row throughout; an empty table gives no
rows; other columns are kept by ``dedup_lines``, but for those with the names of
its results, which take their place (names starting with two underscores are
reserved).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickwise.llm.common import UPPER, ascii_lower, read, strip_blanks, without, written

LEAST = 10  # code points that a key needs
DOCUMENTS = 2  # a key in so many documents is a repeat


def dedup_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least: int = LEAST, documents: int = DOCUMENTS) -> DataFrame:
    """``docs`` with ``n_lines``, ``n_dropped`` and ``kept`` (the text after).

    least: code points that a key needs; documents: distinct documents from
    which on a key is a repeat."""
    docs = without(docs, ("n_lines", "n_dropped", "kept"), id_column, text_column)
    lines = F.split(F.coalesce(F.col(text_column), F.lit("")), "\n", -1)
    fingerprint = F.xxhash64(text_column)  # tells apart different rows of one id
    keyed = (docs.where(F.col(id_column).isNotNull()).select(F.col(id_column).alias("__id"), fingerprint.alias("__print"), F.posexplode(lines).alias("__pos", "__line"))
             .withColumn("__line", strip_blanks(F.col("__line"))).where(F.length("__line") >= least)
             .withColumn("__line", ascii_lower(F.col("__line"))))
    long = written(keyed.select("__id", "__print", "__pos", F.struct(F.xxhash64("__line").alias("x"), F.hash("__line").alias("m")).alias("__h")), "lines")  # both sides of the join below read it
    if documents == 2:
        repeats = long.groupBy("__h").agg(F.min("__id").alias("__first"), F.max("__id").alias("__last")).where(F.col("__first") < F.col("__last"))
    else:
        repeats = (long.groupBy("__h", "__id").agg(F.lit(1).alias("__one")).groupBy("__h")
                   .agg(F.min("__id").alias("__first"), F.sum("__one").alias("__n")).where(F.col("__n") >= documents))
    repeats = written(repeats.select("__h", "__first"), "repeats")
    found = long.join(repeats, "__h").where(F.col("__id") > F.col("__first")).select("__id", "__print", "__pos")
    # One flag a line, in order, of documents that lose some; a set, as rows may be repeated.
    gone = found.groupBy("__id", "__print").agg(F.sort_array(F.collect_set("__pos")).alias("__gone"))
    joined = (docs.withColumn("__lines", lines).withColumn("__p", fingerprint)  # below the join: split once a row
              .join(gone, (docs[id_column] == gone["__id"]) & (F.col("__p") == gone["__print"]), "left"))
    kept = F.when(F.col("__gone").isNull(), F.col("__lines")).otherwise(_without(F.col("__lines"), F.col("__gone")))
    return joined.select(*[docs[c] for c in docs.columns], F.size("__lines").cast("long").alias("n_lines"),
                         F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_dropped"), F.array_join(kept, "\n").alias("kept"))


def _without(lines: Column, gone: Column) -> Column:
    """``lines`` less those at the ascending positions ``gone``, in one pass:
    the pieces between two dropped lines are slices."""
    ends = F.concat(gone, F.array(F.size(lines)))
    starts = F.concat(F.array(F.lit(0)), F.transform(gone, lambda p: p + 1))
    return F.flatten(F.zip_with(starts, ends, lambda a, b: F.slice(lines, a + 1, b - a)))


def op7_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


_STRIP = r"chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP7_SQL = f"""
WITH lines AS (
  SELECT doc_id, rid, pos, line,
         translate(trim(line, {_STRIP}), '{UPPER}', '{UPPER.lower()}') AS key
  FROM (SELECT doc_id, rid, unnest(ls) AS line, unnest(range(len(ls))) AS pos
        FROM (SELECT doc_id, row_number() OVER () AS rid, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
repeats AS (
  SELECT key, min(doc_id) AS first FROM lines WHERE length(key) >= {LEAST} AND doc_id IS NOT NULL
  GROUP BY key HAVING count(DISTINCT doc_id) >= {DOCUMENTS}),
marked AS (
  SELECT l.*, coalesce(l.doc_id > r.first, false) AS gone FROM lines l LEFT JOIN repeats r ON l.key = r.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id, rid
"""
