"""Substring dedup over sliding sentence spans (operator 8).

A text is cut into sentences (up to and with ``. ! ?`` or a line end and the
blanks after it; nothing is lost between them). Every run of several
consecutive sentences is hashed - two sentences of 20 words or more together,
three of 10 or more - and, so that a single very long sentence is covered
too, each sentence of 50 words or more. Where sentences are shorter than that,
a run grows until it holds 20 words, however many sentences it takes: the
shortest one from each sentence and the shortest one up to each. So every
sentence of a repeated passage of two sentences and 20 words or more lies in
a run of that passage. One aggregation per hash finds the
first document of a run, combining before the shuffle; runs that occur once
end there. All other occurrences go back to their documents, and the
sentences that any of them covers are removed.

The few runs with the most occurrences (at most ``HOT_RUNS``, whatever the
corpus) meet their first document by a broadcast of those runs; the others by
a shuffle in which no key has more than a ``HOT_RUNS``-th of all rows. Later
places of a run within its text are told where the runs are made.

"First" is the occurrence in the smallest document id, at the smallest
position; if runs of one document overlap, each is held against its own first
place, so a sentence of a first place goes if another run that covers it came
before. Sentences compare by their key: blanks at both ends off, inner
blanks as one space, A-Z lower-cased. A run is known by 96 bits.

Cases: null and empty texts have no sentences and stay as they are (kept text
empty); documents are told apart by id, a row repeated with its id counts
once and all its copies are treated alike; rows with a null id take no part
and keep all; a run repeated inside one document keeps its first place, but for
sentences that its other places cover; an
empty table gives no rows; other columns are kept by ``dedup_spans``, but for
those with the names of its results, which take their place (names starting with
two underscores are reserved).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tickwise.llm.common import UPPER, ascii_lower, mix64, read, ship, strip_blanks, without, written

#: (sentences, words at least) of the runs that count.
RUNS = ((1, 50), (2, 20), (3, 10))
_B = r"[\x20\x09-\x0D]"
#: Words that a run of any number of sentences grows to, from and up to each sentence.
GROWN = 20
SENTENCES = 250_000  # whose runs are made at a time
HOT_RUNS = 8192  # runs broadcast at most: those with more than such a share of all rows
_MORE = np.uint64(0x9E3779B97F4A7C15)
#: One sentence; the same in Java, Python and RE2. Together the matches are the whole text.
SENTENCE = rf"[^.!?\n]+[.!?\n]*{_B}*|[.!?\n]+{_B}*"


def _shortest(total: np.ndarray, lo: np.ndarray, hi: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, sentences) of the shortest runs of two sentences and ``words``
    words or more from each sentence and up to each sentence; ``total`` counts
    the words before each sentence, lo and hi bound the text around it."""
    at = np.arange(len(lo))
    end = np.maximum(np.searchsorted(total, total[at] + words), at + 2)
    start = np.minimum(np.searchsorted(total, total[at + 1] - words, "right") - 1, at - 1)
    on, up = end <= hi, start >= lo
    again = np.zeros(len(at), bool)
    again[up] = end[start[up]] == at[up] + 1  # the same run, from its start
    up &= ~again
    return np.concatenate([at[on], start[up]]), np.concatenate([(end - at)[on], (at + 1 - start)[up]])


def _hashed(x: np.ndarray, m: np.ndarray, start: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64 and 32 bits of each run, from those of its sentences."""
    a, b = mix64(k.astype(np.uint64)), mix64(~k.astype(np.uint64))
    for j in range(int(k.max(initial=0))):
        on = np.flatnonzero(k > j)
        a[on] = mix64(a[on] * _MORE + x[start[on] + j])
        b[on] = mix64(b[on] * _MORE + m[start[on] + j])
    return a.view(np.int64), (b >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _runs(runs, grown: int | None):
    """Texts as arrays of (x, m, w) -> their runs (pos, k, x, m; again: the
    text holds the run at an earlier place)."""
    def of(piece: pa.RecordBatch) -> pa.RecordBatch:
        keys = piece.column("__keys")
        each = keys.flatten()
        x, m, w = (each.field(c).to_numpy() for c in ("x", "m", "w"))
        n = pc.list_value_length(keys).to_numpy()
        text, hi = np.repeat(np.arange(len(n)), n), np.repeat(np.cumsum(n), n)
        lo, at = hi - np.repeat(n, n), np.arange(len(hi))
        total = np.concatenate([[0], np.cumsum(w, dtype=np.int64)])
        starts, sizes = [], []
        for k, words in runs:
            own = at[at + k <= hi]
            own = own[total[own + k] - total[own] >= words]
            starts.append(own)
            sizes.append(np.full(len(own), k))
        if grown is not None:
            own, size = _shortest(total, lo, hi, grown)
            new = ~np.isin(size, [k for k, words in runs if words <= grown])  # the others are there already
            starts.append(own[new])
            sizes.append(size[new])
        start, size = np.concatenate(starts), np.concatenate(sizes)
        one, two = _hashed(x.view(np.uint64), m.view(np.uint32).astype(np.uint64), start, size)
        whose = pa.array(text[start])
        mixed = one.view(np.uint64) ^ mix64(text[start].astype(np.uint64) + _MORE)
        order = np.lexsort((start, mixed))
        again = np.zeros(len(start), bool)
        again[order[1:]] = (mixed[order[1:]] == mixed[order[:-1]]) & (two[order[1:]] == two[order[:-1]])
        return pa.RecordBatch.from_pydict({"__id": piece.column("__id").take(whose), "__print": piece.column("__print").take(whose),
                                           "__pos": pa.array((start - lo[start]).astype(np.int32)), "__k": pa.array(size.astype(np.int32)), "__again": pa.array(again), "__x": pa.array(one), "__m": pa.array(two)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(pc.list_value_length(batch.column("__keys")).to_numpy())
            start = 0
            while start < len(ends):
                stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + SENTENCES, "right")))
                yield of(batch.slice(start, stop - start))
                start = stop
    return run


def _cut(id_column: str, text_column: str, schema: pa.Schema):
    pattern = re.compile(SENTENCE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, n, dropped, spans = [], [], [], []
            for text, gone in zip(batch.column(text_column).to_pylist(), batch.column("__gone").to_pylist()):
                if gone is None:
                    kept.append(text or "")
                    n.append(len(pattern.findall(text or "")))
                    dropped.append(0)
                    spans.append("")
                    continue
                gone, parts, out = set(gone), [], []
                count = 0
                for i, m in enumerate(pattern.finditer(text)):
                    count += 1
                    if i not in gone:
                        parts.append(m.group())
                    elif out and out[-1][1] == m.start():
                        out[-1][1] = m.end()
                    else:
                        out.append([m.start(), m.end()])
                kept.append("".join(parts))
                n.append(count)
                dropped.append(len(gone))
                spans.append(",".join(f"{a}:{b}" for a, b in out))
            own = [c for c in batch.schema.names if c != "__gone"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).cast(f.type) for c, f in zip(own, schema)), pa.array(n, pa.int64()), pa.array(dropped, pa.int64()),
                 pa.array(spans, pa.string()), pa.array(kept, pa.string())], schema=schema)
    return run


def dedup_spans(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", runs=RUNS, grown: int | None = None) -> DataFrame:
    """``docs`` with ``n_sentences``, ``n_removed``, ``removed`` ("start:end"
    in code points, comma-joined) and ``kept`` (the text after). ``grown``:
    words of the runs of any number of sentences; without it, ``runs`` alone count."""
    ship(docs.sparkSession)
    docs = without(docs, ("n_sentences", "n_removed", "removed", "kept"), id_column, text_column)
    fingerprint = F.xxhash64(text_column)
    texts = docs.where(F.col(id_column).isNotNull() & F.col(text_column).isNotNull())
    # The keys of a document's sentences, in order, computed row by row (no shuffle).
    keyed = texts.select(F.col(id_column).alias("__id"), fingerprint.alias("__print"),
                         _keyed(F.regexp_extract_all(text_column, F.lit(SENTENCE), F.lit(0))).alias("__keys"))
    made = T.StructType([T.StructField("__id", keyed.schema["__id"].dataType),
                         *T.StructType.fromDDL("__print long, __pos int, __k int, __again boolean, __x long, __m int")])
    spread = written(keyed.mapInArrow(_runs(runs, grown), made), "runs")
    # Only ids with several texts need the print to tell rows apart.
    prints = docs.where(F.col(id_column).isNotNull()).select(F.col(id_column).alias("__id"), fingerprint.alias("__print"))
    several = written(prints.groupBy("__id").agg(F.min("__print").alias("lo"), F.max("__print").alias("hi")).where("lo < hi")
                      .select("__id", F.lit(True).alias("__several")), "several")
    covered = _repeats(spread.join(several, "__id", "left").withColumn("__print", F.when(F.col("__several"), F.col("__print"))))
    gone = (covered.select("__id", "__print", F.explode(F.sequence("__pos", F.col("__pos") + F.col("__k") - 1)).alias("__pos"))
            .groupBy("__id", "__print").agg(F.collect_set("__pos").alias("__gone")))
    told = several.withColumnRenamed("__id", "__sid")
    own = docs.join(told, docs[id_column] == told["__sid"], "left").withColumn("__p", F.when(F.col("__several"), fingerprint)).drop("__sid", "__several")
    joined = (own.join(gone, (own[id_column] == gone["__id"]) & F.col("__p").eqNullSafe(gone["__print"]), "left")
              .select(*[own[c] for c in docs.columns], "__gone"))
    schema = T.StructType([*docs.schema, T.StructField("n_sentences", T.LongType()), T.StructField("n_removed", T.LongType()),
                           T.StructField("removed", T.StringType()), T.StructField("kept", T.StringType())])
    return joined.mapInArrow(_cut(id_column, text_column, to_arrow_schema(schema)), schema)


def _repeats(spread: DataFrame) -> DataFrame:
    """(id, print, pos, k) of the runs that are not the first of their kind."""
    size = F.col("__mk").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("__k")
    bits = F.shiftleft(F.col("__m").cast("long"), 32).bitwiseOR(F.col("__k").cast("long"))
    # A run's length is part of its key, so it needs no column of its own.
    once = spread.where(~F.col("__again")).select("__id", "__print", "__pos", "__x", bits.alias("__mk"))
    total = once.count()
    repeats = written(once.groupBy("__x", "__mk").agg(F.min("__id").alias("__first"), F.count("*").alias("__n")).where(F.col("__n") > 1), "repeats")
    hot = F.broadcast(repeats.where(F.col("__n") > -(-total // HOT_RUNS)).select("__x", "__mk", "__first"))  # fewer than HOT_RUNS rows
    cold = repeats.where(F.col("__n") <= -(-total // HOT_RUNS)).select("__x", "__mk", "__first").hint("merge")  # grows with the corpus: never broadcast
    later = [once.join(hot, ["__x", "__mk"]), once.join(hot, ["__x", "__mk"], "left_anti").join(cold, ["__x", "__mk"])]
    out = [found.where(F.col("__id") > F.col("__first")).select("__id", "__print", "__pos", size) for found in later]
    out.append(spread.where("__again").select("__id", "__print", "__pos", "__k"))
    # Texts that share an id are one document: the first place is the earliest of all.
    start = F.min("__pos").over(Window.partitionBy("__id", "__x", "__mk"))
    beside = once.where(F.col("__print").isNotNull()).withColumn("__start", start).where(F.col("__pos") > F.col("__start"))
    return reduce(DataFrame.unionAll, [*out, beside.select("__id", "__print", "__pos", size)])


def _keyed(sentences: Column) -> Column:
    """(x, m, w) of each sentence: hashes of its key, and its words. One step a
    ``transform``, as a lambda computes an expression anew wherever it stands."""
    keys = F.transform(F.transform(sentences, strip_blanks), ascii_lower)

    def evened(key: Column) -> Column:  # the regular expression only where it has work
        uneven = F.contains(key, F.lit("  "))
        for blank in "\t\n\x0b\x0c\r":
            uneven = uneven | F.contains(key, F.lit(blank))
        return F.when(uneven, F.regexp_replace(key, f"{_B}+", " ")).otherwise(key)

    def hashed(key: Column) -> Column:
        words = F.octet_length(key) - F.octet_length(F.replace(key, F.lit(" "), F.lit(""))) + F.when(key == "", 0).otherwise(1)
        return F.struct(F.xxhash64(key).alias("x"), F.hash(key).alias("m"), words.alias("w"))
    return F.transform(F.transform(keys, evened), hashed)


def op8_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_spans(docs, grown=GROWN).select("doc_id", "n_sentences", "n_removed", F.sha2("kept", 256).alias("kept_sha256"), F.col("kept").alias("text"))


def _op8_sql() -> str:
    strip = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    pattern = SENTENCE.replace("'", "''")
    each = " UNION ALL ".join(
        f"SELECT doc_id, rid, pos, {k} AS k, keys[pos:pos + {k - 1}] AS run FROM (SELECT doc_id, rid, keys, ws, unnest(range(1, len(keys) - {k} + 2)) AS pos FROM keyed) "
        f"WHERE list_sum(ws[pos:pos + {k - 1}]) >= {words}" for k, words in RUNS)
    return f"""
WITH cut AS (
  SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(coalesce(text, ''), '{pattern}') AS parts FROM documents),
parts AS (
  SELECT doc_id, rid, pos, part, regexp_replace(translate(trim(part, {strip}), '{UPPER}', '{UPPER.lower()}'), '{_B}+', ' ', 'g') AS key
  FROM (SELECT doc_id, rid, unnest(parts) AS part, unnest(range(1, len(parts) + 1)) AS pos FROM cut)),
keyed AS (
  SELECT doc_id, rid, list(key ORDER BY pos) AS keys,
         list(CASE WHEN key = '' THEN 0 ELSE length(key) - length(replace(key, ' ', '')) + 1 END ORDER BY pos) AS ws
  FROM parts WHERE doc_id IS NOT NULL GROUP BY doc_id, rid),
cums AS (
  SELECT rid, pos, w, sum(w) OVER (PARTITION BY rid ORDER BY pos) AS upto, count(*) OVER (PARTITION BY rid) AS n
  FROM (SELECT rid, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS pos FROM keyed)),
ends AS (SELECT rid, upto, min(pos) AS pos FROM cums GROUP BY rid, upto),
starts AS (SELECT rid, upto - w AS before, max(pos) AS pos FROM cums GROUP BY rid, upto - w),
grown AS (
  SELECT c.rid, c.pos, greatest(e.pos, c.pos + 1) - c.pos + 1 AS k FROM cums c ASOF JOIN ends e ON c.rid = e.rid AND c.upto - c.w + {GROWN} <= e.upto
  WHERE greatest(e.pos, c.pos + 1) <= c.n
  UNION SELECT c.rid, least(s.pos, c.pos - 1), c.pos - least(s.pos, c.pos - 1) + 1 FROM cums c ASOF JOIN starts s ON c.rid = s.rid AND c.upto - {GROWN} >= s.before
  WHERE c.pos > 1),
runs AS (
  {each}
  UNION ALL SELECT doc_id, rid, pos, k, keys[pos:pos + k - 1] FROM grown JOIN keyed USING (rid) WHERE k NOT IN ({", ".join(str(k) for k, words in RUNS if words <= GROWN)})),
firsts AS (SELECT run, min(doc_id) AS first FROM runs GROUP BY run HAVING count(*) > 1),
again AS (
  SELECT rid, pos, k FROM (
    SELECT r.*, f.first, min(pos) OVER (PARTITION BY r.doc_id, r.run) AS start FROM runs r JOIN firsts f ON r.run = f.run)
  WHERE doc_id > first OR pos > start),
gone AS (SELECT DISTINCT rid, unnest(range(pos, pos + k)) AS pos FROM again),
told AS (SELECT p.rid, count(*) AS n_sentences, count(g.pos) AS n_removed, string_agg(p.part, '' ORDER BY p.pos) FILTER (g.pos IS NULL) AS kept
         FROM parts p LEFT JOIN gone g ON p.rid = g.rid AND p.pos = g.pos GROUP BY p.rid)
SELECT c.doc_id, coalesce(t.n_sentences, 0) AS n_sentences, coalesce(t.n_removed, 0) AS n_removed,
       sha256(coalesce(t.kept, '')) AS kept_sha256, coalesce(t.kept, '') AS text
FROM cut c LEFT JOIN told t ON c.rid = t.rid
"""


OP8_SQL = _op8_sql()
