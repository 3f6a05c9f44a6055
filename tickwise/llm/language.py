"""Language identification with bit-sliced Bloom filters (operator 9).

All languages share one table of ``POSITIONS`` entries. Each entry is a bit
mask over the languages: bit *l* of the table is the Bloom filter of language
*l*, and the filters lie side by side, so that the AND of the ``HASHES``
entries of an n-gram gives at once every language that contains it. A text is
scored by counting, per language, the n-grams whose mask has its bit
(popcounts), and by correcting the share for the false positives that the
fill of that filter makes likely: ``(hits / n - fp) / (1 - fp)``. The highest
share wins, ties go to the language that sorts first.

Learning reads every labelled document that isn't held out: its n-grams are
counted by Spark, and each language keeps its ``grams`` most frequent ones, less
those that are far more frequent in another language. Prediction reads every
whole text.

Cases: texts that are null or have no letter get ``und`` and score 0; a text
whose n-grams are in no filter gets the most frequent learned language with
score 0; without any labelled row everything is ``und``; rows with a null id
are predicted but never learned from; a null ``lang`` isn't learned from;
repeated rows give one output row each; empty tables give no rows; other
columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tickwise.llm.common import read, segments

POSITIONS = 1 << 20  # entries of the table (a power of two)
HASHES = 3
SEGMENT_CHARS = 1_000_000  # characters scored at a time
HELD_GRAMS = 1_000_000  # counts that a task holds before it gives them on
_MULTIPLIERS = tuple(np.uint32(m) for m in (2654435769, 2246822519, 3266489917, 668265263))
_LETTER = re.compile(r"[^\W\d_]")
_WORD_BYTE = np.array([b >= 128 or chr(b).isalpha() for b in range(256)])


@dataclass(frozen=True)
class Filters:
    """``tables[s]`` holds the masks of languages 64*s .. 64*s+63."""
    languages: tuple[str, ...]
    tables: tuple[np.ndarray, ...]
    false_positive: np.ndarray
    fallback: int


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """4-byte n-grams of all texts, lower-cased, other than letters as blanks,
    and the text that each belongs to. n-grams over two blanks don't count."""
    raw = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    a = np.frombuffer(b"  " + b"    ".join(raw) + b"    ", np.uint8)
    a = np.where(_WORD_BYTE[a], a, np.uint8(32)).astype(np.uint32)
    codes = a[:-3] << 24 | a[1:-2] << 16 | a[2:-1] << 8 | a[3:]
    blank = a == 32
    keep = np.flatnonzero(~(blank[:-3] & blank[1:-2] | blank[1:-2] & blank[2:-1] | blank[2:-1] & blank[3:]))
    starts = np.cumsum([0, *(len(r) + 4 for r in raw[:-1])])
    return codes[keep], np.searchsorted(keep, starts)


def _positions(codes: np.ndarray, j: int) -> np.ndarray:
    x = codes * _MULTIPLIERS[j]
    x ^= x >> np.uint32(15)
    x *= _MULTIPLIERS[(j + 1) % 4]
    return x >> np.uint32(32 - POSITIONS.bit_length() + 1)


def held_out(id_column: Column) -> Column:
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _summed(grams: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams, sorted, and the sums of their counts."""
    order = np.argsort(grams, kind="stable")
    grams, n = grams[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])) if len(grams) else np.empty(0, np.int64)
    return grams[first], np.add.reduceat(n, first) if len(first) else n


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def given() -> Iterator[pa.RecordBatch]:
        for lang in sorted(held):
            grams, n = held.pop(lang)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams.astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    for batch, texts in segments(batches, "text", SEGMENT_CHARS):
        langs = np.array(batch.column("lang").to_pylist(), object)
        for lang in sorted(set(langs)):
            codes = np.sort(_codes([t for t, own in zip(texts, langs) if own == lang])[0])
            parts = [_summed(codes, np.ones(len(codes), np.int64)), *([held[lang]] if lang in held else [])]
            held[lang] = _summed(*(np.concatenate(x) for x in zip(*parts)))
        if sum(len(grams) for grams, _ in held.values()) > HELD_GRAMS:
            yield from given()
    yield from given()


def learn(docs: DataFrame, grams: int = 50_000, least: int = 3, ratio: float = 0.1) -> Filters:
    """Fits the filters on all rows (doc_id, text, lang) that aren't held out.

    grams: n-grams kept of each language at most; least: occurrences that an
    n-gram needs; ratio: an n-gram is left out of languages where it is rarer
    than this share of its highest rate.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    if not sizes:
        return Filters((), (), np.empty(0), 0)
    counted = (rows.select("lang", "text").mapInArrow(_count, "lang string, gram long, n long")
               .groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    totals = Window.partitionBy("lang")
    rated = counted.withColumn("rate", F.col("n") / F.sum("n").over(totals)).where(F.col("n") >= least)
    kept = (rated.withColumn("top", F.max("rate").over(Window.partitionBy("gram"))).where(F.col("rate") >= ratio * F.col("top"))
            .withColumn("place", F.row_number().over(totals.orderBy(F.desc("n"), "gram"))).where(F.col("place") <= grams)
            .select("lang", "gram").toPandas())  # at most ``grams`` a language
    languages = tuple(sorted(sizes))
    slices = -(-len(languages) // 64)
    kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if min(len(languages), 64) <= 8 * np.dtype(k).itemsize)
    tables = tuple(np.zeros(POSITIONS, kind) for _ in range(slices))
    fp = np.zeros(len(languages))
    for i, lang in enumerate(languages):
        codes = kept.loc[kept["lang"] == lang, "gram"].to_numpy(np.int64).astype(np.uint32)
        bit = kind(1 << i % 64)
        for j in range(HASHES):
            tables[i // 64][_positions(codes, j)] |= bit
        fp[i] = np.count_nonzero(tables[i // 64] & bit) / POSITIONS
    return Filters(languages, tables, fp ** HASHES, languages.index(min(sizes, key=lambda k: (-sizes[k], k))))


def score(filters: Filters, texts: list[str]) -> np.ndarray:
    """Corrected share of each text's n-grams in each language's filter."""
    codes, starts = _codes(texts)
    n = np.diff(np.append(starts, len(codes)))
    out = np.zeros((len(texts), len(filters.languages)))
    some = np.flatnonzero(n)
    if not len(some):
        return out
    at = [_positions(codes, j) for j in range(HASHES)]
    for s, table in enumerate(filters.tables):
        masks = table[at[0]]
        for p in at[1:]:
            masks &= table[p]
        for i in range(64 * s, min(64 * s + 64, len(filters.languages))):
            hits = np.add.reduceat(masks >> table.dtype.type(i % 64) & table.dtype.type(1), starts[some], dtype=np.int64)
            out[some, i] = hits / n[some]
    return np.clip((out - filters.false_positive) / (1 - filters.false_positive), 0, 1)


def _predict(shared, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters: Filters = shared.value
        for batch, texts in segments(batches, "text", SEGMENT_CHARS):
            asked = [i for i, t in enumerate(texts) if t and _LETTER.search(t)] if filters.languages else []
            names, scores = ["und"] * len(texts), [0.0] * len(texts)
            if asked:
                shares = score(filters, [texts[i] for i in asked])
                best = shares.argmax(axis=1)
                for i, row, b in zip(asked, shares, best.tolist()):
                    scores[i] = float(row[b])
                    names[i] = filters.languages[b if row[b] > 0 else filters.fallback]
            columns = [batch.column(c) for c in batch.schema.names]
            yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(columns, schema)), pa.array(names, pa.string()), pa.array(scores)], schema=schema)
    return run


def predict(docs: DataFrame, filters: Filters, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Adds ``lang_pred`` and ``score`` to the ``keep`` columns; only ``text``
    is an input of the prediction."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)  # POSITIONS masks: a few MB
    names = [c for c in keep if c != "text"]
    rows = docs.select(*names, "text")
    schema = T.StructType([*rows.schema, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    out = rows.mapInArrow(_predict(shared, to_arrow_schema(schema)), schema)
    return out.select(*keep, "lang_pred", "score")


def lowest_score(docs: DataFrame, filters: Filters, quantile: float = 0.01, margin: float = 0.5) -> float:
    """The score below which a text is in none of the learned languages:
    ``margin`` times the ``quantile`` of the scores of all labelled rows (those
    that may be learned from) that get their own language. 0 without such rows."""
    rows = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    own = predict(rows, filters, keep=("lang",)).where(F.col("lang") == F.col("lang_pred"))
    low = own.agg(F.percentile_approx("score", quantile, 10_000)).first()[0]
    return margin * low if low else 0.0


def identify(docs: DataFrame, **learning) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of ``docs``."""
    filters = learn(docs.select("doc_id", "text", "lang"), **learning)
    return predict(docs.select("doc_id", "text"), filters).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read(spark, sf_dir, "documents"))
