"""Token-ID files in shuffled planes (operator 11).

Texts are encoded in ascending order of their ids, an end id is appended to
each, and the ids of a shard (one range of ids) are cut into blocks of a fixed
number of ids. A block is written as planes: plane p holds byte p (or bit p)
of every id of the block, so that bytes that vary alike stand together, and
each plane is compressed with zstandard.

Layout of a stored table (Parquet files as containers, written and committed
by Spark, so a lost executor leaves no half shard behind)::

    chunks/   one row a block: shard, chunk, start (in its shard), n_ids, kind,
              planes, and the documents in it: first_seq, doc_ids, counts,
              after (ids of the last document that follow in later blocks)
    index/    one row a block: shard, chunk, start (among all ids), n_ids,
              first_doc, n_docs, plane_bytes; written after the chunks, so a
              table without it is incomplete

``read_docs`` decodes blocks wherever they lie: a document that spans several
blocks is put together from the checksums of its pieces (the checksum of a
piece is shifted by the bytes that follow and all are combined by xor, a
partial aggregate). ``read_ids`` gives the ids of one range of places and
reads only the blocks that the index names.

Encoding is done by the tokenizers library. A word of its pre-tokenizer ends
before every blank or line end that stands before a letter, digit or sign, so
texts are cut there as arrays and each distinct piece is encoded once while it
is remembered: a run of letters (with signs behind it) by the library's model,
anything else by the library as a whole. Texts with other white space or with
the string of an added token go through the library whole.

Cases: a null text is encoded as the empty text (the end id alone); rows with
a null id come first; rows that repeat an id come in the order of their texts'
hashes, and each has its place; equal ids are dealt over shards if they are
many; very long texts span blocks; an empty table gives a table without
blocks; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tickwise.llm.bpe import _byte_chars, _Memory
from tickwise.llm.common import read, scratch, ship

BLOCK_IDS = 65_536
END_ID = 0
LEVEL = 3  # of zstandard
SEGMENT_BYTES = 6_000_000  # of text encoded at a time
REMEMBERED = 250_000  # pieces in each of two generations
LONG_PIECE = 64  # characters; longer pieces are not remembered
#: White space that does not just end a word (RE2).
_UNEVEN = r"[ \n]([^!-~\pL\pN]|$)"
#: Two words of the pre-tokenizer: letters, and signs without an apostrophe.
_LETTERS = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
_FRONT = "\x01"  # before the first piece of a text
_POLY = 0xEDB88320  # of crc32, bits reversed


# --- planes -------------------------------------------------------------------


def to_planes(ids: np.ndarray, kind: str = "byte", level: int = LEVEL) -> list[bytes]:
    """uint32 ids -> compressed planes: 4 of a byte or 32 of a bit each."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if kind == "bit":
        rows = np.packbits(np.unpackbits(raw, axis=1, bitorder="little").T, axis=1, bitorder="little")
    elif kind == "byte":
        rows = np.ascontiguousarray(raw.T)
    else:
        raise ValueError(f"unknown kind of planes: {kind}")
    pack = zstandard.ZstdCompressor(level=level).compress
    return [pack(r.tobytes()) for r in rows]


def from_planes(planes: list[bytes], n: int, kind: str = "byte") -> np.ndarray:
    unpack = zstandard.ZstdDecompressor().decompress
    rows = np.stack([np.frombuffer(unpack(p), np.uint8) for p in planes])
    if kind == "bit":
        rows = np.packbits(np.unpackbits(rows, axis=1, count=n, bitorder="little").T, axis=1, bitorder="little").T
    return np.ascontiguousarray(rows.T).view("<u4").reshape(-1)


# --- checksums ----------------------------------------------------------------


def _times(a: int, b: int) -> int:
    """Product of two reversed polynomials modulo that of crc32."""
    out = 0
    for bit in range(31, -1, -1):
        if a >> bit & 1:
            out ^= b
        b = b >> 1 ^ (_POLY if b & 1 else 0)
    return out


@lru_cache(maxsize=1)
def _powers() -> list[int]:
    """x^(8 * 2^k) for the number of bytes 2^k."""
    out = [1 << 23]  # x^8
    for _ in range(62):
        out.append(_times(out[-1], out[-1]))
    return out


def shifted_crc(crc: int, after: int) -> int:
    """What ``crc`` adds to the checksum of a whole with ``after`` bytes
    behind: crc32(A + B) = shifted_crc(crc32(A), len(B)) ^ crc32(B)."""
    for k, power in enumerate(_powers()):
        if after >> k & 1:
            crc = _times(power, crc)
    return crc


# --- writing ------------------------------------------------------------------


class Encoder:
    """Texts -> ids, through the tokenizers library; the end id after each text."""

    def __init__(self, path: str, end_id: int = END_ID):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the work
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        steps = json.loads(self.library.to_str())
        kind = steps["pre_tokenizer"] or {}
        if steps["normalizer"] or kind.get("type") != "ByteLevel" or not kind.get("use_regex") or kind.get("add_prefix_space"):
            raise ValueError(f"{path}: not a byte-level BPE of the supported kind")
        self.model, self.shown = self.library.model, _byte_chars()
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.end = np.array([end_id], "<u4")
        self.front = {" ": b"", "\n": self._whole(["\n"])[0], _FRONT: self.end.tobytes()}
        self.known, self.signs = _Memory(REMEMBERED), {"": b""}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _word(self, word: str) -> bytes:
        if not word.isascii() or word[0] == " ":
            word = "".join([self.shown[b] for b in word.encode()])
        return array("I", [t.id for t in self.model.tokenize(word)]).tobytes()

    def _learn(self, into: dict, pieces: list[str]) -> None:
        """A piece is a blank (not written), line end or the front of a text, and what follows."""
        signs, front, other = self.signs, self.front, []
        for p in pieces:
            lead, body = (p[0], p[1:]) if p[0] in front else (" ", p)
            if (m := _LETTERS.fullmatch(body)) is None:
                other.append(p)
                continue
            word, tail = m.groups()
            if tail not in signs:
                if len(signs) > 10_000:
                    signs.clear()
                signs[tail] = self._word(tail) if tail else b""
            into[p] = front[lead] + self._word(" " + word if lead == " " else word) + signs[tail]
        written = [p[1:] if p[0] == _FRONT else p if p[0] == "\n" else " " + p for p in other]
        for p, ids in zip(other, self._whole(written)):
            into[p] = front[_FRONT] + ids if p[0] == _FRONT else ids

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        long = {p for p in pieces if len(p) > LONG_PIECE}
        known, local = self.known, {}
        self._learn(known, known.missing([p for p in pieces if p not in long] if long else pieces))
        self._learn(local, list(long))
        return [local[p] if p in long else known[p] for p in pieces] if long else list(map(known.__getitem__, pieces))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and how many each text has."""
        texts = texts.fill_null("")
        uneven = pc.match_substring_regex(texts, _UNEVEN)
        for a in self.added:
            uneven = pc.or_(uneven, pc.match_substring(texts, a))
        even = pc.binary_join_element_wise(pa.scalar(_FRONT), pc.if_else(uneven, "", texts), "")
        lists = pc.split_pattern(pc.replace_substring(even, "\n", " \n"), " ")
        flat = lists.flatten().dictionary_encode()
        values = self._pieces(flat.dictionary.to_pylist())
        sizes = np.fromiter(map(len, values), np.int64, len(values)) // 4
        starts, data, at = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(values), "<u4"), flat.indices.to_numpy()
        n = sizes[at]
        ends = np.cumsum(n)
        ids = data[np.repeat(starts[at] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]
        last = np.concatenate([[0], ends])[np.cumsum(pc.list_value_length(lists).to_numpy())]
        counts = np.diff(last, prepend=0)
        # The end id stands in front of each text so far.
        if whole := np.flatnonzero(uneven.to_numpy(zero_copy_only=False)).tolist():
            parts, before = [], 0
            for i, own in zip(whole, self._whole([texts[i].as_py() for i in whole])):
                parts += [ids[before:last[i]], np.frombuffer(own, "<u4")]
                before, counts[i] = last[i], counts[i] + len(own) // 4
            ids = np.concatenate([*parts, ids[before:]])
        return np.concatenate([ids[1:], self.end[:len(texts)]]), counts


@lru_cache(maxsize=1)
def encoder(path: str, end_id: int) -> Encoder:
    """One a worker process, with what it remembers."""
    return Encoder(path, end_id)


class _Shard:
    """Blocks of one shard, in order."""

    def __init__(self, shard: int, block: int, kind: str):
        self.shard, self.block, self.kind = shard, block, kind
        self.chunk = self.start = self.seq = 0
        self.ids, self.docs, self.counts = np.empty(0, "<u4"), [], np.empty(0, np.int64)

    def add(self, docs: list, ids: np.ndarray, counts: np.ndarray) -> Iterator[tuple]:
        self.ids, self.counts = np.concatenate([self.ids, ids]), np.concatenate([self.counts, counts])
        self.docs += docs
        while len(self.ids) >= self.block:
            yield self._row(self.block)

    def end(self) -> Iterator[tuple]:
        if len(self.ids):
            yield self._row(len(self.ids))

    def _row(self, n: int) -> tuple:
        ends = np.cumsum(self.counts)
        k = int(np.searchsorted(ends, n))  # the document that the block's last id is of
        counts, after = self.counts[:k + 1].copy(), int(ends[k]) - n
        counts[k] -= after
        row = (self.shard, self.chunk, self.start, n, self.kind, to_planes(self.ids[:n], self.kind), self.seq, self.docs[:k + 1], counts.tolist(), after)
        done = k if after else k + 1
        self.ids, self.docs, self.counts = self.ids[n:], self.docs[done:], self.counts[done:].copy()
        if after:
            self.counts[0] = after
        self.chunk, self.start, self.seq = self.chunk + 1, self.start + n, self.seq + done
        return row


def _chunk_schema(id_type: T.DataType) -> T.StructType:
    return (T.StructType.fromDDL("shard int, chunk int, start long, n_ids int, kind string, planes array<binary>, first_seq long")
            .add("doc_ids", T.ArrayType(id_type)).add("counts", T.ArrayType(T.IntegerType())).add("after", T.LongType()))


def _blocks(path: str, block: int, kind: str, end_id: int, schema: pa.Schema):
    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard = encoder(path, end_id).encode, _Shard(TaskContext.get().partitionId(), block, kind)
        for batch in batches:
            ends = np.cumsum(pc.binary_length(batch.column("__text")).fill_null(0).to_numpy())
            at = 0
            while at < len(ends):
                stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SEGMENT_BYTES, "right")))
                part = batch.slice(at, stop - at)
                for row in shard.add(part.column("__id").to_pylist(), *encode(part.column("__text"))):
                    yield table([row])
                at = stop
        for row in shard.end():
            yield table([row])
    return run


def write_ids(docs: DataFrame, path: str, tokenizer: str, id_column: str = "doc_id", text_column: str = "text", block: int = BLOCK_IDS,
              kind: str = "byte", end_id: int = END_ID, shards: int | None = None) -> None:
    """Encode ``docs`` in ascending order of their ids and store the ids
    below ``path``. ``shards``: as many as the scan of ``docs`` has tasks,
    unless given."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(docs[id_column].alias("__id"), docs[text_column].alias("__text"))
    shards = shards or max(1, rows.rdd.getNumPartitions())
    # The last column only deals out rows that agree in id and text.
    order = ["__id", "__hash", "__row"]
    rows = rows.withColumns({"__hash": F.xxhash64("__text"), "__row": F.monotonically_increasing_id()})
    ordered = rows.repartitionByRange(shards, *order).sortWithinPartitions(*order).select("__id", "__text")
    schema = _chunk_schema(ordered.schema["__id"].dataType)
    chunks = ordered.mapInArrow(_blocks(tokenizer, block, kind, end_id, to_arrow_schema(schema)), schema)
    # Compressed already.
    chunks.write.option("compression", "none").parquet(f"{path}/chunks")
    stored = spark.read.schema(schema).parquet(f"{path}/chunks")
    about = stored.join(F.broadcast(_bases(stored)), "shard").select(
        "shard", "chunk", (F.col("base") + F.col("start")).alias("start"), "n_ids", F.element_at("doc_ids", 1).alias("first_doc"),
        F.size("doc_ids").alias("n_docs"), F.transform("planes", F.octet_length).alias("plane_bytes"))
    about.write.parquet(f"{path}/index")


def _bases(chunks: DataFrame) -> DataFrame:
    """Ids before each shard; one row a shard, as many as the writing job had tasks."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    sizes = chunks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    return sizes.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))


# --- reading ------------------------------------------------------------------


def _pieces(schema: pa.Schema):
    """Blocks -> a row for each document in them, with its share of the checksum."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = {k: batch.column(k)[r] for k in batch.schema.names}
                n, counts = row["n_ids"].as_py(), np.array(row["counts"].as_py(), np.int64)
                data = from_planes(row["planes"].as_py(), n, row["kind"].as_py()).tobytes()
                ends = np.cumsum(counts)
                crcs = [zlib.crc32(data[4 * (e - c):4 * e]) for e, c in zip(ends.tolist(), counts.tolist())]
                if row["after"].as_py():
                    crcs[-1] = shifted_crc(crcs[-1], 4 * row["after"].as_py())
                m = len(counts)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(m, row["shard"].as_py(), np.int32)), pa.array(row["first_seq"].as_py() + np.arange(m)), row["doc_ids"].values,
                    pa.array(row["start"].as_py() + ends - counts), pa.array(counts), pa.array(crcs, pa.int64())], schema=schema)
    return run


def _stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/chunks")


def read_docs(spark: SparkSession, path: str, id_column: str = "doc_id") -> DataFrame:
    """Per document of a stored table: id, ``start`` (ids before it),
    ``n_tokens`` and ``ids_crc32`` (of its ids as little-endian unsigned
    32-bit integers), from the blocks."""
    ship(spark)
    chunks = _stored(spark, path)
    id_type = chunks.schema["doc_ids"].dataType.elementType
    schema = T.StructType.fromDDL("shard int, seq long").add("__id", id_type).add("start", T.LongType()).add("n", T.LongType()).add("crc", T.LongType())
    pieces = chunks.select("shard", "start", "n_ids", "kind", "planes", "first_seq", "doc_ids", "counts", "after").mapInArrow(_pieces(to_arrow_schema(schema)), schema)
    whole = pieces.groupBy("shard", "seq").agg(F.any_value("__id").alias("__id"), F.min("start").alias("start"), F.sum("n").alias("n_tokens"), F.bit_xor("crc").alias("ids_crc32"))
    bases = _bases(chunks.select("shard", "n_ids"))
    return whole.join(F.broadcast(bases), "shard").select(F.col("__id").alias(id_column), (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def _range(start: int, stop: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                first, n = batch.column("first")[r].as_py(), batch.column("n_ids")[r].as_py()
                ids = from_planes(batch.column("planes")[r].as_py(), n, batch.column("kind")[r].as_py())
                lo, hi = max(start - first, 0), min(stop - first, n)
                yield pa.RecordBatch.from_arrays([pa.array(first + np.arange(lo, hi)), pa.array(ids[lo:hi].astype(np.int64))], schema=schema)
    return run


def read_ids(spark: SparkSession, path: str, start: int, stop: int) -> DataFrame:
    """The ids at places ``start`` to ``stop`` (exclusive) among all: (place,
    id). The index says which blocks are read."""
    ship(spark)
    schema = T.StructType.fromDDL("place long, id long")
    index = spark.read.parquet(f"{path}/index").select("shard", "chunk", F.col("start").alias("first"), F.col("n_ids").alias("n"))
    asked = index.where((F.col("first") < stop) & (F.col("first") + F.col("n") > start)).drop("n")
    blocks = _stored(spark, path).select("shard", "chunk", "n_ids", "kind", "planes").join(asked, ["shard", "chunk"])
    return blocks.select("first", "n_ids", "kind", "planes").mapInArrow(_range(start, stop, to_arrow_schema(schema)), schema)


def default_path() -> str:
    """The byte-level vocabulary of the installed public tokenizers."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def op11_idplanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "idplanes")
    write_ids(read(spark, sf_dir, "documents"), path, default_path())
    return read_docs(spark, path)
