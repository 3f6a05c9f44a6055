"""BPE encoding and decoding by speculation and verification (operator 3).

The texts are split into words as the tokenizer's file prescribes. Words are
encoded once per cache generation:

1. speculate: greedy longest match against the vocabulary proposes tokens;
2. verify: every adjacent token pair of all proposed words is tested at once
   with array operations: would a merge of higher priority have crossed the
   boundary between the two before both were complete? Both edges are undone
   merge by merge, latest first, and each state is looked up in the merge table;
3. repair: only words with an incompatible pair (or a token that BPE itself
   never produces) undergo exact merging.

A sequence of self-consistent tokens whose neighbours are all compatible is
the BPE result: merges inside tokens do not see their neighbours, so the
first merge across a boundary would also happen in that pair alone.

Tokenizers are read from the given path on each executor, never trained.

Cases: a null text is encoded as the empty text (0 tokens, digests of the
empty string); null ids and repeated rows give one output row each, as they
come; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tickwise.llm.common import read, segments

_SEPARATORS = re.compile("[\x1c-\x1f]")
SEGMENT_CHARS = 1_500_000
CACHED = 400_000  # words and chunks remembered by a task in each of two generations
_NEVER = np.int64(1) << 40
_LAST = 1 << 40


class WordBpe:
    """A word-level BPE with an end-of-word suffix, from a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, steps = spec["model"], spec["pre_tokenizer"]["pretokenizers"]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or [s["type"] for s in steps] != ["Split", "ByteLevel"]:
            raise ValueError(f"{path}: not a word-level BPE of the supported kind")
        self.suffix = model["end_of_word_suffix"]
        # White space only separates words, so it need not be folded to one blank first.
        self.words = regex.compile(steps[0]["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"), regex.V0)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.vocab: dict[str, int] = model["vocab"]
        self.token = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        n = max(self.token) + 1
        merges = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {m: r for r, m in enumerate(merges)}
        left = np.fromiter((self.vocab[a] for a, _ in merges), np.int64, len(merges))
        right = np.fromiter((self.vocab[b] for _, b in merges), np.int64, len(merges))
        made = np.fromiter((self.vocab[self._joined(a, b)] for a, b in merges), np.int64, len(merges))
        self.born = np.full(n, -1, np.int64)  # rank of the merge that makes a token
        self.born[made] = np.arange(len(merges))
        self.left, self.right = np.arange(n), np.arange(n)
        self.left[made], self.right[made] = left, right
        self.size = n
        order = np.argsort(left * n + right)
        self.pair_codes, self.pair_ranks = (left * n + right)[order], order.astype(np.int64)
        # Undoing by rank needs merges that come after those of their parts, and one merge a token.
        self.ordered = len(set(made.tolist())) == len(merges) and bool((self.born[left] < np.arange(len(merges))).all() and (self.born[right] < np.arange(len(merges))).all())
        self.sound = np.ones(n, bool)  # tokens that BPE makes of their own text
        self.sound[made] = self.compatible(left, right, np.arange(len(merges)))
        for a, b, t in zip(left.tolist(), right.tolist(), made.tolist()):
            self.sound[t] &= self.sound[a] and self.sound[b]
        self.byte_char = _byte_chars()
        self.starts: dict[str, int] = {}  # longest inner token by its first three characters
        for t in self.vocab:
            if not t.endswith(self.suffix):
                self.starts[t[:3]] = max(self.starts.get(t[:3], 0), len(t))

    def _joined(self, a: str, b: str) -> str:
        return a + b  # the suffix is only ever at the end of b

    def _rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        codes = a * self.size + b
        at = np.minimum(np.searchsorted(self.pair_codes, codes), len(self.pair_codes) - 1)
        return np.where(self.pair_codes[at] == codes, self.pair_ranks[at], _NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """For each pair: no merge crosses its boundary (``before`` that rank)."""
        out = np.ones(len(a), bool)
        alive = np.arange(len(a))
        x, y = a.copy(), b.copy()
        limit = np.full(len(a), _NEVER) if before is None else before.astype(np.int64)  # crossing ranks below it count
        while len(alive):
            crossed = self._rank_of(x, y) < limit
            out[alive[crossed]] = False
            bx, by = self.born[x], self.born[y]
            go = ~crossed & ((bx >= 0) | (by >= 0))
            alive, x, y, bx, by = alive[go], x[go], y[go], bx[go], by[go]
            undo_left = bx > by  # the later of both; of equal merges the right one came last
            limit = np.where(undo_left, bx, by + 1)
            x, y = np.where(undo_left, self.right[x], x), np.where(undo_left, y, self.left[y])
        return out

    def greedy(self, chars: str) -> list[int]:
        vocab, suffix, out, i, n = self.vocab, self.suffix, [], 0, len(chars)
        while True:
            if (last := vocab.get(chars[i:] + suffix)) is not None:
                out.append(last)
                return out
            for k in range(min(n - i - 1, self.starts.get(chars[i:i + 3], 2)), 0, -1):
                if (t := vocab.get(chars[i:i + k])) is not None:
                    break
            else:
                raise ValueError(f"the vocabulary has no token for {chars[i]!r} inside a word")
            out.append(t)
            i += k

    def exact(self, chars: str) -> list[int]:
        """Plain BPE: the merge of highest priority, leftmost first, until none applies."""
        parts = [*chars[:-1], chars[-1] + self.suffix]
        if len(parts) > 60:
            return self._exact_long(parts)
        get = self.rank.get
        ranks = [get(p, _LAST) for p in zip(parts, parts[1:])]
        while ranks and (low := min(ranks)) != _LAST:
            i = ranks.index(low)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = get((parts[i], parts[i + 1]), _LAST)
            if i:
                ranks[i - 1] = get((parts[i - 1], parts[i]), _LAST)
        return [self.vocab[p] for p in parts]

    def _exact_long(self, parts: list[str]) -> list[int]:
        """The same with a heap of open merges, for words of any length."""
        rank, n = self.rank, len(parts)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(rank[p], i, p) for i, p in enumerate(zip(parts, parts[1:])) if p in rank]
        heapq.heapify(heap)
        while heap:
            _, i, (a, b) = heapq.heappop(heap)
            j = after[i]
            if j < 0 or parts[i] != a or parts[j] != b:
                continue  # one of the two has gone into another merge
            parts[i], parts[j], after[i] = a + b, "", after[j]
            if after[i] >= 0:
                before[after[i]] = i
                if (p := (parts[i], parts[after[i]])) in rank:
                    heapq.heappush(heap, (rank[p], i, p))
            if (k := before[i]) >= 0 and (p := (parts[k], parts[i])) in rank:
                heapq.heappush(heap, (rank[p], k, p))
            after[j] = -1
        return [self.vocab[p] for p in parts if p]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        chars = ["".join(map(self.byte_char.__getitem__, w.encode("utf-8", "replace"))) for w in words]
        if not self.ordered:
            return [self.exact(c) for c in chars]
        proposed = [self.greedy(c) for c in chars]
        lengths = np.fromiter(map(len, proposed), np.int64, len(proposed))
        flat = np.fromiter((t for p in proposed for t in p), np.int64, int(lengths.sum()))
        owner = np.repeat(np.arange(len(words)), lengths)
        failed = np.zeros(len(words), bool)
        failed[owner[~self.sound[flat]]] = True
        inner = np.flatnonzero(owner[:-1] == owner[1:])
        codes, back = np.unique(flat[inner] * self.size + flat[inner + 1], return_inverse=True)
        fits = self.compatible(codes // self.size, codes % self.size)
        failed[owner[inner[~fits[back]]]] = True
        for i in np.flatnonzero(failed).tolist():
            proposed[i] = self.exact(chars[i])
        return proposed

    def chunks(self, text: str) -> list[str]:
        """Runs without white space, and special tokens, in order: no word goes beyond one."""
        if self.specials and any(s in text for s in self.special):
            return [w for k, part in enumerate(self.specials.split(text)) for w in ([part] if k % 2 else self._chunks(part))]
        return self._chunks(text)

    def _chunks(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        if _SEPARATORS.search(text):  # blanks for str.split, but no white space
            return [text]
        return text.split()

    def split(self, text: str) -> list[str]:
        """Words and special tokens of a text, in order."""
        return [w for c in self.chunks(text) for w in ([c] if c in self.special else self.words.findall(c))]

    def decode(self, ids) -> str:
        return " ".join([self.token[i] for i in ids])


def _byte_chars() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in shown}
    table |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in table)}
    return [table[b] for b in range(256)]


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordBpe:
    return WordBpe(path)


class _Memory(dict):
    """Remembers about ``size`` to twice as many keys: those asked for since the last change of generation."""

    def __init__(self, size: int):
        super().__init__()
        self.size, self.old = size, {}

    def missing(self, keys: set, turn: bool = True) -> list:
        """Keys that are in neither generation; the others come to the new
        one. With ``turn`` a full generation becomes the old one first."""
        if turn and len(self) > self.size:
            self.old = dict(self)
            self.clear()
        old, out = self.old, []
        for k in keys:
            if k in self:
                continue
            if (v := old.get(k)) is None:
                out.append(k)
            else:
                self[k] = v
        return out


def _encode(path: str, id_column: str, full: bool, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        known = _Memory(CACHED)  # word or chunk -> its ids, as text; a word is the chunk of itself
        shown = {str(i): t for i, t in bpe.token.items()}

        def learn(new: set[str]) -> None:
            split = {c: bpe.words.findall(c) for c in known.missing(new) if c not in bpe.special}
            asked = known.missing({w for ws in split.values() for w in ws}, turn=False)
            for w, ids in zip(asked, bpe.encode_words(asked)):
                known[w] = " ".join(map(str, ids))
            for c, ws in split.items():
                if len(ws) != 1 or ws[0] != c:
                    known[c] = " ".join([known[w] for w in ws])
            for w, i in bpe.special.items():
                known[w] = str(i)

        for batch, texts in segments(batches, "text", SEGMENT_CHARS):
            split = [bpe.chunks(t) if t else [] for t in texts]
            learn({c for chunks in split for c in chunks})
            counts, ids_sha, text_sha, all_ids, all_text = [], [], [], [], []
            for chunks in split:
                ids = " ".join(filter(None, map(known.__getitem__, chunks)))
                tokens = ids.split()
                decoded = " ".join(map(shown.__getitem__, tokens))
                counts.append(len(tokens))
                ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                text_sha.append(hashlib.sha256(decoded.encode()).hexdigest())
                if full:
                    all_ids.append(list(map(int, tokens)))
                    all_text.append(decoded)
            more = [pa.array(all_ids, pa.list_(pa.int32())), pa.array(all_text, pa.string())] if full else []
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([batch.column(id_column), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()),
                                                                              pa.array(text_sha, pa.string()), *more], schema)], schema=schema)
    return run


def encode(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", full: bool = False) -> DataFrame:
    """Per row: id, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``; with
    ``full`` also the token ids and the decoded text themselves."""
    rows = docs.select(docs[id_column].alias(id_column), docs[text_column].alias("text"))
    schema = T.StructType([rows.schema[0], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
                           T.StructField("decoded_sha256", T.StringType())])
    if full:
        schema = schema.add("ids", T.ArrayType(T.IntegerType())).add("decoded", T.StringType())
    return rows.mapInArrow(_encode(path, id_column, full, to_arrow_schema(schema)), schema)


def default_path() -> str:
    """The 49k word-level vocabulary of the installed public tokenizers."""
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(read(spark, sf_dir, "documents"), default_path())
