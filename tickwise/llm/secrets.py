"""Secret scan through a trigram inverted index (operator 10).

Every rule's regular expression is turned into a Boolean query over character
trigrams that any match must contain (AND of the trigrams of a literal, OR of
its alternatives). Each task builds an inverted index over its segment of
documents - trigram -> posting list of row numbers, for the trigrams that some
rule asks for - and answers the Boolean queries by intersecting and uniting
postings. Only candidates are verified with the regular expression. A rule
without a mandatory trigram (long runs of hex digits) scans every document.

The index is segment-local, so nothing is shuffled and a lost task rebuilds
only its own segment. Case is folded in the index alone (ASCII), which can
only add candidates.

Cases: a null text counts as empty (no spans, digest of the empty string);
null ids and repeated rows give one output row each, as they come; an empty
table gives no rows; other input columns are not read, so their names cannot
clash.
"""

from __future__ import annotations

import hashlib
import re
import re._constants as sre
import re._parser as sre_parse
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tickwise.llm.common import distinct, read, segments, ship

MAX_ALTERNATIVES = 16  # literals kept apart while a query is derived
SEGMENT_CHARS = 4_000_000  # texts indexed at a time; a longer text is scanned without an index


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0  # its length decides
    least: int = 0
    ignore_case: bool = False
    base: bool = False

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.ignore_case else 0))


#: Base rules as the contract gives them; the others are further kinds of this scan.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         group=2, least=12, ignore_case=True, base=True),
    Rule("access", r"AKIA[A-Z0-9]+", least=18, base=True),
    Rule("hex", r"[0-9a-f]+", least=16, base=True),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    # From the start of a run of its signs only, so that no run is read twice.
    Rule("bearer", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
)

# A query is True (no condition), a trigram (bytes), ("and", parts) or ("or", parts).


def _all(parts: list):
    parts = [p for p in parts if p is not True]
    return True if not parts else parts[0] if len(parts) == 1 else ("and", tuple(dict.fromkeys(parts)))


def _any(parts: list):
    if any(p is True for p in parts):
        return True
    return parts[0] if len(parts) == 1 else ("or", tuple(dict.fromkeys(parts)))


def _fold(code: int) -> str:
    return chr(code).lower() if code < 128 else chr(code)


def _literals(strings: set[str]):
    def one(s: str):
        b = s.encode()
        return _all([b[i:i + 3] for i in range(len(b) - 2)])
    return _any([one(s) for s in sorted(strings)])


def _class_strings(items) -> set[str] | None:
    out = set()
    for op, arg in items:
        if op is sre.LITERAL:
            out.add(_fold(arg))
        elif op is sre.RANGE and arg[1] - arg[0] < MAX_ALTERNATIVES:
            out |= {_fold(c) for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return out if len(out) <= MAX_ALTERNATIVES else None


def _derive(nodes) -> tuple[set[str] | None, object]:
    """(all strings that the part can match, if few; query that any match fulfils)."""
    exact: set[str] | None = {""}  # of the run of literals that is still open
    whole, found = True, []

    def close():
        nonlocal exact
        if exact:
            found.append(_literals(exact))
        exact = {""}

    def times(strings: set[str]) -> None:
        nonlocal exact, whole
        if len(exact) * len(strings) > MAX_ALTERNATIVES:
            close()
            whole = False
        exact = {a + b for a in exact for b in strings}

    for op, arg in nodes:
        strings, query = None, True
        if op is sre.LITERAL:
            strings = {_fold(arg)}
        elif op is sre.IN:
            strings = _class_strings(arg)
        elif op is sre.SUBPATTERN:
            strings, query = _derive(arg[3])
        elif op is sre.BRANCH:
            each = [_derive(b) for b in arg[1]]
            if all(s is not None for s, _ in each):
                strings = set().union(*(s for s, _ in each))
            query = _any([q for _, q in each])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, part = arg
            inner, query = _derive(part)
            if inner is not None and (low, high) == (0, 1):
                strings = inner | {""}
            elif inner is not None and low == high and len(inner) ** low <= MAX_ALTERNATIVES:
                strings = {""}
                for _ in range(low):
                    strings = {a + b for a in strings for b in inner}
            query = query if low else True
        if strings is not None and len(strings) <= MAX_ALTERNATIVES:
            times(strings)
        else:
            close()
            whole = False
            found.append(query)
    if whole:
        return exact, _literals(exact)
    close()
    return None, _all(found)


@lru_cache(maxsize=None)
def trigram_query(pattern: str):
    return _derive(sre_parse.parse(pattern))[1]


def _trigrams(query) -> set[bytes]:
    if query is True:
        return set()
    return {query} if isinstance(query, bytes) else set().union(*map(_trigrams, query[1]))


def _answer(query, postings: dict[bytes, np.ndarray], n: int) -> np.ndarray:
    """Rows (ascending) that fulfil the query."""
    if query is True:
        return np.arange(n)
    if isinstance(query, bytes):
        return postings.get(query, np.empty(0, np.int64))
    parts = [_answer(q, postings, n) for q in query[1]]
    out = parts[0]
    for p in parts[1:]:
        out = np.intersect1d(out, p, True) if query[0] == "and" else np.union1d(out, p)
    return out


class _Index:
    """Inverted index of one segment over the trigrams that rules ask for."""

    def __init__(self, wanted: set[bytes]):
        self.wanted = sorted(wanted)
        self.slot = np.zeros(1 << 24, np.uint16)  # trigram code -> number from 1
        for i, g in enumerate(self.wanted):
            self.slot[g[0] << 16 | g[1] << 8 | g[2]] = i + 1
        self.fold = np.arange(256, dtype=np.uint8)
        self.fold[65:91] += 32

    def postings(self, raw: list[bytes]) -> dict[bytes, np.ndarray]:
        a = self.fold[np.frombuffer(b"\n".join(raw) + b"\n\n", np.uint8)].astype(np.uint32)
        slots = self.slot[a[:-2] << 16 | a[1:-1] << 8 | a[2:]]
        at = np.flatnonzero(slots)
        starts = np.cumsum([0, *(len(r) + 1 for r in raw[:-1])])
        rows = np.searchsorted(starts, at, "right") - 1
        pairs = distinct(slots[at].astype(np.int64) * len(raw) + rows)
        cut = np.searchsorted(pairs // len(raw), np.arange(1, len(self.wanted) + 2))
        return {g: pairs[cut[i]:cut[i + 1]] % len(raw) for i, g in enumerate(self.wanted)}


def _scan(rules: tuple[Rule, ...], id_column: str, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [r.compiled() for r in rules]
        queries = [trigram_query(r.pattern) for r in rules]
        index = _Index(set().union(*map(_trigrams, queries)))
        for batch, texts in segments(batches, "text", SEGMENT_CHARS):
            texts = [t or "" for t in texts]
            n = len(texts)
            spans: list[list] = [[] for _ in texts]
            if n == 1 and len(texts[0]) > SEGMENT_CHARS:
                asked = [np.arange(1)] * len(rules)
            else:
                postings = index.postings([t.encode("utf-8", "surrogatepass") for t in texts])
                asked = [_answer(q, postings, n) for q in queries]
            for k, (rule, found) in enumerate(zip(rules, compiled)):
                for i in asked[k].tolist():
                    for m in found.finditer(texts[i]):
                        if m.end(rule.group) - m.start(rule.group) >= rule.least:
                            spans[i].append((m.start(), k, m.end()))
            counts = [[sum(s[1] == k for s in row) for row in spans] for k, r in enumerate(rules) if r.base]
            told = [[(f"{rules[k].kind}:{a}:{b}", rules[k].base) for a, k, b in sorted(row)] for row in spans]
            digests = [hashlib.sha256(",".join(s for s, base in row if base).encode()).hexdigest() for row in told]
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_column).cast(schema.field(0).type), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests),
                 pa.array([",".join(s for s, _ in row) for row in told], pa.string()),
                 pa.array([len(row) for row in told], pa.int64())], schema=schema)
    return run


def find_secrets(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                 rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per input row: the id, ``n_<kind>`` of each base rule,
    ``base_sha256``, ``spans`` ("kind:start:end", code points) and ``n_spans``."""
    ship(docs.sparkSession)
    docs = docs.select(docs[id_column].alias(id_column), docs[text_column].alias("text"))
    schema = T.StructType([
        docs.schema[0], *(T.StructField(f"n_{r.kind}", T.LongType()) for r in rules if r.base),
        T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()),
        T.StructField("n_spans", T.LongType())])
    from pyspark.sql.pandas.types import to_arrow_schema
    return docs.mapInArrow(_scan(rules, id_column, to_arrow_schema(schema)), schema)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(read(spark, sf_dir, "documents"))
