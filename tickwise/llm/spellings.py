"""Spelling variants by a frequency-vector trie (operator 12).

The words of all texts are counted; two words are near if one code point more,
less or other makes them equal. Each word has a vector of letter-group counts,
and the trie arranges the words by successive counts. A word that is near
another has at most one letter of a group more (surplus) and one less
(deficit), so a depth-first search from the root spends a budget of one each
and visits only children whose count is equal, one more or one less. What it
reaches is compared letter by letter.

Over all tasks: the nodes that hold more than a cell's words (``skeleton``, a
list bounded by the number of words over the size of a cell) go to every task;
each word goes to the cell below them that is its own, and as a query to all
cells that its budget reaches. A cell's queries are dealt over copies of its
words, so a task has a bounded number of both. A pair is searched from one
side only: from the shorter word, or from the one whose first differing count
is the smaller. Where whole words have no more groups to tell them apart, the
trie goes on with the counts of their first letters, with a new budget (an
edit moves at most one letter into a beginning and one out of it).

A word's form is its most frequent near word, if at least ``RATIO`` times as
frequent; its root is found by following forms, in steps that double.

Cases: null and empty texts have no words; a null id counts as the empty
string where occurrences are altered; repeated rows count each; words of equal
counts are told apart by code points; words of any length are compared whole
(counts above 250 in a group are one); an empty table has no words; other
columns, whatever their names, are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tickwise.llm.common import UPPER, read, segments, ship, written

RUN = "[A-Za-zÀ-ÿ]+"
ALTERED = 199  # one occurrence in so many loses a letter
MIN_LENGTH, MIN_COUNT, RATIO = 6, 5, 5
SEGMENT_CHARS = 2_000_000
HELD = 300_000  # counts that a task holds before it passes them on
CELL = 16_384  # words of a cell at most, if counts can tell them apart
FEWEST = 500  # words that a cell may have at least before it is divided
QUERIES = 65_536  # of a cell in one task
SKELETON = 1_000_000  # nodes at most
STEP = 4  # levels counted at a time
LEAF = 4_096  # pairs that are compared without going on in the trie
PAIRS = 500_000  # compared letter by letter at a time
#: Letters of a group count together; the last group has all others.
GROUPS = ("e", "t", "a", "n", "i", "o", "r", "s", "h", "d", "l", "u", "cmw", "gfp", "bvy")
#: Whole words, then their first so many letters.
PARTS = (None, 8, 16)
WIDTH = len(GROUPS) + 1
LEVELS = WIDTH * len(PARTS)
_GROUP = np.full(256, len(GROUPS), np.int64)
for _i, _letters in enumerate(GROUPS):
    _GROUP[[ord(c) for c in _letters]] = _i


# --- words --------------------------------------------------------------------


def _count(altered: int, shortest: int, schema: pa.Schema):
    find, lower = re.compile(RUN).findall, str.maketrans(UPPER, UPPER.lower())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], schema=schema)

        for batch, texts in segments(batches, "text", SEGMENT_CHARS):
            for doc, text in zip(batch.column("id").to_pylist(), texts):
                if not text:
                    continue
                own: dict[str, int] = {}
                for word, n in Counter(find(text)).items():
                    word = word.lower() if word.isascii() else word.translate(lower)
                    own[word] = own.get(word, 0) + n
                front = zlib.crc32(f"{doc}:".encode())
                for word, n in own.items():
                    h = zlib.crc32(word.encode(), front)
                    if h % altered == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1:]
                    if len(word) >= shortest:
                        held[word] = held.get(word, 0) + n
            if len(held) > HELD:
                yield out()
                held.clear()
        if held:
            yield out()
    return run


def count_words(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", altered: int = ALTERED, shortest: int = MIN_LENGTH,
                least: int = MIN_COUNT) -> DataFrame:
    """(word, n): the runs of letters of all texts, A-Z in lower case, one
    letter dropped from all of an id's occurrences of one in ``altered`` runs
    (by the crc32 of id and run); words of ``shortest`` letters and ``least``
    occurrences."""
    ship(docs.sparkSession)
    rows = docs.select(F.coalesce(docs[id_column].cast("string"), F.lit("")).alias("id"), docs[text_column].alias("text"))
    schema = T.StructType.fromDDL("word string, n long")
    parts = rows.mapInArrow(_count(altered, shortest, to_arrow_schema(schema)), schema)
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


# --- vectors ------------------------------------------------------------------


def vectors(words: list[str]) -> np.ndarray:
    """A row of ``LEVELS`` counts for each word."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    letters = _GROUP[np.frombuffer("".join(words).encode("latin-1"), np.uint8)]
    word = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(letters)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out = []
    for first in PARTS:
        on = slice(None) if first is None else place < first
        out.append(np.bincount(word[on] * WIDTH + letters[on], minlength=len(words) * WIDTH).reshape(-1, WIDTH))
    return np.minimum(np.concatenate(out, axis=1), 250).astype(np.int16)


def _spent(diff: np.ndarray, level: int, more: np.ndarray, less: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Queries that may go to a child whose count differs by ``diff`` from
    theirs, and their budgets there: whether a surplus and a deficit are spent."""
    if level % WIDTH == 0:
        more, less = np.zeros_like(more), np.zeros_like(less)
    lower = ~less & more if level < WIDTH else ~less  # a whole word's surplus comes first: the pair is found from one side
    on = (diff == 0) | (diff == 1) & ~more | (diff == -1) & lower
    return on, (more | (diff == 1))[on], (less | (diff == -1))[on]


# --- cells --------------------------------------------------------------------


def _paths(inner: frozenset, low: int, schema: pa.Schema):
    """Words below inner nodes -> their prefixes of the next levels, counted."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = vectors(batch.column("word").to_pylist()).astype(np.uint8)
            if low:
                rows = rows[[r[:low].tobytes() in inner for r in rows]]
            found = Counter(r[:d].tobytes() for r in rows for d in range(low + 1, min(low + STEP, LEVELS) + 1))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], schema=schema)
    return run


def skeleton(words: DataFrame, cell: int) -> dict[bytes, bool]:
    """Nodes above the cells and the cells themselves, as the path of counts
    that leads there: whether a node is divided. Divided nodes have more than
    ``cell`` words, so there are fewer than LEVELS * words / cell of them."""
    schema = T.StructType.fromDDL("path binary, n long")
    nodes: dict[bytes, bool] = {b"": True}
    inner = frozenset([b""])
    for low in range(0, LEVELS, STEP):
        found = words.select("word").mapInArrow(_paths(inner, low, to_arrow_schema(schema)), schema).groupBy("path").agg(F.sum("n").alias("n"))
        # A node counts if the one above it is divided; on the levels of this step that is known once all are counted.
        big = found.where(F.col("n") > cell).withColumn("path", F.hex("path"))
        above = big.select("path", "n").collect()  # divided nodes: bounded as stated
        divided = {bytes.fromhex(r["path"]) for r in above}
        up = F.expr("substring(path, 1, octet_length(path) - 1)")
        known = words.sparkSession.createDataFrame([(bytearray(p),) for p in (*(p for p in divided if len(p) < low + STEP), *inner)], "up binary")
        for r in found.select("path", up.alias("up")).join(F.broadcast(known), "up", "left_semi").select("path").toLocalIterator():
            nodes[bytes(r["path"])] = bytes(r["path"]) in divided and len(r["path"]) < LEVELS
        inner = frozenset(p for p in divided if len(p) == low + STEP and nodes.get(p))
        if not inner:
            break
    return nodes


def _route(nodes: dict[bytes, bool], schema: pa.Schema):
    children: dict[bytes, list[int]] = {}
    for path in nodes:
        if path:
            children.setdefault(path[:-1], []).append(path[-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = vectors(batch.column("word").to_pylist())
            cells, whose, own = [], [], []
            none = np.zeros(len(rows), bool)
            stack = [(b"", np.arange(len(rows)), none, none)]
            while stack:  # depth first
                path, q, more, less = stack.pop()
                level = len(path)
                for value in children.get(path, ()):
                    on, m, s = _spent(value - rows[q, level], level, more, less)
                    if not on.any():
                        continue
                    child = path + bytes([value])
                    if nodes[child]:
                        stack.append((child, q[on], m, s))
                    else:
                        cells += [child] * len(m)
                        whose.append(q[on])
            # As a word of its own cell: the path that its own counts take.
            homes = []
            for r in rows.astype(np.uint8):
                d = 0
                while nodes[r[:d].tobytes()]:
                    d += 1
                homes.append(r[:d].tobytes())
            at = np.concatenate([*whose, np.arange(len(rows))])
            own = np.arange(len(at)) >= len(cells)
            yield pa.RecordBatch.from_arrays([pa.array(cells + homes, pa.binary()), pa.array(own), batch.column("word").take(pa.array(at)),
                                              batch.column("n").take(pa.array(at))], schema=schema)
    return run


# --- a cell -------------------------------------------------------------------


def reached(words: np.ndarray, queries: np.ndarray, level: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(query, word) pairs within the budgets; ``words`` and ``queries`` are
    rows of counts, the words sorted. The trie's nodes are ranges of them."""
    found_q, found_w = [], []
    none = np.zeros(len(queries), bool)
    stack = [(0, len(words), 0, np.arange(len(queries)), none, none)] if len(words) and len(queries) else []
    while stack:
        lo, hi, level, q, more, less = stack.pop()
        if level == LEVELS or (hi - lo) * len(q) <= LEAF:
            step = max(1, LEAF // (hi - lo))
            for at in range(0, len(q), step):
                some = q[at:at + step]
                diff = words[None, lo:hi, :] - queries[some, None, :]
                up, down = np.maximum(diff, 0), np.maximum(-diff, 0)
                fits = np.ones(diff.shape[:2], bool)
                for part in range(len(PARTS)):
                    on = slice(part * WIDTH, part * WIDTH + WIDTH)
                    u, d = up[..., on].sum(-1), down[..., on].sum(-1)
                    fits &= (u <= 1) & (d <= 1)
                    if part == 0:
                        fits &= d <= u
                x, y = np.nonzero(fits)
                found_q.append(some[x])
                found_w.append(lo + y)
            continue
        column = words[lo:hi, level]
        starts = np.concatenate([[0], np.flatnonzero(column[1:] != column[:-1]) + 1, [hi - lo]])
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
            on, m, s = _spent(column[a] - queries[q, level], level, more, less)
            if on.any():
                stack.append((lo + a, lo + b, level + 1, q[on], m, s))
    if not found_q:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(found_q), np.concatenate(found_w)


class Letters:
    """Words as letters one after the other, to compare pairs from both ends."""

    def __init__(self, words: list[str]):
        self.size = np.fromiter(map(len, words), np.int64, len(words))
        self.start = np.cumsum(self.size) - self.size
        self.all = np.frombuffer("".join(words).encode("latin-1") + b"\0", np.uint8)

    def _agreed(self, i: np.ndarray, j: np.ndarray, step: int) -> np.ndarray:
        """Letters that agree from the front (step 1) or the back (-1)."""
        n = np.minimum(self.size[i], self.size[j])
        out, on, k = np.zeros(len(i), np.int64), np.arange(len(i)), 0
        x, y = (self.start[i], self.start[j]) if step == 1 else (self.start[i] + self.size[i] - 1, self.start[j] + self.size[j] - 1)
        while len(on):
            on = on[n[on] > k]
            on = on[self.all[x[on] + step * k] == self.all[y[on] + step * k]]
            k += 1
            out[on] = k
        return out

    def near(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether the words differ by one letter more, less or other."""
        if not len(i):
            return np.empty(0, bool)
        long = np.maximum(self.size[i], self.size[j])
        agreed = self._agreed(i, j, 1) + self._agreed(i, j, -1)
        same = (self.size[i] == self.size[j]) & (agreed >= 2 * long)
        return (np.abs(self.size[i] - self.size[j]) <= 1) & (agreed >= long - 1) & ~same


def _search(schema: pa.Schema):
    def run(cell: pa.Table) -> pa.Table:
        words, ns, own = cell.column("word").to_pylist(), cell.column("n").to_numpy(), cell.column("own").to_numpy()
        rows = vectors(words)
        home, asked = np.flatnonzero(own), np.flatnonzero(~own)
        home = home[np.lexsort(rows[home].T[::-1])]
        q, w = reached(rows[home], rows[asked])
        i, j = asked[q], home[w]
        letters, near = Letters(words), []
        for at in range(0, len(i), PAIRS):
            near.append(letters.near(i[at:at + PAIRS], j[at:at + PAIRS]))
        on = np.concatenate(near) if near else np.empty(0, bool)
        i, j = i[on], j[on]
        names = cell.column("word").combine_chunks()
        a, b = names.take(pa.array(i)), names.take(pa.array(j))
        # A pair counts from the side whose first differing count is the smaller; of equal counts from the smaller word.
        diff = rows[j, :WIDTH] - rows[i, :WIDTH]
        first = np.take_along_axis(diff, (diff != 0).argmax(axis=1)[:, None], axis=1)[:, 0]
        less = np.fromiter((words[x] < words[y] for x, y in zip(i.tolist(), j.tolist())), bool, len(i))
        once = np.flatnonzero((first > 0) | (first == 0) & less)
        return pa.table([a.take(pa.array(once)), pa.array(ns[i[once]]), b.take(pa.array(once)), pa.array(ns[j[once]])], schema=schema)
    return run


def near_pairs(words: DataFrame, cell: int | None = None) -> DataFrame:
    """(a, n_a, b, n_b): each pair of near words once. ``words``: (word, n), stored."""
    spark = words.sparkSession
    ship(spark)
    n = words.count()
    if cell is None:
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        cell = max(min(CELL, max(FEWEST, n // (4 * tasks))), LEVELS * n // SKELETON)
    schema = T.StructType.fromDDL("cell binary, own boolean, word string, n long")
    routed = words.select("word", "n").mapInArrow(_route(skeleton(words, cell), to_arrow_schema(schema)), schema)
    routed = written(routed, "routed")
    # Each cell's queries are dealt over copies of its words.
    asked = routed.where(~F.col("own")).groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(QUERIES)).cast("int").alias("copies"))
    asked = written(asked, "asked")
    dealt = routed.join(asked, "cell")
    salt = F.when(F.col("own"), F.sequence(F.lit(0), F.col("copies") - 1)).otherwise(F.array(F.pmod(F.xxhash64("word"), F.col("copies")).cast("int")))
    dealt = dealt.withColumn("salt", F.explode(salt)).drop("copies")
    out = T.StructType.fromDDL("a string, n_a long, b string, n_b long")
    return dealt.groupBy("cell", "salt").applyInArrow(_search(to_arrow_schema(out)), out)


# --- forms and roots ----------------------------------------------------------


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last of the forms that follow each other. Each form
    is ``RATIO`` times as frequent as the one before, so the steps are few and
    doubling takes the logarithm of them."""
    to = forms.select("word", F.col("form").alias("root"))
    while True:
        on = to.select(F.col("word").alias("root"), F.col("root").alias("__next"))
        met = written(to.join(on, "root", "left").select("word", F.coalesce("__next", "root").alias("root"), F.col("__next").isNotNull().alias("went")), "roots")
        to = met.select("word", "root")
        if met.where("went").isEmpty():
            return to


def variants(words: DataFrame, ratio: int = RATIO, cell: int | None = None) -> DataFrame:
    """Per word of ``words`` (word, n; stored): form, root, n, n_near, form_n."""
    pairs = written(near_pairs(words, cell), "pairs")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("other_n")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("other_n")))
    best = F.min(F.struct((-F.col("other_n")).alias("n"), "other"))
    near = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    often: Column = -F.col("best.n") >= ratio * F.col("n")
    told = words.join(near, "word", "left").select("word", F.when(often, F.col("best.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
                                                   F.when(often, -F.col("best.n")).alias("form_n"))
    told = written(told, "forms")
    roots = _roots(told.where(F.col("form").isNotNull()))
    return told.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(written(count_words(read(spark, sf_dir, "documents")), "words"))


#: crc32 of the bytes of a string: each goes in with eight shifts.
_CRC = ("xor(list_reduce(list_prepend(4294967295::BIGINT, flatten([[('0x' || substr({0}, 2 * i + 1, 2))::BIGINT, 0, 0, 0, 0, 0, 0, 0] for i in range(len({0}) // 2)])), "
        "lambda a, b: xor(xor(a, b) // 2, 3988292384 * (xor(a, b) % 2))), 4294967295::BIGINT)")

OP12_SQL = f"""
WITH RECURSIVE runs AS (
  SELECT id, run, count(*) AS n FROM (
    SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(unnest(regexp_extract_all(text, '{RUN}')), '{UPPER}', '{UPPER.lower()}') AS run FROM documents)
  GROUP BY id, run),
hashed AS (SELECT run, n, {_CRC.format("x")} AS h FROM (SELECT run, n, hex(encode(id || ':' || run)) AS x FROM runs)),
words AS (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT CASE WHEN h % {ALTERED} = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= {MIN_LENGTH} GROUP BY word HAVING sum(n) >= {MIN_COUNT}),
less AS (SELECT word, n, pos, substr(word, 1, pos - 1) || substr(word, pos + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS pos FROM words)),
near AS (
  SELECT a.word, b.word AS other FROM less a JOIN less b ON a.pos = b.pos AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT l.word, w.word FROM less l JOIN words w ON w.word = l.rest
  UNION SELECT w.word, l.word FROM less l JOIN words w ON w.word = l.rest),
best AS (SELECT e.word, count(*) AS n_near, max(w.n) AS most, first(e.other ORDER BY w.n DESC, e.other) AS other FROM near e JOIN words w ON w.word = e.other GROUP BY e.word),
told AS (
  SELECT w.word, CASE WHEN most >= {RATIO} * n THEN other END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= {RATIO} * n THEN most END AS form_n
  FROM words w LEFT JOIN best USING (word)),
walk AS (
  SELECT word, word AS at FROM told
  UNION ALL SELECT w.word, t.form FROM walk w JOIN told t ON t.word = w.at WHERE t.form IS NOT NULL)
SELECT t.word, t.form, w.at AS root, t.n, t.n_near, t.form_n
FROM told t JOIN walk w ON w.word = t.word JOIN told e ON e.word = w.at WHERE e.form IS NULL
"""
