"""Operators 11 to 13 against the library itself or brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tickwise.llm import idplanes, prefixtrie, spellings

# --- operator 11 ------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(idplanes.default_path())


def _wanted(rows, library):
    """Rows (id, text) in the order of the files -> (id, start, n_tokens, crc)."""
    out, start = [], 0
    for doc, text in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        out.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("kind,block", [("byte", 64), ("bit", 1000), ("byte", 65_536)])
def test_ids_come_back(spark, edge, library, tmp_path, kind, block):
    from pyspark.sql import functions as F
    clashing = edge.withColumns({c: F.lit("x") for c in ("start", "n_tokens", "shard", "chunk", "__row")})
    idplanes.write_ids(clashing, str(tmp_path / "t"), idplanes.default_path(), block=block, kind=kind, shards=3)
    got = sorted(map(tuple, idplanes.read_docs(spark, str(tmp_path / "t")).collect()), key=lambda r: r[1])
    order = edge.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()
    order = sorted(order, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["h"]))
    assert got == _wanted([(r["doc_id"], r["text"]) for r in order], library)


def test_range_of_ids(spark, docs, library, tmp_path):
    path = str(tmp_path / "t")
    idplanes.write_ids(docs, path, idplanes.default_path(), block=512, shards=4)
    texts = [r["text"] for r in docs.orderBy("doc_id").collect()]
    ids = [i for t in texts for i in [*library.encode(t or "", add_special_tokens=False).ids, 0]]
    for lo, hi in ((0, 10), (500, 2000), (len(ids) - 3, len(ids) + 9), (7, 7)):
        got = idplanes.read_ids(spark, path, lo, hi).orderBy("place").collect()
        assert [r["id"] for r in got] == ids[lo:hi]
        assert [r["place"] for r in got] == list(range(lo, min(hi, len(ids))))
    index = spark.read.parquet(f"{path}/index").orderBy("start").collect()
    assert sum(r["n_ids"] for r in index) == len(ids) and all(len(r["plane_bytes"]) == 4 for r in index)


def test_no_documents(spark, no_docs, tmp_path):
    idplanes.write_ids(no_docs, str(tmp_path / "t"), idplanes.default_path())
    assert idplanes.read_docs(spark, str(tmp_path / "t")).collect() == []


def test_one_id_in_many_shards(spark, tmp_path):
    rows = spark.range(0, 3000, 1, 8).selectExpr("7L doc_id", "concat('text ', id % 3) text")
    idplanes.write_ids(rows, str(tmp_path / "t"), idplanes.default_path(), shards=6)
    sizes = spark.read.parquet(str(tmp_path / "t") + "/chunks").groupBy("shard").sum("n_ids").collect()
    assert len(sizes) >= 4  # equal rows are dealt over shards
    got = idplanes.read_docs(spark, str(tmp_path / "t")).orderBy("start").collect()
    assert len(got) == 3000 and all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(got, got[1:]))


def test_encoder_against_library(library):
    import pyarrow as pa
    draw = random.Random(5)
    signs = ["a", "B", " ", "  ", "\n", "\t", "!", "é", "1", "'s", "<|endoftext|>", "\x1c", "　", "漢", "🙂", "_", ".", "\x01", "×", " b", "\nd", "xyz" * 30]
    texts = [None, "", *("".join(draw.choices(signs, k=draw.randint(0, 14))) for _ in range(4000))]
    ids, counts = idplanes.Encoder(idplanes.default_path()).encode(pa.array(texts))
    want = [[*e.ids, 0] for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert counts.tolist() == [len(w) for w in want]
    assert ids.tolist() == [i for w in want for i in w]


def test_planes_and_checksums():
    ids = np.random.default_rng(1).integers(0, 1 << 32, 777, dtype=np.uint32)
    for kind in ("byte", "bit"):
        for n in (0, 1, 8, 777):
            assert (idplanes.from_planes(idplanes.to_planes(ids[:n], kind), n, kind) == ids[:n]).all()
    a, b = bytes(range(250)), b"some more" * 1000
    assert idplanes.shifted_crc(zlib.crc32(a), len(b)) ^ zlib.crc32(b) == zlib.crc32(a + b)
    with pytest.raises(ValueError):
        idplanes.to_planes(ids, "nibble")


# --- operator 12 ------------------------------------------------------------------


def _near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def _variants(n):
    near = defaultdict(list)
    words = sorted(n)
    for i, a in enumerate(words):
        for b in words[i + 1:]:
            if _near(a, b):
                near[a].append(b)
                near[b].append(a)
    form = {}
    for w in words:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])
    return {(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in words}


@pytest.mark.parametrize("cell", [3, 40, 100_000])
def test_variants_against_brute_force(spark, cell):
    draw = random.Random(11)
    words = {"".join(draw.choices("aabeéÿ×", k=draw.randint(6, 9))) for _ in range(250)}
    for w in list(words):
        i = draw.randrange(len(w))
        words |= {w[:i] + w[i + 1:], w[:i] + "ß" + w[i:], w[:i] + "t" + w[i + 1:]}
    words |= {"aaaaaabbbbbb", "bbbbbbaaaaaa", "abababababab", "abababababaa", "e" * 300, "e" * 301, "e" * 299 + "t"}
    n = {w: 5 ** draw.randint(0, 5) for w in words if len(w) >= 6}
    table = spark.createDataFrame(list(n.items()), "word string, n long").repartition(3)
    from tickwise.llm.common import written
    got = spellings.variants(written(table, "words"), cell=cell)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = list(map(tuple, got.collect()))
    assert len(rows) == len(n) and set(rows) == _variants(n)


def test_words_counted(spark, edge, edge_rows):
    want = Counter()
    for doc, text, *_ in edge_rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            want[run[:h % len(run)] + run[h % len(run) + 1:] if h % 3 == 0 else run] += 1
    got = spellings.count_words(edge, altered=3, shortest=2, least=2).collect()
    assert {(r["word"], r["n"]) for r in got} == {(w, n) for w, n in want.items() if len(w) >= 2 and n >= 2}


def test_no_words(spark, no_docs):
    from tickwise.llm.common import written
    assert spellings.variants(written(spellings.count_words(no_docs), "words")).collect() == []


# --- operator 13 ------------------------------------------------------------------

TURNS = [
    (20, 2, "user", "b c"), (20, 1, "user", "a a a"), (20, None, "system", "be good"), (20, 3, None, None), (21, 1, "user", "own"), (21, 2, "user", "own  two"),
    (21, 3, "user", "own 3"), (21, 3, "user", "own 3"), (None, 1, "user", "nobody"), (22, 1, "user", "x y"), (23, 1, "user", "x y"), (24, 1, None, ""), (45, 1, "u", "base is absent"),
    (-7, 1, "u", "below zero"), (-20, 1, "u", "base below zero"), (0, 1, "u", "zero"), (0, 2, "u", "zero " * 30_000), *[(c, t, "user", f"copy {t}") for c in range(100, 160) for t in range(5)],
]


def _trie(turns):
    own = defaultdict(list)
    for c, t, r, x in turns:
        if c is not None:
            r, x = r or "", x or ""
            own[c].append((t is not None, t or 0, hashlib.md5(f"{len(r)}:{r}{x}".encode()).hexdigest(), r, x))
    own = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in own.items()}
    members, size = defaultdict(list), {}
    for c in own:
        h, base = zlib.crc32(str(c).encode()) % 4, c - (c % 20 if c >= 0 else -(-c % 20))
        path = tuple(own.get(base, [])[:h] + own[c][h:])
        size[c] = len(path)
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    kids = Counter(p[:-1] for p in members if p)
    out = []
    for p, ms in members.items():
        below = [q for q in members if q[:len(p)] == p]
        saved = sum((len(members[q]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", q[-1][1])) for q in below if q)
        ends = ",".join(str(c) for c in sorted(ms) if size[c] == len(p))
        out.append((min(ms), len(p), min(members[p[:-1]]) if p else None, len(ms), kids[p], sum(not kids[q] for q in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("shards", [1, 2, 9, 200, None])
def test_trie_against_brute_force(spark, shards):
    from tickwise.llm.common import written
    table = spark.createDataFrame([(*t, "k", 1) for t in TURNS], "conv_id long, turn long, role string, text string, key string, words int").repartition(3)
    stored = written(prefixtrie.paths(prefixtrie.rebuilt(prefixtrie.conversations(table))), "paths")
    got = prefixtrie.prefix_trie(stored, shards)
    assert sorted(map(tuple, got.collect()), key=str) == _trie(TURNS)


def test_equal_paths_are_split(spark):
    from tickwise.llm.common import written
    copies = spark.range(0, 400).selectExpr("id conv_id", "unhex(repeat(md5('x'), 3)) key", "array(1, 2, 3) words")
    stored = written(copies, "paths")
    ends = prefixtrie.splitters(stored, 4)
    assert len(ends) == 3 and {len(k) for k, _ in ends} == {48}
    got = {r["depth"]: r for r in prefixtrie.prefix_trie(stored, 4).collect()}
    assert [got[d]["n_convs"] for d in range(4)] == [400] * 4 and got[0]["saved_tokens"] == 399 * 6
    assert got[3]["ends_sha256"] == hashlib.sha256(",".join(map(str, range(400))).encode()).hexdigest()


def test_long_lists_of_ends(monkeypatch):
    monkeypatch.setattr(prefixtrie, "ENDS", 7)
    trie = prefixtrie._Trie(b"x" * 16, None)
    for c in range(30):
        trie.add(b"x" * 16, c, [1])
    lists = [r for r in trie.rows(5) if r[0] == prefixtrie.LIST]
    assert len(lists) == 5 and ",".join(r[-1] for r in lists) == ",".join(map(str, range(30)))


def test_no_conversations(spark):
    from tickwise.llm.common import written
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefixtrie.prefix_trie(written(prefixtrie.paths(prefixtrie.rebuilt(prefixtrie.conversations(none))), "paths")).collect() == []
