"""N-gram Jaccard join by parity sketches (operator 5).

A document's set of word shingles is XOR-hashed into a bit sketch: a shingle
flips one bit, so the sketches of two sets differ in at most as many bits as
the sets differ in shingles. The sketch is long (n segments of 2^64 / n bits,
kept sparsely), and a segment is known by the XOR of its set bits' hashes.
With J >= t, sets of a and b shingles differ in at most
(a + b)(1 - t)/(1 + t) shingles, hence their sketches in at most as many
segments: a set of m shingles can afford d = m(1 - t)/t damaged segments.
The number of segments depends on the size band (powers of two); a set whose
partners may lie in the next band is sketched in both.

Pigeonhole, on E non-empty segments of a set, with E > d:

1. All segments meet by fingerprint. A set that shares fewer than E - d
   segments with other sets has no partner and ends here.
2. In an order of the segments by frequency, two partners agree in one of
   their first d + 1 segments each; segments that nobody shares come first
   and cost nothing, so few remain, the rarest shared ones.
3. Sets that agree in such a segment are candidates if their sizes fit and a
   second, dense sketch (4 to 8 bits a shingle; the longer of two is folded)
   doesn't already differ in more bits than the sets may. First every set is
   held against one hub of its segments, the set with the most common ones;
   then against the nearest set of every other group; at last all pairs that
   are still apart. Candidates are verified on the whole sets of shingles. A
   pair that is known to be connected would change nothing, so it is left out.

A segment that more than ``HOT`` sets have among their first (of a template, say)
is left to a second pigeonhole, on whole shingles: of m shingles, at most
m(1 - t) are not the partner's, so two partners among the sets of hot segments
agree in one of their first m(1 - t) + 1 shingles each, the rarest among these
sets first. Shingles that nobody shares count against a set: the smaller of two
partners has 2 t / (1 + t) of its shingles in common, so pairs of sets that both
share less are left out, as none can link. A shingle that more than ``BLOCK``
sets have even so is cut into blocks of about so many, and each pair of blocks
meets by itself.

Segments travel packed (4 bytes each and a bucket) between tasks; buckets are
as many as the texts need. Equal sets are one set throughout. If a set had
E <= d segments (the bands make that all but impossible), the sketches are
made again with more segments, so no link is lost.

Cases: null, empty and blank texts have an empty set, linked with nothing; a
text of fewer words than a shingle is one shingle; equal texts are linked;
rows with a null id are linked with nothing (component null); a row repeated
with its id appears as often in the result; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickwise.llm.common import UPPER, distinct, mix64, read, segments, written
from tickwise.llm.components import components
from tickwise.llm.shingles import shingle_sets

SEGMENT_CHARS = 2_000_000  # of text sketched at a time
BUCKET_BYTES = 16_000_000  # of text whose segments make one bucket, about
SMALL_BAND = 7  # sets below 2^7 shingles: a segment a bit, nearly
SMALL_GROUP = 64  # sets of a segment up to which groups are paired together
CHUNK_WORDS = 1 << 21  # words of dense sketches compared at a time
MEMBERS = 250_000  # (segment, set) rows of a candidate bucket, about
HOT = 5_000  # sets that a segment may have; those of a hotter one meet by shingles
BLOCK = 50_000  # sets that a shingle may have; those of a hotter one meet in pairs of blocks of so many
FEW_IDS = 4_000_000  # ids up to which they are broadcast (32 MB)
_K1, _K2, _K3 = (np.uint64(k) for k in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3))
_META = np.dtype([("key", "<u8"), ("sid", "<u8"), ("m", "<u4"), ("e", "<u4")])

ROWS = "kind int, bucket int, doc_id long, n long, sid long, weak boolean, payload binary"


def allowed(m: np.ndarray, num: int, den: int) -> np.ndarray:
    """Shingles (so segments) in which a set of m can differ from a partner."""
    most = m * den // num  # shingles of the largest partner
    return (m + most) * (den - num) // (den + num)


def _sketch(h: np.ndarray, offsets: np.ndarray, num: int, den: int, finer: int):
    """(key, set number, m, E) of every entry - a set in a band - and its
    segments: entry number and fingerprint."""
    m = np.diff(offsets)
    some = np.flatnonzero(m)
    band = np.maximum(np.floor(np.log2(m[some] + 0.5)).astype(np.int64), SMALL_BAND - 1)
    up = m[some] * den // num >= 2 << band
    sets, bands = np.concatenate([some, some[up]]), np.concatenate([band, band[up] + 1])
    order = np.lexsort((bands, sets))
    sets, bands = sets[order], bands[order]
    size = m[sets]
    entry = np.repeat(np.arange(len(sets)), size)
    at = np.arange(len(entry)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(offsets[sets], size)
    token = h[at]
    # At most 1.4 shingles a segment on average: then E is far above d for thresholds near 3/4.
    n = np.where(bands < SMALL_BAND, 1 << 31, np.minimum((10 << bands) // 7 * finer, 1 << 31)).astype(np.uint64)
    segment = ((token >> np.uint64(32)) * n[entry]) >> np.uint64(32)
    new = np.ones(len(entry), bool)
    new[1:] = (entry[1:] != entry[:-1]) | (segment[1:] != segment[:-1])
    starts = np.flatnonzero(new)
    odd = np.bitwise_xor.reduceat(mix64(token ^ _K1), starts) if len(starts) else np.empty(0, np.uint64)
    entry = entry[starts]
    fingerprint = mix64(odd ^ mix64(segment[starts] * _K2 + bands[entry].astype(np.uint64) * _K3))
    return sets, bands, size, np.bincount(entry, minlength=len(sets)), entry, fingerprint


def _set_ids(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    m = np.diff(offsets)
    out = np.zeros(len(m), np.uint64)
    some = np.flatnonzero(m)
    if len(some):
        out[some] = mix64(np.add.reduceat(mix64(h ^ _K2), offsets[some]) ^ mix64(np.bitwise_xor.reduceat(mix64(h ^ _K3), offsets[some])) ^ m[some].astype(np.uint64))
    return out


def _groups(sorted_values: np.ndarray) -> np.ndarray:
    """Starts of runs of equal values, and the end."""
    if not len(sorted_values):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1, [len(sorted_values)]])


def _dealt(owner: np.ndarray, bucket: np.ndarray, keys: np.ndarray, columns: tuple[np.ndarray, ...]) -> Iterator[tuple[int, bytes]]:
    """Packs rows by bucket: number of owners, their keys, their row counts, then the columns."""
    order = np.lexsort((owner, bucket))
    owner, bucket, columns = owner[order], bucket[order], [c[order] for c in columns]
    cuts = _groups(bucket)
    for a, b in zip(cuts[:-1], cuts[1:]):
        runs = _groups(owner[a:b])
        who = keys[owner[a:b][runs[:-1]]]
        yield int(bucket[a]), b"".join([np.array([len(who), b - a], np.uint32).tobytes(), who.tobytes(), np.diff(runs).astype(np.uint32).tobytes(), *(c[a:b].tobytes() for c in columns)])


def _opened(payloads: list[bytes], kinds: tuple[str, ...]) -> list[np.ndarray]:
    """What ``_dealt`` packed: the keys, the number of rows of each, the columns."""
    out = [[] for _ in range(2 + len(kinds))]
    for p in payloads:
        owners, rows = np.frombuffer(p, np.uint32, 2).tolist()
        out[0].append(np.frombuffer(p, np.uint64, owners, 8))
        at = 8 + 8 * owners
        out[1].append(np.frombuffer(p, np.uint32, owners, at))
        at += 4 * owners
        for part, kind in zip(out[2:], kinds):
            part.append(np.frombuffer(p, kind, rows, at))
            at += rows * np.dtype(kind).itemsize
    return [np.concatenate(o) if o else np.empty(0, k) for o, k in zip(out, (np.uint64, np.uint32, *kinds))]


def _table(kind: int, rows: list[tuple[int, bytes]]) -> dict:
    n = len(rows)
    return {"kind": pa.array([kind] * n, pa.int32()), "bucket": pa.array([b for b, _ in rows], pa.int32()), "doc_id": pa.nulls(n, pa.int64()), "n": pa.nulls(n, pa.int64()),
            "sid": pa.nulls(n, pa.int64()), "weak": pa.nulls(n, pa.bool_()), "payload": pa.array([p for _, p in rows], pa.binary())}


def _sketches(buckets: int, words: int, num: int, den: int, finer: int):
    """Texts -> rows of kind 2 (a document), 0 (entries, by key) and 1 (segments, by fingerprint)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in segments(batches, "text", SEGMENT_CHARS):
            h, offsets = shingle_sets(texts, words)
            sids = _set_ids(h, offsets)
            ids = batch.column("doc_id").cast(pa.int64())
            m = np.diff(offsets)
            # Sketch each set once; sets of rows without an id not at all.
            first = np.zeros(len(m), bool)
            known = np.flatnonzero(np.asarray(ids.is_valid()))
            first[known[np.unique(sids[known], return_index=True)[1]]] = True
            first &= m > 0
            picked = np.flatnonzero(first)
            own = np.concatenate([[0], np.cumsum(m[picked])])
            h = h[np.repeat(first, m)]
            sets, bands, size, e, entry, fp = _sketch(h, own, num, den, finer)
            keys = mix64(sids[picked][sets] + bands.astype(np.uint64) * _K1)
            weak = np.zeros(len(m), bool)
            weak[picked[sets[e <= allowed(size, num, den)]]] = True
            yield pa.RecordBatch.from_pydict({"kind": pa.array(np.full(len(m), 2, np.int32)), "bucket": pa.array((sids % np.uint64(buckets)).astype(np.int32)), "doc_id": ids,
                                              "n": pa.array(m), "sid": pa.array(sids.view(np.int64)), "weak": pa.array(weak), "payload": pa.nulls(len(m), pa.binary())})
            if not len(sets):
                continue
            meta = np.zeros(len(sets), _META)
            meta["key"], meta["sid"], meta["m"], meta["e"] = keys, sids[picked][sets], size, e
            home = (keys % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(home, kind="stable")
            cuts = _groups(home[order])
            rows = [(int(home[order[a]]), meta[order[a:b]].tobytes()) for a, b in zip(cuts[:-1], cuts[1:])]
            yield pa.RecordBatch.from_pydict(_table(0, rows))
            rows = list(_dealt(entry, ((fp >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64), keys, (fp.astype(np.uint32),)))
            yield pa.RecordBatch.from_pydict(_table(1, rows))
    return run


def _shared(buckets: int):
    """Segments of one bucket -> those that more than one set has, with their frequency, by key."""
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        kinds = table.column("kind").to_numpy()
        rest = table.filter(pa.array(kinds != 1))
        keys, rows, fp = _opened(table.filter(pa.array(kinds == 1)).column("payload").to_pylist(), ("<u4",))
        if not len(keys):
            return rest
        known, number = np.unique(keys, return_inverse=True)
        both = distinct(fp.astype(np.uint64) << np.uint64(32) | np.repeat(number.astype(np.uint64), rows))
        fp, number = (both >> np.uint64(32)).astype(np.uint32), (both & np.uint64(0xFFFFFFFF)).astype(np.int64)
        runs = np.diff(_groups(fp))
        often = np.repeat(runs, runs)
        fp, number, often = fp[often > 1], number[often > 1], often[often > 1]
        bucket = np.full(len(fp), int(key[0].as_py()), np.uint32)
        home = (known % np.uint64(buckets)).astype(np.int64)
        rows = list(_dealt(number, home[number], known, (fp, often.astype(np.uint32), bucket)))
        return pa.concat_tables([rest, pa.Table.from_pydict(_table(1, rows), schema=rest.schema)]) if rows else rest
    return run


PREFIX = "sid long, m long, common double, smaller boolean, segments binary, hot binary"


def _prefixes(num: int, den: int, hot: int, whole: bool = False):
    """Entries of one bucket with their shared segments -> (sid, m, mean frequency of its
    segments, whether it can be the smaller of two partners, first shared segments, those of
    them with a frequency above ``hot``) of sets that can have a partner. ``whole``: the
    segments are single shingles, so what nobody shares is known not to be a partner's."""
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        kinds = table.column("kind").to_numpy()
        meta = np.concatenate([np.frombuffer(p, _META) for p in table.filter(pa.array(kinds == 0)).column("payload").to_pylist()] or [np.empty(0, _META)])
        meta = meta[np.unique(meta["key"], return_index=True)[1]]
        keys, rows, fp, often, bucket = _opened(table.filter(pa.array(kinds == 1)).column("payload").to_pylist(), ("<u4", "<u4", "<u4"))
        keys = np.repeat(keys, rows)
        order = np.lexsort((fp, bucket, often, keys))
        keys, segment, often = keys[order], bucket[order].astype(np.uint64) << np.uint64(32) | fp[order].astype(np.uint64), often[order]
        cuts = _groups(keys)
        found = meta[np.searchsorted(meta["key"], keys[cuts[:-1]])] if len(keys) else meta[:0]
        shared = np.diff(cuts)
        size = found["m"].astype(np.int64)
        spare = size * (den - num) // den if whole else allowed(size, num, den)  # a partner has num / den of the shingles at least
        go = shared >= np.maximum(found["e"].astype(np.int64) - spare, 1)
        take = np.minimum(spare + 1 - (found["e"] - shared), shared)  # those that nobody shares come first
        common = (np.add.reduceat(often.astype(np.float64), cuts[:-1]) + found["e"] - shared) / found["e"] if len(keys) else np.empty(0)
        smaller = (size - found["e"] + shared) * (den + num) >= 2 * num * size if whole else np.ones(len(size), bool)
        chosen = np.flatnonzero(go)
        ends = cuts[:-1] + take
        calm = np.concatenate([[0], np.cumsum(often <= hot)])  # the frequent ones come last
        turns = np.minimum(cuts[:-1] + calm[cuts[1:]] - calm[cuts[:-1]], ends)
        return pa.Table.from_pydict({
            "sid": pa.array(found["sid"][chosen].view(np.int64)), "m": pa.array(found["m"][chosen].astype(np.int64)), "common": pa.array(common[chosen]), "smaller": pa.array(smaller[chosen]),
            "segments": pa.array([segment[cuts[i]:turns[i]].tobytes() for i in chosen.tolist()], pa.binary()),
            "hot": pa.array([segment[turns[i]:ends[i]].tobytes() for i in chosen.tolist()], pa.binary())})
    return run


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets -> their frequent segments, counted."""
    for batch in batches:
        segment, n = np.unique(np.frombuffer(b"".join(batch.column("hot").to_pylist()), np.uint64), return_counts=True)
        yield pa.RecordBatch.from_pydict({"segment": pa.array(segment.view(np.int64)), "n": pa.array(n)})


def _hot(prefixes: DataFrame, hot: int) -> tuple[np.ndarray, np.ndarray]:
    """The segments that more than ``hot`` sets have among their first, and how many have them."""
    found = prefixes.select("hot").where(F.octet_length("hot") > 0).mapInArrow(_meetings, "segment long, n long").groupBy("segment").agg(F.sum("n").alias("n")).where(F.col("n") > hot).collect()
    segment, n = np.array([r["segment"] for r in found], np.int64).view(np.uint64), np.array([r["n"] for r in found], np.int64)
    order = np.argsort(segment)
    return segment[order], n[order]


def _parted(shared):
    """Sets whose ``hot`` keeps the segments that are hot indeed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [np.frombuffer(p, np.uint64) for p in batch.column("hot").to_pylist()]
            among = [np.isin(p, shared.value) for p in parts]
            calm = [s + p[~a].tobytes() for s, p, a in zip(batch.column("segments").to_pylist(), parts, among)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(calm, pa.binary()), pa.array([p[a].tobytes() for p, a in zip(parts, among)], pa.binary())], names=batch.schema.names)
    return run


def _singly(buckets: int):
    """Sets -> rows as of ``_sketches``, each shingle a segment."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [np.frombuffer(p, np.uint64) for p in batch.column("shingles").to_pylist()]
            if not parts:
                continue
            sids, m = batch.column("sid").to_numpy().view(np.uint64), np.array([len(p) for p in parts])
            h, owner = mix64(np.concatenate(parts) ^ _K3), np.repeat(np.arange(len(parts)), m)
            bucket, fp = ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64), h & np.uint64(0xFFFFFFFF)
            order = np.lexsort((fp, bucket, owner))
            owner, bucket, fp = owner[order], bucket[order], fp[order]
            new = np.ones(len(owner), bool)
            new[1:] = (owner[1:] != owner[:-1]) | (bucket[1:] != bucket[:-1]) | (fp[1:] != fp[:-1])
            owner, bucket, fp = owner[new], bucket[new], fp[new]
            meta = np.zeros(len(parts), _META)
            meta["key"], meta["sid"], meta["m"], meta["e"] = sids, sids, m, np.bincount(owner, minlength=len(parts))
            home = (sids % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(home, kind="stable")
            cuts = _groups(home[order])
            yield pa.RecordBatch.from_pydict(_table(0, [(int(home[order[a]]), meta[order[a:b]].tobytes()) for a, b in zip(cuts[:-1], cuts[1:])]))
            yield pa.RecordBatch.from_pydict(_table(1, list(_dealt(owner, bucket, sids, (fp.astype(np.uint32),)))))
    return run


def _cooled(prefixes: DataFrame, sets: DataFrame, num: int, den: int, hot: int, block: int) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """Instead of a hot segment, the sets that have one get their rarest shingles (among
    these sets): partners agree in one of the first m - num / den m + 1 of each. Then the
    shingles that are hot still, and how many sets have them."""
    busy, _ = _hot(prefixes, hot)
    calm = prefixes.withColumn("segments", F.concat("segments", "hot"))
    if not len(busy):
        return calm, busy, busy.astype(np.int64)
    parted = written(prefixes.mapInArrow(_parted(prefixes.sparkSession.sparkContext.broadcast(busy)), PREFIX), "parted")
    among = written(parted.where(F.octet_length("hot") > 0).select("sid").distinct(), "among")
    members = sets.join(F.broadcast(among) if among.count() <= FEW_IDS else among, "sid", "left_semi").select("sid", "shingles")
    size = members.agg(F.sum(F.octet_length("shingles"))).first()[0] or 0
    buckets = max(1, -(-size // BUCKET_BYTES))
    met = members.mapInArrow(_singly(buckets), ROWS).groupBy("bucket").applyInArrow(_shared(buckets), ROWS)
    rare = written(met.groupBy("bucket").applyInArrow(_prefixes(num, den, block, whole=True), PREFIX), "rare")
    busy, n = _hot(rare, block)
    return parted.where(F.octet_length("segments") > 0).unionByName(rare.withColumn("segments", F.concat("segments", "hot"))), busy, n


def _in_blocks(segment: np.ndarray, owner: np.ndarray, sid: np.ndarray, busy: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sets of a hot segment fall into blocks, and each pair of blocks is a segment of
    its own: a set is in those of its block with every other."""
    if not len(busy):
        return segment, owner
    at = np.minimum(np.searchsorted(busy, segment), len(busy) - 1)
    n = np.where(busy[at] == segment, blocks[at], 1)
    split = np.flatnonzero(n > 1)
    copies = n[split]
    own = (mix64(sid[owner[split]].view(np.uint64) ^ _K2) % copies.astype(np.uint64)).astype(np.int64)
    row = np.repeat(np.arange(len(split)), copies)
    other = np.arange(len(row)) - np.repeat(np.cumsum(copies) - copies, copies)
    row, other = row[other != own[row]], other[other != own[row]]
    pair = np.minimum(own[row], other) * copies[row] + np.maximum(own[row], other)
    dealt = mix64(segment[split][row] ^ mix64(pair.astype(np.uint64) ^ _K3))
    return np.concatenate([segment[n == 1], dealt]), np.concatenate([owner[n == 1], owner[split][row]])


def dense_sketch(shingles: np.ndarray) -> np.ndarray:
    """Parity bits of a set, 4 to 8 a shingle, as 64-bit words (a power of two)."""
    words = 1 << max(0, int(len(shingles) - 1).bit_length() - 4)
    place = mix64(shingles ^ _K1)
    bit = np.uint64(1) << (place & np.uint64(63))
    at = (place >> np.uint64(6) & np.uint64(words - 1)).astype(np.int64)
    out = np.zeros(words, np.uint64)
    np.bitwise_xor.at(out, at, bit)
    return out


def folded(sketch: np.ndarray, words: int) -> np.ndarray:
    """The sketch that the same set has with fewer words."""
    while len(sketch) > words:
        sketch = sketch[:len(sketch) // 2] ^ sketch[len(sketch) // 2:]
    return sketch


def _members(buckets: int, shared):
    """Sets with their segments -> packs by segment bucket: a table of the sets, and (segment, row in it)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [np.frombuffer(p, np.uint64) for p in batch.column("segments").to_pylist()]
            sketches = batch.column("sketch").to_pylist()
            own = {c: batch.column(c).to_numpy() for c in ("sid", "comp", "m", "common")}
            smaller = batch.column("smaller").to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
            segment = np.concatenate(parts) if parts else np.empty(0, np.uint64)
            segment, owner = _in_blocks(segment, owner, own["sid"], *shared.value)
            home = (mix64(segment) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(home, kind="stable")
            cuts = _groups(home[order])
            rows = []
            for a, b in zip(cuts[:-1], cuts[1:]):
                at = order[a:b]
                who, number = np.unique(owner[at], return_inverse=True)
                rows.append((int(home[at[0]]), pickle.dumps((segment[at], number.astype(np.int32), smaller[owner[at]], *(own[c][who] for c in own), [sketches[i] for i in who.tolist()]))))
            yield pa.RecordBatch.from_pydict({"bucket": pa.array([r[0] for r in rows], pa.int32()), "payload": pa.array([r[1] for r in rows], pa.binary())})
    return run


def _bits_apart(x: np.ndarray, y: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
    """Bits in which the dense sketches of the sets x[i] and y[i] differ, the longer folded."""
    out = np.zeros(len(x), np.int64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    short = np.minimum(sizes[x], sizes[y])
    for n in np.unique(short).tolist():
        at = np.flatnonzero(short == n)
        who = distinct(np.concatenate([x[at], y[at]]))
        bits = np.stack([folded(words[i], n) for i in who.tolist()])
        for i in range(0, len(at), step := max(1, CHUNK_WORDS // n)):
            some = at[i:i + step]
            out[some] = np.bitwise_count(bits[np.searchsorted(who, x[some])] ^ bits[np.searchsorted(who, y[some])]).sum(axis=1, dtype=np.int64)
    return out


def _pairs_of(owner: np.ndarray, smaller: np.ndarray, cuts: np.ndarray, comp: np.ndarray, fits) -> Iterator[np.ndarray]:
    """Pairs of sets that agree in a segment, fit, one of which can be the smaller of
    two partners by it, and that are of different components, as x * sets + y
    with x < y; in parts of bounded size, a pair may come again."""
    n = np.int64(len(comp))

    def coded(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        go = (comp[a] != comp[b]) & fits(a, b)
        a, b = a[go], b[go]
        return np.minimum(a, b) * n + np.maximum(a, b)

    sizes = np.diff(cuts)
    group = np.repeat(np.arange(len(sizes)), sizes)
    for k in range(1, sizes[sizes <= SMALL_GROUP].max(initial=0)):  # small groups together: rows k apart
        at = np.flatnonzero((group[k:] == group[:-k]) & (sizes[group[k:]] <= SMALL_GROUP) & (smaller[k:] | smaller[:-k]))
        for i in range(0, len(at), 1_000_000):
            yield coded(owner[at[i:i + 1_000_000]], owner[at[i:i + 1_000_000] + k])
    seen = set()
    for g in np.flatnonzero(sizes > SMALL_GROUP).tolist():
        members = distinct(owner[cuts[g]:cuts[g + 1]])
        can = np.isin(members, owner[cuts[g]:cuts[g + 1]][smaller[cuts[g]:cuts[g + 1]]])
        if (mark := hashlib.blake2b(members.tobytes() + can.tobytes(), digest_size=16).digest()) in seen:  # near copies meet in many segments: once is enough
            continue
        seen.add(mark)
        parts, of, many = np.unique(comp[members], return_inverse=True, return_counts=True)
        small = of.reshape(-1) != many.argmax()  # of each pair one is outside the largest component
        for some, others in ((members[small & can], members), (members[small & ~can], members[can])):
            for i in range(0, len(some), step := max(1, 1_000_000 // max(1, len(others)))):
                x = some[i:i + step]
                yield coded(np.repeat(x, len(others)), np.tile(others, len(x)))


def _candidates(mode: str, num: int, den: int):
    """Candidates (u, v, kind, score) between sets of different components that
    agree in a segment of this bucket: per set its hub; per set the nearest
    one (kind 0), and the nearest of the largest component around (kind 1); or
    all. The lowest score of a set and kind is the best over all buckets."""
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        segment, owner, smaller, sid, comp, m, common, sketches, n = [], [], [], [], [], [], [], [], 0
        for p in table.column("payload").to_pylist():
            seg, number, can, *columns, some = pickle.loads(p)
            segment.append(seg)
            owner.append(number.astype(np.int64) + n)
            smaller.append(can)
            for whole, part in zip((sid, comp, m, common), columns):
                whole.append(part)
            sketches += some
            n += len(some)
        segment, owner, smaller, sid, comp, m, common = (np.concatenate(c) for c in (segment, owner, smaller, sid, comp, m, common))
        # A set sketched in two bands is one set. Numbers by hub order: the most common first.
        _, first, same = np.unique(sid, return_index=True, return_inverse=True)
        order = np.lexsort((sid[first], -common[first]))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        owner = place[same.reshape(-1)[owner]]
        first = first[order]
        sid, comp, m = sid[first], np.unique(comp[first], return_inverse=True)[1].reshape(-1), m[first]
        words = [np.frombuffer(sketches[i], np.uint64) for i in first.tolist()]
        order = np.lexsort((owner, segment))
        segment, owner, smaller = segment[order], owner[order], smaller[order]
        cuts = _groups(segment)
        mixed = (np.minimum.reduceat(comp[owner], cuts[:-1]) < np.maximum.reduceat(comp[owner], cuts[:-1])) & np.logical_or.reduceat(smaller, cuts[:-1]) if len(owner) else np.empty(0, bool)
        live = np.repeat(mixed, np.diff(cuts))
        segment, owner, smaller = segment[live], owner[live], smaller[live]
        cuts = _groups(segment)
        sets = np.int64(len(sid))

        def fits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            return (m[a] * den >= num * m[b]) & (m[b] * den >= num * m[a])

        def near(codes: np.ndarray) -> np.ndarray:
            """(x, y, bits apart) of the pairs whose dense sketches may belong to partners."""
            x, y = codes // sets, codes % sets
            apart = _bits_apart(x, y, words)
            ok = apart * (den + num) <= (m[x] + m[y]) * (den - num)
            return np.stack([x[ok], y[ok], apart[ok]], 1)

        if mode == "hub":
            head = np.repeat(owner[cuts[:-1]], np.diff(cuts)) if len(owner) else owner
            go = (comp[owner] != comp[head]) & fits(owner, head)
            found = near(distinct(owner[go] * sets + head[go]))
            found = found[np.lexsort((found[:, 1], found[:, 0]))]
            pairs = found[_groups(found[:, 0])[:-1], :2]
            pairs = np.column_stack([pairs, np.zeros(len(pairs), np.int64)])
            score = -common[first][pairs[:, 1]]
        else:
            size = np.bincount(comp, minlength=1)
            held, pairs = [], np.empty((0, 3), np.int64)
            for part in _pairs_of(owner, smaller, cuts, comp, fits):
                held.append(part)
                if sum(map(len, held)) > 2_000_000:
                    pairs = _chosen(np.concatenate([pairs, near(distinct(np.concatenate(held)))]), mode, comp, size)
                    held = []
            if held:
                pairs = _chosen(np.concatenate([pairs, near(distinct(np.concatenate(held)))]), mode, comp, size)
            score = pairs[:, 2].astype(np.float64)
            if mode == "near":
                pairs, score = _sides(pairs, comp, size)
            else:
                pairs[:, 2] = 0
        return pa.Table.from_pydict({"u": pa.array(sid[pairs[:, 0]]), "v": pa.array(sid[pairs[:, 1]]), "kind": pa.array(pairs[:, 2].astype(np.int32)), "score": pa.array(score)})
    return run


def _sides(pairs: np.ndarray, comp: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per set the nearest one (kind 0) and the nearest of the largest component around (kind 1), as (x, y, kind) and bits apart."""
    x, y, apart = pairs.T
    turn = size[comp[x]] > size[comp[y]]  # from the set of the smaller component
    x, y = np.where(turn, y, x), np.where(turn, x, y)
    out = []
    for order in (np.lexsort((y, apart, x)), np.lexsort((y, apart, -size[comp[y]], x))):
        out.append(order[_groups(x[order])[:-1]] if len(order) else order)
    kind = np.repeat([0, 1], [len(out[0]), len(out[1])])
    best = np.concatenate(out)
    return np.stack([x[best], y[best], kind], 1), apart[best].astype(np.float64)


def _chosen(pairs: np.ndarray, mode: str, comp: np.ndarray, size: np.ndarray) -> np.ndarray:
    """(x, y, bits apart) of the pairs that can still be chosen."""
    if mode == "all" or not len(pairs):
        return np.unique(pairs, axis=0)
    found, apart = _sides(pairs, comp, size)
    return np.unique(np.column_stack([found[:, :2], apart.astype(np.int64)]), axis=0)


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in segments(batches, "text", SEGMENT_CHARS // 4):
            h, offsets = shingle_sets(texts, words)
            sets = [h[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_pydict({"sid": pa.array(_set_ids(h, offsets).view(np.int64)), "shingles": pa.array([s.tobytes() for s in sets], pa.binary()),
                                              "sketch": pa.array([dense_sketch(s).tobytes() for s in sets], pa.binary())})
    return run


def _verify(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int(np.count_nonzero(y[at] == x))
                keep.append(den * both >= num * (len(x) + len(y) - both))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))
    return run


def near_duplicates(docs: DataFrame, num: int = 3, den: int = 4, words: int = 5, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; documents link when
    ``den`` * intersection >= ``num`` * union (num / den above 1/2)."""
    if not den < 2 * num <= 2 * den:
        raise ValueError("the threshold must be above 1/2 and at most 1")
    spark = docs.sparkSession
    docs = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-size // BUCKET_BYTES))
    for finer in (1, 16, 256, 1 << 20):
        made = docs.mapInArrow(_sketches(buckets, words, num, den, finer), ROWS)
        met = written(made.groupBy("bucket").applyInArrow(_shared(buckets), ROWS), "sketches")
        if finer == 1 << 20 or met.where(F.col("weak")).isEmpty():
            break
    heads = met.where(F.col("kind") == 2).select("doc_id", "n", "sid")
    prefixes = met.where(F.col("kind") < 2).groupBy("bucket").applyInArrow(_prefixes(num, den, HOT), PREFIX)
    prefixes = written(prefixes, "prefixes")
    sets = _shingles_of(docs, heads, prefixes, words)
    prefixes, busy, n = _cooled(prefixes, sets, num, den, HOT, BLOCK)
    blocks = -(-n // BLOCK)
    shared = spark.sparkContext.broadcast((busy, blocks))
    able = prefixes.join(sets.select("sid", "sketch"), "sid")
    rows = prefixes.agg(F.sum(F.octet_length("segments") / 8)).first()[0] or 0
    rows += int((n * (blocks - 2)).sum())
    packs = max(1, int(-(-rows // MEMBERS)))

    links, labels = [], None  # labels (sid, comp): equal only for sets that are known to be connected
    for mode in ("hub", "near", "all"):
        labelled = able.withColumn("comp", F.col("sid")) if labels is None else able.join(labels, "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
        packed = labelled.select("sid", "comp", "m", "common", "smaller", "segments", "sketch").mapInArrow(_members(packs, shared), "bucket int, payload binary")
        pairs = packed.groupBy("bucket").applyInArrow(_candidates(mode, num, den), "u long, v long, kind int, score double")
        if mode == "all":
            pairs = pairs.select("u", "v").distinct()
        else:
            pairs = pairs.groupBy("u", "kind").agg(F.min_by("v", F.struct("score", "v")).alias("v")).select("u", "v").distinct()
        held = pairs.join(sets.select(F.col("sid").alias("u"), F.col("shingles").alias("a")), "u").join(
            sets.select(F.col("sid").alias("v"), F.col("shingles").alias("b")), "v").select("u", "v", "a", "b")
        links.append(written(held.mapInArrow(_verify(num, den), "u long, v long"), "links"))
        if mode == "hub":  # a set's hub, or the hub's own
            labels = _follow(links[0], links[0].groupBy(F.col("u").alias("sid")).agg(F.min("v").alias("comp")))
        elif mode == "near":
            moved = _follow(links[1], labels)
            labels = moved.unionByName(labels.join(moved.select("sid"), "sid", "left_anti"))
    labels = components(reduce(DataFrame.unionByName, links))

    nodes = heads.where(F.col("n") > 0).join(labels.select(F.col("u").alias("sid"), "low"), "sid", "left").withColumn("node", F.coalesce("low", "sid"))
    least = nodes.groupBy("node").agg(F.min("doc_id").alias("component_id"))
    joined = nodes.join(least, "node").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
    return joined.unionByName(heads.where(F.col("n") == 0).select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def _follow(links: DataFrame, labels: DataFrame) -> DataFrame:
    """Each linking set (u) with the label of one that it links to (v)."""
    to = links.groupBy(F.col("u").alias("sid")).agg(F.min("v").alias("to"))
    known = labels.select(F.col("sid").alias("to"), "comp")
    return to.join(known, "to", "left").select("sid", F.coalesce("comp", "to").alias("comp"))


def _shingles_of(docs: DataFrame, heads: DataFrame, prefixes: DataFrame, words: int) -> DataFrame:
    """(sid, shingles) of the sets that can have partners, from the text of one document each."""
    wanted = prefixes.select("sid").distinct()
    chosen = written(heads.join(wanted, "sid").groupBy("sid").agg(F.min("doc_id").alias("doc_id")), "chosen")
    ids = chosen.select("doc_id").distinct()
    ids = F.broadcast(ids) if chosen.count() <= FEW_IDS else ids
    texts = docs.join(ids, "doc_id", "left_semi").select("text")
    return written(texts.mapInArrow(_sets(words), "sid long, shingles binary, sketch binary").join(chosen.select("sid"), "sid", "left_semi").dropDuplicates(["sid"]), "sets")


def op5_paritysketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


OP5_SQL = f"""
WITH RECURSIVE words AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT rid, doc_id, s FROM (
    SELECT rid, doc_id, CASE WHEN len(w) < 5 THEN w ELSE w[i:i + 4] END AS s
    FROM (SELECT *, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0))),
sizes AS (SELECT rid, doc_id, count(*) AS n FROM shingles GROUP BY rid, doc_id),
common AS (SELECT a.rid AS x, b.rid AS y, count(*) AS n_both FROM shingles a JOIN shingles b ON a.s = b.s AND a.rid < b.rid GROUP BY 1, 2),
links AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM common c JOIN sizes a ON a.rid = c.x JOIN sizes b ON b.rid = c.y
  WHERE 100 * n_both >= 75 * (a.n + b.n - n_both)),
sym AS (SELECT u, v FROM links UNION SELECT v, u FROM links),
reach AS (SELECT DISTINCT u, u AS v FROM sym UNION SELECT r.u, s.v FROM reach r JOIN sym s ON r.v = s.u),
least AS (SELECT u, min(v) AS low FROM reach GROUP BY u)
SELECT w.doc_id, coalesce(z.n, 0) AS n_shingles, coalesce(l.low, w.doc_id) AS component_id
FROM words w LEFT JOIN sizes z ON z.rid = w.rid LEFT JOIN least l ON l.u = w.doc_id
"""
