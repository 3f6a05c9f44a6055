"""Plain Python versions of the operators, for small inputs."""

import hashlib
import math
import re
import struct
import zlib
from collections import Counter, defaultdict

import xxhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BLANKS = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def line_dedup(rows, least=10):
    """rows (doc_id, text) -> (doc_id, n_lines, n_dropped, kept) in order."""
    key = lambda line: line.strip(BLANKS).translate(LOWER)
    holders = defaultdict(set)
    for i, t in rows:
        if i is not None:
            for line in (t or "").split("\n"):
                if len(key(line)) >= least:
                    holders[key(line)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(holders.get(key(x), ())) < 2 or i == min(holders[key(x)])]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def shingles(text, k=5):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[j:j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()


def near_duplicates(rows, num=75, den=100):
    """rows (doc_id, text) -> (doc_id, n_shingles, component_id)."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a in range(len(rows)):
        for b in range(a):
            if rows[a][0] is not None and rows[b][0] is not None and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                    parent[root(a)] = root(b)
    low = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            low[root(i)].append(doc)
    return [(doc, len(sets[i]), None if doc is None else min(low[root(i)])) for i, (doc, _) in enumerate(rows)]


def spans(rows, pattern, runs, grown=None):
    """rows (doc_id, text) -> (doc_id, n_sentences, n_removed, kept)."""
    def key(s):
        return re.sub(r"[\x20\x09-\x0D]+", " ", s.strip(BLANKS).translate(LOWER))
    cut = [re.findall(pattern, t or "") for _, t in rows]
    found = defaultdict(set)
    own = []
    for r, (doc, _) in enumerate(rows):
        keys = [key(s) for s in cut[r]]
        words_of = [len(x.split(" ")) if x else 0 for x in keys]
        taken = {(p, k) for k, words in runs for p in range(len(keys) - k + 1) if sum(words_of[p:p + k]) >= words}
        if grown is not None:
            for p in range(len(keys)):
                taken |= set([(p, k) for k in range(2, len(keys) - p + 1) if sum(words_of[p:p + k]) >= grown][:1])
                taken |= set([(p - k + 1, k) for k in range(2, p + 2) if sum(words_of[p - k + 1:p + 1]) >= grown][:1])
        mine = [(p, k, tuple(keys[p:p + k])) for p, k in taken] if doc is not None else []
        for p, _, run in mine:
            found[run].add((doc, p))
        own.append(mine)
    out = []
    for r, (doc, _) in enumerate(rows):
        gone = {q for p, k, run in own[r] if min(found[run]) != (doc, p) for q in range(p, p + k)}
        out.append((doc, len(cut[r]), len(gone), "".join(s for q, s in enumerate(cut[r]) if q not in gone)))
    return out


def fill(budget, nodes):
    """Shares of a budget: nodes name -> (weight, capacity); floors and one more in name order."""
    got, open_, left = {}, dict(nodes), budget
    while True:
        total = sum(w for w, _ in open_.values())
        full = {n: c for n, (w, c) in open_.items() if c * total <= w * left}
        if not full:
            break
        # the one that fills up first, as its leavings raise the others
        n = min(full, key=lambda x: (open_[x][1] / open_[x][0], x))
        got[n] = full[n]
        left -= full[n]
        del open_[n]
        if not open_:
            return got
    total = sum(w for w, _ in open_.values())
    low = {n: w * left // total for n, (w, _) in open_.items()}
    over = left - sum(low.values())
    for j, n in enumerate(sorted(low)):
        got[n] = low[n] + (j < over)
    return got


def tokens(text):
    return len(WORD.findall(text or ""))


def mixed(rows, weights, share, max_epochs, seed, budget=None):
    """rows (doc_id, text, lang, source) -> sorted (doc_id, domain, n_tokens, epoch, take_tokens)."""
    def leaf(r):
        number = re.search(r"([0-9]{1,9})$", r[3] or "")
        return (f"domain{int(number[1]) % 4}" if number else "other", r[2] if r[2] is not None else "(none)", r[3] if r[3] is not None else "(none)")
    leaves = defaultdict(list)
    for r in rows:
        leaves[leaf(r)].append((r[0], tokens(r[1])))
    sizes = {k: sum(n for _, n in v) for k, v in leaves.items()}
    whole = min(sum(sizes.values()) * max_epochs, int(sum(sizes.values()) * share) if budget is None else budget)
    got = {(): whole}
    for depth, level in enumerate(("domain", "lang", "source")):
        nxt = {}
        for up, b in got.items():
            names = {k[depth] for k in leaves if k[:depth] == up}
            nodes = {n: (weights.get(level, {}).get(n, 1), max_epochs * sum(s for k, s in sizes.items() if k[:depth + 1] == (*up, n))) for n in names}
            nxt |= {(*up, n): v for n, v in fill(b, nodes).items()}
        got = nxt
    out = []
    for k, docs in leaves.items():
        if not sizes[k]:
            continue
        e, part = divmod(got[k], sizes[k])
        out += [(d, k[0], n, i, n) for d, n in docs for i in range(e)]
        for _, n, d in sorted((hashlib.md5(f"{seed}|{e}|{'' if d is None else d}".encode()).hexdigest(), n, d) for d, n in docs):
            if part > 0:
                out.append((d, k[0], n, e, min(n, part)))
            part -= n
    return sorted(out, key=str)


def rendezvous(key, weights):
    """The shard with the smallest -ln(u) / weight; ties to the smaller number."""
    def drawn(shard):
        h = xxhash.xxh64_intdigest(struct.pack("<i", shard), seed=xxhash.xxh64_intdigest(key.encode(), seed=42))
        return -math.log(((h >> 12) + 0.5) / 2 ** 52) / weights[shard]
    return min(range(len(weights)), key=lambda s: (drawn(s), s))


def languages(rows, positions, most, least, ratio):
    """rows (doc_id, text, lang) -> (doc_id, language, share), all rows learned from but the held-out ones."""
    word = 2 ** 32

    def grams(text):
        raw = b"  " + text.lower().encode() + b"    "
        a = [b if b >= 128 or chr(b).isalpha() else 32 for b in raw]
        return [tuple(a[i:i + 4]) for i in range(len(a) - 3) if (32, 32) not in (tuple(a[i:i + 2]), tuple(a[i + 1:i + 3]), tuple(a[i + 2:i + 4]))]

    def places(gram):
        code = int.from_bytes(bytes(gram), "big")
        out = []
        odd = (2654435769, 2246822519, 3266489917, 668265263)
        for j in range(3):
            x = code * odd[j] % word
            x = (x ^ x >> 15) * odd[j + 1] % word
            out.append(x >> 33 - positions.bit_length())
        return out

    known = [(t, lang) for d, t, lang in rows if d is not None and t is not None and lang is not None and zlib.crc32(str(d).encode()) % 3 != 1]
    counts, n_docs = defaultdict(Counter), Counter(lang for _, lang in known)
    for t, lang in known:
        counts[lang].update(grams(t))
    rates = {lang: {g: n / sum(c.values()) for g, n in c.items() if n >= least} for lang, c in counts.items()}
    top = Counter()
    for r in rates.values():
        for g, x in r.items():
            top[g] = max(top[g], x)
    filters = {}
    for lang in sorted(n_docs):
        kept = sorted((g for g, x in rates.get(lang, {}).items() if x >= ratio * top[g]), key=lambda g: (-counts[lang][g], g))[:most]
        filters[lang] = {p for g in kept for p in places(g)}
    out = []
    for d, t, _ in rows:
        if not filters or not t or not re.search(r"[^\W\d_]", t):
            out.append((d, "und", 0.0))
            continue
        seen, best = [places(g) for g in grams(t)], (-1.0, None)
        for lang, bits in filters.items():
            false = (len(bits) / positions) ** 3
            share = sum(all(p in bits for p in at) for at in seen) / len(seen) if seen else 0.0
            share = min(1.0, max(0.0, (share - false) / (1 - false)))
            if share > best[0]:
                best = share, lang
        out.append((d, best[1] if best[0] > 0 else min(n_docs, key=lambda k: (-n_docs[k], k)), round(best[0], 9)))
    return out
