"""Word shingles of whole texts as 64-bit hashes, many texts at a time.

Words are runs of other than space and TAB..CR, A-Z lower-cased. A text with
fewer words than a shingle has its whole word sequence as its one shingle.
"""

from __future__ import annotations

import numpy as np

from tickwise.llm.common import BLANKS, mix64

CHUNK_BYTES = 1_000_000  # of text hashed at a time
_BASE = 0x9E3779B97F4A7C15  # odd
_STEP = np.uint64(0xD6E8FEB86659FD93)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[ord(c) for c in BLANKS]] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_to(n: int) -> list[np.ndarray]:
    """base^i and base^-i (mod 2^64) for i < n."""
    if len(_powers[0]) < n:
        for k, b in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers


def _hash_chunk(raw: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, shingle hash) of each shingle, not yet distinct."""
    a = _FOLD[np.frombuffer(b" " + b" ".join(raw) + b" ", np.uint8)]
    edge = np.diff(_BLANK[a].view(np.int8))
    start, end = np.flatnonzero(edge == -1) + 1, np.flatnonzero(edge == 1) + 1
    text = np.searchsorted(np.cumsum([1, *(len(r) + 1 for r in raw[:-1])]), start, "right") - 1
    power, inverse = _powers_to(len(a))
    total = np.cumsum((a.astype(np.uint64) + np.uint64(1)) * power[:len(a)], dtype=np.uint64)
    word = mix64((total[end - 1] - total[start - 1]) * inverse[start] ^ mix64((end - start).astype(np.uint64)))
    n = np.bincount(text, minlength=len(raw))
    size = np.uint64(words)
    h = np.zeros(max(0, len(word) - words + 1), np.uint64)
    for j in range(words):
        h = h * _STEP + word[j:len(word) - words + 1 + j]
    whole = np.flatnonzero(text[:len(h)] == text[words - 1:]) if len(h) else np.empty(0, np.int64)
    owners, hashes = [text[whole]], [mix64(h[whole] ^ size)]
    first = np.cumsum(n) - n
    for k in range(1, words):
        short = np.flatnonzero(n == k)
        h = np.zeros(len(short), np.uint64)
        for j in range(k):
            h = h * _STEP + word[first[short] + j]
        owners.append(short)
        hashes.append(mix64(h ^ np.uint64(k)))
    return np.concatenate(owners), np.concatenate(hashes)


def shingle_sets(texts: list[str | None], words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of every text, ascending within a text, and offsets:
    text i has ``hashes[offsets[i]:offsets[i + 1]]``."""
    parts, sizes, i = [], [np.zeros(1, np.int64)], 0
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    while i < len(raw):
        j, held = i, 0
        while j < len(raw) and (j == i or held + len(raw[j]) <= CHUNK_BYTES):
            held += len(raw[j]) + 1
            j += 1
        owner, h = _hash_chunk(raw[i:j], words)
        if (owner[1:] < owner[:-1]).any():  # short texts come last
            order = np.argsort(owner, kind="stable")
            owner, h = owner[order], h[order]
        ends = np.cumsum(np.bincount(owner, minlength=j - i)).tolist()
        for a, b in zip([0, *ends], ends):
            h[a:b].sort()
        new = np.ones(len(h), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])
        parts.append(h[new])
        sizes.append(np.bincount(owner[new], minlength=j - i))
        i = j
    hashes = np.concatenate(parts) if parts else np.empty(0, np.uint64)
    return hashes, np.cumsum(np.concatenate(sizes))
