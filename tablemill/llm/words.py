"""Words of many texts as 64-bit hashes, computed on whole byte arrays."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

#: Bytes that one pass over a long text takes.
SLICE = 1 << 19
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SYMBOL = np.zeros(256, bool)
SYMBOL[33:127] = True
SYMBOL[48:58] = SYMBOL[65:91] = SYMBOL[97:123] = False

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2^64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((BASE, BASE_INVERSE)):
            steps = np.full(max(n, SLICE + 4096), base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def kind_spans(kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal kinds, without those of kind 0."""
    if not len(kind):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.empty(len(kind) + 1, bool)
    edge[0] = edge[-1] = True
    np.not_equal(kind[1:], kind[:-1], out=edge[1:-1])
    at = np.flatnonzero(edge)
    word = kind[at[:-1]] > 0
    return at[:-1][word], at[1:][word]


def spans(raw: np.ndarray, shapes: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words; with ``shapes`` a word also ends where symbols begin or end."""
    kind = (~SPACE[raw]).astype(np.int8)
    if shapes:
        kind += SYMBOL[raw]
    return kind_spans(kind)


def hash_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One hash for the bytes of each span."""
    up, down = powers(len(raw) + 1)
    sums = np.empty(len(raw) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def pieces(raw: bytes, limit: int = SLICE) -> list[tuple[int, int]]:
    """Cut a long text at white space into pieces of about ``limit`` bytes; a longer word is not cut."""
    out, start = [], 0
    while start < len(raw):
        stop = min(start + limit, len(raw))
        while stop < len(raw) and not SPACE[raw[stop]]:
            stop += 1
        out.append((start, stop))
        start = stop
    return out


def hashed_words(texts: Sequence[str | None], lower: bool = True, shapes: bool = False,
                 with_places: bool = False):
    """(hashes, counts): the word hashes of all texts in order, and how many each text has.

    ``with_places`` adds the byte offset of every word's start and end in its own text. NULL has no words.
    """
    hashes, firsts, lasts, counts = [], [], [], np.zeros(len(texts), np.int64)
    group: list[tuple[int, bytes]] = []

    def flush():
        if not group:
            return
        raw = np.frombuffer(b"\n".join(b for _, b in group), np.uint8)
        bounds = np.cumsum([0] + [len(b) + 1 for _, b in group])
        starts, ends = spans(raw, shapes)
        if lower:
            raw = LOWER[raw]
        hashes.append(hash_spans(raw, starts, ends))
        cuts = np.searchsorted(starts, bounds)
        for k, (number, _) in enumerate(group):
            counts[number] += cuts[k + 1] - cuts[k]
        if with_places:
            base = np.repeat(bounds[:-1], np.diff(cuts))
            firsts.append(starts - base)
            lasts.append(ends - base)
        group.clear()

    held = 0
    for number, text in enumerate(texts):
        raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""
        if len(raw) > SLICE:
            flush()
            held = 0
            for a, b in pieces(raw):
                group.append((number, raw[a:b]))
                flush()
                if with_places:
                    firsts[-1] += a
                    lasts[-1] += a
            continue
        group.append((number, raw))
        held += len(raw)
        if held > SLICE:
            flush()
            held = 0
    flush()
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    if with_places:
        return join(hashes, np.uint64), counts, join(firsts, np.int64), join(lasts, np.int64)
    return join(hashes, np.uint64), counts


def grams(hashes: np.ndarray, counts: np.ndarray, size: int, short: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text number, first word in the text) of every run of ``size`` words that stays in its text.

    ``short`` makes one run of a text that has fewer words, but some.
    """
    ends = np.cumsum(counts)
    begins = ends - counts
    owner = np.repeat(np.arange(len(counts)), counts)
    n = len(hashes)
    m = max(n - size + 1, 0)
    acc = np.zeros(m, np.uint64)
    for k in range(size):
        acc = acc * np.uint64(BASE) + hashes[k:k + m]
    whole = np.arange(m) + size <= ends[owner[:m]]
    out, who, first = mix(acc[whole]), owner[:m][whole], (np.arange(m) - begins[owner[:m]])[whole]
    if short:
        few = np.flatnonzero((counts > 0) & (counts < size))
        extra = np.zeros(len(few), np.uint64)
        for k in range(size):
            has = counts[few] > k
            extra[has] = extra[has] * np.uint64(BASE) + hashes[(begins[few] + k)[has]]
        out = np.concatenate([out, mix(extra + np.uint64(1))])
        who = np.concatenate([who, few])
        first = np.concatenate([first, np.zeros(len(few), np.int64)])
        order = np.argsort(who, kind="stable")
        out, who, first = out[order], who[order], first[order]
    return out, who, first


def sequence_hashes(hashes: np.ndarray, counts: np.ndarray, seed: int = 0) -> np.ndarray:
    """One hash for the words of each text, in their order; 0 words give the hash of nothing."""
    up, down = powers(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(mix(hashes + np.uint64(seed)) * up[:len(hashes)], out=sums[1:])
    ends = np.cumsum(counts)
    begins = ends - counts
    return mix((sums[ends] - sums[begins]) * down[begins] + counts.astype(np.uint64) + np.uint64(seed))


def distinct_grams(hashes: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts): the sorted different runs of ``size`` words of every text. A shorter text is one run."""
    value, who, _ = grams(hashes, counts, size, short=True)
    order = np.lexsort((value, who))
    value, who = value[order], who[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (who[1:] != who[:-1])
    return value[new], np.bincount(who[new], minlength=len(counts))


def minhash(value: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """``size`` MinHash values of every set, one row each; rows of empty sets are 0."""
    seeds = mix(np.arange(1, 2 * size + 1, dtype=np.uint64) * np.uint64(BASE))
    out = np.zeros((len(counts), size), np.uint32)
    filled = np.flatnonzero(counts)
    if len(filled):
        cuts = (np.cumsum(counts) - counts)[filled]
        for k in range(size):
            moved = ((value * (seeds[2 * k] | np.uint64(1)) + seeds[2 * k + 1]) >> np.uint64(32)).astype(np.uint32)
            out[filled, k] = np.minimum.reduceat(moved, cuts)
    return out
