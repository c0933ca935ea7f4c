"""Hashed sets of word shingles, many documents at a time in numpy."""

from __future__ import annotations

import numpy as np

#: Bytes of text hashed at once; a longer text is cut at white space and its words are put together again.
CHUNK = 1 << 20
#: Documents hashed together; their number takes the upper bits of a sort key, the hash the lower ones.
GROUP, TOKEN_BITS = 1024, 54
#: Bits of the smallest parity bitmap; a larger set has the next power of two above its size.
LEAST_BITS = 512

_U = np.uint64
_P = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def mix_one(x: int) -> int:
    return int(mix(np.array([x & _MASK], dtype=_U))[0])


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, dtype=_U)
    out[1:] = _U(base)
    return np.multiply.accumulate(out)


_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(_P))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(CHUNK + 1, 1 << (n + 1).bit_length())
    if size not in _TABLES:
        tables = _powers(_P, size), _powers(pow(_P, -1, 1 << 64), size)
        if size > CHUNK + 1:
            return tables  # for one giant word only
        _TABLES[size] = tables
    return _TABLES[size]


def _words(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and 64-bit hash of each run of bytes that are no white space."""
    a = np.frombuffer(raw, dtype=np.uint8)
    gap = (a == 0x20) | ((a >= 0x09) & (a <= 0x0D))
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True])).view(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    up, down = _tables(len(a))
    sums = np.zeros(len(a) + 1, dtype=_U)
    np.cumsum(_BYTE[a] * up[: len(a)], out=sums[1:])
    return starts, mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(_U) * _U(_P))


def _cut(raw: bytes):
    """Pieces of at most about CHUNK bytes that end at white space (a longer word stays whole)."""
    at = 0
    while len(raw) - at > CHUNK:
        piece = raw[at : at + CHUNK]
        end = max(piece.rfind(c) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
        if end <= 0:
            ends = [i for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c") if (i := raw.find(c, at + CHUNK)) >= 0]
            end = (min(ends) if ends else len(raw)) - at
        yield raw[at : at + end + 1]
        at += end + 1
    yield raw[at:]


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, number of words of each text); A-Z count as a-z."""
    raws = [t.encode("utf-8", "surrogatepass").lower() if t else b"" for t in texts]
    found, counts = [], np.zeros(len(raws), dtype=np.int64)
    k = 0
    while k < len(raws):
        if len(raws[k]) > CHUNK:
            parts = [_words(p)[1] for p in _cut(raws[k])]
            found += parts
            counts[k] = sum(map(len, parts))
            k += 1
            continue
        j, size = k, 0
        while j < len(raws) and (size := size + len(raws[j]) + 1) <= CHUNK:
            j += 1
        j = max(j, k + 1)
        starts, hashes = _words(b"\n".join(raws[k:j]))
        offsets = np.cumsum([0, *(len(r) + 1 for r in raws[k:j])])
        counts[k:j] = np.diff(np.searchsorted(starts, offsets))
        found.append(hashes)
        k = j
    return (np.concatenate(found) if found else np.zeros(0, dtype=_U)), counts


def token_sets(texts: list[str | None], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of ``k`` words of up to GROUP texts: (index of the text, token), sorted, and the set sizes.

    A text with fewer words has its whole sequence as its only shingle; one without words has none.
    """
    words, counts = word_hashes(texts)
    own = np.repeat(np.arange(len(texts)), counts)
    n = len(words) - k + 1
    if n > 0:
        h = words[:n].copy()
        for j in range(1, k):
            h = mix(h * _U(0xD6E8FEB86659FD93) + words[j : n + j])
        keep = own[:n] == own[k - 1 :]
        h, at = h[keep], own[:n][keep]
    else:
        h, at = np.zeros(0, dtype=_U), np.zeros(0, dtype=np.int64)
    first = np.cumsum(counts) - counts
    short = [i for i in np.flatnonzero((counts > 0) & (counts < k))]
    if short:
        whole = np.zeros(len(short), dtype=_U)
        for s, i in enumerate(short):
            v = _U(mix_one(int(counts[i])))
            for w in words[first[i] : first[i] + counts[i]]:
                v = _U(mix_one(int(v) * 0xD6E8FEB86659FD93 + int(w)))
            whole[s] = v
        h, at = np.concatenate((h, whole)), np.concatenate((at, np.array(short)))
    key = np.sort((at.astype(_U) << _U(TOKEN_BITS)) | (h >> _U(64 - TOKEN_BITS)))
    key = key[np.concatenate(([True], key[1:] != key[:-1]))] if len(key) else key
    at = (key >> _U(TOKEN_BITS)).astype(np.int64)
    return at, mix(key & _U((1 << TOKEN_BITS) - 1)), np.bincount(at, minlength=len(texts))


def sum_by(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of 64-bit words modulo 2 ** 64 by index."""
    out = np.zeros(n, dtype=_U)
    np.add.at(out, at, values)
    return out


def fingerprints(at: np.ndarray, tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit identity of each set."""
    return mix(sum_by(at, tokens, len(sizes)) + sizes.astype(_U) * _U(_P)).view(np.int64)


def bitmaps(at: np.ndarray, tokens: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """Parity bitmap of each set: two sets differ in at least as many tokens as their bitmaps in bits."""
    bits = LEAST_BITS << np.maximum(0, np.ceil(np.log2(np.maximum(sizes, 1) / LEAST_BITS))).astype(np.int64)
    begin = np.cumsum(bits) - bits
    place = begin[at] + ((tokens >> _U(32)) % bits[at].astype(_U)).astype(np.int64)
    odd = (np.bincount(place, minlength=int(bits.sum())) & 1).astype(np.uint8)
    packed = np.packbits(odd, bitorder="little").tobytes()
    return [packed[b : b + n] for b, n in zip((begin // 8).tolist(), (bits // 8).tolist(), strict=True)]


def folded(bitmap: bytes, words: int) -> np.ndarray:
    """A bitmap as ``words`` 64-bit words: halves are laid upon each other, as a smaller bitmap of the same set would be."""
    x = np.frombuffer(bitmap, dtype=_U)
    while len(x) > words:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x
