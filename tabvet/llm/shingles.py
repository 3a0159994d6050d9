"""Word hashes and word shingles of Arrow batches of texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_B, _C = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A well-spread 64-bit value of each 64-bit value."""
    x = x + np.uint64(0x9E3779B97F4A7C15 * (salt + 1) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each blank-separated word in order, words per text).
    ``lower`` folds A-Z."""
    import xxhash
    texts = texts.cast(pa.large_string())
    words = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    flat = words.flatten()
    per = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = flat.dictionary_encode()
    known = coded.dictionary.cast(pa.large_binary()).to_pylist()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, known), np.uint64, len(known))
    which = coded.indices.to_numpy(zero_copy_only=False)
    # the splitter yields an empty word before a leading and after a trailing blank
    real = np.fromiter(map(len, known), np.int64, len(known))[which] > 0
    if not real.all():
        owner = np.repeat(np.arange(len(per)), per)
        per = np.bincount(owner[real], minlength=len(per)).astype(np.int64)
        which = which[real]
    return hashes[which], per


def shingles(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each shingle of ``words`` words, shingles per text); a
    text of fewer words, but one at least, is one shingle."""
    h, per = word_hashes(texts)
    last = np.cumsum(per)
    count = np.where(per >= words, per - words + 1, (per > 0).astype(np.int64))
    text = np.repeat(np.arange(len(per)), count)
    ends = np.cumsum(count)
    at = (last - per)[text] + np.arange(len(text)) - (ends - count)[text]
    padded = np.concatenate([h, np.zeros(words, np.uint64)])
    out = np.zeros(len(at), np.uint64)
    for k in range(words):
        inside = at + k < last[text]
        out = mix(out ^ np.where(inside, padded[at + k], np.uint64(k)), k)
    return out, count


def occurrences(hashes: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, count) of the distinct hashes of each text, by text."""
    order = np.lexsort((hashes, text))
    t, h = text[order], hashes[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    first = np.flatnonzero(new)
    return t[first], h[first], np.diff(np.append(first, len(h)))


def elements(text: str | bytes, words: int) -> np.ndarray:
    """The multiset of a text's shingles as a sorted set: the k-th occurrence
    of a shingle is an element of its own."""
    s, _ = shingles(pa.array([text]).cast(pa.large_string()), words)
    s = np.sort(s)
    if not len(s):
        return s
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    first = np.flatnonzero(new)
    nth = np.arange(len(s)) - np.repeat(first, np.diff(np.append(first, len(s))))
    again = nth > 0
    s[again] = mix(s[again] + nth[again].astype(np.uint64) * _B, 99)
    return np.sort(s) if again.any() else s


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two multisets given as ``elements``."""
    if not len(a) or not len(b):
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return both / (len(a) + len(b) - both)
