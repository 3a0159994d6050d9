"""Token ids of whole texts by a ``tokenizers`` file, for the operators that
write or pack them.

The vocabulary drops white space before it cuts words, so a text's ids are
the ids of its blank-separated words in order: the words of a batch are
dictionary-encoded, each distinct word is encoded by the library, and the ids
are gathered back.  Words seen lately are kept with their ids in flat arrays,
``KEPT_WORDS`` at most.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

KEPT_WORDS = 250_000
#: Stands between words that go to the library in one call.
_MARK = "\x01"
_GROUP = 64


def ragged(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0]+1, ... (size[0] of them), begin[1], ..."""
    stop = np.cumsum(size)
    total = int(stop[-1]) if len(stop) else 0
    kind = np.int32 if max(total, int(begin.max(initial=0))) < 1 << 30 else np.int64
    out = np.repeat((begin - (stop - size)).astype(kind), size)
    out += np.arange(total, dtype=kind)
    return out


class WordEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"      # Spark runs one task per core
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.mark = self._ids(_MARK)[0] if len(self._ids(_MARK)) == 1 else None
        probe = "Ab c.\td,e\n f"
        if self._ids(probe) != [i for w in probe.split() for i in self._ids(w)]:
            raise ValueError("this vocabulary encodes the blanks between words")
        self.folds = self._ids("Ab") == self._ids("ab")
        self.tails = {t: np.array(self._ids(t), np.uint32) for t in ".,"}
        self.words = pa.array([], pa.large_string())        # known words, their places in the pool, their last use
        self.pool = np.zeros(0, np.uint32)
        self.begin, self.size, self.used = (np.zeros(0, np.int64) for _ in range(3))
        self.round = 0

    def _ids(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, number of ids per word)."""
        if self.mark is None or any(_MARK in w for w in words):
            ids = [np.array(e.ids, np.uint32) for e in
                   self.library.encode_batch_fast(words, add_special_tokens=False)]
            return np.concatenate(ids), np.array([len(x) for x in ids], np.int64)
        joined = [f" {_MARK} ".join(words[k:k + _GROUP]) + f" {_MARK}" for k in range(0, len(words), _GROUP)]
        flat = np.concatenate([np.array(e.ids, np.uint32) for e in
                               self.library.encode_batch_fast(joined, add_special_tokens=False)])
        ends = np.flatnonzero(flat == self.mark)
        return flat[flat != self.mark], np.diff(ends, prepend=-1) - 1

    def _places(self, words: pa.Array) -> np.ndarray:
        """Places of distinct words among the known ones, after learning the new."""
        self.round += 1
        at = pc.index_in(words, value_set=self.words)
        fresh = words.filter(pc.is_null(at))
        out = at.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        if len(fresh):
            if len(self.words) + len(fresh) > KEPT_WORDS and len(self.words):
                # forget what has not been used for longest, never what this batch uses
                self.used[out[out >= 0]] = self.round
                stay = self.used >= np.sort(self.used)[len(self.used) // 2]
                self.pool = self.pool[ragged(self.begin[stay], self.size[stay])]
                self.words, self.size, self.used = self.words.filter(pa.array(stay)), self.size[stay], self.used[stay]
                self.begin = np.cumsum(self.size) - self.size
                out = np.where(out >= 0, (np.cumsum(stay) - 1)[out], -1)
            flat, size = self._encode_words(fresh.to_pylist())
            out[out < 0] = len(self.words) + np.arange(len(fresh))
            self.begin = np.concatenate([self.begin, len(self.pool) + np.cumsum(size) - size])
            self.words = pa.concat_arrays([self.words, fresh])
            self.pool, self.size = np.concatenate([self.pool, flat]), np.concatenate([self.size, size])
            self.used = np.concatenate([self.used, np.zeros(len(fresh), np.int64)])
        self.used[out] = self.round
        return out

    def _distinct(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, number of ids per word) of distinct words.  A word of A-Z
        and a-z alone, or with one final stop or comma, is looked up as its
        lower-case letters."""
        if not self.folds:
            at = self._places(words)
            return self.pool[ragged(self.begin[at], self.size[at])], self.size[at]
        plain = pc.match_substring_regex(words, "^[A-Za-z]+[.,]?$")
        coded = pc.if_else(plain, pc.ascii_lower(pc.ascii_rtrim(words, characters=".,")), words).dictionary_encode()
        at = self._places(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)]
        size = self.size[at]
        extra = np.zeros(len(at), np.int64)
        tailed = {}
        for tail, ids in self.tails.items():
            tailed[tail] = np.flatnonzero(pc.and_(plain, pc.ends_with(words, tail)).to_numpy(zero_copy_only=False))
            extra[tailed[tail]] = len(ids)
        out = np.zeros(int((size + extra).sum()), np.uint32)
        begin = np.cumsum(size + extra) - size - extra
        out[ragged(begin, size)] = self.pool[ragged(self.begin[at], size)]
        for tail, ids in self.tails.items():
            for k, i in enumerate(ids):
                out[(begin + size)[tailed[tail]] + k] = i
        return out, size + extra

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, number of ids per text), with ``end_id`` after each text."""
        words = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
        per_text = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = words.flatten().dictionary_encode()
        pool, size = self._distinct(coded.dictionary)
        begin = np.cumsum(size) - size
        which = coded.indices.to_numpy(zero_copy_only=False)
        if end_id is not None:                  # one more word behind each text
            which = np.insert(which, np.cumsum(per_text), len(size))
            size, begin = np.append(size, 1), np.append(begin, len(pool))
            pool = np.append(pool, np.uint32(end_id))
            per_text = per_text + 1
        each = size[which]
        stop = np.concatenate([[0], np.cumsum(each)])[np.concatenate([[0], np.cumsum(per_text)])]
        return pool[ragged(begin[which], each)], np.diff(stop)


@lru_cache(maxsize=2)
def load(path: str) -> WordEncoder:
    return WordEncoder(path)
