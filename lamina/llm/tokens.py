"""Token ids of whole text columns, with a bounded cache of words.

The vocabulary's tokenizer normalises (NFC, lower case) and splits at white space, and neither step joins
anything over an ASCII blank, tab or line break. So a text's ids are those of its blank-separated words in
order, and each different word is tokenized once.
"""

from __future__ import annotations

import functools
import itertools
import os

import numpy as np
import pyarrow as pa

from . import textvec as V

#: Words in the cache of one Python worker; it starts again from empty when it is full. One call's words are held together, however many.
CACHE_WORDS = 1_000_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordTokenizer:
    def __init__(self, path: str | None = None, cache_words: int = CACHE_WORDS):
        # Every core has a task of its own already: threads inside a task only add CPU time.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or default_path())
        self.cache_words = cache_words
        self._clear()

    def _clear(self) -> None:
        self.hashes = np.zeros(0, V.U64)  # sorted
        self.begin = np.zeros(0, np.int64)  # of each cached word in self.ids
        self.count = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        """Add words that the cache does not hold; `hashes` is sorted."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        count = np.fromiter(map(len, found), np.int64, len(found))
        begin = len(self.ids) + np.append(0, np.cumsum(count))[:-1]
        self.ids = np.concatenate([self.ids, np.fromiter(itertools.chain.from_iterable(found), np.uint32, int(count.sum()))])
        at = np.searchsorted(self.hashes, hashes)
        self.hashes, self.begin, self.count = np.insert(self.hashes, at, hashes), np.insert(self.begin, at, begin), np.insert(self.count, at, count)

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All rows' ids in one array, and the place of each row's first id (and one more). `end_id` follows each row."""
        data, offsets = V.column_bytes(texts)
        starts, ends, first = V.spans(data, offsets, V.IS_SOLID)
        known, at, word = np.unique(V.span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        if len(known):
            place = np.minimum(np.searchsorted(self.hashes, known), max(0, len(self.hashes) - 1))
            new = self.hashes[place] != known if len(self.hashes) else np.ones(len(known), bool)
            if len(self.hashes) + new.sum() > self.cache_words:
                # All of this call's words are learned again, even where they alone are more than the cache holds.
                self._clear()
                new[:] = True
            if new.any():
                raw = data.tobytes()
                at = at[new]
                self._learn(known[new], [raw[a:b].decode() for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
            place = np.searchsorted(self.hashes, known)
            begin, count = self.begin[place][word], self.count[place][word]
        else:
            begin = count = np.zeros(0, np.int64)
        before = np.append(0, np.cumsum(count))
        edges = before[first]
        total = int(before[-1])
        ids = self.ids[np.arange(total) + np.repeat(begin - before[:-1], count)] if total else np.zeros(0, np.uint32)
        if end_id is not None:
            ids = np.insert(ids, edges[1:], np.uint32(end_id))
            edges = edges + np.arange(len(edges))
        return ids, edges


@functools.lru_cache(maxsize=2)
def tokenizer(path: str | None = None) -> WordTokenizer:
    """One tokenizer and cache for each Python worker."""
    return WordTokenizer(path)
