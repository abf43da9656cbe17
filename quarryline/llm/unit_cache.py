"""Encoding through a cache of units: a space and the word after it.

A pre-tokenizer that never joins a word to the white space after it may be applied to such units alone; most units of a
text have been seen before, so the tokenizer runs on the new ones only. Texts in which white space follows white space,
that hold control characters on which definitions of white space differ, or one of the tokenizer's added tokens, are encoded
whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from functools import lru_cache
from itertools import chain, islice

import numpy as np

#: White space after white space, or information separators.
UNSAFE = re.compile(r"\s\s|[\x1c-\x1f\x85]")
#: Units that a worker remembers before it starts anew.
CACHED = 700_000
#: New units or texts that the tokenizer gets at once.
AT_ONCE = 4096
#: Units that are joined for one call.
JOINED = 512


class Codes(dict):
    """Numbers words as they come."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n


class UnitCache:
    """encode_many gives the ids of each of a list of strings, encode_words all ids of words after a space, and how many of each. A word is kept under its own name, for the space and itself."""

    def __init__(self, encode_many: Callable[[list[str]], list], encode_words: Callable[[list[str]], tuple], vocabulary: int, added: list[str] = ()):
        self.encode_many, self.encode_words, self.vocabulary = encode_many, encode_words, vocabulary
        self.unsafe = re.compile("|".join([UNSAFE.pattern, *map(re.escape, filter(None, added))]))
        self.clear()

    def clear(self) -> None:
        self.codes = Codes()
        self.codes.new = []
        self.starts = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.int64)

    @staticmethod
    @lru_cache(maxsize=2)
    def of_tokenizer(path: str) -> UnitCache:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        bytes_of = np.zeros(t.get_vocab_size(), np.int64)
        for token, i in t.get_vocab().items():
            bytes_of[i] = len(token)

        def encode_many(texts: list[str]) -> list[list[int]]:
            return [e.ids for k in range(0, len(texts), AT_ONCE) for e in t.encode_batch_fast(texts[k : k + AT_ONCE], add_special_tokens=False)]

        def encode_words(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
            """Words, each with a space before it, are encoded joined and told apart by their bytes."""
            ids, sizes = [], []
            for a in range(0, len(words), JOINED):
                part = words[a : a + JOINED]
                if any(w == "" or w[-1].isspace() for w in part):
                    found = encode_many([" " + w for w in part])
                    ids += [np.array(x, np.int64) for x in found]
                    sizes.append([len(x) for x in found])
                    continue
                got = np.array(t.encode_batch_fast([" " + " ".join(part)], add_special_tokens=False)[0].ids)
                ends = np.cumsum([len(w.encode()) + 1 for w in part])
                ids.append(got)
                sizes.append(np.diff(np.searchsorted(np.cumsum(bytes_of[got]), ends) + 1, prepend=0))
            return np.concatenate([np.zeros(0, np.int64), *ids]), np.concatenate([np.zeros(0, np.int64), *sizes])

        added = sorted({x.content for x in t.get_added_tokens_decoder().values()})
        return UnitCache(encode_many, encode_words, len(bytes_of), added)

    def learn(self) -> None:
        ids, sizes = self.encode_words(self.codes.new)
        self.codes.new = []
        self.starts = np.append(self.starts, self.starts[-1] + np.cumsum(sizes))
        self.ids = np.append(self.ids, ids)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.codes) > CACHED:
            self.clear()
        out: list[np.ndarray] = [None] * len(texts)  # type: ignore[list-item]
        plain = [k for k, t in enumerate(texts) if not self.unsafe.search(t)]
        words = [texts[k].split(" ") for k in plain]
        odd = sorted(set(range(len(texts))).difference(plain))
        # First words have no space before them: they, and texts with odd white space, are encoded as they are.
        heads = self.encode_many([w[0] for w in words] + [texts[k] for k in odd])
        heads = [np.asarray(x, np.int64) for x in heads]
        for k, ids in zip(odd, heads[len(plain) :], strict=True):
            out[k] = ids
        sizes = [len(w) - 1 for w in words]
        c = np.fromiter(map(self.codes.__getitem__, chain.from_iterable(islice(w, 1, None) for w in words)), np.int64, sum(sizes))
        if self.codes.new:
            self.learn()
        begin, size = self.starts[c], self.starts[c + 1] - self.starts[c]
        ends = np.cumsum(size)
        ids = self.ids[np.repeat(begin - (ends - size), size) + np.arange(size.sum())]
        cut = np.r_[0, ends][np.cumsum(sizes)] if sizes else []
        for k, head, rest in zip(plain, heads, np.split(ids, cut)[: len(plain)], strict=False):
            out[k] = np.concatenate([head, rest])
        return out
