"""Operator 7: language identification by cross-parsing entropy.

A sample of labelled text per language becomes a suffix automaton, which knows every substring of its sample. A text is
parsed against each: the longest match from the current place is a phrase, and the next begins after it. A language whose
text shares long passages with the sample needs few phrases; phrases times the logarithm of the sample's length, per
character, estimates the cross entropy in bits. The language with the fewest such bits wins.

Texts are parsed whole. Stretches of ``BLOCK`` characters of all texts of a batch advance together, a numpy step for the next
character of all, each as if a phrase began with it. Then the parse that comes over a stretch's border follows until it is
in the same state as the stretch's own, from where on both are one, and the phrases until there are put right. A text in
which they never meet within a stretch is walked from its start. So the phrases are those of one parse of the whole text.
The automata are tables [state, character] for a language's
``ALPHABET`` most usual characters; moves by its other characters stand in sorted keys, so that every character counts.

What is learnt is bounded in labelled rows by a parameter of ``sample_languages``: ``docs_each`` documents a language, chosen by hash,
with their whole texts. Prediction reads the text alone.

Letters are characters of the Unicode categories L; marks (M), as vowel signs, stay with them. Whatever else stands between
is one space.

Defined results: null text, and text without a letter, is ``und`` with score 0, as is every text if nothing was learnt; rows
are predicted alone, so repeats agree; equal bits go to the language that comes first in code point order; an empty table
gives no rows; extra columns stay.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.llm.shared import small_batches

#: Documents of a language that are learnt from.
DOCS = 20
#: Characters with a column in the table.
ALPHABET = 120
#: Characters of a stretch, and stretches that advance together. Neither changes a result.
BLOCK, TOGETHER = 256, 16_384
UNKNOWN = "und"
OTHER = regex.compile(r"[^\p{L}\p{M}]+")
LETTER = regex.compile(r"\p{L}")


def normalise(text: str | None) -> str:
    """Lower-case letters and their marks, with one space for whatever stands between; empty without a letter."""
    plain = OTHER.sub(" ", (text or "").lower()).strip()
    return plain if LETTER.search(plain) else ""


def suffix_automaton(text: str) -> list[dict[str, int]]:
    """Transitions of the states of the suffix automaton; 0 is the start."""
    step: list[dict[str, int]] = [{}]
    link, size, last = [-1], [0], 0
    for c in text:
        new = len(step)
        step.append({})
        size.append(size[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if size[p] + 1 == size[q]:
                link[new] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                size.append(size[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return step


class Automaton:
    """The moves of one language's sample. Code 0 stands for characters that it doesn't hold, codes from width on for rare ones."""

    def __init__(self, sample: str):
        known = [c for c, _ in sorted(Counter(sample).items(), key=lambda x: (-x[1], x[0]))]
        self.code = np.zeros(0x110000, np.int32)
        self.code[[ord(c) for c in known]] = np.arange(1, len(known) + 1)
        states = suffix_automaton(sample)
        self.width, self.codes = min(len(known), ALPHABET) + 1, len(known) + 1
        self.next = np.full((len(states), self.width), -1, np.int32)
        #: Where a phrase that begins with a character stands; 0 if the character is a phrase of its own.
        self.begin = np.zeros(self.codes, np.int32)
        at = {c: k for k, c in enumerate(known, 1)}
        rare = []
        for s, moves in enumerate(states):
            for c, t in moves.items():
                k = at[c]
                if k < self.width:
                    self.next[s, k] = t
                else:
                    rare.append((s * self.codes + k, t))
                if s == 0:
                    self.begin[k] = t
        self.keys, self.to = np.array(sorted(rare), np.int64).reshape(-1, 2).T
        self.rare = dict(rare)
        self.next = self.next.ravel()
        self.moves, self.begins = memoryview(self.next), self.begin.tolist()
        self.bits = math.log2(len(sample) + 1)

    def step(self, at: np.ndarray, c: np.ndarray, rare: bool) -> tuple[np.ndarray, np.ndarray]:
        """States after a character, and whether a phrase begins with it: at the start, where the last one can't go on, and after a character of no sample."""
        to = self.next[at * self.width + np.where(c < self.width, c, 0)] if rare else self.next[at * self.width + c]
        if rare and len(own := np.flatnonzero(c >= self.width)):
            key = at[own].astype(np.int64) * self.codes + c[own]
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            to[own] = np.where(self.keys[place] == key, self.to[place], -1)
        missed = to < 0
        return np.where(missed, self.begin[c], to), missed | (at == 0)

    def phrases(self, chars: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Phrases of each text; the texts follow one another in chars."""
        codes = self.code[chars]
        rare = bool((codes >= self.width).any())
        blocks = -(-sizes // BLOCK)
        doc = np.repeat(np.arange(len(sizes)), blocks)
        inside = (np.arange(len(doc)) - np.repeat(np.cumsum(blocks) - blocks, blocks)) * BLOCK
        start = np.repeat(np.cumsum(sizes) - sizes, blocks) + inside
        size = np.minimum(BLOCK, sizes[doc] - inside)
        count, state = np.zeros(len(doc), np.int64), np.zeros(len(doc), np.int32)
        order = np.argsort(-size, kind="stable")
        for b in range(0, len(order), TOGETHER):
            own = order[b : b + TOGETHER]
            for k in range(size[own[0]]):
                own = own[: np.searchsorted(-size[own], -k, "left")]
                state[own], new = self.step(state[own], codes[start[own] + k], rare)
                count[own] += new
        # Over the borders: two parses of each stretch but a text's first, until they meet.
        own = np.flatnonzero(inside)
        come, alone, apart = state[own - 1], np.zeros(len(own), np.int32), []
        for k in range(BLOCK):
            if not len(own):
                break
            c = codes[start[own] + k]
            (come, a), (alone, b) = self.step(come, c, rare), self.step(alone, c, rare)
            count[own] += a.astype(np.int64) - b
            live = come != alone
            over = live & (size[own] == k + 1)
            # A text's last stretch may end before they meet: its phrases are right all the same.
            apart.append(doc[own[over & (inside[own] + k + 1 < sizes[doc[own]])]])
            live &= ~over
            own, come, alone = own[live], come[live], alone[live]
        out = np.bincount(doc, count, len(sizes)).astype(np.int64)
        ends = np.cumsum(sizes)
        for d in np.unique(np.concatenate([*apart, np.zeros(0, np.int64)])).tolist():
            out[d] = self.walk(codes[ends[d] - sizes[d] : ends[d]].tolist(), 0)
        return out

    def walk(self, codes: list[int], state: int) -> int:
        """The phrases of a text, a character at a time."""
        moves, begins, rare, width, codes_n, count = self.moves, self.begins, self.rare, self.width, self.codes, 0
        for c in codes:
            to = moves[state * width + c] if c < width else rare.get(state * codes_n + c, -1)
            if to < 0 or state == 0:
                count += 1
            state = begins[c] if to < 0 else to
        return count


class LanguageModel:
    def __init__(self, samples: dict[str, str]):
        self.names = sorted(samples)
        self.automata = [Automaton(samples[n]) for n in self.names]

    def predict(self, texts) -> tuple[list[str], np.ndarray]:
        """Languages and scores; a score is the share of the winner's inverse bits."""
        plain = [normalise(t) for t in texts]
        names, scores = [UNKNOWN] * len(plain), np.zeros(len(plain))
        own = [k for k, t in enumerate(plain) if t]
        if not own or not self.names:
            return names, scores
        sizes = np.array([len(plain[k]) for k in own])
        chars = np.frombuffer("".join([plain[k] for k in own]).encode("utf-32-le", "surrogatepass"), "<u4")
        bits = np.stack([a.phrases(chars, sizes) * a.bits / sizes for a in self.automata])
        best = bits.argmin(axis=0)
        share = (1 / bits[best, np.arange(len(own))]) / (1 / bits).sum(axis=0)
        for j, k in enumerate(own):
            names[k] = self.names[best[j]]
        scores[own] = share
        return names, scores


@lru_cache(maxsize=2)
def model_of(samples: tuple[tuple[str, str], ...]) -> LanguageModel:
    return LanguageModel(dict(samples))


def sample_languages(docs: DataFrame, learn_from: Column, docs_each: int = DOCS) -> tuple[tuple[str, str], ...]:
    """(lang, text sample) of each language: the whole texts of docs_each documents at most that may be learnt from, of equal texts one."""
    own = docs.where(learn_from & F.col("lang").isNotNull() & F.col("text").isNotNull())
    # One number a language; the languages' automata stand on the driver anyway.
    n = {r["lang"]: r["count"] for r in own.groupBy("lang").count().collect()}
    if not n:
        return ()
    # Some more than are wanted are drawn, as copies of one text count once, and the first of them are taken.
    share = F.create_map(*[F.lit(x) for lang, count in sorted(n.items()) for x in (lang, 8 * (docs_each + 4) / count)])
    draw = F.pmod(F.xxhash64("text"), F.lit(1 << 40)) / (1 << 40)
    few = own.where(draw < share[F.col("lang")]).select("lang", "text", draw.alias("draw")).dropDuplicates(["lang", "text"])
    first = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "text"))
    texts: dict[str, list[str]] = {}
    for r in few.withColumn("_n", first).where(F.col("_n") <= docs_each).orderBy("lang", "_n").toLocalIterator():
        texts.setdefault(r["lang"], []).append(normalise(r["text"]))
    return tuple((k, " ".join(v)) for k, v in sorted(texts.items()) if any(v))


def identify(docs: DataFrame, samples: tuple[tuple[str, str], ...], text_col: str = "text") -> DataFrame:
    """Add lang_pred and score."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(samples)

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        names, scores = model_of(shared.value).predict(texts)
        return pd.DataFrame({"lang_pred": names, "score": scores})

    return docs.withColumn("_p", predict(F.col(text_col).cast("string"))).withColumns({"lang_pred": F.col("_p.lang_pred"), "score": F.col("_p.score")}).drop("_p")
