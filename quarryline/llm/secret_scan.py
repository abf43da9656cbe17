"""Secrets: fixed patterns, and what a linear-chain conditional random field finds beside them.

The patterns (``base_spans``) give the kinds assign, access and hex. The chain tags tokens as the begin of a secret, inside or
outside. A token's features are its shape (length, kinds of characters, changes between them, beginning), its neighbours up to
three tokens before and two after it (words that stand near secrets, punctuation, else their shape), and its file (length,
shares of digits and of signs, length of lines). A line is a chain, with outside before and after it.

The weights are learnt from what the patterns mark in at most about FIT_DOCS documents with and as many without marks, chosen by
hash: the only bound, in rows; their whole texts count. Each step of L-BFGS is a Spark job that adds up gradients of its
partitions by the forward-backward algorithm; only sums reach the driver. Every text is scanned whole. Viterbi decoding runs
where a token could gain by not being outside: around such tokens as far as all gains of the line could pay for, which leaves
the best path as it is (tests against all paths).

Null and empty texts have no secrets. Rows are scanned alone, so repeats and ties agree. An empty table, or one without marks, gives
a chain that marks nothing. Extra columns stay; the result replaces a column of its name. Offsets are in code points.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.llm.shared import materialize, small_batches

#: Fixed patterns, by kind in the order of equal starts, with the group that holds the secret and its least length.
BASE = {
    "assign": (re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile(r"[0-9a-f]{24,}"), 0, 24),
}
#: Parts of words without which there is no assignment, in lower case.
KEYWORDS = (b"passw", b"secret", b"token", b"api")
#: The kind of spans that the chain adds.
FOUND = "found"
#: What a text with marks matches, and some others do.
MAY_HOLD = r"[0-9a-f]{24}|AKIA[A-Z0-9]{16}|(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{6}"

#: Documents with marks that the chain learns from, and as many without, about.
FIT_DOCS = 400
#: Words near secrets that are told apart: so often in the sample at least, and at most so many.
WORD_COUNT, WORDS = 5, 200
STEPS, PENALTY = 30, 0.5
TOKEN = re.compile(r"\n|[\w+/-]+|[^\w\s]")
OUT, BEGIN, INSIDE = 0, 1, 2
#: The score of what can't be.
FORBIDDEN = -1e9
OFFSETS = (-3, -2, -1, 1, 2)
#: Tokens that a worker remembers before it starts anew.
CACHED = 300_000
#: Characters of texts that are scored together.
AT_ONCE = 1 << 20
#: Tokens of the sample whose gradient is taken together.
TOKENS_AT_ONCE = 50_000

LENGTHS = np.array([2, 3, 4, 6, 8, 12, 16, 20, 24, 32, 40, 64])
KINDS = len(LENGTHS) + 1
#: Beginnings count for tokens from LONG characters on.
LONG, BEGINNINGS = 16, 256
#: Sizes of a token's own features: length, kinds of characters, hexadecimal, changes, length with kinds, beginning.
OWN = (KINDS, 32, 4, 7, KINDS * 32, BEGINNINGS + 1)
OWN_AT = np.concatenate([[0], np.cumsum(OWN)])
#: Neighbours that aren't known words: the line's edge, ASCII signs by code, other tokens by kinds of characters.
EDGE, SIGNS = 0, 128
FILE = (21, 6, 6, 12)
FILE_AT = np.concatenate([[0], np.cumsum(FILE)])


def base_spans(text: str) -> list[tuple[int, str, int, int, int]]:
    """(start, kind, end, begin and end of the secret in it), by start, then as kinds are listed."""
    low = text.encode("utf-8", "surrogatepass").lower()
    out = []
    for kind, (pattern, group, least) in BASE.items():
        if kind == "assign" and not any(k in low for k in KEYWORDS) or kind == "access" and b"akia" not in low:
            continue
        out += [(m.start(), kind, m.end(), *m.span(group)) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    rank = list(BASE)
    return sorted(out, key=lambda s: (s[0], rank.index(s[1])))


def _kinds() -> np.ndarray:
    """Kinds of characters by code: lower and upper case ASCII letters, digits, other characters beyond ASCII, signs."""
    out = np.full(129, 4)
    for k, (first, last) in enumerate(("az", "AZ", "09")):
        out[ord(first) : ord(last) + 1] = k
    out[128] = 3
    return out


KIND = _kinds()
HEX = np.isin(np.arange(129), [ord(c) for c in "0123456789abcdefABCDEF"])


def shapes(tokens: list[str]) -> np.ndarray:
    """(token, feature): the tokens' own features, as places in one list of all of them."""
    codes = np.frombuffer("".join(tokens).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    first = np.cumsum(sizes) - sizes
    low = np.minimum(codes, 128)
    kind = KIND[low]
    mask = np.bitwise_or.reduceat(1 << kind, first)
    change = np.concatenate([[0], np.diff(kind) != 0])
    change[first] = 0
    changes = np.minimum(6, np.ceil(np.log2(np.add.reduceat(change, first) + 1)).astype(np.int64))
    size = np.searchsorted(LENGTHS, sizes, side="right")
    # Not hexadecimal, letters alone, letters and digits, digits alone.
    is_hex = np.where(~np.logical_and.reduceat(HEX[low], first), 0, np.where((mask & 4) == 0, 1, np.where(mask == 4, 3, 2)))
    begin = np.zeros(len(tokens), np.int64)
    long = sizes >= LONG
    for k in range(4):
        begin[long] = (begin[long] * 31 + codes[first[long] + k]) % BEGINNINGS
    begin[long] += 1
    return np.stack([size, mask, is_hex, changes, size * 32 + mask, begin], axis=1) + OWN_AT[:-1]


@dataclass
class Words:
    """Known neighbours; a token's class is its word's, or what its signs or characters are."""

    words: dict[str, int]

    @property
    def classes(self) -> int:
        return SIGNS + 32 + len(self.words)

    def of(self, tokens: list[str], own: np.ndarray) -> np.ndarray:
        get = self.words.get
        plain = [ord(t) if len(t) == 1 and "\n" < t < "\x7f" else -1 for t in tokens]
        known = np.array([get(t.lower(), -1) for t in tokens])
        return np.where(known >= 0, SIGNS + 32 + known, np.where(np.array(plain) >= 0, plain, SIGNS + own[:, 1] - OWN_AT[1]))


class Types(dict):
    """Numbers tokens as they come (a line's end is 0); own features, class and score of each stand in arrays that grow with them."""

    def __init__(self, words: Words, weights: Weights | None = None):
        self.words, self.weights, self.new = words, weights, []
        self.own, self.near, self.score = np.zeros((0, len(OWN)), np.int32), np.zeros(0, np.int32), np.zeros((0, 3))
        self["\n"]

    def __missing__(self, token: str) -> int:
        n = self[token] = len(self)
        self.new.append(token)
        return n

    def of(self, tokens: list[str]) -> np.ndarray:
        codes = np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))
        if self.new:
            own = shapes(self.new)
            near = self.words.of(self.new, own)
            near[[t == "\n" for t in self.new]] = EDGE
            if self.weights is not None:
                self.score = np.concatenate([self.score, self.weights.parts()[0][own].sum(axis=1)])
            self.own, self.near, self.new = np.concatenate([self.own, own.astype(np.int32)]), np.concatenate([self.near, near.astype(np.int32)]), []
        return codes


def file_features(codes: np.ndarray, mask: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(text, feature) of texts that lie one after another, each beginning at first with a line's end (0) before it: how many tokens,
    shares with digits and of signs, length of lines."""
    n = np.diff(np.append(first, len(codes)))
    count = lambda x: np.add.reduceat(x.astype(np.int64), first)
    bits = lambda x: np.ceil(np.log2(x + 1)).astype(np.int64)
    share = lambda x: np.searchsorted([0.001, 0.01, 0.03, 0.1, 0.3], count(x) / n)
    values = np.minimum(20, bits(n)), share((mask & 4) > 0), share(mask == 16), np.minimum(11, bits(n // count(codes == 0)))
    return np.stack(values, axis=1) + FILE_AT[:-1]


@dataclass
class Weights:
    """All weights in one vector: own, near by offset, file, and steps from tag to tag."""

    vector: np.ndarray
    classes: int

    @staticmethod
    def size(classes: int) -> int:
        return 3 * int(OWN_AT[-1] + len(OFFSETS) * classes + FILE_AT[-1]) + 9

    def parts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Views of the vector."""
        v, out = self.vector, []
        for n in (int(OWN_AT[-1]), len(OFFSETS) * self.classes, int(FILE_AT[-1]), 3):
            out.append(v[: 3 * n].reshape(n, 3))
            v = v[3 * n :]
        return out[0], out[1].reshape(len(OFFSETS), self.classes, 3), out[2], out[3]

    def steps(self) -> np.ndarray:
        """From tag (row) to tag; inside follows begin or inside only."""
        s = self.parts()[3].copy()
        s[OUT, INSIDE] = FORBIDDEN
        return s


def neighbours(near: np.ndarray) -> np.ndarray:
    """Classes of the neighbours (offset, token); what lies beyond a line is its edge."""
    n = len(near)
    line = np.cumsum(near == EDGE)
    out = np.full((len(OFFSETS), n), EDGE)
    for k, o in enumerate(OFFSETS):
        here, there = slice(max(0, -o), n - max(0, o)), slice(max(0, o), n - max(0, -o))
        if n > abs(o):
            out[k, here] = np.where(line[here] == line[there], near[there], EDGE)
    return out


def emissions(score: np.ndarray, near: np.ndarray, file: np.ndarray, w: Weights) -> np.ndarray:
    """(token, tag) scores from those of own features, neighbours and files; those of line ends mean nothing."""
    e = score + file
    for k, classes in enumerate(neighbours(near)):
        e += w.parts()[1][k][classes]
    return e


def padded(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For chains that lie one after another: (step, chain) places of their tokens and which of these there are."""
    starts = np.cumsum(sizes) - sizes
    step = np.arange(sizes.max(initial=0))[:, None]
    there = step < sizes
    return np.where(there, starts + step, 0), there


def of_like_length(sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Chains that lie one after another, by lengths from a power of two to the next: places of their tokens, and sizes."""
    starts = np.cumsum(sizes) - sizes
    order = np.ceil(np.log2(np.maximum(sizes, 1)))
    for k in np.unique(order[sizes > 0]):
        chosen = (order == k) & (sizes > 0)
        n = sizes[chosen]
        yield np.repeat(starts[chosen] - (np.cumsum(n) - n), n) + np.arange(n.sum()), n


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def expectations(e: np.ndarray, sizes: np.ndarray, steps: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Forward-backward: the sum of log partition functions of the chains, (token, tag) marginals, expected steps."""
    at, there = padded(sizes)
    n, chains = at.shape
    alpha, beta = np.empty((n, chains, 3)), np.empty((n, chains, 3))
    last = np.broadcast_to(np.array([0.0, FORBIDDEN, FORBIDDEN]), (chains, 3))
    for t in range(n):
        now = log_sum(last[:, :, None] + steps[None], 1) + e[at[t]]
        alpha[t] = last = np.where(there[t][:, None], now, last)
    total = log_sum(last + steps[:, OUT], 1)
    beta_next = np.broadcast_to(steps[:, OUT], (chains, 3))
    for t in range(n - 1, -1, -1):
        beta[t] = beta_next
        beta_next = np.where(there[t][:, None], log_sum(steps[None] + (e[at[t]] + beta_next)[:, None, :], 2), beta_next)
    marginal = np.zeros_like(e)
    marginal[at[there]] = np.exp(alpha + beta - total[None, :, None])[there]
    # Steps into each token, and those out of the last.
    before = np.concatenate([np.broadcast_to(np.array([0.0, FORBIDDEN, FORBIDDEN]), (1, chains, 3)), alpha[:-1]])
    into = np.exp(before[:, :, :, None] + steps[None, None] + (e[at] + beta)[:, :, None, :] - total[None, :, None, None])
    final = np.exp(last + steps[:, OUT] - total[:, None]).sum(axis=0)
    pairs = into[there].sum(axis=0)
    pairs[:, OUT] += final
    return float(total.sum()), marginal, pairs


def best_tags(e: np.ndarray, sizes: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Viterbi: the best tags of chains that lie one after another, each with outside before and after; of equal paths the one further outside."""
    at, there = padded(sizes)
    n, chains = at.shape
    back = np.zeros((n, chains, 3), np.int8)
    last = np.broadcast_to(np.array([0.0, FORBIDDEN, FORBIDDEN]), (chains, 3))
    for t in range(n):
        ways = last[:, :, None] + steps[None]
        back[t] = ways.argmax(axis=1)
        last = np.where(there[t][:, None], ways.max(axis=1) + e[at[t]], last)
    tag = (last + steps[:, OUT]).argmax(axis=1)
    out = np.zeros(len(e), np.int8)
    for t in range(n - 1, -1, -1):
        here = there[t]
        out[at[t][here]] = tag[here]
        tag = np.where(here, back[t][np.arange(chains), tag], tag)
    return out


def windows(e: np.ndarray, ends: np.ndarray, steps: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of tokens beyond which the best path is outside. ends marks line ends, which are outside.

    Being begin or inside rather than outside gains at most g at a token, whatever stands around it. A stretch whose g sum up to less than
    nothing is better outside; so no tag but outside reaches further from a token with a gain than all gains of its line pay for.
    """
    stay = steps[OUT, OUT]
    leave = max(0.0, max(steps[BEGIN, OUT], steps[INSIDE, OUT]) - stay)
    begin = e[:, BEGIN] - e[:, OUT] + steps[:, BEGIN].max() - stay + leave
    inside = e[:, INSIDE] - e[:, OUT] + steps[1:, INSIDE].max() - stay
    g = np.maximum(begin, inside)
    gains = np.flatnonzero((g > 0) & ~ends)
    if not len(gains):
        return []
    loss = np.concatenate([[0.0], np.cumsum(np.where(ends, 0.0, np.maximum(-g, 0.0)))])
    edges = np.concatenate([[-1], np.flatnonzero(ends), [len(e)]])
    line = np.searchsorted(edges, gains, side="right") - 1
    purse = np.bincount(line, g[gains], len(edges))[line] + 1e-6
    left = np.maximum(np.searchsorted(loss, loss[gains] - purse, side="right") - 1, edges[line] + 1)
    right = np.minimum(np.searchsorted(loss, loss[gains + 1] + purse, side="left"), edges[line + 1])
    out: list[list[int]] = []
    for a, b in zip(left.tolist(), right.tolist(), strict=True):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


@dataclass
class SecretModel:
    words: Words
    weights: Weights | None = None

    def types(self) -> Types:
        return Types(self.words, self.weights)

    def find(self, texts: list[str], types: Types) -> list[list[tuple[int, int]]]:
        """Spans of secrets by the chain, a list a text: begin and what is inside after it."""
        out: list[list[tuple[int, int]]] = [[] for _ in texts]
        if self.weights is None or not texts:
            return out
        tokens, sizes = [], []
        for text in texts:
            tokens.append("\n")
            tokens += TOKEN.findall(text)
            sizes.append(len(tokens))
        codes, first = types.of(tokens), np.array([0, *sizes[:-1]])
        del tokens
        file = file_features(codes, types.own[codes, 1] - OWN_AT[1], first)
        per_file = self.weights.parts()[2][file].sum(axis=1)
        e = emissions(types.score[codes], types.near[codes], np.repeat(per_file, np.diff([*first, len(codes)]), axis=0), self.weights)
        steps, ends = self.weights.steps(), codes == 0
        # Windows of neighbouring lines may touch: chains end where lines do.
        chains = [x for a, b in windows(e, ends, steps) for x in _lines(ends, a, b)]
        if not chains:
            return out
        places = np.concatenate([np.arange(a, b) for a, b in chains])
        tags, sizes = np.zeros(len(places), np.int8), np.array([b - a for a, b in chains])
        for part, n in of_like_length(sizes):
            tags[part] = best_tags(e[places[part]], n, steps)
        found: list[list[int]] = []
        for k, tag in zip(places[tags != OUT].tolist(), tags[tags != OUT].tolist(), strict=True):
            if tag == BEGIN:
                found.append([k, k])
            else:
                found[-1][1] = k
        at: dict[int, list[tuple[int, int]]] = {}
        for a, b in found:
            doc = int(np.searchsorted(first, a, side="right")) - 1
            if doc not in at:
                at[doc] = [m.span() for m in TOKEN.finditer(texts[doc])]
            base = int(first[doc]) + 1
            out[doc].append((at[doc][a - base][0], at[doc][b - base][1]))
        return out

    def spans(self, texts: list[str], types: Types) -> list[list[tuple[int, str, int]]]:
        """(start, kind, end) of the patterns and, where they touch none of these, of the chain; a list a text."""
        rank, out = [*BASE, FOUND], []
        for text, more in zip(texts, self.find(texts, types), strict=True):
            base = [(s[0], s[1], s[2]) for s in base_spans(text)]
            more = [(a, FOUND, b) for a, b in more if not any(a < e and s < b for s, _, e in base)]
            out.append(sorted(base + more, key=lambda s: (s[0], rank.index(s[1]))))
        return out


def _lines(ends: np.ndarray, a: int, b: int) -> Iterator[tuple[int, int]]:
    cuts = [a - 1, *(np.flatnonzero(ends[a:b]) + a).tolist(), b]
    for x, y in pairwise(cuts):
        if y > x + 1:
            yield x + 1, y


def _chosen(docs: DataFrame, fit_docs: int) -> DataFrame:
    """About fit_docs texts that may hold marks and as many others, by a hash of row and text."""
    slim = docs.select(F.col("text").cast("string").alias("text"), F.xxhash64("doc_id", "text").alias("h")).where("text is not null and text <> ''")
    may = F.col("text").rlike(MAY_HOLD)
    counts = {r["may"]: r["n"] for r in slim.groupBy(may.alias("may")).agg(F.count("*").alias("n")).collect()}
    share = lambda c: min(1.0, fit_docs / max(1, counts.get(c, 0)))
    drawn = lambda c: F.pmod("h", F.lit(1 << 20)) < share(c) * (1 << 20)
    return slim.where(drawn(True) | drawn(False)).where(F.when(may, drawn(True)).otherwise(drawn(False))).select("text")


def _marked(text: str) -> tuple[list[str], np.ndarray]:
    """Tokens and the tags that the patterns' secrets give them."""
    found = list(TOKEN.finditer(text))
    starts, ends = np.array([m.start() for m in found], np.int64), np.array([m.end() for m in found], np.int64)
    tags, until = np.zeros(len(found), np.int8), -1
    for a, b in sorted(s[3:] for s in base_spans(text)):
        first, last = np.searchsorted(ends, a, side="right"), np.searchsorted(starts, b, side="left")
        if a >= until:
            tags[first:last] = INSIDE
            tags[first : first + 1] = BEGIN
            until = b
    tags[[m[0] == "\n" for m in found]] = OUT
    return [m[0] for m in found], tags


def _near_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    seen: Counter = Counter()
    for batch in batches:
        for text in batch["text"]:
            tokens, tags = _marked(text)
            for k in np.flatnonzero(tags == BEGIN).tolist():
                seen.update(t.lower() for o in OFFSETS if 0 <= k + o < len(tokens) and not tags[k + o] and (t := tokens[k + o])[0].isalpha())
    yield pd.DataFrame(list(seen.items()), columns=["word", "n"])


def _encoded(words: Words):
    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        types = Types(words)
        for batch in batches:
            rows = []
            for text in batch["text"]:
                tokens, tags = _marked(text)
                codes = types.of(["\n", *tokens])
                own = types.own[codes]
                arrays = own, types.near[codes], np.concatenate([[OUT], tags]), file_features(codes, own[:, 1] - OWN_AT[1], np.array([0]))[0]
                rows.append(tuple(np.asarray(x, np.int32).tobytes() for x in arrays))
            yield pd.DataFrame(rows, columns=["own", "near", "tags", "file"])

    return encode


def add_gradient(own: np.ndarray, near: np.ndarray, tags: np.ndarray, file: np.ndarray, w: Weights, into: Weights) -> float:
    """Adds the gradient of tokens' log-likelihood, of which each line is a chain, to into; returns the log-likelihood.

    own and file have the features of every token (file those of its text), near its class; line ends have tags that mean nothing.
    """
    own_weights, _, file_weights, _ = w.parts()
    a, b, c, s = into.parts()
    inner = near != EDGE
    e = emissions(own_weights[own].sum(axis=1), near, file_weights[file].sum(axis=1), w)[inner]
    own, file, y, around = own[inner], file[inner], tags[inner], neighbours(near)[:, inner]
    sizes = np.diff(np.flatnonzero(np.concatenate([[True], ~inner, [True]]))) - 1
    steps, value, delta = w.steps(), 0.0, np.zeros_like(e)
    for part, n in of_like_length(sizes):
        total, marginal, pairs = expectations(e[part], n, steps)
        tag, first = y[part], np.cumsum(n) - n
        delta[part] = -marginal
        delta[part, tag] += 1
        before = np.concatenate([[OUT], tag[:-1]])
        before[first] = OUT
        last = tag[first + n - 1]
        value += float(e[part, tag].sum() + steps[before, tag].sum() + steps[last, OUT].sum() - total)
        np.add.at(s, (before, tag), 1)
        np.add.at(s, (last, OUT), 1)
        s -= pairs
    for tag in range(3):
        for k in range(own.shape[1]):
            a[:, tag] += np.bincount(own[:, k], delta[:, tag], len(a))
        for k in range(len(OFFSETS)):
            b[k, :, tag] += np.bincount(around[k], delta[:, tag], b.shape[1])
        for k in range(file.shape[1]):
            c[:, tag] += np.bincount(file[:, k], delta[:, tag], len(c))
    return value


def _gradients(w: Weights):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        into, value = Weights(np.zeros_like(w.vector), w.classes), 0.0
        for batch in batches:
            part: list[tuple] = []
            for k, r in enumerate(batch.itertuples(), 1):
                own, near, tags, file = (np.frombuffer(x, np.int32).astype(np.int64) for x in (r.own, r.near, r.tags, r.file))
                part.append((own.reshape(-1, len(OWN)), near, tags, np.tile(file, (len(near), 1))))
                if sum(len(p[1]) for p in part) >= TOKENS_AT_ONCE or k == len(batch):
                    value += add_gradient(*(np.concatenate(x) for x in zip(*part, strict=True)), w, into)
                    part = []
        yield pd.DataFrame({"value": [value], "gradient": [into.vector.tobytes()]})

    return run


def _lbfgs(loss, x: np.ndarray, steps: int, memory: int = 8) -> np.ndarray:
    """Minimises loss(x) -> (value, gradient) by limited-memory BFGS with halved steps."""
    value, g = loss(x)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        d, kept = g.copy(), []
        for s, y in reversed(pairs):
            r = (s @ d) / (s @ y)
            kept.append(r)
            d -= r * y
        d *= (pairs[-1][0] @ pairs[-1][1]) / (pairs[-1][1] @ pairs[-1][1]) if pairs else 1 / max(1.0, np.abs(g).max())
        for (s, y), r in zip(pairs, reversed(kept), strict=True):
            d += (r - (y @ d) / (s @ y)) * s
        size = 1.0
        while size > 1e-3:
            new = x - size * d
            new_value, new_g = loss(new)
            if new_value <= value - 1e-4 * size * (d @ g):
                break
            size /= 2
        else:
            return x
        s, y = new - x, new_g - g
        if s @ y > 1e-10:
            pairs = [*pairs[1 - memory :], (s, y)] if len(pairs) >= memory else [*pairs, (s, y)]
        done = value - new_value < 1e-4 * max(1.0, abs(value))
        x, value, g = new, new_value, new_g
        if done:
            break
    return x


def fit_secrets(docs: DataFrame, fit_docs: int = FIT_DOCS, steps: int = STEPS) -> SecretModel:
    """Learns the chain from the patterns' marks in a sample of doc_id and text."""
    spark = docs.sparkSession
    small_batches(spark)
    sample = materialize(_chosen(docs, fit_docs).repartition(16), "secrets-sample")
    counted = sample.mapInPandas(_near_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= WORD_COUNT)
    words = Words({r["word"]: k for k, r in enumerate(counted.orderBy(F.desc("n"), "word").limit(WORDS).collect())})
    encoded = materialize(sample.mapInPandas(_encoded(words), "own binary, near binary, tags binary, file binary"), "secrets-encoded")
    model = SecretModel(words)
    if encoded.isEmpty():
        return model

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        sums = encoded.mapInPandas(_gradients(Weights(x, words.classes)), "value double, gradient binary").collect()
        gradient = sum((np.frombuffer(r["gradient"]) for r in sums), np.zeros_like(x))
        return PENALTY * float(x @ x) - sum(r["value"] for r in sums), 2 * PENALTY * x - gradient

    model.weights = Weights(_lbfgs(loss, np.zeros(Weights.size(words.classes)), steps), words.classes)
    return model


def _parts(texts: list[str]) -> Iterator[list[str]]:
    """Texts in runs of about AT_ONCE characters."""
    part, size = [], 0
    for text in texts:
        part.append(text)
        size += len(text)
        if size >= AT_ONCE:
            yield part
            part, size = [], 0
    if part:
        yield part


def find_secrets(docs: DataFrame, model: SecretModel, text: str = "text", out: str = "secrets") -> DataFrame:
    """docs with an array of (kind, start, end): the patterns' spans and those that the chain adds, by start, then kind."""
    small_batches(docs.sparkSession)

    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        types = model.types()
        for batch in batches:
            texts, out = [t or "" for t in batch], []
            for part in _parts(texts):
                if len(types) > CACHED:
                    types = model.types()
                out += [",".join(f"{k}:{a}:{b}" for a, k, b in x) for x in model.spans(part, types)]
            yield pd.Series(out, dtype=str)

    def span(x: Column) -> Column:
        part = F.split(x, ":")
        return F.struct(F.get(part, F.lit(0)).alias("kind"), F.get(part, F.lit(1)).cast("int").alias("start"), F.get(part, F.lit(2)).cast("int").alias("end"))

    found = F.pandas_udf(scan, "string")(F.col(text).cast("string"))
    listed = docs.withColumn(out, found)
    return listed.withColumn(out, F.transform(F.filter(F.split(out, ","), lambda x: x != ""), span))
