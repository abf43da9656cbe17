"""Operator 9: removal of repeated byte strings, by suffix arrays.

Every byte goes that a string of ``length`` bytes covers which also starts anywhere else in the corpus, the same document
included. The suffix array of the whole corpus is built in parts that a repeated string can't straddle:

1. Each window of ``length`` bytes belongs to its anchor, the least-hashed ``GRAM``-byte gram in it. Equal windows have
   equal anchors at equal offsets, so windows need comparing under their anchor's hash only. An anchor's context is the
   bytes of all windows that belong to it.
2. Contexts that are equal as a whole are repeats as they stand, however many there are; of each, one represents all.
   Anchors whose hash has a single context are done.
3. The different contexts that share anchors are cut into symbols of ``SYMBOL`` bytes from the anchor on, concatenated, and
   suffix-sorted. Neighbours in the order that share enough symbols hold repeats; the few windows at the ends of a shared
   run, which no whole number of symbols tells, are compared as bytes within their run.

The suffix array is built by grouping in linear passes (``suffix_order``): groups of suffixes that share a Lyndon prefix are
processed in descending order, each suffix points to the last suffix before it in a lower group, and the suffixes pointed
to move up, within their groups, by how often; then the groups' order is emitted in one ascending pass along the same
pointers. No suffix is renamed recursively.

An anchor with more than ``group_limit`` different contexts doesn't go to one task: its windows are counted by hash.

With ``words``, every so many words that also start anywhere else go too, from the first word's first byte to the last
one's last, whatever white space stands between them. These are found in the same way and in the same passes, in a second
form of the text that has the 8-byte hash of each word: there the windows are of 8 * ``words`` bytes and start with a word. The lowest bit of an anchor's hash tells the form.

Defined results: null text is empty; texts shorter than ``length`` keep all; copies and repeated rows remove each other
whole; ties don't arise; an empty table gives no rows; extra columns stay with remove_repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarryline.llm.shared import give_back, materialize, small_batches, text_or_empty, tidy

LENGTH = 400
GRAM = 32
SYMBOL = 32
#: Bytes of a word's hash, and of the gram of a text's words: that of eight words, as fewer are shared by chance.
WORD = 8
WORD_GRAM = 64
#: Different contexts of one anchor that a task takes.
GROUP_LIMIT = 50_000
#: Contexts that are sorted together.
TOGETHER = 1500
INDEX_BITS = np.uint64(28)
ODD = [int(x) | 1 for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def suffix_order(text: list[int]) -> list[int]:
    """The suffix array of a list of integers; the end is less than anything."""
    n = len(text)
    order = sorted(range(n), key=text.__getitem__)
    place, group, size = [0] * n, [0] * n, [0] * n
    start = 0
    for k, i in enumerate(order):
        if text[i] != text[order[start]]:
            start = k
        place[i], group[i] = k, start
        size[start] += 1
    before, jump = [-1] * n, [-1] * n
    top = n - 1
    while top >= 0:
        g = group[order[top]]
        members = sorted(order[g : top + 1])
        times: dict[int, int] = {}
        for i in members:
            j = i - 1
            path = []
            while j >= 0 and group[j] >= g:
                path.append(j)
                j = jump[j]
            for k in path:
                jump[k] = j
            before[i] = jump[i] = j
            if j >= 0:
                times[j] = times.get(j, 0) + 1
        by_times: dict[int, list[int]] = {}
        for j, t in times.items():
            by_times.setdefault(t, []).append(j)
        # Those that more members point to come later: they go to the end of their group first.
        for t in sorted(by_times, reverse=True):
            moved = by_times[t]
            for j in moved:
                own = group[j]
                last = own + size[own] - 1
                other, at = order[last], place[j]
                order[at], place[other] = other, at
                order[last], place[j] = j, last
                size[own] -= 1
            begin = {own: own + size[own] for own in {group[j] for j in moved}}
            for j in moved:
                new = group[j] = begin[group[j]]
                size[new] += 1
        top = g - 1
    out, head, done = [-1] * n, list(range(n)), [False] * n
    for k in range(-1, n):
        j = n - 1 if k < 0 else out[k] - 1
        while j >= 0 and not done[j]:
            g = group[j]
            out[head[g]] = j
            head[g] += 1
            done[j] = True
            j = before[j]
    return out


def shared_prefixes(text: list[int], order: list[int]) -> list[int]:
    """For each place of the order, the symbols its suffix shares with the one before it."""
    n = len(text)
    rank, out, k = [0] * n, [0] * n, 0
    for r, i in enumerate(order):
        rank[i] = r
    for i in range(n):
        r = rank[i]
        if r:
            j = order[r - 1]
            while i + k < n and j + k < n and text[i + k] == text[j + k]:
                k += 1
            out[r] = k
            if k:
                k -= 1
        else:
            k = 0
    return out


class WordHashes(dict):
    """Hash of each word met; to be dropped with the batch."""

    def __missing__(self, word: bytes) -> bytes:
        self[word] = out = xxhash.xxh64_digest(word)
        return out


def form_of(data: bytes, unit: int, seen: WordHashes) -> bytes:
    """The text as it stands (unit 0), or the hashes of its words (runs of other bytes than white space; unit 1)."""
    return b"".join(map(seen.__getitem__, data.split())) if unit else data


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Hash of the gram's bytes (or words) from each place, by doubling."""
    h = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(ODD[0])
    size, k = 1, 0
    while size < gram:
        h = h[: len(h) - size] * np.uint64(ODD[k % len(ODD)]) + (h[size:] ^ (h[size:] >> np.uint64(29)))
        size, k = 2 * size, k + 1
    h ^= h >> np.uint64(32)
    return h * np.uint64(ODD[1])


def least_grams(h: np.ndarray, width: int) -> np.ndarray:
    """The place of the least-hashed gram, the first if several are, of each ``width`` neighbours."""
    n = len(h)
    packed = ((h >> INDEX_BITS) << INDEX_BITS) | np.arange(n, dtype=np.uint64)
    # Least of each window: running minima forwards and backwards in runs of the window's width.
    full = -(-n // width) * width
    padded = np.full(full, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = packed
    runs = padded.reshape(-1, width)
    forward = np.minimum.accumulate(runs, axis=1).ravel()
    backward = np.minimum.accumulate(runs[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = n - width + 1
    least = np.minimum(backward[:starts], forward[width - 1 : width - 1 + starts])
    return (least & ((np.uint64(1) << INDEX_BITS) - np.uint64(1))).astype(np.int64)


def anchors(data: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per anchor in order: its hash, place, and the first and last start of the windows that belong to it."""
    h = gram_hashes(np.frombuffer(data, np.uint8))
    at = least_grams(h, length - GRAM + 1)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    last = np.r_[first[1:] - 1, len(at) - 1]
    return h[at[first]].view(np.int64), at[first], first, last


def word_anchors(forms: bytes, sizes: np.ndarray, words: int) -> tuple[np.ndarray, ...]:
    """Anchors of texts whose word hashes stand one after another, ``sizes`` (``words`` or more) of each text.

    Per anchor in order: the text, its hash, place, first and last start; places are counted in words over all texts.
    """
    h = gram_hashes(np.frombuffer(forms, np.uint64), WORD_GRAM // WORD)
    at = least_grams(h, words - WORD_GRAM // WORD + 1)
    # Windows that go over a text's end are none.
    ends = np.cumsum(sizes)
    own = np.repeat(np.arange(len(sizes)), sizes)[: len(at)]
    starts = np.flatnonzero(np.arange(len(at)) + words <= ends[own])
    at = at[starts]
    edge = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    first, last = starts[edge], starts[np.r_[edge[1:] - 1, len(at) - 1]]
    return own[first], h[at[edge]].view(np.int64), at[edge], first, last


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def repeated_windows(contexts: list[bytes], offsets: list[int], known: list[bool], length: int, step: int = 1) -> list[bytearray]:
    """For each context, a flag per window that also stands elsewhere in these contexts.

    ``offsets``: where the anchor stands in the context. Known contexts take part, but need no flags. With ``step``, of
    which offsets are multiples, only flags at its multiples count.
    """
    flags = [bytearray(max(0, len(c) - length + 1)) for c in contexts]
    ids: dict[bytes, int] = {}
    text: list[int] = []
    where: list[tuple[int, int]] = []
    separator = -1
    for k, (c, a) in enumerate(zip(contexts, offsets, strict=True)):
        for s in range(a % SYMBOL, len(c) - SYMBOL + 1, SYMBOL):
            text.append(ids.setdefault(c[s : s + SYMBOL], len(ids)))
            where.append((k, s))
        text.append(separator)
        where.append((k, len(c)))
        separator -= 1
    order = suffix_order(text)
    shared = shared_prefixes(text, order)
    least, sure = (length - SYMBOL + 1) // SYMBOL, -(-length // SYMBOL)
    groups: list[list[int]] = []
    for r in range(1, len(order)):
        if shared[r] >= sure:
            for i in (order[r - 1], order[r]):
                k, s = where[i]
                n = SYMBOL * shared[r] - length + 1
                flags[k][s : s + n] = b"\1" * n
        if shared[r] >= least:
            if shared[r - 1] < least or r == 1:
                groups.append([order[r - 1]])
            groups[-1].append(order[r])
    for group in groups:
        members = [where[i] for i in group]
        for o in range(0, SYMBOL, step):
            here = [(k, s - o) for k, s in members if o <= s <= len(contexts[k]) - length + o]
            if len(here) < 2 or all(known[k] or flags[k][q] for k, q in here):
                continue
            seen: dict[bytes, tuple[int, int]] = {}
            for k, q in here:
                other = seen.setdefault(contexts[k][q : q + length], (k, q))
                if other != (k, q):
                    flags[k][q] = flags[other[0]][other[1]] = 1
    return flags


def runs_of(flags: bytearray) -> list[tuple[int, int]]:
    """(first, last) of the runs of ones."""
    f = np.frombuffer(bytes(flags), np.uint8)
    edges = np.flatnonzero(np.diff(np.r_[0, f, 0]))
    return [(int(a), int(b) - 1) for a, b in edges.reshape(-1, 2)]


def _keyed(docs: DataFrame) -> DataFrame:
    """Texts by a 128-bit key: copies share it."""
    text = text_or_empty()
    return docs.select(F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(7), text).alias("k2"), text.alias("text"))


def _context_hashes(data: bytes, at: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(data[a:b], p - a) >> 1 for a, b, p in zip(begin.tolist(), end.tolist(), at.tolist(), strict=True)], np.int64)


def _fold(doc: np.ndarray, k1: np.ndarray, h: np.ndarray, c: np.ndarray, p: np.ndarray, q0: np.ndarray, q1: np.ndarray) -> tuple[np.ndarray, ...]:
    """(doc, h, c, p, q0, q1, own) of anchors in order of text and place.

    A context that a text holds more than twice gives two rows; runs of contexts that it holds twice are a row with own = 1.
    """
    n = len(c)
    order = np.lexsort((c, doc))
    new = np.flatnonzero(np.r_[True, (np.diff(doc[order]) != 0) | (np.diff(c[order].view(np.uint64)) != 0)])
    sizes = np.diff(np.r_[new, n])
    times, turn = np.empty(n, np.int64), np.empty(n, np.int64)
    times[order], turn[order] = np.repeat(sizes, sizes), np.arange(n) - np.repeat(new, sizes)
    twice, keep = times > 1, turn < 2
    other = np.r_[True, np.diff(doc) != 0]
    a = np.flatnonzero(twice & (other | ~np.r_[False, twice[:-1]]))
    b = np.flatnonzero(twice & (np.r_[other[1:], True] | ~np.r_[twice[1:], False]))
    own = np.r_[np.zeros(keep.sum(), np.int64), np.ones(len(a), np.int64)]
    both = ((doc, doc[a]), (h, k1[doc[a]]), (c, np.full(len(a), -1)), (p, p[a]), (q0, q0[a]), (q1, q1[b]))
    return *(np.r_[x[keep], y] for x, y in both), own


def _find_anchors(batches: Iterator[pd.DataFrame], lengths: list[int]) -> Iterator[pd.DataFrame]:
    """Anchors of texts in each form, with a hash c of the context."""
    for d in batches:
        k1, k2 = d["k1"].to_numpy(), d["k2"].to_numpy()
        raws = [t.encode("utf-8", "replace") for t in d["text"]]
        parts, rows = [], []
        for i, raw in enumerate(raws):
            if len(raw) >= lengths[0]:
                h, at, q0, q1 = anchors(raw, lengths[0])
                rows.append((np.full(len(h), i), h, _context_hashes(raw, at, q0, q1 + lengths[0]), at, q0, q1))
        if rows:
            doc, *found = map(np.concatenate, zip(*rows, strict=True))
            parts.append((0, *_fold(doc, k1, *found)))
        if len(lengths) > 1:
            parts += _find_word_anchors(raws, k1, lengths[1] // WORD)
        for u, doc, h, c, p, q0, q1, own in parts:
            yield pd.DataFrame({"k1": k1[doc], "k2": k2[doc], "h": h & -2 | u, "c": c, "p": p, "q0": q0, "q1": q1, "own": own})


def _find_word_anchors(raws: list[bytes], k1: np.ndarray, words: int) -> list[tuple]:
    seen, kept, forms = WordHashes(), [], []
    for i, raw in enumerate(raws):
        # A word and the space after it are two bytes at least.
        if len(raw) >= 2 * words - 1 and len(form := form_of(raw, 1, seen)) >= WORD * words:
            kept.append(i)
            forms.append(form)
    if not kept:
        return []
    sizes = np.array([len(x) // WORD for x in forms])
    data = b"".join(forms)
    text, h, at, q0, q1 = word_anchors(data, sizes, words)
    c = _context_hashes(data, WORD * at, WORD * q0, WORD * (q1 + words))
    begin = (np.cumsum(sizes) - sizes)[text]
    return [(1, *_fold(np.array(kept)[text], k1, h, c, *(WORD * (x - begin) for x in (at, q0, q1))))]


def _cut_contexts(batches: Iterator[pd.DataFrame], lengths: list[int]) -> Iterator[pd.DataFrame]:
    """(text, its candidates) -> the bytes of each candidate's context."""
    for d in batches:
        rows, seen = [], WordHashes()
        for k1, k2, t, found in zip(d["k1"], d["k2"], d["text"], d["found"], strict=True):
            raw = t.encode("utf-8", "replace")
            forms = {u: form_of(raw, u, seen) for u in {x["h"] & 1 for x in found}}
            for x in found:
                u = x["h"] & 1
                rows.append((x["h"], forms[u][x["q0"] : x["q1"] + lengths[u]], x["p"] - x["q0"], k1, k2, x["q0"], x["kind"] == 2))
                if len(rows) == 5000:
                    yield pd.DataFrame(rows, columns=CONTEXT)
                    rows = []
        yield pd.DataFrame(rows, columns=CONTEXT)


CONTEXT = ["h", "context", "offset", "k1", "k2", "q0", "known"]


def _sort_contexts(batches: Iterator[pd.DataFrame], lengths: list[int]) -> Iterator[pd.DataFrame]:
    """Contexts sorted by h -> spans (k1, k2, first, last, unit) of windows that are repeated; whole anchors are sorted together."""

    def spans(both: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for u, d in both.groupby(both["h"].to_numpy() & 1):
            known, step = d["known"].tolist(), WORD if u else 1
            flags = repeated_windows([bytes(c) for c in d["context"]], d["offset"].tolist(), known, lengths[u], step)
            rows += [(k1, k2, q0 + step * a, q0 + step * b, u) for k1, k2, q0, f, done in zip(d["k1"], d["k2"], d["q0"], flags, known, strict=True) if not done for a, b in runs_of(f[::step])]
        return pd.DataFrame(rows, columns=["k1", "k2", "q0", "q1", "u"])

    held: pd.DataFrame | None = None
    for d in batches:
        held = d if held is None else pd.concat([held, d], ignore_index=True)
        while len(held) > TOGETHER:
            h = held["h"].to_numpy()
            begins = np.flatnonzero(np.r_[False, h[1:] != h[:-1]])
            # The last begin within reach; an anchor with more contexts than that is taken whole.
            fit = begins[begins <= TOGETHER]
            cut = int(fit[-1]) if len(fit) else int(begins[0]) if len(begins) else 0
            if not cut:
                break
            yield spans(held[:cut])
            held = held[cut:].reset_index(drop=True)
    if held is not None and len(held):
        yield spans(held)


def _list_windows(batches: Iterator[pd.DataFrame], lengths: list[int]) -> Iterator[pd.DataFrame]:
    """Every window of the contexts, by its hash and the anchor's offset in it."""
    for d in batches:
        for h, c, o, k1, k2, q0 in zip(d["h"], d["context"], d["offset"], d["k1"], d["k2"], d["q0"], strict=True):
            c, length = bytes(c), lengths[h & 1]
            n = len(c) - length + 1
            w = [xxhash.xxh3_128_intdigest(c[q : q + length]) for q in range(n)]
            yield pd.DataFrame({"h": h, "o": o - np.arange(n), "w1": np.array([x >> 65 for x in w], np.int64), "w2": np.array([x & (1 << 63) - 1 for x in w], np.int64), "k1": k1, "k2": k2, "q0": q0 + np.arange(n)})


def repeated_spans(docs: DataFrame, length: int = LENGTH, group_limit: int = GROUP_LIMIT, words: int | None = None) -> DataFrame:
    """(k1, k2, q0, q1, u): by key of the text, runs of windows (first and last start) that are repeated in the corpus.

    u is 0 for windows of ``length`` bytes and 1 for those of 8 * ``words`` bytes in the hashes of the text's words.
    """
    if length < GRAM + 2 * SYMBOL:
        raise ValueError(f"length must be {GRAM + 2 * SYMBOL} at least")
    if words is not None and WORD * words < WORD_GRAM + 2 * SYMBOL:
        raise ValueError(f"words must be {(WORD_GRAM + 2 * SYMBOL) // WORD} at least")
    lengths = [length] if words is None else [length, WORD * words]
    small_batches(docs.sparkSession)
    keyed = _keyed(docs)
    found = keyed.mapInPandas(tidy(lambda it: _find_anchors(it, lengths)), "k1 long, k2 long, h long, c long, p int, q0 int, q1 int, own long")
    context, anchor = Window.partitionBy("h", "c"), Window.partitionBy("h")
    found = found.withColumn("times", F.count("*").over(context)).withColumn("turn", F.row_number().over(context.orderBy("k1", "k2", "p")))
    found = found.withColumn("several", F.min("c").over(anchor) != F.max("c").over(anchor))
    kind = F.when((F.col("own") == 0) & F.col("several") & (F.col("times") == 1), 1).when((F.col("own") == 0) & F.col("several") & (F.col("turn") == 1), 2).when((F.col("own") == 1) | (F.col("times") > 1), 0)
    found = materialize(found.select("k1", "k2", "h", "p", "q0", "q1", kind.alias("kind")).where("kind is not null").distinct(), "repeats-anchors", release=True)
    unit = F.col("h").bitwiseAND(1).cast("int").alias("u")
    asis = found.where("kind <> 1").select("k1", "k2", "q0", "q1", unit).distinct()
    # The list is bounded by the text: a text has one row for an anchor.
    wanted = found.where("kind > 0").groupBy("k1", "k2").agg(F.collect_list(F.struct("h", "p", "q0", "q1", "kind")).alias("found"))
    texts = keyed.groupBy("k1", "k2").agg(F.first("text").alias("text"))
    contexts = texts.join(wanted, ["k1", "k2"]).mapInPandas(tidy(lambda it: _cut_contexts(it, lengths)), "h long, context binary, offset int, k1 long, k2 long, q0 int, known boolean")
    contexts = materialize(contexts, "repeats-contexts", release=True)
    large = contexts.groupBy("h").count().where(F.col("count") > group_limit).select(F.col("h").alias("large"))
    marked = contexts.join(large, F.col("h") == F.col("large"), "left")
    usual = marked.where("large is null").drop("large").repartition("h").sortWithinPartitions("h", "k1", "k2", "q0")
    spans = asis.unionByName(usual.mapInPandas(tidy(lambda it: _sort_contexts(it, lengths)), "k1 long, k2 long, q0 int, q1 int, u int"))
    if not large.isEmpty():
        windows = marked.where("large is not null").drop("large").mapInPandas(tidy(lambda it: _list_windows(it, lengths)), "h long, o int, w1 long, w2 long, k1 long, k2 long, q0 int")
        again = windows.groupBy("h", "o", "w1", "w2").agg(F.count("*").alias("n")).where("n > 1")
        spans = spans.unionByName(windows.join(again, ["h", "o", "w1", "w2"], "left_semi").select("k1", "k2", "q0", F.col("q0").alias("q1"), unit))
    return spans


def word_places(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of each word."""
    data = np.frombuffer(raw, np.uint8)
    edges = np.flatnonzero(np.diff(np.r_[False, (data != 32) & (data - np.uint8(9) > 4), False]))
    return edges[::2], edges[1::2]


def byte_spans(raw: bytes, found: list, length: int, words: int | None) -> list[tuple[int, int]]:
    """Runs of windows as the bytes that they cover, merged."""
    out = [(s["q0"], s["q1"] + length) for s in found if not s["u"]]
    runs = [(-(-s["q0"] // WORD), s["q1"] // WORD) for s in found if s["u"]]
    if runs:
        begin, end = word_places(raw)
        out += [(int(begin[a]), int(end[b + words - 1])) for a, b in runs if a <= b]
    return merge(out)


def without(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    """What merged spans leave."""
    parts, at = [], 0
    for a, b in spans:
        parts.append(raw[at:a])
        at = b
    return b"".join([*parts, raw[at:]])


def remove_repeats(docs: DataFrame, length: int = LENGTH, group_limit: int = GROUP_LIMIT, text: bool = False, words: int | None = None, apart: bool = False) -> DataFrame:
    """Add n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes) to the documents.

    With ``text``, also kept_text: the remaining bytes as text, without those of characters that a cut went through.
    With ``words``, every so many words that also start anywhere else go too; with ``apart``, from kept_text alone.
    """
    spans = repeated_spans(docs, length, group_limit, words)
    # Copies give equal rows: distinct before the list, which the text bounds.
    spans = spans.distinct().groupBy("k1", "k2").agg(F.collect_list(F.struct("q0", "q1", "u")).alias("spans")).withColumnsRenamed({"k1": "s1", "k2": "s2"})
    kept_columns = docs.drop("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", *["kept_text"] * text).columns
    whole = text_or_empty()
    # Rows hold their text once as they are dealt out.
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in kept_columns)).alias("_row"), F.xxhash64(whole).alias("_k1"), F.xxhash64(F.lit(7), whole).alias("_k2"))
    joined = own.join(spans, (F.col("_k1") == F.col("s1")) & (F.col("_k2") == F.col("s2")), "left")

    columns = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", *["kept_text"] * text]

    @F.pandas_udf("n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary" + ", kept_text string" * text)
    def cut(data: pd.Series, found: pd.Series) -> pd.DataFrame:
        rows = []
        for raw, x in zip(data, found, strict=True):
            raw = bytes(raw)
            found_here = x if x is not None else []
            every = byte_spans(raw, found_here, length, words)
            gone = byte_spans(raw, [s for s in found_here if not s["u"]], length, words) if apart and any(s["u"] for s in found_here) else every
            kept = without(raw, gone)
            rest = (kept if gone == every else without(raw, every)).decode("utf-8", "ignore") if text else None
            rows.append((len(raw), len(raw) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), kept, rest)[: len(columns)])
        give_back()
        return pd.DataFrame(rows, columns=columns)

    # Told to be random, the function runs once, also where a filter asks for what it gives.
    out = joined.withColumn("_cut", cut.asNondeterministic()(F.encode(text_or_empty("_row.text"), "UTF-8"), "spans"))
    return out.select("_row.*", "_cut.*")

