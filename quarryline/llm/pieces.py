"""Operator 6: SentencePiece encoding and decoding by a batched numpy Viterbi.

A text becomes words (a run of spaces and what follows it); no piece crosses a word's end. The different words of a part of
a batch are encoded once, and those of equal length advance together: prefix hashes give the hash of every substring, which
probes the sorted keys of the pieces of its length, and at each place a maximum over the pieces that end there is stored as
the backpointer. What is chosen is compared with the words themselves, so equal hashes can't pass unnoticed.

For a unigram model, the best is the largest sum of scores. For a BPE model (``piece_bpe_32k.model`` is one), a sum of scores
doesn't give the library's result, but its result has the same form: pieces follow one another exactly if merging the two
alone leaves them as they are, and at each place just one piece may end. So the lattice is the same, the value of a path is
0 or nothing, and the maximum finds that piece. Whether two pieces may follow one another is worked out once per pair and
kept in a table of fixed size. Characters without a piece become their bytes' pieces.

Memory: a batch is taken in parts of about ``CHARS`` characters, also within a text, and a lattice has at most ``CELLS``
places, or those of one word. Nothing but the table of pairs is kept from one batch to the next.

Defined results: null text gives null ids and null text back; empty text has no ids; very long texts and words are encoded
whole; repeated rows, extra columns and empty tables need nothing special.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache
from itertools import chain, groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm.shared import small_batches

SPACE = "▁"
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Characters whose words are encoded at once, and places of a lattice.
CHARS = 2_000_000
CELLS = 1 << 17
#: Slots of a table of pairs, as a power of two, and what mixes the pairs for each table.
PAIR_BITS = 19
MIX = (BASE, np.uint64(0xC2B2AE3D27D4EB4F))
PLAIN = re.compile(f"  |^ | $|{SPACE}")


def as_int(field: bytes) -> int:
    return sum((b & 127) << 7 * k for k, b in enumerate(field))


class Numbers(dict):
    """Numbers words as they come."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def segments(text: str) -> list[str]:
    """The text in parts of about CHARS characters, cut at single spaces, which go; their words are the text's."""
    out, at = [], 0
    while len(text) - at > CHARS:
        cut = at + CHARS
        while (cut := text.find(" ", cut)) >= 0 and ("  " in text[cut - 1 : cut + 2] or SPACE in text[cut - 1 : cut + 2] or cut + 1 == len(text)):
            cut += 1
        if cut < 0:
            break
        out.append(text[at:cut])
        at = cut + 1
    return [*out, text[at:]]


def words_of(text: str) -> list[str]:
    """Words without the space before them."""
    if not text:
        return []
    if PLAIN.search(text):
        return [u[1:] for u in re.findall(f"{SPACE}+[^{SPACE}]*", SPACE + text.replace(" ", SPACE))]
    return text.split(" ")


class PieceModel:
    """The pieces of a model file, and encoding and decoding with them."""

    def __init__(self, path: str):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lib.get_piece_size()
        self.setup([lib.id_to_piece(i) for i in range(n)], [lib.get_score(i) for i in range(n)], {i for i in range(n) if lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i)}, bpe=_is_bpe(path))

    def setup(self, pieces: list[str], scores: list[float], special: set[int], bpe: bool) -> None:
        self.bpe, self.pieces, self.scores = bpe, pieces, np.array(scores)
        normal = [i for i in range(len(pieces)) if i not in special]
        self.score = {pieces[i]: scores[i] for i in normal}
        self.bytes_at = pieces.index("<0x00>") if "<0x00>" in pieces else None
        self.unknown = pieces.index("<unk>") if "<unk>" in pieces else 0
        self.known = np.zeros(0x110000, bool)
        self.known[[ord(p) for p in self.score if len(p) == 1]] = True
        self.longest = max(map(len, self.score))
        self.tables = {}
        for size in range(1, self.longest + 1):
            own = [i for i in normal if len(pieces[i]) == size]
            if own:
                codes = np.array([[ord(c) for c in pieces[i]] for i in own], np.uint64)
                keys = np.zeros(len(own), np.uint64)
                for k in range(size):
                    keys = keys * BASE + codes[:, k]
                order = np.argsort(keys)
                if len(np.unique(keys)) < len(keys):
                    raise ValueError("two pieces share a hash")
                self.tables[size] = (keys[order], np.array(own, np.int32)[order])
        self.lengths = np.array(list(map(len, pieces)))
        self.points = points("".join(pieces))
        self.points_at = np.cumsum(self.lengths) - self.lengths
        self.raw = [p.replace(SPACE, " ").encode() for p in pieces]
        for i in special:
            self.raw[i] = bytes([i - self.bytes_at]) if self.bytes_at is not None and self.bytes_at <= i < self.bytes_at + 256 else b""
        #: Two tables of pairs, and whether they stay.
        self.pairs = np.full((2, 1 << PAIR_BITS), -1, np.int64)
        self.follows = np.zeros((2, 1 << PAIR_BITS), bool)

    def merged(self, text: str) -> list[str]:
        """BPE of a short string: the best-scored neighbours merge first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = self.score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def stays(self, pair: int) -> bool:
        """Whether merging leaves a pair as it is: (before + 1) * pieces + piece, before is -1 at a word's start."""
        before, piece = divmod(pair, len(self.pieces))
        want = [self.pieces[before - 1]] * (before > 0) + [self.pieces[piece]]
        return self.merged("".join(want)) == want

    def may_follow(self, pairs: np.ndarray) -> np.ndarray:
        ok, new = np.zeros(len(pairs), bool), np.arange(len(pairs))
        for table in (0, 1):
            slot = self.slot(pairs[new], table)
            hit = self.pairs[table][slot] == pairs[new]
            ok[new[hit]] = self.follows[table][slot[hit]]
            new = new[~hit]
        if len(new):
            unique, back = np.unique(pairs[new], return_inverse=True)
            found = np.array(list(map(self.stays, unique.tolist())), bool)
            ok[new] = found[back]
            # New pairs push old ones into the second table. Of pairs that want the same slot, one gets it.
            _, first = np.unique(self.slot(unique, 0), return_index=True)
            pushed = self.keep(unique[first], found[first], 0)
            self.keep(*pushed, 1)
            rest = np.setdiff1d(np.arange(len(unique)), first)
            self.keep(unique[rest], found[rest], 1)
        return ok

    @staticmethod
    def slot(pairs: np.ndarray, table: int) -> np.ndarray:
        return (pairs.astype(np.uint64) * MIX[table] >> np.uint64(64 - PAIR_BITS)).astype(np.int64)

    def keep(self, pairs: np.ndarray, found: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
        """Write pairs into a table; returns those that stood there."""
        slot, first = np.unique(self.slot(pairs, table), return_index=True)
        old, said = self.pairs[table][slot], self.follows[table][slot]
        self.pairs[table][slot], self.follows[table][slot] = pairs[first], found[first]
        return old[old >= 0], said[old >= 0]

    def viterbi(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, length) code points of known characters -> the piece that ends at each place, and its size."""
        rows, length = words.shape
        reach = min(self.longest, length)
        prefix = np.zeros((rows, length + 1), np.uint64)
        for k in range(length):
            prefix[:, k + 1] = prefix[:, k] * BASE + words[:, k]
        #: [row, end, size - 1]: the piece of that size that ends there.
        lattice = np.full((rows, length + 1, reach), -1, np.int32)
        power = 1
        for size in range(1, reach + 1):
            power = power * int(BASE) % 2**64
            if size in self.tables:
                keys, ids = self.tables[size]
                sub = prefix[:, size:] - prefix[:, :-size] * np.uint64(power)
                at = np.minimum(np.searchsorted(keys, sub), len(keys) - 1)
                lattice[:, size:, size - 1] = np.where(keys[at] == sub, ids[at], -1)
        piece = np.full((rows, length + 1), -2, np.int32)
        piece[:, 0] = -1
        step = np.zeros((rows, length + 1), np.int32)
        best = np.full((rows, length + 1), -np.inf)
        best[:, 0] = 0
        every = np.arange(rows)
        for end in range(1, length + 1):
            k = min(reach, end)
            here = lattice[:, end, :k]
            r, s = np.nonzero((here >= 0) & (piece[:, end - k : end][:, ::-1] > -2))
            to = here[r, s]
            if self.bpe:
                ok = self.may_follow((piece[r, end - 1 - s].astype(np.int64) + 1) * len(self.pieces) + to)
                r, s, to = r[ok], s[ok], to[ok]
                value = np.zeros(len(r))
            else:
                value = best[r, end - 1 - s] + self.scores[to]
            values = np.full((rows, k), -np.inf)
            values[r, s] = value
            least = values.argmax(axis=1)
            best[:, end] = values[every, least]
            reached = np.flatnonzero(best[:, end] > -np.inf)
            piece[reached, end], step[reached, end] = here[reached, least[reached]], least[reached] + 1
        return piece, step

    def encode_runs(self, runs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(rows, length) arrays of runs of known characters -> sizes and ids, all in order of the rows of all arrays."""
        sizes, flat = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        for run in runs:
            length = run.shape[1]
            rows = max(1, CELLS // length)
            for a in range(0, len(run), rows):
                words = run[a : a + rows]
                piece, step = self.viterbi(words.astype(np.uint64))
                at = np.full(len(words), length)
                back = np.full((len(words), length), -1, np.int32)
                every = np.arange(len(words))
                for k in range(length - 1, -1, -1):
                    if not at.any():
                        break
                    back[:, k] = np.where(at > 0, piece[every, at], -1)
                    at = at - step[every, at]
                real = back >= 0
                ids = back[real]
                n = self.lengths[ids]
                ends = np.cumsum(n)
                if ends[-1] != words.size or not np.array_equal(self.points[np.repeat(self.points_at[ids] - (ends - n), n) + np.arange(words.size)], words.ravel()):
                    raise ValueError("a substring shares its hash with a piece")
                sizes.append(real.sum(axis=1))
                flat.append(ids)
        return np.concatenate(sizes), np.concatenate(flat)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Different words, without the space before them -> where the ids of each begin (and the end), and the ids."""
        units = [SPACE + w for w in words]
        size = np.fromiter(map(len, units), np.int64, len(units))
        codes = points("".join(units))
        start = np.cumsum(size) - size
        strange = ~self.known[codes]
        odd = np.zeros(len(units), bool)
        odd[np.searchsorted(start, np.flatnonzero(strange), "right") - 1] = True
        # Words of known characters go by their lengths; of the others, the runs of known characters do, after them.
        order = np.flatnonzero(~odd)
        order = order[np.argsort(size[order], kind="stable")]
        cuts = np.flatnonzero(np.diff(size[order])) + 1
        runs = [codes[start[g][:, None] + np.arange(size[g[0]])] for g in np.split(order, cuts) if len(g)]
        split = {k: ["".join(g) for _, g in groupby(units[k], key=lambda c: bool(self.known[ord(c)]) or c)] for k in np.flatnonzero(odd).tolist()}
        more = sorted({p for parts in split.values() for p in parts if self.known[ord(p[0])]}, key=len)
        runs += [points("".join(g)).reshape(-1, n) for n, g in ((n, list(g)) for n, g in groupby(more, key=len))]
        sizes, flat = self.encode_runs(runs)
        ends = np.cumsum(sizes)
        found = [np.zeros(0, np.int32)] * len(units)
        at = np.full(len(units), -1, np.int64)
        at[order] = np.arange(len(order))
        count = np.zeros(len(units), np.int64)
        count[order] = sizes[: len(order)]
        part = {p: flat[ends[k] - sizes[k] : ends[k]] for k, p in enumerate(more, len(order))}
        for k, parts in split.items():
            found[k] = np.concatenate([part[p] if p in part else np.concatenate([self.fallback(c) for c in p]) for p in parts])
            count[k] = len(found[k])
        starts = np.r_[0, np.cumsum(count)]
        out = np.zeros(starts[-1], np.int32)
        n = count[order]
        out[np.repeat(starts[order] - (np.cumsum(n) - n), n) + np.arange(n.sum())] = flat[: n.sum()]
        for k in split:
            out[starts[k] : starts[k + 1]] = found[k]
        return starts, out

    def fallback(self, char: str) -> np.ndarray:
        if self.bytes_at is None:
            return np.array([self.unknown], np.int32)
        return np.frombuffer(char.encode("utf-8", "replace"), np.uint8).astype(np.int32) + self.bytes_at

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        parts = [(k, p) for k, t in enumerate(texts) for p in segments(t)]
        out: list[list[np.ndarray]] = [[] for _ in texts]
        a = 0
        while a < len(parts):
            b, chars = a, 0
            while b < len(parts) and (b == a or chars + len(parts[b][1]) <= CHARS):
                chars += len(parts[b][1])
                b += 1
            for (k, _), ids in zip(parts[a:b], self._encode([p for _, p in parts[a:b]]), strict=True):
                out[k].append(ids)
            a = b
        return [x[0] if len(x) == 1 else np.concatenate(x) for x in out]

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        words = list(map(words_of, texts))
        sizes = list(map(len, words))
        numbers = Numbers()
        c = np.fromiter(map(numbers.__getitem__, chain.from_iterable(words)), np.int64, sum(sizes))
        if not len(c):
            return [np.zeros(0, np.int32)] * len(texts)
        starts, known = self.encode_words(list(numbers))
        begin, size = starts[c], starts[c + 1] - starts[c]
        ends = np.cumsum(size)
        ids = known[np.repeat(begin - (ends - size), size) + np.arange(ends[-1])]
        return np.split(ids, np.r_[0, ends][np.cumsum(sizes)])[: len(texts)]

    def decode(self, ids: np.ndarray) -> str:
        raw = self.raw
        text = b"".join([raw[i] for i in ids.tolist()]).decode("utf-8", "replace")
        return text.removeprefix(" ")


def _is_bpe(path: str) -> bool:
    """The model_type (field 3 of the trainer's part, field 2) of a model file; 2 is BPE."""
    with open(path, "rb") as f:
        for number, value in _fields(f.read()):
            if number == 2:
                return any(n == 3 and v == 2 for n, v in _fields(value))
    return False


def _fields(data: bytes):
    at = 0

    def varint() -> int:
        nonlocal at
        start = at
        while data[at] & 128:
            at += 1
        at += 1
        return as_int(data[start:at])

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = varint() if kind == 2 else 8 if kind == 1 else 4
            yield tag >> 3, data[at : at + n]
            at += n


@lru_cache(maxsize=2)
def model_of(path: str) -> PieceModel:
    os.environ.setdefault("OMP_NUM_THREADS", "1")
    return PieceModel(path)


def encode_pieces(docs: DataFrame, model_file: str, text_col: str = "text", out: str = "piece_ids") -> DataFrame:
    """Add ``out``: the text's piece ids as binary, little-endian 32-bit integers; null for null."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("binary")
    def encode(texts: pd.Series) -> pd.Series:
        m = model_of(model_file)
        ids = m.encode([t or "" for t in texts])
        return pd.Series([None if t is None else x.astype("<u4").tobytes() for t, x in zip(texts, ids, strict=True)], dtype=object)

    return docs.withColumn(out, encode(F.col(text_col).cast("string")))


def decode_pieces(docs: DataFrame, model_file: str, ids_col: str = "piece_ids", out: str = "decoded") -> DataFrame:
    """Add ``out``: the text of the piece ids; null for null."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def decode(ids: pd.Series) -> pd.Series:
        m = model_of(model_file)
        return pd.Series([None if x is None else m.decode(np.frombuffer(x, "<u4")) for x in ids], dtype=object)

    return docs.withColumn(out, decode(F.col(ids_col)))


def round_trip(docs: DataFrame, model_file: str, text_col: str = "text", out: str = "piece_ids", back: str = "decoded") -> DataFrame:
    """encode_pieces and decode_pieces in one pass: the ids are decoded from the bytes that ``out`` gets.

    Chained as two functions, the encoder would run twice, as its result is wanted by itself and by the decoder.
    """
    small_batches(docs.sparkSession)

    @F.pandas_udf("ids binary, back string")
    def both(texts: pd.Series) -> pd.DataFrame:
        m = model_of(model_file)
        raw = [None if t is None else x.astype("<u4").tobytes() for t, x in zip(texts, m.encode([t or "" for t in texts]), strict=True)]
        return pd.DataFrame({"ids": pd.Series(raw, dtype=object), "back": pd.Series([None if x is None else m.decode(np.frombuffer(x, "<u4")) for x in raw], dtype=object)})

    return docs.withColumn("_both", both(F.col(text_col).cast("string"))).withColumns({out: F.col("_both.ids"), back: F.col("_both.back")}).drop("_both")
