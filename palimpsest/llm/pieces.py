"""SentencePiece BPE encoding and decoding with a given model file.

Texts are cut into words before blanks, which no piece crosses.  All words that
a run of texts holds and that aren't remembered are merged together: their
symbols lie in one flat array, cut further where two characters stand side by
side that no piece has side by side.  A round finds each stretch's least pair
rank and merges that pair wherever it stands, from the left, then closes the
gaps; stretches without a pair left are done.  Where a merge makes a pair that
comes before the other places of the same rank (ranks needn't grow along a
piece's parts), those wait for another round, so that the outcome is that of
one merge at a time.  What ROUNDS rounds leave open (stretches of hundreds of
such cases, as long white space is, whose pieces all rank alike) is finished by
a queue of pairs, in time n log n; stretches of up to ROUNDS characters never
come to that.

Models are byte-fallback BPE without normalisation rules or pieces that users
have defined; others are refused.  Null and empty texts have the begin and end
ids only and decode to the empty text.  Repeated rows give repeated results;
texts of any length are taken whole; an empty table gives an empty one.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import heapq
import re
import struct
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from .bpe import Memory
from .common import map_texts, named

SPACE = "▁"
ROUNDS = 256
NONE = np.int32(2**31 - 1)

#: Kinds of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6

#: U+FFFD for every byte of what isn't UTF-8.
EACH_BYTE = "palimpsest-each-byte"
codecs.register_error(EACH_BYTE, lambda e: ("\ufffd" * (e.end - e.start), e.end))

_WORD = re.compile(f"{SPACE}+[^{SPACE}]*")


def fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol buffer's message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
            continue
        size = number() if key & 7 == 2 else {1: 8, 5: 4}[key & 7]
        yield key >> 3, message[at : at + size]
        at += size


class Pieces:
    """A model, ready to encode and decode."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            parts = list(fields(f.read()))
        pieces = [dict(fields(p)) for n, p in parts if n == 1]
        trainer = dict(fields(next(p for n, p in parts if n == 2)))
        rules = dict(fields(next((p for n, p in parts if n == 3), b"")))
        self.strings = [p[1].decode() for p in pieces]
        scores = [struct.unpack("<f", p[2])[0] if 2 in p else 0.0 for p in pieces]
        kinds = [p.get(3, NORMAL) for p in pieces]
        plain = not rules.get(2) and rules.get(3, 1) == 1 and rules.get(4, 1) == 0 and rules.get(5, 1) == 1 and not trainer.get(24, 0)
        if trainer.get(3, 1) != 2 or not trainer.get(35, 0) or not plain or set(kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError(f"{path}: only BPE models with byte fallback and without normalisation or user-defined pieces")
        at = {s: i for i, s in enumerate(self.strings)}
        self.begin, self.end = at[trainer[46].decode()] if 46 in trainer else at["<s>"], at[trainer[47].decode()] if 47 in trainer else at["</s>"]
        self.silent = {i for i, k in enumerate(kinds) if k == CONTROL}
        self.unknown = {i: trainer[44].decode() if 44 in trainer else " ⁇ " for i, k in enumerate(kinds) if k == UNKNOWN}
        self.bytes = np.array([at[f"<0x{b:02X}>"] for b in range(256)], np.int32)
        self.byte_of = {int(i): b for b, i in enumerate(self.bytes)}
        self._tables({s: i for i, s in enumerate(self.strings) if kinds[i] == NORMAL}, scores)
        self.memory = Memory()

    def _tables(self, normal: dict[str, int], scores: list[float]) -> None:
        """Numbers of characters and symbols, which characters stand side by side in a piece, and each pair's rank and outcome."""
        chars = sorted({c for s in normal for c in s})
        symbols = dict(normal)
        for c in chars:
            symbols.setdefault(c, len(self.strings) + len(symbols))  # part of pieces, though none itself
        self.char = np.full(0x110000, len(chars), np.int32)
        points = np.array([ord(c) for c in chars])
        self.char[points] = np.arange(len(chars))
        self.symbol = np.append(np.array([symbols[c] for c in chars], np.int64), 0)
        number = {c: i for i, c in enumerate(chars)}
        self.beside = np.zeros((len(chars) + 1,) * 2, bool)
        rank = {score: r for r, score in enumerate(sorted({scores[i] for i in normal.values()}, reverse=True))}
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for s, i in normal.items():
            for k in range(1, len(s)):
                self.beside[number[s[k - 1]], number[s[k]]] = True
                left, right = symbols.get(s[:k]), symbols.get(s[k:])
                if left is not None and right is not None:
                    self.pairs[left, right] = rank[scores[i]], i
        self.size = max(symbols.values(), default=0) + 1
        keys = np.array([a * self.size + b for a, b in self.pairs], np.int64)
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.iinfo(np.int64).max)
        found = np.array([*self.pairs.values(), (NONE, 0)], np.int32).reshape(-1, 2)
        self.ranks, self.made = np.append(found[:-1, 0][order], NONE), np.append(found[:-1, 1][order], 0)

    # encoding

    def words(self, text: str) -> list[str]:
        """The words of a text, each without the blank that begins it."""
        if not text:
            return []
        if text[0] != " " and "  " not in text and SPACE not in text:
            return text.split(" ")
        return [w[1:] for w in _WORD.findall(SPACE + text.replace(" ", SPACE))]

    def known(self, words: set[str]) -> dict[str, tuple[bytes, str]]:
        """word -> its ids as little-endian numbers of 32 bits, and the text that they decode to, with the word's first blank."""
        out, new = {}, []
        for w in words:
            if (found := self.memory.get(w)) is None:
                new.append(w)
            else:
                out[w] = found
        for w, ids in zip(new, self.merged([SPACE + w for w in new]), strict=True):
            out[w] = found = ids.astype("<u4").tobytes(), self.shown(ids.tolist())
            self.memory.put(w, found)
        return out

    def merged(self, words: list[str]) -> list[np.ndarray]:
        """The ids of each word, which must not be empty."""
        if not words:
            return []
        points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        chars = self.char[points]
        starts = np.zeros(len(points), bool)
        starts[np.cumsum([0, *map(len, words[:-1])])] = True
        word = np.cumsum(starts) - 1
        starts[1:] |= ~self.beside[chars[:-1], chars[1:]]
        own = chars == len(self.symbol) - 1
        symbols = np.where(own, self.size + points.astype(np.int64), self.symbol[chars])
        symbols, place = self._rounds(symbols, np.cumsum(starts) - 1)
        ids, counts = self._with_bytes(symbols, points[place])
        ends = np.cumsum(np.bincount(word[place], counts, len(words)).astype(np.int64))
        return np.split(ids, ends[:-1])

    def _rank(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of pairs, NONE where there is none, and the symbols that they make."""
        keys = np.where((left < self.size) & (right < self.size), left * self.size + right, -1)
        at = np.searchsorted(self.keys, keys)
        return np.where(self.keys[at] == keys, self.ranks[at], NONE), self.made[at]

    def _rounds(self, symbols: np.ndarray, stretch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols when no pair is left in any stretch, and where each begins."""
        place, done = np.arange(len(symbols)), []
        rank, made = np.full(len(symbols), NONE), np.zeros(len(symbols), np.int64)  # of each symbol with the one after it
        inside = np.flatnonzero(stretch[1:] == stretch[:-1])
        rank[inside], made[inside] = self._rank(symbols[inside], symbols[inside + 1])
        for _ in range(ROUNDS):
            first = np.flatnonzero(np.append(True, stretch[1:] != stretch[:-1]))
            size = np.diff(np.append(first, len(symbols)))
            least = np.minimum.reduceat(rank, first)
            still = np.repeat(least < NONE, size)
            if not still.all():  # stretches that are done leave
                done.append((symbols[~still], place[~still]))
                symbols, place, stretch, rank, made = (x[still] for x in (symbols, place, stretch, rank, made))
                size, least = size[least < NONE], least[least < NONE]
            if not len(symbols):
                break
            at = self._chosen(symbols, stretch, rank, made, np.repeat(least, size))
            symbols[at] = made[at]
            kept = np.ones(len(symbols), bool)
            kept[at + 1] = False
            rank[at + 1] = NONE
            changed = np.zeros(len(symbols), bool)
            changed[at] = True
            symbols, place, stretch, rank, made, changed = (x[kept] for x in (symbols, place, stretch, rank, made, changed))
            at = np.flatnonzero(changed)
            again = np.union1d(at, at[at > 0] - 1)
            rank[again] = NONE
            again = again[again + 1 < len(symbols)]
            again = again[stretch[again] == stretch[again + 1]]
            rank[again], made[again] = self._rank(symbols[again], symbols[again + 1])
        for s in np.split(np.arange(len(symbols)), np.flatnonzero(stretch[1:] != stretch[:-1]) + 1) if len(symbols) else []:
            left = self._queued(symbols[s].tolist())
            kept = [i for i, x in enumerate(left) if x >= 0]
            done.append((np.array(left)[kept], place[s][kept]))
        symbols, place = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(place, kind="stable")
        return symbols[order], place[order]

    def _chosen(self, symbols, stretch, rank, made, least) -> np.ndarray:
        """Where pairs are merged in this round: those of least rank, from the left, up to the first that makes a pair which goes before the rest."""
        at = np.flatnonzero(rank == least)
        run = np.cumsum(np.append(True, np.diff(at) > 1)) - 1  # pairs that overlap
        begin = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
        at = at[(np.arange(len(at)) - begin[run]) % 2 == 0]
        new, r = made[at], least[at]
        # the pair with the symbol before, which may itself have been merged just now, and with the one after
        before = np.where(at > 0, symbols[at - 1], 0)
        follows = np.append(False, at[1:] - at[:-1] == 2)
        before[follows] = new[:-1][follows[1:]]
        has_before = (at > 0) & (stretch[at - 1] == stretch[at])
        beyond = np.minimum(at + 2, len(symbols) - 1)
        has_after = (at + 2 < len(symbols)) & (stretch[beyond] == stretch[at])
        sooner = (has_before & (self._rank(before, new)[0] <= r)) | (has_after & (self._rank(new, symbols[beyond])[0] <= r))
        if not sooner.any():
            return at
        group = stretch[at]
        passed = np.cumsum(sooner) - sooner  # such merges before this one
        begin = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        return at[passed == np.repeat(passed[begin], np.diff(np.append(begin, len(at))))]

    def _queued(self, symbols: list[int]) -> list[int]:
        """One merge at a time; -1 where a symbol has gone into the one before it."""
        n, get = len(symbols), self.pairs.get
        after, before = [*range(1, n), n], [*range(-1, n - 1)]
        queue = [(found[0], i, symbols[i], symbols[i + 1], found[1]) for i in range(n - 1) if (found := get((symbols[i], symbols[i + 1])))]
        heapq.heapify(queue)
        while queue:
            _, i, a, b, new = heapq.heappop(queue)
            j = after[i]
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue  # stale
            symbols[i], symbols[j] = new, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if found := get((new, symbols[k])):
                    heapq.heappush(queue, (found[0], i, new, symbols[k], found[1]))
            if (h := before[i]) >= 0 and (found := get((symbols[h], new))):
                heapq.heappush(queue, (found[0], h, symbols[h], new, found[1]))
        return symbols

    def _with_bytes(self, symbols: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all symbols, those that aren't pieces as the bytes of their characters, and how many ids each symbol has."""
        other = symbols >= len(self.strings)
        counts = np.ones(len(symbols), np.int64)
        if not other.any():
            return symbols.astype(np.int32), counts
        p = points[other]
        counts[other] = 1 + (p >= 0x80) + (p >= 0x800) + (p >= 0x10000)
        ids = np.repeat(symbols, counts)
        ids[np.repeat(other, counts)] = self.bytes[np.frombuffer(str(p.tobytes(), "utf-32-le").encode(), np.uint8)]
        return ids.astype(np.int32), counts

    def encode(self, text: str) -> list[int]:
        words = self.words(text)
        known = self.known(set(words))
        return [self.begin, *np.frombuffer(b"".join([known[w][0] for w in words]), "<u4").tolist(), self.end]

    # decoding

    def shown(self, ids: list[int]) -> str:
        """The strings of ids, one after the other; bytes are read as UTF-8, each byte that isn't becomes U+FFFD."""
        strings, byte_of, out, run = self.strings, self.byte_of, [], bytearray()
        for i in ids:
            if (b := byte_of.get(i)) is not None:
                run.append(b)
                continue
            if run:
                out.append(run.decode(errors=EACH_BYTE))
                run = bytearray()
            if i not in self.silent:
                out.append(self.unknown[i] if i in self.unknown else strings[i])
        if run:
            out.append(run.decode(errors=EACH_BYTE))
        return "".join(out).replace(SPACE, " ")

    def decode(self, ids: list[int]) -> str:
        """The text of ids; the blank that encoding put before it is taken off."""
        text = self.shown(ids)
        first = next((i for i in ids if i not in self.silent), None)
        return text[1:] if first is not None and first not in self.byte_of and self.strings[first].startswith(SPACE) else text


@functools.lru_cache(maxsize=1)
def model(path: str) -> Pieces:
    """A worker's model, read once."""
    return Pieces(path)


def piece_ids(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, decoded) of every text: the ids as an array, begin and end included, and the text that they decode to."""

    def start():
        pieces = model(path)

        def run(texts):
            return [(ids, pieces.decode(ids)) for ids in map(pieces.encode, texts)]

        return run

    return map_texts(docs.select(named(id_col), named(text_col).alias("text")), "ids array<int>, decoded string", start)


def piece_digest(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encoded and decoded as in piece_ids, digested where the ids are made so that neither form is moved."""

    def start():
        pieces = model(path)
        begin, end = (struct.pack("<I", i) for i in (pieces.begin, pieces.end))

        def run(texts):
            cut = [pieces.words(t) for t in texts]
            known = pieces.known(set().union(*cut))
            made = []
            for words in cut:
                parts = [known[w] for w in words]
                ids = b"".join([begin, *[p[0] for p in parts], end])
                decoded = "".join([p[1] for p in parts])[1:]
                made.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
            return made

        return run

    return map_texts(docs.select(named(id_col), named(text_col).alias("text")), "n_tokens long, ids_sha256 string, decoded_sha256 string", start)
