"""BPE encoding and decoding with a given vocabulary file.

The merges run on a doubly linked list of symbols: a priority queue holds
(rank, position) of each adjacent pair that has a rank; entries whose pair has
changed since are skipped.  Pieces never span white space, so a text is cut at
white space and each distinct piece is worked out once while it is remembered.
Decoding concatenates vocabulary strings, with the separator that the file's
missing decoder implies.

Null and empty texts have no ids and decode to the empty text.  Repeated rows
give repeated results.  Texts of any length are taken whole.  Letters and numbers are as the
installed regex library knows them, which may be a version of Unicode ahead.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata

import regex

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, named

#: What a generation of remembered pieces may weigh: a piece weighs WEIGHT and its characters; two generations are kept.
REMEMBERED, WEIGHT = 24_000_000, 88

#: Characters that str.split() takes as white space and Unicode's White_Space does not.
_INFORMATION_SEPARATORS = regex.compile("[\x1c-\x1f]")
_WHITE_SPACE = regex.compile(r"\p{White_Space}+")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table, spare = {b: chr(b) for b in shown}, 0x100
    for b in range(256):
        if b not in table:
            table[b] = chr(spare)
            spare += 1
    return [table[b] for b in range(256)]


class Memory:
    """A dictionary of bounded weight: when the young generation is full it becomes the old one.  What outweighs a generation isn't remembered."""

    def __init__(self, most: int = REMEMBERED):
        self.young, self.old, self.most, self.weight = {}, {}, most, 0

    def get(self, key):
        value = self.young.get(key)
        if value is None and (value := self.old.get(key)) is not None:
            self.put(key, value)
        return value

    def put(self, key, value) -> None:
        weight = WEIGHT + len(key)
        if weight > self.most:
            return
        if self.weight + weight > self.most:
            self.old, self.young, self.weight = self.young, {}, 0
        self.young[key] = value
        self.weight += weight


class Bpe:
    """A lower-casing word-end BPE as its file describes it."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.merges = {(self.vocab[a], self.vocab[b]): (rank, self.vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.strings = {i: s for s, i in self.vocab.items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings |= {i: s for s, i in self.added.items()}
        self.alphabet = byte_alphabet()
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.word = regex.compile(split.replace(r"\s", r"\p{White_Space}"))
        # the same pattern for ASCII, in the faster library
        self.ascii_word = re.compile(split.replace(r"\p{L}", "a-zA-Z").replace(r"\p{N}", "0-9"), re.ASCII)
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.words, self.pieces = Memory(REMEMBERED // 2), Memory()

    def merge(self, word: str) -> tuple[int, ...]:
        """The ids of a word of byte characters."""
        vocab, n = self.vocab, len(word)
        symbols = [vocab.get(c) for c in word]
        symbols[-1] = vocab.get(word[-1] + self.end)
        if None in symbols:
            symbols = [s for s in symbols if s is not None]  # no unknown token: such symbols are left out
            n = len(symbols)
        ranked, push, pop = self.merges.get, heapq.heappush, heapq.heappop
        queue = []
        for i, pair in enumerate(zip(symbols, symbols[1:], strict=False)):
            if found := ranked(pair):
                queue.append((found[0], i, pair, found[1]))
        if not queue:
            return tuple(symbols)
        heapq.heapify(queue)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        while queue:
            _, i, pair, made = pop(queue)
            j = after[i]
            if j < 0 or symbols[i] != pair[0] or symbols[j] != pair[1]:
                continue  # stale
            symbols[i], symbols[j] = made, None
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if found := ranked(pair := (made, symbols[k])):
                    push(queue, (found[0], i, pair, found[1]))
            if (h := before[i]) >= 0 and (found := ranked(pair := (symbols[h], made))):
                push(queue, (found[0], h, pair, found[1]))
        return tuple([s for s in symbols if s is not None])

    def piece(self, piece: str) -> tuple[int, ...]:
        """The ids of a piece without white space, remembered."""
        if (known := self.pieces.get(piece)) is None:
            self.pieces.put(piece, known := tuple(self.ids(piece)))
        return known

    def ids(self, piece: str) -> list[int]:
        """The ids of a piece without white space."""
        ids: list[int] = []
        for part in self.special.split(piece) if self.special and "<" in piece else (piece,):
            if part in self.added:
                ids.append(self.added[part])
                continue
            if part.isascii():
                text = part.lower()
                words = (text,) if text.isalpha() else self.ascii_word.findall(text)
            else:
                words = self.word.findall(unicodedata.normalize("NFC", part).replace("Σ", "σ").lower())
            for word in words:
                if (merged := self.words.get(word)) is None:
                    merged = self.merge(word if word.isascii() and word.isprintable() else "".join([self.alphabet[b] for b in word.encode()]))
                    self.words.put(word, merged)
                ids += merged
        return ids

    def split(self, text: str) -> list[str]:
        if _INFORMATION_SEPARATORS.search(text):
            return [x for x in _WHITE_SPACE.split(text) if x]
        return text.split()

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for piece in self.split(text):
            out += self.piece(piece)
        return out

    def decode(self, ids) -> str:
        strings = self.strings
        return " ".join([strings[i] for i in ids if i in strings])


def bpe_ids(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, decoded) of every text: the ids as an array, and the text that they decode to."""

    def start():
        bpe = Bpe(path)

        def run(texts):
            made = []
            for text in texts:
                ids = bpe.encode(text)
                made.append((ids, bpe.decode(ids)))
            return made

        return run

    return map_texts(docs.select(named(id_col), named(text_col).alias("text")), "ids array<int>, decoded string", start)


def bpe_digest(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encoded and decoded as in bpe_ids, digested where the ids are made so that neither form is moved."""

    def start():
        bpe = Bpe(path)
        shown: Memory = Memory()

        def show(piece):
            if (out := shown.get(piece)) is None:
                ids = bpe.ids(piece)
                shown.put(piece, out := (len(ids), " ".join(map(str, ids)), bpe.decode(ids)))
            return out

        def run(texts):
            made = []
            for text in texts:
                get = shown.young.get  # most are here; show() looks further
                parts = [get(p) or show(p) for p in bpe.split(text)]
                parts = [p for p in parts if p[0]]
                made.append((sum([p[0] for p in parts]), hashlib.sha256(" ".join([p[1] for p in parts]).encode()).hexdigest(), hashlib.sha256(" ".join([p[2] for p in parts]).encode()).hexdigest()))
            return made

        return run

    return map_texts(docs.select(named(id_col), named(text_col).alias("text")), "n_tokens long, ids_sha256 string, decoded_sha256 string", start)
