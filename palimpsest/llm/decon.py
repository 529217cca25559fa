"""Benchmark decontamination with suffix arrays over shards of the corpus.

A shard is a run of documents.  Its words become ids of the benchmark's
vocabulary, 0 for any other word; its suffix array holds the places of all
words that the benchmark has, sorted by what follows up to the next foreign
word.  Every suffix of every benchmark item is looked up by binary search, word
by word, which gives the longest verbatim match of every place of the shard,
of any length, and all occurrences of every window.  Equal beginnings are
looked up once, and occurrences stay ranges of the array until they are read.

The benchmark is written down in blocks of bounded size.  One block at a time
is with the driver and the executors; where there are several, each has a pass
over the documents of its own, and what the passes found is put together.

Null and empty texts have no words.  Items without words match nothing.  A
null item_id reads as 'null'; rows that share an item_id are one item.  Items
and documents that stand there several times are judged alike; extra columns
of either table play no part.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, map_texts, numbered

WINDOW = 10
#: Bytes of benchmark text in a block.
BLOCK_BYTES = 8 << 20
#: Bytes, and texts, of a shard.
SHARD_BYTES, SHARD_ROWS = 4 << 20, 8192
#: Pairs of a document and an item that are made at once.
PAIRS = 1 << 20

#: Folds A-Z and makes every byte that is no part of a word a space.
_TABLE = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def words(raw: bytes) -> list[bytes]:
    return raw.translate(_TABLE).split()


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """The places of ids other than 0, sorted by their suffixes up to the next 0, to depth ids at least.  ids must end with 0.

    Prefix doubling: places that agree in k ids are sorted by the rank of the
    place k further on, as long as several agree.
    """
    order = np.flatnonzero(ids)
    order = order[np.argsort(ids[order], kind="stable")]
    rank = np.zeros(len(ids) + 1, np.int32)
    slots, key = np.arange(len(order)), ids[order].astype(np.int64)
    k = 0
    while len(slots):
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[starts, len(key)])
        rank[order[slots]] = np.repeat(slots[starts] + 1, size)
        more = np.repeat(size > 1, size)
        if k:
            more &= (key & 0xFFFFFFFF) > 0  # else these have ended, and are the same
        k = 2 * k or 1
        if k >= depth:
            break
        slots = slots[more]
        places = order[slots]
        key = (rank[places].astype(np.int64) << 32) | rank[np.minimum(places + k, len(ids))]
        by = np.argsort(key, kind="stable")
        order[slots], key = places[by], key[by]
    return order


class Block:
    """Items of the benchmark as ids in a row, each followed by 0, and their suffixes in order."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.window = window
        named: dict[tuple, set] = {}
        for name, raw in items:
            if ws := tuple(words(raw)):
                named.setdefault(ws, set()).add(name)  # items of the same words are one
        texts = sorted(named)
        self.names = [sorted(named[t]) for t in texts]
        self.vocabulary = {w: i + 1 for i, w in enumerate(sorted({w for t in texts for w in t}))}
        self.size = np.array([len(t) for t in texts], np.int64)
        starts = np.cumsum(self.size + 1) - self.size - 1
        self.ids = np.zeros(int((self.size + 1).sum()) + 1, np.int64)
        for t, a in zip(texts, starts, strict=True):
            self.ids[a : a + len(t)] = [self.vocabulary[w] for w in t]
        self.depth = int(self.size.max(initial=0))
        self.suffixes = suffix_array(self.ids, self.depth)
        self.item = np.searchsorted(starts, self.suffixes, "right") - 1
        self.word = self.suffixes - starts[self.item] if len(starts) else self.suffixes


class Shard:
    """Texts as ids of a block's vocabulary, and their suffix array."""

    def __init__(self, texts: list[bytes], block: Block):
        get = block.vocabulary.get
        rows = [np.fromiter(map(get, words(t), repeat(0)), np.int32) for t in texts]
        self.sizes = np.array([len(r) for r in rows], np.int64)
        self.starts = np.r_[0, np.cumsum(self.sizes + 1)]
        self.ids = np.zeros(self.starts[-1] + 1, np.int32)
        for r, a in zip(rows, self.starts, strict=False):
            self.ids[a : a + len(r)] = r
        self.array = suffix_array(self.ids, block.depth)

    def document(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, places, "right") - 1

    def narrowed(self, low: np.ndarray, high: np.ndarray, k: int, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of ranges of the array that agree in k ids, the parts that go on with word: two binary searches in all ranges at once."""
        ends = []
        for least in (word, word + 1):
            a, b = (ends[0].copy() if ends else low.copy()), high.copy()
            while (apart := a < b).any():
                m = (a + b) >> 1
                less = apart & (self.ids[np.where(apart, self.array[np.where(apart, m, 0)] + k, 0)] < least)
                a, b = np.where(less, m + 1, a), np.where(apart & ~less, m, b)
            ends.append(a)
        return ends[0], ends[1]


def _spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which range, and place in the array, of all that lies in the ranges."""
    size = high - low
    of = np.repeat(np.arange(len(low)), size)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + low[of]


class Found:
    """What the items of a block have in common with the texts of a shard."""

    def __init__(self, shard: Shard, block: Block, places: bool = True):
        self.shard, self.block = shard, block
        array, ids = shard.array, shard.ids
        self.hit = np.zeros(len(ids) + block.window + 1, np.int32)
        self.pairs = np.zeros(0, np.int64)
        self.short: list[tuple] = []  # occurrences of items shorter than a window
        depth = np.zeros(len(array) + 1, np.int32)
        kept: dict[int, tuple] = {}
        first = ids[array]
        asked = np.arange(len(block.suffixes))
        word = block.ids[block.suffixes]
        low, high = np.searchsorted(first, word, "left"), np.searchsorted(first, word, "right")
        k = 1
        while True:
            live = high > low
            asked, low, high = asked[live], low[live], high[live]
            if not len(asked):
                break
            # Suffixes come in order, so those that agree stand together, and their range is one.
            new = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
            depth[low[new]] += 1
            depth[high[new]] -= 1
            if places and k >= block.window:
                kept[k] = low[new], asked[new]
            if k <= block.window:
                whole = np.flatnonzero((block.size[block.item[asked]] == k) & (block.word[asked] == 0)) if k < block.window else np.arange(len(asked))
                self._occur(asked[whole], low[whole], high[whole], k)
            word = block.ids[block.suffixes[asked] + k]
            on = word > 0
            asked, low, high, word = asked[on], low[on], high[on], word[on]
            if not len(asked):
                break
            run = np.r_[True, (low[1:] != low[:-1]) | (word[1:] != word[:-1])]
            a, b = shard.narrowed(low[run], high[run], k, word[run])
            of = np.cumsum(run) - 1
            low, high = a[of], b[of]
            k += 1
        self.length = np.zeros(len(ids), np.int64)  # of the longest match that begins at a place
        self.length[array] = np.cumsum(depth)[: len(array)]
        self.longest = np.maximum.reduceat(np.r_[self.length, 0], shard.starts[:-1]) if len(shard.sizes) else np.zeros(0, np.int64)
        self.matches = self._maximal(kept) if places else np.zeros((0, 5), np.int64)

    def _occur(self, asked: np.ndarray, low: np.ndarray, high: np.ndarray, n: int) -> None:
        """Windows of n words: their occurrences are hit, and their items are met in the documents where they lie."""
        if not len(asked):
            return
        shard, block = self.shard, self.block
        new = np.r_[True, low[1:] != low[:-1]]
        of, slots = _spread(low[new], high[new])
        places = shard.array[slots]
        np.add.at(self.hit, places, 1)
        np.add.at(self.hit, places + n, -1)
        if n < block.window:
            self.short.append((places, np.full(len(places), n), asked[new][of]))
        many, documents = np.int64(len(shard.sizes)), shard.document(places)
        here = np.unique(of * many + documents)
        there = np.unique((np.cumsum(new) - 1) * np.int64(len(block.names)) + block.item[asked])
        window, document = np.divmod(here, many)
        owner_of, owner = np.divmod(there, len(block.names))
        first, last = np.searchsorted(owner_of, window, "left"), np.searchsorted(owner_of, window, "right")
        ends = np.cumsum(last - first)
        begin = 0
        while begin < len(window):
            end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + PAIRS, "right")))
            of, at = _spread(first[begin:end], last[begin:end])
            self.pairs = np.union1d(self.pairs, document[begin:end][of] * np.int64(len(block.names)) + owner[at])
            begin = end

    def _maximal(self, kept: dict[int, tuple]) -> np.ndarray:
        """(document, word, length, item, its word) of the matches of at least a window that no longer one holds, and of all occurrences of shorter items."""
        shard, block, length = self.shard, self.block, self.length
        places = np.flatnonzero((length >= block.window) & (np.r_[0, length[:-1]] <= length))
        slot = np.zeros(len(shard.ids), np.int64)
        slot[shard.array] = np.arange(len(shard.array))
        suffix = np.zeros(len(places), np.int64)
        for n in np.unique(length[places]).tolist():
            low, asked = kept[n]
            at = np.flatnonzero(length[places] == n)
            suffix[at] = asked[np.searchsorted(low, slot[places[at]], "right") - 1]
        rows = [(places, length[places], suffix), *self.short]
        place, n, suffix = (np.concatenate([r[i] for r in rows]) for i in range(3))
        order = np.lexsort((block.word[suffix], block.item[suffix], -n, place))
        place, n, suffix = place[order], n[order], suffix[order]
        document = shard.document(place)
        return np.column_stack([document, place - shard.starts[document], n, block.item[suffix], block.word[suffix]])


def search(texts: list[bytes], block: Block, places: bool = True) -> list[tuple]:
    """(words, hit words, items, matches, length of the longest match) of each text; no matches where their places aren't asked for."""
    shard = Shard(texts, block)
    found = Found(shard, block, places)
    covered = np.flatnonzero(np.cumsum(found.hit) > 0)
    document = shard.document(covered)
    ends = np.searchsorted(document, np.arange(len(texts) + 1))
    met, item = np.divmod(found.pairs, max(1, len(block.names)))
    met_ends = np.searchsorted(met, np.arange(len(texts) + 1))
    match_ends = np.searchsorted(found.matches[:, 0], np.arange(len(texts) + 1))
    names = block.names
    out = []
    for i, n in enumerate(shard.sizes.tolist()):
        a, b = ends[i], ends[i + 1]
        items = sorted({name for k in item[met_ends[i] : met_ends[i + 1]].tolist() for name in names[k]})
        matches = [(w, m, names[k][0], v) for _, w, m, k, v in found.matches[match_ends[i] : match_ends[i + 1]].tolist()]
        out.append((n, (covered[a:b] - shard.starts[i]).tolist(), items, matches, int(found.longest[i])))
    return out


def blocks(benchmark: DataFrame, size: int, work: Workspace, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW):
    """The distinct items in blocks of about size bytes, each gathered when it is its turn.  Rows are dealt by a hash: equal ones would all meet in one block, so they are united first."""
    items = benchmark.select(F.coalesce(F.col(f"`{item_col}`").cast("string"), F.lit("null")).alias("name"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).distinct()
    total = items.agg(F.sum(F.octet_length("text") + F.octet_length("name"))).first()[0] or 0
    n = 1 + total // size
    if n > 1:
        numbers = F.pmod(F.xxhash64("name", "text"), F.lit(n))
        items = work.table(items.withColumn("block", numbers).repartition("block").sortWithinPartitions("block"), "benchmark")
    for k in range(n):
        part = items if n == 1 else items.where(F.col("block") == k)
        yield n, Block([(r.name, r.text.encode()) for r in part.collect()], window)


_FOUND = "n_words long, hits array<int>, items array<string>, matches array<struct<word:int,length:int,item:string,item_word:int>>, longest long"


def overlaps(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, places: bool = True) -> DataFrame:
    """docs' columns but the text as _0, _1, ... by their places, and

    n_words; hits, the words of the text inside any occurrence of a window,
    ascending; items, the names of items with occurring windows, sorted;
    matches, the longest verbatim matches of at least a window where none is
    part of another, and every occurrence of shorter items, with the item and
    its word (none if places is False); and longest, the words of the longest verbatim match of any length.
    """
    work = Workspace(docs.sparkSession, "decon")
    sc = docs.sparkSession.sparkContext
    rows = numbered(docs).withColumnRenamed(f"_{docs.columns.index(text_col)}", "text")

    def judged(rows, block):
        sent = sc.broadcast(block)  # bounded by the block's bytes
        return sent, map_texts(rows, _FOUND, lambda: lambda texts: search(texts, sent.value, places), as_bytes=True, most_bytes=SHARD_BYTES, most_rows=SHARD_ROWS)

    passes = []
    for n, block in blocks(benchmark, block_bytes, work, window=window):
        if n == 1:
            return judged(rows, block)[1]
        if not passes:
            rows = work.table(rows.withColumn("row", F.monotonically_increasing_id()), "documents")  # written, a row keeps its number
        sent, out = judged(rows.select("row", "text"), block)
        passes.append(work.table(out.where("longest > 0"), "pass"))
        sent.destroy()
    every = passes[0]
    for p in passes[1:]:
        every = every.unionByName(p)
    empty = lambda c, t: F.coalesce(c, F.expr(f"CAST(array() AS array<{t}>)"))
    sums = every.groupBy("row").agg(
        *[F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("hits", "items")], F.array_sort(F.flatten(F.collect_list("matches"))).alias("matches"), F.max("longest").alias("longest")
    )  # each row's own results, one entry for each block
    counted = map_texts(rows, "n_words long", lambda: lambda texts: [(len(words(t)),) for t in texts], as_bytes=True)
    struct = "struct<word:int,length:int,item:string,item_word:int>"
    return counted.join(sums, "row", "left").select(
        *[c for c in rows.columns if c not in ("row", "text")], "n_words", empty(F.col("hits"), "int").alias("hits"), empty(F.col("items"), "string").alias("items"), empty(F.col("matches"), struct).alias("matches"), F.coalesce("longest", F.lit(0)).cast("long").alias("longest")
    )


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated, longest): longest is the length in words of the longest verbatim match of any length."""
    found = overlaps(docs.select(f"`{id_col}`", f"`{text_col}`"), benchmark, text_col, window, block_bytes, places=False)
    return found.select(
        F.col("_0").alias(id_col), "n_words", F.size("hits").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"), "longest",
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs that hold no window of the benchmark, with their columns."""
    at = docs.columns.index(text_col)
    rows = numbered(docs).withColumn("text", F.col(f"_{at}"))
    marked = overlaps(rows, benchmark, "text", window, block_bytes, places=False)
    return marked.where(F.size("hits") == 0).select(*[f"_{i}" for i in range(len(docs.columns))]).toDF(*docs.columns)
