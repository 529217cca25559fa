"""Near-duplicates by SimHash fingerprints and a Gray-order hierarchical index.

Two fingerprints that differ in at most d bits agree in one of d + 1 blocks of
bits, and in one of d + 1 parts of the rest; each distinct fingerprint goes to
the groups of its (block, part) values.  A group that is too large for a task
is cut into parts, and each two of its parts meet in a task of their own.
Groups are the roots of a Gray-order index: below a root the fingerprints are
sorted by Gray rank, so that neighbours share long masked patterns.  Upper
nodes hold those patterns; differences accumulate from node to node, and a
pair of nodes that is too far apart is dropped with all below it.  A group
gives one link from each of its linked fingerprints to the least of its
cluster, never all pairs.  Links are joined to components by star contraction
on tables in the shared folder.

Texts without words (null, empty or blank) have fingerprint zero and link like
any other.  Rows without an id keep their fingerprint, link nothing, and have a
null component.  Repeated rows give repeated results; rows that share an id and
differ in text are judged each by its own text.  Texts are taken whole.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, map_texts, named, numbered

SHINGLE, SEED, DISTANCE = 3, 42, 3
#: Nodes of a level that are compared with one another at once.
TILE = 2048
#: Cut points of the index's levels below the roots: the first bits, then more of them.
LEVELS = (16, 32, 48, 64)
#: Fingerprints of a group from which on it is cut into parts of about as many.
PART = 8192


def shingle_hashes(raw: bytes, size: int = SHINGLE) -> np.ndarray:
    """XXH64 of every shingle, repeats included."""
    words = raw.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False)) if len(words) >= size else [b" ".join(words)]
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64)


def fingerprints_of(texts: list[bytes]) -> list[int]:
    """A fingerprint for each text: the bits set in over half of its hashes."""
    hashes = [shingle_hashes(t) for t in texts]
    out = np.zeros(len(texts), np.uint64)
    for i, h in enumerate(hashes):
        if len(h):
            ones = np.zeros(64, np.int64)
            for a in range(0, len(h), 8192):
                ones += np.unpackbits(h[a : a + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
            out[i] = np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0]
    return out.view(np.int64).tolist()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): fp as the signed long of the same 64 bits."""
    return map_texts(docs.select(named(id_col), named(text_col)), "fp long", lambda: lambda texts: [(x,) for x in fingerprints_of(texts)], text_col, as_bytes=True)


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each code in the order in which neighbours differ in one bit."""
    out = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(shift)
    return out


class Clusters:
    """Union-find over small numbers, many unions at once."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.root[a], self.root[b]
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(up := self.root[self.root], self.root):
                self.root = up


class GrayIndex:
    """Distinct codes of several groups, in Gray order under nodes of shared leading bits; the groups are the roots."""

    def __init__(self, codes: np.ndarray, groups: np.ndarray):
        self.order = np.lexsort((gray_rank(codes), groups))
        self.codes, groups = codes[self.order], groups[self.order]
        new_group = np.r_[True, groups[1:] != groups[:-1]]
        # Leading bits of a code and of its rank name one another, so each pattern is one run of its group.
        self.levels = []
        for bits in (0, *LEVELS):
            pattern = self.codes >> np.uint64(64 - bits) if bits else np.zeros(len(codes), np.uint64)
            starts = np.flatnonzero(new_group | np.r_[True, pattern[1:] != pattern[:-1]])
            self.levels.append((pattern[starts], starts))

    def pairs(self, most: int):
        """Places (i, j), i < j in the order, of codes of one group that differ in at most most bits; in bounded runs."""
        roots = np.arange(len(self.levels[0][0]))
        for a in range(0, len(roots), TILE):
            yield from self._down(0, roots[a : a + TILE], roots[a : a + TILE], most)

    def _tile(self, level: int, left: np.ndarray, right: np.ndarray, most: int):
        patterns, _ = self.levels[level]
        # patterns hold all bits from the top, so their distance is what has accumulated down to this level
        far = np.bitwise_count(patterns[left][:, None] ^ patterns[right][None, :])
        i, j = np.nonzero(far <= most)
        yield from self._down(level, left[i], right[j], most)

    def _down(self, level: int, left: np.ndarray, right: np.ndarray, most: int):
        keep = left <= right
        left, right = left[keep], right[keep]
        if level == len(self.levels) - 1:
            apart = left < right
            if apart.any():
                yield left[apart], right[apart]
            return
        first, after = self._children(level)
        a, b = after[left] - first[left], after[right] - first[right]
        many = (a * b).astype(np.int64)
        wide = many > TILE * TILE
        for i in np.flatnonzero(wide):  # two nodes with many children each: by tiles
            for x in range(first[left[i]], after[left[i]], TILE):
                for y in range(first[right[i]], after[right[i]], TILE):
                    yield from self._tile(level + 1, np.arange(x, min(after[left[i]], x + TILE)), np.arange(y, min(after[right[i]], y + TILE)), most)
        left, right, many, b = left[~wide], right[~wide], many[~wide], b[~wide]
        patterns = self.levels[level + 1][0]
        ends = np.cumsum(many)
        start = 0
        while start < len(left):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + TILE * TILE)))
            size = many[start:stop]
            pair = np.repeat(np.arange(start, stop), size)
            at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            x, y = first[left[pair]] + at // b[pair], first[right[pair]] + at % b[pair]
            near = np.bitwise_count(patterns[x] ^ patterns[y]) <= most
            yield from self._down(level + 1, x[near], y[near], most)
            start = stop

    def _children(self, level: int):
        starts, below = self.levels[level][1], self.levels[level + 1][1]
        first = np.searchsorted(below, starts)
        return first, np.r_[first[1:], len(below)]


def links(codes: np.ndarray, groups: np.ndarray, most: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """(code, least code of its cluster) for the codes that link to a lesser one of their group."""
    index, clusters = GrayIndex(codes, groups), Clusters(len(codes))
    order = np.argsort(index.codes, kind="stable")
    place = np.empty(len(codes), np.int64)
    place[order] = np.arange(len(codes))  # clusters are named by the rank of their least code
    for i, j in index.pairs(most):
        clusters.join(place[i], place[j])
    moved = np.flatnonzero(clusters.root != np.arange(len(codes)))
    return index.codes[order[moved]], index.codes[order[clusters.root[moved]]]


def _keys(d: int = DISTANCE):
    """Columns of the group keys of fp: for each block of 64 / (d + 1) bits and each part of the other bits, what they hold."""
    width = 64 // (d + 1)
    fp = F.col("fp")
    out = []
    for block in range(d + 1):
        high = F.shiftrightunsigned(fp, width * block).bitwiseAND(F.lit((1 << width) - 1))
        # the other bits, moved together
        low = fp.bitwiseAND(F.lit((1 << (width * block)) - 1)) if block else F.lit(0).cast("long")
        rest = F.shiftleft(F.shiftrightunsigned(fp, width * (block + 1)), width * block) if block < d else F.lit(0).cast("long")
        others = rest.bitwiseOR(low)
        part = (64 - width) // (d + 1)
        for k in range(d + 1):
            value = F.shiftrightunsigned(others, part * k).bitwiseAND(F.lit((1 << part) - 1))
            out.append(F.lit((block * (d + 1) + k) << (width + part)).cast("long").bitwiseOR(F.shiftleft(high, part)).bitwiseOR(value))
    return F.array(*out)


def candidate_links(distinct: DataFrame, work: Workspace, part: int = PART) -> DataFrame:
    """(a, b): links of distinct fingerprints fp, each to the least of its cluster in a group."""

    def run(batches):
        # Rows come sorted by group; the last group of a batch may go on in the next one.
        held: list[np.ndarray] = []  # of (key, cell, fp) rows
        last = None

        def found():
            rows = np.concatenate(held, axis=1)
            group = np.cumsum(np.r_[False, (np.diff(rows[:2]) != 0).any(0)])
            alone = np.bincount(group) < 2
            rows, group = rows[2][~alone[group]], group[~alone[group]]
            if len(rows):
                pairs = np.unique(np.column_stack(links(rows.view(np.uint64), group)), axis=0).view(np.int64)
                if len(pairs):
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([batch.column(i).to_numpy() for i in range(3)])
            cut = int(np.flatnonzero(np.r_[True, (np.diff(rows[:2]) != 0).any(0)])[-1])  # what stands before the last group is whole
            if cut or tuple(rows[:2, 0]) != last:
                held.append(rows[:, :cut])
                yield from found()
                held.clear()
            held.append(rows[:, cut:])
            last = tuple(rows[:2, -1])
        if held:
            yield from found()

    keyed = distinct.select(F.explode(_keys()).alias("key"), "fp")
    hot = work.table(keyed.groupBy("key").count().where(F.col("count") > part).select("key", F.ceil(F.col("count") / part).alias("parts")), "hot")
    # A code of part p goes to the cells of p with each other part: every two parts meet, and what lies in one part meets itself.
    own = F.pmod(F.xxhash64("fp", F.lit(5)), F.col("parts"))
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda q: q != F.col("own"))
    cells = F.transform(others, lambda q: F.least(q, "own") * F.col("parts") + F.greatest(q, "own"))
    placed = keyed.join(hot, "key", "left").withColumn("own", own)
    celled = placed.select("key", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(-1).cast("long"))).otherwise(cells)).alias("cell"), "fp")
    return celled.repartition("key", "cell").sortWithinPartitions("key", "cell").mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame, work: Workspace, most: int = 60) -> DataFrame:
    """(node, root): for every node of the edges (a, b) the least node that it reaches.

    Large and small stars in turn: first every node's greater neighbours, then
    its lesser ones, are hung on the least neighbour.  Each round is written to
    the shared folder; rounds grow with the logarithm of the longest path.
    """

    def state(df):
        return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    def least(df):
        return df.groupBy("a").agg(F.min("b").alias("m"))

    now = work.table(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "edges")
    seen = state(now)
    for _ in range(most):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.join(least(both).select("a", F.least("a", "m").alias("m")), "a")
        large = near.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # in large every a is greater than its b, so the lesser neighbours of a are its b
        large = work.table(large, "large")
        lesser = large.join(least(large), "a")
        small = lesser.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(lesser.select("a", F.col("m").alias("b"))).distinct()
        new = work.table(small, "small")
        work.drop(large)
        work.drop(now)
        now, before, seen = new, seen, state(new)
        if seen == before:
            break
    else:
        raise RuntimeError(f"no end after {most} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _marked(docs: DataFrame, id_col: str, text_col: str, work: Workspace) -> DataFrame:
    """Rows (id, digest, fp, root, least): of every row of docs its text's digest and fingerprint, the fingerprint that names its component, and the least id there."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(f"`{text_col}`").alias("digest"), F.col(f"`{text_col}`").alias("text"))
    marked = work.table(map_texts(rows, "fp long", lambda: lambda texts: [(x,) for x in fingerprints_of(texts)], as_bytes=True), "marked")
    distinct = work.table(marked.where("id IS NOT NULL").groupBy("fp").agg(F.min("id").cast("long").alias("rep")), "distinct")
    roots = components(candidate_links(distinct, work), work)
    named = work.table(distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "rep", F.coalesce("root", "fp").alias("root")), "named")
    least = named.groupBy("root").agg(F.min("rep").alias("least"))
    return marked.join(named.join(least, "root").select("fp", "root", "least"), "fp", "left")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id): component_id is the least id that can be reached over links of at most three bits."""
    out = _marked(docs, id_col, text_col, Workspace(docs.sparkSession, "simhash"))
    return out.select(F.col("id").alias(id_col), "fp", F.when(F.col("id").isNotNull(), F.col("least")).alias("component_id"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with their columns, one of each component: that with the least id.

    Of rows with that id in the component the one with the least digest of its
    text stays, and of rows that share both the one whose other columns come
    first as JSON.  Rows without an id stay.
    """
    work = Workspace(docs.sparkSession, "dedup")
    found = work.table(_marked(docs, id_col, text_col, work).where("id IS NOT NULL").groupBy("root", "id", "digest").count(), "found")
    # Joined by the rows' own keys, not by the component: a large component is then no hot key.
    first = found.groupBy("root").agg(F.min(F.struct("id", "digest")).alias("first")).select("first.*")
    first = work.table(first.join(found.select("id", "digest", "count"), ["id", "digest"]), "first")
    # An id none of whose rows stays is told by itself; texts are only looked at where one id has rows of both kinds.
    gone = work.table(found.select("id").distinct().join(first.select("id"), "id", "left_anti"), "gone")
    mixed = work.table(found.select("id", "digest").join(first.select("id").distinct(), "id", "left_semi").join(first, ["id", "digest"], "left_anti"), "mixed")
    at = docs.columns.index(id_col), docs.columns.index(text_col)
    rows = numbered(docs).withColumns({"id": F.col(f"_{at[0]}"), "digest": F.xxhash64(f"_{at[1]}")})
    names = [f"_{i}" for i in range(len(docs.columns))]
    kept = rows.join(gone, "id", "left_anti")
    if not mixed.isEmpty():
        kept = kept.join(mixed, ["id", "digest"], "left_anti")
    repeated = work.table(first.where("count > 1").select("id", "digest"), "repeated")
    if not repeated.isEmpty():
        several = kept.join(repeated, ["id", "digest"], "left_semi")
        whole, others = F.struct(*names), F.to_json(F.struct(*[n for n in names if n != f"_{at[1]}"]))
        one = several.groupBy("id", "digest").agg(F.min_by(whole, others).alias("row")).select("row.*")
        return kept.join(repeated, ["id", "digest"], "left_anti").select(*names).union(one).toDF(*docs.columns)
    return kept.select(*names).toDF(*docs.columns)


def hexadecimal(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
