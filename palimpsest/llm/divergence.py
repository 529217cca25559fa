"""How sources of a language diverge from each other and from the language.

Terms are runs of letters and of characters beyond ASCII.  A first pass over
the documents counts exactly in how many documents of its language each term
stands; those in enough of them are kept.  A second pass counts the occurrences
of the kept terms: an automaton (Aho-Corasick) of the terms, each with a
delimiter on either side, runs over texts in which everything else is a
delimiter.  The kept terms of all languages are dealt to automata of bounded
size; where they need several, each has a pass of its own.

What comes of it is sparse: (language, source, term) where the term occurs; all
terms that a source doesn't hold have the same share there.  Shares are whole
numbers of billionths and added up exactly.  Sources are compared in blocks,
over chunks of terms, in arrays of bounded size; sums of chunks are added up.

Null texts, languages and sources are empty texts.  A language without kept
terms compares its sources with value 0 and has no term rows; a source without
terms is compared like any other.  Repeated rows count as often as they stand;
ties of value go by the item's bytes; an empty table gives an empty one.
"""

from __future__ import annotations

from collections import Counter
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, hand_back, named, slices

#: Documents that a kept term is in at least, what is added to each count, the whole of all shares, and the terms that are told of a source.
LEAST_DOCUMENTS, ADDED, SCALE, MOST_TERMS = 30, 5, 1_000_000_000, 50

#: Bytes of terms in an automaton, entries in a task's tables before they are handed on, and how many terms and sources are compared at once.
AUTOMATON_BYTES, ENTRIES, CHUNK, BLOCK = 2 << 20, 400_000, 2048, 128

#: What bytes of a text count as: A-Z as a-z, a-z and bytes beyond ASCII as they are, all else as the delimiter.
TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def counted(rows: DataFrame, start, term_type: str) -> DataFrame:
    """rows' last column is a text: (the other columns, term, n), n added up in each task first.  start() gives f(text as bytes) -> the terms to count in it."""
    *names, text = rows.columns
    schema = ", ".join([*(f"{n} string" for n in names), f"term {term_type}", "n long"])

    def run(batches):
        hand_back()
        terms, counts, entries = start(), {}, 0

        def out():
            flat = [(*key, t, n) for key, found in counts.items() for t, n in found.items()]
            for i in range(0, len(flat), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*flat[i : i + 20_000], strict=True)], [*names, "term", "n"])

        for part, texts in slices(batches, text, as_bytes=True):
            for *key, t in zip(*(part.column(n).to_pylist() for n in names), texts, strict=True):
                found = counts.setdefault(tuple(key), Counter())
                entries -= len(found)
                found.update(terms(t))
                entries += len(found)
            if entries > ENTRIES:
                yield from out()
                counts, entries = {}, 0
        yield from out()

    return rows.mapInArrow(run, schema).groupBy(*names, F.col("term").cast("string").alias("term")).agg(F.sum("n").alias("n"))


def document_frequencies(rows: DataFrame) -> DataFrame:
    """(lang, term, n) of (lang, text): in how many documents of its language each term stands."""
    return counted(rows, lambda: lambda text: set(text.translate(TABLE).split()), "binary")


def automaton(terms: list[str]) -> ahocorasick.Automaton:
    """Finds terms that stand between delimiters."""
    made = ahocorasick.Automaton()
    for t in terms:
        made.add_word(f" {t} ", t)
    made.make_automaton()
    return made


def occurrences(rows: DataFrame, terms: DataFrame, work: Workspace, automaton_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """(lang, source, term, n) of (lang, source, text): how often each of the given terms occurs.  One automaton at a time is with the driver and the executors."""
    spark = rows.sparkSession
    size = terms.agg(F.sum(F.octet_length("term") + 2)).first()[0] or 0
    parts = max(1, -(-size // automaton_bytes))
    dealt = F.pmod(F.xxhash64("term"), F.lit(parts))
    made = None
    for part in range(parts):
        block = spark.sparkContext.broadcast([r.term for r in terms.where(dealt == part).toLocalIterator()])

        def start(block=block):
            found, value = automaton(block.value), itemgetter(1)
            return lambda text: map(value, found.iter(f" {text.translate(TABLE).decode()} ")) if len(found) else ()

        one = work.table(counted(rows, start, "string"), "occurrences")
        block.destroy()
        made = one if made is None else made.unionByName(one)
    return made


def _share(n: str, total: str, terms: str) -> str:
    wide = lambda c: f"cast({c} as decimal(19, 0))"
    return f"1 + (cast({SCALE} as decimal(10, 0)) * {wide(f'{n} + {ADDED}')}) div ({wide(total)} + {ADDED} * {wide(terms)})"


def differences(shares: DataFrame, groups: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, a, b, value) with a before b: all pairs of sources of a language, and their differences summed over its kept terms.

    shares: (lang, source, term, p) where the term occurs; groups: (lang, source, V, p0), p0 the share of what doesn't occur; kept: (lang, term).
    """
    sizes = groups.groupBy("lang").agg(F.max("V").alias("V"), F.count("*").alias("S")).selectExpr("lang", f"greatest(1, cast(ceil(V / {CHUNK}) as bigint)) as chunks", f"cast(ceil(S / {BLOCK}) as bigint) as blocks")
    chunk, mine = F.expr("pmod(xxhash64(term), chunks)"), F.expr("pmod(xxhash64(source), blocks)")
    held = kept.join(sizes, "lang").groupBy("lang", chunk.alias("chunk")).agg(F.count("*").alias("width"))
    chunks = sizes.select("lang", F.explode(F.expr("sequence(0, chunks - 1)")).alias("chunk")).join(held, ["lang", "chunk"], "left")
    every = groups.select("lang", "source", F.col("p0").alias("p")).join(chunks, "lang").join(sizes, "lang").select("lang", "chunk", "blocks", "source", F.lit(None).cast("string").alias("term"), "p", F.coalesce("width", F.lit(0)).alias("width"))
    present = shares.join(sizes, "lang").select("lang", chunk.alias("chunk"), "blocks", "source", "term", "p", F.lit(0).cast("long").alias("width"))
    rows = every.unionByName(present).withColumn("mine", mine).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    rows = rows.select("lang", "chunk", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), "mine", "source", "term", "p", "width")

    def compare(key, table):
        lang, _, x, y = (k.as_py() for k in key)
        term = pc.dictionary_encode(table["term"].combine_chunks())
        column = pc.fill_null(term.indices, -1).to_numpy(zero_copy_only=False)
        p, block = table["p"].to_numpy(), table["mine"].to_numpy()
        source = pc.dictionary_encode(table["source"].combine_chunks())
        at, names = source.indices.to_numpy(), source.dictionary.to_pylist()
        fill, of = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
        fill[at[column < 0]], of[at[column < 0]] = p[column < 0], block[column < 0]
        dense = np.repeat(fill[:, None], len(term.dictionary), 1)
        dense[at[column >= 0], column[column >= 0]] = p[column >= 0]
        absent = int(pc.max(table["width"]).as_py()) - len(term.dictionary)  # terms of the chunk that none of these sources holds
        a, b, value = [], [], []
        for i in np.flatnonzero(of == x):
            others = np.flatnonzero(of == y)
            others = others[others > i] if x == y else others
            sums = np.abs(dense[others] - dense[i]).sum(1) + absent * np.abs(fill[others] - fill[i])
            for j, v in zip(others, sums.tolist(), strict=True):
                first, second = sorted((names[i], names[j]), key=str.encode)
                a.append(first)
                b.append(second)
                value.append(v)
        return pa.table({"lang": pa.array([lang] * len(a), pa.string()), "a": pa.array(a, pa.string()), "b": pa.array(b, pa.string()), "value": pa.array(value, pa.int64())})

    return rows.groupBy("lang", "chunk", "x", "y").applyInArrow(compare, "lang string, a string, b string, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least: int = LEAST_DOCUMENTS, most_terms: int = MOST_TERMS, automaton_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """(lang, source, part, item, value, rank).

    Part pair: every other source of the language and the difference of their
    shares, summed over the language's kept terms.  Part term: the kept terms
    that a source has more of than its language, by how much more, only the
    first most_terms.
    """
    work = Workspace(docs.sparkSession, "divergence")
    name = lambda c, to: F.coalesce(named(c).cast("string"), F.lit("")).alias(to)
    rows = docs.select(name(lang_col, "lang"), name(source_col, "source"), named(text_col).cast("string").alias("text"))
    kept = work.table(document_frequencies(rows.select("lang", "text")).where(F.col("n") >= least).select("lang", "term"), "kept")
    found = occurrences(rows, kept.select("term").distinct(), work, automaton_bytes)
    counts = work.table(found.join(kept, ["lang", "term"], "left_semi").select("lang", "source", "term", "n"), "counts")

    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    of_lang = counts.groupBy("lang").agg(F.sum("n").alias("lang_total"))
    terms = kept.groupBy("lang").agg(F.count("*").alias("V"))
    groups = rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(terms, "lang", "left").join(of_lang, "lang", "left").na.fill(0, ["total", "V", "lang_total"])
    groups = work.table(groups.withColumn("p0", F.expr(f"if(V = 0, 1, {_share('0', 'total', 'V')})")), "groups")

    shares = counts.join(groups, ["lang", "source"]).withColumn("p", F.expr(_share("n", "total", "V")))
    pairs = differences(shares.select("lang", "source", "term", "p"), groups, kept).select("lang", F.explode(F.expr("array(struct(a as source, b as item), struct(b as source, a as item))")).alias("r"), "value")
    pairs = pairs.select("lang", "r.source", F.lit("pair").alias("part"), "r.item", "value")

    whole = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"))
    more = shares.join(whole, ["lang", "term"]).withColumn("q", F.expr(_share("lang_n", "lang_total", "V"))).where("p > q")
    more = more.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", rank).unionByName(more.withColumn("rank", rank).where(F.col("rank") <= most_terms))
