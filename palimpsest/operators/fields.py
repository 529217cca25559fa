"""Generated directories, told by the fields that make them.

A field begins and ends somewhere in a document, may hold others and go on over
paragraphs; what it is stands in its instruction, which may come in pieces.
All of it is running sums: the depth of fields, the number of a field among
those of its depth, the directories that are open.  Each is worked out within
stretches of a document and carried over from the sums of the stretches before,
so a document is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let
from ..sources import shared

# Field types that make directories, and what ends a type in an instruction.
DIRECTORY_FIELDS = ("TOC", "TOA", "INDEX")
_TYPE = r'^[^ \\"\t]*'
_TYPED = r'[ \\"\t]'

_STRETCH = "_stretch"


def running(rows: DataFrame, key: list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    """rows with sums of what stands up to each in the order of its key; _stretch, a number that never falls in that order, says which rows are summed up together.  Keys aren't null."""
    valued = rows.withColumns({f"_v_{n}": v for n, v in sums.items()})
    upto = Window.partitionBy(*key, _STRETCH).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*key).orderBy(_STRETCH).rowsBetween(Window.unboundedPreceding, -1)
    totals = valued.groupBy(*key, _STRETCH).agg(*[F.sum(f"_v_{n}").alias(n) for n in sums])
    # a key's first stretch has nothing to carry: only what is there is joined
    carried = totals.select(*key, _STRETCH, *[F.sum(n).over(before).alias(f"_c_{n}") for n in sums]).where(F.coalesce(*[F.col(f"_c_{n}") for n in sums]).isNotNull())
    own = valued.withColumns({n: F.sum(f"_v_{n}").over(upto) for n in sums})
    out = own.join(carried, [*key, _STRETCH], "left").withColumns({n: F.col(n) + F.coalesce(F.col(f"_c_{n}"), F.lit(0)) for n in sums})
    return out.select(*rows.columns, *sums)


def _typed(codes: Column) -> Column:
    """Of a field's pieces (n, stretch, text) in order: the instruction up to the piece that ends its type, and where that piece stands; nulls for the place where none does."""
    start = F.struct(F.lit("").alias("text"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("long").alias("stretch"))

    def more(acc: Column, c: Column) -> Column:
        def upto(text: Column) -> Column:
            done = text.rlike(_TYPED)
            return F.struct(text.alias("text"), F.when(done, c["n"]).alias("n"), F.when(done, c["stretch"]).alias("stretch"))

        return F.when(acc["n"].isNotNull(), acc).otherwise(let(F.regexp_replace(F.concat(acc["text"], c["text"]), r"(?U)^\s+", ""), upto))

    return F.aggregate(codes, start, more)


def directory_paragraphs(events: DataFrame, key: list[str], width: int = 1 << 14) -> DataFrame:
    """key, para: paragraphs that lie in a generated directory, of field events (key, seq, para, kind, text); kind is paragraph, begin, code or end.

    A directory reaches from the paragraph that its field begins in to the last
    that begins before its end.  A document whose fields don't balance has
    none, rather than too many.  Events are in the order of seq, a number; of
    equal ones in that of para, kind and text.  width: how many places of seq
    a stretch has.  A field's instruction is gathered, no document is.  Events
    are read once, and written to the shared folder; those of documents that have
    fields, and an end for each, are put in order and written with their numbers,
    and so are the directories, as all that follows asks for parts of them.
    """
    kind, is_ = F.col("kind"), lambda k: (F.col("kind") == k).cast("int")
    written = shared.folder(events.sparkSession, "fields")
    rows = events.select(F.struct(*key).alias("_key"), F.floor(F.col("seq") / width).cast("long").alias(_STRETCH), "seq", "para", "kind", "text").where(kind.isin("paragraph", "begin", "code", "end") & F.col("seq").isNotNull())
    rows.write.parquet(f"{written}/rows")
    rows = events.sparkSession.read.parquet(f"{written}/rows")
    closed = rows.where(kind.isin("begin", "end")).groupBy("_key").agg(F.sum(is_("begin") - is_("end")).alias("left")).where("left = 0").select("_key")
    rows = rows.join(closed, "_key", "left_semi")
    running(rows, ["_key"], ["seq", "para", "kind", "text"], {"n": F.lit(1), "depth": is_("begin") - is_("end")}).drop("seq").write.parquet(f"{written}/steps")
    steps = events.sparkSession.read.parquet(f"{written}/steps")
    steps = steps.join(steps.where("depth < 0").select("_key").distinct(), "_key", "left_anti")
    marks = steps.where((kind != "paragraph") & ((kind != "code") | (F.col("depth") > 0))).withColumn("level", F.col("depth") + is_("end"))
    fields = running(marks, ["_key", "level"], ["n"], {"turn": is_("begin")})
    piece = F.when((kind == "code") & (F.col("text") != ""), F.struct("n", F.col(_STRETCH).alias("stretch"), "text"))
    one = fields.groupBy("_key", "level", "turn").agg(
        F.max(F.when(kind == "begin", F.col("para"))).alias("para"), F.max(F.when(kind == "end", F.struct("n", F.col(_STRETCH).alias("stretch")))).alias("end"), _typed(F.array_sort(F.collect_list(piece))).alias("type"))
    made = one.where(F.col("type.n").isNotNull() & F.upper(F.regexp_extract("type.text", _TYPE, 0)).isin(*DIRECTORY_FIELDS))
    made.select("_key", "para", "type.n", "type.stretch", "end").write.parquet(f"{written}/made")
    made = events.sparkSession.read.parquet(f"{written}/made")
    border = lambda at, step: F.struct(F.col(f"{at}stretch").alias(_STRETCH), F.col(f"{at}n").alias("n"), F.lit(step).alias("step"))
    borders = made.select("_key", F.explode(F.array(border("", 1), border("end.", -1))).alias("b")).select("_key", "b.*", F.lit(None).cast(events.schema["para"].dataType).alias("para"))
    places = steps.where(kind == "paragraph").join(made.select("_key"), "_key", "left_semi").select("_key", _STRETCH, "n", F.lit(0).alias("step"), "para").unionByName(borders)
    inside = running(places, ["_key"], ["n"], {"open": F.col("step")}).where("open > 0 and step = 0").select("_key", "para")
    return inside.union(made.select("_key", "para")).distinct().select("_key.*", F.col("para").cast("int").alias("para"))
