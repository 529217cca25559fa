"""Two versions compared into revisions, and revisions accepted, rejected and filtered.

A revision list is an ordered array of (kind, token), kind one of equal,
insert, delete; or rows of it, one for each entry, with their place.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate, pairwise

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from ..functions.diff import OPS, accepted, amount, kept_original, word_diff
from ..functions.rows import by_rows
from ..functions.text import html_escaped

NBSP = "\u00a0"


def paired(original: DataFrame, corrected: DataFrame, key: list[str], pos_col: str = "pos", text_col: str = "text") -> DataFrame:
    """key, pos, original, corrected: paragraphs by their place; those that one side has more have null on the other."""
    a = original.select(*key, pos_col, F.col(text_col).alias("original"), F.lit(True).alias("_a"))
    b = corrected.select(*key, pos_col, F.col(text_col).alias("corrected"), F.lit(True).alias("_b"))
    return a.join(b, [*key, pos_col], "full").drop("_a", "_b")


def notes_paired(original: DataFrame, corrected: DataFrame, key: list[str], text_col: str = "text") -> DataFrame:
    """Notes by their id; a note that only one side has is left out."""
    return original.select(*key, F.col(text_col).alias("original")).join(corrected.select(*key, F.col(text_col).alias("corrected")), key)


def compared(pairs: DataFrame) -> DataFrame:
    """pairs with status and ops.  To the diff's Python workers go the texts only of paragraphs that differ and stand on both sides; for all others they get nulls, and their ops are expressions."""
    entry = lambda kind, text: F.array(F.struct(F.lit(kind).alias("kind"), F.col(text).alias("token")))
    same, new, gone = F.coalesce(F.col("original") == F.col("corrected"), F.lit(False)), F.col("original").isNull(), F.col("corrected").isNull()
    status = F.when(new, "inserted").when(gone, "deleted").when(same, "unchanged").otherwise("changed")
    simple = F.when(new, entry("insert", "corrected")).when(gone, entry("delete", "original")).otherwise(entry("equal", "original")).cast(OPS)
    changed = F.col("status") == "changed"
    out = pairs.withColumn("status", status).withColumn("_diff", word_diff(F.when(changed, F.col("original")), F.when(changed, F.col("corrected"))))
    return out.withColumn("ops", F.when(changed, F.col("_diff")).otherwise(F.filter(simple, lambda o: o["token"] != ""))).drop("_diff")


def statistics(revised: DataFrame, key: list[str]) -> DataFrame:
    """key, paragraphs, changed, inserted, deleted, equal (characters), similarity."""
    one = {k: amount(F.col("ops"), k) for k in ("equal", "insert", "delete")}
    out = revised.groupBy(*key).agg(
        F.count(F.lit(1)).alias("paragraphs"), F.count_if(F.col("status") != "unchanged").alias("changed"),
        F.sum(one["insert"]).alias("inserted"), F.sum(one["delete"]).alias("deleted"), F.sum(one["equal"]).alias("equal"),
    )
    size = 2 * F.col("equal") + F.col("inserted") + F.col("deleted")
    return out.withColumn("similarity", F.when(size == 0, 1.0).otherwise(F.round(2 * F.col("equal") / size, 6)))


def entries(revised: DataFrame, key: list[str]) -> DataFrame:
    """A row for each entry: key, seq, kind, token."""
    return revised.select(*key, F.posexplode("ops").alias("seq", "o")).select(*key, "seq", "o.kind", "o.token")


RUNS = ArrayType(StructType([StructField("kind", StringType()), StructField("text", StringType()), StructField("offset", IntegerType()), StructField("props", StringType())]))


def runs_of(ops: list, spans: list, new_spans: list, marks: list[int]) -> list[tuple[str, str, int, str | None]]:
    """Entries as runs (kind, text, offset in the original, props).

    Equal and deleted text is cut where the original's spans (size, props) and
    marks lie, and has their formats; inserted text has those of the corrected
    text's spans.  A mark comes back as a run of its own kind before what
    stands at its offset, in front of what is inserted there.
    """
    old_ends, new_ends = ([0, *accumulate(n for n, _ in s)] for s in (spans, new_spans))
    left, out, i, j = sorted(marks), [], 0, 0

    def cut(kind: str, text: str, at: int, ends: list[int], formats: list) -> None:
        stops = {at, at + len(text), *ends, *(() if kind == "insert" else left)}
        for a, b in pairwise(sorted(x for x in stops if at <= x <= at + len(text))):
            place = i if kind == "insert" else a
            while left and left[0] <= place:
                out.append(("mark", "", left.pop(0), None))
            k = bisect_right(ends, a) - 1
            out.append((kind, text[a - at : b - at], place, formats[k][1] if k < len(formats) else None))

    for kind, text in ops:
        if kind == "insert":
            cut(kind, text, j, new_ends, new_spans)
        else:
            cut(kind, text, i, old_ends, spans)
            i += len(text)
        j += len(text) * (kind != "delete")
    return out + [("mark", "", at, None) for at in left]


@by_rows(RUNS)
def revision_runs(ops: list, spans: list, new_spans: list, marks: list[int]) -> list[dict]:
    """Columns of arrays (kind, token), (size, props), (size, props) and offsets to runs."""
    pairs = lambda rows, *names: [tuple(r[n] for n in names) for r in rows]
    made = runs_of(pairs(ops, "kind", "token"), pairs(spans, "size", "props"), pairs(new_spans, "size", "props"), marks)
    return [dict(zip(("kind", "text", "offset", "props"), r, strict=True)) for r in made]


def numbered(rows: DataFrame, key: list[str], order: list[str], first: Column | None = None) -> DataFrame:
    """Entries with rev_id for insertions and deletions, counted in order within a document."""
    turn = F.count_if(F.col("kind") != "equal").over(Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("rev_id", F.when(F.col("kind") != "equal", turn - 1 + (F.lit(1) if first is None else first)))


def next_revision_id(ids: Column) -> Column:
    """One more than the largest id that reads as a number above 0."""
    n = ids.try_cast("int")
    return (F.coalesce(F.max(F.when(n > 0, n)), F.lit(0)) + 1).cast("long")


def has_revisions(ops: Column) -> Column:
    return F.exists(ops, lambda o: o["kind"].isin("insert", "delete", "move_from", "move_to", "format"))


def all_accepted(ops: Column) -> Column:
    return accepted(ops)


def all_rejected(ops: Column) -> Column:
    return kept_original(ops)


def text_changes_only(rows: DataFrame) -> DataFrame:
    """Entries of other kinds than text go: a move's source and formats; its target is plain text."""
    return rows.where(~F.col("kind").isin("move_from", "format")).withColumn("kind", F.when(F.col("kind") == "move_to", "equal").otherwise(F.col("kind")))


def formats_rejected(props: Column, before: Column) -> Column:
    return F.coalesce(before, props)


def nbsp_restored(rows: DataFrame, key: list[str], order: str = "seq") -> DataFrame:
    """A deletion and an insertion side by side, in either order, that differ only in no-break spaces become the deleted text, plain.

    Of overlapping pairs the earlier one counts, so pairs are told by their
    place in a run of entries that could pair.  All of it is seen through one
    window, so rows are sorted once.
    """
    w = Window.partitionBy(*key).orderBy(order)
    kind, token = F.col("kind"), F.col("token")
    next_kind, next_token = F.lead("kind").over(w), F.lead("token").over(w)

    def only_spaces(deleted: Column, inserted: Column) -> Column:
        # equal where no-break spaces read as spaces, at places where the deleted text has them and the inserted one has spaces
        pairs = F.arrays_zip(F.split(deleted, "").alias("d"), F.split(inserted, "").alias("i"))
        fits = F.forall(pairs, lambda p: (p["d"] == p["i"]) | ((p["d"] == NBSP) & (p["i"] == " ")))
        return (F.length(deleted) == F.length(inserted)) & (deleted != inserted) & fits

    pair = ((kind == "delete") & (next_kind == "insert") & only_spaces(token, next_token)) | ((kind == "insert") & (next_kind == "delete") & only_spaces(next_token, token))
    marked = rows.withColumn("_pair", F.coalesce(pair, F.lit(False)).cast("int"))
    # starts of pairs that follow one another share entries: every second one of such a run counts
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = marked.withColumn("_at", F.row_number().over(w)).withColumn("_run", F.coalesce(F.max(F.when(F.col("_pair") == 0, F.col("_at"))).over(upto), F.lit(0)))
    marked = marked.withColumn("_take", (F.col("_pair") == 1) & ((F.col("_at") - F.col("_run")) % 2 == 1))
    text = F.when(kind == "delete", token).otherwise(F.lead("token").over(w))
    marked = marked.withColumns({"_text": text, "_gone": F.coalesce(F.lag("_take").over(w), F.lit(False))})
    out = marked.where(~F.col("_gone"))
    return out.withColumns({"token": F.when(F.col("_take"), F.col("_text")).otherwise(token), "kind": F.when(F.col("_take"), "equal").otherwise(kind)}).drop("_pair", "_at", "_run", "_take", "_text", "_gone")


def trailing_spaces_rejected(rows: DataFrame, key: list[str], order: str = "seq") -> DataFrame:
    """From a paragraph's end backwards, while entries hold spaces (U+0020) only: deleted ones become plain again, inserted ones go."""
    back = Window.partitionBy(*key).orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tail = F.bool_and(F.col("token").rlike("^ +$")).over(back)
    marked = rows.withColumn("_tail", tail)
    return marked.where(~(F.col("_tail") & (F.col("kind") == "insert"))).withColumn("kind", F.when(F.col("_tail") & (F.col("kind") == "delete"), "equal").otherwise(F.col("kind"))).drop("_tail")


def nearest_format(rows: DataFrame, key: list[str], order: str = "seq", format_col: str = "props") -> DataFrame:
    """Insertions take the format of the nearest entry before them that isn't one, else of the next."""
    w = Window.partitionBy(*key).orderBy(order)
    other = F.when(F.col("kind") != "insert", F.col(format_col))
    left = F.last(other, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    right = F.first(other, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    return rows.withColumn(format_col, F.when(F.col("kind") == "insert", F.coalesce(left, right, F.col(format_col))).otherwise(F.col(format_col)))


def span_at(spans: Column, offset: Column) -> Column:
    """Of ordered spans (start, end, props) the one that holds an offset, else the last that ends before it, else the first after."""
    inside = F.filter(spans, lambda s: (s["start"] <= offset) & (offset < s["end"]))
    before = F.filter(spans, lambda s: s["end"] <= offset)
    after = F.filter(spans, lambda s: s["start"] >= offset)
    return F.coalesce(F.get(inside, F.lit(0)), F.get(before, F.size(before) - 1), F.get(after, F.lit(0)))


def spans_at(offsets: DataFrame, spans: DataFrame, key: list[str], offset: str, start: str, values: list[str], width: int = 1 << 16) -> DataFrame:
    """offsets with the values of the span that holds the offset, else of the last before it, else of the first of its key; spans don't overlap.

    An as-of join that gathers nothing: spans and distinct offsets are merged
    in order within stretches of width places, so a key's rows are spread over
    tasks; what a stretch begins with is carried over from the summaries of the
    stretches before it, of which there is one row each.  Offsets of keys
    without spans have nulls, as have those without an offset.
    """
    stretch = lambda c: F.floor(F.col(c) / width).cast("long")
    own = spans.select(*key, F.col(start).cast("long").alias("_at"), F.struct(F.col(start).cast("long").alias("_at"), *values).alias("_span")).withColumn("_stretch", stretch("_at"))
    asked = offsets.where(F.col(offset).isNotNull()).select(*key, F.col(offset).cast("long").alias("_at")).distinct()
    ends = own.groupBy(*key, "_stretch").agg(F.max_by("_span", "_at").alias("_last"), F.min_by("_span", "_at").alias("_first"))
    touched = asked.select(*key, stretch("_at").alias("_stretch")).distinct().join(ends, [*key, "_stretch"], "full")
    before = Window.partitionBy(*key).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = touched.select(*key, "_stretch", F.last("_last", ignorenulls=True).over(before).alias("_carried"), F.min("_first").over(Window.partitionBy(*key)).alias("_first"))
    merged = asked.select(*key, "_at", stretch("_at").alias("_stretch"), F.lit(None).cast(own.schema["_span"].dataType).alias("_span")).unionByName(own)
    upto = Window.partitionBy(*key, "_stretch").orderBy("_at", F.col("_span").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = merged.withColumn("_seen", F.last("_span", ignorenulls=True).over(upto)).where("_span is null")
    found = seen.join(carried, [*key, "_stretch"]).select(*key, F.col("_at").alias(offset), F.coalesce("_seen", "_carried", "_first").alias("_span"))
    return offsets.join(found, [*key, offset], "left").select(*offsets.columns, *[F.col(f"_span.{v}").alias(v) for v in values])


def pairs_by_index(original: DataFrame, corrected: DataFrame, key: list[str], order: str, text_col: str = "text") -> DataFrame:
    """Parts such as headers by their turn: key, turn, original, corrected up to the smaller number of both."""

    def turned(df: DataFrame, name: str) -> DataFrame:
        return df.select(*key, (F.row_number().over(Window.partitionBy(*key).orderBy(order)) - 1).alias("turn"), F.col(text_col).alias(name))

    return turned(original, "original").join(turned(corrected, "corrected"), [*key, "turn"])


def document_compared(original: DataFrame, corrected: DataFrame, part_order: list[str], key: str = "doc_id", part: str = "part_kind", pos: str = "pos") -> DataFrame:
    """Every entry of a document's comparison with its number: parts in their order, paragraphs by place, one count of insertions and deletions through the whole document."""
    rows = entries(compared(paired(original, corrected, [key, part], pos)), [key, part, pos])
    order = F.array_position(F.array(*map(F.lit, part_order)), F.col(part))
    return numbered(rows.withColumn("part_no", order), [key], ["part_no", pos, "seq"]).drop("part_no")


def joined_neighbours(rows: DataFrame, key: list[str], order: str = "seq") -> DataFrame:
    """Entries of one kind side by side as one: key, seq (of the first), kind, token."""
    w = Window.partitionBy(*key).orderBy(order)
    new = F.coalesce((F.lag("kind").over(w) != F.col("kind")).cast("int"), F.lit(1))
    island = F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    marked = rows.withColumn("_new", new).withColumn("_island", island)
    token = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), "token"))), lambda x: x["token"]), "")
    return marked.groupBy(*key, "_island", "kind").agg(F.min(order).alias(order), token.alias("token")).drop("_island")


def html(ops: Column) -> Column:
    """Entries as HTML: insertions and deletions marked, the white space at their ends outside the marks."""

    def one(o: Column) -> Column:
        parts = [F.regexp_extract(o["token"], p, 0) for p in (r"(?U)^\s*", r"(?Us)\S(?:.*\S)?", r"(?U)(?<=\S)\s*$")]
        lead, body, trail = (html_escaped(x) for x in parts)
        tag = F.when(o["kind"] == "insert", F.lit("ins")).otherwise(F.lit("del"))
        marked = F.when(body == "", F.lit("")).otherwise(F.concat(F.lit("<"), tag, F.lit(">"), body, F.lit("</"), tag, F.lit(">")))
        return F.when(o["kind"] == "equal", html_escaped(o["token"])).otherwise(F.concat(lead, marked, trail))

    return F.array_join(F.transform(ops, one), "")
