"""What an editor shows of corrections while they come in."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType, StructField, StructType

from ..functions.diff import OPS
from ..functions.growth import Growing, to_last_sentence
from ..functions.rows import SLICE

#: original: the text that is corrected, in a key's first row; piece: what a row adds to the correction; done: whether it is the last.
PIECES = "seq long, original string, piece string, done boolean"

#: Characters of diffs that go on together.
MOST_CHARACTERS = 4 << 20


def shown(pieces: DataFrame, key: list[str]) -> DataFrame:
    """key, seq, chars (of the correction so far), done, ops, for each row of key and PIECES.

    While a correction grows, the original is shown up to its last sentence
    end, and whole when the correction is done.  Each diff goes on from the one
    before.  A key's rows stream through one task in the order of seq; its
    memory holds one key's texts and table.  A null original is empty, a null
    piece adds nothing, a null done is false; rows after the end change
    nothing and aren't shown.  Rows with a null in
    key or seq are left out.
    """
    fields = [pieces.schema[k] for k in key]
    schema = StructType([*fields, StructField("seq", LongType()), StructField("chars", IntegerType()), StructField("done", BooleanType()), StructField("ops", OPS)])

    arrow = to_arrow_schema(schema)

    def made(batch: pa.RecordBatch, rows: list[int], texts: list[tuple], ops: list[list]) -> pa.RecordBatch:
        """Rows of a batch with what is shown of them."""
        entries = [o for one in ops for o in one]
        columns = [pa.array([o[i] for o in entries], pa.string()) for i in (0, 1)]
        lists = pa.ListArray.from_arrays(pa.array([0, *accumulate(map(len, ops))], pa.int32()), pa.StructArray.from_arrays(columns, fields=list(arrow.field("ops").type.value_type)), type=arrow.field("ops").type)
        own = batch.select([*key, "seq"]).take(pa.array(rows, pa.int64()))
        return pa.RecordBatch.from_arrays([*own.columns, *[pa.array([t[i] for t in texts], arrow.field(c).type) for i, c in enumerate(("chars", "done"))], lists], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = state = None
        original = text = ""
        over = False
        for batch in batches:
            rows, texts, shown_ops, size = [], [], [], 0
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                for i, (*own, first, piece, done) in enumerate(zip(*[part.column(c).to_pylist() for c in [*key, "original", "piece", "done"]], strict=True), start):
                    if own != at:
                        at, state, original, text, over = own, Growing(), first or "", "", False
                    if over:
                        continue
                    text, over = text + (piece or ""), done is True
                    rows.append(i)
                    texts.append((len(text), over))
                    shown_ops.append(state.texts(original if over else to_last_sentence(original), text))
                    size += len(original) + len(text)
                    if size >= MOST_CHARACTERS:
                        yield made(batch, rows, texts, shown_ops)
                        rows, texts, shown_ops, size = [], [], [], 0
            yield made(batch, rows, texts, shown_ops)

    known = pieces.select(*key, F.col("seq").cast("long").alias("seq"), "original", "piece", "done").dropna(subset=[*key, "seq"])
    return known.repartition(*key).sortWithinPartitions(*key, "seq").mapInArrow(run, schema)
