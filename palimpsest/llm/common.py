"""What the operators share: reading, shared storage, and text batches."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

#: A slice of a batch that Python holds as objects at once.
SLICE_BYTES = 4 << 20
SLICE_ROWS = 1024


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).  Only where the session names none and runs on one machine, a temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="palimpsest-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


class Workspace:
    """Intermediate tables in the shared folder.  Writing one cuts the lineage, and survives the loss of executors.  What isn't dropped before goes when the driver ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.count = 0
        forget(spark, self.path)

    def table(self, df: DataFrame, name: str = "t") -> DataFrame:
        self.count += 1
        path = f"{self.path}/{name}-{self.count}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.workspace_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        if path := getattr(df, "workspace_path", None):
            delete(self.spark, path)


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def forget(spark: SparkSession, path: str) -> None:
    """Makes the folder path, and has it deleted when the driver ends."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(p)
    fs.deleteOnExit(p)


def named(name: str) -> Column:
    """The column of just this name, whatever signs it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def numbered(df: DataFrame) -> DataFrame:
    """df with its columns named _0, _1, ...: whatever they were called, they clash with nothing.  toDF(*df.columns) undoes it."""
    return df.toDF(*(f"_{i}" for i in range(len(df.columns))))


def held_out(id_col: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves this remainder.  A null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def held_out_py(doc_id, modulus: int, remainder: int) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % modulus == remainder


def sampled(rows: DataFrame, group: str, order: list[Column], most: int, salts: tuple[int, ...] = (64, 8)) -> DataFrame:
    """The first most rows of each group by order, with all their columns.

    Ranks are taken within salted parts of the groups first, fewer and fewer,
    so that no task reads a whole group, whatever its share of the rows; Spark
    keeps only the first rows of each partition before it shuffles them.
    """
    for n in (*salts, 1):
        salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*order, F.lit(1)), F.lit(n)))
        rank = F.row_number().over(Window.partitionBy(group, "_salt").orderBy(*order))
        rows = salted.withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_rank", "_salt")
    return rows


class Covered:
    """Spans (start, end) in order, so that it need not be asked of each whether it meets another."""

    def __init__(self, spans: Iterable[tuple[int, int]]):
        spans = sorted(spans)
        self.starts = [a for a, _ in spans]
        self.reach = list(accumulate((b for _, b in spans), max))

    def meets(self, start: int, end: int) -> bool:
        """Whether any of the spans has a place between start and end."""
        before = bisect_left(self.starts, end)
        return before > 0 and self.reach[before - 1] > start


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", as_bytes: bool = False, most_bytes: int = SLICE_BYTES, most_rows: int = SLICE_ROWS) -> Iterator[tuple[pa.RecordBatch, list]]:
    """(rows, their texts) in runs of bounded size; null texts are empty."""
    for rows, part in bounded(batches, text, most_bytes, most_rows):
        blank = b"" if as_bytes else ""
        yield rows, [blank if x is None else x for x in (part.cast(pa.binary()) if as_bytes else part).to_pylist()]


def bounded(batches: Iterator[pa.RecordBatch], text: str, most_bytes: int, most_rows: int) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """(rows, their texts as a column) in runs of bounded size."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
        start = size = 0
        for i, n in enumerate(sizes):
            if i > start and (size + n > most_bytes or i - start >= most_rows):
                yield batch.slice(start, i - start), column.slice(start, i - start)
                start, size = i, 0
            size += n
        if len(sizes) > start:
            yield batch.slice(start), column.slice(start)


def hand_back() -> None:
    """Gives memory that earlier tasks of a worker have freed back to the system, where the C library can: workers go on from stage to stage."""
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def map_texts(df: DataFrame, added: str, start: Callable[[], Callable], text: str = "text", as_bytes: bool = False, most_bytes: int = SLICE_BYTES, most_rows: int = SLICE_ROWS, beside: str | None = None) -> DataFrame:
    """df without its text, and the columns of added, which the texts are worked out to.

    start() runs once in a task and returns f(texts) -> one tuple for each text;
    where a column beside the text is named, f(texts, its values).
    """
    made_fields, at = StructType.fromDDL(added).fields, df.columns.index(text)
    by = None if beside is None else f"_{df.columns.index(beside)}"
    plain = numbered(df)  # names may hold signs that mapInArrow can't resolve
    kept = [f for i, f in enumerate(plain.schema.fields) if i != at]
    struct = StructType([*kept, *made_fields])
    names, types = struct.names, [to_arrow_type(f.dataType) for f in made_fields]

    def run(batches):
        hand_back()
        f = start()
        for rows, texts in slices(batches, f"_{at}", as_bytes, most_bytes, most_rows):
            made = zip(*(f(texts) if by is None else f(texts, rows.column(by).to_pylist())), strict=True)
            arrays = [rows.column(rows.schema.get_field_index(c)) for c in names[: len(kept)]]
            arrays += [pa.array(c, t) for c, t in zip(made, types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return plain.mapInArrow(run, struct).toDF(*[c for i, c in enumerate(df.columns) if i != at], *names[len(kept) :])
