"""Token counts as rollups that are kept up by deltas.

Documents are counted once into a narrow table (before and, where a text was
revised, after).  A batch turns inserts, deletes and revisions into signed rows
and sums them by source, language and tokenizer version; totals are the sums of
all committed batches.  A batch is written under a name of its own and counts
from the moment its marker exists; committing it again changes nothing, and
what a failed attempt left behind is never read.

Null source, lang or text are groups and counts like any other (null text: 0
tokens).  Repeated rows count as often as they stand there.  Groups that end
with neither documents nor tokens are left out of the totals.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete, map_texts

_PIECES = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\x20\x09-\x0d]")


def words(raw: bytes) -> int:
    """Runs of anything but ASCII white space."""
    return len(raw.split())


def pieces(raw: bytes) -> int:
    """Runs of letters and digits, any other visible character on its own."""
    return len(_PIECES.findall(raw))


def bpe(path: str) -> Callable[[bytes], int]:
    """A counter of a BPE vocabulary file's tokens; it loads the file where it first runs."""
    loaded = []

    def count(raw: bytes) -> int:
        if not loaded:
            from .bpe import Bpe

            loaded.append(Bpe(path))
        return sum(len(loaded[0].piece(p)) for p in loaded[0].split(raw.decode()))

    return count


#: Tokenizer version -> its counter.
COUNTERS: dict[str, Callable[[bytes], int]] = {"words/1": words, "pieces/1": pieces}


def counted(docs: DataFrame, keep: list[str], texts: dict[str, str], counters: dict[str, Callable[[bytes], int]] = COUNTERS) -> DataFrame:
    """keep, and for each name in texts an array of its column's counts, in the order of counters."""
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    out = docs.select(*map(quoted, keep), *[quoted(c).alias(f"_t_{n}") for n, c in texts.items()])
    count = list(counters.values())
    for n in texts:
        out = map_texts(out, f"`{n}` array<long>", lambda: lambda raws: [([f(r) for f in count],) for r in raws], f"_t_{n}", as_bytes=True)
    return out


def signed(counts: DataFrame, column: str, sign: int, documents: int = 1, counters=COUNTERS) -> DataFrame:
    """Signed rows of a counted column: sign is that of its tokens, documents how many documents each row adds (times sign)."""
    rows = counts.select("source", "lang", F.posexplode(column).alias("i", "n"))
    return rows.select("source", "lang", F.element_at(F.array(*map(F.lit, counters)), F.col("i") + 1).alias("tokenizer"), F.lit(sign * documents).cast("long").alias("d_docs"), (F.col("n") * sign).alias("d_tokens"))


def inserted(counts: DataFrame, column: str = "before") -> DataFrame:
    return signed(counts, column, 1)


def deleted(counts: DataFrame, column: str = "before") -> DataFrame:
    return signed(counts, column, -1)


def revised(counts: DataFrame, before: str = "before", after: str = "after") -> DataFrame:
    """Old counts go, new ones come; documents stay."""
    return signed(counts, before, -1, 0).unionByName(signed(counts, after, 1, 0))


class Rollup:
    """Committed batches in a shared folder."""

    KEYS = ("source", "lang", "tokenizer")
    SCHEMA = "source string, lang string, tokenizer string, d_docs long, d_tokens long"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _marker(self, batch: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits/{batch}")

    def markers(self) -> dict[str, dict]:
        fs, folder = self._fs(), self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits")
        if not fs.exists(folder):
            return {}
        found = {}
        for status in fs.listStatus(folder):
            if not status.getPath().getName().startswith((".", "_")):
                with_stream = fs.open(status.getPath())
                text = bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(with_stream)).decode()
                with_stream.close()
                if text.endswith("\n"):
                    found[status.getPath().getName()] = json.loads(text)
        return found

    def _mark(self, batch: str, content: dict) -> bool:
        """The marker under its name, only if none was there: it is created exclusively, which of several committers one alone can do.  A marker that its maker didn't finish holds no whole JSON line, counts for nothing, and is taken over."""
        fs, marker = self._fs(), self._marker(batch)
        line = json.dumps(content).encode() + b"\n"
        if fs.exists(marker) and batch not in self.markers():
            fs.delete(marker, False)
        try:
            out = fs.create(marker, False)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        out.write(bytearray(line))
        out.close()
        return True

    @staticmethod
    def _named(batch: str) -> None:
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_-]*", batch):
            raise ValueError(f"a batch needs a name of letters, digits, _ and -: {batch!r}")

    def _write(self, rows: DataFrame) -> str:
        data = f"{self.path}/data/{uuid.uuid4().hex}"
        rows.groupBy(*self.KEYS).agg(F.sum("d_docs").alias("d_docs"), F.sum("d_tokens").alias("d_tokens")).write.parquet(data)
        return data

    def commit(self, batch: str, rows: DataFrame) -> bool:
        """Whether this call made the batch count; False where it counted already."""
        self._named(batch)
        marks = self.markers()
        if batch in marks or any(batch in m["covers"] for m in marks.values()):
            return False
        data = self._write(rows)
        if self._mark(batch, {"data": data, "covers": []}):
            return True
        delete(self.spark, data)
        return False

    def _live(self) -> dict[str, str]:
        marks = self.markers()
        covered = {c for m in marks.values() for c in m["covers"]}
        return {b: m["data"] for b, m in marks.items() if b not in covered}

    def compact(self, name: str) -> bool:
        """Folds the batches of now into one; their names stay known.  True if this call did so.  Only one committer may compact at a time."""
        self._named(name)
        live = self._live()
        if not live:
            return False
        data = self._write(self.spark.read.schema(self.SCHEMA).parquet(*live.values()))
        if self._mark(name, {"data": data, "covers": sorted({*live, *(c for m in self.markers().values() for c in m["covers"])})}):
            return True
        delete(self.spark, data)
        return False

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens)."""
        live = self._live()
        rows = self.spark.read.schema(self.SCHEMA).parquet(*live.values()) if live else self.spark.createDataFrame([], self.SCHEMA)
        out = rows.groupBy(*self.KEYS).agg(F.sum("d_docs").alias("n_docs"), F.sum("d_tokens").alias("n_tokens"))
        return out.where((F.col("n_docs") != 0) | (F.col("n_tokens") != 0))
