"""Functions of one row as UDFs on Arrow columns."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

#: Rows that are Python objects at once; the rest of a batch stays as Arrow has it.
SLICE = 64
#: Bytes of an Arrow batch that Python gets, where its rows are large.
BATCH_BYTES = 4 << 20
_MOST = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """From now on the session's batches for Python have some BATCH_BYTES, not 10,000 rows whatever their size: what a worker holds doesn't grow with its task.  A limit that the session has set itself stays."""
    if spark.conf.get(_MOST, None) is None:
        spark.conf.set(_MOST, str(BATCH_BYTES))


def by_rows(returns: DataType | str):
    """A function of a row's values, nulls as None, as a UDF: of an Arrow batch only SLICE rows, and their results, are Python objects at a time."""
    kind = DataType.fromDDL(returns) if isinstance(returns, str) else returns
    arrow = to_arrow_type(kind)

    def made(f: Callable):
        def run(*columns: pa.Array) -> pa.Array:
            parts = [pa.array([], arrow)]
            for at in range(0, len(columns[0]), SLICE):
                parts.append(pa.array([f(*row) for row in zip(*[c.slice(at, SLICE).to_pylist() for c in columns], strict=True)], arrow))
            return pa.concat_arrays(parts)

        run.__name__ = f.__name__
        return F.arrow_udf(run, kind)

    return made
