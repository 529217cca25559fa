"""Parts that relations reach."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import folder


def reached(roots: DataFrame, relations: DataFrame, parts: DataFrame, most_steps: int = 100) -> DataFrame:
    """part, depth: of every part that relations (source, target) reach from roots (part), how many steps away it is.

    Breadth first: each step goes on from the parts that the step before has
    met for the first time, so each part is gone on from once and circles end.
    (Recursive SQL would do, but Spark's unites steps with their repeats only,
    which in circles grow without end.)  A step is written before the next, so
    none is worked out twice.  Relations to what isn't among parts lead
    nowhere; parts further than most_steps aren't reached.
    """
    spark, base = relations.sparkSession, folder(relations.sparkSession, "reached")
    relations.select("source", F.col("target").alias("part")).distinct().join(parts.select("part"), "part", "left_semi").write.parquet(f"{base}/relations")
    known = spark.read.parquet(f"{base}/relations")
    met = roots.select("part").join(parts.select("part"), "part", "left_semi").distinct()
    schema = None
    for depth in range(most_steps + 1):
        path = f"{base}/met/depth={depth}"
        met.write.parquet(path)
        schema = met.schema
        met = spark.read.schema(schema).parquet(path)
        if met.isEmpty():
            break
        before = spark.read.schema(schema).parquet(*(f"{base}/met/depth={d}" for d in range(depth + 1)))
        met = met.select(F.col("part").alias("source")).join(known, "source").select("part").distinct().join(before, "part", "left_anti")
    return spark.read.schema(schema.add("depth", "integer")).parquet(f"{base}/met")
