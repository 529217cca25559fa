"""Tables as ordered paragraphs, chat messages and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Parts of a document in their order, with their weight in its progress.
PARTS = (("main", 70), ("footnotes", 5), ("endnotes", 5), ("headers", 2), ("footers", 3), ("glossary", 2))
#: Largest input, in bytes, and its kinds.
MOST_BYTES, EXTENSIONS = 30 * 1024 * 1024, ("docx", "docm", "dotx", "dotm")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def paragraphs(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, pos, text): the lines of each text, by their place from 0.  An empty text is one empty line; a null text has none, so its document has no rows."""
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.col(text_col), "\n")).alias("pos", "text"))


def parts(paras: DataFrame) -> DataFrame:
    """Paragraphs dealt to the parts of a document by their place."""
    names = F.array(*[F.lit(name) for name, _ in PARTS])
    return paras.withColumn("part_kind", F.element_at(names, F.col("pos") % len(PARTS) + 1))


def scoped(paras: DataFrame, scope: list[str], part: str = "part_kind") -> DataFrame:
    """Paragraphs of the parts asked for; an error where there is none."""
    out = paras.where(F.col(part).isin(*scope))
    if out.isEmpty():
        raise ValueError(f"no text in {', '.join(scope)}")
    return out


def part_weights(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, name, weight) for i, (name, weight) in enumerate(PARTS)], "part_no int, part_kind string, weight int")


def accepted_files(files: DataFrame) -> DataFrame:
    """Rows of a binaryFile listing that may be opened: kind and size."""
    return files.where(F.lower("path").rlike(rf"\.({'|'.join(EXTENSIONS)})$") & (F.col("length") <= MOST_BYTES))


def uploads(rows: DataFrame, name_col: str = "name", data_col: str = "data") -> DataFrame:
    """Base64 uploads decoded: (name, content, size), names without folders; empty, oversized and unknown kinds dropped."""
    base = F.regexp_extract(F.col(name_col), r"([^/\\]+)$", 1)
    content = F.expr(f"try_to_binary(`{data_col}`, 'base64')")
    out = rows.select(base.alias("name"), content.alias("content")).withColumn("size", F.octet_length("content").cast("long"))
    return out.where((F.col("size") > 0) & (F.col("size") <= MOST_BYTES) & F.lower("name").rlike(rf"\.({'|'.join(EXTENSIONS)})$"))


def event_lines(lines: DataFrame, col: str = "value") -> DataFrame:
    """Lines of a worker's JSON output by type; what isn't JSON or has no type is left out."""
    schema = "type string, level string, message string, percent int, outputPath string, trackChangesCreated boolean, hasTrackChanges boolean"
    return lines.select(F.from_json(F.col(col), schema).alias("e")).select("e.*").where(F.col("type").isNotNull())


def model_names(payloads: DataFrame, col: str = "value") -> DataFrame:
    """Ids of a model list, without those for sight, sound and images; a local server's list as it is."""
    remote = F.from_json(F.get_json_object(F.col(col), "$.data"), "array<struct<id:string>>")
    local = F.from_json(F.get_json_object(F.col(col), "$.models"), "array<struct<model:string>>")
    wanted = F.filter(F.transform(remote, lambda m: m["id"]), lambda i: ~F.lower(i).rlike("vision|audio|image"))
    return payloads.select(F.explode(F.coalesce(wanted, F.transform(local, lambda m: m["model"]))).alias("model"))
