"""The whole run over Word packages: looked into, accepted, corrected with revisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.correct import Corrector, corrected
from ..operators.packing import in_need
from ..sources import office, packages, shared


def inspected(files: DataFrame) -> DataFrame:
    """path, has_tracked_changes of packages (path, content): whether any of their paragraphs has text put in or taken out; false for what isn't a package."""
    found = office.read_paragraphs(files).groupBy("path").agg(F.bool_or(office.has_tracked_changes(F.col("runs"))).alias("has_tracked_changes"))
    return files.select("path").join(found, "path", "left").select("path", F.coalesce("has_tracked_changes", F.lit(False)).alias("has_tracked_changes"))


def accepted(files: DataFrame) -> DataFrame:
    """files with all revisions that they hold accepted."""
    return files.withColumn("content", packages.resolved("content", True))


def corrected_packages(files: DataFrame, author: str, date: str, corrector: Corrector | None = None, prompt: str = "", mode: str = "correct", scope: list[str] | None = None, accept_existing: bool = True) -> DataFrame:
    """files (path, content and more) with what a corrector makes of their paragraphs as revisions.

    Revisions that are there already are accepted first, unless
    accept_existing is false; then new ones are written inside them.  That is
    done once, in the shared folder.  Equal
    texts are asked once, over all packages; blank paragraphs and bare labels
    aren't asked.  scope: the parts that are corrected, as main, footnotes or
    headers; all where it is null.  Corrections are written to the shared
    folder before revisions are made of them, so that nothing is asked again
    where a task is lost.
    """
    base = files
    if accept_existing:
        opened = f"{shared.folder(files.sparkSession, 'accepted')}/files"
        accepted(files).write.parquet(opened)
        base = files.sparkSession.read.schema(files.schema).parquet(opened)
    texts = in_need(packages.texts_of(base))
    if scope is not None:
        texts = texts.where(F.split("label", " ")[0].isin(*scope))
    kept = f"{shared.folder(files.sparkSession, 'corrected')}/texts"
    corrected(texts, corrector, prompt, mode).where("corrected <> text").select("path", "label", "note", "pos", "corrected").write.parquet(kept)
    return packages.redlined(base, packages.revisions_of_texts(base, files.sparkSession.read.parquet(kept), author, date))
