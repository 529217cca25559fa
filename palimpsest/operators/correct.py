"""Correctors: whatever turns texts into corrected texts, and the run around one."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import label_restored
from ..functions.replies import edge_spaces_restored, sanitized, space_after_mark
from ..functions.rows import SLICE
from ..functions.text import chunks, is_blank, length_safe, let, translation_length_safe
from .align import selected_block, selected_block_by_length
from .lookup import once_each

CHUNK = 7500

log = logging.getLogger(__name__)


class Corrector(Protocol):
    """Prompts and texts in, replies out, a batch at a time; None where the service gave none."""

    def __call__(self, prompts: list[str], texts: list[str]) -> list[str | None]: ...


def echo(prompts: list[str], texts: list[str]) -> list[str | None]:
    return list(texts)


def scripted(answers: dict[str, str]) -> Corrector:
    return lambda prompts, texts: [answers.get(t, t) for t in texts]


def rules(text: Column) -> Column:
    """The built-in corrector, in expressions: runs of exclamation marks and of blanks become one."""
    return F.regexp_replace(F.regexp_replace(text, "!{2,}", "!"), " {2,}", " ")


class Throttled(Exception):
    """The service refuses for now; seconds: how long it asks to wait, if it says so."""

    def __init__(self, seconds: float | None = None):
        super().__init__(seconds)
        self.seconds = seconds


def with_retries(corrector: Corrector, batch_refusals: int = 3, refusals: int = 20, tries: int = 3, wait: Callable[[float], None] = time.sleep) -> Callable:
    """The corrector, asked with patience.

    A batch that is refused is sent again, three times at most.  Where it
    fails otherwise, its texts are asked one by one; each may be refused twenty
    times and fail three times.  What never succeeds has no reply.  Before it
    asks again it waits as long as the service says, or half a second for each
    attempt.
    """

    def attempt(prompts: list[str], texts: list[str], refused_most: int, failed_most: int) -> tuple[list[str | None] | None, bool]:
        """The replies, or none, and whether that was for refusals alone."""
        refused = failed = 0
        while True:
            try:
                return corrector(prompts, texts), False
            except Throttled as e:
                refused += 1
                if refused >= refused_most:
                    return None, True
                wait(max(e.seconds or 0.0, 0.5 * refused))
            except Exception as e:
                failed += 1
                if failed >= failed_most:
                    log.warning("a request failed %d times: %r", failed, e)
                    return None, False

    def ask(prompts: list[str], texts: list[str]) -> list[str | None]:
        several = len(texts) > 1
        got, refused = attempt(prompts, texts, batch_refusals if several else refusals, 1 if several else tries)
        if got is not None:
            return got
        if refused or not several:
            return [None] * len(texts)
        return [(attempt([p], [t], refusals, tries)[0] or [None])[0] for p, t in zip(prompts, texts, strict=True)]

    return ask


def replies(rows: DataFrame, corrector: Corrector, prompt: str, most: int = CHUNK) -> DataFrame:
    """(_key, text) to (_key, reply): long texts go in chunks, a chunk without a reply stays as it is.  The corrector is asked with SLICE texts' chunks at a time, which is all that is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                keys, texts = batch.column("_key").slice(at, SLICE), batch.column("chunks").slice(at, SLICE).to_pylist()
                flat = [(i, c) for i, cs in enumerate(texts) for c in cs]
                got = corrector([prompt] * len(flat), [c for _, c in flat])
                out: list[list[str]] = [[] for _ in texts]
                for (i, chunk), reply in zip(flat, got, strict=True):
                    out[i].append(reply if reply and reply.strip() else chunk)
                yield pa.RecordBatch.from_arrays([keys, pa.array(["".join(x) for x in out], pa.string())], ["_key", "reply"])

    return rows.select("_key", chunks("text", most).alias("chunks")).mapInArrow(run, "_key string, reply string")


def applied(rows: DataFrame, mode: str = "correct", by_text: bool = True, text_col: str = "text", reply_col: str = "reply", after_mark: Column | None = None, unsafe: Column | None = None) -> DataFrame:
    """rows with corrected, what the reply makes of the text: cleaned, the block that answers chosen, label and edges restored; the text itself where that isn't safe.

    after_mark: whether the text follows a reference mark, whose white space
    stays between them; unsafe: whether the paragraph holds what a correction
    could break, so that nothing is changed.
    """
    original = F.col(text_col)
    translating = mode == "translate"
    safe = translation_length_safe if translating else length_safe
    choose = selected_block_by_length if translating or not by_text else selected_block
    whole = edge_spaces_restored(original, label_restored(original, F.col("_block")))
    whole = whole if after_mark is None else space_after_mark(original, whole, after_mark)
    kept = is_blank("_clean") | is_blank("_block")
    kept = kept if unsafe is None else kept | F.coalesce(unsafe, F.lit(False))
    checked = let(whole, lambda w: F.when(safe(original, w), w).otherwise(original))
    out = rows.withColumn("_clean", sanitized(reply_col, original)).withColumn("_block", choose(F.col("_clean"), original))
    return out.withColumn("corrected", F.when(kept, original).otherwise(checked)).drop("_clean", "_block")


def corrected(paras: DataFrame, corrector: Corrector | None = None, prompt: str = "", mode: str = "correct") -> DataFrame:
    """paras with corrected.  Equal texts are asked once.  Without a corrector the built-in rules apply, all in expressions."""
    if corrector is None:
        return paras.withColumn("corrected", let(rules(F.col("text")), lambda new: F.when(length_safe("text", new), new).otherwise(F.col("text"))))
    work = lambda distinct: applied(distinct.join(replies(distinct, corrector, prompt), "_key"), mode).select("_key", "corrected")
    return once_each(paras, "text", work)


def corrected_as_a_whole(texts: DataFrame, corrector: Corrector, prompt: str = "") -> DataFrame:
    """texts with corrected, for texts without paragraphs around them, as in charts: equal texts are asked once, and a blank answer leaves the text as it is."""
    work = lambda distinct: replies(distinct, corrector, prompt).join(distinct, "_key").withColumn("_clean", sanitized("reply", F.col("text"))).select("_key", F.when(is_blank("_clean"), F.col("text")).otherwise(F.col("_clean")).alias("corrected"))
    return once_each(texts, "text", work)
