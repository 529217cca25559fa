"""Texts rearranged for filling in the middle.

Each text becomes an array of code points; where a sign that isn't white space
is followed by white space, a token ends (a token is white space and what
follows it, or white space at the end).  Two hashed ranks choose two of those
ends, which cut the text into prefix, middle and suffix; a third hash says
whether the text is rearranged at all, a fourth in which order.

A null text is empty, and empty texts stay plain, as do texts that hold one of
the markers: what is rearranged can always be put back.  A null id is hashed as
the empty text.  Repeated rows give repeated results; texts of any length are
taken whole; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts, named

PLAIN, PSM, SPM = "plain", "psm", "spm"


@dataclass(frozen=True)
class Rearrangement:
    """Of 100 texts, rearranged are to be cut, and of 100 of those suffix_first are to begin with their suffix.  The markers begin prefix, suffix and middle."""

    seed: int = 42
    rearranged: int = 50
    suffix_first: int = 80
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def hashes(self, doc_id) -> list[int]:
        digest = hashlib.sha256(f"{self.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
        return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]

    def apply(self, doc_id, text: str) -> tuple:
        """(n, form, prefix's length, middle's length, output)"""
        points = np.frombuffer(text.encode("utf-32-le"), "<u4")
        ends = token_ends(points)
        n, (first, second, whether, order) = len(ends), self.hashes(doc_id)
        if not text or any(m in text for m in (self.prefix, self.suffix, self.middle)) or whether % 100 >= self.rearranged:
            return n, PLAIN, None, None, text
        a, b = sorted((first % (n + 1), second % (n + 1)))
        a, b = (int(ends[k - 1]) if k else 0 for k in (a, b))
        pieces = (points[:a], points[a:b], points[b:])
        before, middle, after = (str(p.tobytes(), "utf-32-le") for p in pieces)
        if order % 100 < self.suffix_first:
            return n, SPM, a, b - a, f"{self.suffix}{after}{self.prefix}{before}{self.middle}{middle}"
        return n, PSM, a, b - a, f"{self.prefix}{before}{self.suffix}{after}{self.middle}{middle}"

    def restored(self, output: Column, form: Column) -> Column:
        """The text that output was made of: rearranged outputs hold each marker once."""
        quote = lambda m: "\\Q" + m.replace("\\E", "\\E\\\\E\\Q") + "\\E"
        parts = F.split(output, "|".join(map(quote, (self.prefix, self.suffix, self.middle))), -1)
        part = lambda i: F.element_at(parts, i)
        return F.when(form == PSM, F.concat(part(2), part(4), part(3))).when(form == SPM, F.concat(part(3), part(4), part(2))).otherwise(output)


def token_ends(points: np.ndarray) -> np.ndarray:
    """Where tokens end, the end of the text included."""
    blank = (points == 0x20) | ((points >= 0x09) & (points <= 0x0D))
    ends = np.flatnonzero(blank[1:] & ~blank[:-1]) + 1
    return np.append(ends, len(points)) if len(points) else ends


def fill_in_middle(docs: DataFrame, how: Rearrangement = Rearrangement(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) of every text: its tokens, what was done to it, code points of prefix and middle (null if plain), and the rearranged text."""

    def start():
        return lambda texts, ids: list(map(how.apply, ids, texts))

    rows = docs.select(named(id_col).alias("id"), named(text_col).alias("text"))
    made = map_texts(rows, "n long, form string, prefix_chars long, middle_chars long, output string", start, beside="id")
    return made.withColumnRenamed("id", id_col)


def fill_in_middle_digest(docs: DataFrame, how: Rearrangement = Rearrangement(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As fill_in_middle, with the digests of the output and of the text restored from it in place of the output."""
    made = fill_in_middle(docs, how, id_col, text_col)
    digests = [F.sha2("output", 256).alias("output_sha256"), F.sha2(how.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")]
    return made.select(named(id_col), "n", "form", "prefix_chars", "middle_chars", *digests)
