"""Settings of a run: read from JSON, clamped and checked."""

from __future__ import annotations

import json
import math
import os
import re
from dataclasses import dataclass, field

# Defaults and bounds.
CHUNK, BATCH_CHARS, BATCH_PARAGRAPHS, PARALLEL = (7500, 500, 50_000), (7500, 500, 50_000), (10, 1, 100), (4, 1, 16)
SCOPES = ("main", "footnotes", "endnotes", "headers", "footers", "glossary")
MODES = ("correct", "translate")
STYLES = ("off", "auto", "with_space", "without_space")


@dataclass(frozen=True)
class Settings:
    mode: str = "correct"
    target_language: str = ""
    model: str = ""
    api_key: str = field(default="", repr=False)
    prompt: str = ""
    footnote_prompt: str = ""
    scope: tuple[str, ...] = ("main", "footnotes", "endnotes")
    chunk_chars: int = CHUNK[0]
    batch_chars: int = BATCH_CHARS[0]
    batch_paragraphs: int = BATCH_PARAGRAPHS[0]
    parallel: int = PARALLEL[0]
    requests_per_minute: float | None = None
    temperature: float | None = None
    citation_style: str = "auto"

    @property
    def key(self) -> str:
        """The key itself, or that of the environment variable it names."""
        return os.environ.get(self.api_key[4:].strip(), "") if self.api_key[:4].upper() == "ENV:" else self.api_key.strip()


def clamped(value, bounds: tuple[int, int, int]) -> int:
    default, low, high = bounds
    if not isinstance(value, int | float) or isinstance(value, bool) or not math.isfinite(value):
        return default
    return int(min(max(value, low), high))


def from_json(text: str) -> Settings:
    """Settings of a JSON object; unknown names are ignored, unknown values of mode and scope are errors."""
    raw = json.loads(text)
    mode = raw.get("mode") or "correct"
    style = re.sub("^(with|without)[_-]?space$", r"\1_space", str(raw.get("citationStyle") or "auto").strip().lower())
    rpm, temperature = raw.get("requestsPerMinute"), raw.get("temperature")
    number = lambda x: isinstance(x, int | float) and not isinstance(x, bool) and math.isfinite(x)
    out = Settings(
        mode=mode, target_language=(raw.get("targetLanguage") or "").strip(), model=(raw.get("model") or "").strip(), api_key=raw.get("apiKey") or "", prompt=raw.get("prompt") or "", footnote_prompt=raw.get("footnotePrompt") or "",
        scope=tuple(raw.get("scope") or Settings.scope), chunk_chars=clamped(raw.get("chunkChars"), CHUNK), batch_chars=clamped(raw.get("batchChars"), BATCH_CHARS), batch_paragraphs=clamped(raw.get("batchParagraphs"), BATCH_PARAGRAPHS),
        parallel=clamped(raw.get("parallel"), PARALLEL), requests_per_minute=float(rpm) if number(rpm) and rpm > 0 else None, temperature=min(max(float(temperature), 0.0), 2.0) if number(temperature) else None, citation_style=style if style in STYLES else "auto",
    )
    if problem := first_problem(out):
        raise ValueError(problem)
    return out


def first_problem(s: Settings) -> str | None:
    """What is wrong, the first rule that fails; None if nothing is."""
    rules = (
        (s.mode in MODES, f"unknown mode {s.mode!r}"),
        (s.mode != "translate" or bool(s.target_language), "a translation needs a target language"),
        (bool(s.scope), "the scope is empty"),
        (all(x in SCOPES for x in s.scope), f"unknown part in scope {s.scope!r}"),
    )
    return next((message for ok, message in rules if not ok), None)
