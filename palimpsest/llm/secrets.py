"""Secrets in texts: fixed patterns, and values in credential contexts that are dear to guess.

A value beside a credential word is cut, by dynamic programming, into words,
dates, repeats, keyboard walks and brute-force spans so that the guesses an
attacker needs are fewest; values that still cost enough are secrets.  Words
are ranked: a short list common in passwords, then the whole words of a public
vocabulary file in its order.  Costs add up: each span's guesses, and for each
span after the first a choice among the five kinds, so the minimum is exact.

Null and empty texts have no spans.  Offsets count code points, ends excluded.
Texts are taken whole; repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache
from itertools import accumulate, pairwise
from math import log10

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Memory
from .common import Covered, map_texts, named

#: assign, access and hex are the fixed patterns; guess is what the guess cost adds.
KINDS = ("assign", "access", "hex", "guess")

#: A file whose whole words, in their order, rank words.
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")

#: Read on folded bytes; folding ASCII keeps every offset.
_ASSIGN = re.compile(rb"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]+")
_HEX_TABLE = bytes(0x68 if chr(b) in "0123456789abcdef" else 0x20 for b in range(256))
_KEY_WORDS = (b"password", b"passwd", b"secret", b"token", b"key")

#: Words that announce a credential; the value follows a sign or "is".
_CONTEXT = re.compile(
    r"""(?<![A-Za-z])(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|(?:api|access|private|auth)[ _-]?key|bearer|credentials?)["']?[ \t]*(?:[:=]|=>|->|[ \t]is[ \t])[ \t]*["']?([^\s"'<>,;]{6,})""",
    re.IGNORECASE,
)
_CONTEXT_WORDS = (b"pass", b"pwd", b"secret", b"token", b"key", b"bearer", b"credential")

# Words common in passwords and placeholders.
COMMON_WORDS = (
    "password", "passwd", "pass", "secret", "token", "admin", "administrator", "root", "user", "guest", "test", "demo", "example", "sample", "changeme", "change", "default", "login", "welcome", "hello",
    "letmein", "master", "monkey", "dragon", "shadow", "sunshine", "princess", "football", "baseball", "superman", "batman", "iloveyou", "trustno", "qwerty", "abc", "your", "my", "the", "key", "api",
    "here", "none", "null", "true", "false", "redacted", "hidden", "removed", "placeholder", "insert", "value", "string", "summer", "winter", "spring", "autumn", "access", "private", "public", "server",
    "database", "mysql", "postgres", "oracle", "google", "amazon", "home", "work", "office", "company", "love", "god", "star", "blue", "red", "green", "black", "white", "house", "dog", "cat", "freedom",
)
# The rows of a keyboard.
_ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
_YEAR, _MONTH, _DAY = "(?:19|20)[0-9]{2}", "(?:0[1-9]|1[0-2])", "(?:0[1-9]|[12][0-9]|3[01])"
#: Forms of dates, and log10 of how many there are.
_DATES = tuple((re.compile(p), log10(n)) for p, n in ((_YEAR, 120), (f"{_YEAR}[-/.]?{_MONTH}", 120 * 12), (f"{_YEAR}[-/.]?{_MONTH}[-/.]?{_DAY}", 120 * 365), (f"{_DAY}[-/.]?{_MONTH}[-/.]?{_YEAR}", 120 * 365)))
#: log10 of the kinds of spans.
KIND = log10(5)
#: log10 of the walks that begin at any of 47 keys in one of 3 directions, but for their length.
WALK = log10(47 * 3)
#: log10 of the guesses from which a value counts as a secret.
MIN_GUESSES = 10.0


def _neighbours() -> dict[str, set[str]]:
    near: dict[str, set[str]] = {}
    for y, row in enumerate(_ROWS):
        for x, c in enumerate(row):
            near[c] = {r[i] for r, i in ((row, x - 1), (row, x + 1), *((_ROWS[y + d], x + e) for d in (-1, 1) if 0 <= y + d < len(_ROWS) for e in (-1, 0, 1))) if 0 <= i < len(r)}
    return near


_NEAR = _neighbours()


def _alphabet(c: str) -> int:
    return 10 if c.isdigit() else 26 if c.isascii() and c.isalpha() else 33 if c.isascii() else 100


@lru_cache(maxsize=4)
def ranks(vocabulary: str) -> tuple[dict[str, int], int]:
    """Words to their ranks, from 1, and the length of the longest."""
    with open(vocabulary, encoding="utf-8") as f:
        model = json.load(f)["model"]
    end = model["end_of_word_suffix"]
    whole = (token.removesuffix(end) for token in sorted(model["vocab"], key=model["vocab"].get) if token.endswith(end))
    words = dict.fromkeys([*COMMON_WORDS, *(w for w in whole if len(w) >= 3 and w.isascii() and w.isalpha())])
    return {w: i + 1 for i, w in enumerate(words)}, max(map(len, words))


class Run:
    """Spans that may begin and end at any step of a run, and cost the logarithm of their length in steps.

    A start that is no dearer than a later one at the nearest end of the later
    is no dearer at any end, so the later one is left out.
    """

    def __init__(self, end: int, step: int, least: int, cost: float):
        self.end, self.step, self.least, self.cost = end, step, least, cost
        self.starts: list[list[tuple[int, float]]] = [[] for _ in range(step)]

    def offers(self, i: int, before: float):
        """(end, cost) for the spans from i on, where reaching i has cost before."""
        near = i + self.least * self.step
        known = self.starts[i % self.step]
        if near > self.end or any(cost + log10((near - at) / self.step) <= before + log10(self.least) for at, cost in known):
            return
        known.append((i, before))
        for j in range(near, self.end + 1, self.step):
            yield j, before + self.cost + log10((j - i) // self.step)


#: What the remembered values may weigh, in characters and 88 for each.
REMEMBERED = 4_000_000


@lru_cache(maxsize=2)
def _known(vocabulary: str) -> Memory:
    """Costs that a worker remembers, of bounded weight: long values are forgotten sooner."""
    return Memory(REMEMBERED)


def guess_cost(value: str, vocabulary: str = VOCABULARY) -> float:
    """log10 of the guesses for the cheapest cut of value into spans."""
    known = _known(vocabulary)
    if (cost := known.get(value)) is None:
        known.put(value, cost := _guess_cost(value, vocabulary))
    return cost


def _guess_cost(value: str, vocabulary: str) -> float:
    n, low = len(value), value.lower()
    if len(low) != n:  # a few characters are longer in lower case
        low = "".join([c.lower() if len(c.lower()) == 1 else c for c in value])
    rank, longest = ranks(vocabulary)
    best = [0.0] + [float("inf")] * n
    brute = float("inf")  # with a brute-force span that ends here and may go on
    repeats, walks, walk = _repeats(low), _walks(low), None
    running: list[Run] = []
    for i in range(n):
        before = best[i] + (KIND if i else 0.0)
        for j in range(i + 1, min(n, i + longest) + 1):
            if r := rank.get(low[i:j]):
                best[j] = min(best[j], before + log10(r * (1 if value[i:j] == low[i:j] else 2) + 1))
        for form, cost in _DATES:
            if m := form.match(value, i):
                best[m.end()] = min(best[m.end()], before + cost)
        if walk is None or walk.end != walks[i]:
            walk = Run(walks[i], 1, 4, WALK)
        running = [r for r in running if r.end > i] + [Run(*r) for r in repeats.get(i, ())]
        for run in (walk, *running):
            for j, cost in run.offers(i, before):
                best[j] = min(best[j], cost)
        brute = min(brute, before) + log10(_alphabet(value[i]))
        best[i + 1] = min(best[i + 1], brute)
    return best[n]


def _repeats(low: str) -> dict[int, list[tuple[int, int, int, float]]]:
    """Start -> (end, size, 3, cost of a unit) of the stretches in which one to four characters are said at least three times."""
    found: dict[int, list[tuple[int, int, int, float]]] = {}
    for size in (1, 2, 3, 4):
        i = 0
        while i + size < len(low):
            j = i
            while j + size < len(low) and low[j] == low[j + size]:
                j += 1
            if j - i >= 2 * size:
                found.setdefault(i, []).append((j + size, size, 3, sum(log10(_alphabet(c)) for c in low[i : i + size])))
            i = j + 1
    return found


def _walks(low: str) -> list[int]:
    """For each start, where the walk over neighbouring keys ends."""
    n = len(low)
    ends = [*range(1, n + 1)]
    for i in range(n - 2, -1, -1):
        if low[i + 1] in _NEAR.get(low[i], ()):
            ends[i] = ends[i + 1]
    return ends


def plain_bytes(raw: bytes) -> list[tuple[int, int, str]]:
    """Byte spans of the fixed patterns, leftmost and non-overlapping in each kind."""
    found = []
    low = raw.lower()
    if any(w in low for w in _KEY_WORDS):
        found += [(*m.span(), "assign") for m in _ASSIGN.finditer(low) if len(m[1]) >= 6]
    if b"AKIA" in raw:
        found += [(*m.span(), "access") for m in _ACCESS.finditer(raw) if m.end() - m.start() >= 20]
    at = (runs := raw.translate(_HEX_TABLE)).find(b"h" * 24)
    while at >= 0:
        end = _HEX.match(raw, at).end()
        found.append((at, end, "hex"))
        at = runs.find(b"h" * 24, end)
    return found


def guessed(text: str, base: list[tuple[int, int, str]], least: float = MIN_GUESSES, vocabulary: str = VOCABULARY) -> list[tuple[int, int, str]]:
    """Values in credential contexts that cost at least 10**least guesses and lie outside the plain spans."""
    found, covered = [], Covered((a, b) for a, b, _ in base)
    for m in _CONTEXT.finditer(text):
        value = m[1].rstrip(".)]}")
        a, b = m.start(1), m.start(1) + len(value)
        if len(value) >= 6 and not covered.meets(a, b) and guess_cost(value, vocabulary) >= least:
            found.append((a, b, "guess"))
    return found


def ordered(spans) -> list[tuple[int, int, str]]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def find(raw: bytes, least: float = MIN_GUESSES, vocabulary: str = VOCABULARY) -> tuple[list, list]:
    """(plain spans, all spans) of a text in UTF-8, in code points."""
    base = plain_bytes(raw)
    low = raw.lower()
    if not base and not any(w in low for w in _CONTEXT_WORDS):
        return [], []
    text = raw.decode()
    if base and len(text) != len(raw):
        ends = sorted({x for a, b, _ in base for x in (a, b)})
        place = dict(zip(ends, accumulate(len(raw[a:b].decode()) for a, b in pairwise([0, *ends])), strict=True))
        base = [(place[a], place[b], k) for a, b, k in base]
    base = ordered(base)
    more = guessed(text, base, least, vocabulary)
    return base, ordered(base + more) if more else base


def show(spans) -> str:
    return ",".join([f"{k}:{a}:{b}" for a, b, k in spans])


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = MIN_GUESSES, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans, n_guess, guess_costs): counts and digest are of the plain spans, spans are all; guess_costs has log10 of the guesses of each assigned or added value, in the order of spans."""

    def start():
        def run(texts):
            made = []
            for raw in texts:
                base, spans = find(raw, least, vocabulary)
                kinds = [k for _, _, k in base]
                costs = []
                if spans:
                    text = raw.decode()
                    costs = [round(guess_cost(re.split(r"""[:=]\s*["']?""", text[a:b], maxsplit=1)[-1], vocabulary), 3) for a, b, k in spans if k in ("assign", "guess")]
                made.append((*(kinds.count(k) for k in KINDS[:3]), hashlib.sha256(show(base).encode()).hexdigest(), show(spans), len(spans) - len(base), costs))
            return made

        return run

    kept = docs.select(named(id_col), named(text_col).alias("text"))
    return map_texts(kept, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long, guess_costs array<double>", start, as_bytes=True)
