"""Personal data, plain and disguised.

Plain identifiers are found by fixed patterns.  Disguised ones: transducers
rewrite a text - look-alike characters, bracketed or spelled "at" and "dot",
digits spelled as words - and keep for every rewritten stretch where it came
from; the same detectors read the rewritten text, and their spans are mapped
back to source characters.  A span that no rewriting touched is not added, and
neither is one that overlaps a plain span of its kind.

Disguises are read in English, French, German and Spanish.  Null and empty texts have no spans.  Offsets count code points, ends excluded.
Texts are taken whole; repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Covered, map_texts, named, numbered

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: No part of a match can begin inside a run of digits: where it fails from the run's start, it fails from any of its digits.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join([c for c in s if "0" <= c <= "9"])


def octet(part: str) -> bool:
    """Whether digits, however many, say at most 255."""
    return len(part := part.lstrip("0")) <= 3 and int(part or 0) <= 255


def emails(text: str) -> list[Span]:
    """A match holds one @ after its local part, so it is enough to look at each @: the match begins where the run before it begins."""
    found, at, free = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found.append((start, m.end(), "email"))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return found


def plain(text: str) -> list[Span]:
    """Spans of the fixed patterns, leftmost and non-overlapping in each kind, ordered by start and kind."""
    found = emails(text) if "@" in text else []
    if _DIGIT.search(text):
        found += [(*m.span(), "ip") for m in _IP.finditer(text) if all(map(octet, m[0].split(".")))]
        found += [(*m.span(), "card") for m in _CARD.finditer(text) if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
        if "+" in text:
            found += [(*m.span(), "phone") for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return ordered(found)


def ordered(spans) -> list[Span]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


# Cyrillic and Greek letters drawn like Latin ones, and stops, at and plus signs of other scripts.
_LIKE = dict(zip("аеорсухіјѕԁһвмнтАВЕКМНОРСТХІЈЅοανριΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijsdhbmhtABEKMHOPCTXIJSoavpiABEZHIKMNOPTYX", strict=True))
_LIKE |= {"。": ".", "．": ".", "｡": ".", "․": ".", "·": ".", "＠": "@", "﹫": "@", "＋": "+", "﹢": "+", "‐": "-", "‑": "-", "‒": "-", "–": "-"}
_HIDDEN = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
# Digits as words in English, French, German and Spanish.
_SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "zéro": "0", "un": "1", "une": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "fuenf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "cero": "0", "uno": "1", "una": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
# The at sign and the dot as words of these languages.  Only words of one language go together where no bracket marks them.
_SPOKEN = (("at", "dot"), ("arobase|arrobase", "point|dot"), ("arroba", "punto"), ("at|ät|klammeraffe", "punkt"))
_AT, _DOT = ("|".join(dict.fromkeys(w for pair in _SPOKEN for w in pair[i].split("|"))) for i in (0, 1))
_PLUS = "plus|más|mas"


def _alike(c: str) -> str:
    if c in _LIKE:
        return _LIKE[c]
    if c in _HIDDEN:
        return ""
    folded = unicodedata.normalize("NFKC", c)
    if len(folded) == 1 and folded.isascii():
        return folded
    value = unicodedata.decimal(c, None)
    return c if value is None else str(value)


def _class(chars: list[int]) -> str:
    """A character class of code points, in ranges."""
    runs: list[list[int]] = []
    for c in chars:
        if runs and c == runs[-1][1] + 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs) + "]"


#: Characters that the first transducer rewrites.  The planes above the second hold none.
_ODD = re.compile(_class([c for c in range(0x80, 0x20000) if not 0xD800 <= c < 0xE000 and _alike(chr(c)) != chr(c)]) + "+")
_WORD = "|".join(_SPELLED)
_DIGITS = rf"(?:(?:{_WORD}|[0-9])(?:[\s-](?:{_WORD}|[0-9])){{0,2}}|[0-9]{{1,3}})"
_LABEL = "[A-Za-z0-9-]+"
# Top-level domains that a spoken address may end in, and, for each language of _SPOKEN, those that are words of it.
_TOP = "com|org|net|edu|gov|mil|int|info|biz|name|pro|mobi|online|site|shop|store|tech|cloud|blog|email|example|test|local|invalid|dev|app|ai|io|co|eu|uk|fr|ch|nl|pl|cz|dk|fi|gr|hu|pt|ro|ru|sk|ua|br|mx|cl|ar|ca|jp|cn|kr|nz|za|au|ie|li|lt|lv|bg|hr|rs|tr|il|sg|hk|tw|th|vn|ph|cc|tv|fm|gg|ly|xyz|de|es|se"
_WORDS_TOO = ("", "de|es|se|ca|ai", "de|se", "es")
#: What stands before "at" in a sentence and not in an address.
_NO_NAME = "me|us|him|her|it|them|you|is|are|was|were|be|been|look|looked|here|there|home|mich|uns|ihn|sie|nous|lui|eux|nos|ellos"
# where nothing is bracketed, the words alone don't make an address: a known top-level domain ends it, and a name begins it
_TOPS = ["|".join(t for t in _TOP.split("|") if t not in own.split("|")) for own in _WORDS_TOO]
_MAIL = "|".join(rf"\s(?:{at})\s{_LABEL}(?:\s(?:{dot})\s{_LABEL})*\s(?:{dot})\s(?:{top})(?![\w-])" for (at, dot), top in zip(_SPOKEN, _TOPS, strict=True)) + rf"|@{_LABEL}(?:\s(?:{_DOT})\s{_LABEL})+"
_RULES = re.compile(
    rf"(?P<at>\s{{0,3}}[\[({{<]\s*(?:{_AT}|@)\s{{0,3}}[\])}}>]\s{{0,3}}|(?<=\w)\s@\s(?=\w)|&(?:\#64|commat);)"
    rf"|(?P<dot>\s{{0,3}}[\[({{<]\s*(?:{_DOT}|\.)\s{{0,3}}[\])}}>]\s{{0,3}}|&(?:\#46|period);)"
    rf"|(?<![\w@.%+-])(?P<plain>(?!(?:{_NO_NAME})\s)[A-Za-z0-9._%+-]+(?:{_MAIL}))(?!\w)"
    rf"|(?<!\w)(?P<spelled>{_DIGITS}(?:\s(?:{_DOT})\s{_DIGITS}){{3}}|(?:(?:{_PLUS})[\s-]+)?(?:{_WORD})(?:[\s,.-]{{1,2}}(?:{_WORD}|[0-9])){{6,}})(?!\w)",
    re.IGNORECASE,
)
_DOTS = tuple(_DOT.split("|"))
_ENTITY = re.compile("&(?:#64|#46|commat|period);")
_BRACKETED = re.compile(rf"[\[({{<]\s*(?:{_AT}|{_DOT}|@|\.)\s{{0,3}}[\])}}>]")
_SPOKEN_HINT = re.compile(rf"(?:\s(?:{_AT})\s|@){_LABEL}\s(?:{_DOT})\s|(?:[0-9]|{_WORD})\s(?:{_DOT})\s(?:{_WORD}|[0-9])")
# It begins with letters, which the regex engine looks for at once.
_SPELLED_HINT = re.compile(rf"(?:{_WORD})[\s,.-]{{1,2}}(?:{_WORD}|[0-9])[\s,.-]{{1,2}}(?:{_WORD}|[0-9])")


def hinted(text: str) -> bool:
    """True for every text that a rule can rewrite: each test asks for less than its rule, on lower case, whose two odd letters go through."""
    low = text.lower()
    return bool(
        ("&" in low and _ENTITY.search(low))
        or ("@" in low and re.search(r"\s@\s", low))
        or (("(" in low or "[" in low or "<" in low or "{" in low) and _BRACKETED.search(low))
        or (any([w in low for w in _DOTS]) and _SPOKEN_HINT.search(low))
        or _SPELLED_HINT.search(low)
        or (not text.isascii() and ("\u0130" in text or "\u0131" in text))
    )


_PLAIN_PART = re.compile(rf"(\s(?:{_AT}|{_DOT})\s)", re.IGNORECASE)
_SPELLED_PART = re.compile(rf"{_PLUS}|{_WORD}|{_DOT}|[0-9]", re.IGNORECASE)
_SIGNS = {w: "@" for w in _AT.split("|")} | {w: "." for w in _DOT.split("|")} | {w: "+" for w in _PLUS.split("|")}


class Rewritten:
    """A text with, for each rewritten stretch, its source."""

    def __init__(self):
        self.parts: list[str] = []
        self.length = 0
        self.starts: list[int] = []  # of stretches in the rewritten text
        self.sources: list[tuple[int, int, bool]] = []  # their source start and end, and whether rewritten

    def add(self, s: str, start: int, end: int, changed: bool) -> None:
        if s:
            self.parts.append(s)
            self.starts.append(self.length)
            self.sources.append((start, end, changed))
            self.length += len(s)

    @property
    def text(self) -> str:
        return "".join(self.parts)

    def source(self, start: int, end: int) -> tuple[int, int, bool]:
        """Source start and end of a span, and whether any of it was rewritten."""
        i, j = bisect_right(self.starts, start) - 1, bisect_right(self.starts, end - 1) - 1
        a, _, changed = self.sources[i]
        b, last, _ = self.sources[j]
        begin = a if changed else a + start - self.starts[i]
        stop = last if self.sources[j][2] else b + end - self.starts[j]
        # hidden characters leave no stretch of their own, but the source is longer by them
        return begin, stop, stop - begin != end - start or any(self.sources[k][2] for k in range(i, j + 1))


def unlike(text: str) -> Rewritten:
    """First transducer: characters drawn like others, compatibility forms, digits of other scripts, hidden characters."""
    out, done = Rewritten(), 0
    for m in _ODD.finditer(text):
        for i in range(*m.span()):
            if (new := _alike(text[i])) != text[i]:
                out.add(text[done:i], done, i, False)
                out.add(new, i, i + 1, True)
                done = i + 1
    out.add(text[done:], done, len(text), False)
    return out


def unspell(text: str) -> Rewritten:
    """Second transducer: at and dot disguises, spelled digits."""
    out, done = Rewritten(), 0
    for m in _RULES.finditer(text):
        out.add(text[done : m.start()], done, m.start(), False)
        done, at = m.end(), m.start()
        if m["at"] or m["dot"]:
            out.add("@" if m["at"] else ".", *m.span(), True)
        elif m["plain"]:
            for part in _PLAIN_PART.split(m[0]):
                sign = _SIGNS.get(part.strip().lower()) if part[:1].isspace() else None
                out.add(sign or part, at, at + len(part), bool(sign))
                at += len(part)
        else:
            for x in _SPELLED_PART.finditer(m[0]):
                word = x[0].lower()
                out.add(_SIGNS.get(word) or _SPELLED.get(word, word), at + x.start(), at + x.end(), True)
    out.add(text[done:], done, len(text), False)
    return out


def disguised(text: str, base: list[Span]) -> list[Span]:
    """Spans that only the rewritten text shows."""
    odd = not text.isascii() and _ODD.search(text) is not None
    if not odd and not hinted(text):
        return []
    first = unlike(text) if odd else None
    middle = first.text if first else text
    second = unspell(middle)
    clear, found = second.text, []
    covered = {kind: Covered((a, b) for a, b, k in base if k == kind) for kind in KINDS}
    for start, end, kind in plain(clear):
        a, b, changed = second.source(start, end)
        if first:
            a, b, touched = first.source(a, b)
            changed |= touched
        if not changed or covered[kind].meets(a, b):
            continue
        if kind == "email" and not re.search(r"\.[A-Za-z]{2,24}$", clear[start:end].rstrip("-")):
            continue
        found.append((a, b, kind))
    return found


def find(text: str) -> tuple[list[Span], list[Span]]:
    """(plain spans, all spans)."""
    base = plain(text)
    more = disguised(text, base)
    return base, ordered(base + more) if more else base


def show(spans) -> str:
    return ",".join([f"{k}:{a}:{b}" for a, b, k in spans])


def mask(text: str, spans) -> str:
    """The text with every span, and what overlapping spans cover together, replaced by the kind of the first."""
    if not spans:
        return text
    out, done = [], 0
    merged: list[list] = []
    for a, b, k in spans:
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b, k])
    for a, b, k in merged:
        out += [text[done:a], f"[{k.upper()}]"]
        done = b
    return "".join(out) + text[done:]


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added): counts and digest are of the plain spans, spans are all, n_added those that only the rewriting found."""

    def start():
        def run(texts):
            made = []
            for text in texts:
                base, spans = find(text)
                kinds = [k for _, _, k in base]
                made.append((*map(kinds.count, KINDS), hashlib.sha256(show(base).encode()).hexdigest(), show(spans), len(spans) - len(base)))
            return made

        return run

    kept = docs.select(named(id_col), named(text_col).alias("text"))
    return map_texts(kept, "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long", start)


def masked(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs, with the spans of every text masked.  A null text stays null."""
    at = docs.columns.index(text_col)

    def start():
        return lambda texts: [(mask(t, find(t)[1]),) for t in texts]

    rows = numbered(docs).withColumn("text", F.col(f"_{at}")).withColumn(f"_{at}", F.col(f"_{at}").isNull())
    out = map_texts(rows, "masked string", start)
    return out.select(*[F.when(~F.col(f"_{i}"), F.col("masked")) if i == at else F.col(f"_{i}") for i in range(len(docs.columns))]).toDF(*docs.columns)
