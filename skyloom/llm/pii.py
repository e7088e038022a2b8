"""Personal data, plain and disguised, with spans in the code points of the source text.

Plain identifiers are found as they stand. Disguised ones are found in a text rewritten by a chain of three
transducers: look-alike characters, spelled digits, and spelled or bracketed "at" and "dot". Each transducer
emits, with every character, the source characters that it stands for, so a span of the rewritten text maps back
to the source. Such a span is added unless it overlaps a plain one of its kind.
"""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Callable

from pyspark.sql import DataFrame

from .common import change_texts, map_texts

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

Span = tuple[str, int, int]


def emails(text: str) -> list[Span]:
    """From each @ back over the local part and on over the domain: linear, whatever the words' lengths."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        head = text[free:at]
        start = free + len(head.rstrip(_LOCAL))
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append(("email", start, found.end()))
        free = found.end() if found else at + 1
        at = text.find("@", free)
    return out


def ips(text: str) -> list[Span]:
    small = lambda x: len(x) <= 3 and int(x or 0) <= 255
    return [("ip", *m.span()) for m in _IP.finditer(text) if all(small(p.lstrip("0")) for p in m[0].split("."))]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def cards(text: str) -> list[Span]:
    out = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    return out


def phones(text: str) -> list[Span]:
    return [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15] if "+" in text else []


def plain(text: str) -> list[Span]:
    return emails(text) + ips(text) + cards(text) + phones(text)


#: Letters of other scripts that look like Latin ones.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "。": ".", "․": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", " ": " ", " ": " ", " ": " ", "　": " ",
}
#: Characters without width, which the first transducer drops.
UNSEEN = "­​‌‍⁠﻿"
#: Spelled digits.
DIGITS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}


#: Top-level labels that make a spaced or spelled address sure.
TOP = "com|org|net|edu|gov|int|mil|info|biz|io|dev|app|ai|co|uk|us|ca|au|nz|ie|in|eu|de|at|ch|fr|be|nl|es|pt|it|pl|se|no|fi|dk|cz|ru|jp|cn|kr|br|mx|ar"


def look(c: str) -> str:
    """What a character looks like: itself, an ASCII character, or nothing."""
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    if c in UNSEEN:
        return ""
    if "！" <= c <= "～":
        return chr(ord(c) - 0xFEE0)
    if c > "\x7f" and (d := unicodedata.digit(c, None)) is not None and unicodedata.category(c) != "No":
        return str(d)
    if "\U0001d400" <= c <= "\U0001d7ff":
        return unicodedata.normalize("NFKC", c)
    return c


class _Looks(dict):
    """look() by code point, one character for one, remembered; characters without width stay for the next step."""

    def __missing__(self, code: int) -> str:
        new = look(chr(code))
        self[code] = new = new if len(new) == 1 else chr(code)
        return new


_LOOKS = _Looks()


class Tape:
    """A text, and where its characters come from in the text before it.

    Only places that change a text's length are kept: for each, its start and end here and there. All else has the
    distance from the place before it, so a tape is no larger than what was rewritten.
    """

    def __init__(self, text: str, before: Tape | None = None, places: list[tuple[int, int, int, int]] = ()):
        self.text, self.before, self.places = text, before, places

    def source(self, start: int, end: int) -> tuple[int, int]:
        """The span of the source text that a span of this one stands for."""
        if self.before is None:
            return start, end
        return self.before.source(self._there(start)[0], self._there(end - 1)[1])

    def _there(self, i: int) -> tuple[int, int]:
        k = bisect_right(self.places, (i, math.inf)) - 1  # the last place that starts at i or before
        if k < 0:
            return i, i + 1
        start, end, a, b = self.places[k]
        return (a, b) if i < end else (b + i - end, b + i - end + 1)

    def rewritten(self, pattern: re.Pattern, to: Callable[[re.Match], str]) -> Tape:
        """Each match becomes ``to(match)``; every character of that stands for the whole match."""
        text, places, done, shift = [], [], 0, 0
        for m in pattern.finditer(self.text):
            new = to(m)
            a, b = m.span()
            if new == m[0] or a == b:
                continue
            text += [self.text[done:a], new]
            if b - a > 1 or len(new) != 1:
                places.append((a + shift, a + shift + len(new), a, b))
            shift += len(new) - (b - a)
            done = b
        return Tape("".join([*text, self.text[done:]]), self, places) if text else self


_UNSEEN = re.compile(f"[{UNSEEN}]")
_SPELLED = "(?:" + "|".join(DIGITS) + ")"
_SPELLED_RUN = re.compile(rf"(?<![A-Za-z])(?:{_SPELLED}|[0-9])(?:(?:[ ,-]{{1,2}}|[ ](?:dot|point)[ ])(?:{_SPELLED}|[0-9])){{2,}}(?![A-Za-z])", re.I)
_PLUS = re.compile(r"(?<![A-Za-z])plus[ ]+(?=[0-9])", re.I)
_BRACKETED = re.compile(r"[ ]?[(\[{<][ ]?(at|dot|@|\.)[ ]?[)\]}>][ ]?", re.I)
_LABEL, _NAME = "[A-Za-z0-9-]{1,63}", "[A-Za-z0-9_%+-]{1,64}"
#: Addresses whose signs are spelled or stand apart. Each form holds something that plain prose lacks: a spelled dot, a
#: name with a dot, digit or underscore before a known top-level label, or signs with a space on either side.
_ADDRESSES = (
    re.compile(rf"(?<![A-Za-z0-9._%+-]){_NAME}(?:(?: dot |\.){_NAME})? at {_LABEL}(?:(?: dot |\.){_LABEL}){{0,3}} dot [A-Za-z]{{2,24}}(?![A-Za-z0-9-])", re.I),
    re.compile(rf"(?<![A-Za-z0-9._%+-])(?=[A-Za-z0-9_%+-]{{0,64}}[A-Za-z])(?:{_NAME}\.{_NAME}|{_NAME}[0-9_+]|{_NAME}[0-9_+]{_NAME}) at {_LABEL}(?:\.{_LABEL}){{0,3}}\.(?:{TOP})(?![A-Za-z0-9-])", re.I),
    re.compile(rf"(?<![A-Za-z0-9._%+-]){_NAME}(?:(?: \. |\.){_NAME})? ?@ ?{_LABEL}(?:(?: \. |\.){_LABEL}){{0,3}}(?: \. |\.)(?:{TOP})(?![A-Za-z0-9-])", re.I),
    re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9+-]{{1,64}}(?:[._][A-Za-z0-9+-]{{1,64}}){{0,4}}_at_{_LABEL}(?:_dot_{_LABEL}){{0,3}}_dot_[A-Za-z]{{2,24}}(?![A-Za-z0-9-])", re.I),
)
_DOTTED_NUMBERS = re.compile(r"(?<![0-9.])[0-9]{1,3}(?: ?(?:dot|point) ?[0-9]{1,3}){3}(?![0-9])", re.I)
_SIGN = re.compile(r" (at|dot|@|\.) | ?(@) ?|_(at|dot)_", re.I)
_SPACED_DOT = re.compile(r" ?(dot|point) ?", re.I)
_HINT = re.compile(r"[(\[{<] ?(?:at|dot|@|\.) ?[)\]}>]", re.I)
_SIGNS = {"at": "@", "@": "@", "dot": ".", ".": "."}


def _inside(tape: Tape, region: re.Pattern, pattern: re.Pattern, to: Callable[[re.Match], str]) -> Tape:
    """Rewrite only inside the matches of ``region``."""
    spans = [m.span() for m in region.finditer(tape.text)]
    if not spans:
        return tape
    at = {m.start() for a, b in spans for m in pattern.finditer(tape.text, a, b)}
    return tape.rewritten(pattern, lambda m: to(m) if m.start() in at else m[0])


def digits_of(m: re.Match) -> str:
    found = m[0].lower()
    spoken = DIGITS | {"dot": ".", "point": "."}
    return "".join(spoken.get(w, w) for w in re.split(r"[ ,-]+", found)) if any(w in found for w in DIGITS) else m[0]


def undisguised(text: str) -> Tape:
    """The three transducers, one after the other; each runs only where its marks are seen."""
    tape = Tape(text)
    if not text.isascii():
        seen = text.translate(_LOOKS)
        tape = tape if seen == text else Tape(seen, tape)
        tape = tape.rewritten(_UNSEEN, lambda m: "")
    low = tape.text.lower()
    if sum(low.count(w) for w in DIGITS if w in low) >= 3:
        tape = tape.rewritten(_SPELLED_RUN, digits_of)
        tape = tape.rewritten(_PLUS, lambda m: "+")
    spelled = "dot" in low or "point" in low
    if spelled or _HINT.search(low):
        tape = tape.rewritten(_BRACKETED, lambda m: _SIGNS[m[1].lower()])
        tape = _inside(tape, _DOTTED_NUMBERS, _SPACED_DOT, lambda m: ".")
    for form, marked in zip(_ADDRESSES, (" at " in low and " dot " in low, " at " in low, "@ " in low or " @" in low or " . " in low and "@" in low, "_at_" in low)):
        if marked:
            tape = _inside(tape, form, _SIGN, lambda m: _SIGNS[(m[1] or m[2] or m[3]).lower()])
    return tape


def disguised(text: str, base: list[Span]) -> list[Span]:
    """What the rewritten text holds and the text itself doesn't show, without what overlaps a base span of its kind."""
    tape = undisguised(text)
    if tape.text == text:
        return []
    starts: dict[str, list[int]] = {k: [] for k in KINDS}
    ends: dict[str, list[int]] = {k: [] for k in KINDS}
    for kind, a, b in base:  # those of a kind don't overlap and come in order
        starts[kind].append(a)
        ends[kind].append(b)
    out = []
    for kind, a, b in plain(tape.text):
        start, end = tape.source(a, b)
        before = bisect_left(starts[kind], end) - 1  # the last base span that begins before this one ends
        if text[start:end] != tape.text[a:b] and not (before >= 0 and ends[kind][before] > start):
            out.append((kind, start, end))
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2])))


def scan(text: str) -> tuple[list[Span], list[Span]]:
    base = plain(text)
    return base, disguised(text, base)


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, found): one row for each row of docs.

    The counts and the digest are those of the plain spans; ``spans`` holds all, and ``found`` says whether there are
    any. Null and empty texts have none. Repeated rows give repeated results; ids may be null.
    """

    def f(ids, texts):
        found = [scan(t) for t in texts]
        return (
            ids, *([sum(k == kind for k, _, _ in b) for b, _ in found] for kind in KINDS),
            [hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in found], [joined(b + m) for b, m in found], [len(m) for _, m in found], [bool(b or m) for b, m in found],
        )

    kinds = "".join(f"n_{k} long, " for k in KINDS)
    return map_texts(docs, lambda: f, f"doc_id long, {kinds}base_sha256 string, spans string, n_added long, found boolean")


def redacted(text: str) -> str:
    """Every span, merged where spans overlap, becomes its kind in angle brackets."""
    base, more = scan(text)
    out, done = [], 0
    for kind, a, b in sorted(base + more, key=lambda x: (x[1], -x[2], KINDS.index(x[0]))):
        if a >= done:
            out += [text[done:a], f"<{kind}>"]
        done = max(done, b)
    return "".join([*out, text[done:]]) if out else text


def redact(docs: DataFrame) -> DataFrame:
    """The same rows and columns, with identifiers in ``text`` replaced; a null text becomes an empty one."""
    return change_texts(docs, redacted)
