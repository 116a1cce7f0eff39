"""Personal data: fixed patterns, and the same patterns behind an offset-preserving deobfuscation.

A transducer rewrites homoglyphs, digits in words and at/dot disguises, and keeps for each rewritten piece the source
characters it came from. Identifiers found in the rewritten text are mapped back to spans of the source.
"""

from __future__ import annotations

import re
import string
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame

from ._scan import Block, Found, byte_class, scan

BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, *(f"hidden_{k}" for k in BASE)]

EMAIL = re.compile(rb"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: As the contract's pattern, whose leftmost match always starts a group of digits; each byte is read a few times at most.
IP = re.compile(rb"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(rb"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = byte_class(string.ascii_letters + string.digits + "._%+-")
DIGIT_DOT, DIGIT_GAP = byte_class(string.digits + "."), byte_class(string.digits + " -")

# Letters that look like an ASCII letter.
HOMOGLYPHS = dict(zip("аеорсхуіѕјԁһӏԛԝАВЕКМНОРСТХУІЅЈοαιντυρΑΒΕΖΗΙΚΜΝΟΡΤΥΧıɡ", "aeopcxyisjdhlqwABEKMHOPCTXYISJoaivtupABEZHIKMNOPTYXig", strict=True))
# The digits' names in English, German, French and Spanish.
DIGIT_WORDS = {
    word: str(digit)
    for digit, words in enumerate(["zero oh null zéro cero", "one eins un uno", "two zwei deux dos", "three drei trois tres", "four vier quatre cuatro", "five fünf cinq cinco", "six sechs seis", "seven sieben sept siete", "eight acht huit ocho", "nine neun neuf nueve"])
    for word in words.split()
}
LEAST_SPELLED = 7
# Characters without width, which split an identifier unseen.
UNSEEN = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
_WORD = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_LOOKALIKE = re.escape("".join(HOMOGLYPHS))
#: White space in front is looked for from its first character on and never given back, so that long gaps cost once.
RULES = re.compile(
    rf"""(?P<at>(?<!\s)\s*+[(\[{{<]\s*+(?:at|ät|arroba|@)\s*+[)\]}}>]\s*+)
    |(?P<plain_at>(?<=[\w%+-])\s++(?:at|arroba)\s++(?=[\w-]++(?:\s*+[(\[{{]\s*+(?:dot|punkt|punto|point|\.)\s*+[)\]}}]\s*+|\s++(?:dot|punkt|punto)\s++)\w))
    |(?P<dot>(?<!\s)\s*+[(\[{{<]\s*+(?:dot|punkt|punto|point|\.)\s*+[)\]}}>]\s*+)
    |(?P<plain_dot>(?<=\w)\s++(?:dot|punkt|punto)\s++(?=\w))
    |(?P<digits>(?<!\w)(?:(?:plus|\+)[\s,.-]*+)?(?:{_WORD})(?:[\s,.-]++(?:{_WORD})(?!\w)){{{LEAST_SPELLED - 1},}}+)
    |(?P<glyph>(?-i:[{_LOOKALIKE}！-～]|(?![0-9])\d|[{UNSEEN}]))""",
    re.I | re.X,
)
_PART = re.compile(rf"(?:plus|\+)|{_WORD}", re.I)
# Characters beside a letter's own two cases that match it where case is ignored.
OTHER_CASE = "\u0130\u0131\u017f\u212a"
_FOLDED = str.maketrans(OTHER_CASE, "iisk")
#: The rules' white space and separators as bytes; any byte of a longer character counts.
_GAP = np.array([b >= 128 or chr(b).isspace() for b in range(256)])
_BETWEEN = _GAP | byte_class(",.-")
_SPACE = rb"[\s\x1c-\x1f\x80-\xff]*"
_BRACKETED = re.compile(rb"[(\[{<]" + _SPACE + "(?:at|ät|Ät|arroba|@|dot|punkt|punto|point|\\.)".encode() + _SPACE + rb"[)\]}>]")
_PLAIN_DOTS = (b"dot", b"punkt", b"punto")
#: The digits' names in lower case, where bytes have one.
_DIGIT_BYTES = sorted({x.encode().lower() for w in DIGIT_WORDS for x in (w, w.upper())})
#: First bytes of the characters that the glyph rule can rewrite: Greek, Cyrillic and other scripts' digits, full width.
_LEADS = np.array([b in (0xC4, 0xC9) or 0xCE <= b <= 0xD4 or b >= 0xD9 and b != 0xE2 for b in range(256)])


def luhn(digits: bytes) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        d -= 48
        total += d if k % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _within(block: Block, pattern: re.Pattern[bytes], runs: list[tuple[int, int]]):
    """Matches inside runs of a class that holds every character of the pattern: none can cross a run's end."""
    for a, b in runs:
        yield from pattern.finditer(block.data, a, b)


def base_spans(block: Block) -> Found:
    out: Found = []
    end = 0
    for at in block.finds(b"@"):
        start = at
        while start > end and LOCAL[block.data[start - 1]]:
            start -= 1
        if start < at and (m := EMAIL.match(block.data, start)):
            out.append(("email", *m.span()))
            end = m.end()
    for m in _within(block, IP, block.runs(DIGIT_DOT, 7)):
        if all(len(p.lstrip(b"0")) <= 3 and int(p.lstrip(b"0") or b"0") <= 255 for p in m[0].split(b".")):
            out.append(("ip", *m.span()))
    for m in _within(block, CARD, block.runs(DIGIT_GAP, 16)):
        digits = m[0].translate(None, b" -")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in block.matches(PHONE, block.finds(b"+")):
        if 8 <= sum(48 <= c <= 57 for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return out


def _glyph(char: str) -> str:
    if char in HOMOGLYPHS:
        return HOMOGLYPHS[char]
    if char in UNSEEN:
        return ""
    if 0xFF01 <= ord(char) <= 0xFF5E:
        return chr(ord(char) - 0xFEE0)
    return str(unicodedata.digit(char, "")) or char


def normalised(text: str) -> tuple[str, list[tuple[int, int, int, int]]]:
    """The rewritten text, and its rewritten pieces as (start, end, source start, source end)."""
    out, pieces, at, size = [], [], 0, 0

    def put(new: str, a: int, b: int) -> None:
        nonlocal size
        pieces.append((size, size + len(new), a, b))
        out.append(new)
        size += len(new)

    for m in RULES.finditer(text):
        out.append(text[at : m.start()])
        size += m.start() - at
        at = m.end()
        if m.lastgroup == "digits":
            for p in _PART.finditer(text, *m.span()):
                name = p[0].translate(_FOLDED).lower()
                put("+" if name in ("plus", "+") else DIGIT_WORDS[name], *p.span())
        else:
            put({"at": "@", "plain_at": "@", "dot": ".", "plain_dot": "."}.get(m.lastgroup) or _glyph(m[0]), *m.span())
    out.append(text[at:])
    return "".join(out), pieces


def to_source(pieces: list[tuple[int, int, int, int]], starts: list[int], start: int, end: int) -> tuple[int, int] | None:
    """The source characters behind a span of the rewritten text; None if none of it was rewritten.

    ``starts`` holds the pieces' places in the rewritten text, once for all spans.
    """

    def place(at: int, last: bool) -> int:
        k = bisect_right(starts, at) - 1
        if k < 0:
            return at
        a, b, x, y = pieces[k]
        if at < b:
            return y - 1 if last else x
        return y + at - b

    k = bisect_right(starts, end - 1) - 1
    if k < 0 or pieces[k][1] <= start:
        return None
    return place(start, False), place(end - 1, True) + 1


def disguised_rows(block: Block) -> set[int]:
    """All rows where a rule of the transducer can fire, and few others.

    Each test holds wherever its rule does, bytes of 0x80 and above being taken for white space or a letter at need: an at
    or dot between brackets; a dot's word between white space (a plain at is followed by one of the two); digits' names
    with nothing but separators between; the characters that the glyph rule rewrites, or that match a letter in other case.
    """
    lower = block.data.lower()
    hits = [m.start() for m in _BRACKETED.finditer(lower)]
    for word in _PLAIN_DOTS:
        hits += [k for k in block.finds(word, lower) if k and _GAP[lower[k - 1]] and _GAP[lower[k + len(word)]]]
    hits += [k for char in UNSEEN + OTHER_CASE for k in block.finds(char.encode())]
    hits += np.flatnonzero(_LEADS[block.bytes]).tolist()
    words = sorted((k, k + len(w)) for w in _DIGIT_BYTES for k in block.finds(w, lower))
    if len(words) >= LEAST_SPELLED:
        start, end = (np.array([x[k] for x in words]) for k in (0, 1))
        # names can lie in each other (un, uno, neun), so the gap counts from the farthest end so far
        letters = np.concatenate([[0], np.cumsum(~_BETWEEN[block.bytes])])
        reach = np.minimum(np.maximum.accumulate(end)[:-1], start[1:])
        close = (letters[start[1:]] == letters[reach]).astype(np.int64)
        total = np.concatenate([[0], np.cumsum(close)])
        need = LEAST_SPELLED - 1
        hits += start[np.flatnonzero(total[need:] - total[:-need] >= need)].tolist()
    return set(block.rows(hits).tolist()) if hits else set()


def spelled_numbers(text: str) -> Iterator[tuple[int, int]]:
    """Stretches of 8 to 15 digits in words: telephone numbers, with or without a plus."""
    for m in RULES.finditer(text):
        if m.lastgroup == "digits" and 8 <= sum(p[0].translate(_FOLDED).lower() not in ("plus", "+") for p in _PART.finditer(m[0])) <= 15:
            yield m.span()


def hidden_spans(block: Block) -> Found:
    """Identifiers behind a disguise; a spelled number that no other identifier holds is a telephone number."""
    out: Found = []
    for row in disguised_rows(block):
        source = block.texts[row].decode("utf-8", "replace")
        text, pieces = normalised(source)
        if not pieces:
            continue
        other, spans, starts = Block([text.encode()]), [], [p[0] for p in pieces]
        found = base_spans(other)
        edges = other.points(np.array([x[1:] for x in found], np.int64).reshape(-1, 2), np.zeros((len(found), 1), np.int64)).tolist()
        for (kind, _, _), (a, b) in zip(found, edges, strict=True):
            if place := to_source(pieces, starts, a, b):
                spans.append((f"hidden_{kind}", *place))
        held = sorted((a, b) for _, a, b in spans)
        reach = list(accumulate((b for _, b in held), max))
        for start, end in spelled_numbers(source):
            k = bisect_right(held, end - 1, key=lambda x: x[0])
            if not k or reach[k - 1] <= start:
                spans.append(("hidden_phone", start, end))
        if spans:  # code points to bytes
            data = source.encode()
            at = np.append(np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80), len(data)) + int(block.starts[row])
            out += [(kind, int(at[a]), int(at[b])) for kind, a, b in spans]
    return out


def uncovered(hidden: Found, base: Found) -> Found:
    """The hidden spans but those that a base span of the same kind covers wholly."""
    by_kind = {f"hidden_{k}": sorted((a, b) for kind, a, b in base if kind == k) for k in BASE}
    out = []
    for kind, a, b in hidden:
        k = bisect_right(by_kind[kind], a, key=lambda x: x[0])
        if not k or by_kind[kind][k - 1][1] < b:
            out.append((kind, a, b))
    return out


def find_pii(docs: DataFrame, keep: list[str] | None = None, text_col: str = "text", out_col: str = "found") -> DataFrame:
    """The ``keep`` columns of docs (default: all) and ``out_col``: spans (kind, start, end) in code points, by start.

    Base kinds stand as their patterns find them, leftmost and non-overlapping per kind; identifiers behind a disguise are
    added as ``hidden_`` kinds, beside base spans that hold a part of them, unless one of their kind holds them whole. Null and empty texts have none. Only the text is looked
    at, whole.
    """

    def find(block: Block) -> Found:
        base = base_spans(block)
        return base + uncovered(hidden_spans(block), base)

    return scan(docs, find, docs.columns if keep is None else keep, text_col, out_col)
