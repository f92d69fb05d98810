"""Personal data with exact source offsets, in plain and in disguised form."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts

KINDS = ("email", "ip", "card", "phone")
FOUND = T.StructType([T.StructField(f"n_{k}", T.LongType()) for k in KINDS] + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_spans", T.LongType())])

Span = tuple[int, int, str]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")  # no later start in a run of digits does better
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def is_card(digits: str) -> bool:
    return 12 <= len(digits) <= 19 and luhn(digits)


def emails(text: str) -> list[Span]:
    """Each at-sign with the longest run of local characters before it and a dotted name after it."""
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found.append((start, m.end(), "email"))
            done = m.end()
        at = text.find("@", at + 1)
    return found


def base_spans(text: str) -> list[Span]:
    """The plain identifiers, leftmost and non-overlapping within each kind."""
    found = emails(text)
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m[0].split("."))):
            found.append((m.start(), m.end(), "ip"))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and is_card(_NOT_DIGIT.sub("", m[0])):
            found.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                found.append((m.start(), m.end(), "phone"))
    return found


#: Letters of other scripts that look like Latin ones, and marks that stand for ASCII ones.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ѡ": "w", "ѵ": "v",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "У": "Y", "Х": "X", "З": "3",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ϲ": "c",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "―": "-", "−": "-", "․": ".", "。": ".", " ": " ", " ": " ", " ": " ",
}
#: Characters without width.
INVISIBLE = "­​‌‍‎‏⁠﻿"
#: Spelled digits.
SPELLED = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
#: Letters that stand for digits between digits.
DIGIT_LIKE = {"O": "0", "o": "0", "I": "1", "l": "1", "|": "1"}

#: Dashes and narrow spaces are common in clean texts, and a reason to look closer only between digits.
_PARTED = re.compile(r"[0-9)][\x20.-]*[" + "".join(c for c in LOOKALIKES if not c.isalpha()) + r"]+[\x20.(-]*[0-9]")
_STRANGE = re.compile("[" + INVISIBLE + "".join(c for c in LOOKALIKES if c.isalpha()) + "․。！-～٠-٩۰-۹०-९\U0001d400-\U0001d7ff]")
_FOREIGN = re.compile("[" + INVISIBLE + "".join(LOOKALIKES) + "！-～٠-٩۰-۹०-९\U0001d400-\U0001d7ff]")
_AT = r"(?:[(\[{<]\s*(?:at|@)\s*[)\]}>])"
_DOT = r"(?:[(\[{<]\s*(?:dot|\.)\s*[)\]}>])"
_MARKED = re.compile(rf"(?i){_AT}|{_DOT}")
#: A name's characters, and what may follow a sign. Bare words count only in the whole shape: name at name dot name. A
#: spaced sign needs a dot that is spaced alike or not at all. The search starts at the sign and looks outward, so that a
#: long run of names is read once and not from each of its places.
_NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_%+-")
_SIGN = re.compile(r"(?i)(?<=\s)at(?=\s)|@")
_HOST = r"[A-Za-z0-9-]++"
_AFTER_AT = re.compile(rf"(?i)\s++{_HOST}(?:(?:\s++dot\s++|\.){_HOST})*?\s++dot\s++[A-Za-z]{{2,24}}\b(?:(?:\s++dot\s++|\.)[A-Za-z]{{2,24}}\b)*")
_AFTER_SIGN = re.compile(rf"(?i)\s*+{_HOST}(?:(?:\s++dot\s++|\s++\.\s++|\.){_HOST})+")
_SAID_AT = re.compile(r"(?i)(?<!\s)\s++at\s++|(?<!\s)\s*+@\s*+")
_SAID_DOT = re.compile(r"(?i)(?<!\s)\s++dot\s++|(?<!\s)\s++\.\s++")
_DIGIT_WORD = "(?:" + "|".join(SPELLED) + ")"
_SPELT = re.compile(rf"(?i)(?:\bplus\b[\s,-]*|\+\s*)?(?:\b{_DIGIT_WORD}\b|(?<![0-9])[0-9]++)(?:(?:[\s,-]+(?:dot|point)[\s,-]+|\s*\.\s*|[\s,-]+)(?:{_DIGIT_WORD}\b|[0-9]+))+")
_SPELT_HINT = re.compile(rf"(?i)\b{_DIGIT_WORD}[\s,.-]+(?:(?:dot|point)[\s,-]+)?(?:{_DIGIT_WORD}\b|[0-9])|[0-9][\s,.-]+{_DIGIT_WORD}\b")
_SPELT_PART = re.compile(rf"(?i)\b{_DIGIT_WORD}\b|\bplus\b\s*|\b(?:dot|point)\b|[\s,-]+")
_MIXED = re.compile(r"[0-9][OoIl|]+(?=[0-9])")
_AT_HINT = re.compile(r"(?i)[(\[{<]\s*(?:at|dot|@|\.)\s*[)\]}>]|\bdot\b|\s@|@\s")


class Traced:
    """A string with, for each of its characters, where its source begins and ends."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.begin = list(range(len(text)))
        self.end = list(range(1, len(text) + 1))

    def replace(self, edits: list[tuple[int, int, str]]) -> None:
        """Puts strings in place of stretches (in order, apart from each other)."""
        if not edits:
            return
        parts, begin, end, at = [], [], [], 0
        for a, b, new in [*edits, (len(self.text), len(self.text), "")]:
            parts += [self.text[at:a], new]
            begin += self.begin[at:a] + [self.begin[a]] * len(new) if a < len(self.begin) else self.begin[at:a]
            end += self.end[at:a] + [self.end[b - 1]] * len(new) if new else self.end[at:a]
            at = b
        self.text, self.begin, self.end = "".join(parts), begin, end


def _plain(c: str) -> str:
    if c in INVISIBLE:
        return ""
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    if (d := unicodedata.digit(c, None)) is not None:
        return str(d)
    n = unicodedata.normalize("NFKC", c)
    return n if len(n) == 1 and n.isascii() else LOOKALIKES.get(n, c)


def _marked(t: Traced) -> None:
    edits, done = [], 0
    for m in _MARKED.finditer(t.text):
        begin, end = _spaces(t.text, m.start(), -1, done), _spaces(t.text, m.end(), 1, len(t.text))
        edits.append((begin, end, "@" if re.search("(?i)at|@", m[0]) else "."))
        done = end
    t.replace(edits)


def _spaces(text: str, at: int, step: int, stop: int) -> int:
    """Where a run of white space ends that begins at ``at`` and goes forward or back, up to ``stop``."""
    while at != stop and text[at if step > 0 else at - 1].isspace():
        at += step
    return at


def _name_before(text: str, end: int, done: int) -> int:
    """Where the longest run of names, parted by dots or the word dot, begins that ends at ``end``; -1 without one."""
    begin, at = -1, end
    while True:
        name = at
        while name > done and text[name - 1] in _NAME:
            name -= 1
        if name == at:
            break
        begin = name
        if name - 1 > done and text[name - 1] == ".":
            at = name - 1
            continue
        word = _spaces(text, name, -1, done)
        space = _spaces(text, word - 3, -1, done) if word - 3 > done and text[word - 3 : word].lower() == "dot" else word - 3
        if word == name or space == word - 3:
            break
        at = space
    while 0 <= begin < end and begin and (text[begin - 1].isalnum() or text[begin - 1] == "_") == (text[begin].isalnum() or text[begin] == "_"):
        begin += 1  # a name begins at the border of a word
    return begin if begin < end else -1


def _said(t: Traced) -> None:
    edits, done, text = [], 0, t.text
    for m in _SIGN.finditer(text):
        if m.start() < done:
            continue
        begin = _name_before(text, _spaces(text, m.start(), -1, done), done)
        after = (_AFTER_SIGN if m[0] == "@" else _AFTER_AT).match(text, m.end()) if begin >= 0 else None
        if after:
            done = after.end()
            for kind, new in ((_SAID_AT, "@"), (_SAID_DOT, ".")):
                edits += [(begin + x.start(), begin + x.end(), new) for x in kind.finditer(text[begin:done]) if x[0] != new]
    t.replace(sorted(edits))


def _spelt(t: Traced) -> None:
    edits = []
    for m in _SPELT.finditer(t.text):
        words = re.findall(rf"(?i)\b{_DIGIT_WORD}\b", m[0])
        digits = "".join(SPELLED.get(x.lower(), x) for x in re.findall(rf"(?i)\b{_DIGIT_WORD}\b|[0-9]", m[0]))
        if not words or len(words) < 4 and not (re.match(r"(?i)\+|plus", m[0]) and 9 <= len(digits) <= 15) and not is_card(digits):
            continue
        dotted = bool(re.search(r"(?i)\b(?:dot|point)\b|[a-z]\s*\.", m[0]))
        for x in _SPELT_PART.finditer(m[0]):
            word = x[0].strip().lower()
            new = SPELLED.get(word) or {"plus": "+", "dot": ".", "point": "."}.get(word, "" if not word.strip(",-") else x[0])
            edits.append((m.start() + x.start(), m.start() + x.end(), new))
        if not dotted and not re.match(r"(?i)\+|plus", m[0]):
            n = sum(1 for _ in words) + len(re.findall("[0-9]", m[0]))
            if 9 <= n <= 15:
                t.phones.append((t.begin[m.start()], t.end[m.end() - 1]))
    t.replace(sorted(edits))


def disguised_spans(text: str, plain: list[Span]) -> list[Span]:
    """Identifiers that show once homoglyphs, spelled digits and at/dot disguises are undone, in source offsets.

    Of these, only those that overlap no plain span of their kind are new. A run of digits that is too long for one
    card is also looked at number by number.
    """
    found: list[Span] = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() > 19 and len(_NOT_DIGIT.sub("", m[0])) > 19:
            for x in re.finditer(r"[0-9]{12,19}(?![0-9])|[0-9]{4}(?:[\x20-][0-9]{4}){3}(?![0-9])", m[0]):
                if is_card(_NOT_DIGIT.sub("", x[0])):
                    found.append((m.start() + x.start(), m.start() + x.end(), "card"))
    strange, parted, hinted, spelt, mixed = (p.search(text) for p in (_STRANGE, _PARTED, _AT_HINT, _SPELT_HINT, _MIXED))
    if strange or parted or hinted or spelt or mixed:
        t = Traced(text)
        t.phones = []
        if strange or parted:
            t.replace([(m.start(), m.end(), _plain(m[0])) for m in _FOREIGN.finditer(text)])
        if strange or mixed:
            t.replace([(m.start(), m.end(), m[0][0] + "".join(DIGIT_LIKE[c] for c in m[0][1:])) for m in _MIXED.finditer(t.text)])
        if strange or hinted:
            _marked(t)
            _said(t)
        if strange or spelt:
            _spelt(t)
        if t.text != text:
            found += [(t.begin[a], t.end[b - 1], k) for a, b, k in base_spans(t.text)]
            cards = _Taken((a, b) for a, b, k in found if k == "card")
            found += [(a, b, "phone") for a, b in t.phones if not cards.meets(a, b)]
    taken = {kind: _Taken((a, b) for a, b, k in plain if k == kind) for kind in KINDS}
    new: list[Span] = []
    for a, b, k in found:
        if not taken[k].meets(a, b):
            taken[k].add(a, b)
            new.append((a, b, k))
    return new


class _Taken:
    """Stretches in order; of those that overlap, only the first is kept."""

    def __init__(self, spans: Iterable[tuple[int, int]]) -> None:
        self.begins: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted(spans):
            if not self.ends or a >= self.ends[-1]:
                self.begins.append(a)
                self.ends.append(b)

    def meets(self, a: int, b: int) -> bool:
        at = bisect_left(self.begins, b)
        return at > 0 and self.ends[at - 1] > a

    def add(self, a: int, b: int) -> None:
        at = bisect_left(self.begins, a)
        self.begins.insert(at, a)
        self.ends.insert(at, b)


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


def find(text: str) -> tuple:
    plain = base_spans(text)
    every = plain + disguised_spans(text, plain)
    counts = [sum(1 for s in plain if s[2] == k) for k in KINDS]
    return *counts, hashlib.sha256(_joined(plain).encode()).hexdigest(), _joined(every), len(every)


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans`` of each document.

    Counts and digest are of the plain identifiers; ``spans`` lists these and the disguised ones as ``kind:start:end``
    in code points, by start and then kind. A null or empty text has none; repeated rows get equal results; texts are
    read whole; an empty table gives no rows; columns other than the two play no part.
    """
    need = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def start() -> Callable[[str], tuple]:
        return find

    return map_texts(need, start, FOUND)
