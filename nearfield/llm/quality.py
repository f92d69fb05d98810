"""Quality rules as a short-circuit cascade ordered by rejections per cost."""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterable
from functools import cached_property
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import filter_texts, map_texts

#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"

BASE = T.StructType([T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())])


class Doc:
    """A text as the rules see it; each figure is computed when a rule first asks for it."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.raw = text.encode()
        self.words = self.raw.split()  # of bytes: splits at \x20 and \x09-\x0D only

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, " \t\n\x0b\x0c\r"))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.raw.split(b"\n") if x and not x.isspace()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        return repeated(self.words)


def repeated(words: list[bytes]) -> int:
    """Words that stand in a window of three words that the text has twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    times, total, covered = Counter(windows), 0, 0
    for i, window in enumerate(windows):
        if times[window] > 1:
            total += i + 3 - max(covered, i)
            covered = i + 3
    return total


class Rule(NamedTuple):
    name: str
    rejects: Callable[[Doc], bool]


def _letters(word: bytes) -> bool:
    return not word.isascii() or word.upper() != word.lower()


#: The contract's own rules. A result with all figures has them at hand; a filter orders them among the others.
BASE_RULES = (
    Rule("few_words", lambda d: len(d.words) < 50),
    Rule("repeats", lambda d: 100 * d.n_repeat_words > 50 * len(d.words)),
)
RULES = (
    Rule("symbols", lambda d: 10 * d.n_symbols > len(d.words)),
    Rule("word_length", lambda d: not 3 * len(d.words) <= d.word_chars <= 10 * len(d.words)),
    Rule("duplicate_lines", lambda d: 2 * d.n_dup_lines > len(d.lines)),
    Rule("capitals", lambda d: 10 * sum(map(d.raw.count, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")) > 3 * d.word_chars),
    Rule("shouting", lambda d: 2 * (d.raw.count(b"!") + d.raw.count(b"?")) > len(d.words)),
    Rule("common_word", lambda d: 4 * max(Counter(d.words).values(), default=0) > len(d.words)),
    Rule("lettered_words", lambda d: 10 * sum(map(_letters, d.words)) < 8 * len(d.words)),
)


class Planned(NamedTuple):
    name: str
    cost: float
    rejected: float


def plan_cascade(texts: Iterable[str], rules: Iterable[Rule] = RULES, figures: bool = True) -> list[Planned]:
    """The rules in the order of rejected share per second, as estimated on sample texts.

    With ``figures`` the base figures are there already, and only texts that pass the base rules count; without, the
    cost of a rule is that of its words' figures too, so each rule is timed on texts of which nothing is known but the words.
    """
    rules, texts = list(rules), list(texts)
    if figures:
        docs = [d for d in map(Doc, texts) if not base_failed(d) and d.word_chars + d.n_symbols + d.n_dup_lines + 1]
    plan = []
    for rule in rules:
        if not figures:
            docs = list(map(Doc, texts))
        began = time.perf_counter()
        rejected = sum(map(rule.rejects, docs))
        cost = (time.perf_counter() - began) / max(1, len(docs))
        plan.append(Planned(rule.name, max(cost, 1e-9), (rejected + 0.5) / (len(docs) + 1)))
    return sorted(plan, key=lambda p: -p.rejected / p.cost)


def base_failed(doc: Doc) -> bool:
    return any(r.rejects(doc) for r in BASE_RULES)


def quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 400, order: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base figures and verdict of each document: ``id_col`` and the columns of ``BASE``.

    A document that passes the base rules goes through the cascade, which stops at the first rule that rejects it.
    The order comes from ``sample_rows`` rows picked by hash (a bound of what reaches the driver, and it only sets
    the speed: the verdict doesn't depend on the order), or is given. Each row is judged by itself, so repeated rows
    get equal results; a null or empty text has no words and fails the base rules; an empty table gives no rows;
    other columns of the input play no part. Texts are judged whole, at any length.
    """
    need = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    cascade = _cascade(need, rules, sample_rows, order, figures=True)

    def start() -> Callable[[str], tuple]:
        def judge(text: str) -> tuple:
            d = Doc(text)
            failed = base_failed(d)
            kept = not failed and not any(rejects(d) for rejects in cascade)
            return len(d.words), d.word_chars, d.n_symbols, d.n_dup_lines, d.n_repeat_words, failed, kept

        return judge

    return map_texts(need, start, BASE)


def _cascade(docs: DataFrame, rules: tuple[Rule, ...], sample_rows: int, order: list[str] | None, figures: bool) -> list[Callable[[Doc], bool]]:
    if order is None:
        sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(8)) == 0).select("text").take(sample_rows)
        order = [p.name for p in plan_cascade((r.text or "" for r in sample), rules, figures)]
    named = {r.name: r for r in rules}
    return [named[n].rejects for n in order]


def keep(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + RULES, sample_rows: int = 400, order: list[str] | None = None) -> DataFrame:
    """The documents, with all their columns, that ``quality`` keeps.

    The base rules take part in the cascade, and a figure is computed only if a rule that is reached needs it. A null
    or empty text has no words and goes; repeated rows fare alike; an empty table gives no rows; texts are judged
    whole; other columns are kept, whatever their names.
    """
    cascade = _cascade(docs, rules, sample_rows, order, figures=False)

    def start() -> Callable[[str], bool]:
        def judge(text: str) -> bool:
            d = Doc(text)
            return not any(rejects(d) for rejects in cascade)

        return judge

    return filter_texts(docs, start)


ORACLE = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
tri AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w),
trig AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM tri),
rep AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM trig),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep WHERE c > 1) GROUP BY doc_id),
top AS (SELECT doc_id, max(c) AS m FROM (SELECT doc_id, x, count(*) AS c FROM (SELECT doc_id, unnest(ws) AS x FROM w) GROUP BY doc_id, x) GROUP BY doc_id),
f AS (
  SELECT w.doc_id, len(ws) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words,
         length(regexp_replace(t, '[^A-Z]', '', 'g')) AS caps, length(regexp_replace(t, '[^!?]', '', 'g')) AS bangs, coalesce(top.m, 0) AS top,
         len(list_filter(ws, lambda x: regexp_matches(x, '[A-Za-z]') OR regexp_matches(x, '[^\x00-\x7F]'))) AS alpha
  FROM w LEFT JOIN cov ON w.doc_id = cov.doc_id LEFT JOIN top ON w.doc_id = top.doc_id),
b AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM f)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, word_chars, n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 3 * n_words OR word_chars > 10 * n_words OR 2 * n_dup_lines > n_lines
            OR 10 * caps > 3 * word_chars OR 2 * bangs > n_words OR 4 * top > n_words OR 10 * alpha < 8 * n_words) AS kept
FROM b
"""
