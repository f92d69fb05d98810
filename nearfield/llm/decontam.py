"""Benchmark decontamination by Wu-Manber search over word blocks."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts, reliable

WINDOW = 13
#: Benchmark bytes that one pass holds in a worker; a larger benchmark is searched in several passes.
PASS_BYTES = 32 << 20
CONTAMINATED = "_nf_n_hit > 0 AND 20 * _nf_n_hit >= _nf_n_words"

_SEPARATORS = bytes(32 if c <= 0x2F or 0x3A <= c <= 0x40 or 0x5B <= c <= 0x60 or 0x7B <= c <= 0x7F else c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))

HITS = T.StructType([T.StructField("_nf_n_words", T.LongType()), T.StructField("_nf_n_hit", T.LongType()), T.StructField("_nf_hits", T.ArrayType(T.LongType())), T.StructField("_nf_items", T.ArrayType(T.StringType()))])


def words_of(text: str) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased."""
    return text.encode().translate(_SEPARATORS).split()


class WuManber:
    """Multi-pattern search; a pattern is a tuple of words, the block is its last one or two words.

    ``shift`` says how far the scan may skip after a block; a block that ends the first ``least`` words of a pattern
    has shift 0 and a bucket of those patterns, each of which is compared word by word.
    """

    def __init__(self, patterns: dict[tuple[bytes, ...], set[str]]) -> None:
        self.owners = patterns
        self.least = min(map(len, patterns))
        self.block = min(2, self.least)
        self.skip = self.least - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], list[tuple[bytes, ...]]] = defaultdict(list)
        for p in patterns:
            for end in range(self.block, self.least + 1):
                b = p[end - self.block : end]
                self.shift[b] = min(self.shift.get(b, self.skip), self.least - end)
            self.buckets[p[self.least - self.block : self.least]].append(p)

    def find(self, words: list[bytes], found: Callable[[int, tuple[bytes, ...]], None]) -> None:
        end, n, block, skip, get = self.least, len(words), self.block, self.skip, self.shift.get
        while end <= n:
            step = get(tuple(words[end - block : end]), skip)
            if step:
                end += step
                continue
            begin = end - self.least
            rest: dict[int, tuple[bytes, ...]] = {}
            for p in self.buckets[tuple(words[end - block : end])]:
                size = len(p)
                if size not in rest:
                    rest[size] = tuple(words[begin : begin + size])
                if rest[size] == p:
                    found(begin, p)
            end += 1


def patterns_of(items: list[tuple[str, str]], window: int = WINDOW) -> list[dict[tuple[bytes, ...], set[str]]]:
    """Windows of the items and who owns them: those of full length, and those of shorter items."""
    full: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
    short: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
    for item, text in items:
        w = words_of(text or "")
        if len(w) >= window:
            for i in range(len(w) - window + 1):
                full[tuple(w[i : i + window])].add(item)
        elif w:
            short[tuple(w)].add(item)
    return [dict(x) for x in (full, short) if x]


def _search(docs: DataFrame, items: list[tuple[str, str]], window: int, keep_text: bool) -> DataFrame:
    """Adds to what earlier passes found (columns ``_nf_hits`` and ``_nf_items``) what these items have."""

    def start() -> Callable[..., tuple]:
        matchers = [WuManber(p) for p in patterns_of(items, window)]

        def search(text: str, hits: list[int] | None, items: list[str] | None) -> tuple:
            words = words_of(text)
            spans = list(zip(hits[::2], hits[1::2])) if hits else []
            owners = set(items or ())
            for m in matchers:

                def found(begin: int, p: tuple[bytes, ...], of: dict = m.owners) -> None:
                    spans.append((begin, begin + len(p)))
                    owners.update(of[p])

                m.find(words, found)
            merged: list[int] = []
            for begin, end in sorted(spans):
                if merged and begin <= merged[-1]:
                    merged[-1] = max(merged[-1], end)
                else:
                    merged += [begin, end]
            return len(words), sum(merged[1::2]) - sum(merged[::2]), merged, sorted(owners)

        return search

    return map_texts(docs, start, HITS, also=("_nf_hits", "_nf_items"), keep_text=keep_text)


def marked(docs: DataFrame, benchmark: DataFrame, window: int, pass_bytes: int, keep_text: bool) -> DataFrame:
    """The rows of ``docs`` with the columns of ``HITS`` added.

    The benchmark's bytes are summed first. Up to ``pass_bytes`` one pass over the documents searches all items, else
    the items are cut into so many hash classes and each class has its pass, which adds to the spans of those before.
    """
    found = docs.select("*", F.lit(None).cast("array<bigint>").alias("_nf_hits"), F.lit(None).cast("array<string>").alias("_nf_items"))
    named = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).distinct()
    passes = max(1, -(-int(named.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // pass_bytes))
    for k in range(passes):
        items = [(r.item_id, r.text) for r in named.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k).collect()]
        if k:  # else the workers of all passes would stand in memory at once
            found = reliable(found.drop("_nf_n_words", "_nf_n_hit"))
        found = _search(found, items, window, keep_text=keep_text or k + 1 < passes)
    return found


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, pass_bytes: int = PASS_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` and the hit word spans of each document.

    ``hit_spans``: begin and end of each run of hit words, flat.

    A null or empty text has no words and no hits, a null or empty item no window; a null item id is written
    ``null``. Repeated document rows get equal results, repeated items count once. Empty tables are fine, texts are
    searched whole, and other columns of the input play no part.
    """
    need = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return marked(need, benchmark, window, pass_bytes, keep_text=False).select(
        "doc_id",
        F.col("_nf_n_words").alias("n_words"),
        F.col("_nf_n_hit").alias("n_hit"),
        F.size("_nf_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_nf_items", ","), 256).alias("items_sha256"),
        F.expr(CONTAMINATED).alias("contaminated"),
        F.col("_nf_hits").alias("hit_spans"),
    )


def keep(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """The documents, with all their columns, that no benchmark item contaminates.

    Null and empty texts have no words and stay; null and empty items match nothing; repeated rows fare alike; empty
    tables are fine; other columns may have any name that doesn't begin with ``_nf_``.
    """
    return marked(docs, benchmark, window, pass_bytes, keep_text=True).where(f"NOT ({CONTAMINATED})").select(*docs.columns)


ORACLE = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
bw AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
win AS (SELECT item, least(13, len(ws)) AS k, unnest(range(1, greatest(len(ws) - 11, 2))) AS i, ws FROM bw WHERE len(ws) > 0),
pat AS (SELECT DISTINCT item, k, array_to_string(ws[i : i + k - 1], ' ') AS g FROM win),
ks AS (SELECT DISTINCT k FROM pat),
dg AS (SELECT doc_id, k, i, array_to_string(ws[i : i + k - 1], ' ') AS g FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM dw, ks WHERE len(ws) >= k)),
m AS (SELECT DISTINCT dg.doc_id, dg.i, dg.k, pat.item FROM dg JOIN pat ON dg.k = pat.k AND dg.g = pat.g),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM dw LEFT JOIN h ON dw.doc_id = h.doc_id LEFT JOIN it ON dw.doc_id = it.doc_id
"""
