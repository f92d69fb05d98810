"""Jaccard join on word n-grams: MinHash banding finds pairs, the full n-gram sets decide."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import forget, map_texts, reliable, settled, small
from .components import components, link_groups, shared_buckets

WORDS = 5
SIMILARITY = 0.8
RECALL = 0.999
MOST_HASHES = 144
#: Bounds of a block of n-gram sets; a task compares two blocks.
BLOCK, BLOCK_GRAMS = 512, 1 << 20
PAIRS_PER_TASK = 1000

SIGNATURE = T.StructType([T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType()), T.StructField("n", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])


def bands_for(similarity: float = SIMILARITY, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """Bands and rows: the most rows for which enough bands to find a pair at ``similarity`` with ``recall`` fit."""
    best = None
    for rows in range(1, most + 1):
        bands = max(1, math.ceil(math.log(1 - recall) / math.log1p(-(similarity**rows)))) if similarity < 1 else 1
        if bands * rows <= most:
            best = bands, rows
    if best is None:
        raise ValueError("no number of bands reaches this recall")
    return best


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingler(words: int = WORDS) -> Callable[[str], np.ndarray]:
    """Function from a text to the sorted set of its word n-grams, as 64-bit hashes; a shorter text is one n-gram."""
    known = _Hashes()

    def shingles(text: str) -> np.ndarray:
        w = text.encode().split()
        if not w:
            return np.empty(0, np.uint64)
        h = np.fromiter(map(known.__getitem__, w), np.uint64, len(w))
        k = min(words, len(w))
        out = np.zeros(len(w) - k + 1, np.uint64)
        for i in range(k):
            out = _mixed(out + h[i : len(w) - k + 1 + i] + np.uint64(0x9E3779B97F4A7C15))
        return np.unique(out)

    return shingles


def _signer(words: int, bands: int, rows: int) -> Callable[[], Callable[[str], tuple]]:
    def start() -> Callable[[str], tuple]:
        shingles = shingler(words)
        rng = np.random.default_rng(20240501)
        factor = rng.integers(1, 1 << 63, bands * rows, dtype=np.uint64) | np.uint64(1)
        shift = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)
        turn = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)

        def sign(text: str) -> tuple:
            s = shingles(text)
            if not len(s):
                return 0, 0, 0, []
            least = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
            for at in range(0, len(s), 512):
                least = np.minimum(least, (s[at : at + 512, None] * factor + shift).min(axis=0))
            keys = turn.copy()
            for column in least.reshape(bands, rows).T:
                keys = _mixed(keys + column)
            whole = s.tobytes()
            k1, k2 = (np.uint64(xxhash.xxh3_64_intdigest(whole, seed)).astype(np.int64) for seed in (0, 1))
            return int(k1), int(k2), len(s), keys.astype(np.int64).tolist()

        return sign

    return start


class Join:
    """The parts of one run: ``signed`` has a row for each document, ``classes`` one for each distinct n-gram set,
    ``sets`` the n-grams of the classes that share a bucket with another, ``groups`` their components."""

    def __init__(self, docs: DataFrame, words: int, similarity: float, recall: float) -> None:
        self.docs, self.words, self.similarity = docs, words, similarity
        bands, rows = bands_for(similarity, recall)
        marked = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
        self.signed = reliable(map_texts(marked, _signer(words, bands, rows), SIGNATURE))
        first = F.min(F.struct("doc_id", "text_hash")).alias("first")
        self.classes = reliable(self.signed.where("n > 0").groupBy("k1", "k2", "n", "bands").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("least_id"), first))
        shared = shared_buckets(self.classes.select(F.explode("bands").alias("bucket"), F.col("k1").alias("node")))
        self.sets = reliable(self._sets(*settled(shared.select("node").distinct())))
        info = self.sets.select("node", F.col("copies").alias("weight"), F.col("n").alias("mark"))
        self.groups, self.n_groups = settled(link_groups(shared, info, self._may, self._verify, self._compare))
        forget(shared)

    def _may(self, a: Column, b: Column) -> Column:
        return F.least(a, b) >= F.lit(self.similarity - 1e-9) * F.greatest(a, b)

    def _sets(self, nodes: DataFrame, n_nodes: int) -> DataFrame:
        """``node, n, copies, grams`` of the classes in ``nodes``; their first documents are read and cut anew."""
        wanted, n = settled(self.classes.select(F.col("k1").alias("node"), "n", "copies", "first").join(small(nodes, n_nodes), "node").select("node", "n", "copies", F.col("first.doc_id").alias("i"), F.col("first.text_hash").alias("h")))
        placed = self.docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).join(small(wanted, n), F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("text_hash") == F.col("h")))
        words = self.words

        def start() -> Callable[[str], tuple]:
            shingles = shingler(words)
            return lambda text: (shingles(text).astype(np.int64),)

        made = map_texts(placed.select("node", "n", "copies", "text"), start, T.StructType([T.StructField("grams", T.ArrayType(T.LongType()))]))
        return made.dropDuplicates(["node"])

    def _verify(self, pairs: DataFrame, n_pairs: int) -> DataFrame:
        tasks = max(1, -(-n_pairs // PAIRS_PER_TASK))
        both = pairs.join(self.sets.select(F.col("node").alias("b"), F.col("grams").alias("y")), "b").repartition(tasks, "a")
        both = both.join(self.sets.select(F.col("node").alias("a"), F.col("grams").alias("x")).repartition(tasks, "a"), "a")
        common = F.size(F.array_intersect("x", "y"))
        return both.where(common >= F.lit(self.similarity - 1e-9) * (F.size("x") + F.size("y") - common)).select("a", "b")

    def _tasks(self, groups: DataFrame) -> DataFrame:
        """Every pair of blocks of each group's members as one bounded run of rows, sorted together.

        A group's members are dealt into blocks of about ``BLOCK`` rows and ``BLOCK_GRAMS`` n-grams; a row goes to its
        block's task with each block.
        """
        members = groups.join(self.sets.select("node", "n", "copies"), "node")
        sizes = members.groupBy("root").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / BLOCK_GRAMS)).cast("long").alias("blocks"))
        dealt, n = settled(members.join(sizes, "root").select("node", "root", "blocks", F.pmod(F.xxhash64("node"), "blocks").alias("own")))
        tasks = self.sets.select("node", "copies", "grams").join(small(dealt, n), "node").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        tasks = tasks.select(F.xxhash64("root", F.least("own", "other"), F.greatest("own", "other")).alias("task"), "root", "own", "other", "node", "copies", "grams")
        return tasks.repartition("task").sortWithinPartitions("task", "root")

    def links(self) -> DataFrame:
        """``node, linked``: how many documents have another n-gram set that is similar enough to the node's.

        All pairs of a component are compared, block against block, and only counts leave a task.
        """
        counted = self._tasks(self.groups).mapInArrow(_kernel(self.similarity, _count), "node bigint, value bigint")
        return counted.groupBy("node").agg(F.sum("value").alias("linked"))

    def _compare(self, large: DataFrame, known: DataFrame) -> DataFrame:
        """Links that join what is linked within large buckets that have rows in common: each task gives a tree over its
        linked rows, not all pairs."""
        met, n = settled(large.select("node", "bucket").distinct())
        together = components(met.select(F.col("node").alias("a"), F.col("bucket").alias("b"))).join(small(met.select("node").distinct(), n), "node")
        return self._tasks(together).mapInArrow(_kernel(self.similarity, _join), "node bigint, value bigint").select(F.col("node").alias("a"), F.col("value").alias("b"))


def _count(near: np.ndarray, rows: list[tuple]) -> list[tuple[int, int]]:
    copies = np.array([r[4] for r in rows])
    return list(zip((r[3] for r in rows), (near @ copies).tolist()))


def _join(near: np.ndarray, rows: list[tuple]) -> list[tuple[int, int]]:
    found, left = [], np.ones(len(rows), bool)
    for i in range(len(rows)):
        if left[i]:
            left[i] = False
            front = [i]
            while front:
                new = np.flatnonzero(near[front].any(axis=0) & left)
                left[new] = False
                found += [(rows[j][3], rows[i][3]) for j in new]
                front = new.tolist()
    return found


def _kernel(similarity: float, of: Callable[[np.ndarray, list[tuple]], list[tuple[int, int]]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Compares the rows of each task with each other (a run of rows holds two blocks of one group)."""

    def similar(grams: list[np.ndarray]) -> np.ndarray:
        sizes = np.array([len(g) for g in grams])
        flat = np.concatenate(grams)
        _, column = np.unique(flat, return_inverse=True)
        row = np.repeat(np.arange(len(grams)), sizes)
        common = np.zeros((len(grams), len(grams)), np.float32)
        order = np.argsort(column, kind="stable")
        column, row = column[order], row[order]
        width = 4096
        for low in range(0, int(column[-1]) + 1, width):
            a, b = np.searchsorted(column, (low, low + width))
            dense = np.zeros((len(grams), width), np.float32)
            dense[row[a:b], column[a:b] - low] = 1
            common += dense @ dense.T
        both = sizes[:, None] + sizes[None, :] - common
        return common >= (similarity - 1e-9) * both

    def finish(rows: list[tuple]) -> list[tuple[int, int]]:
        if len(rows) < 2:
            return []
        near = similar([r[5] for r in rows])
        np.fill_diagonal(near, False)
        own = np.array([r[1] for r in rows])
        other = np.array([r[2] for r in rows])
        if (own != other).any():  # two blocks: those within one block are counted by the block's own task
            near &= own[:, None] != own[None, :]
        return of(near, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        last = None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("task", "root", "own", "other", "node", "copies")]
            grams = batch.column("grams")
            out: list[tuple[int, int]] = []
            for i, (task, root, *x) in enumerate(zip(*columns)):
                if (task, root) != last:
                    out += finish(held)
                    held, last = [], (task, root)
                held.append((root, *x, grams[i].values.to_numpy(zero_copy_only=False)))
            yield _counts(out)
        yield _counts(finish(held))

    return run


def _counts(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)], ["node", "value"])


def jaccard_join(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """``doc_id, class_id, copies, n_links`` of each document.

    ``copies``: documents with the same n-gram set, itself included. ``n_links``: other documents whose set has a
    Jaccard similarity of ``similarity`` or more. ``class_id``: least doc_id of those joined by links, directly or not.
    Words are ``[^\\x20\\x09-\\x0D]+``; a text of fewer than ``words`` words is one n-gram; a null, empty or blank text
    has none, is linked to nothing and is a class alone. Null ids are left out of the least id; repeated rows are
    copies of each other; an empty table gives no rows; other columns play no part.
    """
    j = Join(docs.select("doc_id", "text"), words, similarity, recall)
    classes = j.classes.select("k1", "k2", "copies", "least_id")
    linked = j.links().withColumnRenamed("node", "l_node")
    joined = classes.join(small(j.groups, j.n_groups), F.col("k1") == F.col("node"), "left").join(small(linked, j.n_groups), F.col("k1") == F.col("l_node"), "left")
    least = joined.where("root IS NOT NULL").groupBy("root").agg(F.min("least_id").alias("root_id"))
    made = joined.join(least, "root", "left").select("k1", "k2", "copies", F.when(F.col("root").isNull(), F.col("least_id")).otherwise(F.col("root_id")).alias("class_id"), (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    full = j.signed.where("n > 0").select("doc_id", "k1", "k2").join(made, ["k1", "k2"]).select("doc_id", "class_id", "copies", "n_links")
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    return full.unionByName(j.signed.where("n = 0").select("doc_id", F.col("doc_id").alias("class_id"), one.alias("copies"), zero.alias("n_links")))


def keep(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """The documents without near duplicates: of each linked group the first stays, by doc_id and text digest.

    Texts without words have no links and stay; of rows equal in doc_id and text one stays.
    """
    j = Join(docs.select("doc_id", "text"), words, similarity, recall)
    joined = j.classes.join(small(j.groups, j.n_groups), F.col("k1") == F.col("node"), "left").select("k1", "k2", "copies", "first", "root")
    firsts = joined.where("root IS NOT NULL").groupBy("root").agg(F.min("first").alias("win"))
    winners = joined.join(firsts, "root", "left").where("copies > 1 OR root IS NOT NULL").select("k1", "k2", F.coalesce("win", "first").alias("win"))
    lost = j.signed.where("n > 0").join(winners, ["k1", "k2"]).where(~F.struct("doc_id", "text_hash").eqNullSafe(F.col("win")))
    lost = reliable(lost.select(F.col("doc_id").alias("_nf_i"), F.col("text_hash").alias("_nf_h")).distinct())
    hashed = docs.withColumn("_nf_hash", F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col("_nf_i")) & (F.col("_nf_hash") == F.col("_nf_h"))
    kept = hashed.join(small(lost, lost.count()), same, "left_anti")
    twice = reliable(j.signed.where("n > 0").groupBy(F.col("doc_id").alias("_nf_i"), F.col("text_hash").alias("_nf_h")).agg(F.count(F.lit(1)).alias("_nf_n")).where("_nf_n > 1").drop("_nf_n"))
    if n := twice.count():
        again = kept.join(small(twice, n), same, "left_semi").dropDuplicates(["doc_id", "_nf_hash"])
        kept = kept.join(small(twice, n), same, "left_anti").unionByName(again)
    return kept.select(*docs.columns)


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, y, c = nx.n AND c = ny.n AS same FROM p JOIN n nx ON x = nx.doc_id JOIN n ny ON y = ny.doc_id WHERE 5 * c >= 4 * (nx.n + ny.n - c)),
reach AS (SELECT x, y FROM e UNION SELECT reach.x, e.y FROM reach JOIN e ON reach.y = e.x),
least_id AS (SELECT x, min(y) AS m FROM reach GROUP BY x),
linked AS (SELECT x, count(*) AS n_links, count(*) FILTER (WHERE same) AS n_same FROM e GROUP BY x)
SELECT doc_id, least(doc_id, coalesce(m, doc_id)) AS class_id, CAST(1 + coalesce(n_same, 0) AS BIGINT) AS copies, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links
FROM w LEFT JOIN least_id ON doc_id = least_id.x LEFT JOIN linked ON doc_id = linked.x
"""
