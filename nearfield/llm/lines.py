"""Fuzzy line dedup: bands of hashed word pairs, edit similarity, one occurrence for each connected group."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import add, sub

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, forget, reliable, settled, small, stored
from .components import link_groups, shared_buckets

SIMILARITY = 0.9
#: Lines of up to ``SHORT`` words go by their words but one; up to ``MIDDLE``, by bands of two pairs of neighbouring
#: words; longer ones, by bands of three. A line next to a border gets both kinds.
SHORT, MIDDLE = 7, 20
BANDS = {2: 8, 3: 12}
VARIED = 16
#: Lines of one or two words go by runs of so many characters, or below ``HALVES`` characters by their halves.
RUN, HALVES = 5, 20
PAIRS_PER_TASK = 1000
#: Characters that are counted in lines of large buckets, all others as one.
COUNTED = "entaoirsdlhu "
#: In a large bucket a block of so many nodes meets another one.
BLOCK = 512
#: SQL: whether the lines x and y differ in ``most`` edits at most. Spark's edit distance takes the product of the lengths where
#: lines are linked (of others it soon sees that they aren't), so cheaper bounds come first. The sum over the words, if
#: equally many, is a distance that some edits reach; so is the sum over pieces, up to 12, cut at the same shares of both lines.
_BY_WORD = "aggregate(zip_with(split(x, ' '), split(y, ' '), (v, w) -> if(v = w, 0, levenshtein(v, w))), 0, (s, d) -> s + d)"
_SPACES = "length(replace(x, ' ', '')) - length(x) = length(replace(y, ' ', '')) - length(y)"
_PIECES = "cast(least(12, length(x) div 512) AS int)"
_PIECE = "substring({0}, cast(1 + i * length({0}) div {1} AS int), cast((i + 1) * length({0}) div {1} - i * length({0}) div {1} AS int))"
_DISTANCE = f"levenshtein({_PIECE.format('x', _PIECES)}, {_PIECE.format('y', _PIECES)}, cast(64 + most div 3 AS int))"
_BY_PIECE = f"aggregate(transform(sequence(0, {_PIECES} - 1), i -> {_DISTANCE}), 0, (s, d) -> if(d < 0, 1 + most, s + d))"
NEAR = f"""abs(length(x) - length(y)) <= most AND (greatest(length(x), length(y)) <= most
    OR {_SPACES} AND {_BY_WORD} <= most
    OR length(x) >= 1024 AND {_BY_PIECE} <= most
    OR levenshtein(x, y, most) >= 0)"""
#: SQL: how many characters x and y have in common at their heads, and at their tails, found by halving.
_COMMON = "aggregate(sequence(cast(log2(1 + least(length(x), length(y))) AS int), 0, -1), 0, (n, b) -> if(n + shiftleft(1, b) <= least(length(x), length(y)) AND {0}(x, n + shiftleft(1, b)) = {0}(y, n + shiftleft(1, b)), n + shiftleft(1, b), n))"


def middles(pairs: DataFrame) -> DataFrame:
    """The pairs ``x, y`` without the heads and the tails that they have in common, which no distance depends on."""
    for side, rest in (("left", "substring({0}, 1 + n)"), ("right", "left({0}, length({0}) - n)")):
        cut = f"transform(array({_COMMON.format(side)}), n -> struct({rest.format('x')} AS x, {rest.format('y')} AS y))"
        # An explode keeps the optimizer from writing the cut out in every place where x and y are used.
        pairs = pairs.select("*", F.explode(F.expr(cut)).alias("cut")).withColumns({"x": F.col("cut.x"), "y": F.col("cut.y")}).drop("cut")
    return pairs


def plain(text: Column) -> Column:
    """The text in lower case, with spaces for all white space but line ends."""
    text = F.lower(text)
    for c in "\t\x0b\x0c\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return text


def words_of(line: Column) -> Column:
    """The words of a plain line; one without words has none."""
    return F.array_remove(F.split(line, " "), "")


def lines_of(docs: DataFrame, text: Column) -> DataFrame:
    """``doc_id, text_hash, pos, line``: the lines of ``text``, as it is or plain."""
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))


def occurrences(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, pos, k1, k2, keys`` of each line that has a word; k1 and k2 digest its words, lower-cased.

    Lines that share one of the ``keys`` are compared. The features of a line (its pairs of neighbouring words) are
    hashed and sorted, and each run of two or three of the least ones, neighbours in that order, makes a band: a band
    is lost only if one of its features changes or a new one falls between them. A feature counts once, else a pair of
    words that stands three times in many lines would be a band of them all. A line of fewer than ``VARIED`` different
    features gets a second set of bands, in which repeats (the second; the third and fourth; and so on, doubling) are
    features too.
    """
    n, s, norm = F.col("n"), F.col("s"), F.array_join("words", " ")
    lines = lines_of(docs, plain(F.col("text"))).where(F.btrim("line") != "").select("doc_id", "text_hash", "pos", words_of(F.col("line")).alias("words"))
    lines = lines.select("*", F.size("words").alias("n"), F.when(F.size("words") <= 2, norm).alias("norm"))
    lines = lines.withColumn("chars", F.when(F.length("norm") >= HALVES, F.split("norm", "")))
    pairs = F.transform(F.slice("words", 1, n - 1), lambda w, i: F.xxhash64(w, F.get("words", i + 1)))
    runs = F.transform(F.slice("chars", 1, F.size("chars") - RUN + 1), lambda _, i: F.xxhash64(F.slice("chars", i + 1, F.lit(RUN))))
    features = F.sort_array(F.when(n >= SHORT, pairs).otherwise(runs))

    def numbered(h: Column, i: Column) -> Column:
        before = [F.coalesce(F.get("s", i - (1 << j)) == h, F.lit(False)) for j in range(12)]
        return F.when(before[0], F.xxhash64(h, reduce(add, [b.cast("int") for b in before]))).otherwise(h)

    k1, k2 = F.xxhash64("words").alias("k1"), F.xxhash64(F.lit("second"), "words").alias("k2")
    lines = lines.select("doc_id", "text_hash", "pos", k1, k2, "n", "norm", F.when(n <= SHORT + 1, F.col("words")).alias("few"), features.alias("s")).withColumn("d", F.array_distinct("s"))
    repeats = F.sort_array(F.array_distinct(F.transform("s", numbered)))
    lines = lines.withColumn("r", F.when((F.size("d") < VARIED) & (F.size("d") < F.size("s")), repeats))

    def bands(size: int) -> Column:
        def of(s: str) -> Column:
            every = F.array(*[F.xxhash64(F.lit(size), *[F.get(s, F.lit(j + k)) for k in range(size)]) for j in range(BANDS[size])])
            return F.slice(every, F.lit(1), F.greatest(F.lit(1), F.size(s) - size + 1))

        return F.when(F.col("r").isNull(), of("d")).otherwise(F.array_union(of("d"), of("r")))

    but_one = F.transform("few", lambda _, i: F.xxhash64(F.concat(F.slice("few", F.lit(1), i), F.slice("few", i + 2, n))))
    length = F.length("norm")
    # One change leaves either the first half or the last; of lines of two lengths the shorter one's half counts.
    halves = F.array(*[F.xxhash64(F.lit(side), cut(half)) for side, cut in (("head", lambda k: F.left("norm", k)), ("tail", lambda k: F.right("norm", k))) for half in (F.floor((length - 1) / 2).cast("int"), F.floor((length - 2) / 2).cast("int"))])
    none = F.array().cast("array<bigint>")
    keys = F.concat(
        F.when(n.between(3, SHORT + 1), F.array_append(but_one, F.xxhash64("few"))).otherwise(none),
        F.when(n.between(SHORT, MIDDLE + 1) | F.size(s).isNotNull() & (F.size(s) >= 0) & (n <= 2), bands(2)).otherwise(none),
        F.when(n >= MIDDLE, bands(3)).otherwise(none),
        F.when((n <= 2) & length.between(10, HALVES - 1), halves).otherwise(none),
    )
    return lines.select("doc_id", "text_hash", "pos", "k1", "k2", keys.alias("keys"))


def most_edits(x: Column, y: Column, similarity: float) -> Column:
    """The greatest edit distance of lines of these lengths that are linked."""
    return F.floor((1 - similarity + 1e-9) * F.greatest(x, y)).cast("int")


def counts_of(line: Column) -> Column:
    """The length of a line and how often each of the ``COUNTED`` characters stands in it."""
    return F.array(F.length(line), *[F.length(line) - F.length(F.replace(line, F.lit(c), F.lit(""))) for c in COUNTED])


def alike(a: Column, b: Column, similarity: float) -> Column:
    """Whether the ``counts_of`` two lines allow a link. Added up, the differences of the counts, that of the others' count
    and that of the lengths grow by two at most with an edit: a substitution changes two counts, another edit one and the length."""
    gaps = [a[i] - b[i] for i in range(len(COUNTED) + 1)]
    others = F.abs(reduce(sub, gaps))
    most = most_edits(a[0], b[0], similarity)
    return (F.abs(gaps[0]) <= most) & (reduce(add, map(F.abs, gaps)) + others <= 2 * most)


def block_pairs(large: DataFrame, may: Callable[[Column, Column], Column]) -> DataFrame:
    """All pairs ``a, b`` of different parts within buckets, ``bucket, node, part, mark``, that may be linked.

    Each node outside the bucket's greatest part meets all nodes of the bucket, block against block, so no task gets
    more than ``BLOCK`` nodes of both for one key.
    """
    counted = large.groupBy("bucket", "part").agg(F.count(F.lit(1)).alias("n")).groupBy("bucket")
    sizes = counted.agg(F.max(F.struct("n", "part")).alias("main"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    sizes, n = settled(sizes.select("bucket", F.col("main.part").alias("main"), F.ceil((F.col("n") - F.col("main.n")) / BLOCK).alias("outer"), F.ceil(F.col("n") / BLOCK).alias("blocks")))
    nodes = large.select("bucket", "node", "part", "mark").join(small(sizes, n), "bucket")
    of, every = (lambda c: F.pmod(F.xxhash64("node"), F.col(c))), (lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1)))
    left = nodes.where("part != main").select("bucket", of("outer").alias("i"), every("blocks").alias("j"), F.col("node").alias("a"), F.col("part").alias("p"), F.col("mark").alias("am"))
    right = nodes.select("bucket", of("blocks").alias("j"), every("outer").alias("i"), F.col("node").alias("b"), F.col("part").alias("q"), F.col("mark").alias("bm"))
    met = left.join(right, ["bucket", "i", "j"]).where((F.col("p") != F.col("q")) & may(F.col("am"), F.col("bm")))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def removals(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id, text_hash, removed``: the sorted positions of the lines that go, for documents that lose some."""
    occ, done_with = stored(occurrences(docs))
    shared = shared_buckets(occ.select(F.explode("keys").alias("bucket"), F.col("k1").alias("node")))
    nodes, n_nodes = settled(shared.select("node").distinct())
    first = F.min(F.struct("doc_id", "text_hash", "pos")).alias("first")
    distinct = occ.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("times"), first).join(small(nodes, n_nodes), F.col("k1") == F.col("node"), "left").where("times > 1 OR node IS NOT NULL")
    distinct = reliable(distinct)
    wanted = distinct.where("node IS NOT NULL").select("node", F.col("first.doc_id").alias("i"), F.col("first.text_hash").alias("h"), F.col("first.pos").alias("p"))
    lines = lines_of(docs, F.col("text"))
    placed = lines.join(small(wanted, n_nodes), lines["doc_id"].eqNullSafe(F.col("i")) & (lines["text_hash"] == F.col("h")) & (lines["pos"] == F.col("p")))
    texts = reliable(placed.select("node", F.array_join(words_of(plain(F.col("line"))), " ").alias("line")).dropDuplicates(["node"]))
    info = distinct.where("node IS NOT NULL").groupBy("node").agg(F.sum("times").alias("weight")).join(texts.select("node", F.length("line").alias("mark")), "node")

    def may(a: Column, b: Column) -> Column:
        return F.abs(a - b) <= most_edits(a, b, similarity)

    def verify(pairs: DataFrame, n_pairs: int) -> DataFrame:
        # Distances cost much more than the bytes suggest by which Spark would choose the number of tasks.
        tasks = max(1, -(-n_pairs // PAIRS_PER_TASK))
        both = pairs.join(texts.select(F.col("node").alias("b"), F.col("line").alias("y")), "b").repartition(tasks, "a")
        both = both.join(texts.select(F.col("node").alias("a"), F.col("line").alias("x")).repartition(tasks, "a"), "a")
        return middles(both.withColumn("most", most_edits(F.length("x"), F.length("y"), similarity))).where(NEAR).select("a", "b")

    def compare(large: DataFrame, known: DataFrame) -> DataFrame:
        counted, n = settled(large.select("node").distinct().join(texts, "node").select("node", counts_of(F.col("line")).alias("mark")))
        pairs = block_pairs(large.drop("mark").join(small(counted, 8 * n), "node"), lambda a, b: alike(a, b, similarity))
        return verify(*settled(pairs.join(known, ["a", "b"], "left_anti")))

    groups, n_groups = settled(link_groups(shared, info, may, verify, compare))
    for done in (shared, texts):
        forget(done)
    joined = distinct.drop("node").join(small(groups, n_groups), F.col("k1") == F.col("node"), "left")
    winners = joined.where("root IS NOT NULL").groupBy("root").agg(F.min("first").alias("win"))
    kept = joined.where("root IS NOT NULL").select("k1", "k2", "root").join(winners, "root").select("k1", "k2", "win")
    alone = joined.where("root IS NULL AND times > 1").select("k1", "k2", F.col("first").alias("win"))
    winning, n = settled(kept.unionByName(alone))
    lost = occ.select("doc_id", "text_hash", "pos", "k1", "k2").join(small(winning, n), ["k1", "k2"]).where(~F.struct("doc_id", "text_hash", "pos").eqNullSafe(F.col("win")))
    removed = reliable(lost.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("pos")).alias("removed")))
    done_with()
    return removed


def dedup_lines(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The documents with all their columns, ``text`` without the lines that repeat, and ``_nf_n_removed``.

    Two lines are linked if their words, lower-cased and joined by one space, are equal, or if they share a key (see
    ``occurrences``) and their edit similarity (1 - distance / longer length) is ``similarity`` or more. Of each
    connected group the first occurrence stays, by doc_id (null first), text digest and place.

    Lines without a word stay. A null text stays null; an emptied one is empty. Rows equal in doc_id and text are one
    document, and all of them get the same text. An empty table gives no rows. Lines are compared whole.
    """
    need = docs.select("doc_id", "text")
    gone = removals(need, similarity)
    n, places = gone.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("removed")), F.lit(0))).first()
    gone = gone.select(F.col("doc_id").alias("_nf_i"), F.col("text_hash").alias("_nf_h"), F.col("removed").alias("_nf_removed"))
    gone = F.broadcast(gone) if n <= BROADCAST_ROWS and places <= 4 * BROADCAST_ROWS else gone.hint("shuffle_hash")
    joined = docs.join(gone, docs["doc_id"].eqNullSafe(F.col("_nf_i")) & (F.xxhash64(docs["text"]) == F.col("_nf_h")), "left").drop("_nf_i", "_nf_h")
    split = joined.withColumn("_nf_lines", F.when(F.col("_nf_removed").isNotNull(), F.split("text", "\n", -1)))
    pieces = F.zip_with(F.concat(F.array(F.lit(-1)), "_nf_removed"), F.concat("_nf_removed", F.array(F.size("_nf_lines"))), lambda p, q: F.slice("_nf_lines", p + 2, q - p - 1))
    made = split.withColumn("text", F.when(F.col("_nf_removed").isNull(), F.col("text")).otherwise(F.array_join(F.flatten(pieces), "\n")))
    return made.withColumn("_nf_n_removed", F.coalesce(F.size("_nf_removed"), F.lit(0)).cast("long")).drop("_nf_lines", "_nf_removed")


def line_digest(docs: DataFrame) -> DataFrame:
    """``doc_id, n_removed, text`` of each document after line dedup."""
    return dedup_lines(docs.select("doc_id", "text")).select("doc_id", F.col("_nf_n_removed").alias("n_removed"), "text")


def keep(docs: DataFrame) -> DataFrame:
    """The documents without repeated lines; ``n_chars`` follows the text where there is such a column.

    All rows and columns stay, so nulls, repeated rows and empty tables are as in ``dedup_lines``; columns that the
    operator uses inside have names of their own, so that any other column may have any name.
    """
    made = dedup_lines(docs)
    if "n_chars" in docs.columns:
        made = made.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return made.select(*docs.columns)
