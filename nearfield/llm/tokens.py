"""Token counts through a digest cache: only texts whose digest has no stored count are encoded."""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_ROWS, map_texts, reliable, settled, shared_dir, small

CACHE = "digest binary, version string, n_tokens long"


def version_of(tokenizer: str) -> str:
    """Digest of the tokenizer's file: counts of one version never serve another."""
    return hashlib.sha256(Path(tokenizer).read_bytes()).hexdigest()


class _Pieces(dict):
    """Token counts of pieces of text met before; bounded, it starts anew when full."""

    def __init__(self, count: Callable[[str], int], before: str, most: int = 400_000) -> None:
        self.count, self.before, self.most = count, before, most

    def __missing__(self, piece: str) -> int:
        if len(self) >= self.most:
            self.clear()
        n = self.count(self.before + piece)
        if len(piece) <= 64:
            self[piece] = n
        return n


#: A space that is alone between two characters that aren't white always starts a new pre-token.
_WIDE = re.compile(r"\s | \s|^ | $")


def counter(tokenizer: str) -> Callable[[str], int]:
    """Function from a text to its number of tokens, without added special tokens.

    Byte-level pre-tokens hold a space as first character only. A text whose spaces all stand alone is the sum of
    its pieces between spaces, whose counts are remembered; any other text, and other kinds of tokenizer, are encoded
    whole.
    """
    if tokenizer.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=tokenizer)
        return lambda text: len(pieces.encode(text, num_threads=1))
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import json

    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tokenizer)
    model.no_padding()
    model.no_truncation()

    def whole(text: str) -> int:
        return len(model.encode(text, add_special_tokens=False))

    spec = json.loads(Path(tokenizer).read_text())
    before = spec.get("pre_tokenizer") or {}
    added = [x["content"] for x in spec.get("added_tokens") or ()]
    plain = not spec.get("normalizer") and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    plain = plain and not any(re.search(r"\s", x) for x in added) and not any(x.get("lstrip") or x.get("rstrip") or x.get("single_word") for x in spec.get("added_tokens") or ())
    if not plain:
        return whole
    first, later = _Pieces(whole, ""), _Pieces(whole, " ")

    def count(text: str) -> int:
        if not text:
            return 0
        if _WIDE.search(text):
            return whole(text)
        pieces = text.split(" ")
        return first[pieces[0]] + sum(map(later.__getitem__, pieces[1:]))

    return count


def count_tokens(docs: DataFrame, tokenizer: str, cache: str | None = None, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every document, whole.

    ``cache``: folder of the Parquet table ``digest, version, n_tokens``; missing or empty is fine, and new counts are
    appended to it. Without one, a new folder beside the checkpoints serves this call. The content's normal form is
    the text itself with null as empty, since any change could change the counts.

    Repeated rows share a digest and are encoded once; a null id is kept; an empty table gives no rows; columns
    other than the two play no part. ``over_limit``: more than ``limit`` tokens.
    """
    spark = docs.sparkSession
    shared_dir(spark)
    version = version_of(tokenizer)
    where = cache or f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/token-cache-{uuid.uuid4().hex}"
    need = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    digested = need.withColumn("digest", F.unhex(F.sha2("text", 256)))
    keys = reliable(digested.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes")))
    stored = _stored(spark, where).where(F.col("version") == version).select("digest", "n_tokens").dropDuplicates(["digest"])
    chosen = keys.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("rows"))
    missing = reliable(chosen.join(stored, "digest", "left_anti"))
    misses, copies = missing.agg(F.count(F.lit(1)), F.coalesce(F.sum("rows"), F.lit(0))).first()
    total = keys.count()
    if misses:
        same = [digested["digest"].eqNullSafe(F.col("m_digest")), digested["doc_id"].eqNullSafe(F.col("m_id"))]
        named = missing.select(F.col("digest").alias("m_digest"), F.col("doc_id").alias("m_id"))
        if total - misses < min(misses, BROADCAST_ROWS):  # the rows to skip are the shorter list
            others = keys.join(missing.select("digest", "doc_id"), [keys["digest"] == missing["digest"], keys["doc_id"].eqNullSafe(missing["doc_id"])], "left_anti")
            skip = others.select(F.col("digest").alias("m_digest"), F.col("doc_id").alias("m_id"))
            todo = digested.join(F.broadcast(skip), same, "left_anti")
        else:
            todo = digested.join(small(named, misses), same, "left_semi")
        encoded = map_texts(todo.select("digest", "text"), lambda: (lambda count: lambda text: (count(text),))(counter(tokenizer)), T.StructType([T.StructField("n_tokens", T.LongType())]))
        encoded.dropDuplicates(["digest"]).select("digest", F.lit(version).alias("version"), "n_tokens").write.mode("append").parquet(where)
    # Stored apart, so that the join is between plain exchanges, which Spark can split where very many rows have one text.
    counts, n = settled(_stored(spark, where).where(F.col("version") == version).select("digest", "n_tokens").dropDuplicates(["digest"]))
    return keys.join(small(counts, n), "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def _stored(spark, where: str) -> DataFrame:
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(CACHE).parquet(where) if there else spark.createDataFrame([], CACHE)
