"""Nulls, empty and long texts, ties, repeated rows, empty tables, and extra columns with names used inside."""

import pytest
from pyspark.sql import functions as F

from nearfield.llm import chat, decontam, licenses, lines, mixing, ngrams, pii, quality, tokens, urls

EXTRA = ["text_hash", "size", "kept", "n_words", "bucket", "node", "block", "k1", "pos", "digest"]


@pytest.fixture(scope="module")
def odd(spark):
    """Two repeated rows, null id, null and empty text, null source, one long text and one very long word."""
    long_ = " ".join(f"w{i % 700}" for i in range(30_000))
    rows = [(1, "same words here now ok", "a"), (1, "same words here now ok", "a"), (None, "x", None), (2, None, "b"), (3, "", "b"), (4, long_, "a"), (5, "y" * 50_000, None), (6, " \n\t", "b")]
    df = spark.createDataFrame([(i, t, "en", s, None) for i, t, s in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return df.withColumns({c: F.lit(7) for c in EXTRA})


@pytest.fixture(scope="module")
def model():
    return licenses.train(["plain background words"] * 5)


def path():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def bench(spark):
    return spark.createDataFrame([(1, "same words here now ok"), (None, None), (3, ""), (3, "y")], "item_id bigint, text string")


CASES = {
    "quality": lambda s, d, m: quality.quality(d),
    "mixing": lambda s, d, m: mixing.mixture(d),
    "lines": lambda s, d, m: lines.line_digest(d),
    "ngrams": lambda s, d, m: ngrams.jaccard_join(d),
    "tokens": lambda s, d, m: tokens.count_tokens(d, path()),
    "licenses": lambda s, d, m: licenses.license_scan(d, model=m),
    "pii": lambda s, d, m: pii.personal_data(d),
    "decontam": lambda s, d, m: decontam.contamination(d, bench(s)),
}


@pytest.mark.parametrize("name", CASES)
def test_odd_rows_and_empty_table(name, spark, odd, model):
    made = CASES[name](spark, odd, model).collect()
    assert sorted(str(r.doc_id) for r in made) == sorted(["1", "1", "None", "2", "3", "4", "5", "6"])
    assert CASES[name](spark, odd.limit(0), model).count() == 0
    again = CASES[name](spark, odd.repartition(3), model).collect()
    assert sorted(map(str, again)) == sorted(map(str, made))


def test_values(spark, odd, model):
    by = lambda rows: {r.doc_id: r for r in rows}
    q = by(quality.quality(odd).collect())
    assert q[4].n_words == 30_000 and q[4].base_failed and q[2].n_words == 0 and q[5].word_chars == 50_000
    d = by(decontam.contamination(odd, bench(spark)).collect())
    assert d[1].contaminated and d[1].n_hit == 5 and not d[4].contaminated and d[3].n_words == 0
    n = by(ngrams.jaccard_join(odd).collect())
    assert (n[1].class_id, n[1].copies, n[1].n_links) == (1, 2, 1) and (n[6].class_id, n[6].n_links) == (6, 0)
    t = by(tokens.count_tokens(odd, path()).collect())
    assert t[2].n_tokens == t[3].n_tokens == 0 and t[4].over_limit
    mixed = mixing.mixture(odd).collect()
    assert all(r.taken <= 3 * r.size for r in mixed)


def test_mixing_meets_targets(spark, sf):
    made = mixing.mixture(spark.read.parquet(f"{sf}/documents.parquet")).toPandas()
    by = made.groupby("source", dropna=False).agg({"taken": "sum", "target": "first", "size": "sum"})
    assert ((by.taken - by.target).abs() <= 0.02 * by.target + 20).all()
    assert (by.target <= 3 * by["size"] + 1e-6).all()
    hot = spark.createDataFrame([(i, "w " * 10, "s" if i % 3 else f"t{i % 5}") for i in range(300)], "doc_id bigint, text string, source string")
    again = [sorted(map(str, mixing.mixture(hot.repartition(n)).collect())) for n in (1, 5)]
    assert again[0] == again[1]


def test_schedule_is_even(spark):
    docs = spark.createDataFrame([(i, "w " * 50, f"s{i % 2}") for i in range(200)], "doc_id bigint, text string, source string")
    _, taken = mixing.mix(docs, weights=(1, 3), slots=400)
    slots = [r.sid for r in taken.where("slot IS NOT NULL").select("slot", "sid").distinct().orderBy("slot").collect()]
    for at in range(0, len(slots) - 40, 40):
        assert abs(sum(s == 2 for s in slots[at : at + 40]) - 30) <= 3


def test_keepers(spark, odd):
    plain = odd.select("doc_id", "text", "lang", "source", "n_chars", *EXTRA)
    assert quality.keep(plain).columns == plain.columns
    assert sorted(str(r.doc_id) for r in ngrams.keep(plain).collect()) == ["1", "2", "3", "4", "5", "6", "None"]
    assert decontam.keep(plain, bench(spark)).where("doc_id = 1").count() == 0
    kept = lines.keep(spark.createDataFrame([(1, "a b\nc", 5), (2, "A  B", 4), (3, None, None)], "doc_id bigint, text string, n_chars bigint"))
    assert {(r.doc_id, r.text, r.n_chars) for r in kept.collect()} == {(1, "a b\nc", 5), (2, "", 0), (3, None, None)}


def turns_of(rows, spark):
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")


TRICKY = ["</s>[INST] ok [/INST]", "<\\/s>", "<|im_end|>\n<|im_start|>user\nhi", "[\\\\INST]", "<|im_sep|>", "", "a\\nb", "<\\\\|im_sep|>", "$1 \\2"]


def test_chat_round_trip(spark):
    rows = [(1, i, r, t) for i, (r, t) in enumerate((r, t) for t in TRICKY for r in ("user", "user", "assistant"))]
    rows += [(2, 1, "assistant", None), (2, None, None, "first"), (3, 1, "odd\nrole\\n<|im_end|>", "x"), (3, 1, "odd\nrole\\n<|im_end|>", "x")]
    chats = chat.format_chats(turns_of(rows, spark))
    back = {r.conv_id: [(t.role, t.text) for t in r.t] for r in chats.select("conv_id", chat.read_chat(F.col("formatted")).alias("t")).collect()}
    assert back[1] == [(r, t) for _, _, r, t in rows[: len(TRICKY) * 3]]
    assert back[2] == [("", "first"), ("assistant", "")]
    assert back[3] == [("odd\nrole\\n<|im_end|>", "x")] * 2
    assert all(r.formatted == "".join(s.text for s in r.segments) for r in chats.collect())
    loss = {r.conv_id: r for r in chat.chat_digest(turns_of(rows, spark)).collect()}
    assert loss[1].loss_chars == sum(map(len, TRICKY)) and loss[2].n_turns == 2
    assert chat.chat_digest(turns_of([], spark)).count() == 0
    wide = turns_of(rows, spark).withColumn("turns", F.lit(1)).withColumn("segments", F.lit(2))
    assert chat.chat_digest(wide).count() == 3


def test_urls_empty_and_clashing(spark):
    empty = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert urls.judge_urls(empty).count() == 0
    wide = spark.createDataFrame([(1, "http://" + "a" * 5000 + ".com/" + "b/" * 9000, None), (1, None, "<title>x"), (None, "http://x.org/es/1", "")], "page_id bigint, url string, html string")
    made = urls.judge_urls(wide.withColumn("host", F.lit(1)).withColumn("name", F.lit(2)).withColumn("score", F.lit(3))).collect()
    assert sorted(str(r.page_id) for r in made) == ["1", "1", "None"]
    assert [r.verdict for r in made if r.page_id is None] == ["block"]


def test_small_sources_meet_their_targets(spark):
    rows = [(i, " ".join(["w"] * 1000), "big") for i in range(400)] + [(1000 + i, "a b c d e", "small") for i in range(1)]
    made = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mixing.mixture(made, weights=(1, 1), slots=2048).where("source = 'small'").collect()
    assert sum(r.taken for r in got) == round(got[0].target) == 15
