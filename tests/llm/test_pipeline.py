"""The pipeline's stages, each against a plain version on its own input."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from nearfield.llm import quality

from .test_queries import check_lines, ngram_truth


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        path = str(tmp_path / str(k))
        out.write.parquet(path)
        made = spark.read.parquet(path)
        texts = {r.doc_id: r.text for r in docs.collect()}
        if k < 4:
            assert made.columns == docs.columns
            got = {r.doc_id: r.text for r in made.collect()}
        if k == 0:
            want = {i: t for i, t in texts.items() if not quality.base_failed(d := quality.Doc(t)) and not any(r.rejects(d) for r in quality.RULES)}
        elif k == 1:
            check_lines(texts, got)
            assert all(r.n_chars == len(r.text) for r in made.collect())
            want = got
        elif k == 2:
            truth = ngram_truth(texts)
            want = {i: t for i, t in texts.items() if truth[i][0] == i}
        elif k == 3:
            from nearfield.llm import decontam

            bench = {r.item_id: r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
            windows = [p for t in bench.values() if (w := decontam.words_of(t)) for p in ([tuple(w[i : i + 13]) for i in range(len(w) - 12)] or [tuple(w)])]

            known = set(windows)
            by_size = {n: {p for p in known if len(p) == n} for n in {len(p) for p in known}}

            def hits(text):
                w = decontam.words_of(text)
                at = {j for n, ps in by_size.items() for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in ps for j in range(i, i + n)}
                return at and 20 * len(at) >= len(w)

            want = {i: t for i, t in texts.items() if not hits(t)}
        else:
            sizes = {i: len((t or "").encode().split()) for i, t in texts.items()}
            got, want = {r.doc_id: r["size"] for r in made.collect()}, sizes
            assert all(r.taken <= 3 * r["size"] for r in made.collect())
        assert got == want, name
        docs = made


def odd_documents(spark):
    long_ = " ".join(f"word{i % 900}" for i in range(20_000))
    rows = [(1, "few words", "a"), (None, None, None), (2, "", "a"), (3, long_, "b"), (3, long_, "b"), (4, " \n\t", None)]
    df = spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return df.withColumns({c: F.lit(7) for c in ("node", "bucket", "text_hash", "k1", "pos", "words", "line", "size", "kept", "root")})


@pytest.mark.parametrize("k", range(4))
def test_stages_on_odd_and_empty_tables(k, spark, sf):
    name, stage = corpus_pipeline.STAGES[k]
    odd = odd_documents(spark)
    made = stage(spark, odd, sf)
    assert made.columns == odd.columns
    ids = sorted(str(r.doc_id) for r in made.collect())
    assert ids == {0: [], 1: ["1", "2", "3", "3", "4", "None"], 2: ["1", "2", "3", "4", "None"], 3: ["1", "2", "3", "3", "4", "None"]}[k], name
    assert stage(spark, odd.limit(0), sf).count() == 0


def test_last_stage_on_odd_and_empty_tables(spark, sf):
    odd = odd_documents(spark)
    stage = corpus_pipeline.STAGES[-1][1]
    assert stage(spark, odd, sf).count() == 6
    assert stage(spark, odd.limit(0), sf).count() == 0
