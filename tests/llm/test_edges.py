"""Every operator and stage on nulls, empty and long texts, repeated rows, empty tables and clashing column names."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from sqlverdict.llm import bpe, exact_dedup, hmm, line_dedup, lpf, near_dup, packing, pii, quality, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"
LONG = "many words make a long text. " * 4000
ROWS = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "one", "en", "a", 3), (3, "one", "en", "a", 3), (4, LONG, "de", "b", len(LONG)), (5, LONG, "en", None, 1), (None, "no id here", "en", "a", 2), (6, " \t\n ", "en", "a", 4), (7, "x" * 30_000, "en", "c", 1)]
PATH = bpe.tokenizer_file()

OPERATORS = {
    "op1": lambda d, _: packing.pack(d, PATH),
    "op2": lambda d, labels: toxicity.score(d, toxicity.fit(d, labels), "tox"),
    "op3": lambda d, _: near_dup.classes(d),
    "op4": lambda d, _: exact_dedup.deduplicate(d),
    "op5": lambda d, _: pii.pseudonymize(d, pii.TEST_KEY),
    "op6": lambda d, _: lpf.remove_repeats(d),
    "op7": lambda d, _: hmm.language_scores(d),
    "op8": lambda d, _: bpe.encode_decode(d, PATH),
    "op9": lambda d, _: quality.judged(d),
    "op10": lambda d, _: line_dedup.remove_boilerplate(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name):
    docs = spark.createDataFrame(ROWS, DOCS)
    labels = spark.createDataFrame([(3, 1, 1), (4, 1, 0), (None, 1, 1), (2, None, None)], LABELS)
    found = OPERATORS[name](docs, labels).collect()
    if name == "op1":
        assert sum(r.length for r in found if r.start == 0 and r.doc_tokens == r.length == 1) == 2
        assert {r.doc_id for r in found} == {r[0] for r in ROWS}
    else:
        assert sorted(str(r[0]) for r in found) == sorted(str(r[0]) for r in ROWS)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(spark, name):
    assert OPERATORS[name](spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)).collect() == []


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_columns(spark, name):
    names = ["id", "row", "h", "key", "body", "score", "digest", "keep_id", "kept", "class_id", "llm_id", "n", "hits", "llm_hits", "Line", "hash"]
    docs = spark.createDataFrame([(1, "a b c", "en", "s", 3), (2, "a b c", "en", "s", 3)], DOCS).select("*", *[F.lit("odd").alias(c) for c in names])
    labels = spark.createDataFrame([(1, 1, 0)], LABELS).withColumn("text", F.lit("x")).withColumn("llm_id", F.lit(1))
    assert {r.doc_id for r in OPERATORS[name](docs, labels).collect()} == {1, 2}


def test_stages_keep_columns_and_extra_ones(spark, tmp_path):
    docs = spark.createDataFrame(ROWS, DOCS).withColumn("llm_id", F.lit("extra")).withColumn("llm_nth", F.lit("extra"))
    spark.createDataFrame([(3, 1, 0)], LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        assert 0 < out.count() <= len(ROWS)
        assert stage(spark, docs.limit(0), str(tmp_path)).collect() == []


def test_exact_stage_keeps_one_of_repeated_rows(spark):
    docs = spark.createDataFrame(ROWS, DOCS)
    kept = exact_dedup.keep_first(docs)
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "3", "4", "None", "6", "7"])
    again = exact_dedup.deduplicate(docs).groupBy("doc_id").agg(F.count_if("kept").alias("n")).where("doc_id = 3").first()
    assert again.n == 1
