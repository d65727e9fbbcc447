"""The pipeline against a plain composition of what its stages promise."""

import os
import re
import zlib
from collections import defaultdict

import corpus_pipeline
import numpy as np
import pyarrow as pa
from sqlverdict.llm import _bytes as B
from sqlverdict.llm import bpe, exact_dedup, near_dup, pii, toxicity

from tests.llm.test_near import components_of

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        if name == "toxicity":
            scores = toxicity.score(docs, toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))).collect()
            assert {r.doc_id for r in out.collect()} == {r.doc_id for r in scores if r.score < 0.3}
        elif name == "exact_dedup":
            assert {r.doc_id for r in out.collect()} == {r.doc_id for r in exact_dedup.deduplicate(docs).collect() if r.kept}
        elif name == "near_dup":
            classes = near_dup.classes(docs).collect()
            assert {r.doc_id for r in out.collect()} == {r.class_id for r in classes}
        elif name == "pii":
            after = {r.doc_id: r for r in out.collect()}
            assert after.keys() == before.keys()
            assert all("@mail" not in r.text or r.text != before[k].text for k, r in after.items())
        else:
            assert {r.doc_id for r in out.collect()} == before.keys()
        if name != "packing":
            assert out.columns == docs.columns
        docs = out


def test_run_is_the_stages_in_turn(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(rows[0].asDict())


def test_stages_against_plain_python(spark, tmp_path):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    texts = {r.doc_id: r.text or "" for r in rows}
    stages, docs = dict(corpus_pipeline.STAGES), spark.read.parquet(f"{SF}/documents.parquet")

    def after(name):
        nonlocal docs
        stages[name](spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        return {r.doc_id: r.text or "" for r in docs.collect()}

    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))

    def toxic(t):
        own = set(toxicity.features(*B.flat(pa.array([t], pa.string())))[1].tolist())
        return 1 / (1 + np.exp(-(sum(model.weights[f] for f in own) + model.intercept))) >= 0.3

    texts = {k: t for k, t in texts.items() if not toxic(t)}
    assert after("toxicity") == texts
    first = {}
    for k in sorted(texts):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", texts[k]), k)
    texts = {k: texts[k] for k in first.values()}
    assert after("exact_dedup") == texts
    ids = sorted(texts)
    texts = {ids[i]: texts[ids[i]] for i in set(components_of([texts[k] for k in ids]))}
    assert after("near_dup") == texts
    changed = after("pii")
    back = {r.doc_id: r.text or "" for r in pii.restore(docs, pii.key_of(spark)).collect()}
    assert back == texts
    assert 0 < sum(changed[k] != t for k, t in texts.items()) < len(texts)
    tokenizer, pieces = Tokenizer.from_file(bpe.tokenizer_file()), defaultdict(list)
    for r in stages["packing"](spark, docs, SF).collect():
        pieces[r.doc_id].append(r)
    assert pieces.keys() == changed.keys()
    for k, t in changed.items():
        whole, at = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], np.uint32), 0
        for r in sorted(pieces[k], key=lambda r: r.start):
            assert (r.start, r.ids_crc32) == (at, zlib.crc32(whole[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(whole)
