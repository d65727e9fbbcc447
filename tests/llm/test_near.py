"""Near duplicates: open buckets in blocks, a group with edits from a common pool, and the real table, against brute force."""

import random
from collections import Counter, defaultdict

import pytest
from sqlverdict.llm import near_dup

from tests.llm.test_operators import SF, jaccard, weighted


def components_of(texts, threshold=0.8):
    """The smallest index of each text's component, by all pairs that share a shingle."""
    sets = [weighted(t) for t in texts]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders, empty = defaultdict(list), [i for i, s in enumerate(sets) if not s]
    links = [(empty[0], i) for i in empty[1:]]
    for i, s in enumerate(sets):
        met = Counter(j for x in s for j in holders[x])
        links += [(j, i) for j, n in met.items() if 3 * n >= max(len(s), len(sets[j])) and jaccard(s, sets[j]) >= threshold - 1e-9]
        for x in s:
            holders[x].append(i)
    for i, j in links:
        a, b = sorted((root(i), root(j)))
        parent[b] = a
    return [root(i) for i in range(len(texts))]


def pooled(n, seed=3):
    """Copies of one text with edits from a pool: many are near the text, many only near a few others."""
    r = random.Random(seed)
    base = [f"w{i}" for i in range(60)]
    pool = [(i, f"x{i}") for i in r.sample(range(60), 20)]
    out = []
    for _ in range(n):
        t = base.copy()
        for i, x in r.sample(pool, r.randint(1, 4)):
            t[i] = x
        out.append(" ".join(t))
    return out


@pytest.mark.parametrize("block", [near_dup.BLOCK, 700])
def test_open_buckets(spark, monkeypatch, block):
    monkeypatch.setattr(near_dup, "BLOCK", block)
    texts = pooled(250)
    want = components_of(texts)
    assert 1 < len(set(want)) < len(texts)
    found = near_dup.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in found} == dict(enumerate(want))


def test_the_real_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted((r.doc_id, r.text or "") for r in docs.collect())
    want = components_of([t for _, t in rows])
    found = {r.doc_id: r.class_id for r in near_dup.classes(docs).collect()}
    assert found == {rows[i][0]: rows[k][0] for i, k in enumerate(want)}


def test_maps_pass_through(spark):
    rows = [(1, "one two", {"a": 1}), (1, "one two", {"b": 2}), (2, "one two three four five six", None), (None, "", {})]
    kept = near_dup.keep_one(spark.createDataFrame(rows, "doc_id long, text string, more map<string, int>")).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "2", "None"]
