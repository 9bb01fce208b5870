"""The pipeline's near-duplicates against brute-force Jaccard similarity of five-word shingles."""

import random
import re

import corpus_pipeline
import pytest
from tessera.llm import jaccard, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}


def least_of_each(docs):
    """The ids that are the smallest of their component, by all pairs."""
    sets, group, at = [shingles(t) for _, t in docs], list(range(len(docs))), {}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, s in enumerate(sets):
        shared = {}
        for x in s:
            for j in at.setdefault(x, []):
                shared[j] = shared.get(j, 0) + 1
            at[x].append(i)
        for j, n in shared.items():
            if 5 * n >= 4 * (len(s) + len(sets[j]) - n):
                x, y = root(i), root(j)
                group[max(x, y)] = min(x, y)
    return [d[0] for k, d in enumerate(docs) if root(k) == k]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_stage_leaves_one_of_each_group(spark, sf):
    d = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    docs = sorted((r.doc_id, r.text) for r in d.select("doc_id", "text").collect())
    got = corpus_pipeline.dedup_stage(spark, d, "")
    assert sorted(r.doc_id for r in got.collect()) == least_of_each(docs)


def test_large_groups_at_the_limit(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    rng, docs = random.Random(3), []
    for _ in range(4):
        base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
        for _ in range(45):  # similarities on both sides of 0.8
            own = list(base)
            for p in rng.sample(range(120), rng.randrange(1, 6)):
                own[p] = f"x{rng.randrange(10**6)}"
            docs.append((len(docs), " ".join(own)))
    got = corpus_pipeline.dedup_stage(spark, spark.createDataFrame(docs, "doc_id long, text string"), "")
    assert sorted(r.doc_id for r in got.collect()) == least_of_each(docs)


def test_odd_rows(spark):
    t = " ".join(f"w{k}" for k in range(60))
    rows = [(None, t), (None, t.upper()), (1, "a b"), (1, "c d"), (1, "a b"), (2, None), (3, " "), (None, t + " more"), (None, "own")]
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.text) for r in got if r.doc_id), key=str) == [(1, "a b"), (1, "c d"), (2, None)]
    assert len([r for r in got if r.doc_id is None]) == 2
    assert simhash.keep_one(spark.createDataFrame([], "doc_id long, text string")).count() == 0
