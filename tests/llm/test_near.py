"""The pipeline's near-duplicates against all pairs' 5-word Jaccard similarity."""

import random
from itertools import combinations

import corpus_pipeline


def shingles(text):
    ws = (text or "").lower().split()
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def test_near_duplicates_by_jaccard(spark):
    rng = random.Random(3)
    texts = []
    for _ in range(12):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([30, 200, 1500]))]
        texts.append(" ".join(base))
        for share in (0.005, 0.01, 0.02, 0.03, 0.05):
            texts.append(" ".join(f"x{rng.randrange(5000)}" if rng.random() < share else w for w in base))
    texts += ["a b", "A b", "", None, "a b c d e f g h i j", texts[0].upper()]
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))
    for i, j in combinations(range(len(texts)), 2):
        if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            a, b = sorted((root[i], root[j]))
            root = [a if r == b else r for r in root]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(root))
    assert kept.columns == docs.columns


def test_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert corpus_pipeline.near_duplicate_stage(spark, docs, "").count() == 0
