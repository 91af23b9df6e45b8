"""The pipeline's near-dedup stage against plain pair counts at its own threshold."""

import numpy as np

import corpus_pipeline
from tessera.llm import minhash
from tests.llm import brute


def firsts(rows, percent):
    """The ids that are the least of their component, by comparing all pairs."""
    sets, root = {d: brute.shingles(t) for d, t in rows}, {d: d for d, _ in rows}
    for a in sorted(sets):
        for b in sorted(sets):
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((root[a], root[b]))
                root = {d: low if r == high else r for d, r in root.items()}
    return {d for d, r in root.items() if d == r}


def test_stage_links_at_080(spark, sf):
    """Pairs of similarity 0.70 to 0.95; words are changed far apart, so each change costs five shingles."""
    made, rows = np.random.default_rng(11), []
    for pair in range(60):
        words = [f"p{pair}w{i}" for i in range(204)]
        rows.append((2 * pair, " ".join(words)))
        for at in range(made.integers(1, 8)):
            words[10 + 25 * at] = f"new{at}"
        rows.append((2 * pair + 1, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = firsts(rows, 80)
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, sf).collect()} == want
    at_85 = {r["doc_id"] for r in minhash.near_duplicates(docs, percent=85).where("kept").collect()}
    assert at_85 == firsts(rows, 85) and len(want) < len(at_85)
