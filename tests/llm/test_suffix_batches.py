"""Substring dedup where one batch has many runs of an anchor and another only copies of one of them."""

from collections import Counter

import numpy as np

from tessera.llm import suffix_dedup
from tests.llm import brute
from tests.llm.test_operators import got


def test_copies_in_another_batch_reach_the_last_pass(spark):
    """The earliest copy of each X is alone in the second batch; the first has X late, before many texts with its passage."""
    made, many, early = np.random.default_rng(4), [], []
    draw = lambda n: bytes(made.integers(97, 123, n, dtype=np.uint8)).decode()
    for group in range(8):
        passage = draw(180)
        x = passage + draw(180)
        early.append((10 + group, x))
        many += [(900 + group, x)] + [(100 + 30 * group + i, passage + draw(150)) for i in range(30)]
    batches = spark.sparkContext.parallelize([many, early], 2).flatMap(lambda rows: rows)
    done = suffix_dedup.dedup(spark.createDataFrame(batches, "doc_id long, text string"))
    assert got(done, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == Counter(brute.suffix_dedup(many + early))
