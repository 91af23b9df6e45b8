"""Shared passages of over 50 words that begin and end inside a sentence."""

import random
from collections import Counter

from tessera.llm import sentence_dedup
from tests.llm import brute

COLUMNS = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def got(df):
    return Counter(tuple(r[c] for c in COLUMNS) for r in df.collect())


def test_one_whole_inner_sentence_suffices(spark):
    """The outer sentences differ; between them stands one whole sentence of 20 to 39 words."""
    rows = []
    for k in range(20):
        word = lambda part, n: " ".join(f"{part}{k}w{i}" for i in range(n))
        passage = f"{word('a', 16)}. {word('b', 20 + k)}. {word('c', 16)}"
        rows += [(2 * k, f"{word('d', 9)} {passage} {word('e', 9)}."), (2 * k + 1, f"{word('f', 9)} {passage} {word('g', 9)}.")]
    done = {r["doc_id"]: r["n_removed"] for r in sentence_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(not done[2 * k] and done[2 * k + 1] for k in range(20))


def test_shortest_runs_remove_what_all_runs_do(spark):
    """Texts of few different sentences, so that runs of every length come again, overlap and touch."""
    rng = random.Random(5)
    pool = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 14))) + rng.choice(".!;") for _ in range(12)]
    rows = [(k, " ".join(rng.choice(pool) for _ in range(rng.randint(0, 25)))) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for least, alone in ((20, 20), (9, 12), (30, 99)):
        want = brute.sentence_dedup(rows, least, alone, every=True)
        assert got(sentence_dedup.dedup(df, min_words=least, long_words=alone)) == Counter(want)
        assert sum(w[2] for w in want)


def test_punctuation_behind_a_mark(spark):
    """Markup between a mark and white space doesn't hide the end of a sentence; a mark of the text before doesn't count."""
    words = " ".join(f"w{i}" for i in range(15))
    passage = f"{words}.** {words}?\"]] {words},$$$"
    rows = [(1, f"one.** {passage} end..."), (2, f"** two {passage} other"), (3, f"*** three. {passage}"), (4, "!"), (5, "' ' . .")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    want = brute.sentence_dedup(rows, 20, 20)
    assert got(sentence_dedup.dedup(df)) == Counter(want)
    assert [w[2] > 0 for w in sorted(want)] == [False, True, True, False, False]
