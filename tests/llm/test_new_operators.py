"""Centroid clustering, filter audit and line dedup against plain versions, on hand-made rows."""

import hashlib
import math
import re
from collections import Counter
from fractions import Fraction
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import centroids, filter_audit, line_dedup
from tests.llm import brute

WHITE = " \t\n\x0b\x0c\r"
#: Clashing column names, nulls, repeats, long and empty texts.
TEXTS = [
    (1, ""), (2, None), (3, "one line"), (4, " One LINE\t\nother\n\none line "), (5, "\n\n"), (6, "a\nb\na\nb\nc"), (6, "a\nb\na\nb\nc"), (7, "É\né\nA"),
    (8, "x\n" * 3000 + "end"), (None, "one line\nnull id"), (None, "one line\nnull id"), (9, "c"), (10, "A \n B"), (10, "another text\nb"), (11, "\r\n\x0ba"), (12, "  "),
]


def frame(spark, rows):
    return spark.createDataFrame(
        [(d, t, "en", 1, "w", 2.5, "x", "y") for d, t in rows], "doc_id long, text string, lang string, id int, v string, p double, starts string, n_lines string"
    )


def lines_brute(rows, least, keep_first=False):
    """doc_id, n_lines, n_dropped, kept text and runs; order: text hashes of one id as Spark has them, so only distinct ids count there."""
    docs, places = {}, {}
    for doc_id, text in rows:
        docs[doc_id, text or ""] = [(x.strip(WHITE).translate(brute.DOWN), x) for x in (text or "").split("\n")]
    for doc, own in docs.items():
        for p, (key, _) in enumerate(own):
            places.setdefault(key, {}).setdefault(doc, p)
    out = []
    for doc_id, text in rows:
        doc, bits = (doc_id, text or ""), []
        for p, (key, _) in enumerate(docs[doc]):
            common = key != "" and len(places[key]) >= least
            first = keep_first and common and min(places[key], key=lambda d: (d[0] is not None, d[0] or 0)) == doc and places[key][doc] == p
            bits.append(not common or first)
        runs, now = [], True
        n = 0
        for bit in bits:
            if bit != now:
                runs.append(n)
                now, n = bit, 0
            n += 1
        runs.append(n)
        if not now:
            runs.append(0)
        kept = "\n".join(x for (_, x), bit in zip(docs[doc], bits) if bit)
        out.append((doc_id, len(bits), bits.count(False), kept, ",".join(map(str, runs))))
    return Counter(out)


@pytest.mark.parametrize("least", [1, 2, 3])
def test_line_dedup_of_odd_rows(spark, least):
    found = line_dedup.dedup(frame(spark, TEXTS), least)
    got = Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"], r["keep_runs"]) for r in found.collect())
    assert got == lines_brute(TEXTS, least)
    thin = line_dedup.bitmaps(frame(spark, TEXTS), least)
    assert Counter(map(tuple, thin.collect())) == Counter((d, n, k, runs) for (d, n, k, _, runs), m in got.items() for _ in range(m))


def test_first_occurrences_stay(spark):
    rows = [x for x in TEXTS if x[0] not in (6, 10, None)] + [(20, "one line\nend\nend")]
    found = line_dedup.dedup(frame(spark, rows), 2, keep_first=True)
    assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"], r["keep_runs"]) for r in found.collect()) == lines_brute(rows, 2, True)


def test_a_common_line_is_spread_over_ranges(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("common\n"), F.col("id").cast("string")).alias("text"))
    ranged = line_dedup.keys(rows).repartitionByRange(8, "a", "b", "id", "v").select(F.spark_partition_id().alias("part"), "a").groupBy("a").agg(F.count_distinct("part").alias("k"))
    assert ranged.agg(F.max("k")).first()[0] > 2
    assert line_dedup.dedup(rows).agg(F.sum("n_dropped")).first()[0] == 4000


def test_line_dedup_without_rows(spark):
    assert line_dedup.dedup(frame(spark, [])).collect() == [] == line_dedup.bitmaps(frame(spark, [])).collect()


def audit_brute(rows, labels):
    """rows: (doc_id, text, lang)."""
    marks = {}
    for doc_id, quality, toxic in labels:
        good, bad = marks.get(doc_id, (False, False))
        marks[doc_id] = (good or quality == 1, bad or toxic == 1)
    docs = []
    for doc_id, text, lang in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {x for x, bad in (("A", len(words) < 100), ("B", 100 * len(set(words)) < 80 * len(words)), ("C", 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text)), ("D", bool(set(text) & set("#$%&*|")))) if bad}
        if doc_id is not None and any(d is not None and d < doc_id and (t or "") == text for d, t, _ in rows):
            fails.add("E")
        docs.append((lang or "", fails, *(marks.get(doc_id, (False, False)) if doc_id is not None else (False, False))))
    out = []
    for part in {d[0] for d in docs}:
        own, share = [d for d in docs if d[0] == part], Counter()
        for order in permutations("ABCDE"):
            for step, name in enumerate(order):
                before = set(order[:step])
                here = [d for d in own if name in d[1] and not d[1] & before]
                share[name] += len(here)
                out.append([part, "".join(order), step + 1, sum(not d[1] & (before | {name}) for d in own), len(here), sum(name in d[1] and bool(d[1] & before) for d in own), sum(d[1] == {name} for d in own), sum(d[2] for d in here), sum(d[3] for d in here), name])
        for row in out:
            if row[0] == part:
                row[-1] = share[row[-1]]
    return Counter(map(tuple, out))


def audit_rows():
    made, rows = np.random.default_rng(1), []
    for i in range(60):
        words = [["alpha", "BETA", "gamma", "#tag", f"w{i}", "É", "x y"][j] for j in made.integers(0, 7, int(made.integers(0, 300)))]
        rows.append((i, " ".join(words) + " ".join(f"n{j}" for j in range(int(made.integers(0, 900)))), ["en", "de", None, ""][i % 4]))
    rows += [(100 + i, rows[i % 5][1], "en") for i in range(40)] + [(3, rows[3][1], "de")] * 3 + [(None, rows[0][1], "en"), (None, None, "en"), (200, None, "fr"), (201, "", "fr"), (200, None, "en")]
    return rows


def test_audit_of_all_orders(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "CHAIN_BYTES", 4000)
    rows = audit_rows()
    labels = [(i, i % 2, i % 3 == 0) for i in range(0, 150, 2)] + [(3, 1, 1), (3, 0, 0), (5, None, None), (None, 1, 1)]
    table = spark.createDataFrame([(d, t, g, 1, 2) for d, t, g in rows], "doc_id long, text string, lang string, mask int, part int").repartition(6)
    marks = spark.createDataFrame([(d, q, int(t) if t is not None else None) for d, q, t in labels], "doc_id long, quality int, toxic int")
    got = Counter(map(tuple, filter_audit.audit(table, marks).collect()))
    assert got == audit_brute(rows, labels)
    assert filter_audit.audit(table.limit(0), marks).collect() == []


def test_texts_with_one_fingerprint_are_told_apart(monkeypatch):
    monkeypatch.setattr(filter_audit.xxhash, "xxh64_intdigest", lambda body: 7)
    rows = [(2, "p", "a b"), (1, "p", "other"), (3, "p", "a b"), (4, "p", "other"), (1, "p", "other")]
    keyed = sorted((x for row in rows for x in filter_audit.routed([row], filter_audit.FILTERS)), key=lambda x: x[0])
    found = Counter(t for t in filter_audit.chained(iter(keyed), 16))
    assert {(d, mask >= 16): n for (d, _, mask, _), n in found.items()} == {(1, False): 2, (2, False): 1, (3, True): 1, (4, True): 1}


def clusters_brute(rows, k, rounds, seed, scale, dims):
    kept = [(i, [math.floor(Fraction(v) * scale) for v in x]) for i, x in rows if x is not None and len(x) == dims and all(v is not None and math.isfinite(v) for v in x)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    c = [x for _, x in order[:k]]
    far = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y))
    near = lambda x: min(range(len(c)), key=lambda j: (far(x, c[j]), j))
    for _ in range(rounds):
        at = [near(x) for _, x in kept]
        c = [[sum(v) // len(v) for v in zip(*own)] if (own := [x for (_, x), a in zip(kept, at) if a == j]) else c[j] for j in range(len(c))]
    done = [(i, near(x), x) for i, x in kept]
    own = Counter()
    for _, j, x in done:
        own[j] += far(x, c[j])
    fits = lambda v: v if v < 2**63 else None
    return Counter((i, j, fits(far(x, c[j])), fits(own[j]), fits(sum(own.values())), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, j, x in done)


def vectors(spark, rows, kind="double"):
    return spark.createDataFrame([(i, x, 1, "c") for i, x in rows], f"vec_id long, embedding array<{kind}>, id int, x string").repartition(4)


@pytest.mark.parametrize("k, dims, seed", [(1, 2, 3), (5, 3, 1), (12, 2, 4)])
def test_clusters_with_ties_and_odd_vectors(spark, k, dims, seed):
    made = np.random.default_rng(seed)
    rows = [(i, [float(v) for v in x]) for i, x in enumerate(np.round(made.normal(0, 2, (150, dims))))]  # a lattice: many equal distances
    rows += [(7, rows[7][1])] * 3 + [(None, rows[1][1]), (None, rows[1][1]), (500, None), (501, []), (502, [1.0] * (dims + 1)), (503, [None] + [0.0] * (dims - 1)), (504, [float("nan")] * dims), (505, [float("inf")] * dims)]
    got = Counter(map(tuple, centroids.cluster(vectors(spark, rows), k, 6, seed, 4, dims).collect()))
    assert got == clusters_brute(rows, k, 6, seed, 4, dims)


def test_clusters_of_huge_components_and_of_few_vectors(spark):
    rows = [(1, [1e300, 0.0]), (2, [-1.7e308, 5.0]), (3, [0.25, 1e18]), (4, [0.5, -1e18]), (5, [3e9, 3e9])]
    for k in (2, 8):
        assert Counter(map(tuple, centroids.cluster(vectors(spark, rows), k, 3, 3, 1024, 2).collect())) == clusters_brute(rows, k, 3, 3, 1024, 2)
    assert centroids.cluster(vectors(spark, rows).limit(0), 3, 2, 3, 1024, 2).collect() == []


def test_bounds_spare_distances(spark, monkeypatch):
    """Vectors in separate groups are looked at against few centroids once the bounds are known."""
    made = np.random.default_rng(0)
    x = (np.repeat(np.arange(10) * 10_000, 50)[:, None] + made.integers(0, 50, (500, 4))).astype(np.int64)
    c = x[::50].copy()
    block = centroids.Block(None, x, np.full(500, -1), np.full(500, np.inf), np.zeros(500))
    block = centroids.assigned(block, centroids.centres(c))
    looked = []
    plain = centroids.squares
    to = centroids.centres(c + 1, c)
    monkeypatch.setattr(centroids, "squares", lambda a, b: looked.append(len(a)) or plain(a, b))
    after = centroids.assigned(block, to)
    assert (after.at == np.repeat(np.arange(10), 50)).all() and sum(looked) < 500


def test_small_sources_are_spread_over_all_shards(spark):
    from tessera.llm import sharding

    rows = spark.range(8000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") % 2 == 0, F.lit("big")).otherwise(F.col("id").cast("string")).alias("source"))
    shares = sharding.shard(rows).groupBy("shard").agg(F.avg((F.col("source") == "big").cast("double")).alias("share"), F.count("*").alias("n")).collect()
    assert len(shares) == 40 and all(r["n"] == 200 and abs(r["share"] - 0.5) < 0.1 for r in shares)
    assert sum(abs(r["share"] - 0.5) for r in shares) / 40 < 0.05


def test_the_sample_has_one_row_for_each_labelled_id(spark):
    from tessera.llm import quality_model

    docs = spark.createDataFrame([(i, f"text {i}") for i in range(50)] + [(1, f"other {k}") for k in range(300)] + [(None, "x")], "doc_id long, text string").repartition(7)
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, quality int")
    found = quality_model.sample(docs, labels, "quality", 20).collect()
    assert len(found) == 20 == len({r["doc_id"] for r in found})
    assert sorted(found) == sorted(quality_model.sample(docs.repartition(3), labels, "quality", 20).collect())
