"""MinHash near-dedup: documents whose sets of word shingles have a Jaccard similarity of percent or more.

The operator alone links at PERCENT, the corpus stage keep() at STAGE_PERCENT.

Every set gets ROWS * BANDS universal-hash minima; bands of ROWS minima put likely pairs into
buckets. Equal sets are first reduced to one. In each bucket every member is compared with the
bucket's first and last member: sizes and signatures first, then the full sets. Verified links are joined
into components by alternating large-star and small-star.

A bucket that then still holds several components may hide links between other members. Its members
are compared across components by their rare shingles, without a cap: their shingles are ordered by
how many of the members have them, rarest first, and two sets of similarity percent have one in
common among the first n - ceil(percent * n / 100) + 1 of each; where it stands in both bounds what
they share, so text that a whole family has makes no candidates. Signatures and full sets decide. A
link of similarity 0.85 is missed if no band agrees, with probability (1 - 0.85**5)**32 = 7e-9, one
of 0.80 with 3e-6.

Words are runs of characters other than ASCII white space, with A-Z in lower case; they are hashed
modulo the prime 2**61 - 1, and so are shingles of them. A text of fewer words than a shingle is one
shingle; null and empty texts have none and are linked with nothing. Rows that share a doc_id are one
node, all their different sets with it: the links of each are its links, and each row is returned. A
null doc_id is a node too, before all others. An empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import documents, stage, utf8, without
from tessera.llm.components import components
from tessera.llm.repeats import NO_DOC
from tessera.llm.rolling import Ranges, U, mix, sequences
from tessera.llm.sentence_dedup import chunks, is_white

#: Production parameters.
SHINGLE, PERCENT, STAGE_PERCENT, ROWS, BANDS = 5, 85, 80, 5, 32
#: Bytes of text that are hashed at a time; rows of a block, in which members that share a rare shingle are compared; rows of one task's small groups; prefixes that a task holds as sets.
CHUNK, BLOCK, GROUP_ROWS, PREFIXES = 1 << 18, 1024, 4_000, 4_096


def hashes() -> tuple[np.ndarray, np.ndarray]:
    made = np.random.default_rng(20240229)
    draw = lambda: made.integers(0, 1 << 63, ROWS * BANDS, dtype=np.uint64) * U(2) + U(1)
    return draw(), draw()


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words of texts laid end to end, and where each text's begin; by pieces of CHUNK bytes."""
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    solid = ~is_white(data)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = solid[:-1], solid[1:]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    out = np.zeros(len(starts), U)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + CHUNK, "right")))
        base = starts[a]
        out[a:b] = Ranges(data[base : ends[b - 1]]).of(starts[a:b] - base, ends[a:b] - base)
        a = b
    return out >> U(3), np.searchsorted(starts, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text."""
    words, bounds = word_hashes(data, offsets)
    windows, short = sequences(words, SHINGLE), {k: sequences(words, k) for k in range(1, SHINGLE)}
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= SHINGLE:
            out.append(np.unique(windows[a : b - SHINGLE + 1]))
        else:
            out.append(mix(short[b - a][a : a + 1] + U(b - a)) if b > a else np.zeros(0, U))
    return out


def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, t, text) to (id, t, n, f1, f2, bands, sig)."""
    a, b = hashes()
    for batch in batches:
        data, offsets = utf8(batch.column(2))
        for lo, hi in chunks(offsets, CHUNK):
            sets = shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            sizes = np.array([len(s) for s in sets])
            some = np.flatnonzero(sizes)
            minima = np.full((len(sets), ROWS * BANDS), ~U(0))
            marks = np.zeros((2, len(sets)), U)
            if len(some):
                x, at = np.concatenate(sets), (np.cumsum(sizes) - sizes)[some]
                for k in range(ROWS * BANDS):
                    minima[some, k] = np.minimum.reduceat(x * a[k] + b[k], at)
                marks[0, some], marks[1, some] = np.add.reduceat(mix(x), at), np.add.reduceat(mix(x ^ a[0]), at)
            keys = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=U)), (len(sets), BANDS))
            for k in range(ROWS):
                keys = mix(keys * a[0] + minima[:, k::ROWS])
            bands = pa.ListArray.from_arrays(np.arange(0, len(sets) * BANDS + 1, BANDS, dtype=np.int32), pa.array(keys.view(np.int64).ravel()))
            sig = [row.tobytes() for row in (minima >> U(40)).astype(np.uint8)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i).slice(lo, hi - lo) for i in (0, 1)), pa.array(sizes, pa.int64()), *(pa.array(m.view(np.int64)) for m in marks), bands, pa.array(sig, pa.binary())],
                names=["id", "t", "n", "f1", "f2", "bands", "sig"],
            )


def with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(sid, text) to (sid, set)."""
    for batch in batches:
        data, offsets = utf8(batch.column(1))
        for lo, hi in chunks(offsets, CHUNK):
            sets = shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([s.tobytes() for s in sets], pa.binary())], names=["sid", "set"])


def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(sid, set) to (sid, token), a row for each shingle."""
    for batch in batches:
        for sid, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            tokens = np.frombuffer(s, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(tokens), sid)), pa.array(tokens)], names=["sid", "token"])


def min_agreement(percent: int) -> float:
    """Least agreement of signatures of a pair that is compared on full sets: six standard errors below percent."""
    p = percent / 100
    return p - 6 * (p * (1 - p) / (ROWS * BANDS)) ** 0.5


def linked(a: bytes, b: bytes, percent: int) -> bool:
    x, y = np.frombuffer(a, U), np.frombuffer(b, U)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def agree(percent: int):
    """Arrow batches of (u, v, sig, sig) to the (u, v) whose signatures agree well enough."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for i in (2, 3))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array((x == y).mean(1) >= min_agreement(percent)))

    return of


def verify(percent: int):
    """Arrow batches of (u, v, set, set) to the (u, v) that are linked."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [linked(a, b, percent) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(ok, pa.bool_()))

    return of


def across(rows: pd.DataFrame, sets: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Pairs of different components in blocks: rows(token, lo, hi, block, sid, comp, n, pos) that have a token at pos of n, and sets(sid_, sig_, dfs_, tokens_, start_), each once.

    The first token that a pair shares bounds what it shares: no more than stands behind pos in either.
    A pair whose bound at this token is too low isn't linked, or has shared an earlier one. Signatures
    that agree too little end the rest. Then prefixes (dfs and tokens in order, from place start on) are
    compared: up to where the shorter one ends, what they share is known, and behind it no more is shared
    than either set has left. A pair counts under the first token of its prefixes only.
    """
    rows = rows.sort_values(["token", "lo", "hi"], kind="stable")
    token, lo, hi, block, sid, comp, n, pos = (rows[c].to_numpy() for c in ("token", "lo", "hi", "block", "sid", "comp", "n", "pos"))
    sets = sets.sort_values("sid_")
    own, start = np.searchsorted(sets["sid_"].to_numpy(), sid), sets["start_"].to_numpy()
    fresh = np.append(True, (token[1:] != token[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]))
    group, left, at, found = np.cumsum(fresh), n - pos, np.arange(len(rows)), []
    sig, dfs, tokens = np.frombuffer(b"".join(sets["sig_"]), np.uint8).reshape(len(sets), -1), sets["dfs_"].to_list(), sets["tokens_"].to_list()
    prefix = lru_cache(maxsize=PREFIXES)(lambda k: (x := [*zip(dfs[k].tolist(), tokens[k].tolist())], frozenset(x)))

    def enough(most, i, j):
        return 100 * most >= percent * (n[i] + n[j] - most)

    def promising(i: int, j: int) -> bool:
        (x, inside), (y, other) = prefix(own[i]), prefix(own[j])
        both = inside & other
        if min(both)[1] != token[i]:
            return False
        end = min(x[-1], y[-1])
        rest = min(n[i] - start[own[i]] - bisect_right(x, end), n[j] - start[own[j]] - bisect_right(y, end))
        return enough(len(both) + rest, i, j)

    step = 0
    while len(at := at[at + step + 1 < len(rows)]):
        step += 1
        at = at[group[at] == group[at + step]]
        ok = (comp[at] != comp[at + step]) & ((lo[at] == hi[at]) | (block[at] != block[at + step])) & enough(np.minimum(left[at], left[at + step]), at, at + step)
        near = at[ok]
        near = near[(sig[own[near]] == sig[own[near + step]]).mean(1) >= min_agreement(percent)]
        near = near[np.array([promising(i, i + step) for i in near.tolist()], bool)]
        a, b = sid[near], sid[near + step]
        found.append(np.stack([np.maximum(a, b), np.minimum(a, b)], 1))
    return pd.DataFrame(np.concatenate(found) if found else np.zeros((0, 2), np.int64), columns=["u", "v"])


def pick(table: DataFrame, key: str, **columns: str) -> DataFrame:
    return table.select(F.col("sid").alias(key), *(F.col(c).alias(as_) for as_, c in columns.items()))


def likely_pairs(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Of pairs(u, v), those whose sizes and signatures allow a link."""
    sized = pairs.join(pick(reps, "u", nu="n", su="sig"), "u").join(pick(reps, "v", nv="n", sv="sig"), "v")
    fits = 100 * F.least("nu", "nv") >= percent * F.greatest("nu", "nv")
    return stage(sized.where(fits).select("u", "v", "su", "sv").mapInArrow(agree(percent), "u long, v long"), "likely")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs(u, v), those that are linked, by their full sets."""
    full = pairs.join(pick(sets, "u", x="set"), "u").join(pick(sets, "v", y="set"), "v").select("u", "v", "x", "y")
    return stage(full.mapInArrow(verify(percent), "u long, v long"), "links")


def rare_pairs(open_: DataFrame, sets: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """open_(sid, comp) to the pairs (u, v) of different components that may be linked, by prefixes of their rarest shingles."""
    tokens = sets.join(open_.select("sid"), "sid").select("sid", "set").mapInArrow(spread, "sid long, token long")
    seen = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")  # the others are rarest, and in one set only
    mine = tokens.join(seen, "token").groupBy("sid").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("shared"))
    sized = mine.join(reps.select("sid", "n"), "sid").join(open_, "sid")
    first = (F.col("n") - F.size("shared")).cast("int")
    placed = F.transform("shared", lambda x, i: F.struct(x["df"].alias("df"), x["token"].alias("token"), (first + i).alias("pos")))
    prefix = F.filter(placed, lambda x: x["pos"] < F.col("n") - F.ceil(percent * F.col("n") / 100) + 1)
    held = stage(sized.select("sid", "comp", "n", prefix.alias("prefix")), "prefixes")
    rows = held.select("sid", "comp", "n", F.inline("prefix")).drop("df")
    groups = rows.groupBy("token").agg(F.count("*").alias("m"), F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1")
    nb = F.ceil(F.col("m") / BLOCK).cast("int")
    here = rows.join(groups.select("token", nb.alias("nb")), "token").withColumn("block", F.expr("pmod(hash(sid), nb)"))
    paired = here.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    lo, hi = F.least("block", "other"), F.greatest("block", "other")
    parts = max(1, held.agg(F.sum(F.size("prefix"))).first()[0] or 0) // GROUP_ROWS + 1
    g = F.when(F.col("nb") == 1, F.pmod(F.hash("token"), F.lit(parts)).cast("long")).otherwise(F.xxhash64("token", lo, hi))
    keyed = paired.select(g.alias("g"), "token", lo.alias("lo"), hi.alias("hi"), "block", "sid", "comp", "n", "pos")
    beside = held.select("sid", F.col("prefix.df").alias("dfs"), F.col("prefix.token").alias("tokens"), F.get("prefix", F.lit(0))["pos"].alias("start")).join(reps.select("sid", "sig"), "sid")
    once = keyed.select("g", "sid").distinct().join(beside, "sid")  # a set's prefix goes to each group once, not with each of its rows
    once = once.select(F.col("g").alias("h"), *(F.col(c).alias(f"{c}_") for c in ("sid", "sig", "dfs", "tokens", "start")))
    return keyed.groupBy("g").cogroup(once.groupBy("h")).applyInPandas(lambda rows, sets: across(rows, sets, percent), "u long, v long")


def links(docs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """docs(id, t, text) and reps(sid, id, t, n, bands, sig), one row for each set, to links (u, v) that give its components."""
    buckets = reps.select("sid", F.explode("bands").alias("key"))
    shared = buckets.groupBy("key").agg(F.min("sid").alias("lead"), F.max("sid").alias("last"), F.count("*").alias("m")).where("m > 1")
    members = stage(buckets.join(shared, "key"), "members")
    ends = F.array(F.col("lead"), F.when(F.col("m") > 2, F.col("last")))
    stars = members.select("sid", F.explode(ends).alias("end")).where("sid <> end").select(F.greatest("sid", "end").alias("u"), F.least("sid", "end").alias("v")).distinct()
    involved = reps.join(members.select("sid").distinct(), "sid").select("sid", "id", "t")
    texts = docs.join(involved, ["id", "t"]).dropDuplicates(["id", "t"]).select("sid", "text")
    sets = stage(texts.mapInArrow(with_sets, "sid long, set binary"), "sets")
    first = confirmed(likely_pairs(stars, reps, percent), sets, percent)
    so_far = stage(components(first), "components").withColumnRenamed("id", "sid")
    placed = stage(members.where("m > 2").join(so_far, "sid", "left").select("key", "sid", F.coalesce("component", "sid").alias("comp")), "placed")
    mixed = placed.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("key")
    open_ = stage(placed.join(mixed, "key").select("sid", "comp").distinct(), "open")
    rest = confirmed(rare_pairs(open_, sets, reps, percent), sets, percent)
    return so_far.select(F.col("sid").alias("u"), F.col("component").alias("v")).unionByName(rest)


def near_duplicates(docs: DataFrame, text: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id and kept (it is the first of its component)."""
    body = F.col(text)
    nodes = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_DOC)).alias("id"), F.xxhash64(body).alias("t"), body.alias("text"))
    rows = stage(nodes.mapInArrow(signed, "id long, t long, n long, f1 long, f2 long, bands array<long>, sig binary"), "minhash")
    some = rows.where("n > 0")
    once = some.groupBy("f1", "f2").agg(F.min(F.struct("id", "t")).alias("x"), F.first(F.struct("n", "bands", "sig")).alias("y"))
    reps = stage(once.select(F.monotonically_increasing_id().alias("sid"), "f1", "f2", "x.*", "y.*"), "sets-once")
    by_set = reps.select("sid", F.col("id").alias("lead"), F.col("f1").alias("g1"), F.col("f2").alias("g2"))
    on = (F.col("f1") == F.col("g1")) & (F.col("f2") == F.col("g2"))
    empty = rows.where("n = 0").select("id", "n", F.lit(None).cast("long").alias("sid"), F.col("id").alias("lead"))
    placed = stage(some.join(by_set, on).select("id", "n", "sid", "lead").unionByName(empty), "documents")
    # Rows of one doc_id with several sets, or with one and none: their sets are linked.
    several = placed.groupBy("id").agg(F.min("sid").alias("own"), F.max("sid").alias("last"), F.count("sid").alias("k"), F.count("*").alias("m"))
    several = stage(several.where("own <> last or k > 0 and k < m").select("id", "own"), "repeated-ids")
    together = placed.join(several, "id").where("sid <> own").select(F.col("sid").alias("u"), F.col("own").alias("v"))
    found = components(links(nodes, reps, percent).unionByName(together)).withColumnRenamed("id", "sid")
    least = found.join(reps.select("sid", "id"), "sid").groupBy("component").agg(F.min("id").alias("label"))
    labels = found.join(least, "component").select(F.col("sid").alias("of"), "label")
    owned = placed.join(several.select(F.col("id").alias("_id"), "own"), F.col("id") == F.col("_id"), "left").withColumn("sid", F.coalesce("sid", "own"))
    lead = F.coalesce("label", "own_lead", "lead")
    own_lead = reps.select(F.col("sid").alias("_own"), F.col("id").alias("own_lead")).join(several.select(F.col("own").alias("_own")).distinct(), "_own")
    out = owned.join(labels, F.col("sid") == F.col("of"), "left").join(own_lead, F.col("own") == F.col("_own"), "left").withColumn("component_id", lead)
    real = lambda c: F.when(F.col(c) != NO_DOC, F.col(c))
    return out.select(real("id").alias("doc_id"), F.col("n").alias("n_shingles"), real("component_id").alias("component_id"), (F.col("id") == F.col("component_id")).alias("kept"))


def keep(docs: DataFrame, text: str = "text", percent: int = STAGE_PERCENT) -> DataFrame:
    """The documents that are the first of their component, with their own columns."""
    return without(docs, near_duplicates(docs, text, percent).where(~F.col("kept")).select("doc_id"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
