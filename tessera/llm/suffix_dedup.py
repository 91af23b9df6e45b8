"""Exact substring dedup: every byte inside a 100-byte string that also starts earlier is removed.

This is a radix sort of all suffixes, most significant digits first and only as deep as the threshold
of 100 bytes; after each pass groups of one are left out, and the groups of the last are exactly the
repeated windows. The bytes of a window are taken in an order that lets neighbours share digits:

1. The first digit of a window is its anchor: of the 24-byte grams inside it, the one with the least
   hash. Equal windows have equal anchors at equal offsets, and a run of neighbouring windows has one
   anchor, about one run for 40 bytes of text: a row.
2. The second digit goes to both sides of the anchor. The windows that begin PART neighbouring places
   before it have 100 - PART + 1 bytes in common: a row for each such part of a run. It carries its
   bytes, so texts are fetched once.
3. The third digit is the rest of the window: a row for each window that is left.

In the first two passes, rows with equal bytes are repeats as a whole; the first of each goes on where
its group has others. Batches settle repeats inside themselves, so a passage in a third of all
documents sends a row a batch. A group that has many different rows in one batch goes on at once; a
mark of it sends on the rows that other batches hold there too. Bytes are compared by two hashes
modulo 2**61 - 1 with different bases: different windows agree with a probability below 2**-108.

Null and empty texts have no bytes; texts shorter than a window keep all. A null doc_id comes before
all others. Rows that agree in doc_id and text are one document and get the same result; different
texts under one doc_id are told apart and ordered by a 64-bit hash. Equal windows that overlap in one
text count, as any others. An empty table gives an empty result; other columns are ignored. Offsets
are bytes; a kept text may be cut inside a character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import documents, stage, utf8
from tessera.llm.repeats import cut, flat, keyed, pack, unpack, with_places
from tessera.llm.rolling import BASES, Ranges, U, firsts, sliding_min

#: Production parameters: bytes of a window and of an anchor, and neighbouring windows of a part.
WINDOW, GRAM, PART = 100, 24, 20
#: Window starts that are hashed at a time, rows that are cut out at a time, and the rows of one group in a batch from which all go on.
CHUNK, SLICE, COMMON = 1 << 19, 20_000, 16
#: MARK is of the same group as RUN, modulo 3.
RUN, REPEAT, DEEP, MARK = 0, 1, 2, 3
ROWS = "kind int, k1 long, k2 long, _d long, _v long, loc long"


def table(kind, k1, k2, doc, variant, loc) -> pa.RecordBatch:
    columns = [pa.array(np.broadcast_to(kind, len(loc)).astype(np.int32)), *(pa.array(np.ascontiguousarray(x).view(np.int64)) for x in (k1, k2, doc, variant, loc))]
    return pa.RecordBatch.from_arrays(columns, names=["kind", "k1", "k2", "_d", "_v", "loc"])


def thinned(k1, k2, doc, variant, loc) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(kind, rows, group keys, other keys) of what a batch sends on: RUN, REPEAT, DEEP and MARK rows.

    The keys of rows that aren't to be grouped are spread.
    """
    first = firsts([k1, k2], [doc, variant, loc])
    again, where = np.flatnonzero(~first), np.flatnonzero(first)
    _, back, count = np.unique(k1[where], return_inverse=True, return_counts=True)
    deep = where[count[back] > COMMON]
    mark = deep[np.unique(k1[deep], return_index=True)[1]]
    yield REPEAT, again, k2[again] ^ loc[again].view(U), k1[again]
    yield DEEP, deep, k2[deep], k1[deep]
    yield MARK, mark, k1[mark], k2[mark]
    rest = where[count[back] <= COMMON]
    yield RUN, rest, k1[rest], k2[rest]


def runs_of(data: np.ndarray, offsets: np.ndarray, window: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, start, windows, the anchor's place after it, anchor hash, hash of the run's bytes) of the runs of windows with one anchor, by chunks."""
    n = len(data)
    for a in range(0, n, CHUNK):
        b = min(n, a + CHUNK + window - 1)
        if b - a < window:
            break
        grams = Ranges(data[a:b]).fixed(gram)
        place = np.arange(len(grams), dtype=U)
        anchors = (sliding_min((grams & ~U(2 * CHUNK - 1)) | place, window - gram + 1) & U(2 * CHUNK - 1)).astype(np.int64)
        starts = np.arange(len(anchors))
        r0, r1 = int(np.searchsorted(offsets, a, "right")) - 1, int(np.searchsorted(offsets, a + len(anchors)))
        ends = np.repeat(offsets[r0 + 1 : r1 + 1], np.diff(np.clip(offsets[r0 : r1 + 1], a, a + len(anchors))))
        whole = starts + a + window <= ends
        head = whole.copy()
        head[1:] &= ~(whole[:-1] & (anchors[1:] == anchors[:-1]))
        first = np.flatnonzero(head)
        if not len(first):
            continue
        stop = whole & ~np.append(whole[1:] & (anchors[1:] == anchors[:-1]), False)
        size = np.flatnonzero(stop) - first + 1
        row = np.searchsorted(offsets, first + a, "right") - 1
        yield row, first + a - offsets[row], size, anchors[first] - first, grams[anchors[first]], Ranges(data[a:b], BASES[1]).of(first, first + size + window - 1)


def runs(window: int, gram: int):
    """The first digit: Arrow batches of (_d, _v, _text) to rows of runs."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, variants = (np.asarray(batch.column(i)).astype(np.int64) for i in (0, 1))
            data, offsets = utf8(batch.column(2))
            found = [*runs_of(data, offsets, window, gram)]
            if not found:
                continue
            row, start, size, inner, anchor, body = (np.concatenate(x) for x in zip(*found))
            doc, variant, loc = docs[row], variants[row], pack(start, size, inner)
            for kind, rows, k1, k2 in thinned(anchor, body, doc, variant, loc):
                if len(rows):
                    yield table(kind, k1, k2, doc[rows], variant[rows], loc[rows])

    return of


def hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """The hashes of short ranges of data, by chunks of their starts."""
    out = np.zeros(len(starts), U)
    for a in range(0, len(data), CHUNK):
        inside = np.flatnonzero((starts >= a) & (starts < a + CHUNK))
        if len(inside):
            out[inside] = Ranges(data[a : ends[inside].max()], base).of(starts[inside] - a, ends[inside] - a)
    return out


def pieces(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The bytes of ranges as a binary column."""
    edges = np.concatenate([[0], np.cumsum(sizes)])
    places = np.arange(edges[-1]) + np.repeat(starts - edges[:-1], sizes)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(data[places].tobytes())])


def parts(window: int, width: int):
    """The second digit: Arrow batches of (_d, _v, _text, locs of runs) to rows of parts, with their bytes unless they are settled."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                yield from some(whole.slice(at, 2048))

    def some(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        docs, variants = (np.asarray(batch.column(i)).astype(np.int64) for i in (0, 1))
        data, offsets = utf8(batch.column(2))
        locs, row = flat(batch.column(3))
        if not len(locs):
            return
        start, size, inner = unpack(locs)
        low, high = (inner - size + 1) // width, inner // width  # of the places before the anchor, the first part and the last
        n = high - low + 1
        at = np.repeat(np.arange(len(locs)), n)
        q = np.repeat(low, n) + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        anchor = (start + inner)[at]
        begin = np.maximum(anchor - q * width - width + 1, start[at])
        last = np.minimum(anchor - q * width, (start + size - 1)[at])
        shift, row = offsets[row[at]], row[at]
        core = hashed(data, shift + anchor - q * width, shift + anchor - q * width + window - width + 1, BASES[0])
        body = hashed(data, shift + begin, shift + last + window, BASES[1])
        doc, variant, loc = docs[row], variants[row], pack(begin, last - begin + 1)
        for kind, every, k1, k2 in thinned(core, body, doc, variant, loc):
            for a in range(0, len(every), SLICE):
                rows, some_ = every[a : a + SLICE], slice(a, a + SLICE)
                made = table(kind, k1[some_], k2[some_], doc[rows], variant[rows], loc[rows])
                sizes = (last - begin)[rows] + window if kind in (RUN, DEEP) else np.zeros(len(rows), np.int64)
                yield made.append_column("body", pieces(data, (shift + begin)[rows], sizes))

    return of


def windows(window: int):
    """The third digit: Arrow batches of (_d, _v, loc, body) to rows of single windows."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body = batch.column(3).cast(pa.large_binary())
            edges = np.frombuffer(body.buffers()[1], np.int64)[body.offset : body.offset + len(body) + 1]
            data = np.frombuffer(body.buffers()[2], np.uint8)[edges[0] : edges[-1]]
            edges = edges - edges[0]
            docs, variants, locs = (np.asarray(batch.column(i)).astype(np.int64) for i in range(3))
            start, size, _ = unpack(locs)
            row = np.repeat(np.arange(len(locs)), size)
            step = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            at = edges[row] + step
            k1, k2 = (hashed(data, at, at + window, base) for base in BASES)
            doc, variant, loc = docs[row], variants[row], pack(start[row] + step, np.ones_like(step))
            first = firsts([k1, k2], [doc, variant, loc])
            for kind, where in ((RUN, np.flatnonzero(first)), (REPEAT, np.flatnonzero(~first))):
                if len(where):
                    yield table(kind, k1[where], k2[where], doc[where], variant[where], loc[where])

    return of


def grouped(rows: DataFrame) -> tuple[DataFrame, Column, Column]:
    """Rows of a digit without groups of one, and which of them repeat others, and which go on to the next digit."""
    group = Window.partitionBy("_g", "k1")
    inside = Window.partitionBy("_g", "k1", "k2", "kind").orderBy("_d", "_v", "loc")
    placed = (
        rows.withColumn("_g", F.col("kind") % 3)
        .withColumn("_n", F.count("*").over(group))
        .where((F.col("kind") != RUN) | (F.col("_n") > 1))
        .withColumn("_r", F.rank().over(inside))
        .withColumn("_other", (F.min("k2").over(group) != F.max("k2").over(group)) | (F.max("kind").over(group) == MARK))
    )
    again = (F.col("kind") == REPEAT) | (F.col("kind") == RUN) & (F.col("_r") > 1)
    return placed, again, ~again & ((F.col("kind") == DEEP) | (F.col("kind") == RUN) & F.col("_other"))


def repeated(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, width: int = PART) -> DataFrame:
    """keyed docs to the places (_d, _v, loc) of all windows that start earlier too; loc's length counts windows."""
    place = ["_d", "_v", "loc"]
    rows, again, on = grouped(docs.mapInArrow(runs(window, gram), ROWS))
    first = stage(rows.where(again | on).select(again.alias("again"), *place), "runs")
    open_ = with_places(docs, first.where(~F.col("again")).select(*place), "inner").select("_d", "_v", "_text", "locs")
    rows, again, on = grouped(open_.mapInArrow(parts(window, width), f"{ROWS}, body binary"))
    second = stage(rows.where(again | on).select(again.alias("again"), *place, F.when(~again, F.col("body")).alias("body")), "parts")
    rows = second.where(~F.col("again")).select(*place, "body").mapInArrow(windows(window), ROWS)
    same = Window.partitionBy("kind", "k1", "k2").orderBy("_d", "_v", "loc")
    third = rows.withColumn("_r", F.rank().over(same)).where((F.col("kind") == REPEAT) | (F.col("_r") > 1))
    settled = lambda digit: digit.where("again").select(*place)
    return settled(first).unionByName(settled(second)).unionByName(stage(third.select(*place), "windows"))


def dedup(docs: DataFrame, text: str = "text", window: int = WINDOW, gram: int = GRAM, texts: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document, and kept_text if asked for."""
    rows = keyed(docs, text)
    return cut(rows, repeated(rows, window, gram), lambda _, start, size: (start, start + size + window - 1), texts)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(documents(spark, sf_dir))
