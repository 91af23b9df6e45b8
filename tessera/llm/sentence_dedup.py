"""Substring dedup by sliding sentence spans.

A text is cut at line breaks and after the stops of any script; ASCII ones and clause marks count only
before white space, with or without other ASCII punctuation between (quotes, brackets, markup). What
stands between two cuts is called a sentence here. Every run of several consecutive sentences with MIN_WORDS words or more counts; as a
longer run is covered by the shortest ones inside it, only these are hashed: from every sentence the
shortest forwards and the shortest backwards. A sentence of LONG_WORDS or more is such a run by
itself. The hashes are joined globally, and a sentence inside any run that isn't the first of its kind
(by doc_id, then place) is removed together with the white space after it.

Words are runs of other characters than ASCII white space; where scripts write without spaces, two
ideographs, kana or syllables count as one more. Runs are compared by two hashes modulo 2**61 - 1.

Null and empty texts have no sentences. A null doc_id comes before all others. Rows that agree in
doc_id and text are one document and get the same result; different texts under one doc_id are told
apart and ordered by a 64-bit hash. A run that comes twice in one text counts as a repeat. An empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import documents, stage, utf8
from tessera.llm.repeats import cut, keyed, pack
from tessera.llm.rolling import BASES, Ranges, U, firsts, mix, reduced, times
from tessera.llm.suffix_dedup import REPEAT, ROWS, RUN, table

#: Production parameters: the words of a run of several sentences, and of a sentence that is a run by itself.
MIN_WORDS, LONG_WORDS = 20, 20
#: Marks that end a sentence before white space, what may stand behind them, and stops that need no space (in UTF-8).
MARKS, PUNCTUATION = b".!?,;:", string.punctuation.encode()
STOPS = tuple(c.encode() for c in "\u3002\uff01\uff1f\uff1b\uff0c\u2026\u061f\u06d4\u061b\u0964\u0965\u1362\u104b")
#: First bytes of characters of scripts without spaces: U+3000 to U+DFFF.
WIDE = (0xE3, 0xED)
#: Bytes of text that are hashed at a time; a longer text is taken alone.
CHUNK = 1 << 20


def is_white(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def sentences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (without white space) of the sentences of texts laid end to end, and the words of each."""
    white, n = is_white(data), len(data)
    begins = np.zeros(n, bool)
    begins[offsets[:-1][offsets[:-1] < n]] = True
    index = np.arange(n)
    mark, punctuation = (np.isin(data, np.frombuffer(x, np.uint8)) for x in (MARKS, PUNCTUATION))
    other = np.where(punctuation, np.where(begins, index - 1, -1), index)  # what a mark before it doesn't reach past
    closed = np.maximum.accumulate(np.where(mark, index, -1)) > np.maximum.accumulate(other)
    breaks = begins.copy()
    breaks[1:] |= (data[:-1] == 10) | (white[1:] & closed[:-1])
    for stop in STOPS:
        k = len(stop)
        if n > k:
            hit = np.logical_and.reduce([data[i : n - k + i] == c for i, c in enumerate(stop)])
            breaks[np.flatnonzero(hit) + k] = True
    part, solid = np.cumsum(breaks), np.flatnonzero(~white)
    if not len(solid):
        return solid, solid, solid
    fresh = part[solid[1:]] != part[solid[:-1]]
    starts, ends = solid[np.append(True, fresh)], solid[np.append(fresh, True)] + 1
    word = ~white
    word[1:] &= white[:-1] | begins[1:]
    word[starts] = True
    count = np.concatenate([[0], np.cumsum(word)])
    wide = np.concatenate([[0], np.cumsum((data >= WIDE[0]) & (data <= WIDE[1]))])
    return starts, ends, count[ends] - count[starts] + (wide[ends] - wide[starts]) // 2


def run_hashes(each: np.ndarray, first: np.ndarray, size: np.ndarray, base: int) -> np.ndarray:
    """The hashes of runs of sentences from those of each; runs have few sentences."""
    each = each >> U(3)
    total = each[first] if len(first) else np.zeros(0, U)
    for k in range(1, int(size.max(initial=1))):
        more = np.flatnonzero(size > k)
        total[more] = reduced(times(total[more], U(base)) + each[first[more] + k])
    return mix(total + size.astype(U))


def runs_in(data: np.ndarray, offsets: np.ndarray, min_words: int, long_words: int) -> tuple[np.ndarray, ...]:
    """(row, first sentence, sentences, hash, hash) of the runs."""
    starts, ends, words = sentences(data, offsets)
    row = np.searchsorted(offsets, starts, "right") - 1
    n = len(starts)
    index = np.arange(n)
    total = np.concatenate([[0], np.cumsum(words)])
    head = np.searchsorted(row, row)  # the first sentence of the same text
    tail = np.searchsorted(row, row, "right")
    to = np.maximum(np.searchsorted(total, total[:-1] + min_words), index + 2)
    back = np.minimum(np.searchsorted(total, total[1:] - min_words, "right") - 1, index - 1)
    ahead, behind, alone = to <= tail, back >= head, words >= long_words
    first = np.concatenate([index[ahead], back[behind], index[alone]])
    stop = np.concatenate([to[ahead], index[behind] + 1, index[alone] + 1])
    pairs = np.unique(np.stack([first, stop], 1), axis=0) if len(first) else np.zeros((0, 2), np.int64)
    first, stop = pairs[:, 0], pairs[:, 1]
    both = [run_hashes(Ranges(data, base).of(starts, ends), first, stop - first, base) for base in BASES]
    return row[first], first - head[first], stop - first, *both


def chunks(offsets: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about so many bytes."""
    a = 0
    while a < len(offsets) - 1:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1)
        yield a, b
        a = b


def runs(min_words: int, long_words: int):
    """Arrow batches of (_d, _v, _text) to RUN and REPEAT rows; the length of loc counts sentences."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, variants = (np.asarray(batch.column(i)).astype(np.int64) for i in (0, 1))
            data, offsets = utf8(batch.column(2))
            found = []
            for a, b in chunks(offsets, CHUNK):
                row, *rest = runs_in(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], min_words, long_words)
                found.append((row + a, *rest))
            if not found:
                continue
            row, start, size, k1, k2 = (np.concatenate(x) for x in zip(*found))
            doc, variant, loc = docs[row], variants[row], pack(start, size)
            first = firsts([k1, k2], [doc, variant, loc])
            for kind, where in ((RUN, np.flatnonzero(first)), (REPEAT, np.flatnonzero(~first))):
                if len(where):
                    spread = k1[where] if kind == RUN else k1[where] ^ loc[where].view(np.uint64)
                    yield table(kind, spread, k2[where], doc[where], variant[where], loc[where])

    return of


def to_bytes(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in sentences to bytes, up to where the next sentence begins."""
    starts, _, _ = sentences(data, np.array([0, len(data)]))
    edges = np.append(starts, len(data))
    return edges[first], edges[first + size]


def dedup(docs: DataFrame, text: str = "text", min_words: int = MIN_WORDS, long_words: int = LONG_WORDS, texts: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document, and kept_text if asked for."""
    rows = keyed(docs, text)
    same = Window.partitionBy("kind", "k1", "k2").orderBy("_d", "_v", "loc")
    ranked = rows.mapInArrow(runs(min_words, long_words), ROWS).withColumn("_r", F.rank().over(same))
    places = stage(ranked.where((F.col("kind") == REPEAT) | (F.col("_r") > 1)).select("_d", "_v", "loc"), "sentence-runs")
    return cut(rows, places, to_bytes, texts)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(documents(spark, sf_dir))
