"""Shared by the substring operators: which rows of a key come first, and cutting spans out of texts.

An occurrence is (k1, k2, doc, variant, loc): two hashes of content, the document, a 64-bit hash that
tells apart texts under one doc_id, and a packed place. Loc holds the start in bytes, then an inner
offset and a length of 7 bits each.
Occurrences are thinned where they are made: of equal keys in one batch only the first goes on and
the others are known to be repeats. A key then has one row a batch at most, however common it is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import utf8, variant

PART_BITS = 7
NO_DOC = -(1 << 63)


def pack(starts: np.ndarray, lengths: np.ndarray, inner: np.ndarray | int = 0) -> np.ndarray:
    return (starts.astype(np.int64) << (2 * PART_BITS)) | (np.int64(inner) << PART_BITS if isinstance(inner, int) else inner.astype(np.int64) << PART_BITS) | lengths.astype(np.int64)


def unpack(loc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and inner offsets."""
    least = (1 << PART_BITS) - 1
    return loc >> (2 * PART_BITS), loc & least, (loc >> PART_BITS) & least


def keyed(docs: DataFrame, text: str = "text") -> DataFrame:
    """_d (doc_id; the least long if null), _v and _text (null: empty)."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_DOC)).alias("_d"), variant(body).alias("_v"), body.alias("_text"))


def with_places(docs: DataFrame, places: DataFrame, how: str) -> DataFrame:
    """keyed docs with locs, the places(_d, _v, loc) of each document (null: none); a document's are at most a few for each of its bytes."""
    found = places.groupBy(F.col("_d").alias("_gd"), F.col("_v").alias("_gv")).agg(F.collect_set("loc").alias("locs"))
    return docs.join(found, (F.col("_d") == F.col("_gd")) & (F.col("_v") == F.col("_gv")), how).drop("_gd", "_gv")


def flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column, and the row of each."""
    sizes = np.nan_to_num(np.asarray(pa.compute.list_value_length(lists).fill_null(0))).astype(np.int64)
    return np.asarray(lists.drop_null().flatten() if lists.null_count else lists.flatten()).astype(np.int64), np.repeat(np.arange(len(lists)), sizes)


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of n bytes, those inside any of the ranges."""
    depth = np.zeros(n + 1, np.int32)
    np.add.at(depth, starts, 1)
    np.add.at(depth, ends, -1)
    return np.cumsum(depth[:n]) > 0


def cut(docs: DataFrame, places: DataFrame, ranges: Callable, texts: bool = False) -> DataFrame:
    """Every document with its ranges removed; ranges(bytes, starts, lengths) turns places into byte starts and ends.

    doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept_sha256, or kept_text too if asked for.
    """
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
    fields += [("kept_text", pa.string())] * texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            locs, row = flat(batch.column(2))
            starts, lengths, _ = unpack(locs)
            bounds = np.searchsorted(row, np.arange(batch.num_rows + 1))
            out: list[list] = [[] for _ in fields]
            for i, doc in enumerate(batch.column(0).to_pylist()):
                body, mine = data[offsets[i] : offsets[i + 1]], slice(bounds[i], bounds[i + 1])
                n, runs = len(body), 0
                if mine.start < mine.stop:
                    gone = covered(n, *ranges(body, starts[mine], lengths[mine]))
                    runs = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
                    body = body[~gone]
                kept = body.tobytes()
                values = [None if doc == NO_DOC else doc, n, n - len(kept), runs, hashlib.sha256(kept).hexdigest()]
                for column, value in zip(out, values + [kept.decode("utf-8", "replace")] * texts):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(out, fields)], names=[f for f, _ in fields])

    rows = with_places(docs, places, "left").select("_d", "_text", "locs")
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * texts)
