"""Byte-level BPE encoding and decoding.

A text is cut at the special tokens, then into pieces by the pattern of byte-level BPE. The bytes of
a piece form a doubly linked list; a priority queue holds the ranks of its mergeable neighbours, and
an entry whose symbols have changed since it was pushed is stale and skipped. Decoding concatenates
the vocabulary strings. Pieces are remembered in a bounded table for each Python worker.

Null and empty texts have no tokens; repeated rows and ties each get their own result; an empty
table gives an empty result; further columns are ignored. Texts of any length are encoded whole.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import documents

#: Fixed value: the pattern of byte-level BPE, as published with the public tokenizers.
PIECE = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces that a worker remembers, and the longest piece that it does.
CACHE_PIECES, CACHE_LETTERS = 400_000, 64


def byte_letters() -> dict[str, int]:
    """Printable stand-ins for the 256 bytes: themselves where printable, else the letters from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class Bpe:
    """A tokenizer from the text of a tokenizer.json file with a byte-level BPE model."""

    def __init__(self, spec: str):
        model, letters = json.loads(spec), byte_letters()
        special = {t["content"]: t["id"] for t in model["added_tokens"]}
        as_bytes = lambda token: bytes(letters[c] for c in token)
        vocab = {as_bytes(t): i for t, i in model["model"]["vocab"].items() if t not in special}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"])
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(pairs):
            a, b = as_bytes(a), as_bytes(b)
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.single = [vocab[bytes([b])] for b in range(256)]
        self.strings = {i: s for s, i in vocab.items()} | {i: t.encode() for t, i in special.items()}
        self.special = special
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.pieces = regex.compile(PIECE)
        self.known: dict[str, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """The ids of one piece."""
        ids = [self.single[b] for b in piece]
        n = len(ids)
        if n == 1:
            return (ids[0],)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        queue = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := self.merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(queue)
        while queue:
            _, i, left, right, merged = heapq.heappop(queue)
            j = after[i]
            if ids[i] != left or j < 0 or ids[j] != right:
                continue  # stale: one of the two has been merged since
            ids[i], ids[j] = merged, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if m := self.merges.get((merged, ids[k])):
                    heapq.heappush(queue, (m[0], i, merged, ids[k], m[1]))
            if (h := before[i]) >= 0 and (m := self.merges.get((ids[h], merged))):
                heapq.heappush(queue, (m[0], h, ids[h], merged, m[1]))
        return tuple(t for t in ids if t >= 0)

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        known, extend = self.known, out.extend
        for k, part in enumerate(self.cut.split(text) if self.cut else [text]):
            if k % 2:
                out.append(self.special[part])
                continue
            for piece in self.pieces.findall(part):
                ids = known.get(piece)
                if ids is None:
                    ids = self.merge(piece.encode())
                    if len(piece) <= CACHE_LETTERS:
                        if len(known) >= CACHE_PIECES:
                            known.clear()
                        known[piece] = ids
                extend(ids)
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def tokenizer(spec: str) -> Bpe:
    return Bpe(spec)


def encode(docs: DataFrame, tokenizer_path: str, digest: bool = False) -> DataFrame:
    """docs(doc_id, text) to (doc_id, n_tokens, ids, decoded), or with digests in place of the last two.

    tokenizer_path: a tokenizer.json file on the driver, of a few MB; it is broadcast.
    """
    spec = docs.sparkSession.sparkContext.broadcast(open(tokenizer_path, encoding="utf-8").read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(spec.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                n, ids, back = [], [], []
                for text in part.column(1).to_pylist():
                    got = bpe.encode(text or "")
                    n.append(len(got))
                    decoded = bpe.decode(got)
                    ids.append(hashlib.sha256(np.asarray(got, "<u4").tobytes()).hexdigest() if digest else got)
                    back.append(hashlib.sha256(decoded.encode()).hexdigest() if digest else decoded)
                kinds = (pa.string(), pa.string()) if digest else (pa.list_(pa.int64()), pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(ids, kinds[0]), pa.array(back, kinds[1])], names=names)

    names = ["doc_id", "n_tokens", *(("ids_sha256", "decoded_sha256") if digest else ("ids", "decoded"))]
    kinds = ("string", "string") if digest else ("array<bigint>", "string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    return rows.mapInArrow(run, f"doc_id bigint, n_tokens bigint, {names[2]} {kinds[0]}, {names[3]} {kinds[1]}")


def default_tokenizer() -> str:
    """The place of the public 50k byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(documents(spark, sf_dir), default_tokenizer(), digest=True)
