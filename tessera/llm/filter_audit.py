"""Filter interaction audit: what each filter of a cascade removes, in every order of the filters.

Texts are routed by fingerprint: pair RDDs are partitioned by the xxhash of a text and sorted by it and the id
within partitions, so the collision chain of a fingerprint (its different texts, each whole, with their least id)
is built while its rows stream by, and the ids that aren't the least of their text come out. Before that, each
task reduces the copies of a text that it has read to one, so a group of copies of any size sends one
row for each CHAIN_BYTES of texts read. A text fails the other filters by itself, so a document is then a
small mask of failures; vectors of counts by mask are merged by combineByKey for each part, and all
orders are worked out from the vectors.

The duplicate filter fails a document if a smaller doc_id anywhere has the identical text. Rows that agree in
both don't fail for each other; a null doc_id neither fails nor makes others fail. A null text is an empty one, a null
part the empty string. Labels that are missing or null count as 0; of several for a doc_id the
greatest counts. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator, Mapping
from itertools import count, permutations
from typing import NamedTuple

import numpy as np
import xxhash
import zstandard
from pyspark import RDD
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import documents, stage

#: Texts that a task holds while it reduces copies, and texts for each partition that they are routed to.
CHAIN_BYTES, PART_BYTES = 16 << 20, 64 << 20
#: More filters than this have too many orders to list.
MAX_FILTERS = 7
SYMBOLS = re.compile(rb"[#$%&*|]")
CAPITALS = bytes(range(65, 91))


class Text(NamedTuple):
    """What filters are told of a text: its UTF-8 bytes, its words between ASCII white space, and its code points."""

    body: bytes
    words: list[bytes]
    points: int


#: Filters of a text alone, by letter: true where it fails.
FILTERS: dict[str, Callable[[Text], bool]] = {
    "A": lambda t: len(t.words) < 100,
    "B": lambda t: 100 * len(set(t.words)) < 80 * len(t.words),
    "C": lambda t: 100 * (len(t.body) - len(t.body.translate(None, CAPITALS))) > 10 * t.points,
    "D": lambda t: SYMBOLS.search(t.body) is not None,
}
#: The filter of repeated texts.
DUPLICATE = "E"
Thin = tuple[int | None, str, int, int]  # doc_id, part, mask and how many such rows


def failures(text: str, filters: Mapping[str, Callable[[Text], bool]]) -> tuple[bytes, int]:
    """The text's bytes, and a bit for each filter that it fails."""
    body = text.encode("utf-8", "surrogatepass")
    seen = Text(body, body.split(), len(text))
    return body, sum(1 << i for i, fails in enumerate(filters.values()) if fails(seen))


def routed(rows: Iterator, filters: Mapping[str, Callable[[Text], bool]]) -> Iterator[tuple[tuple, tuple]]:
    """Rows (doc_id, part, text) to ((hash, doc_id), (thin rows, compressed text or None)).

    With a text: the least id of it here, with its rows. Without: rows whose outcome is known, dealt out by a count and the id.
    """
    duplicate, squeeze = 1 << len(filters), zstandard.ZstdCompressor(level=1).compress
    chain: dict[bytes, list] = {}  # text to mask, least id, and parts with counts
    held, dealt = 0, count()

    def known(doc_id, mask: int, parts: Mapping[str, int]) -> tuple[tuple, tuple]:
        return (xxhash.xxh64_intdigest(f"{next(dealt)}:{doc_id}"), 0), ([(doc_id, part, mask, n) for part, n in parts.items()], None)

    def flush() -> Iterator[tuple[tuple, tuple]]:
        for body, (mask, doc_id, parts) in chain.items():
            yield (xxhash.xxh64_intdigest(body), doc_id), ([(doc_id, part, mask, n) for part, n in parts.items()], squeeze(body))
        chain.clear()

    for doc_id, part, text in rows:
        body, mask = failures(text or "", filters)
        part = part or ""
        if doc_id is None:
            yield known(doc_id, mask, {part: 1})
        elif body not in chain:
            chain[body] = [mask, doc_id, Counter({part: 1})]
            held += len(body) + 200
            if held > CHAIN_BYTES:
                yield from flush()
                held = 0
        elif doc_id == (own := chain[body])[1]:
            own[2][part] += 1
        else:
            late, parts = (own[1], own[2]) if doc_id < own[1] else (doc_id, {part: 1})
            if doc_id < own[1]:
                own[1], own[2] = doc_id, Counter({part: 1})
            yield known(late, mask | duplicate, parts)
    yield from flush()


def chained(rows: Iterator[tuple[tuple, tuple]], duplicate: int) -> Iterator[Thin]:
    """routed() rows in the order of their keys to thin rows: of a text all but its least id get the bit duplicate."""
    at, chain, expand = None, [], zstandard.ZstdDecompressor().decompress
    for (fingerprint, doc_id), (thin, blob) in rows:
        if blob is None:
            yield from thin
            continue
        if fingerprint != at:
            at, chain = fingerprint, []
        text = expand(blob)
        least = next((x for body, x in chain if body == text), None)
        if least is None:
            chain.append((text, least := doc_id))
        yield from thin if doc_id == least else ((d, part, mask | duplicate, n) for d, part, mask, n in thin)


def masks(docs: DataFrame, filters: Mapping[str, Callable[[Text], bool]] = FILTERS, by: str = "lang", text: str = "text") -> RDD:
    """(doc_id, part, mask, n): n documents that fail the filters of mask, its last bit for repeated texts."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col(by).cast("string"), F.col(text)).rdd
    keyed = rows.mapPartitions(lambda part: routed(part, filters))
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    parts = max(size // PART_BYTES, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = keyed.repartitionAndSortWithinPartitions(parts, lambda key: key[0])
    return ordered.mapPartitions(lambda part: chained(part, 1 << len(filters)))


def vectors(thin: DataFrame, size: int) -> RDD:
    """thin(part, mask, n, good, toxic) to (part, counts by mask of documents, of good ones and of toxic ones)."""

    def add(counts: np.ndarray, row: tuple) -> np.ndarray:
        mask, n, good, toxic = row
        counts[0, mask] += n
        counts[1, mask] += n * good
        counts[2, mask] += n * toxic
        return counts

    pairs = thin.select("part", "mask", "n", "good", "toxic").rdd.map(lambda r: (r[0], tuple(r[1:])))
    return pairs.combineByKey(lambda row: add(np.zeros((3, size), np.int64), row), add, np.add)


def orders(part: str, counts: np.ndarray, names: list[str]) -> list[tuple]:
    """The result rows of one part: every order of the filters, step by step."""
    each = np.arange(counts.shape[1])
    bit = {name: 1 << i for i, name in enumerate(names)}
    rows, whole = [], Counter()
    for order in permutations(sorted(names)):
        before = 0
        for step, name in enumerate(order, 1):
            own = bit[name]
            gone, late = (each & own > 0) & (each & before == 0), (each & own > 0) & (each & before > 0)
            before |= own
            removed, good, toxic = (int(x) for x in counts[:, gone].sum(1))
            whole[name] += removed
            rows.append((part, "".join(order), step, int(counts[0, each & before == 0].sum()), removed, int(counts[0, late].sum()), int(counts[0, own]), good, toxic, name))
    return [(*row[:-1], whole[row[-1]]) for row in rows]


AUDIT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audit(docs: DataFrame, labels: DataFrame, filters: Mapping[str, Callable[[Text], bool]] = FILTERS, duplicate: str = DUPLICATE, by: str = "lang", text: str = "text") -> DataFrame:
    """A row for each part, order of all filters and step of it: what is kept after the step, and what its filter does there.

    removed: by this step; redundant: failing its filter but removed before; unique_fails: failing this filter only; good_lost and
    toxic_lost: removed with that label; shapley: the filter's removed, summed over all orders.
    """
    names = [*filters, duplicate]
    if len(names) > MAX_FILTERS or any(len(x) != 1 for x in names):
        raise ValueError(f"up to {MAX_FILTERS} filters with names of one letter")
    spark = docs.sparkSession
    thin = spark.createDataFrame(masks(docs, filters, by, text), "doc_id long, part string, mask int, n long", verifySchema=False)
    known = stage(
        labels.groupBy(F.col("doc_id").cast("long").alias("lid")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")),
        "audit-labels",
    )
    none = F.lit(0)
    joined = thin.join(known, F.col("doc_id") == F.col("lid"), "left").withColumns({"good": F.coalesce("good", none), "toxic": F.coalesce("toxic", none)})
    found = vectors(joined, 1 << len(names)).flatMap(lambda x: orders(x[0], x[1], names))
    return spark.createDataFrame(found, AUDIT, verifySchema=False)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP12_SQL = r"""
WITH words AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
known AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS bad FROM labels GROUP BY doc_id),
failed AS (SELECT doc_id, part, (len(w) < 100)::INT + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INT
  + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
  + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS mask FROM words),
counts AS (SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(bad), 0) AS bad FROM failed LEFT JOIN known USING (doc_id) GROUP BY part, mask),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS bit),
ordered AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31),
steps AS (SELECT filter_order, s::INT AS step, bits[s] AS own, list_sum(list_prepend(0, bits[1:s - 1]))::INT AS before FROM ordered, range(1, 6) t(s)),
found AS (SELECT part, filter_order, step, own,
  coalesce(sum(n) FILTER (WHERE mask & (own | before) = 0), 0) AS kept,
  coalesce(sum(n) FILTER (WHERE mask & own > 0 AND mask & before = 0), 0) AS removed,
  coalesce(sum(n) FILTER (WHERE mask & own > 0 AND mask & before > 0), 0) AS redundant,
  coalesce(sum(n) FILTER (WHERE mask = own), 0) AS unique_fails,
  coalesce(sum(good) FILTER (WHERE mask & own > 0 AND mask & before = 0), 0) AS good_lost,
  coalesce(sum(bad) FILTER (WHERE mask & own > 0 AND mask & before = 0), 0) AS toxic_lost
  FROM counts, steps GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM found
"""
