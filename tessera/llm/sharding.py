"""Shards that all match the mixture of sources; DataFrame functions only.

Within each source the rows are shuffled by a seeded hash and ranked; a row's fractional rank is
(rank from 0 + u) / rows of its source, with u from 0 to 1 out of the same hash. All rows are sorted by fractional rank and
cut into equal runs, so every shard holds its share of every source, the rows of many small sources together are spread
evenly too, and the counts of two shards differ by one at most.

Both ranks come from counts of buckets of the sort key plus a row number within a bucket, so no
source and no sort goes through one task: a source is split by its hash into as many buckets as the whole table needs for
BUCKET_ROWS rows each, and the fractional ranks are spread evenly.

A null source is a source of its own; a null text has no bytes; a null doc_id is shuffled by the word null. Rows that agree in id and text are
interchangeable; each gets a slot of its own. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import documents, stage

SHARDS, SEED = 40, "tessera"
#: Buckets at least, and rows of one in the mean.
BUCKETS, BUCKET_ROWS = 1024, 100_000
ROW_OVERHEAD = 16
#: Fractions are of 32 bits.
UNIT = 1 << 32


def below(rows: DataFrame, within: list[str], bucket: str, order: list[Column]) -> DataFrame:
    """rows with _rank (from 0) by bucket and order within a group, and _of, the rows of the group."""
    counts = rows.groupBy(*within, bucket).agg(F.count("*").alias("_n"))
    group = Window.partitionBy(*(within or [F.lit(0)]))
    before = counts.select(
        *(F.col(c).alias(f"_{c}") for c in [*within, bucket]),
        (F.sum("_n").over(group.orderBy(bucket)) - F.col("_n")).alias("_before"),
        F.sum("_n").over(group).alias("_of"),
    )
    match = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in [*within, bucket]]
    numbered = rows.withColumn("_i", F.row_number().over(Window.partitionBy(*within, bucket).orderBy(*order)))
    joined = numbered.join(before, match, "left")
    return joined.withColumn("_rank", F.col("_before") + F.col("_i") - 1).drop("_i", "_before", *(f"_{c}" for c in [*within, bucket]))


def shard(docs: DataFrame, shards: int = SHARDS, seed: str = SEED, source: str = "source", text: str = "text") -> DataFrame:
    """One row for each document: doc_id, size, text_crc32, source, shard and slot."""
    body = F.coalesce(F.col(text), F.lit(""))
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    thin = docs.select(
        "doc_id",
        F.col(source).alias("source"),
        (F.octet_length(body) + ROW_OVERHEAD).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.substring(digest, 1, 16).alias("h"),
        (F.conv(F.substring(digest, 17, 8), 16, 10).cast("double") / UNIT).alias("u"),
    )
    thin = stage(thin, "shard-rows")
    buckets = max(BUCKETS, thin.count() // BUCKET_ROWS)
    thin = thin.withColumn("b", F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("double") / UNIT * buckets))
    by_source = below(thin, ["source"], "b", [F.col("h"), F.col("doc_id"), F.col("text_crc32")])
    ranked = stage(by_source.select("doc_id", "source", "size", "text_crc32", "h", ((F.col("_rank") + F.col("u")) / F.col("_of")).alias("f")), "shard-ranks")
    cut = below(ranked.withColumn("b", F.floor(F.col("f") * buckets)), [], "b", [F.col("f"), F.col("source"), F.col("h"), F.col("doc_id"), F.col("text_crc32")])
    return cut.withColumn("shard", F.expr(f"_rank * {shards} div _of").cast("int")).select(
        "doc_id", "source", "size", "text_crc32", "shard",
        (F.col("_rank") - F.expr(f"(shard * _of + {shards - 1}) div {shards}")).alias("slot"),
    )


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(documents(spark, sf_dir)).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


#: The checksum is worked out byte by byte, from a table of its 256 steps.
OP4_SQL = r"""
WITH bits AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n::BIGINT, range(8)::BIGINT[]),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc
), bytes AS (
  SELECT doc_id, source, coalesce(text, '') AS t, hex(encode(coalesce(text, ''))) AS x FROM documents
), sized AS (
  SELECT doc_id, source, length(x) // 2 + 16 AS size,
    xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(x, '..'),
      lambda b: (16 * (strpos('0123456789ABCDEF', b[1]) - 1) + strpos('0123456789ABCDEF', b[2]) - 1)::BIGINT)),
      lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]))) AS text_crc32,
    md5('tessera:' || coalesce(doc_id::VARCHAR, 'null')) AS m, substr(m, 1, 16) AS h, ('0x' || substr(m, 17, 8))::BIGINT / 4294967296::DOUBLE AS u
  FROM bytes, bits
), ranked AS (
  SELECT *, (row_number() OVER (PARTITION BY source ORDER BY h, doc_id NULLS FIRST, text_crc32) - 1 + u)
    / count(*) OVER (PARTITION BY source) AS f FROM sized
), cut AS (
  SELECT *, row_number() OVER (ORDER BY f, source NULLS FIRST, h, doc_id NULLS FIRST, text_crc32) - 1 AS r, count(*) OVER () AS n FROM ranked
)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'rows' AS law, (r * 40 // n)::INTEGER AS shard,
  (r - ((r * 40 // n) * n + 39) // 40)::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM cut
"""
