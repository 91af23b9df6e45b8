"""Line dedup: lines whose key many documents have go, or all of a key but its first; DataFrame functions only.

A line's key is the line without ASCII white space at its ends, A-Z in lower case. Keys are hashed to 128 bits,
and the rows (hash, document, position) are range-partitioned by hash and document and sorted within
the partitions. Each partition is then read once in that order: the rows of a key and document meet
there and leave their first position, and a key leaves its number of documents and its first
occurrence, one row a partition, whose merge is small. As the ranges are cut by document too, a key that a
third of all lines have is spread over many partitions.

What comes back to a document is no text but a keep bitmap, compressed to the lengths of its runs:
kept, dropped, kept and so on, from its first line.

A document is a doc_id with a text: rows that agree in both are one, and each is returned. A null doc_id is an
id like others; a null text is an empty one, which has one empty line. Lines with an empty key
always stay. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import LOWER, UPPER, WHITE, documents, lower_ascii, stage, variant

#: Documents that a key must be in to be dropped.
LEAST = 10


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def keys(docs: DataFrame, text: str = "text") -> DataFrame:
    """A row for each line that has a key: id, v (a hash of the text), p (the line's position) and the key's hashes a and b."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col("doc_id").alias("id"), variant(body).alias("v"), F.posexplode(lines(body)).alias("p", "line"))
    key = rows.select("id", "v", "p", lower_ascii(F.btrim("line", F.lit(WHITE))).alias("key")).where("key <> ''")
    return key.select("id", "v", "p", F.xxhash64("key").alias("a"), F.xxhash64("key", F.lit(1)).alias("b"))


def counted(rows: DataFrame) -> DataFrame:
    """keys() to a row for each key: a, b, n (its documents) and first(id, v, p), its first occurrence."""
    order = ["a", "b", "id", "v"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order, "p")
    per_document = ranged.groupBy(*order).agg(F.min("p").alias("p"))  # all rows of a group are in one range
    return per_document.groupBy("a", "b").agg(F.count("*").alias("n"), F.min(F.struct("id", "v", "p")).alias("first"))


def dropped_runs(docs: DataFrame, least: int = LEAST, keep_first: bool = False, text: str = "text") -> DataFrame:
    """id, v, and starts and ends, the first and last positions of the runs of lines that go; no row where all stay."""
    rows = stage(keys(docs, text), "line-keys")
    common = stage(counted(rows).where(F.col("n") >= least).select(F.col("a").alias("ka"), F.col("b").alias("kb"), "first"), "line-common")
    found = rows.join(common, (F.col("a") == F.col("ka")) & (F.col("b") == F.col("kb")))
    if keep_first:
        found = found.where(~F.struct("id", "v", "p").eqNullSafe(F.col("first")))
    q = F.col("q")
    runs = found.groupBy("id", "v").agg(F.array_sort(F.collect_set("p")).alias("q"))
    apart = lambda x, y: F.coalesce(x + 1 != y, F.lit(True))
    return runs.select(
        "id", "v",
        F.filter(q, lambda x, i: apart(F.get(q, i - 1), x)).alias("starts"),
        F.filter(q, lambda x, i: apart(x, F.get(q, i + 1))).alias("ends"),
    )


def with_runs(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """rows(id, v, ...) with starts and ends, empty where no line goes."""
    found = runs.select(F.col("id").alias("rid"), F.col("v").alias("rv"), "starts", "ends")
    joined = rows.join(found, F.col("id").eqNullSafe(F.col("rid")) & (F.col("v") == F.col("rv")), "left").drop("rid", "rv")
    return joined.withColumns({c: F.coalesce(c, F.array().cast("array<int>")) for c in ("starts", "ends")})


def kept_parts() -> Column:
    """Of starts, ends and n_lines, the array of kept runs (begin, size), one before each dropped run and one after all; sizes can be 0."""
    ends, starts = F.col("ends"), F.col("starts")
    begin = lambda i: F.coalesce(F.get(ends, i - 1) + 1, F.lit(0))
    part = lambda i: F.struct(begin(i).alias("begin"), (F.coalesce(F.get(starts, i), F.col("n_lines").cast("int")) - begin(i)).alias("size"))
    return F.transform(F.sequence(F.lit(0), F.size(starts)), part)


def keep_runs() -> Column:
    """The bitmap of starts, ends and n_lines: lengths of kept and dropped runs in turn, joined by commas."""
    starts, ends = F.col("starts"), F.col("ends")
    both = F.transform(kept_parts(), lambda x, i: F.array(x["size"], F.get(ends, i) - F.get(starts, i) + 1))
    return F.array_join(F.transform(F.flatten(both), lambda x: x.cast("string")), ",")  # the last has no dropped run: null, left out


def bitmaps(docs: DataFrame, least: int = LEAST, keep_first: bool = False, text: str = "text") -> DataFrame:
    """doc_id, n_lines, n_dropped and keep_runs of each document, without texts.

    Keys of least documents or more lose all lines, or all but the first by doc_id, text hash and position if keep_first.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    thin = docs.select(F.col("doc_id").alias("id"), variant(body).alias("v"), F.size(lines(body)).cast("long").alias("n_lines"))
    return with_runs(thin, dropped_runs(docs, least, keep_first, text)).select(F.col("id").alias("doc_id"), "n_lines", n_dropped(), keep_runs().alias("keep_runs"))


def n_dropped() -> Column:
    ends = F.aggregate("ends", F.lit(0).cast("long"), lambda s, x: s + x + 1)
    return (ends - F.aggregate("starts", F.lit(0).cast("long"), lambda s, x: s + x)).alias("n_dropped")


def dedup(docs: DataFrame, least: int = LEAST, keep_first: bool = False, text: str = "text") -> DataFrame:
    """bitmaps() with kept_text, the lines that stay, joined by line ends."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col("doc_id").alias("id"), variant(body).alias("v"), body.alias("body"))
    joined = with_runs(rows, dropped_runs(docs, least, keep_first, text)).withColumn("lines", lines(F.col("body"))).withColumn("n_lines", F.size("lines").cast("long"))
    kept = F.array_join(F.flatten(F.transform(kept_parts(), lambda x: F.slice("lines", x["begin"] + 1, x["size"]))), "\n")
    whole = F.when(F.size("starts") == 0, F.col("body")).otherwise(kept)
    return joined.select(F.col("id").alias("doc_id"), "n_lines", n_dropped(), whole.alias("kept_text"), keep_runs().alias("keep_runs"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(documents(spark, sf_dir)).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"), "keep_runs")


OP13_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents),
cut AS (SELECT r, doc_id, unnest(x) AS line, unnest(range(len(x))) AS p FROM docs),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS k FROM cut),
whole AS (SELECT r, doc_id, x, min(r) OVER (PARTITION BY doc_id, x) AS same FROM docs),
common AS (SELECT k FROM keyed JOIN whole USING (r) WHERE k <> '' GROUP BY k HAVING count(DISTINCT same) >= {LEAST}),
marked AS (SELECT r, keyed.doc_id, line, p, common.k IS NOT NULL AS gone FROM keyed LEFT JOIN common USING (k)),
grouped AS (SELECT *, p - row_number() OVER (PARTITION BY r, gone ORDER BY p) AS g FROM marked),
runs AS (SELECT r, gone, min(p) AS a, count(*) AS n FROM grouped GROUP BY r, gone, g),
bits AS (SELECT r, CASE WHEN arg_min(gone, a) THEN '0,' ELSE '' END || string_agg(n::VARCHAR, ',' ORDER BY a) || CASE WHEN arg_max(gone, a) THEN ',0' ELSE '' END AS keep_runs FROM runs GROUP BY r)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (WHERE NOT gone), '')) AS kept_sha256, min(keep_runs) AS keep_runs
FROM marked JOIN bits USING (r) GROUP BY r, doc_id
"""
