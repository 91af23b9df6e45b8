"""Rule-based quality verdicts with a second look at hosts; DataFrame functions only.

Every document gets its counts and a base verdict. Hosts (by default the column source) are then
judged by the share of their documents that fail: the share is shrunk by a beta prior, so that small
hosts lean on the rest, and a document of a host whose shrunk share is over the limit is rejected too.
The prior is fitted to all hosts by moments that allow for their sizes and for chance: its mean is the
share of all documents, and of the spread of hosts' shares only what drawing documents doesn't explain
counts. Without such a rest, hosts have the mean; with no more than that, a host has its own share.

Null and empty texts have no words and fail the base rules. A null host is a host of its own.
Repeated rows count once each; an empty table gives an empty result; other columns are ignored.
Windows of five words are compared by a 64-bit hash within one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import WHITE, documents, stage, white_words

SYMBOLS = "#*$%&|<>"
#: Production parameters: least words, most repeated words in a hundred, most failures of a host.
MIN_WORDS, MAX_REPEATED_PERCENT, MAX_HOST_FAILURES = 10, 20, 0.5
WINDOW = 5
#: Rejected hosts that are broadcast; more are joined by a shuffle, in which a host with very many documents is split.
BROADCAST_HOSTS = 500_000


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    body, keep = F.coalesce(F.col(text), F.lit("")), docs.columns
    window_key = lambda words: F.transform(
        F.sequence(F.lit(0), F.size(words) - WINDOW),
        lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(WINDOW))),
    )
    counted = docs.withColumns(
        {
            "_words": white_words(body),
            "_lines": F.filter(F.split(body, "\n"), lambda line: F.translate(line, WHITE, "") != ""),
            "word_chars": F.length(F.translate(body, WHITE, "")).cast("long"),
            "n_symbols": (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long"),
        }
    )
    keyed = counted.select(
        *keep,
        F.size("_words").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("_words") > WINDOW, window_key(F.col("_words"))).alias("_keys"),
    )
    repeated = F.size(F.array_distinct("_keys")) < F.size("_keys")
    ranked = keyed.withColumn("_order", F.when(repeated, F.array_sort(F.transform("_keys", lambda k, i: F.struct(k.alias("k"), i.alias("i"))))))
    same = lambda x, j: F.coalesce(F.get("_order", j)["k"] == x["k"], F.lit(False))
    found = ranked.withColumn(
        "_at", F.array_sort(F.transform(F.filter("_order", lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"]))
    )
    steps = F.transform("_at", lambda p, j: F.least(F.lit(WINDOW), F.get("_at", j + 1) - p))
    whole = found.withColumn("n_repeat_words", F.coalesce(F.aggregate(steps, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long"))
    return whole.withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words"))).drop("_keys", "_order", "_at")


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEATED_PERCENT * n_words)


def rejected_hosts(judged: DataFrame, host: str, max_failures: float = MAX_HOST_FAILURES) -> DataFrame:
    """judged(host, base_failed) to one row (_host) for each host whose shrunk share of failures is over the limit."""
    hosts = judged.groupBy(F.col(host).alias("_host")).agg(F.count("*").alias("n"), F.count_if("base_failed").alias("k"))
    n, k = F.col("n"), F.col("k")
    total = hosts.agg(F.sum("n").alias("N"), F.sum("k").alias("K"), F.count("*").alias("I"), F.sum(n * n).alias("Q"), F.sum(k * k / n).alias("S")).first()  # one row
    if not total["N"]:
        return hosts.select("_host")
    mean = total["K"] / total["N"]
    chance = mean * (1 - mean)
    room = chance * (total["N"] - total["Q"] / total["N"] - (total["I"] - 1))
    rho = (total["S"] - total["K"] * mean - chance * (total["I"] - 1)) / room if room > 0 else 0.0
    shrunk = (k + mean * (1 / rho - 1)) / (n + (1 / rho - 1)) if 0 < rho < 1 else F.lit(mean) if rho <= 0 else k / n
    return hosts.where(shrunk > max_failures).select("_host")


def sized(hosts: DataFrame) -> DataFrame:
    """Rejected hosts, staged, to be broadcast if they are few enough."""
    kept = stage(hosts, "rejected-hosts")
    return F.broadcast(kept) if kept.count() <= BROADCAST_HOSTS else kept


def judge(docs: DataFrame, text: str = "text", host: str = "source", max_failures: float = MAX_HOST_FAILURES) -> DataFrame:
    """One row for each document: doc_id, host, the counts, base_failed, host_failed and kept."""
    thin = stage(measured(docs.select("doc_id", F.col(host).alias("_host"), F.col(text).alias("_text")), "_text").drop("_text"), "quality")
    bad = sized(rejected_hosts(thin, "_host", max_failures).select(F.col("_host").alias("_bad"), F.lit(True).alias("host_failed")))
    joined = thin.join(bad, F.col("_host").eqNullSafe(F.col("_bad")), "left").drop("_bad")
    hit = F.coalesce("host_failed", F.lit(False))
    return joined.withColumn("host_failed", hit).withColumn("kept", ~F.col("base_failed") & ~hit).withColumnRenamed("_host", "host")


def keep(docs: DataFrame, text: str = "text", host: str = "source", max_failures: float = MAX_HOST_FAILURES) -> DataFrame:
    """The documents that pass, with their own columns only."""
    inner = docs.select(F.struct("*").alias("_row"), F.col(host).alias("_of"), F.col(text).alias("_text"))
    judged = stage(measured(inner, "_text").select("_row", "_of", "base_failed"), "quality-docs")
    bad = sized(rejected_hosts(judged, "_of", max_failures))
    return judged.where(~F.col("base_failed")).join(bad, F.col("_of").eqNullSafe(F.col("_host")), "left_anti").select("_row.*")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_failed"
    )


OP7_SQL = r"""
WITH texts AS (
  SELECT doc_id, source, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents
), parts AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM texts
), starts AS (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM parts WHERE len(w) >= 5),
windows AS (SELECT r, i, count(*) OVER (PARTITION BY r, list_slice(w, i, i + 4)) AS n FROM starts),
repeats AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM windows WHERE n > 1) GROUP BY r
), counts AS (
  SELECT doc_id, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM parts LEFT JOIN repeats USING (r)
), judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counts),
hosts AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE base_failed) AS k FROM judged GROUP BY source),
sums AS (SELECT sum(n)::DOUBLE AS n, sum(k)::DOUBLE AS k, count(*) AS i, sum(n * n)::DOUBLE AS q, sum(k * k / n) AS s FROM hosts),
prior AS (
  SELECT m, CASE WHEN room > 0 THEN (s - k * m - c * (i - 1)) / room ELSE 0 END AS rho
  FROM (SELECT *, c * (n - q / n - (i - 1)) AS room FROM (SELECT *, k / n AS m, k / n * (1 - k / n) AS c FROM sums))
), verdicts AS (
  SELECT source, CASE WHEN rho <= 0 THEN m WHEN rho >= 1 THEN k / n ELSE (k + m * (1 / rho - 1)) / (n + (1 / rho - 1)) END > 0.5 AS host_failed FROM hosts, prior
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT host_failed AS kept, host_failed
FROM judged JOIN verdicts ON judged.source IS NOT DISTINCT FROM verdicts.source
"""
