"""Benchmark decontamination by a positional inverted index; DataFrame functions only.

The index holds postings (term, document, position) of all documents for every term that the benchmark
has; it is stored, and texts are cut into words once, for it. Every window of 13 consecutive words of a
benchmark item (the whole item, if shorter) is sought from its two rarest terms, by counts over all
documents. A posting at item place q lies on the diagonal (position - q). Where the rarest term of a
window has a posting, and the other one within SLOP places of that diagonal, the lists of all words of
the item are intersected there, adjusted by their places in it.

- Exact match: a run of words on one diagonal that holds a whole window.
- Proximity match: every word of a window stands within SLOP places of its place on a diagonal, and
  the window's rarest (the first of several) stands on it. Exact matches are such too.

The tables of terms and pivots grow with the benchmark. They are broadcast up to BROADCAST_ROWS rows;
beyond, the same joins run as shuffles of thin postings.

Null and empty texts have no words; an item without words matches nothing; equal items each count. An
item of null id makes hits but has no id to list or count. Items that share an id count as one. Rows
that repeat a doc_id are told apart by a 64-bit hash of the text; a null doc_id is an id of its own. An
empty table on either side gives no hits. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import documents, lower_ascii, stage, variant, without
from tessera.llm.repeats import NO_DOC

#: What separates words, the words of a window, and the share of hit words that contaminates.
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW, HIT_SHARE = 13, 20
#: Production parameters: places that a word may be off its diagonal; rows of a table that is broadcast; positions of a block of postings.
SLOP, BROADCAST_ROWS, BLOCK = 2, 500_000, 8
KEY = ["_d", "_v"]


def words(text: Column) -> Column:
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATOR), lambda w: w != "")


def small(table: DataFrame) -> DataFrame:
    """A staged table, to be broadcast if it has few enough rows."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def items(benchmark: DataFrame) -> DataFrame:
    """item_id, ik (a key of item_id and words), iw (its words) and len (of its windows); an item without words is left out."""
    found = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("iw")).where(F.size("iw") > 0).distinct()
    return found.select("item_id", F.xxhash64(F.coalesce("item_id", F.lit(" ")), F.array_join("iw", " ")).alias("ik"), "iw", F.least(F.lit(WINDOW), F.size("iw")).alias("len"))


def inverted(docs: DataFrame, terms: DataFrame, text: str = "text") -> DataFrame:
    """The postings (_d, _v, term, pos) of docs for terms(term); a posting of the null term has each document's number of words."""
    body = F.col(text)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_DOC)).alias("_d"), variant(body).alias("_v"), words(body).alias("w"))
    every = rows.select(*KEY, F.posexplode(F.array_append("w", F.lit(None).cast("string"))).alias("pos", "term"))
    known = small(terms.select(F.col("term").alias("known")))
    spread = F.coalesce("term", F.concat(F.lit(" "), F.col("_v").cast("string")))  # no term has a space
    return every.join(known, spread == F.col("known"), "left").where("term is null or known is not null").select(*KEY, "term", "pos")


def pivots(bench: DataFrame, places: DataFrame, index: DataFrame) -> DataFrame:
    """ik, s (a window's start), len, and its rarest places: q1, term1, q2, term2 (the same in windows of one word)."""
    seen = index.where("term is not null").groupBy("term").agg(F.count("*").alias("df"))
    counted = places.join(bench.select("ik", "len", F.size("iw").alias("n")), "ik").join(seen, "term", "left").na.fill(0, ["df"])
    starts = F.sequence(F.greatest(F.lit(0), F.col("q") - F.col("len") + 1), F.least(F.col("q"), F.col("n") - F.col("len")))
    spread = counted.select("ik", "len", "q", "term", "df", F.explode(starts).alias("s"))
    rarest = Window.partitionBy("ik", "s").orderBy("df", "q")
    ranked = spread.withColumn("r", F.row_number().over(rarest)).where("r <= 2")
    both = ranked.groupBy("ik", "s", "len").agg(F.min(F.struct("r", "q", "term")).alias("x"), F.max(F.struct("r", "q", "term")).alias("y"))
    return both.select("ik", "s", "len", F.col("x.q").alias("q1"), F.col("x.term").alias("term1"), F.col("y.q").alias("q2"), F.col("y.term").alias("term2"))


def candidates(chosen: DataFrame, index: DataFrame, slop: int) -> DataFrame:
    """_d, _v, ik and diag: where the rarest term of some window stands, the second within slop places."""
    pairs = stage(chosen.select("ik", "q1", "term1", "q2", "term2").distinct(), "pairs")
    one = index.join(small(pairs), F.col("term") == F.col("term1")).select(*KEY, "ik", "q2", (F.col("pos") - F.col("q1")).alias("diag"))
    near = one.withColumn("at", F.explode(F.transform(F.sequence(F.lit(-slop), F.lit(slop)), lambda k: F.col("diag") + k)))
    second = pairs.select("ik", "q2", "term2").distinct()
    two = index.join(small(second), F.col("term") == F.col("term2")).select(*KEY, "ik", "q2", (F.col("pos") - F.col("q2")).alias("at")).distinct()
    return near.join(two, [*KEY, "ik", "q2", "at"]).select(*KEY, "ik", "diag").distinct()


def lined(found: DataFrame, places: DataFrame, index: DataFrame, slop: int) -> DataFrame:
    """_d, _v, ik, diag, q and exact: the item's words that stand within slop places of the diagonal, and whether on it."""
    wanted = found.join(small(places), "ik").select(*KEY, "ik", "diag", "q", "term", (F.col("diag") + F.col("q")).alias("at")).where(F.col("at") >= -slop)
    block = lambda x: F.floor(x / BLOCK).cast("int")
    blocks = F.array_distinct(F.array(block(F.col("at") - slop), block(F.col("at") + slop)))
    postings = index.where("term is not null").select(*KEY, "term", "pos", block(F.col("pos")).alias("block"))
    met = wanted.withColumn("block", F.explode(blocks)).join(postings, [*KEY, "term", "block"]).where(F.abs(F.col("pos") - F.col("at")) <= slop)
    return met.groupBy(*KEY, "ik", "diag", "q").agg(F.max(F.col("pos") == F.col("at")).alias("exact"))


def stretches(rows: DataFrame, bench: DataFrame) -> DataFrame:
    """Runs of consecutive q of lined() rows that hold a window: _d, _v, ik, diag, item_id, len, a, b (exclusive) and the exact places."""
    line = Window.partitionBy(*KEY, "ik", "diag").orderBy("q")
    apart = rows.withColumn("run", F.col("q") - F.row_number().over(line))
    runs = apart.groupBy(*KEY, "ik", "diag", "run").agg(F.min("q").alias("a"), (F.max("q") + 1).alias("b"), F.collect_list(F.when(F.col("exact"), F.col("q"))).alias("on"))
    return runs.join(bench.select("ik", "item_id", "len"), "ik").where("b - a >= len").drop("run")


def matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", slop: int = SLOP) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The documents (_d, _v, n_words); exact matches (_d, _v, item_id, start, end in words, exclusive); proximity matches (_d, _v, item_id)."""
    bench = stage(items(benchmark), "items")
    places = stage(bench.select("ik", F.posexplode("iw").alias("q", "term")), "places")
    index = stage(inverted(docs, stage(places.select("term").distinct(), "terms"), text), "postings")
    chosen = stage(pivots(bench, places, index), "pivots")
    rows = stage(lined(candidates(chosen, index, slop), places, index, slop), "lined")
    exact = stretches(rows.where("exact"), bench)
    windows = small(chosen.select(F.col("ik").alias("_ik"), "s", "q1", F.col("len").alias("_len")))
    fits = (F.col("ik") == F.col("_ik")) & (F.col("a") <= F.col("s")) & (F.col("s") + F.col("_len") <= F.col("b")) & F.array_contains("on", F.col("q1"))
    near = stretches(rows, bench).join(windows, fits).select(*KEY, "item_id").distinct()
    sizes = index.where("term is null").select(*KEY, F.col("pos").cast("long").alias("n_words"))
    return sizes, exact.select(*KEY, "item_id", (F.col("diag") + F.col("a")).alias("start"), (F.col("diag") + F.col("b")).alias("end")), near


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", slop: int = SLOP) -> DataFrame:
    """One row for each document: doc_id, n_words, n_hit, n_items, items (sorted ids), n_near (items with proximity matches) and contaminated."""
    sizes, exact, near = matches(docs, benchmark, text, slop)
    by_doc = Window.partitionBy(*KEY).orderBy("start", "end")
    reached = F.coalesce(F.max("end").over(by_doc.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    fresh = exact.withColumn("n", F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("start"), reached)))
    hits = fresh.groupBy(*KEY).agg(F.sum("n").alias("n_hit"), F.array_sort(F.collect_set("item_id")).alias("items"))
    beside = near.groupBy(*KEY).agg(F.count("item_id").alias("n_near"))
    joined = sizes.join(hits, KEY, "left").join(beside, KEY, "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return joined.select(
        F.when(F.col("_d") != NO_DOC, F.col("_d")).alias("doc_id"), F.col("_v").alias("variant"), "n_words", n_hit.alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        ((n_hit > 0) & (HIT_SHARE * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The documents that aren't contaminated."""
    return without(docs, contamination(docs, benchmark, text, 0).where("contaminated").select("doc_id", "variant"), variant(F.col(text)))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated", "n_near",
    )


OP9_SQL = r"""
WITH docs AS (
  SELECT doc_id, row_number() OVER () AS r,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), items AS (
  SELECT item_id::VARCHAR AS item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), sized AS (SELECT *, least(13, len(w)) AS k FROM items WHERE len(w) > 0),
wanted AS (
  SELECT DISTINCT item_id, k, list_slice(w, s, s + k - 1) AS win
  FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS s FROM sized)
), tried AS (
  SELECT r, k, s, list_slice(w, s, s + k - 1) AS win
  FROM (SELECT docs.*, k, unnest(range(1, len(w) - k + 2)) AS s FROM docs, (SELECT DISTINCT k FROM sized) AS ks WHERE len(w) >= k)
), found AS (SELECT r, item_id, s, tried.k AS k FROM tried JOIN wanted ON tried.k = wanted.k AND tried.win = wanted.win),
hit AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(s, s + k)) AS p FROM found) GROUP BY r),
ids AS (SELECT r, count(item_id) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM found) GROUP BY r),
every AS (SELECT r, unnest(w) AS term, generate_subscripts(w, 1) AS pos FROM docs),
df AS (SELECT term, count(*) AS df FROM every GROUP BY term),
keyed AS (SELECT DISTINCT item_id, w, k FROM sized),
starts AS (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM keyed),
inside AS (SELECT item_id, w, k, s, unnest(range(s, s + k)) AS q FROM starts),
ranked AS (
  SELECT item_id, w, k, s, q, w[q] AS term, row_number() OVER (PARTITION BY item_id, w, s ORDER BY coalesce(df.df, 0), q) AS rarest
  FROM inside LEFT JOIN df ON df.term = w[q]
), anchored AS (
  SELECT e.r, p.item_id, p.w, p.k, p.s, e.pos - p.q AS d FROM ranked p JOIN every e ON e.term = p.term WHERE p.rarest = 1
), closest AS (
  SELECT a.r, a.item_id, a.w, a.k, a.s, a.d, q.q FROM anchored a JOIN ranked q ON q.item_id IS NOT DISTINCT FROM a.item_id AND q.w = a.w AND q.s = a.s
  JOIN every e ON e.r = a.r AND e.term = q.term WHERE abs(e.pos - q.q - a.d) <= 2
), near AS (
  SELECT r, count(DISTINCT item_id) AS n FROM (SELECT r, item_id FROM closest GROUP BY r, item_id, w, k, s, d HAVING count(DISTINCT q) = k) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(ids.n, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AND 20 * coalesce(hit.n, 0) >= len(w) AS contaminated,
  coalesce(near.n, 0)::BIGINT AS n_near
FROM docs LEFT JOIN hit USING (r) LEFT JOIN ids USING (r) LEFT JOIN near USING (r)
"""
