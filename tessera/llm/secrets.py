"""Secret scans: fixed patterns, and a battery of randomness tests; DataFrame functions only.

Base spans come from three patterns (assignments, access keys, hex strings). Further spans come
from tokens of 20 letters or more. The alphabet of a token is inferred (hex, base32, base36,
base64) and three tests ask whether it could be drawn evenly from it: chi-squared uniformity with
the exact mean and variance for short strings, a runs test above and below the middle of the
alphabet, and serial correlation. The least of the three p-values, Bonferroni corrected, is the
token's. Over the whole table, and for each alphabet and band of lengths, the share of p-values
that even draws would have gives the false-discovery rate of each limit, in steps of 1 / STEPS; a token
is reported when it reaches the lowest limit from LEAST_P on that keeps the rate at FDR or less.

Every match is a row, and places are running sums over the rows of a document, so the work grows with
the text, however many matches it has. Null and empty texts have no spans. Spans are in code points, the
end exclusive. Reported tokens don't overlap base spans. Repeated rows each get their result; an empty
table gives an empty one. Redaction holds one document's characters at a time as an array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import documents, stage

#: The base patterns by kind, the group whose length counts, and its least length.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}"
ASSIGN_LETTERS = 6
KINDS = ("assign", "access", "hex", "random")
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
#: Alphabets in the order in which they are tried, with the pattern of their tokens.
DIGITS, LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
ALPHABETS = {
    "hex": (DIGITS + "abcdef", "^([0-9a-f]+|[0-9A-F]+)$"),
    "base32": (LOWER + "234567", "^[A-Z2-7]+=*$"),
    "base36": (DIGITS + LOWER, "^([0-9a-z]+|[0-9A-Z]+)$"),
    "base64": (LOWER.upper() + LOWER + DIGITS + "+/", "^[A-Za-z0-9+/_-]+=*$"),
}
FDR, LEAST_P, EVEN_ABOVE, STEPS = 0.05, 0.01, 0.5, 1000
#: Bands of lengths are powers of two, from 2**4 to 2**MAX_BAND and longer.
MAX_BAND = 10


def occurrences(text: Column, pattern: str, kind: int, group: int = 0) -> Column:
    """Array of (kind, i, gap, hit, sized, token) of a pattern's leftmost matches: letters since the last one, of it, and of its group."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sized = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    whole = F.filter(F.arrays_zip(gaps.alias("gap"), found.alias("hit"), sized.alias("sized")), lambda x: x["hit"].isNotNull())

    def row(x: Column, i: Column) -> Column:
        token = x["hit"] if kind == len(KINDS) - 1 else F.lit(None).cast("string")
        return F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.length(x["gap"]).alias("gap"), F.length(x["hit"]).alias("hit"), F.length(x["sized"]).alias("sized"), token.alias("token"))

    return F.when(text.rlike(pattern), F.transform(whole, row)).otherwise(F.array().cast("array<struct<kind:int,i:int,gap:int,hit:int,sized:int,token:string>>"))


def upper_tail(z: Column) -> Column:
    """Share of the normal distribution above z, by a logistic approximation good to 2e-4."""
    return 1 / (1 + F.exp(F.greatest(F.lit(-600.0), F.least(F.lit(600.0), 1.5976 * z + 0.070566 * z * z * z))))


def coded(token: Column) -> Column:
    """Struct of enc (index in ALPHABETS), a (letters of the alphabet) and v (the token's codes); null if none fits."""

    def by(letters: str, enc: int) -> Column:
        clean = F.rtrim(F.translate(token, "-_", "+/"), F.lit("=")) if enc == 3 else F.rtrim(F.lower(token), F.lit("="))
        codes = F.transform(F.split(clean, ""), lambda c: F.position(c, F.lit(letters)) - 1)
        return F.struct(F.lit(enc).alias("enc"), F.lit(len(letters)).alias("a"), codes.alias("v"))

    pick = F.lit(None).cast("struct<enc:int,a:int,v:array<int>>")
    for enc, (letters, pattern) in reversed([*enumerate(ALPHABETS.values())]):
        pick = F.when(token.rlike(pattern), by(letters, enc)).otherwise(pick)
    return pick


def battery(v: Column, a: Column) -> Column:
    """The corrected p-value of codes v of an alphabet of a letters."""
    n = F.size(v).cast("double")
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)
    squares = total(F.transform(F.array_distinct(v), lambda d: F.pow(F.size(F.filter(v, lambda x: x == d)).cast("double"), F.lit(2.0))))
    chi = squares * a / n - n
    z_chi = (chi - (a - 1)) / F.sqrt(2 * (a - 1) * (n - 1) / n)
    high = F.transform(v, lambda x: (2 * x >= a).cast("int"))
    ups = total(F.transform(high, lambda x: x.cast("double")))
    runs = 1 + total(F.transform(high, lambda x, i: F.coalesce((F.get(high, i - 1) != x).cast("double"), F.lit(0.0))))
    expected = 1 + 2 * ups * (n - ups) / n
    z_runs = (runs - expected) / F.sqrt(F.greatest(F.lit(1e-9), (expected - 1) * (expected - 2) / (n - 1)))
    mean = total(F.transform(v, lambda x: x.cast("double"))) / n
    spread = total(F.transform(v, lambda x: F.pow(x - mean, F.lit(2.0))))
    lagged = total(F.transform(v, lambda x, i: F.coalesce((x - mean) * (F.get(v, i + 1) - mean), F.lit(0.0))))
    z_serial = F.try_divide(lagged, spread) * F.sqrt(n)
    least = F.least(upper_tail(z_chi), 2 * upper_tail(F.abs(z_runs)), 2 * upper_tail(F.abs(F.coalesce(z_serial, F.lit(99.0)))))
    return F.least(F.lit(1.0), 3 * least)


def numbered(docs: DataFrame, text: str) -> DataFrame:
    """_id, _row (a struct of docs' columns) and _found (the matches of all patterns), staged: ids stay as they are."""
    body = F.coalesce(F.col(text), F.lit(""))
    found = F.concat(occurrences(body, ASSIGN, 0, 2), occurrences(body, ACCESS, 1), occurrences(body, HEX, 2), occurrences(body, TOKEN, 3))
    return docs.select(F.monotonically_increasing_id().alias("_id"), F.struct("*").alias("_row"), found.alias("_found"))


def judged(rows: DataFrame) -> DataFrame:
    """rows(_id, _found) to (_id, kind, start, end), and enc, band and p of tokens off all base spans; before any limit."""
    every = rows.where(F.size("_found") > 0).select("_id", F.inline("_found")).repartition("_id")
    ahead = Window.partitionBy("_id", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    placed = every.withColumn("end", F.sum(F.col("gap") + F.col("hit")).over(ahead).cast("int")).withColumn("start", F.col("end") - F.col("hit"))
    base = F.col("kind") < len(KINDS) - 1
    whole = placed.where((F.col("kind") != 0) | (F.col("sized") >= ASSIGN_LETTERS))
    # By where base spans start and tokens end, a token overlaps a base span if the furthest end so far is behind its start.
    so_far = Window.partitionBy("_id").orderBy(F.when(base, F.col("start")).otherwise(F.col("end")), F.when(base, 1).otherwise(0)).rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max(F.when(base, F.col("end"))).over(so_far), F.lit(0))
    free = whole.withColumn("reached", reached).where(base | (F.col("reached") <= F.col("start"))).withColumn("t", coded(F.col("token")))
    usable = free.where(base | F.col("t").isNotNull() & (F.size("t.v") > 2))
    band = F.least(F.lit(MAX_BAND), F.floor(F.log2(F.size("t.v").cast("double"))).cast("int"))
    return usable.select("_id", "kind", "start", "end", "t.enc", F.when(~base, band).alias("band"), F.when(~base, battery(F.col("t.v"), F.col("t.a"))).alias("p"))


def limits(tokens: DataFrame, fdr: float = FDR) -> DataFrame:
    """tokens(enc, band, p) to the lowest step of p that is reported, by alphabet and band; at most 4 x MAX_BAND rows."""
    even = lambda t: F.pow(1 - t / 3, F.lit(3.0))  # noqa: E731  the share of even draws whose p is over t
    counts = tokens.groupBy("enc", "band", F.floor(F.col("p") * STEPS).alias("step")).agg(F.count("*").alias("n"))
    group = Window.partitionBy("enc", "band")
    up = F.sum("n").over(group.orderBy(F.desc("step")))
    draws = F.sum(F.when(F.col("step") >= EVEN_ABOVE * STEPS, F.col("n")).otherwise(0)).over(group) / even(F.lit(EVEN_ABOVE))
    kept = counts.withColumn("rate", 1 - draws * even(F.col("step") / STEPS) / up).where((F.col("rate") <= fdr) & (F.col("step") >= LEAST_P * STEPS))
    return kept.groupBy("enc", "band").agg(F.min("step").alias("least"))


def reported(spans: DataFrame, fdr: float) -> DataFrame:
    """judged() rows to the base spans and the reported tokens: _id, kind, start, end."""
    tokens = spans.where("p is not null")
    least = limits(tokens, fdr).select(F.col("enc").alias("_enc"), F.col("band").alias("_band"), "least")
    table = spans.join(F.broadcast(least), (F.col("enc") == F.col("_enc")) & (F.col("band") == F.col("_band")), "left")  # 4 x MAX_BAND rows at most
    return table.where(F.col("p").isNull() | (F.floor(F.col("p") * STEPS) >= F.col("least"))).select("_id", "kind", "start", "end")


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, text: str = "text", fdr: float = FDR) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every document."""
    rows = stage(numbered(docs.select("doc_id", F.col(text).alias("_text")), "_text").withColumn("_row", F.struct("_row.doc_id")), "secrets")
    spans = stage(judged(rows), "secret-spans")
    every = F.array_sort(F.collect_list(F.struct("start", "kind", "end")))
    found = reported(spans, fdr).groupBy("_id").agg(every.alias("_spans"))
    whole = rows.select("_id", "_row.doc_id").join(found, "_id", "left")
    span = "array<struct<start:int,kind:int,end:int>>"
    spanned = whole.select("doc_id", F.coalesce("_spans", F.array().cast(span)).alias("_spans"))
    base = F.filter("_spans", lambda s: s["kind"] < len(KINDS) - 1)
    count = lambda kind: F.size(F.filter("_spans", lambda s: s["kind"] == kind)).cast("long")
    return spanned.select("doc_id", *(count(k).alias(f"n_{name}") for k, name in enumerate(KINDS[:3])), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("_spans")).alias("spans"))


def redact(docs: DataFrame, text: str = "text", mark: str = "[secret]", fdr: float = FDR) -> DataFrame:
    """docs, each reported span replaced by mark (overlapping ones by one); n_chars, if there, follows the text."""
    rows = stage(numbered(docs, text), "secrets-docs")
    spans = reported(stage(judged(rows.select("_id", "_found")), "secret-spans"), fdr)
    in_order = Window.partitionBy("_id").orderBy("start", "end")
    before = F.coalesce(F.max("end").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = spans.withColumn("fresh", (F.col("start") >= before).cast("int")).withColumn("run", F.sum("fresh").over(in_order))
    merged = runs.groupBy("_id", "run").agg(F.min("start").alias("a"), F.max("end").alias("b"))
    cuts = merged.groupBy("_id").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("_cuts"))
    body, chars = F.col("_row")[text], F.regexp_extract_all(F.col("_row")[text], F.lit("(?s)."), F.lit(0))
    spanned = rows.join(cuts, "_id", "left").withColumn("_chars", F.when(F.col("_cuts").isNotNull(), chars))
    begin = lambda i: F.coalesce(F.get("_cuts", i - 1)["b"], F.lit(0))
    pieces = F.transform("_cuts", lambda c, i: F.array_join(F.slice("_chars", begin(i) + 1, c["a"] - begin(i)), ""))
    last = F.col("_cuts")[F.size("_cuts") - 1]["b"]
    rest = F.array_join(F.slice("_chars", last + 1, F.greatest(F.lit(0), F.size("_chars") - last)), "")
    now = F.when(F.col("_cuts").isNotNull(), F.array_join(F.concat(pieces, F.array(rest)), mark)).otherwise(body)
    done = spanned.withColumn("_now", now)
    changed = {text: F.col("_now")} | ({"n_chars": F.length("_now").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return done.select(*(changed.get(c, F.col("_row")[c]).alias(c) for c in docs.columns))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))
