"""Quality classifier: a sparse rule ensemble, compiled to Spark columns.

Statistics of the whole text are Spark columns. Shallow trees on bootstrap samples give paths; each
path is a conjunctive rule over the statistics. A lasso logistic regression on the rules keeps a few,
and score() turns these into one column expression.

Fitting uses at most MAX_ROWS labelled rows outside the test fold, those with the least hash of the
id; this bound is a parameter. All documents are scored on their whole text. Null and empty texts
have zero in every statistic and get a score. With no labels, or labels of one kind, the score is
the base rate. A null doc_id is not held out. Rows that repeat are scored alike; other columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import UPPER, documents, held_out, white_words
from tessera.llm.fitting import Condition, logistic, tree_paths

#: Production parameters of the fit.
MAX_ROWS, TREES, DEPTH, SAMPLE, L1, SEED = 20_000, 24, 3, 4_000, 2e-3, 7
THRESHOLD = 0.3
MARKS = {"upper": UPPER, "digits": "0123456789", "symbols": "#*$%&<>", "pipes": "|", "exclaims": "!", "stops": ".,"}


def statistics(docs: DataFrame, text: str = "text") -> tuple[DataFrame, list[str]]:
    """docs with a column for each statistic, and their names."""
    body = F.coalesce(F.col(text), F.lit(""))
    chars = F.greatest(F.lit(1), F.length(body))
    rows = docs.withColumns(
        {
            "_w": white_words(body),
            "_l": F.split(body, "\n"),
            **{f"s_{name}": (F.length(body) - F.length(F.translate(body, marks, ""))) / chars for name, marks in MARKS.items()},
            "_chars": chars,
        }
    )
    words, lines = F.greatest(F.lit(1), F.size("_w")), F.size("_l")
    rows = rows.withColumns(
        {
            "s_words": F.log1p(F.size("_w").cast("double")),
            "s_distinct": F.size(F.array_distinct("_w")) / words,
            "s_letters": F.col("_chars") / words,
            "s_repeats": 1 - F.size(F.array_distinct("_l")) / lines,
            "s_line_words": F.log1p(words / lines),
        }
    ).drop("_w", "_l", "_chars")
    return rows, [*(f"s_{name}" for name in MARKS), "s_words", "s_distinct", "s_letters", "s_repeats", "s_line_words"]


def sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """At most max_rows labelled documents outside the test fold, with the label as y; ids that are labelled twice are left out, of the rows of one id the one with the least hash stays."""
    once = labels.where(F.col(label).isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min(label).alias("y"), F.count("*").alias("_n")).where("_n = 1")
    chosen = once.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows).select("doc_id", "y")
    rest = [c for c in docs.columns if c != "doc_id"]
    found = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min_by(F.struct(*rest), F.xxhash64(*rest)).alias("_row"))  # max_rows bounds what is broadcast
    return found.select("doc_id", "y", "_row.*")


def rules(x: np.ndarray, y: np.ndarray) -> tuple[float, list[tuple[tuple[Condition, ...], float]]]:
    """(intercept, rules with their weights)."""
    made, paths = np.random.default_rng(SEED), {}
    for _ in range(TREES if len(y) and 0 < y.mean() < 1 else 0):
        rows = made.choice(len(y), min(len(y), SAMPLE))
        for path in tree_paths(x[rows], y[rows], DEPTH, made):
            paths[tuple(sorted(path))] = None
    found = [*paths]
    fires = np.array([np.logical_and.reduce([(x[:, c] > cut) == over for c, over, cut in path]) for path in found], float).T.reshape(len(y), len(found))
    bias, w = logistic(fires, y, l1=L1)
    return bias, [(path, float(a)) for path, a in zip(found, w) if a]


def score(names: list[str], bias: float, weighted: list[tuple[tuple[Condition, ...], float]]) -> Column:
    total = F.lit(bias)
    for path, weight in weighted:
        fires = F.lit(True)
        for c, over, cut in path:
            fires = fires & ((F.col(names[c]) > cut) if over else (F.col(names[c]) <= cut))
        total = total + F.when(fires, weight).otherwise(0.0)
    return 1 / (1 + F.exp(-total))


def classify(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "quality", max_rows: int = MAX_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    thin = docs.select("doc_id", F.col(text).alias("_text"))
    train, names = statistics(sample(thin, labels, label, max_rows), "_text")
    table = train.select("doc_id", "y", *names).toPandas().sort_values("doc_id")  # max_rows at most
    bias, weighted = rules(table[names].to_numpy(float), table["y"].to_numpy(float))
    scored = statistics(thin, "_text")[0].withColumn("score", score(names, bias, weighted))
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
