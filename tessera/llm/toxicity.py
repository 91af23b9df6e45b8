"""Toxicity: a learned lexicon, misspellings by automata, and scores of the context.

The lexicon comes from labelled rows outside the test fold: words, and stems that begin words, which
are far more frequent in toxic documents (MIN_TOXIC of them at least, and log odds of MIN_Z standard
errors). The Levenshtein automata of all its words, intersected with their trie, make one finite
automaton: a state is the set of trie nodes that can be reached with the edits spent on each, clipped
at what the words below a node allow, and a transition is worked out once. A word of a text is run
through it; most words leave it after a few letters.

A hit counts apart if it stands in quotation marks, or soon after a word that labelled rows show to
introduce quotations: one before hits far more often in clean documents than in toxic ones. Hits close
together add up in a window, those apart and the others each for themselves. A logistic regression on
the sums gives the score, so labels decide what a quoted hit weighs.

Fitting uses at most MAX_ROWS labelled rows, those with the least hash of the id; this bound is a
parameter, and bounds the lexicon too. Whole texts are scored. Null and empty texts have no hits and
get the score of that. With no labels, or labels of one kind, the score is the base rate. A null
doc_id is not held out. Rows that repeat are scored alike; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import documents, held_out, stage
from tessera.llm.fitting import logistic
from tessera.llm.quality_model import sample

#: Production parameters of the fit.
MAX_ROWS, MIN_TOXIC, MIN_SHARE, MIN_Z = 20_000, 8, 0.5, 3.0
STEMS = range(3, 9)
#: Letters from which a word may have one edit, and two.
ONE_EDIT, TWO_EDITS = 5, 9
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
QUOTES = {'"': '"', "“": "”", "«": "»", "„": "“"}
#: Words before a hit that may introduce a quotation; words on either side in a window; words and transitions that a worker remembers.
BEFORE, AROUND, KNOWN = 3, 10, 400_000
NAMES = ["exact", "misspelled", "stems", "exact_quoted", "misspelled_quoted", "stems_quoted", "window", "window_quoted", "rate"]


def found_words(text: Column) -> Column:
    """The words of a text as Python finds them, but for letters whose lower case is longer."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def terms(train: DataFrame) -> list[tuple[str, bool, float]]:
    """(term, whether it is a stem, log odds) of words and stems that mark toxic rows of train(y, text)."""
    stems = F.flatten(F.transform("w", lambda w: F.transform(F.array(*map(F.lit, STEMS)), lambda k: F.when(F.length(w) > k, F.concat(w.substr(F.lit(1), k), F.lit("*"))))))
    words = train.select("y", F.array_distinct(found_words(F.col("text"))).alias("w"))
    both = words.select("y", F.explode(F.array_distinct(F.concat("w", stems))).alias("term")).where("term is not null")
    n = {int(r["y"]): r["n"] for r in train.groupBy("y").agg(F.count("*").alias("n")).collect()}  # two rows
    if not n.get(0) or not n.get(1):
        return []
    counted = both.groupBy("term").agg(F.count_if(F.col("y") == 1).alias("bad"), F.count_if(F.col("y") == 0).alias("good")).where(f"bad >= {MIN_TOXIC}")
    odds = F.log((F.col("bad") + 0.5) / (n[1] + 1)) - F.log((F.col("good") + 0.5) / (n[0] + 1))
    error = F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("good") + 0.5))
    share = F.col("bad") / (F.col("bad") + F.col("good"))
    rows = counted.select("term", "bad", odds.alias("odds")).where((share >= MIN_SHARE) & (odds >= MIN_Z * error)).collect()  # bounded by max_rows
    found = sorted((r["term"], r["bad"], r["odds"]) for r in rows)
    words_of = [(t, bad, o) for t, bad, o in found if not t.endswith("*")]
    explained = lambda t, bad, o: any(w.startswith(t[:-1]) and (b >= 0.9 * bad or b >= bad / 2 and p > o + 1) for w, b, p in words_of)  # noqa: E731  a stem that is mostly one worse word
    kept = [(t, bad, o) for t, bad, o in found if not (t.endswith("*") and explained(t, bad, o))]
    stems_of = {t[:-1] for t, _, _ in kept if t.endswith("*")}
    covered = lambda t: any(t[:k] in stems_of for k in STEMS if k < len(t.rstrip("*")))
    return [(t.rstrip("*"), t.endswith("*"), float(o)) for t, _, o in kept if not covered(t)]


def edits(term: str) -> int:
    """How many edits a term allows."""
    return 0 if len(term) < ONE_EDIT else 1 if len(term) < TWO_EDITS else 2


class Automaton:
    """The Levenshtein automata of terms, intersected with their trie; made deterministic where words lead."""

    def __init__(self, found: dict[str, float]):
        self.below: list[dict[str, int]] = [{}]
        self.end: list[tuple[str, float] | None] = [None]
        self.allowed = [0]  # the most edits of a term below a node
        for t, o in sorted(found.items()):
            if k := edits(t):
                node = 0
                self.allowed[0] = max(self.allowed[0], k)
                for c in t:
                    if c not in self.below[node]:
                        self.below[node][c] = len(self.below)
                        self.below.append({})
                        self.end.append(None)
                        self.allowed.append(0)
                    node = self.below[node][c]
                    self.allowed[node] = max(self.allowed[node], k)
                self.end[node] = (t, o)
        self.forget()

    def forget(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.states: list[tuple[tuple[int, int], ...]] = []
        self.steps: dict[tuple[int, str], int] = {}
        self.number(())  # state 0 is the dead one
        self.start = self.number(self.closed({0: 0}))

    def number(self, state: tuple[tuple[int, int], ...]) -> int:
        if state not in self.ids:
            self.ids[state] = len(self.states)
            self.states.append(state)
        return self.ids[state]

    def closed(self, spent: dict[int, int]) -> tuple[tuple[int, int], ...]:
        """With the nodes that letters left out lead to, and without those that have spent too much."""
        todo = [*spent.items()]
        while todo:
            node, e = todo.pop()
            if e == spent[node] and e < self.allowed[node]:
                for to in self.below[node].values():
                    if e + 1 <= self.allowed[to] and e + 1 < spent.get(to, 9):
                        spent[to] = e + 1
                        todo.append((to, e + 1))
        return tuple(sorted(spent.items()))

    def step(self, state: int, c: str) -> int:
        new: dict[int, int] = {}
        for node, e in self.states[state]:
            if e < self.allowed[node] and e + 1 < new.get(node, 9):
                new[node] = e + 1  # a letter too many
            for d, to in self.below[node].items():
                cost = e + (c != d)
                if cost <= self.allowed[to] and cost < new.get(to, 9):
                    new[to] = cost
        return self.number(self.closed(new))

    def nearest(self, word: str) -> tuple[int, float] | None:
        """(edits, log odds) of the nearest term within what it allows, the worst of several."""
        if len(self.steps) > KNOWN:
            self.forget()
        state, steps = self.start, self.steps
        for c in word:
            to = steps.get((state, c))
            if to is None:
                to = steps[state, c] = self.step(state, c)
            if not to:
                return None
            state = to
        ends = [(e, -self.end[node][1]) for node, e in self.states[state] if self.end[node] and e <= edits(self.end[node][0])]
        return (min(ends)[0], -min(ends)[1]) if ends else None


class Lexicon:
    """Terms and stems, and the words that introduce quotations."""

    def __init__(self, found: list[tuple[str, bool, float]], cues: frozenset[str] = frozenset()):
        self.exact = {t: o for t, stem, o in found if not stem}
        self.stems = {t: o for t, stem, o in found if stem}
        self.longest = max(map(len, self.exact), default=0)
        self.sizes = sorted({len(t) for t in self.stems})
        self.automaton, self.cues = Automaton(self.exact), cues
        self.known: dict[str, tuple[int, float] | None] = {}

    def find(self, word: str) -> tuple[int, float] | None:
        """(kind, log odds): 0 exact, 1 misspelled, 2 stem."""
        if word in self.known:
            return self.known[word]
        hit = None
        if (o := self.exact.get(word)) is not None:
            hit = (0, o)
        else:
            for k in self.sizes:
                if len(word) > k and (o := self.stems.get(word[:k])) is not None:
                    hit = (2, o)
            if hit is None and ONE_EDIT - 1 <= len(word) <= self.longest + 2 and (near := self.automaton.nearest(word)):
                hit = (1, near[1])
        if len(self.known) >= KNOWN:
            self.known.clear()
        self.known[word] = hit
        return hit

    def hits(self, text: str) -> tuple[list[str], list[tuple[int, tuple[int, float], bool]]]:
        """The words of a text, and (place, hit, whether it stands in quotation marks) of its hits."""
        low = text.lower()
        words = finder.findall(low)
        known = {w: h for w in set(words) if (h := self.find(w))}
        if not known:
            return words, []
        spans, out = quotations(low), []
        for i, m in enumerate(finder.finditer(low)):
            if hit := known.get(m[0]):
                at = bisect.bisect(spans, (m.start(), len(low))) - 1
                out.append((i, hit, at >= 0 and m.start() < spans[at][1]))
        return words, out

    def contexts(self, text: str) -> list[str]:
        """The words that stand before hits outside quotation marks, each once."""
        words, found = self.hits(text)
        return sorted({w for i, _, inside in found if not inside for w in words[max(0, i - BEFORE) : i]})

    def features(self, text: str) -> list[float]:
        """The sums of NAMES for one text."""
        words, found = self.hits(text)
        out = [0.0] * len(NAMES)
        if not found:
            return out
        places: list[list[tuple[int, float]]] = [[], []]
        for i, (kind, odds), inside in found:
            apart = inside or not self.cues.isdisjoint(words[max(0, i - BEFORE) : i])
            out[kind + 3 * apart] += 1
            places[apart].append((i, odds))
        for apart in (0, 1):
            a, total = 0, 0.0
            for i, weight in places[apart]:
                total += weight
                while places[apart][a][0] < i - 2 * AROUND:
                    total -= places[apart][a][1]
                    a += 1
                out[6 + apart] = max(out[6 + apart], total)
        out[8] = 100 * sum(out[:3]) / len(words)
        return [float(np.log1p(max(0.0, v))) for v in out]


finder = re.compile(WORD)


def quotations(text: str) -> list[tuple[int, int]]:
    """The spans inside quotation marks, within a line, in order and joined where they overlap."""
    if not any(a in text for a in QUOTES):
        return []
    out: list[tuple[int, int]] = []
    for a, b in sorted(m.span() for a, b in QUOTES.items() for m in re.finditer(f"{a}[^{a}{b}\n]*{b}", text)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def mapped(docs: DataFrame, found: list[tuple[str, bool, float]], cues: frozenset[str], what: str, kind: pa.DataType, sql: str) -> DataFrame:
    """docs(doc_id, text) to (doc_id, f: what the lexicon's method of that name makes of the text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = getattr(Lexicon(found, cues), what)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([of(t or "") for t in part.column(1).to_pylist()], pa.list_(kind))], names=["doc_id", "f"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, f array<{sql}>")


def with_features(docs: DataFrame, found: list[tuple[str, bool, float]], cues: frozenset[str] = frozenset()) -> DataFrame:
    return mapped(docs, found, cues, "features", pa.float64(), "double")


def introductions(train: DataFrame, found: list[tuple[str, bool, float]]) -> frozenset[str]:
    """Words that stand before hits of clean rows far more often than before those of toxic rows, by MIN_Z standard errors."""
    before = mapped(train, found, frozenset(), "contexts", pa.string(), "string").where(F.size("f") > 0).join(train.select("doc_id", "y"), "doc_id")
    n = {int(r["y"]): r["n"] for r in before.groupBy("y").agg(F.count("*").alias("n")).collect()}  # two rows
    if not n.get(0) or not n.get(1):
        return frozenset()
    counted = before.select("y", F.explode("f").alias("w")).groupBy("w").agg(F.count_if(F.col("y") == 1).alias("bad"), F.count_if(F.col("y") == 0).alias("good"))
    odds = F.log((F.col("good") + 0.5) / (n[0] + 1)) - F.log((F.col("bad") + 0.5) / (n[1] + 1))
    error = F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("good") + 0.5))
    return frozenset(r["w"] for r in counted.where(odds >= MIN_Z * error).select("w").collect())  # bounded by max_rows


def classify(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", max_rows: int = MAX_ROWS, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    thin = docs.select("doc_id", F.col(text).alias("text"))
    train = stage(sample(thin, labels, label, max_rows), "toxic-sample")
    found = terms(train)
    cues = introductions(train, found)
    table = with_features(train, found, cues).join(train.select("doc_id", "y"), "doc_id").toPandas().sort_values("doc_id")  # max_rows at most
    x = np.array(table["f"].to_list(), float).reshape(len(table), len(NAMES))
    bias, w = logistic(x, table["y"].to_numpy(float), l2=1e-4, steps=2000)
    total = F.lit(bias)
    for k, weight in enumerate(w):
        total = total + F.get("f", F.lit(k)) * float(weight)
    scored = with_features(thin, found, cues).withColumn("score", 1 / (1 + F.exp(-total)))
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
