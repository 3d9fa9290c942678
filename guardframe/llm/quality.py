"""Operator 3: text quality by a sparse ensemble of rules over statistics.

After RuleFit (Friedman and Popescu, 2008): the paths of shallow trees are conjunctive
rules; a lasso logistic regression gives most of them no weight; the rest become Spark
column expressions over the statistics.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from guardframe.llm.common import durable, remainder, sample_by_hash, slices, table

#: Labelled rows that a model is fitted on: about so many, of low hashes of their ids, where there are more.
SAMPLE = 20_000
#: Trees, their depth, and the weight of the lasso.
TREES, DEPTH, LASSO = 20, 4, 0.0005
#: From this score on a document is kept.
THRESHOLD = 0.3

STATISTICS = (
    "log_chars", "log_words", "word_length", "longest_word", "upper", "digit", "space", "symbol", "mark",
    "bar", "bang", "odd_ends", "distinct_words", "top_word", "repeated_runs", "repeated_lines", "line_words",
    "stops", "capitals", "non_ascii", "short_words", "word_entropy", "doubled",
)

_CLASS = np.zeros(256, np.uint8)
_CLASS[65:91], _CLASS[48:58] = 1, 2
_CLASS[[9, 10, 11, 12, 13, 32]] = 3
_CLASS[[ord(c) for c in "#$%&*@^~<>{}[]\\_=+"]] = 4
_CLASS[[ord(c) for c in ".,;:?'\"()-"]] = 5
_CLASS[ord("|")], _CLASS[ord("!")] = 6, 7
_CLASS[128:] = 8
_ENDS = re.compile(rb"[#$%&*@^~|!+=]{2,}$")


def statistics(text: str | None) -> list[float]:
    """The STATISTICS of a whole text; an empty one has zeros."""
    data = (text or "").encode()
    words = data.split()
    if not words:
        return [0.0] * len(STATISTICS)
    n = len(words)
    kinds = np.bincount(_CLASS[np.frombuffer(data, np.uint8)], minlength=9) / len(data)
    lengths = np.fromiter(map(len, words), np.int64, n)
    low = data.lower().split()
    counts = np.array(list(Counter(low).values()))
    lines = [x.strip() for x in data.split(b"\n") if x.strip()]
    grams = n - 4
    repeated = 1 - len(set(zip(words, words[1:], words[2:], words[3:], words[4:]))) / grams if grams > 0 else 0.0
    ends = sum(map(bool, map(_ENDS.search, words)))
    share = counts / n
    return [
        float(np.log1p(len(data))), float(np.log1p(n)), float(lengths.mean()), float(np.log1p(lengths.max())),
        kinds[1], kinds[2], kinds[3], kinds[4], kinds[5], kinds[6], kinds[7],
        ends / n, len(counts) / n, float(share.max()), repeated, 1 - len(set(lines)) / len(lines), float(np.log1p(n / len(lines))),
        data.count(b".") / n, sum(w[:1].isupper() for w in words) / n, kinds[8], float((lengths < 4).mean()),
        float(-(share * np.log(share)).sum() / max(1.0, np.log(n))) if n > 1 else 0.0,
        sum(a == b for a, b in zip(low, low[1:])) / n,
    ]


def text_statistics(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns to keep, and `stats`, the array of STATISTICS of each row's text."""
    kept = docs.select(*keep, F.col(text).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "_text")

    def run(batches):
        for batch in slices(batches, "_text", 16 << 20):
            rows = [statistics(t) for t in batch.column("_text").to_pylist()]
            columns = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(rows, pa.list_(pa.float64()))], names=[*keep, "stats"])

    return kept.mapInArrow(run, f"{schema}, stats array<double>")


def tree_rules(forest) -> list[tuple[tuple[int, bool, float], ...]]:
    """The distinct paths of a forest's trees, from the root to each inner or last node, as conjunctions.

    A condition is (statistic, above, threshold): its value is above the threshold, or not.
    """
    rules = {}

    def walk(node, path):
        if path:
            rules[_merged(path)] = None
        if node.getClass().getSimpleName() == "InternalNode":
            split = node.split()
            at, threshold = split.featureIndex(), split.threshold()
            walk(node.leftChild(), [*path, (at, False, threshold)])
            walk(node.rightChild(), [*path, (at, True, threshold)])

    for tree in forest.trees:
        walk(tree._java_obj.rootNode(), [])
    return list(rules)


def _merged(path):
    """A conjunction with the tightest bound of each statistic and direction, in a fixed order."""
    bounds = {}
    for at, above, threshold in path:
        old = bounds.get((at, above))
        bounds[at, above] = threshold if old is None else (max if above else min)(old, threshold)
    return tuple(sorted((at, above, t) for (at, above), t in bounds.items()))


def rule_column(rule, stats: str = "stats") -> Column:
    """A rule as a column, 1.0 where it holds."""
    holds = F.lit(True)
    for at, above, threshold in rule:
        value = F.col(stats)[at]
        holds &= (value > threshold) if above else (value <= threshold)
    return F.when(holds, 1.0).otherwise(0.0)


class RuleModel:
    """Weighted rules and an intercept; `column()` is the probability of label 1."""

    def __init__(self, intercept: float, rules: list[tuple[tuple, float]]):
        self.intercept, self.rules = intercept, rules

    def column(self, stats: str = "stats") -> Column:
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total += rule_column(rule, stats) * weight
        return 1 / (1 + F.exp(-total))

    def describe(self) -> list[str]:
        """The rules in words, heaviest first."""
        say = lambda rule: " and ".join(f"{STATISTICS[a]} {'>' if up else '<='} {t:.4g}" for a, up, t in rule)
        return [f"{w:+.3f} if {say(r)}" for r, w in sorted(self.rules, key=lambda x: -abs(x[1]))]


def fit_rules(labelled: DataFrame, sample: int = SAMPLE, trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO) -> RuleModel:
    """A model from labelled(doc_id, stats, label 0 or 1), of which about `sample` rows are taken by their ids' hashes.

    With labels of one kind only, or none, it has no rules and the smoothed share of ones.
    """
    rows = durable(
        sample_by_hash(labelled, sample, "doc_id")
        .select(array_to_vector("stats").alias("features"), "stats", F.col("label").cast("double").alias("label"))
    )
    n, ones = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    prior = float(np.log((ones + 1) / (n - ones + 1)))
    if ones in (0, n):
        return RuleModel(prior, [])
    # a split sees a third of the statistics, so that trees and their paths differ
    forest = RandomForestClassifier(
        numTrees=trees, maxDepth=depth, seed=7, minInstancesPerNode=5, featureSubsetStrategy="onethird", subsamplingRate=0.8
    ).fit(rows.select("features", "label"))
    rules = tree_rules(forest)
    if not rules:
        return RuleModel(prior, [])
    marked = rows.select("label", array_to_vector(F.array(*map(rule_column, rules))).alias("features"))
    fitted = LogisticRegression(elasticNetParam=1.0, regParam=lasso, maxIter=100, standardization=True).fit(durable(marked))
    weights = fitted.coefficients.toArray()
    return RuleModel(float(fitted.intercept), [(r, float(w)) for r, w in zip(rules, weights) if w])


def quality_scores(
    docs: DataFrame, labels: DataFrame, held_out: Column, keep: list[str] | None = None, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row, with any columns to keep.

    labels(doc_id, quality): rows with a null id or label, or of held-out documents, are
    not learned from. A null or empty text has all statistics 0 and is scored like any
    other. Rows that repeat an id are scored alike if their texts are. A null held_out counts as
    false. An empty table gives an empty result. lang, source and the id are no inputs.
    """
    keep = keep or []
    source = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text).alias("text"), *keep)
    scored = durable(text_statistics(source, ["doc_id", "held_out", *keep], "text"))
    marks = labels.where("quality is not null").select(F.col("doc_id").alias("label_id"), F.col("quality").alias("label"))
    known = scored.where(~F.col("held_out")).join(marks, F.col("doc_id") == F.col("label_id")).select("doc_id", "stats", "label")
    score = fit_rules(known).column()
    return scored.select("doc_id", "held_out", score.alias("score"), *keep).withColumn(
        "predicted", (F.col("score") >= THRESHOLD).cast("int")
    )


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; those whose crc32 modulo 5 is 0 are held out of training."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality_scores(docs, labels, remainder(F.col("doc_id"), 5) == 0)
