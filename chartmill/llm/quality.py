"""Quality classifier: a sparse ensemble of rules over text statistics."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartmill.llm.common import text_of, write_table

# most labelled rows that the classifier is fitted on
SAMPLE_ROWS = 20_000
THRESHOLD = 0.7
# folds by the checksum of the id; this one is held out
FOLDS, HELD_OUT = 4, 2


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def _without(text: Column, characters: str) -> Column:
    return F.length(F.regexp_replace(text, characters, ""))


def statistics(docs: DataFrame) -> DataFrame:
    """``doc_id`` and statistics of each whole text, none of them of another column."""
    text = text_of()
    base = docs.select("doc_id", text.alias("text")).select(
        "doc_id", "text",
        F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("words"),
        F.filter(F.split("text", "\n"), lambda w: w != "").alias("lines"),
    )
    n, chars = F.size("words"), F.length("text")
    counted = base.select(
        "doc_id", chars.alias("n_chars"), n.alias("n_words"), F.size("lines").alias("n_lines"),
        F.size(F.array_distinct("words")).alias("distinct_words"), F.size(F.array_distinct("lines")).alias("distinct_lines"),
        (chars - _without(F.col("text"), r"\p{Lu}+")).alias("upper"), (chars - _without(F.col("text"), r"\p{L}+")).alias("letters"),
        (chars - _without(F.col("text"), r"\p{Nd}+")).alias("digits"), (chars - _without(F.col("text"), r"[#$%&*|<>{}=~^_\\\[\]@+]+")).alias("symbols"),
        (chars - _without(F.col("text"), "!+")).alias("shouts"), (chars - _without(F.col("text"), r"[.,;:?]+")).alias("marks"),
    )
    c = F.col
    return counted.select(
        "doc_id", F.log1p(c("n_words").cast("double")).alias("log_words"), _share(c("n_chars"), c("n_words")).alias("word_length"),
        _share(c("n_words"), c("n_lines")).alias("line_words"), _share(c("distinct_words"), c("n_words")).alias("distinct_word_share"),
        # a long text repeats words by chance; against the root of its length it does not
        _share(c("distinct_words"), F.sqrt(c("n_words").cast("double"))).alias("distinct_word_rate"),
        _share(c("distinct_lines"), c("n_lines")).alias("distinct_line_share"), _share(c("upper"), c("letters")).alias("upper_share"),
        _share(c("letters"), c("n_chars")).alias("letter_share"), _share(c("digits"), c("n_chars")).alias("digit_share"),
        _share(c("symbols"), c("n_words")).alias("symbols_per_word"), _share(c("shouts"), c("n_words")).alias("shouts_per_word"),
        _share(c("marks"), c("n_words")).alias("marks_per_word"),
    )


FEATURES = ["log_words", "word_length", "line_words", "distinct_word_share", "distinct_word_rate", "distinct_line_share", "upper_share", "letter_share",
            "digit_share", "symbols_per_word", "shouts_per_word", "marks_per_word"]


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        return F.col(self.feature) > self.threshold if self.above else F.col(self.feature) <= self.threshold


Path = tuple[Condition, ...]


@dataclass(frozen=True)
class RuleModel:
    """Weighted conjunctions; their sum through the logistic function is the score."""

    intercept: float
    weighted: tuple[tuple[Path, float], ...]

    def score(self) -> Column:
        """The model as one column over ``FEATURES``."""
        total = reduce(Column.__add__, [F.when(holds(path), w).otherwise(0.0) for path, w in self.weighted], F.lit(self.intercept))
        return 1 / (1 + F.exp(-total))


def holds(path: Path) -> Column:
    return reduce(Column.__and__, [c.column() for c in path])


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are not looked at; a row without id has no label."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def tree_paths(model) -> list[Path]:
    """Every path from a root to an inner node's child, as a conjunction with one bound per feature and side."""
    found: dict[Path, None] = {}

    def walk(node, path: dict[tuple[str, bool], float]) -> None:
        if path:
            found[tuple(Condition(f, above, t) for (f, above), t in sorted(path.items()))] = None
        if node.numDescendants() == 0:
            return
        feature, threshold = FEATURES[node.split().featureIndex()], node.split().threshold()
        low, high = path.get((feature, False)), path.get((feature, True))
        walk(node.leftChild(), path | {(feature, False): threshold if low is None else min(low, threshold)})
        walk(node.rightChild(), path | {(feature, True): threshold if high is None else max(high, threshold)})

    for tree in model.trees:
        walk(tree._call_java("rootNode"), {})
    return list(found)


def labelled_rows(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Statistics and ``label`` of at most ``sample_rows`` labelled rows outside the held-out fold.

    The rows come first by the hash of their id, so the sample does not depend
    on partitions. Labels that are null or no 0 or 1 are left out; an id with
    several labels has the higher one.
    """
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    one = usable.groupBy("doc_id").agg(F.max("quality").cast("double").alias("label"))
    sample = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    # the sample is bounded by its parameter: a few hundred kilobytes
    marked = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    return statistics(marked.select("doc_id", "text")).join(F.broadcast(sample), "doc_id")


def fit(rows: DataFrame, trees: int = 30, depth: int = 3, penalty: float = 0.001, seed: int = 7) -> RuleModel:
    """Fit the ensemble on rows of ``FEATURES`` and ``label``.

    A forest of shallow trees proposes rules; logistic regression with a lasso
    penalty on their truth values keeps the few that matter. With one label
    only, or none, the score is a constant: the smoothed share of label 1.
    """
    rows = write_table(rows.select(*FEATURES, "label"), "quality-sample")
    count, positive = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    share = (positive + 1) / (count + 2) if count else 1.0
    if positive in (0, count):
        odds = max(share, 1e-6) / max(1 - share, 1e-6)
        return RuleModel(math.log(odds), ())
    table = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="onethird", maxBins=64).fit(table)
    paths = tree_paths(forest)
    truth = rows.select("label", *[holds(p).cast("double").alias(f"r{k}") for k, p in enumerate(paths)])
    truth = VectorAssembler(inputCols=[f"r{k}" for k in range(len(paths))], outputCol="features").transform(truth).select("label", "features")
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=penalty, maxIter=60, standardization=False).fit(write_table(truth, "quality-rules"))
    weights = lasso.coefficients.toArray()
    return RuleModel(float(lasso.intercept), tuple((p, float(w)) for p, w in zip(paths, weights) if w))


def score_quality(docs: DataFrame, model: RuleModel, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row, by one column expression.

    Null and empty texts have statistics of 0 and are scored like any other.
    Repeated rows are scored alike; extra columns are not read.
    """
    return statistics(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.score().alias("score")).withColumn(
        "predicted", F.when(F.col("score") >= threshold, 1).otherwise(0)
    )


def accepted(docs: DataFrame, model: RuleModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, that the model does not reject.

    A score equal to the threshold stays. Null and empty texts are scored like
    any other; repeated rows stay or go together. Columns may have any names:
    a row travels as one value. A model without rules rejects nothing.
    """
    if not model.weighted:
        return docs
    own = docs.select(F.struct(*docs.columns).alias("doc_id"), "text")
    scored = statistics(own).select(F.col("doc_id").alias("row"), model.score().alias("score"))
    # a filter on the score would be pushed down with the statistics spelt out again for every rule
    return scored.select(F.inline(F.when(F.col("score") >= threshold, F.array("row"))))
