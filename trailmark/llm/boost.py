"""Gradient-boosted trees: fitted by Spark ML, applied as a SQL expression.

The fitted trees become nested CASE expressions over the feature columns, so that scoring stays in
one projection and also works inside array functions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.llm import common

_SPLIT = re.compile(r"\s*If \(feature (\d+) <= ([^)]+)\)")
_LEAF = re.compile(r"\s*Predict: (\S+)")


@dataclass(frozen=True)
class Model:
    """`trees`: (weight, node); a node is a leaf value or (feature, threshold, left, right)."""

    features: tuple[str, ...]
    trees: tuple[tuple[float, object], ...]
    constant: float | None = None

    def probability(self, values: Mapping[str, Column]) -> Column:
        """Probability of label 1, where `values` holds a non-null double for every feature."""
        if self.constant is not None:
            return F.lit(self.constant)
        margin = F.lit(0.0)
        for weight, node in self.trees:
            margin = margin + F.lit(weight) * self._expression(node, values)
        return 1 / (1 + F.exp(-2 * margin))

    def _expression(self, node, values: Mapping[str, Column]) -> Column:
        if isinstance(node, float):
            return F.lit(node)
        feature, threshold, left, right = node
        return F.when(values[self.features[feature]] <= threshold, self._expression(left, values)).otherwise(
            self._expression(right, values)
        )


def _node(lines: Iterator[str]):
    line = next(lines)
    leaf = _LEAF.match(line)
    if leaf:
        return float(leaf[1])
    split = _SPLIT.match(line)
    left = _node(lines)
    next(lines)  # the Else line
    return int(split[1]), float(split[2]), left, _node(lines)


def weighted(rows: DataFrame, strata: Sequence[str], limit: int) -> DataFrame:
    """About `limit` at most of the distinct `rows`, with a `_weight` so that they stand for all rows.

    Of each stratum as many are taken as its share of `limit` allows; small strata leave theirs to the
    others. A row stays in with a probability in proportion to how often it occurs, at most 1, by a
    hash, and weighs that often divided by the probability: what is common is never left out.
    """
    distinct = common.cut(rows.groupBy(*rows.columns).agg(F.count("*").alias("_n")))
    sizes = distinct.groupBy(*strata).agg(F.sum("_n").alias("_rows")).collect()  # kinds and labels, a few
    left, chance = limit, F.lit(1.0)
    for k, r in enumerate(sorted(sizes, key=lambda r: r["_rows"])):
        share = min(r["_rows"], left / (len(sizes) - k))
        left -= share
        here = F.lit(True)
        for name in strata:
            here = here & F.col(name).eqNullSafe(F.lit(r[name]))
        chance = F.when(here, F.least(F.lit(1.0), F.col("_n") * (share / r["_rows"]))).otherwise(chance)
    drawn = F.pmod(F.xxhash64(*rows.columns), F.lit(1 << 30)) < chance * (1 << 30)
    return distinct.filter(drawn).withColumn("_weight", F.col("_n") / chance).drop("_n")


def fit(rows: DataFrame, features: Sequence[str], label: str, limit: int, trees: int = 10, depth: int = 3,
        strata: Sequence[str] = ()) -> Model:
    """Fits on at most about `limit` distinct rows, weighted to stand for all, in strata by label and
    the features `strata`. With one label only, or no row, the model is a constant: that label's value,
    or 0."""
    known = rows.select(*features, F.col(label).cast("double").alias("_label")).filter(F.col("_label").isNotNull())
    sample = common.cut(weighted(known, ["_label", *strata], limit))
    labels = [r[0] for r in sample.select("_label").distinct().collect()]
    if len(labels) < 2:
        return Model(tuple(features), (), float(next(iter(labels), 0)))
    vectors = VectorAssembler(inputCols=list(features), outputCol="_features").transform(sample)
    fitted = GBTClassifier(
        featuresCol="_features", labelCol="_label", weightCol="_weight", maxIter=trees, maxDepth=depth, seed=7,
        checkpointInterval=-1,
    ).fit(vectors.select("_features", "_label", "_weight"))
    found, lines = [], iter(fitted.toDebugString.splitlines()[1:])
    for line in lines:
        weight = re.match(r"\s*Tree \d+ \(weight ([^)]+)\)", line)
        if weight:
            found.append((float(weight[1]), _node(lines)))
    return Model(tuple(features), tuple(found))
